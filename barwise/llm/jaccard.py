"""N-gram Jaccard join by universe partition, pigeonhole and exact verification.

A document's set holds the hashes of its distinct word n-grams.  Two sets link
when den * intersection >= num * union; then their symmetric difference is at
most H = (den - num) * (sizes' sum) // (den + num).

Sets are dealt into size bands.  In a band every token falls by its hash into one
of m segments, so a set is cut into m subsets.  A set of size n emits the
signatures of its subsets in the first K(n) segments, where K(n) is more than the
H of any pair in which it is the smaller one: some segment then holds equal
subsets in both.  The first d segments of a band also emit the subset with each
one token left out (the one-deletion neighbourhood), so an error there costs two.
d and the reserve of segments are allocated per band by a cost model (rows that a
set emits against the chance that empty segments use up its reserve); bands are as
wide as their segments stay filled.  With the
reserve a pair shares not one but ``least`` signatures; only where a set's empty
segments eat into it (a weak set) may it be fewer.  A set whose subsets don't reach H + 1 all
the same is ``wild`` and has a second way: up to ``SMALL`` tokens, where that can
happen at all often, by its first tokens in order of a hash, of which a partner has one
among its own first ones; beyond, by its empty segments, which no partner can avoid.

Of the signatures that a set shares with others it is looked for by its rarest ones only, so many that a pair which
shares ``least`` still meets; signatures of common passages drop out.  The sets that meet by one signature are a group,
and groups with the same members count once.  Each set is compared with a hub of its group, first by parity sketches
(``FIRST`` bits, and beyond as many tokens a power of two from ``SKETCH`` on, no less than the set has tokens; they differ in no more
places than the sets in tokens), then by its whole tokens; that makes one
class of most groups of near copies, at a linear cost.  Only the sets of pairs that their sketches let through have their tokens moved.  Groups with members of several classes, of which some are linked,
get another hub, ``ROUNDS`` in all, and only those that remain are looked at inside, groups of much the same members as one: sketches of different classes are compared in blocks of ``BLOCK``
sets, and families of sets that these join are compared whole, block against block.  So sets that meet nobody's sketch
cost no tokens, classes are never taken apart into pairs, and no task holds more than two blocks.

Defined results: a null or empty text, or one without words, is an empty set and
its own class; fewer words than n are one n-gram; equal sets are one class
(repeated rows too); a row without id is linked with nothing and has no class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.llm.common import SPACES, Scratch, Words, mix, rows_of, word_table

WORD = word_table(SPACES)
BLOCK = 256
SEEN = 1 << 20  # sets that a task remembers
SKETCH, FIRST = 2048, 512  # bits of a set's sketches; the longer one, of SKETCH at least, is for sets with more than FIRST tokens
BITMAP = 1 << 24  # bits of the filter that spares tasks the token lists of sets without candidates (2 MB)
RISK = 1 / 400  # share of sets that may be weak
WEAK_COST = 200.0  # rows that a weak set is reckoned to cost
BANDS = 255  # largest number of a band
ROUNDS = 4  # hubs that a group is compared with
FULL = 2.5  # tokens of a segment that a set at the lower end of a band has at least
SMALL = 48  # sets up to this size have a second way of being found
EDGES = 1 << 18  # edges of a graph that a task takes, at least


# ---- bands and allocation ---------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    words: int = 4
    num: int = 85
    den: int = 100

    def largest_partner(self, n):
        return n * self.den // self.num

    def errors(self, n):
        """Most errors of a pair whose smaller set has ``n`` tokens."""
        return (self.den - self.num) * (n + self.largest_partner(n)) // (self.den + self.num)


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    least: int  # signatures that a linked pair shares, unless its smaller set is weak
    deletions: int
    reserve: int
    segments: int


def _tail(mean: float, k: int) -> float:
    """P(more than k) of a Poisson count."""
    term, total = math.exp(-mean), 0.0
    for i in range(k + 1):
        total += term
        term *= mean / (i + 1)
    return max(0.0, 1.0 - total)


def _band(rule: Rule, low: int, exponent: int, share: int) -> Band:
    high = low * rule.den ** exponent // rule.num ** exponent
    best, least = None, 1 + (rule.errors(low) + 1) // share
    for d in (0, 1, 2):
        for reserve in range(d + least - 1, d + least + 96):
            k = max(1, rule.errors(low) + 1 - d + reserve)
            m = max(1, rule.errors(high) + 1 - d + reserve)
            per = max(1.0, low * rule.num / rule.den) / m  # tokens of a segment in the smallest set that comes here
            risk = _tail(k * math.exp(-per), reserve - least + 1)
            cost = k + d * low / m + WEAK_COST * risk
            if best is None or cost < best[0]:
                best = cost, Band(low, high, least, d, reserve, m)
            if risk < RISK:
                break
    return best[1]


@lru_cache(maxsize=16)
def bands(rule: Rule) -> tuple[Band, ...]:
    """Bands as wide as their segments stay ``FULL``: wide ones are entered by fewer sets from below, narrow ones need fewer segments for a set."""
    probe = 1000
    choices = [(e, share) for e in (3, 2, 1) for share in (4, 8)]
    exponent, share = next((c for c in choices if probe / _band(rule, probe, *c).segments >= FULL), choices[-1])
    out, low = [], 1
    while low < 1 << 40:
        out.append(_band(rule, low, exponent, share))
        low = out[-1].high + 1
    return tuple(out)


# ---- sets and signatures -------------------------------------------------------------

def token_sets(col: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): the sorted distinct token hashes of row i are tokens[bounds[i]:bounds[i + 1]]."""
    w = Words(col, WORD)
    per = np.diff(w.rows)
    row = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(row)) - w.rows[row]
    grams = w.grams(words)
    keep = place + words <= per[row]
    for n in range(1, words):  # short texts: the whole sequence
        short = (per[row] == n) & (place == 0)
        if short.any():
            grams = np.where(short, w.grams(n), grams)
            keep |= short
    row, grams = row[keep], grams[keep]
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    row, grams = row[first], grams[first]
    return grams, np.searchsorted(row, np.arange(len(per) + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def set_ids(tokens: np.ndarray, bounds: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    a = _sums(mix(tokens + np.uint64(seed * 2 + 1)), bounds)
    b = _sums(mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)), bounds)
    return mix(a + np.diff(bounds).astype(np.uint64)).view(np.int64), mix(b).view(np.int64)


def signatures(tokens: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """(row, signature, weak) of every subset emitted; (row, code) of the second way; and what each row's subsets weigh beyond its H.

    The low eight bits of a signature are its band.  A pair shares at least as many signatures as the subsets of its
    smaller set weigh beyond H; where that is below the band's ``least`` the row is weak there, and wild below 1.
    """
    table = bands(rule)
    n = np.diff(bounds)
    lows = np.array([b.low for b in table])
    column = {k: np.array([getattr(b, k) for b in table]) for k in ("least", "deletions", "reserve", "segments")}
    need = np.full(len(n), np.iinfo(np.int32).max, np.int64)
    rows, sigs, weak, empty_rows, empties = [], [], [], [], []
    own = np.searchsorted(lows, n, side="right") - 1
    weight = mix(tokens + np.uint64(0x5851F42D4C957F2D))
    part = mix(tokens ^ np.uint64(0x14057B7EF767814F)) >> np.uint64(20)
    for step in (0, 1):
        band = own + step
        live = rule.errors(n) > 0
        if step:
            live &= rule.largest_partner(n) >= lows[np.minimum(band, len(lows) - 1)]
        which = np.flatnonzero(live)
        if not len(which):
            continue
        b = band[which]
        d, m = column["deletions"][b], column["segments"][b]
        k = np.minimum(m, np.maximum(1, rule.errors(n[which]) + 1 - d + column["reserve"][b]))
        at = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in which])
        local = np.repeat(np.arange(len(which)), n[which])
        segment = (part[at] % m[local].astype(np.uint64)).astype(np.int64)
        inside = segment < k[local]
        at, local, segment = at[inside], local[inside], segment[inside]
        order = np.argsort(local * (int(m.max()) + 1) + segment, kind="stable")
        at, local, segment = at[order], local[order], segment[order]
        new = np.ones(len(at), bool)
        new[1:] = (local[1:] != local[:-1]) | (segment[1:] != segment[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        total = _sums(weight[at], np.append(start, len(at)))
        salt = mix((b[local] * 1_000_003 + segment).astype(np.uint64))
        label = b.astype(np.uint64)[local]
        coded = lambda h, of: (mix(h) & ~np.uint64(BANDS)) | label[of]
        rows.append(which[local[start]])
        sigs.append(coded(total + salt[start], start))
        group = np.repeat(np.arange(len(start)), size)
        cut = (segment < d[local]) & (size[group] > 1)
        rows.append(which[local[cut]])
        sigs.append(coded(total[group[cut]] - weight[at[cut]] + salt[cut], cut))
        have = np.bincount(local[start], minlength=len(which)) + np.bincount(local[start[(segment[start] < d[local[start]]) & (size > 1)]], minlength=len(which))
        beyond = have - rule.errors(n[which])
        need[which] = np.minimum(need[which], beyond)
        feeble = beyond < column["least"][b]
        weak += [feeble[local[start]], feeble[local[cut]]]
        full = np.zeros((len(which), int(k.max())), bool) if len(which) * int(k.max()) < 1 << 26 else None
        if full is not None:
            full[local[start], segment[start]] = True
            r, s = np.nonzero(~full & (np.arange(full.shape[1]) < k[:, None]))
        else:
            r, s = (np.concatenate(x) for x in zip(*[(np.full(len(z), i), z) for i in range(len(which)) for z in [np.setdiff1d(np.arange(k[i]), segment[start][local[start] == i])]]))
        large = n[which[r]] > SMALL
        empty_rows.append(which[r[large]])
        empties.append(b[r[large]] * (1 << 40) + s[large])
    # the first tokens by hash, so many that a linked pair has one in common
    own = np.flatnonzero((n > 0) & (n <= rule.largest_partner(SMALL)) & (rule.errors(n) > 0))
    if len(own):
        at = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in own])
        local = np.repeat(np.arange(len(own)), n[own])
        code = mix(tokens[at] ^ np.uint64(0x632BE59BD9B4E019))
        order = np.lexsort((code, local))
        place = np.arange(len(at)) - np.searchsorted(local, local)
        first = place < (n[own] - -(-n[own] * rule.num // rule.den) + 1)[local]
        empty_rows.append(own[local[order][first]])
        empties.append((((code[order][first]) >> np.uint64(3)) | np.uint64(1 << 61)).astype(np.int64))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(rows, np.int64), join(sigs, np.uint64), join(weak, bool), join(empty_rows, np.int64), join(empties, np.int64), need


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[order]))


def _describe(batches: Iterator[pa.RecordBatch], rule: Rule, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch, "text", 1 << 20):
            tokens, bounds = token_sets(part.column("text"), rule.words)
            sid, check = set_ids(tokens, bounds, seed)
            _, _, _, rows, codes, need = signatures(tokens, bounds, rule)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sid, mask=n == 0), pa.array(check), pa.array(need, pa.int64()),
                                              _lists(rows, codes, part.num_rows)], names=["doc_id", "n", "sid", "chk", "need", "empties"])


def _signed(batches: Iterator[pa.RecordBatch], rule: Rule, seed: int) -> Iterator[pa.RecordBatch]:
    """(sig, sid, weak); a task emits the copies of a set once, as long as it remembers it."""
    seen: set[int] = set()
    for batch in batches:
        for part in rows_of(batch, "text", 1 << 20):
            tokens, bounds = token_sets(part.column("text"), rule.words)
            sid, _ = set_ids(tokens, bounds, seed)
            new = np.zeros(len(sid), bool)
            for r, s in enumerate(sid.tolist()):
                if s not in seen:
                    new[r] = True
                    seen.add(s)
            if len(seen) > SEEN:
                seen.clear()
            rows, sigs, weak, _, _, _ = signatures(tokens, bounds, rule)
            rows, sigs, weak = rows[new[rows]], sigs[new[rows]], weak[new[rows]]
            yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(sid[rows]), pa.array(weak)], names=["sig", "sid", "weak"])


def sketch(tokens: np.ndarray, bounds: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """(rows, bits / 64) words: bit i is set where an odd number of the row's tokens falls to i.

    Where two sets differ in k tokens their sketches differ in k bits at most.
    """
    place = (mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key, times = np.unique(row * bits + place, return_counts=True)
    key = key[times % 2 == 1]
    flags = np.zeros((len(bounds) - 1) * bits, np.uint8)
    flags[key] = 1
    return np.packbits(flags.reshape(-1, bits), axis=1, bitorder="little").view(np.int64) if len(bounds) > 1 else np.zeros((0, bits // 64), np.int64)


def long_sketches(sets: list[np.ndarray]) -> list[np.ndarray]:
    """A sketch per set, of no fewer bits than it has tokens, so that it isn't full; none for sets of up to ``FIRST`` tokens."""
    n = np.array([len(s) for s in sets], np.int64)
    out = [np.zeros(0, np.int64)] * len(sets)
    bits = np.where(n > FIRST, np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)), 0)
    for b in np.unique(bits[bits > 0]).tolist():
        rows = np.flatnonzero(bits == b)
        for r, words in zip(rows.tolist(), sketch(np.concatenate([sets[r] for r in rows]), np.cumsum([0, *n[rows]]), b)):
            out[r] = words
    return out


def fold_sketch(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (the last axis) as they are with ``width`` words: a power of two, so bits fall together whose places agree modulo it."""
    return np.bitwise_xor.reduce(words.reshape(*words.shape[:-1], -1, width), axis=-2)


def _sets(batches: Iterator[pa.RecordBatch], rule: Rule, seed: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(sid, n, brief, sketch, tokens) of the sets whose place in the bitmap ``wanted`` is set; a set of ``FIRST`` tokens or fewer has no long sketch."""
    for batch in batches:
        for part in rows_of(batch, "text", 1 << 20):
            tokens, bounds = token_sets(part.column("text"), rule.words)
            sid, _ = set_ids(tokens, bounds, seed)
            place = sid & (BITMAP - 1)
            keep = np.flatnonzero(((wanted[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool) & (np.diff(bounds) > 0))
            own = [tokens[bounds[r]:bounds[r + 1]] for r in keep]
            ends = np.cumsum([0, *map(len, own)])
            flat = np.concatenate([*own, np.zeros(0, np.uint64)])
            to_list = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
            brief, long = sketch(flat, ends, FIRST), long_sketches(own)
            yield pa.RecordBatch.from_arrays([pa.array(sid[keep]), pa.array(np.diff(ends), pa.int64()), to_list(brief.ravel(), np.arange(len(keep) + 1) * brief.shape[1]),
                                              to_list(np.concatenate([*long, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, long)])), to_list(flat.view(np.int64), ends)],
                                             names=["sid", "n", "brief", "sketch", "tokens"])


def _only(full: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, tokens) of ``full`` for the ``sids``, and few others: token lists that nobody asks for aren't shuffled."""
    wanted = full.sparkSession.sparkContext.broadcast(_bitmap(sids))

    def kept(batches):
        for batch in batches:
            place = batch.column("sid").to_numpy(zero_copy_only=False) & (BITMAP - 1)
            yield batch.filter(pa.array(((wanted.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)))
    return full.select("sid", "tokens").mapInArrow(kept, "sid long, tokens array<long>")


def _bitmap(sids: DataFrame) -> np.ndarray:
    """Which of BITMAP places (of constant size, whatever the number of sets) hold a set id."""
    place = F.col("sid").bitwiseAND(F.lit(BITMAP - 1))
    words = sids.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, CAST(sid & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out, found = np.zeros(BITMAP >> 6, np.uint64), words.toArrow()  # BITMAP / 64 rows at most
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


# ---- classes ------------------------------------------------------------------------------

def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in as many tasks as they are worth: a small graph goes through many rounds, and every task of a shuffle leaves files."""
    return df.coalesce(max(1, -(-rows // EDGES)))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) of every id in the edges (a, b): the smallest id that they tie it to."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for x, y in zip(at[:len(a)].tolist(), at[len(a):].tolist()):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return ids, ids[[find(x) for x in range(len(ids))]] if len(ids) else ids


def _stars(batches: Iterator[pa.RecordBatch], most: int, loops: bool) -> Iterator[pa.RecordBatch]:
    """``stars`` of the edges (a, b) that a task reads, ``most`` or a batch more at a time; ``loops``: with the roots' own rows."""
    held, rows = [], 0

    def done():
        ids, root = stars(*(np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("a", "b")))
        keep = np.full(len(ids), True) if loops else ids != root
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep])], names=["a", "b"])
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > most:
            yield done()
            held, rows = [], 0
    if held:
        yield done()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b): the smallest id reachable.

    Each task makes stars of the edges that it reads.  If no more than ``EDGES`` are left, one task takes them all: rounds over
    so small a graph would be hundreds of stages, which the driver keeps track of.  Larger graphs go through rounds of hooking to
    the smallest neighbour.
    """
    most = EDGES
    left = scratch.write(edges.where("a <> b").select("a", "b").mapInArrow(lambda it: _stars(it, most, False), "a long, b long"), name)
    if left.count() <= most:
        roots = scratch.write(left.coalesce(1).mapInArrow(lambda it: _stars(it, most, True), "a long, b long"), name)
        scratch.drop(left)
        return roots.select(F.col("a").alias("id"), F.col("b").alias("root"))
    both = scratch.write(left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    scratch.drop(left)
    while True:
        rows = both.count()
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every neighbour, and the node itself, is tied to the smallest of them instead
        tied = both.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
        tied = _dealt(tied.where("x <> y"), rows)
        turned = tied.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("e"))
        new = scratch.write(_dealt(turned.select("e.*").distinct(), rows), name)
        scratch.drop(both)
        # done when every edge ties an id to the least of its class and no id has two
        open_ends = new.where("b < a").groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.max("b").alias("b"))
        middle = open_ends.join(new.where("b < a").select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1)
        if not open_ends.where("k > 1").limit(1).unionByName(middle.select("a", "k", "b")).take(1):
            roots = new.where("b < a").select(F.col("a").alias("id"), F.col("b").alias("root"))
            return roots.unionByName(new.where("b > a").select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
        both = new


# ---- verification ---------------------------------------------------------------------------

def links_within(sets: list[np.ndarray], known: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links among the sets that join different classes; ``known`` has the class of each so far."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[token] > 1
    token, owner = np.unique(token[shared], return_inverse=True)[1] if shared.any() else token[shared], owner[shared]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    top = int(token[-1]) + 1 if len(token) else 0
    for lo in range(0, top, 4096):
        a, b = np.searchsorted(token, (lo, lo + 4096))
        m = np.zeros((len(sets), min(4096, top - lo)), np.float32)
        m[owner[a:b], token[a:b] - lo] = 1.0
        inter += m @ m.T
    common = np.rint(inter).astype(np.int64)
    union = size[:, None] + size[None, :] - common
    ok = rule.den * common >= rule.num * union
    ok &= known[:, None] != known[None, :]
    ok &= np.tri(len(sets), k=-1, dtype=bool)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    out = []
    for i, j in np.argwhere(ok).tolist():
        x, y = find(i), find(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _verify(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows in order of (family, bi, bj): links of each such group; one group is held at a time."""
    key, ids, known, sets = None, [], [], []

    def done():
        found = links_within(sets, np.array(known), rule) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["a", "b"])
    for batch in batches:
        fam, bi, bj = (batch.column(c).to_pylist() for c in ("family", "bi", "bj"))
        cls, sid = batch.column("class").to_pylist(), batch.column("sid").to_pylist()
        tokens = batch.column("tokens")
        for r in range(batch.num_rows):
            k = fam[r], bi[r], bj[r]
            if k != key:
                if len(ids) > 1:
                    yield done()
                key, ids, known, sets = k, [], [], []
            ids.append(sid[r])
            known.append(cls[r])
            sets.append(tokens[r].values.to_numpy(zero_copy_only=False).copy())
    if len(ids) > 1:
        yield done()


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges (a, b) among n nodes join two trees, taken in order."""
    parent, keep = list(range(n)), np.zeros(len(a), bool)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def near_forest(sid: np.ndarray, cls: np.ndarray, n: np.ndarray, brief: np.ndarray, long: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of a forest that spans whatever pairs of different classes have sizes and sketches that allow a link; ``long`` is empty where a set has none."""
    allowed = lambda i, other, gap: gap * (rule.den + rule.num) <= (rule.den - rule.num) * (n[other] + n[i])
    width = np.array([len(x) for x in long], np.int64)
    by = {w: np.stack([long[r] for r in np.flatnonzero(width == w)]) for w in np.unique(width[width > 0]).tolist()}
    at = np.zeros(len(width), np.int64)
    for w in by:
        at[width == w] = np.arange(len(by[w]))

    def gaps(i, other):
        out = np.zeros(len(other), np.int64)
        for w in np.unique(width[other]).tolist():
            if w:
                these, short = width[other] == w, min(w, int(width[i]))
                out[these] = np.bitwise_count(fold_sketch(by[w][at[other[these]]], short) ^ fold_sketch(long[i], short)).sum(axis=1, dtype=np.int64)
        return out
    a, b = [], []
    for i in range(len(sid) - 1):
        later, mine = n[i + 1:], n[i]
        other = i + 1 + np.flatnonzero((cls[i + 1:] != cls[i]) & (np.minimum(later, mine) * rule.den >= np.maximum(later, mine) * rule.num))
        if len(other):
            hit = other[allowed(i, other, np.bitwise_count(brief[other] ^ brief[i]).sum(axis=1, dtype=np.int64))]
            if width[i] and len(hit):
                hit = hit[allowed(i, hit, gaps(i, hit))]
            a.append(np.full(len(hit), i))
            b.append(hit)
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a, b))
    keep = _forest(a, b, len(sid))
    a, b = sid[a[keep]], sid[b[keep]]
    return np.minimum(a, b), np.maximum(a, b)


def _near(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows (sig, bi, bj, sid, class, n, brief, sketch) in order of (sig, bi, bj): ``near_forest`` of each such group."""
    held: list[pa.RecordBatch] = []

    def done(parts):
        whole = pa.Table.from_batches(parts).combine_chunks()
        value = lambda c: whole[c].to_numpy()
        brief = whole["brief"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(whole.num_rows, -1)
        lists = whole["sketch"].combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        long = np.split(flat, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))[:-1])
        a, b = near_forest(value("sid"), value("class"), value("n"), brief, long, rule)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sig", "bi", "bj")], axis=1)
        if not len(keys):
            continue
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        for lo, hi in zip(starts, np.append(starts[1:], len(keys))):
            if held and tuple(keys[lo]) != last:
                yield done(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(keys[lo])
    if held:
        yield done(held)


def prefixes(signed: DataFrame, rule: Rule) -> DataFrame:
    """(sig, sid) of the signatures that a set is looked for by, each held by two sets or more.

    A linked pair shares ``least`` signatures of a band.  So of k signatures that a set shares with others, all but the
    k - least + 1 rarest can go: one of the pair's is among these in both sets.  Weak sets keep theirs, and so does
    whoever shares them.
    """
    by_sig = W.partitionBy("sig")
    met = signed.withColumns({"lo": F.min("sid").over(by_sig), "hi": F.max("sid").over(by_sig), "by_weak": F.max("weak").over(by_sig)}).where("lo < hi")
    met = met.groupBy("sig", "sid").agg(F.max("weak").alias("weak"), F.max("by_weak").alias("by_weak"))
    met = met.withColumn("df", F.count(F.lit(1)).over(by_sig))
    band = F.col("sig").bitwiseAND(BANDS).cast("int")
    own = W.partitionBy("sid", band)
    ranked = met.withColumns({"k": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("df", "sig"))})
    least = F.array(*[F.lit(b.least) for b in bands(rule)])[band]
    return ranked.where(F.col("by_weak") | (F.col("rank") <= F.col("k") - least + 1)).select("sig", "sid")


def groups_of(rows: DataFrame) -> DataFrame:
    """(sig, sid, hub, size) of the groups of two sets or more; of groups with the same members one stays.  ``hub`` is the least member."""
    per = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("sid").alias("hub"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("members")).where("size > 1")
    one = per.groupBy("size", "hub", "members").agg(F.min("sig").alias("sig")).select("sig", "hub", "size")
    return rows.join(one, "sig")


def _gap(a: str, b: str):
    """Bits in which two sketches differ, both as they are with the words of the shorter one."""
    width = F.least(F.size(a), F.size(b))
    folded = lambda x, i: F.aggregate(F.sequence(i, F.size(x) - 1, width), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(x, j)))
    differ = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.bit_count(folded(a, i).bitwiseXOR(folded(b, i))))
    return F.when(width > 0, F.aggregate(differ, F.lit(0), lambda acc, x: acc + x)).otherwise(0)


def _confirmed(pairs: DataFrame, full: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link: sizes and sketches first, then the whole sets of those that remain."""
    of = lambda side, *names: full.select(F.col("sid").alias(side), *[F.col(n).alias(f"{side}_{n}") for n in names])
    allowed = (rule.den - rule.num) * (F.col("a_n") + F.col("b_n"))
    near = pairs.join(of("a", "n", "brief", "sketch"), "a").join(of("b", "n", "brief", "sketch"), "b")
    near = near.where(F.least("a_n", "b_n") * rule.den >= F.greatest("a_n", "b_n") * rule.num)
    near = near.where(_gap("a_brief", "b_brief") * (rule.den + rule.num) <= allowed).where(_gap("a_sketch", "b_sketch") * (rule.den + rule.num) <= allowed)
    near = scratch.write(near.select("a", "b", "a_n", "b_n"), "jaccard-near")
    some = _only(full, near.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    of = lambda side: some.select(F.col("sid").alias(side), F.col("tokens").alias(f"{side}_tokens"))
    both = near.join(of("a"), "a").join(of("b"), "b").withColumn("common", F.size(F.array_intersect("a_tokens", "b_tokens")))
    return both.where(F.col("common") * rule.den >= (F.col("a_n") + F.col("b_n") - F.col("common")) * rule.num).select("a", "b")


def mixed_groups(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, sid, size, class, linked) of the groups with members of several classes; ``linked``: some member has a link already."""
    classed = groups.join(classes.select(F.col("id").alias("sid"), "root"), "sid", "left").select("sig", "sid", "size", F.coalesce("root", "sid").alias("class"))
    mixed = classed.groupBy("sig").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.max((F.col("class") != F.col("sid")).cast("int")).alias("linked")).where("lo < hi")
    return classed.join(mixed.select("sig", "linked"), "sig")


def hub_pairs(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each member with a hub of its group that is of another class; another hub every turn."""
    hub = mixed.groupBy("sig").agg(F.min(F.struct(F.xxhash64("sid", F.lit(turn)).alias("h"), "sid", "class")).alias("hub"))
    met = mixed.join(hub, "sig").where(F.col("class") != F.col("hub.class"))
    return met.select(F.least("hub.sid", "sid").alias("a"), F.greatest("hub.sid", "sid").alias("b")).distinct()


def merged_groups(mixed: DataFrame) -> DataFrame:
    """(sig, sid, size, class) where the groups of one hub are one group, if that makes no more pairs than they do apart.

    Near copies share very many signatures, whose groups differ in a few members each; hubs, being least ids, are mostly the
    same.  Any two sets that meet in a group still meet.
    """
    tagged = mixed.join(mixed.groupBy("sig").agg(F.min("sid").alias("hub"), F.count(F.lit(1)).alias("k")), "sig")
    apart = tagged.groupBy("hub", "sig").agg(F.max("k").alias("k")).groupBy("hub").agg(F.min("sig").alias("one"), F.sum(F.col("k") * F.col("k")).alias("apart"))
    whole = tagged.select("hub", "sid").distinct().groupBy("hub").agg(F.count(F.lit(1)).alias("whole"))
    as_one = F.col("whole") * F.col("whole") <= F.col("apart")
    dealt = tagged.join(apart.join(whole, "hub"), "hub")
    return dealt.select(F.when(as_one, F.col("one")).otherwise(F.col("sig")).alias("sig"), "sid", F.when(as_one, F.col("whole")).otherwise(F.col("k")).alias("size"), "class").distinct()


def near_pairs(mixed: DataFrame, full: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) that join the sets of a group which are of different classes, but whose sketches allow a link."""
    rows = mixed.join(full.select("sid", "n", "brief", "sketch"), "sid")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("bi"), F.greatest(x, F.col("own")).alias("bj")))
    dealt = rows.withColumns({"blocks": blocks, "own": own}).withColumn("pair", F.explode(pair)).select("sig", "pair.bi", "pair.bj", "sid", "class", "n", "brief", "sketch")
    work = dealt.repartition("sig", "bi", "bj").sortWithinPartitions("sig", "bi", "bj")
    return work.mapInArrow(lambda it: _near(it, rule), "a long, b long").distinct()


def _family_links(pairs: DataFrame, classes: DataFrame, full: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Links (a, b) between classes among the sets of ``pairs``: families of such sets, block against block on the whole sets."""
    family = scratch.write(components(pairs, scratch, "jaccard-families").select(F.col("id").alias("sid"), F.col("root").alias("family")).join(full.select("sid", "n"), "sid"), "jaccard-members")
    per = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("bi"), F.greatest(x, F.col("own")).alias("bj")))
    placed = family.join(per, "family").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("pair", F.explode(pair))
    labelled = placed.select("family", "pair.bi", "pair.bj", "own", "sid").join(classes.select(F.col("id").alias("sid"), "root"), "sid", "left")
    work = labelled.select("family", "bi", "bj", "own", "sid", F.coalesce("root", "sid").alias("class")).join(_only(full, family.select("sid")), "sid")
    work = work.repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj")
    return work.mapInArrow(lambda it: _verify(it, rule), "a long, b long")


def _tables(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid, root) per row, root being the least id of the class; and the links between set ids."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seed = 0
    while True:  # set ids of 64 bits; another seed if two sets ever got the same
        def described(it, s=seed):
            return _describe(it, rule, s)
        facts = scratch.write(rows.mapInArrow(described, "doc_id long, n long, sid long, chk long, need long, empties array<long>"), "jaccard-facts")
        twice = facts.where("sid IS NOT NULL").groupBy("sid").agg(F.min("chk").alias("lo"), F.max("chk").alias("hi")).where("lo <> hi")
        if not twice.take(1):
            break
        scratch.drop(facts)
        seed += 1
    named = facts.where("sid IS NOT NULL AND doc_id IS NOT NULL")

    usable = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    signed = usable.mapInArrow(lambda it: _signed(it, rule, seed), "sig long, sid long, weak boolean")
    wild = named.where("need < 1").select(F.explode("empties").alias("sig")).distinct()
    by_empty = named.select("sid", F.explode("empties").alias("sig")).join(wild, "sig", "left_semi").distinct()
    kept = scratch.write(prefixes(signed, rule).unionByName(by_empty.select("sig", "sid")), "jaccard-prefixes")
    groups = scratch.write(groups_of(kept), "jaccard-groups")
    scratch.drop(kept)
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(groups.select("sid").distinct()))
    full = usable.mapInArrow(lambda it: _sets(it, rule, seed, wanted.value), "sid long, n long, brief array<long>, sketch array<long>, tokens array<long>")
    full = scratch.write(full.dropDuplicates(["sid"]), "jaccard-sets")
    # hubs first: groups that are of one class then cost nothing more
    mixed, links, classes = groups.select("sig", "sid", "size", F.col("sid").alias("class")), None, None
    for turn in range(ROUNDS):
        met = hub_pairs(mixed.where("linked = 1") if turn else mixed, turn)  # another hub only where one found somebody
        found = scratch.write(_confirmed(met, full, rule, scratch), "jaccard-links")
        links = found if links is None else links.unionByName(found)
        if turn and not found.take(1):
            break
        labels = scratch.write(components(links, scratch), "jaccard-classes")
        still = scratch.write(mixed_groups(groups, labels), "jaccard-mixed")
        if classes is not None:
            scratch.drop(classes, mixed)
        classes, mixed = labels, still
    joint = scratch.write(merged_groups(mixed), "jaccard-joint")
    pairs = scratch.write(near_pairs(joint, full, rule), "jaccard-pairs")
    if pairs.take(1):
        more = scratch.write(_family_links(pairs, classes, full, rule, scratch), "jaccard-links")
        links = links.unionByName(more)
        classes = scratch.write(components(links, scratch), "jaccard-classes")
    scratch.drop(mixed)
    scratch.drop(groups, joint, pairs, full)
    first = named.groupBy("sid").agg(F.min("doc_id").alias("first_doc"))
    joined = first.join(classes.select(F.col("id").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = joined.groupBy("root").agg(F.min("first_doc").alias("least"))
    label = joined.join(least, "root").select("sid", F.col("least").alias("root"))
    out = facts.select("doc_id", "n", "sid").join(label, "sid", "left").select("doc_id", "n", "sid", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("root"))
    return out.withColumn("root", F.when(F.col("doc_id").isNotNull(), F.col("root"))), links


def join(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found, _ = _tables(base, Rule(words, num, den))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with the smallest id of each class; rows that share that id stay together, rows without id stay."""
    found = join(docs, words, num, den).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), "component_id").groupBy("__id").agg(F.min("component_id").alias("__least"))
    return docs.join(found, docs["doc_id"] == F.col("__id"), "left").where("__id IS NULL OR __least = __id").select(*[docs[c] for c in docs.columns])
