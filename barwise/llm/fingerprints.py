"""Document fingerprints by consistent weighted sampling.

A text is the bag of its words, or runs of ``words`` words (A-Z lower-cased, split at white space; a shorter text is one run), each
run weighted by how often it occurs.  For each of ``SAMPLES`` samples a run of weight w draws, from its hash alone,
r and c from Gamma(2, 1) and b from [0, 1): t = floor(ln w / r + b) and ln a = ln c - r * (t - b) - r; the run with the
least a is the sample, and 16 bits of (run, t) are kept.  Two texts agree in a sample with a probability equal to their
generalised Jaccard similarity, the sum of the smaller weights over the sum of the larger ones.

Distinct (run, weight) pairs of a slice of texts are drawn once; a text takes the least over its pairs of words that hold
ln a in front and the bits behind, so ties are settled alike everywhere.

Defined results: a null or empty text, or one without words, has the empty fingerprint; two of these are alike by 1, one
and another text by 0; equal texts have equal fingerprints; a long text is a slice of its own, its runs are drawn in
pieces.  Other columns are kept as they are, also those of the same names (results are asked for by name).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.llm.common import SPACES, Words, mix, rows_of, word_table

WORD = word_table(SPACES)
SAMPLES = 64
RUN = 1
DRAWN = 1 << 11  # runs whose samples are drawn at once
BOUNDS_PER_TASK = 4
SALT = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, SAMPLES)


# ---- sampling -----------------------------------------------------------------------------

def _hashed(runs: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A hash of each (run, sample)."""
    h = runs[:, None] ^ salt[None, :]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _uniform(h: np.ndarray, at: int) -> np.ndarray:
    """A number in (0, 1) from 21 bits of each hash."""
    bits = ((h >> np.uint64(at)).astype(np.uint32) & np.uint32((1 << 21) - 1)).astype(np.float32)
    bits += np.float32(0.5)
    bits *= np.float32(2.0 ** -21)
    return bits


def draw(runs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(runs, SAMPLES) words: ln a as an ordered integer in the upper half, 16 bits of (run, t) in the lower one."""
    one, two = _hashed(runs, SALT[0]), _hashed(runs, SALT[1])
    r = -np.log(_uniform(one, 0) * _uniform(one, 21))
    c = -np.log(_uniform(two, 0) * _uniform(two, 21))
    b = _uniform(one, 42)
    t = np.zeros(r.shape, np.float32)  # stays 0 for a weight of 1
    more = np.flatnonzero(weights > 1)
    if len(more):
        t[more] = np.floor(np.log(weights[more].astype(np.float32))[:, None] / r[more] + b[more])
    log_a = np.log(c)
    log_a -= r * (t - b + np.float32(1))
    raw = log_a.view(np.uint32)
    out = np.where(raw >> np.uint32(31), ~raw, raw | np.uint32(1 << 31)).astype(np.uint64)
    out <<= np.uint64(32)
    out |= ((runs >> np.uint64(17))[:, None] + t.astype(np.int32).astype(np.uint64) * np.uint64(40503)) & np.uint64(0xFFFF)
    return out


def sketches(texts: pa.Array, words: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(rows, SAMPLES) 16-bit samples, and which rows have words at all."""
    w = Words(texts, WORD)
    per = np.diff(w.rows)
    row = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(row)) - w.rows[row]
    grams = w.grams(words)
    keep = place + words <= per[row]
    for n in range(1, words):
        short = (per[row] == n) & (place == 0)
        if short.any():
            grams = np.where(short, w.grams(n), grams)
            keep |= short
    row, grams = row[keep], grams[keep]
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    start = np.flatnonzero(new)
    weight = np.diff(np.append(start, len(row)))
    row, grams = row[start], grams[start]
    # distinct (run, weight) pairs, drawn once each
    key = mix(grams + weight.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first, where = np.unique(key, return_index=True, return_inverse=True)
    out = np.full((len(per), SAMPLES), np.iinfo(np.uint64).max, np.uint64)
    by_pair = np.argsort(where, kind="stable")
    rank = where[by_pair]
    for lo in range(0, len(first), DRAWN):
        hi = min(len(first), lo + DRAWN)
        drawn = draw(grams[first[lo:hi]], weight[first[lo:hi]])
        a, b = np.searchsorted(rank, (lo, hi))
        use = by_pair[a:b]
        use = use[np.argsort(row[use], kind="stable")]
        for s in range(0, len(use), DRAWN):
            some = use[s:s + DRAWN]
            edge = np.flatnonzero(np.append(True, row[some][1:] != row[some][:-1]))
            least = np.minimum.reduceat(drawn[where[some] - lo], edge, axis=0)
            at = row[some][edge]
            out[at] = np.minimum(out[at], least)
    return (out & np.uint64(0xFFFF)).astype(np.uint16), per > 0


def as_text(sketch: np.ndarray, real: np.ndarray) -> list[str]:
    whole = sketch.astype(">u2").tobytes().hex()
    return [whole[i * 4 * SAMPLES:(i + 1) * 4 * SAMPLES] if ok else "" for i, ok in enumerate(real.tolist())]


def alike(a: np.ndarray, a_real: np.ndarray, b: np.ndarray, b_real: np.ndarray) -> np.ndarray:
    """Share of equal samples of each row."""
    share = (a == b).mean(axis=1)
    return np.where(a_real & b_real, share, (a_real == b_real).astype(np.float64))


def fingerprints(docs: DataFrame, text: str = "text", words: int = RUN) -> DataFrame:
    """``docs`` with a column fingerprint (in place of one of that name)."""
    texts = docs.withColumn("__text", F.col(f"`{text}`").cast("string")).drop("fingerprint")
    schema = T.StructType([f for f in texts.schema.fields if f.name != "__text"] + [T.StructField("fingerprint", T.StringType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, "__text"):
                found = pa.array(as_text(*sketches(part.column("__text"), words)), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "__text"] + [found],
                                                 names=[n for n in part.schema.names if n != "__text"] + ["fingerprint"])
    return texts.mapInArrow(made, schema)


# ---- each document beside the next one ----------------------------------------------------

def in_order(docs: DataFrame, tasks: int) -> DataFrame:
    """Rows (cell, ahead, doc_id, h, text) dealt so that a task which reads a cell from its end meets each row after the next document.

    Cells are ranges of ids between quantiles; an id that fills several quantiles is dealt over as many cells.  Each cell
    also holds, as ``ahead``, the document after its last one.  Rows without id have no next document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("h"), F.col("text"))
    known = rows.where("doc_id IS NOT NULL")
    cuts = [k / tasks for k in range(1, tasks)]
    got = known.agg(F.percentile_approx("doc_id", cuts or [0.5], 10_000).alias("cuts"), F.min("doc_id").alias("least")).first()
    bounds = np.array(got["cuts"] or [], np.int64) if cuts else np.zeros(0, np.int64)  # tasks - 1 numbers

    @F.pandas_udf("array<int>")
    def span(ids):  # the cells that may hold an id
        values = ids.to_numpy(dtype=np.int64)
        return ids.__class__(np.stack([np.searchsorted(bounds, values, "left"), np.searchsorted(bounds, values, "right")], axis=1).tolist())

    cell = F.when(F.col("s")[0] == F.col("s")[1], F.col("s")[0]).otherwise(
        F.col("s")[0] + 1 + F.pmod(F.monotonically_increasing_id(), (F.col("s")[1] - F.col("s")[0]).cast("long")).cast("int"))
    placed = known.withColumn("s", span("doc_id")).withColumn("cell", cell).drop("s")
    # the id after each cell's last: the cell's upper bound, or for a cell of one id alone the least id above it
    distinct, repeats = np.unique(bounds, return_counts=True)
    after: list[tuple[int, int]] = []  # (id ahead, cell)
    if got["least"] is not None:
        least = int(got["least"])
        edge = distinct[repeats > 1]
        above = {}
        if len(edge):
            @F.pandas_udf("int")
            def slot(ids):
                return ids.__class__(np.searchsorted(edge, ids.to_numpy(dtype=np.int64), "left"))
            told = known.where(F.col("doc_id") > int(edge[0])).select("doc_id", slot("doc_id").alias("slot")).groupBy("slot").agg(F.min("doc_id").alias("low")).collect()
            lows = sorted((r["slot"], r["low"]) for r in told)
            for i, x in enumerate(edge.tolist()):
                above[x] = next((low for s, low in lows if s > i), least)
        for c in range(tasks):  # cell c: ids in [bounds[c - 1], bounds[c]), or shares of one id
            alone = c > 0 and c < len(bounds) and bounds[c - 1] == bounds[c]
            after.append((above[int(bounds[c])] if alone else int(bounds[c]) if c < len(bounds) else least, c))
    ahead = spark.createDataFrame(after, "id long, cell int")
    heads = known.join(F.broadcast(ahead.select(F.col("id").alias("doc_id")).distinct()), "doc_id").groupBy("doc_id").agg(F.min(F.struct("h", "text")).alias("r"))
    heads = heads.join(ahead, F.col("doc_id") == F.col("id")).select("doc_id", "r.h", "r.text", "cell", F.lit(True).alias("ahead"))
    lone = rows.where("doc_id IS NULL").select("doc_id", "h", "text", (-1 - F.pmod(F.monotonically_increasing_id(), F.lit(tasks))).cast("int").alias("cell"), F.lit(False).alias("ahead"))
    whole = placed.select("doc_id", "h", "text", "cell", F.lit(False).alias("ahead")).unionByName(heads).unionByName(lone)
    return whole.repartition(tasks, "cell").sortWithinPartitions(F.asc("cell"), F.desc("ahead"), F.desc("doc_id"), F.desc("h")).select("cell", "ahead", "doc_id", "text")


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edit(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the beginning of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def _compare(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    cell = following = ident = last = None  # following, last: (text, sketch, real) of the next document, of the last row read
    for batch in batches:
        for part in rows_of(batch, "text", 1 << 20):
            cells, ahead, ids = (part.column(k).to_pylist() for k in ("cell", "ahead", "doc_id"))
            texts = [t or "" for t in part.column("text").to_pylist()]
            n = len(texts)
            nexts: list = []  # index of the next document in this slice, or what is held from before, or None
            for i in range(n):
                if cells[i] != cell:
                    cell, following, ident, last = cells[i], None, ids[i], None
                elif ids[i] != ident:
                    following, ident = last, ids[i]
                if ahead[i]:
                    ident = object()  # whatever follows is an id of the cell
                last = i
                nexts.append(None if ids[i] is None else following)
            edited = [edit(t, "" if f is None else texts[f] if isinstance(f, int) else f[0]) for t, f in zip(texts, nexts)]
            both, real = sketches(pa.array(texts + edited, pa.large_string()), words)
            own, own_real, new, new_real = both[:n], real[:n], both[n:], real[n:]
            held = lambda f: (texts[f], own[f], own_real[f]) if isinstance(f, int) else f
            other = [held(f) for f in nexts]
            rows = [i for i in range(n) if not ahead[i]]
            if rows:
                none = (None, np.zeros(SAMPLES, np.uint16), False)
                other_sketch = np.stack([(f or none)[1] for f in other])
                other_real = np.array([(f or none)[2] for f in other])
                near_next = alike(own, own_real, other_sketch, other_real)
                near_edited = alike(own, own_real, new, new_real)
                prints, edited_prints = as_text(own, own_real), as_text(new, new_real)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in rows], pa.int64()), pa.array([len(texts[i]) for i in rows], pa.int64()),
                    pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in rows]), pa.array([prints[i] for i in rows], pa.string()),
                    pa.array([edited_prints[i] for i in rows], pa.string()), pa.array([float(near_edited[i]) for i in rows]),
                    pa.array([float(near_next[i]) if other[i] is not None else None for i in rows], pa.float64())],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            following, last = held(following), held(last)


def compare_with_next(docs: DataFrame, words: int = RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (its last quarter replaced by the beginning of the next document).

    The next document is that of the least larger id, after the last id that of the first; of several rows with that id
    the one with the least hash of its text counts.  A row without id has none: its edited text ends with the cut, and
    near_next is null.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    tasks = min(10_000, BOUNDS_PER_TASK * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return in_order(docs, tasks).mapInArrow(lambda it: _compare(it, words), RESULT)
