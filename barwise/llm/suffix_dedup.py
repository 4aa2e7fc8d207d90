"""Exact substring removal: sparse suffixes at content-chosen anchors, ordered by deep-shallow sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere
else.  Windows of that length are not listed.  In each window the ``gram`` bytes
with the smallest hash are its anchor, so equal windows have equal anchors in the
same place, and only anchors (about one in 70 bytes) are shuffled: hash of the
anchor, hash of the region around it that holds all windows it can anchor.

Anchors that occur once end there.  Equal regions are repeats as a whole.  What
is left are unlike regions around one anchor, mostly the ends of repeats: their
bytes are fetched and sorted.  The left contexts, read from the anchor outwards,
give the places where two regions begin to agree; at each such place the suffixes
of the regions are put in order and the common prefixes of neighbours tell which
windows occur twice.  Sorting is deep-shallow: multikey quicksort to ``SHALLOW``
bytes, then a blind trie for each group that agrees so far.

A group holds at most ``GROUP`` regions in a task; larger groups are compared
window by window through aggregations of 128-bit window hashes instead.

Texts that occur as a whole more than once go entirely (from ``length`` bytes
on), and one of them stands for all in the comparison.  Defined results: null
texts are empty; a repeated row is a copy; texts shorter than ``length`` bytes
stay; ids may be null or repeated.  Text ids are 64-bit hashes whose uniqueness is
checked against MD5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.llm.common import flat, mix, powers, prefix_hash, rows_of, span_hash, written

LENGTH = 200
GRAM = 64
SHALLOW = 24
GROUP = 100_000  # about 34 MB of regions


# ---- deep-shallow sorting -----------------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Compacted trie that keeps only the branching places; the bytes between are looked up in one leaf."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list = [first]  # leaf: list of equal strings; node: (depth, {byte: child})

    @staticmethod
    def _byte(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    def insert(self, i: int) -> None:
        s = self.strings[i]
        node = self.root
        while isinstance(node, tuple):  # blind descent: any child will do where the byte is missing
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node.append(i)
            return
        mine, theirs = self._byte(s, depth), self._byte(other, depth)
        parent, edge, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, edge = node, self._byte(s, node[0])
            node = node[1][edge]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][mine] = [i]
            return
        branch = (depth, {theirs: node, mine: [i]})
        if parent is None:
            self.root = branch
        else:
            parent[1][edge] = branch

    def in_order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings, and the common prefix of each with the one before it (0 for the first)."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out.append(group[0])
            continue
        if depth >= SHALLOW:
            trie = BlindTrie(strings, group[0])
            for i in group[1:]:
                trie.insert(i)
            out.extend(trie.in_order())
            continue
        pivot = strings[group[len(group) // 2]][depth:depth + 8]  # eight bytes are one letter of the quicksort
        low, same, high = [], [], []
        for i in group:
            key = strings[i][depth:depth + 8]
            (same if key == pivot else low if key < pivot else high).append(i)
        if high:
            stack.append((high, depth))
        if len(pivot) < 8:
            stack.extend(([i], depth) for i in reversed(same))
        else:
            stack.append((same, depth + 8))
        if low:
            stack.append((low, depth))
    return out, [0, *(common(strings[a], strings[b]) for a, b in zip(out, out[1:]))]


def repeated_windows(regions: list[bytes], leads: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Windows of each region (places relative to the anchor, first and last) that another region has in the same place.

    leads: bytes of a region before its anchor.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in regions]
    if len(regions) < 2:
        return out
    order, agree = deep_shallow([r[:lead][::-1] for r, lead in zip(regions, leads)])
    reach = [0] * len(regions)  # how far back a region agrees with any other
    for k in range(1, len(order)):
        reach[order[k - 1]] = max(reach[order[k - 1]], agree[k])
        reach[order[k]] = max(reach[order[k]], agree[k])
    for back in sorted({*agree[1:]}, reverse=True):  # two regions begin to agree ``back`` bytes before the anchor
        some = [i for i, lead in enumerate(leads) if reach[i] >= back and len(regions[i]) - lead + back >= length]
        if len(some) < 2:
            continue
        order, lcp = deep_shallow([regions[i][leads[i] - back:] for i in some])
        best = [0] * len(some)
        for k in range(1, len(order)):
            best[order[k - 1]] = max(best[order[k - 1]], lcp[k])
            best[order[k]] = max(best[order[k]], lcp[k])
        for i, n in zip(some, best):
            if n >= length:
                out[i].append((-back, n - length - back))
    return out


# ---- anchors ---------------------------------------------------------------------------

def _row_min(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    n = len(key)
    pad = -n % width
    x = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def anchors(data: np.ndarray, prefix: np.ndarray, lo: int, hi: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of the text data[lo:hi]; places are relative to lo."""
    n = hi - lo
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(lo, hi - gram + 1)
    h = span_hash(prefix, starts, starts + gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones
    at = np.unique(_row_min(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at, h[at]


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(h, region, tid, q, n): anchors with the hash of their region and the text's size."""
    reach = length - gram
    for batch in batches:
        for part in rows_of(batch, "text", 1 << 20):
            data, offsets = flat(part.column("text"))
            prefix = prefix_hash(data)
            powers(len(data) + 1)
            tid = np.asarray(part.column("tid").to_numpy(zero_copy_only=False), np.int64)
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for r in range(part.num_rows):
                lo, hi = int(offsets[r]), int(offsets[r + 1])
                q, h = anchors(data, prefix, lo, hi, length, gram)
                if not len(q):
                    continue
                a, b = np.maximum(q - reach, 0), np.minimum(q + length, hi - lo)
                shape = ((q - a) << 20 | (b - a)).astype(np.uint64)
                region = mix(span_hash(prefix, a + lo, b + lo) ^ mix(shape))
                for x, v in zip(out, (h.view(np.int64), region.view(np.int64), np.full(len(q), tid[r]), q, np.full(len(q), hi - lo))):
                    x.append(v)
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "region", "tid", "q", "n"])


def _regions(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(h, tid, q, single, lead, bytes) for the anchors listed with each text."""
    reach = length - gram
    for batch in batches:
        for part in rows_of(batch, "text", 1 << 20):
            data, offsets = flat(part.column("text"))
            rows = []
            for r, (tid, listed) in enumerate(zip(part.column("tid").to_pylist(), part.column("listed").to_pylist())):
                text = data[offsets[r]:offsets[r + 1]].tobytes()
                for x in listed:
                    a = max(0, x["q"] - reach)
                    rows.append((x["h"], tid, x["q"], x["single"], x["q"] - a, text[a:x["q"] + length]))
            h, tid, q, single, lead, region = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(tid, pa.int64()), pa.array(q, pa.int64()), pa.array(single, pa.bool_()),
                                              pa.array(lead, pa.int64()), pa.array(region, pa.binary())], names=["h", "tid", "q", "single", "lead", "region"])


def _sort_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of h: (tid, s, e) of the bytes in repeated windows of the single regions; one group is held at a time."""
    key, rows = None, {}

    def done():
        items = list(rows.items())
        found = repeated_windows([v[2] for _, v in items], [v[1] for _, v in items], length)
        out = [(tid, q + first, q + last + length) for ((tid, q), v), spans in zip(items, found) if v[0] for first, last in spans]
        tid, s, e = zip(*out) if out else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(tid, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["tid", "s", "e"])
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("h", "tid", "q", "single", "lead", "region")]
        for h, tid, q, single, lead, region in zip(*cols):
            if h != key:
                if len(rows) > 1:
                    yield done()
                key, rows = h, {}
            rows[tid, q] = (single, lead, region)
    if len(rows) > 1:
        yield done()


def _window_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(w1, w2, tid, p, single) of every window of a region, p its place in the text."""
    for batch in batches:
        for part in rows_of(batch, "region", 1 << 18):
            data, offsets = flat(part.column("region"))
            size = np.diff(offsets)
            row = np.repeat(np.arange(part.num_rows), np.maximum(size - length + 1, 0))
            if not len(row):
                continue
            first = np.searchsorted(row, np.arange(part.num_rows))
            at = np.arange(len(row)) - first[row]
            start = offsets[row] + at
            w1 = span_hash(prefix_hash(data), start, start + length)
            w2 = span_hash(prefix_hash(data ^ np.uint8(0x5A)), start, start + length)
            get = lambda c: np.asarray(part.column(c).to_numpy(zero_copy_only=False))
            p = get("q")[row] - get("lead")[row] + at
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(get("tid")[row]), pa.array(p), pa.array(get("single").astype(bool)[row])],
                                             names=["w1", "w2", "tid", "p", "single"])


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch, "__text", 1 << 20):
            data, offsets = flat(part.column("__text"))
            spans, kept = [], []
            for r, (copied, listed) in enumerate(zip(part.column("__copied").to_pylist(), part.column("__listed").to_pylist())):
                raw = data[offsets[r]:offsets[r + 1]].tobytes()
                own = ([[0, len(raw)]] if copied and len(raw) >= length else merged((x["s"], x["e"]) for x in listed or ()))
                at, keep = 0, []
                for s, e in own:
                    keep.append(raw[at:s])
                    at = e
                spans.append(own)
                kept.append(b"".join([*keep, raw[at:]]))
            out = part.drop_columns(["__text", "__copied", "__listed"])
            yield out.append_column("spans", pa.array(spans, pa.list_(pa.list_(pa.int64())))).append_column("kept", pa.array(kept, pa.binary()))


def removed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``docs`` with spans (removed [start, end) bytes, maximal runs) and kept (the remaining bytes)."""
    seed = 0
    source = docs.withColumn("__text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    while True:
        tid = F.xxhash64(F.col("__text"), F.lit(seed))
        facts = written(source.select(F.col(f"`{doc_id}`").alias("doc_id"), tid.alias("tid"), F.md5("__text").alias("md5")), "texts")
        counts = facts.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.first("doc_id").alias("doc_id"), F.min("md5").alias("lo"), F.max("md5").alias("hi"))
        if not counts.where("lo <> hi").take(1):
            break
        seed += 1
    # first() may differ from task to task, so the text that stands for its copies is fixed by a write
    texts = written(counts.select("tid", "copies", "doc_id"), "distinct-texts")

    rows = source.where(F.octet_length("__text") >= length).select(tid.alias("tid"), F.col("__text").alias("text")).mapInArrow(
        lambda it: _anchor_rows(it, length, gram), "h long, region long, tid long, q long, n long")
    by_h, by_region = W.partitionBy("h"), W.partitionBy("h", "region")
    place = F.struct("tid", "q")
    # dealt once by anchor, which serves all three windows and the distinct below
    met = rows.repartition("h").withColumns({"first": F.min(place).over(by_region), "last": F.max(place).over(by_region)}).withColumns(
        {"lo": F.min("region").over(by_h), "hi": F.max("region").over(by_h), "any_single": F.max(F.col("first") == F.col("last")).over(by_h)})
    met = met.where((F.col("lo") != F.col("hi")) | (F.col("first") != F.col("last"))).select(
        "h", "tid", "q", "n", (F.col("first") == F.col("last")).alias("single"), (F.col("first") == place).alias("stands"),
        ((F.col("lo") != F.col("hi")) & F.col("any_single")).alias("mixed")).distinct()
    met = written(met, "anchors-met")
    whole = met.where("NOT single").select("tid", F.greatest(F.col("q") - (length - gram), F.lit(0).cast("long")).alias("s"), F.least(F.col("q") + length, F.col("n")).alias("e"))

    unlike = met.where("mixed AND stands")
    listed = unlike.groupBy("tid").agg(F.collect_list(F.struct("h", "q", "single")).alias("listed")).join(texts, "tid").select("tid", "doc_id", "listed")
    told = source.select(F.col(f"`{doc_id}`").alias("__id"), tid.alias("__tid"), F.col("__text").alias("text"))
    regions = listed.join(told, (F.col("tid") == F.col("__tid")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("tid", "text", "listed").mapInArrow(
        lambda it: _regions(it, length, gram), "h long, tid long, q long, single boolean, lead long, region binary")
    regions = written(regions, "regions")
    large = regions.groupBy("h").count().where(F.col("count") > group).select("h")
    small = regions.join(large, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    sorted_spans = small.mapInArrow(lambda it: _sort_groups(it, length), "tid long, s long, e long")
    by_window = W.partitionBy("w1", "w2")
    hashed = regions.join(large, "h", "left_semi").mapInArrow(lambda it: _window_hashes(it, length), "w1 long, w2 long, tid long, p long, single boolean")
    here = F.struct("tid", "p")
    twice = hashed.withColumns({"a": F.min(here).over(by_window), "b": F.max(here).over(by_window)}).where("a <> b AND single").select("tid", F.col("p").alias("s"), (F.col("p") + length).alias("e"))
    spans = whole.unionByName(sorted_spans).unionByName(twice)
    of_text = spans.groupBy("tid").agg(F.collect_list(F.struct("s", "e")).alias("__listed"))  # bounded by one text's length
    plain = texts.where("copies = 1").join(of_text, "tid").select("tid", F.lit(False).alias("__copied"), "__listed", F.col("doc_id").alias("__id"))
    copied = facts.join(texts.where("copies > 1").select("tid"), "tid", "left_semi").select(
        "tid", F.lit(True).alias("__copied"), F.lit(None).cast("array<struct<s:bigint,e:bigint>>").alias("__listed"), F.col("doc_id").alias("__id")).distinct()
    fate = plain.unionByName(copied).withColumnRenamed("tid", "__tid")
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "kept")]
    base = source.withColumn("__own", tid).join(fate, (F.col("__own") == F.col("__tid")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")), "left").select(
        *[source[c] for c in names], "__text", F.coalesce("__copied", F.lit(False)).alias("__copied"), "__listed")
    schema = base.drop("__text", "__copied", "__listed").selectExpr("*", "cast(null as array<array<bigint>>) AS spans", "cast(null as binary) AS kept").schema
    return base.mapInArrow(lambda it: _cut(it, length), schema)


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
