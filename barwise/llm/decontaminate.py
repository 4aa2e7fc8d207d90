"""Benchmark decontamination: hash set of normalised test n-grams, verified hits, spans or documents removed.

Words: A-Z lower-cased, maximal runs of digits, letters a-z and everything above
0x7F.  A window is ``size`` consecutive words of a test item; an item of fewer
words is one window.  Defined results: a null or empty text has no words and no
hits; an item without words has no window; repeated items count once per id; an
empty benchmark leaves every document clean; other columns are not touched.

The hash set is built by Spark and sent to the tasks only while it has at most
``broadcast_limit`` windows (about 12 bytes each in a task); beyond it the
windows are joined to the documents' windows by shuffle.  Both ways verify each
hash hit on the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.llm.common import Words, rows_of, word_table

SIZE = 13
BROADCAST_LIMIT = 200_000
WORD = word_table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.LongType())),
                     T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])


def _window_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(hash, words, length, item_id) of every window of the test items."""
    for batch in batches:
        for part in rows_of(batch, "text"):
            w = Words(part.column("text"), WORD)
            ids = part.column("item_id").to_pylist()
            hs, text, length, item = [], [], [], []
            grams = {}
            for r, item_id in enumerate(ids):
                a, b = int(w.rows[r]), int(w.rows[r + 1])
                n = min(size, b - a)
                if n == 0:
                    continue
                if n not in grams:
                    grams[n] = w.grams(n)
                for i in range(a, b - n + 1):
                    hs.append(int(grams[n][i].astype(np.int64)))
                    text.append(b" ".join(w.bytes[w.starts[i + j]:w.ends[i + j]].tobytes() for j in range(n)))
                    length.append(n)
                    item.append(item_id)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(text, pa.binary()), pa.array(length, pa.int32()), pa.array(item, pa.int64())],
                                             names=["h", "words", "length", "item_id"])


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (h, words, length, item_id) of the benchmark; rows without id or text give none."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(lambda it: _window_rows(it, size), "h long, words binary, length int, item_id long").distinct()


class HashSet:
    """Test windows in sorted arrays by length: hash lookup, then the words themselves."""

    def __init__(self, rows: list[tuple[int, bytes, int, int]]):
        self.by_length: dict[int, tuple[np.ndarray, dict[bytes, tuple[int, ...]]]] = {}
        grouped: dict[int, dict[bytes, set[int]]] = {}
        hashes: dict[int, set[int]] = {}
        for h, words, length, item in rows:
            grouped.setdefault(length, {}).setdefault(bytes(words), set()).add(item)
            hashes.setdefault(length, set()).add(h)
        for length, items in grouped.items():
            keys = np.sort(np.array(sorted(hashes[length]), np.int64).astype(np.uint64))
            self.by_length[length] = keys, {k: tuple(sorted(v)) for k, v in items.items()}

    def hits(self, w: Words) -> dict[int, list[tuple[int, int, tuple[int, ...]]]]:
        """Row -> (first word, length, items) of every verified occurrence."""
        found: dict[int, list] = {}
        n = len(w.hashes)
        for length, (keys, items) in self.by_length.items():
            if n < length:
                continue
            grams = w.grams(length)
            at = np.searchsorted(keys, grams)
            at[at == len(keys)] = 0
            for i in np.flatnonzero(keys[at] == grams):
                row = int(np.searchsorted(w.rows, i, side="right")) - 1
                if i + length > w.rows[row + 1]:
                    continue
                words = b" ".join(w.bytes[w.starts[i + j]:w.ends[i + j]].tobytes() for j in range(length))
                if words in items:
                    found.setdefault(row, []).append((int(i), length, items[words]))
        return found


def _row_result(w: Words, row: int, found: list) -> tuple[int, list[int], list[list[int]]]:
    """Hit words, items, and merged byte spans relative to the text's first byte."""
    a, b = int(w.rows[row]), int(w.rows[row + 1])
    hit = np.zeros(b - a, bool)
    items: set[int] = set()
    for i, length, owners in found:
        hit[i - a:i - a + length] = True
        items.update(owners)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    base = int(w.offsets[row])
    spans = [[int(w.starts[a + s]) - base, int(w.ends[a + e - 1]) - base] for s, e in zip(edge[::2], edge[1::2])]
    return int(hit.sum()), sorted(items), spans


def _scan(batches: Iterator[pa.RecordBatch], index: HashSet) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch, "__text"):
            w = Words(part.column("__text"), WORD)
            found = index.hits(w)
            n_hit, items, spans = [], [], []
            for r in range(part.num_rows):
                x, y, z = _row_result(w, r, found[r]) if r in found else (0, [], [])
                n_hit.append(x)
                items.append(y)
                spans.append(z)
            out = [part.column(i) for i in range(part.num_columns)]
            out += [pa.array(np.diff(w.rows), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())),
                    pa.array(spans, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(out, names=[*part.schema.names, "n_words", "n_hit", "items", "spans"])


def _doc_windows(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(h, length, key, first word) of every window of a document, for the join by shuffle."""
    for batch in batches:
        for part in rows_of(batch, "__text", 1 << 19):
            w = Words(part.column("__text"), WORD)
            key = np.asarray(part.column("__key").to_numpy(zero_copy_only=False), np.int64)
            row = np.repeat(np.arange(part.num_rows), np.diff(w.rows))
            for length in lengths:
                n = len(w.hashes)
                ok = np.flatnonzero(np.arange(n) + length <= w.rows[row + 1]) if n else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w.grams(length)[ok].view(np.int64)), pa.array(np.full(len(ok), length, np.int32)),
                                                  pa.array(key[row[ok]])], names=["h", "length", "__key"])


def _scan_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_scan``, with each row's own list of candidate windows."""
    for batch in batches:
        for r in range(batch.num_rows):
            part = batch.slice(r, 1)
            listed = part.column("__windows")[0].as_py() or []
            rows = [(x["h"], x["words"], x["length"], x["item_id"]) for x in listed]
            cut = part.drop_columns(["__windows"])
            yield from _scan(iter([cut]), HashSet(rows))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE, broadcast_limit: int = BROADCAST_LIMIT,
         keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (its columns ``keep``, all by default) with n_words, n_hit, items (ids that occur) and spans ([start, end) bytes of the hit words).

    Columns of ``docs`` named like the four results are replaced by them.
    """
    spark = docs.sparkSession
    tests = windows(benchmark, size)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in HITS.names]
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*base.schema.fields, *HITS.fields])
    probe = tests.limit(broadcast_limit + 1).collect() if broadcast_limit > 0 else None
    if probe is not None and len(probe) <= broadcast_limit:
        shared = spark.sparkContext.broadcast([tuple(r) for r in probe])
        cell: dict[str, HashSet] = {}

        def task(it):
            if "index" not in cell:
                cell["index"] = HashSet(shared.value)
            return _scan(it, cell["index"])
        return base.mapInArrow(task, schema).drop("__text")
    keyed = base.withColumn("__key", F.xxhash64("__text"))  # equal texts share their candidates
    lengths = tuple(r[0] for r in tests.select("length").distinct().collect())
    own = keyed.select("__key", "__text").where("__text IS NOT NULL").mapInArrow(lambda it: _doc_windows(it, lengths), "h long, length int, __key long")
    listed = own.distinct().join(tests, ["h", "length"]).groupBy("__key").agg(F.collect_set(F.struct("h", "words", "length", "item_id")).alias("__windows"))
    return keyed.join(listed, "__key", "left").drop("__key").mapInArrow(_scan_listed, schema).drop("__text")


def contaminated(share: int = 20):
    """At least one hit, and hits are 1/``share`` of the words or more."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that are not contaminated; columns as in ``docs``."""
    return scan(docs, benchmark, **options).where(~contaminated()).select(*[f"`{c}`" for c in docs.columns])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for value, spans in zip(batch.column("__text").to_pylist(), batch.column("spans").to_pylist()):
            if value is not None and spans:
                raw, out, at = value.encode(), [], 0
                for s, e in spans:
                    out.append(raw[at:s])
                    at = e
                value = b"".join([*out, raw[at:]]).decode()
            texts.append(value)
        yield batch.set_column(batch.schema.get_field_index("__text"), "__text", pa.array(texts, pa.string()))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the hit words cut out of the texts."""
    found = scan(docs, benchmark, text=text, **options)
    flat = found.withColumn("__text", F.col(f"`{text}`").cast("string"))
    cut = flat.mapInArrow(_cut, flat.schema)
    return cut.select(*[F.col("__text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def items_digest(items):
    """SHA-256 of the ids, sorted as strings and comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(items.cast("array<string>"))), 256)


def digest_of(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
