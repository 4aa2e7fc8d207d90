"""Helpers shared by the operators: table access, Arrow batches as byte arrays, vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 21  # bytes that the numpy work looks at in one go; a longer document is a chunk of its own
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to a new folder under the shared checkpoint folder and read it again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


class Scratch:
    """Tables written in the shared checkpoint folder; one that is superseded is deleted there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, ensure_checkpoint_dir(spark).rstrip("/"), {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{self.folder}/{name}-{uuid.uuid4().hex}", df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``write``; nothing that is still to be computed may read them."""
        for df in tables:
            _, path = self.paths.pop(id(df))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def fold(doc_id: Column | str, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % parts


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``rows`` rows with the smallest hashes of ``key`` (all of a smaller table).

    A threshold that lets about twice as many through comes first, so that tasks don't each hand on ``rows`` of their own.
    """
    n, steps = df.count(), 1 << 40
    near = df if n <= 4 * rows else df.where(F.pmod(F.xxhash64(key), F.lit(steps)) < F.lit(-(-steps * 2 * rows // n)))
    return near.orderBy(F.pmod(F.xxhash64(key), F.lit(steps)), key).limit(rows)


def rows_of(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes; a null text counts as empty."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < n:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (n + 1); nulls are empty."""
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


BASE = 0x9E3779B97F4A7C15 | 1
_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = len(_POW["up"])
    if have < n:
        size = 1 << (n - 1).bit_length()
        for key, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(b)
            _POW[key] = np.cumprod(p, dtype=np.uint64)
    return _POW["up"], _POW["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the input changes about half of the output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(x: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the sum of byte * BASE**position over [i, j)."""
    up, _ = powers(len(x) + 1)
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:len(x)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in each [start, end), independent of where they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of a column of texts: byte spans, 64-bit hashes, and the range of words of each row."""

    def __init__(self, col: pa.Array, is_word: np.ndarray):
        raw, self.offsets = flat(col)
        self.bytes = LOWER[raw]
        n = len(raw)
        word = is_word[self.bytes]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:] = word[:-1]
            after[:-1] = word[1:]
            edge = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            before[edge] = False
            after[edge - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.rows = np.searchsorted(self.starts, self.offsets)  # word range of row i: rows[i]..rows[i + 1]
        self.hashes = span_hash(prefix_hash(self.bytes), self.starts, self.ends)

    def grams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; windows over a row's end are meaningless."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        up, _ = powers(size + 1)
        for j in range(size):
            out[:max(0, n - j)] += self.hashes[j:] * up[size - j]
        return mix(out)


def word_table(separators) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out
