"""Vector codes: one codebook per part of the vectors, found over Hilbert-sorted blocks by exact integer arithmetic.

Each component x counts as the integer floor(scale * x).  A vector is cut into ``parts`` equal consecutive parts; the
codebook of a part starts as that part of the ``entries`` rows with the least ids.  A round gives every part to the
nearest entry (squared distance, the lower index of equals) and moves each entry to the floor of the mean of its parts;
an entry without parts stays.

The vectors are stored once in chunks of ``CHUNK`` rows.  In a chunk each part has its rows in the order of a Hilbert
curve, in blocks of ``BLOCK``, and keeps the smallest box around each block and the block's component sums.  A round
looks at boxes first: an entry whose least distance to a box exceeds the largest distance of another one can't be the
nearest of any row inside, the others are the block's shortlist.  A block with a shortlist of one is added to that entry
by its sums alone, its rows are not read; the rest meet their shortlists in integer kernels.  Between tasks and driver
go sums and codebooks only (parts * entries * (size + 1) numbers each), and nothing is shuffled but these and, at the
end, codes by label.

Defined results: a null vector, or one with a null or non-finite component, is dropped; a row without id is coded, but
comes after all ids as a seed; repeated rows are coded each; rows of one id start the codebook in order of their vectors;
fewer rows than entries give as many entries as rows; no rows give no codes.  Vectors of several lengths, a length that
``parts`` doesn't divide, and integers of 2**28 or more are errors.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import written

CHUNK = 16384
BLOCK = 16
LARGEST = 1 << 28  # squared distances and sums of a chunk stay exact in 64 bits


@dataclass(frozen=True)
class Shape:
    parts: int
    size: int  # components of a part


# ---- order and boxes --------------------------------------------------------------------

def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place of each integer point (n, d) on a Hilbert curve through the box around all of them."""
    n, d = points.shape
    d = min(d, 31)
    if n == 0 or d == 0:
        return np.zeros(n, np.int64)
    bits = max(1, min(16, 62 // d))
    low = points[:, :d].min(axis=0)
    reach = np.maximum(1, points[:, :d].max(axis=0) - low)
    x = ((points[:, :d] - low) * ((1 << bits) - 1) // reach).T.copy()
    for level in range(bits - 1, 0, -1):  # undo the turns of each level, coarse to fine
        q = 1 << level
        for i in range(d):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[i] ^= swap if i else 0
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _chunk(values: np.ndarray, shape: Shape) -> dict[str, bytes]:
    """Sorted parts of the integer vectors (n, parts * size), their order, and boxes and sums of the blocks."""
    n = len(values)
    starts = np.arange(0, n, BLOCK)
    rows, order, low, high, sums = [], [], [], [], []
    for p in range(shape.parts):
        own = values[:, p * shape.size:(p + 1) * shape.size]
        at = np.argsort(hilbert_keys(own), kind="stable")
        own = own[at]
        rows.append(own)
        order.append(at)
        low.append(np.minimum.reduceat(own, starts, axis=0))
        high.append(np.maximum.reduceat(own, starts, axis=0))
        sums.append(np.add.reduceat(own, starts, axis=0))
    pack = lambda x, kind: np.stack(x).astype(kind).tobytes()
    return {"rows": pack(rows, np.int32), "places": pack(order, np.int32), "low": pack(low, np.int32), "high": pack(high, np.int32), "sums": pack(sums, np.int64)}


def _store(batches: Iterator[pa.RecordBatch], shape: Shape, scale: float) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        n = whole.num_rows
        flat = whole.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, shape.parts * shape.size)
        exact = np.floor(flat * scale)
        if exact.size and np.abs(exact).max() >= LARGEST:
            raise ValueError("a component is too large for exact sums in 64 bits")
        found = _chunk(exact.astype(np.int64), shape)
        ends = pa.array([0, n], pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, whole.column("id")), pa.ListArray.from_arrays(ends, whole.column("label")),
                                           *[pa.array([found[k]], pa.binary()) for k in ("rows", "places", "low", "high", "sums")]],
                                          names=["ids", "labels", "rows", "places", "low", "high", "sums"])
    have = 0
    for batch in batches:
        while batch.num_rows:
            piece = batch.slice(0, CHUNK - have)
            held.append(piece)
            have += piece.num_rows
            batch = batch.slice(piece.num_rows)
            if have == CHUNK:
                yield done(held)
                held, have = [], 0
    if have:
        yield done(held)


# ---- assignment -------------------------------------------------------------------------

def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(blocks, entries): whether an entry can be the nearest one of a point in a block's box."""
    below, above = low[:, None, :] - book[None], book[None] - high[:, None, :]
    near = np.maximum(0, np.maximum(below, above))  # to the box; ``far`` to its furthest corner
    far = np.maximum(np.abs(below), np.abs(above))
    return (near * near).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1)[:, None]


def nearest(points: np.ndarray, short: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point (blocks, BLOCK, size) among the shortlist of its block."""
    best = np.full(points.shape[:2], np.iinfo(np.int64).max)
    entry = np.zeros(points.shape[:2], np.int64)
    for e in range(len(book)):  # ascending, and only a smaller distance counts: equals go to the lower index
        blocks = np.flatnonzero(short[:, e])
        if len(blocks):
            gap = points[blocks] - book[e]
            dist = np.einsum("bis,bis->bi", gap, gap)
            known = best[blocks]
            closer = dist < known
            best[blocks] = np.where(closer, dist, known)
            entry[blocks] = np.where(closer, e, entry[blocks])
    return entry, best


class Chunk:
    """A stored chunk read back: ``rows`` are padded to whole blocks by copies of the last row."""

    def __init__(self, row: dict, shape: Shape):
        self.shape = shape
        self.n = n = len(np.frombuffer(row["places"], np.int32)) // shape.parts
        self.blocks = -(-n // BLOCK)
        wide = lambda name, kind, k: np.frombuffer(row[name], kind).astype(np.int64).reshape(shape.parts, k, shape.size)
        self.rows = wide("rows", np.int32, n)
        self.low, self.high, self.sums = (wide(k, kind, self.blocks) for k, kind in (("low", np.int32), ("high", np.int32), ("sums", np.int64)))
        self.places = np.frombuffer(row["places"], np.int32).reshape(shape.parts, n)

    def padded(self, part: int) -> np.ndarray:
        own = self.rows[part]
        more = self.blocks * BLOCK - self.n
        return (np.concatenate([own, np.repeat(own[-1:], more, axis=0)]) if more else own).reshape(self.blocks, BLOCK, self.shape.size)

    def add_to(self, part: int, book: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add this chunk's parts to the counts and sums of their nearest entries."""
        short = shortlists(self.low[part], self.high[part], book)
        sole = short.sum(axis=1) == 1
        size = np.full(self.blocks, BLOCK)
        size[-1] = self.n - BLOCK * (self.blocks - 1)
        owner = short.argmax(axis=1)
        np.add.at(counts, owner[sole], size[sole])
        np.add.at(sums, owner[sole], self.sums[part][sole])
        rest = np.flatnonzero(~sole)
        if not len(rest):
            return
        points = self.padded(part)[rest]
        entry, _ = nearest(points, short[rest], book)
        real = (np.arange(BLOCK) < size[rest][:, None]).ravel()
        entry, points = entry.ravel()[real], points.reshape(-1, self.shape.size)[real]
        counts += np.bincount(entry, minlength=len(book))
        for k in range(self.shape.size):  # below 2**53, so exact
            sums[:, k] += np.bincount(entry, weights=points[:, k], minlength=len(book)).astype(np.int64)

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, parts) entry indexes and the squared distance of each row, in the order of the stored ids."""
        code, error = np.zeros((self.n, self.shape.parts), np.uint8), np.zeros(self.n, np.int64)
        for p in range(self.shape.parts):
            entry, dist = nearest(self.padded(p), shortlists(self.low[p], self.high[p], books[p]), books[p])
            code[self.places[p], p] = entry.ravel()[:self.n]
            error[self.places[p]] += dist.ravel()[:self.n]
        return code, error


def _chunks(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1)
            yield row, Chunk({k: row.column(k)[0].as_py() for k in ("rows", "places", "low", "high", "sums")}, shape)


def _gather(batches: Iterator[pa.RecordBatch], shape: Shape, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, entry, component, total) of the task; component -1 is the count."""
    entries = books.shape[1]
    counts = np.zeros((shape.parts, entries), np.int64)
    sums = np.zeros((shape.parts, entries, shape.size), np.int64)
    for _, chunk in _chunks(batches, shape):
        for p in range(shape.parts):
            chunk.add_to(p, books[p], counts[p], sums[p])
    table = np.concatenate([counts[:, :, None], sums], axis=2)
    part, entry, component = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, table.shape))
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(component - 1, pa.int32()), pa.array(table[part, entry, component])],
                                     names=["part", "entry", "component", "total"])


def _encode(batches: Iterator[pa.RecordBatch], shape: Shape, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for row, chunk in _chunks(batches, shape):
        code, error = chunk.codes(books)
        text = code.tobytes().hex()
        width = 2 * shape.parts
        yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("labels").flatten(),
                                          pa.array([text[i * width:(i + 1) * width] for i in range(chunk.n)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])


# ---- the job ----------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding",
             label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of each kept row, and the codebooks (parts, entries, size); ``entries`` is 256 at most."""
    col = lambda name: F.col(f"`{name}`")
    kept = vectors.select(col(vec_id).alias("id"), col(label).alias("label"), col(vector).cast("array<double>").alias("vec"))
    kind = dict(kept.dtypes)
    kept = kept.where(usable(F.col("vec")))
    low, high = kept.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    out = f"id {kind['id']}, label {kind['label']}, code string, error long"
    if low is None:
        return vectors.sparkSession.createDataFrame([], out), np.zeros((parts, 0, 0), np.int64)
    if low != high or low % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}; found {low} to {high}")
    shape = Shape(parts, low // parts)
    seeds = kept.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()
    books = np.floor(np.array([r["vec"] for r in seeds], np.float64) * scale).astype(np.int64).reshape(len(seeds), parts, shape.size).transpose(1, 0, 2).copy()
    stored = written(kept.mapInArrow(lambda it: _store(it, shape, scale),
                                     f"ids array<{kind['id']}>, labels array<{kind['label']}>, rows binary, places binary, low binary, high binary, sums binary"), "vector-blocks")
    for _ in range(rounds):
        found = stored.mapInArrow(lambda it, b=books: _gather(it, shape, b), "part int, entry int, component int, total long")
        totals = found.groupBy("part", "entry", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a fixed number of rows
        told = {(r["part"], r["entry"], r["component"]): int(r["total"]) for r in totals}
        moved = books.copy()
        for (p, e, c), total in told.items():
            if c >= 0:
                moved[p, e, c] = total // told[p, e, -1]
        books = moved
    return stored.mapInArrow(lambda it: _encode(it, shape, books), out), books


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the errors summed over rows of the same label (nulls together)."""
    codes = written(codes, "vector-codes")
    total = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    return codes.join(total, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
