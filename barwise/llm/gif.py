"""GIF media columns: animated images to timed frames with colour histograms, and bytes stored losslessly as 8-bit samples.

``decode`` reads the blocks of a GIF: LZW code streams, global and local
palettes, interlacing, transparency, and what becomes of a frame after its time
(disposal 0 and 1 keep it, 2 clears its place, 3 restores what was there).  A
frame row has its place, time, samples and a histogram of the whole canvas in
4 x 4 x 4 colours plus one bin of pixels that nothing covers.

``encode`` stores bytes as frames of 64 columns and at most 256 rows, one sample
a pixel, under a grey palette.

Defined results: a null or empty text is 64 bytes of 0; null media decode to null
frames, bytes that are no GIF to no frames and an ``error``; a stream that breaks
off gives the frames before it and an ``error``; repeated rows are treated each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.llm.common import rows_of

COLUMNS, FRAME_ROWS, DELAY = 64, 256, 10
TABLE = 4096  # LZW codes have 12 bits at most
BINS = 65


# ---- LZW -----------------------------------------------------------------------

@lru_cache(maxsize=64)
def code_widths(n: int, bits: int) -> np.ndarray:
    """Width of each code after a clear code: the table has one entry less than codes were read."""
    filled = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.maximum(np.floor(np.log2(filled)).astype(np.int64) + 1, bits + 1), 12)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """Code stream; the table starts anew when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes = [clear]
    known: dict[int, int] = {}
    emit, get = codes.append, known.get
    fresh = end + 1
    rest = iter(data)
    w = next(rest, -1)
    for b in rest:
        key = w << 8 | b
        longer = get(key)
        if longer is not None:
            w = longer
            continue
        emit(w)
        known[key] = fresh
        fresh += 1
        if fresh == TABLE:
            emit(clear)
            known.clear()
            fresh = end + 1
        w = b
    if w >= 0:
        emit(w)
    emit(end)
    a = np.array(codes, np.int64)
    at = np.flatnonzero(a == clear)
    since = np.arange(len(a)) - np.repeat(at, np.diff(np.append(at, len(a)))) - 1  # -1 at a clear code
    table = code_widths(int(since.max()) + 3, bits)
    widths = table[np.maximum(since, 0)]
    widths[at[1:]] = table[since[at[1:] - 1] + 1]  # a clear code is as wide as the code in its place
    widths[0] = bits + 1
    place = np.cumsum(widths) - widths
    shifted = a << (place & 7)
    size = (int(place[-1] + widths[-1]) + 7) // 8
    out = sum(np.bincount((place >> 3) + k, weights=(shifted >> (8 * k)) & 255, minlength=size + 3)[:size + 3] for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def expand(codes: np.ndarray, bits: int) -> np.ndarray:
    """Samples of the codes between two clear codes; raises ValueError where a code is outside the table.

    The entry that code i makes is what i stands for and the first sample of i + 1, that is, the output from
    where i begins, one sample longer than i's.  So each code beyond the samples copies from an earlier place:
    lengths follow by doubling along the codes, samples by doubling along the output.
    """
    n, fresh = len(codes), (1 << bits) + 2
    if n == 0:
        return np.zeros(0, np.uint8)
    plain = codes < (1 << bits)
    back = np.where(plain, np.arange(n), codes - fresh)
    if plain.sum() < n and (back >= np.arange(n))[~plain].any():
        raise ValueError("code outside the table")
    up = back
    step = np.where(plain, 0, 1)  # how many codes ``up`` has gone back
    while True:
        more = step[up]
        if not more.any():
            break
        step = step + more
        up = up[up]
    length = step + 1
    begin = np.cumsum(length) - length
    source = np.arange(int(length.sum())) - np.repeat(np.where(plain, 0, begin - begin[back]), length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    out = np.zeros(len(source), np.uint8)
    out[begin[plain]] = codes[plain]
    return out[source]


def lzw_decode(stream: bytes, bits: int, limit: int) -> bytes:
    """Samples of a code stream, at most ``limit``; raises ValueError on a broken one."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.concatenate((np.frombuffer(stream, np.uint8), np.zeros(3, np.uint8))).astype(np.int32)
    total = 8 * len(stream)
    parts: list[np.ndarray] = []
    size = at = 0
    while size < limit:
        count, stops = TABLE, np.zeros(0, np.int64)
        while True:  # the codes up to the next clear or end code; longer than a full table only if the writer puts that off
            widths = code_widths(count, bits)
            place = at + np.cumsum(widths) - widths
            widths = widths[place + widths <= total]
            place = place[:len(widths)]
            window = raw[place >> 3] | raw[(place >> 3) + 1] << 8 | raw[(place >> 3) + 2] << 16
            codes = (window >> (place & 7)) & ((1 << widths) - 1)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or len(widths) < count:
                break
            count *= 4
        if not len(stops):
            raise ValueError("code stream breaks off")
        n = int(stops[0])
        parts.append(expand(codes[:n], bits))
        size += len(parts[-1])
        if codes[n] == end:
            break
        at = int(place[n] + widths[n])
    return np.concatenate(parts or [np.zeros(0, np.uint8)])[:limit].tobytes()


# ---- files -----------------------------------------------------------------------

@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int  # hundredths of a second
    disposal: int
    transparent: int  # palette index, -1 for none
    samples: bytes
    histogram: list[int]


def encode(payload: bytes) -> bytes:
    """A GIF of the payload, whose length is a multiple of 64."""
    rows = len(payload) // COLUMNS
    height = min(rows, FRAME_ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", COLUMNS, height, 0xF7, 0, 0), bytes(x for i in range(256) for x in (i, i, i))]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * COLUMNS:(top + FRAME_ROWS) * COLUMNS]
        out.append(b"\x21\xF9\x04" + struct.pack("<BHBB", 2 << 2, DELAY, 0, 0))  # disposal 2: the place is cleared after its time
        out.append(b"\x2C" + struct.pack("<HHHHB", 0, 0, COLUMNS, len(part) // COLUMNS, 0) + b"\x08")
        stream = lzw_encode(part)
        out += [bytes([len(stream[i:i + 255])]) + stream[i:i + 255] for i in range(0, len(stream), 255)]
        out.append(b"\x00")
    return b"".join([*out, b"\x3B"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[at]
        if n == 0:
            return b"".join(parts), at + 1
        if at + 1 + n >= len(data):
            raise ValueError("data break off")
        parts.append(data[at + 1:at + 1 + n])
        at += 1 + n


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(0, height, 8), np.arange(4, height, 8), np.arange(2, height, 4), np.arange(1, height, 2)])


def _histogram(canvas: np.ndarray, covered: np.ndarray) -> list[int]:
    q = canvas >> 6
    bins = (q[..., 0] << 4) | (q[..., 1] << 2) | q[..., 2]
    bins[~covered] = BINS - 1
    return np.bincount(bins.ravel(), minlength=BINS).tolist()


def decode(data: bytes) -> tuple[list[Frame], str | None]:
    """Frames in order of time, and what was wrong with the rest."""
    frames: list[Frame] = []
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("no GIF")
        width, height, flags = struct.unpack_from("<HHB", data, 6)
        at, shared = 13, None
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        canvas, covered = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
        delay, disposal, transparent = 0, 0, -1
        while True:
            kind = data[at]
            if kind == 0x3B:
                return frames, None
            if kind == 0x21:
                body, after = _blocks(data, at + 2)
                if data[at + 1] == 0xF9 and len(body) >= 4:
                    bits, delay, index = struct.unpack_from("<BHB", body)
                    disposal, transparent = (bits >> 2) & 7, index if bits & 1 else -1
                at = after
                continue
            if kind != 0x2C:
                raise ValueError(f"unknown block {kind}")
            left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if bits & 0x80:
                n = 3 << ((bits & 7) + 1)
                palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
            if palette is None:
                raise ValueError("no palette")
            stream, after = _blocks(data, at + 1)
            samples = lzw_decode(stream, data[at], w * h)
            at = after
            if len(samples) < w * h:
                raise ValueError("too few samples")
            pixels = np.frombuffer(samples, np.uint8).reshape(h, w)
            if bits & 0x40:
                rows = _interlaced(h)
                whole = np.empty_like(pixels)
                whole[rows] = pixels
                pixels, samples = whole, whole.tobytes()
            before = (canvas.copy(), covered.copy()) if disposal == 3 else None
            box = (slice(top, min(top + h, height)), slice(left, min(left + w, width)))
            seen = pixels[:max(0, height - top), :max(0, width - left)]
            colours = palette.take(seen, axis=0, mode="clip")
            if transparent < 0:
                canvas[box], covered[box] = colours, True
            else:
                drawn = seen != transparent
                canvas[box][drawn] = colours[drawn]
                covered[box] |= drawn
            frames.append(Frame(left, top, w, h, delay, disposal, transparent, samples, _histogram(canvas, covered)))
            if disposal == 2:
                canvas[box], covered[box] = 0, False
            elif before:
                canvas, covered = before
            delay, disposal, transparent = 0, 0, -1
    except (ValueError, IndexError, struct.error) as broken:
        return frames, str(broken) or "data break off"


# ---- columns ---------------------------------------------------------------------

FRAME = T.StructType([T.StructField(n, T.IntegerType()) for n in ("left", "top", "width", "height", "delay", "disposal", "transparent")]
                     + [T.StructField("samples", T.BinaryType()), T.StructField("histogram", T.ArrayType(T.LongType()))])
ARROW_FRAME = pa.struct([(n, pa.int32()) for n in ("left", "top", "width", "height", "delay", "disposal", "transparent")]
                        + [("samples", pa.binary()), ("histogram", pa.list_(pa.int64()))])


def padded(raw: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    return raw + bytes(max(COLUMNS, -(-len(raw) // COLUMNS) * COLUMNS) - len(raw))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch, "__text", 1 << 20):
            media = [encode(padded((t or "").encode())) for t in part.column("__text").to_pylist()]
            yield part.drop_columns(["__text"]).append_column("media", pa.array(media, pa.binary()))


def _load(batches: Iterator[pa.RecordBatch], media: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch, media, 1 << 20):
            frames, errors = [], []
            for data in part.column(media).to_pylist():
                got, wrong = decode(data) if data is not None else (None, None)
                frames.append(None if got is None else [vars(f) for f in got])
                errors.append(wrong)
            yield part.append_column("frames", pa.array(frames, pa.list_(ARROW_FRAME))).append_column("error", pa.array(errors, pa.string()))


def store(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``media``: the text's UTF-8 bytes as a GIF."""
    names = [c for c in (docs.columns if keep is None else keep) if c != "media"]
    base = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    return base.mapInArrow(_store, T.StructType([*base.drop("__text").schema.fields, T.StructField("media", T.BinaryType())]))


def load(table: DataFrame, media: str = "media") -> DataFrame:
    """``table`` with ``frames`` (in order of time) and ``error``."""
    base = table.drop("frames", "error")
    return base.mapInArrow(lambda it: _load(it, media), T.StructType([*base.schema.fields, T.StructField("frames", T.ArrayType(FRAME)), T.StructField("error", T.StringType())]))
