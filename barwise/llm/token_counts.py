"""Token counts by offset mapping: whole documents are encoded once, tokens are attributed to fields or sections by interval join.

A byte-level BPE's tokens are consecutive bytes of the text, so the token
lengths give byte spans, and the places of first bytes give character spans (a
token that holds part of a character spans that character).  Sections are
disjoint and cover the text; both sides are sorted, so the interval join is two
binary searches.  A token that touches several sections goes by ``rule``:

  "most"   to the section with most of its characters, the earlier one on a tie
  "first"  to the section of its first character
  "share"  to all of them, in proportion to its characters there

Under each rule a document's counts add up to its tokens.  Defined results: a
null or empty text is one section without tokens; with fields, a null field is
an empty one; repeated rows are counted each; empty sections have no tokens.
The vocabulary file is a parameter; its bytes (about 1 MB) are sent to the tasks,
after a check of their size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 32 << 20  # largest vocabulary file that is sent to tasks
#: Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("most", "first", "share")
_ENCODERS: dict[str, tuple] = {}


def encoder(raw: bytes, pattern: str):
    """(tokenizer, byte length of each id), built once per Python worker."""
    import tiktoken

    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _ENCODERS[key]


def token_spans(text: str, tokenizer, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of the tokens of a whole text."""
    ids = np.asarray(tokenizer.encode_ordinary(text), np.int64)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # character of each byte
    return char[starts], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens touching it) of each section; section i is [bounds[i], bounds[i + 1])."""
    n = len(bounds) - 1
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    if len(starts) == 0:
        return counts, crossing
    first = np.searchsorted(bounds[:-1], starts, side="right") - 1
    last = np.searchsorted(bounds[:-1], ends - 1, side="right") - 1
    over = np.flatnonzero(first != last)
    if rule == "first" or not len(over):
        counts += np.bincount(first, minlength=n)
    else:
        counts += np.bincount(np.delete(first, over), minlength=n)
    for t in over:
        touched = np.arange(first[t], last[t] + 1)
        chars = np.minimum(bounds[touched + 1], ends[t]) - np.maximum(bounds[touched], starts[t])
        crossing[touched[chars > 0]] += 1
        if rule == "most":
            counts[touched[int(np.argmax(chars))]] += 1
        elif rule == "share":
            counts[touched] += chars / chars.sum()
    return counts, crossing


def line_bounds(text: str) -> np.ndarray:
    """A section is a line with its line end; text after the last line end is one too."""
    cuts = [0]
    at = text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] != len(text) or len(cuts) == 1:
        cuts.append(len(text))
    return np.array(cuts, np.int64)


def _sections(batches: Iterator[pa.RecordBatch], raw: bytes, pattern: str, rule: str, separator: str | None) -> Iterator[pa.RecordBatch]:
    tokenizer, lengths = encoder(raw, pattern)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            row, section, start, end, n, crossing = [], [], [], [], [], []
            for r, value in enumerate(part.column("__text").to_pylist()):
                if separator is None:
                    text = value or ""
                    bounds = line_bounds(text)
                else:
                    fields = [v or "" for v in value]
                    text = separator.join(fields)
                    bounds = np.concatenate(([0], np.cumsum([len(v) + len(separator) for v in fields])))
                    bounds[-1] = len(text)
                counts, over = attribute(*token_spans(text, tokenizer, lengths), bounds, rule) if text else (np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1, np.int64))
                k = len(bounds) - 1
                row.append(np.full(k, r))
                section.append(np.arange(k))
                start.append(bounds[:-1])
                end.append(bounds[1:])
                n.append(counts)
                crossing.append(over)
            at = pa.array(np.concatenate(row))
            kept = [part.column(i).take(at) for i in range(part.num_columns) if part.schema.names[i] != "__text"]
            names = [x for x in part.schema.names if x != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.concatenate(section), pa.int64()), pa.array(np.concatenate(start), pa.int64()), pa.array(np.concatenate(end), pa.int64()),
                 pa.array(np.concatenate(n), pa.float64()), pa.array(np.concatenate(crossing), pa.int64())],
                names=[*names, "section", "start", "end", "n_tokens", "n_crossing"])


def count(docs: DataFrame, texts: str | list[str] = "text", keep: list[str] | None = None, rule: str = "most", separator: str = "\n",
          vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """A row per section: the columns ``keep`` of ``docs``, section (from 0), start, end (characters), n_tokens, n_crossing.

    One column: its lines are the sections.  A list of columns: they are the fields of one document, joined by
    ``separator``, which belongs to the field before it.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    raw = Path(vocabulary).read_bytes()
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is larger than what may be sent to tasks")
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    added = [T.StructField("section", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
             T.StructField("n_tokens", T.DoubleType()), T.StructField("n_crossing", T.LongType())]
    names = [c for c in (keep if keep is not None else [c for c in docs.columns if c != texts and c not in texts]) if c not in {f.name for f in added}]
    value = F.col(f"`{texts}`").cast("string") if isinstance(texts, str) else F.array(*[F.col(f"`{c}`").cast("string") for c in texts])
    base = docs.select(*[F.col(f"`{c}`") for c in names], value.alias("__text"))
    schema = T.StructType([*base.drop("__text").schema.fields, *added])
    between = None if isinstance(texts, str) else separator
    return base.mapInArrow(lambda it: _sections(it, shared.value, pattern, rule, between), schema)
