"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

A document longer than a bin is cut into full pieces and a rest.  Pieces are
dealt into shards of about ``shard_rows`` by a hash of id and piece, so no task
holds more than a bounded number of them; in a shard they are placed in order of
falling size.  Bins stand in order of their residual and carry a bitmap of the
duplicate clusters and ``per_source`` bitmaps of the sources in them.  The search
starts at the first bin whose residual is large enough and goes to its
successors until one conflicts with neither bitmap; if none is left, a bin opens.
So no bin ever holds two pieces of one duplicate cluster (a document's own
pieces are one too), nor more than ``per_source`` pieces of one source.

Defined results: sizes of null count as 0; pieces of size 0 are placed like
others; null source and null cluster are no constraint; ties go by cluster,
document and piece; repeated rows of one id are separate pieces; an empty table
gives no bins.  Only sizes and keys are shuffled, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ROWS = 2000
PER_SOURCE = 2
SCHEMA = "shard long, doc_id long, piece long, size long, bin long"


def best_fit(sizes, sources, clusters, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[int]:
    """Bin of each item, the items taken in the given order; sources and clusters are small codes, -1 for none."""
    residual: list[tuple[int, int]] = []  # (room left, bin), sorted
    dup: list[int] = []
    planes: list[list[int]] = []  # planes[bin][k]: sources with more than k pieces in the bin
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(residual, (size, -1))
        while at < len(residual):
            b = residual[at][1]
            if not (dup[b] & c or planes[b][-1] & s):
                break
            at += 1
        if at < len(residual):
            room, b = residual.pop(at)
        else:
            room, b = capacity, len(dup)
            dup.append(0)
            planes.append([0] * per_source)
        insort(residual, (room - size, b))
        dup[b] |= c
        for k, plane in enumerate(planes[b]):
            if not plane & s:
                planes[b][k] |= s
                break
        out.append(b)
    return out


def codes(values: pd.Series) -> list[int]:
    """Small codes of the values that occur twice or more; -1 for null and for values that can't conflict."""
    again = values.notna() & values.duplicated(keep=False)
    return pd.Series(pd.factorize(values.where(again))[0], index=values.index).tolist()


def _pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    rows = rows.assign(room=-rows["size"]).sort_values(["room", "cluster", "doc_id", "piece", "source"], kind="stable", na_position="last").reset_index(drop=True)
    bins = best_fit(rows["size"].tolist(), codes(rows["source"]), codes(rows["cluster"]), capacity, per_source)
    return rows[["shard", "doc_id", "piece", "size"]].assign(bin=bins)


def word_count(text: Column) -> Column:
    """Words between white space, and one end mark."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def same_text(text: Column) -> Column:
    """Key of the duplicate cluster: equal texts without regard to case and white space."""
    return F.md5(F.lower(F.regexp_replace(text.cast("string"), r"[\x20\x09-\x0D]+", " ")))


def pack(docs: DataFrame, size: Column | None = None, source: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY,
         per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS, doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: shard, bin (number within the shard), doc_id, piece, size, and bin_id, unique over all shards."""
    size = word_count(F.col("text")) if size is None else size
    source = F.col("source") if source is None else source
    cluster = same_text(F.col("text")) if cluster is None else cluster
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(size.cast("long"), F.lit(0)).alias("total"),
                       source.cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    n_pieces = F.greatest(F.ceil(F.col("total") / capacity), F.lit(1)).cast("long")
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)).alias("piece")).select(
        "doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity).alias("size"), "source", "cluster")
    n = docs.select(F.sum(F.greatest(F.ceil(F.coalesce(size.cast("long"), F.lit(0)) / capacity), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(n) // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))
    out = dealt.groupBy("shard").applyInPandas(lambda pdf: _pack_shard(pdf, capacity, per_source), SCHEMA)
    return out.withColumn("bin_id", F.col("bin") * shards + F.col("shard"))
