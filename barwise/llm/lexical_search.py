"""Ranked lexical search for many queries at once over a shared plan of their term sets.

Terms are runs of ASCII letters and digits and of everything above 0x7F, A-Z lower-cased.  With N documents that hold a
term, L terms in all, n terms in a document, df documents with a term and tf occurrences in the document, a term adds
w * ((10**9 * tf) div (1000 * tf + 8 * m)) to an item's score for each of its occurrences there, where
w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 25 + (75 * n * N) div L, all in 64-bit integers.

The items are taken in blocks.  The plan of a block is mined from its items: as long as two nodes (terms at first) stand
together in ``least`` items or more, the pair in most items becomes a node of its own and replaces them there (pairs are looked for among ``GROUP`` terms at
a time, those in most items first).  So each
item ends as a short list of nodes, and nodes form a directed graph in which a shared term set stands once, whatever the
number of items above it.  One pass over the documents counts N, L, n and df; the second keeps, for a slice of documents,
an accumulator of partial scores for each node, adds each node's two children once, then adds up the items' short lists
and takes each item's best ``k`` so far.  A task hands on ``k`` rows per item.

Defined results: a null text has no terms, and neither such a document nor such an item is in any result; a document
without id counts in N, L and df and comes after those with ids of the same score; repeated rows are ranked each; each
row of the items is an item of its own; equal scores go by ascending id; no documents or items give no rows.  A long
document is a slice of its own.  Other columns are not looked at.  Terms are identified by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.llm.common import Words, rows_of, word_table

WORD = word_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
ITEMS = 1000  # items of a block: bounds what the driver and the tasks hold of the items
GROUP = 256  # terms among which pairs are mined, in order of the items that hold them: keeps long items linear
CELLS = 1 << 21  # accumulators held at once: nodes of the plan times documents of a slice
FOUND = "item int, doc_id long, score long"


# ---- the plan -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Plan:
    leaves: np.ndarray  # sorted term hashes; node i is leaf i
    pairs: np.ndarray  # (nodes - leaves, 2): children of the further nodes, children first
    item_of: np.ndarray  # with node_of and times: item lists, in order of items
    node_of: np.ndarray
    times: np.ndarray
    items: int

    @property
    def nodes(self) -> int:
        return len(self.leaves) + len(self.pairs)


def mine(items: list[dict[int, int]], least: int = 2) -> Plan:
    """The plan of items given as term hash -> occurrences; occurrences beyond the first stay outside the shared sets."""
    leaves = np.array(sorted({t for item in items for t in item}), np.uint64)
    number = {int(t): i for i, t in enumerate(leaves)}
    lists = [{number[t] for t in item} for item in items]
    held = Counter(node for nodes in lists for node in nodes)
    group = {node: i // GROUP for i, (node, times) in enumerate(held.most_common()) if times >= least}
    with_pair: dict[tuple[int, int], set[int]] = defaultdict(set)
    for q, nodes in enumerate(lists):
        own: dict[int, list[int]] = defaultdict(list)
        for node in sorted(nodes & group.keys()):
            own[group[node]].append(node)
        for pair in (pair for members in own.values() for pair in combinations(members, 2)):
            with_pair[pair].add(q)
    waiting: dict[int, set[tuple[int, int]]] = defaultdict(set)  # pairs by the number of items they stand in
    for pair, owners in with_pair.items():
        waiting[len(owners)].add(pair)
    top, pairs, following = max(waiting, default=0), [], len(leaves)

    def change(pair, q, add):
        owners = with_pair[pair]
        waiting[len(owners)].discard(pair)
        (owners.add if add else owners.discard)(q)
        waiting[len(owners)].add(pair)
    while top >= least:
        if not waiting[top]:
            top -= 1
            continue
        a, b = min(waiting[top])
        new, following = following, following + 1
        pairs.append((a, b))
        group[new] = group[a]
        for q in list(with_pair[a, b]):
            rest = lists[q] - {a, b}
            change((a, b), q, False)
            for x in (x for x in rest if group.get(x) == group[new]):
                change((min(a, x), max(a, x)), q, False)
                change((min(b, x), max(b, x)), q, False)
                change((x, new), q, True)
            lists[q] = rest | {new}
    entries = [Counter(dict.fromkeys(nodes, 1)) for nodes in lists]
    for q, item in enumerate(items):
        for t, times in item.items():
            if times > 1:
                entries[q][number[t]] += times - 1
    flat = [(q, node, times) for q, entry in enumerate(entries) for node, times in sorted(entry.items())]
    q, node, times = (np.array(x, np.int64) for x in zip(*flat)) if flat else (np.zeros(0, np.int64),) * 3
    return Plan(leaves, np.array(pairs, np.int64).reshape(-1, 2), q, node, times, len(items))


# ---- documents ----------------------------------------------------------------------------

def _terms(part: pa.RecordBatch, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each row, and (row, leaf, tf) of the leaves in it."""
    w = Words(part.column("text"), WORD)
    per = np.diff(w.rows)
    at = np.searchsorted(leaves, w.hashes)
    at[at == len(leaves)] = 0
    hit = np.flatnonzero(leaves[at] == w.hashes) if len(leaves) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(per)), per)[hit]
    key, tf = np.unique(row * max(1, len(leaves)) + at[hit], return_counts=True)
    return per, key // max(1, len(leaves)), key % max(1, len(leaves)), tf


def _counts(batches: Iterator[pa.RecordBatch], leaves: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(leaf, total) of the task: df of each leaf; -1 documents with terms, -2 terms."""
    df, n, total = np.zeros(len(leaves), np.int64), 0, 0
    for batch in batches:
        for part in rows_of(batch, "text"):
            per, _, leaf, _ = _terms(part, leaves)
            df += np.bincount(leaf, minlength=len(leaves))
            n += int((per > 0).sum())
            total += int(per.sum())
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, (-1, -2)), pa.int32()), pa.array(np.append(df[found], (n, total)))], names=["leaf", "total"])


def accumulate(plan: Plan, values: np.ndarray) -> np.ndarray:
    """Scores (items, documents) from leaf values (leaves, documents): each node of the graph is added up once."""
    acc = np.empty((plan.nodes, values.shape[1]), np.int64)
    acc[:len(values)] = values
    for i, (a, b) in enumerate(plan.pairs):
        np.add(acc[a], acc[b], out=acc[len(values) + i])
    out = np.zeros((plan.items, values.shape[1]), np.int64)
    for q, node, times in zip(plan.item_of.tolist(), plan.node_of.tolist(), plan.times.tolist()):
        out[q] += acc[node] if times == 1 else times * acc[node]
    return out


class Best:
    """The best ``k`` (score, id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * items, [np.zeros(0, np.int64)] * items

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for q in range(len(self.scores)):
            own = self.scores[q]
            floor = own[-1] if len(own) == self.k else 1
            at = np.flatnonzero(scores[q] >= floor)
            if len(at):
                s, d = np.concatenate([own, scores[q][at]]), np.concatenate([self.ids[q], ids[at]])
                first = np.lexsort((d, -s))[:self.k]
                self.scores[q], self.ids[q] = s[first], d[first]


LAST = np.iinfo(np.int64).max  # stands for a null id in comparisons


def _rank(batches: Iterator[pa.RecordBatch], plan: Plan, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(plan.items, k)
    width = max(1, CELLS // max(1, plan.nodes + plan.items))
    for batch in batches:
        for part in rows_of(batch, "text"):
            per, row, leaf, tf = _terms(part, plan.leaves)
            m = 100 - 75 + (75 * per * n_docs) // n_terms
            value = weight[leaf] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            ids = part.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
            for lo in range(0, part.num_rows, width):
                hi = min(part.num_rows, lo + width)
                a, b = np.searchsorted(row, (lo, hi))
                if a == b:
                    continue
                values = np.zeros((len(plan.leaves), hi - lo), np.int64)
                values[leaf[a:b], row[a:b] - lo] = value[a:b]
                best.add(accumulate(plan, values), ids[lo:hi])
    item = np.repeat(np.arange(plan.items), [len(x) for x in best.scores])
    ids = np.concatenate([*best.ids, np.zeros(0, np.int64)])
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, mask=ids == LAST), pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]))],
                                     names=["item", "doc_id", "score"])


# ---- the job ------------------------------------------------------------------------------

def term_counts(texts: list[str | None]) -> list[dict[int, int]]:
    w = Words(pa.array(texts, pa.string()), WORD)
    return [dict(Counter(w.hashes[a:b].tolist())) for a, b in zip(w.rows[:-1], w.rows[1:])]


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _block(docs: DataFrame, items: list, item_type: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    plan = mine(term_counts([r["text"] for r in items]))
    totals = {r["leaf"]: r["total"] for r in docs.mapInArrow(lambda it, x=plan.leaves: _counts(it, x), "leaf int, total long").groupBy("leaf").agg(F.sum("total").alias("total")).collect()}
    n_docs, n_terms = totals.get(-1, 0) or 0, totals.get(-2, 0) or 0
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"item int, item_id {item_type}")
    if not n_terms:
        return names.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    weight = weights(np.array([totals.get(i, 0) for i in range(len(plan.leaves))], np.int64), n_docs)
    found = docs.mapInArrow(lambda it: _rank(it, plan, weight, n_docs, n_terms, k), FOUND)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's ``k`` best documents with a score above 0."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    items = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    item_type = dict(items.dtypes)["item_id"]
    blocks = -(-items.count() // ITEMS)
    if blocks <= 1:
        return _block(docs, items.collect(), item_type, k)  # ITEMS rows at most
    dealt = items.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    results = [_block(docs, dealt.where(F.col("block") == b).drop("block").collect(), item_type, k) for b in range(blocks)]
    return reduce(DataFrame.unionByName, results)
