"""Language identification as a mixture: proportions by expectation-maximisation, the set by penalised likelihood.

Features are byte trigrams of the lower-cased text (A-Z) with every run of
bytes other than letters as one space, hashed into ``buckets``.  Training counts
them per label over all training rows: each task adds up its own batches, Spark
sums the rest.  A document's likelihood is a mixture of the languages' smoothed
trigram distributions; EM finds the proportions, and among the nested sets of
the largest proportions the one with the best log likelihood minus
``penalty`` * log(n) / 2 per language is taken.

The model is languages x buckets numbers and is checked against
``max_languages`` before it is sent to the tasks.  Defined results: a null text
or one without a letter is ``und`` with score 0 and an empty set; rows with null
labels never train; without any training row every text is ``und``; other columns
are kept, those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.llm.common import LOWER, flat, rows_of

BUCKETS = 1 << 15
MAX_LANGUAGES = 512
ROUNDS = 25
PENALTY = 6.0
SMOOTHING = 0.05
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True


def trigrams(col: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every byte trigram of a column of texts; trigrams without a letter are left out."""
    raw, offsets = flat(col)
    x = LOWER[raw]
    x = np.where(LETTER[x], x, np.uint8(32))
    n = len(x)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.ones(n, bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (row[1:] != row[:-1])  # a run of other bytes is one space
    x, row = x[keep].astype(np.uint32), row[keep]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    same = row[:-2] == row[2:]
    bucket = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
    return row[:-2][same], bucket[same].astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in rows_of(batch, "text"):
            row, bucket = trigrams(part.column("text"), buckets)
            labels = part.column("label").to_pylist()
            names = sorted(set(labels))
            own = np.array([names.index(v) for v in labels], np.int64)
            add = np.bincount(own[row] * buckets + bucket, minlength=len(names) * buckets).reshape(len(names), buckets)
            for k, name in enumerate(names):
                total[name] = total[name] + add[k] if name in total else add[k]
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["label", "bucket", "n"])


def train(docs: DataFrame, label: Column, text: str = "text", buckets: int = BUCKETS, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the log probability of each bucket in each of them."""
    rows = docs.select(label.cast("string").alias("label"), F.col(f"`{text}`").cast("string").alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(lambda it: _count(it, buckets), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).persist()
    try:
        names = [r[0] for r in sums.select("label").distinct().limit(max_languages + 1).collect()]
        if len(names) > max_languages:
            raise ValueError(f"more than {max_languages} languages: the model would not be bounded")
        names.sort()
        table = np.zeros((len(names), buckets))
        for name, bucket, n in sums.collect():  # at most languages x buckets rows
            table[names.index(name), bucket] = n
    finally:
        sums.unpersist()
    if not names:
        return [], table
    table += SMOOTHING * 100 * table.sum(axis=0) / max(table.sum(), 1) + SMOOTHING
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def mixture(counts: np.ndarray, starts: np.ndarray, likelihood: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM from the given proportions: those per document, and its log likelihood up to the likelihoods' scale.

    counts: of each (document, bucket); starts: where a document's begin; likelihood: the languages' values
    for each.  Languages that begin with proportion 0 stay out.
    """
    own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(counts))))
    size = np.add.reduceat(counts, starts)
    for _ in range(rounds):
        part = share[own] * likelihood
        weight = counts / np.maximum(part.sum(axis=1), 1e-300)
        share = np.add.reduceat(part * weight[:, None], starts, axis=0) / size[:, None]
    total = np.log(np.maximum((share[own] * likelihood).sum(axis=1), 1e-300))
    return share, np.add.reduceat(counts * total, starts)


def choose(counts: np.ndarray, starts: np.ndarray, likelihood: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first proportions, proportions in the chosen set, size of the set) per document.

    Sets are nested: the k languages of the largest proportions, k = 1, 2, ...; a larger set is tried only
    where the last one was better than the one before.
    """
    n_docs, n_lang = len(starts), likelihood.shape[1]
    full, _ = mixture(counts, starts, likelihood, np.full((n_docs, n_lang), 1.0 / n_lang), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    size = np.add.reduceat(counts, starts)
    own = np.repeat(np.arange(n_docs), np.diff(np.append(starts, len(counts))))
    best, best_share, best_size = np.full(n_docs, -np.inf), np.zeros_like(full), np.zeros(n_docs, np.int64)
    open_docs = np.arange(n_docs)
    for k in range(1, n_lang + 1):
        mask = np.zeros((n_docs, n_lang))
        np.put_along_axis(mask, order[:, :k], 1.0, axis=1)
        pick = np.isin(own, open_docs) if len(open_docs) < n_docs else np.ones(len(own), bool)
        sub_own = own[pick]
        sub_starts = np.flatnonzero(np.r_[True, sub_own[1:] != sub_own[:-1]])
        share, loglik = mixture(counts[pick], sub_starts, likelihood[pick], mask[open_docs] / k, rounds if k > 1 else 1)
        value = loglik - penalty * k * np.log(size[open_docs] + 1) / 2
        better = value > best[open_docs]
        at = open_docs[better]
        best[at], best_share[at], best_size[at] = value[better], share[better], k
        open_docs = at
        if not len(open_docs):
            break
    return full, best_share, best_size


def _predict(batches: Iterator[pa.RecordBatch], names: list[str], logp: np.ndarray, rounds: int, penalty: float) -> Iterator[pa.RecordBatch]:
    buckets = logp.shape[1]
    # per bucket the largest is 1: this scale is the same for every set of one document, so it cancels in comparisons
    scaled = np.exp(logp - logp.max(axis=0)).T.copy() if names else np.zeros((buckets, 0))
    for batch in batches:
        for part in rows_of(batch, "__text", 1 << 19):
            n = part.num_rows
            lang, score, sets = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
            row, bucket = trigrams(part.column("__text"), buckets)
            letters = part.column("__letters").to_pylist()
            if names and len(row):
                key, counts = np.unique(row * buckets + bucket, return_counts=True)
                own, of = key // buckets, key % buckets
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                full, share, size = choose(counts.astype(float), starts, scaled[of], rounds, penalty)
                for i, r in enumerate(own[starts]):
                    if not letters[r]:
                        continue
                    order = np.argsort(-share[i], kind="stable")[:size[i]]
                    lang[r] = names[order[0]]
                    score[r] = min(1.0, max(0.0, full[i][order[0]]))
                    sets[r] = [{"lang": names[k], "share": float(share[i][k])} for k in order if share[i][k] > 0]
            if names:
                prior = names[0]
                for r in range(n):  # a letter, but no trigram: too short to tell
                    if letters[r] and lang[r] == "und":
                        lang[r], score[r], sets[r] = prior, 1.0 / len(names), [{"lang": prior, "share": 1.0 / len(names)}]
            out = [part.column(i) for i in range(part.num_columns)]
            out += [pa.array(lang), pa.array(score), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]
            yield pa.RecordBatch.from_arrays(out, names=[*part.schema.names, "lang_pred", "score", "languages"])


RESULTS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None, rounds: int = ROUNDS,
            penalty: float = PENALTY) -> DataFrame:
    """``docs`` with lang_pred, score (the language's proportion over all languages) and languages (the chosen set with shares)."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS.names]
    value = F.col(f"`{text}`").cast("string")
    base = docs.select(*[F.col(f"`{c}`") for c in names], value.alias("__text"), F.coalesce(value.rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    schema = T.StructType([*base.schema.fields, *RESULTS.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.mapInArrow(lambda it: _predict(it, *shared.value, rounds, penalty), schema).drop("__text", "__letters")
