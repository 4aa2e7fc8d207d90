"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades 0..K are ordered.  P(grade >= k) = sigmoid(w.x - cut_k): all thresholds
share the weights, the cuts rise with k, and the expected severity is the sum of
the K probabilities.  Features are the words of a text and their prefixes of 4,
5 and 6 letters, present or not.

The model is fitted on at most ``sample_rows`` labelled rows (those with the
smallest hashes of doc_id; all of them in a smaller table).  Feature counts over
that sample are Spark aggregations; at most ``max_features`` features with the
largest association with grade > 0 are kept, so the sparse design that the
driver fits is bounded by both parameters.  Scoring reads whole texts.

Defined results: a null or empty text has no features and gets the cuts alone; a
row without id is scored like others but never trains; several labels of one id
count as the highest; without labels of two grades every severity is the mean
grade (0 without any); other columns are kept, those named like the results are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.llm.common import hash_sample, rows_of

SAMPLE_ROWS = 20_000
MAX_FEATURES = 20_000
MIN_DOCS = 3
MIN_ASSOCIATION = 10.0
PENALTY = 0.3
REJECT = 0.5
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def features_of(word: str) -> list[str]:
    return [f"={word}", *[word[:n] for n in PREFIXES if len(word) >= n]]


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch, "text"):
            feats = [sorted({f for w in set(WORD.findall((t or "").lower())) for f in features_of(w)}) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), pa.array(feats, pa.list_(pa.string()))], names=["doc_id", "grade", "features"])


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a row per document."""
        return _sigmoid(linear[:, None] - self.cuts[None, :])


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, penalty: float = PENALTY,
                steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising cuts that minimise the penalised negative log likelihood (full-batch Adam).

    ``rows``/``cols``: places of the ones in the design matrix.  The distances of the cuts are drawn
    towards those of the grades' shares with half a pseudo-count, which holds where no row has a grade.
    """
    n = len(grades)
    share = np.array([((grades >= k).sum() + 0.5) / (n + 1.0) for k in range(1, n_grades + 1)])
    first = -np.log(share / (1 - share))
    w = np.zeros(n_features)
    gaps = np.concatenate(([first[0]], np.log(np.maximum(np.diff(first), 1e-2))))
    start = gaps
    theta = np.concatenate((w, gaps))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, gaps = theta[:n_features], theta[n_features:]
        steps_up = np.exp(np.clip(gaps[1:], -20, 5))
        cuts = gaps[0] + np.concatenate(([0.0], np.cumsum(steps_up)))
        linear = np.bincount(rows, weights=w[cols], minlength=n) if len(rows) else np.zeros(n)
        above = np.concatenate((np.ones((n, 1)), _sigmoid(linear[:, None] - cuts), np.zeros((n, 1))), axis=1)  # P(y >= k), k = 0..K+1
        p = np.maximum(above[np.arange(n), grades] - above[np.arange(n), grades + 1], 1e-12)
        slope = above * (1 - above)
        low, high = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        d_linear = -(low - high) / p
        d_cut = np.zeros(n_grades + 2)
        np.add.at(d_cut, grades, low / p)
        np.add.at(d_cut, grades + 1, -high / p)
        d_cut = d_cut[1:-1]
        g_w = (np.bincount(cols, weights=d_linear[rows], minlength=n_features) if len(rows) else np.zeros(n_features)) + penalty * w
        tail = np.cumsum(d_cut[::-1])[::-1]
        g = np.concatenate((g_w, [tail[0]], tail[1:] * steps_up + gaps[1:] - start[1:]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (1 - t / (steps + 1)) ** 0.5 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    gaps = theta[n_features:]
    return theta[:n_features], gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(np.clip(gaps[1:], -20, 5)))))


def fit(docs: DataFrame, grades: DataFrame, n_grades: int = 2, sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES,
        penalty: float = PENALTY) -> Model:
    """Fit on documents (doc_id, text) and grades (doc_id, grade 0..n_grades)."""
    known = grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = hash_sample(known, "doc_id", sample_rows)  # bounded by the parameter, so is its broadcast
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").mapInArrow(
        _sample_features, T.StructType([docs.schema["doc_id"], T.StructField("grade", T.IntegerType()), T.StructField("features", T.ArrayType(T.StringType()))])).persist()
    try:
        by_grade = {r[0]: r[1] for r in sample.groupBy("grade").count().collect()}
        n, pos = sum(by_grade.values()), sum(c for g, c in by_grade.items() if g > 0)
        if len(by_grade) < 2:
            mean = max(by_grade, default=0)
            return Model({}, np.zeros(0), np.array([-40.0 if k <= mean else 40.0 for k in range(1, n_grades + 1)]))
        counts = sample.select((F.col("grade") > 0).cast("long").alias("y"), F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("pos"))
        expected = F.col("df") * pos / n
        spread = expected * (n - pos) / n * (1 - F.col("df") / (n + 1)) + 1e-9
        strong = counts.where(F.col("df") >= MIN_DOCS).withColumn("chi", F.pow(F.col("pos") - expected, 2) / spread).where(F.col("chi") >= MIN_ASSOCIATION)
        top = [r[0] for r in strong.orderBy(F.desc("chi"), "f").limit(max_features).select("f").collect()]
        index = {f: i for i, f in enumerate(top)}
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def narrowed(it):
            for b in it:
                own = [[shared.value[f] for f in fs if f in shared.value] for fs in b.column("features").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(own, pa.list_(pa.int32()))], names=["grade", "own"])
        design = sample.select("grade", "features").mapInArrow(narrowed, "grade int, own array<int>").toArrow()
    finally:
        sample.unpersist()
    y = np.clip(design["grade"].to_numpy().astype(np.int64), 0, n_grades)
    own = design["own"].combine_chunks()
    cols = own.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(y)), pc.list_value_length(own).to_numpy())
    del design, own
    weights, cuts = fit_ordinal(rows, cols, y, len(index), n_grades, penalty)
    return Model(index, weights, cuts)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        for part in rows_of(batch, "__text"):
            linear = np.zeros(part.num_rows)
            for r, text in enumerate(part.column("__text").to_pylist()):
                if not text:
                    continue
                own: set[int] = set()
                for w in set(WORD.findall(text.lower())):
                    at = known.get(w)
                    if at is None:
                        if len(known) >= 300_000:
                            known.clear()
                        at = known[w] = tuple(model.index[f] for f in features_of(w) if f in model.index)
                    own.update(at)
                linear[r] = model.weights[sorted(own)].sum()
            p = model.probabilities(linear)
            out = [part.column(i) for i in range(part.num_columns)]
            out += [pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(p.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(out, names=[*part.schema.names, "p_at_least", "severity"])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with p_at_least (P(grade >= k), k = 1..K) and severity, the expected grade."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("p_at_least", "severity")]
    base = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*base.schema.fields, T.StructField("p_at_least", T.ArrayType(T.DoubleType())), T.StructField("severity", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.mapInArrow(lambda it: _score(it, shared.value), schema).drop("__text")


def grades_of(labels: DataFrame) -> DataFrame:
    """Severity grades of the label table: 0 not toxic, 1 toxic, 2 toxic in a text of low quality."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0).alias("grade"))


def rejected():
    return F.col("severity") >= REJECT


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose expected severity is below the limit; columns as in ``docs``."""
    model = fit(docs, grades_of(labels), **options)
    return score(docs, model).where(~rejected()).select(*[f"`{c}`" for c in docs.columns])
