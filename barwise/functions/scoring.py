"""Text scoring with a pluggable model, and class scores from logits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 16


def softmax(logits: Column) -> Column:
    """Class probabilities of an array of logits."""
    peak = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - peak))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def sentiment_from_logits(df: DataFrame, logits: str, labels: list[str]) -> DataFrame:
    """sentiment = p(positive) - p(negative), confidence = largest p, top label."""
    p = F.col("_p")
    at = lambda name: F.get(p, F.lit(labels.index(name)))
    x = df.withColumn("_p", softmax(F.col(logits)))
    top = F.array_position(p, F.array_max(p)) - 1
    return x.withColumns({"sentiment": at("positive") - at("negative"), "confidence": F.array_max(p),
                          "label": F.get(F.array(*[F.lit(v) for v in labels]), top.cast("int"))}).drop("_p")


def score_texts(df: DataFrame, text: str, loader: Callable[[], Callable[[list[str]], list[tuple[float, float]]]],
                model: str, batch: int = BATCH) -> DataFrame:
    """Add sentiment, confidence and model columns; empty texts fail before scoring.

    ``loader`` runs once per worker and returns a function from texts to
    (sentiment, confidence); whole texts are passed in small batches.  Time
    columns are left as they are: a score does not change availability.
    """
    empty = F.col(text).isNull() | (F.length(F.trim(text)) == 0)
    checked = df.withColumn(text, F.when(empty, F.raise_error(F.lit("text to score is empty"))).otherwise(F.col(text)))

    @F.pandas_udf("struct<sentiment:double,confidence:double>")
    def scorer(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = loader()
        for part in parts:
            texts = part.tolist()
            out = [r for i in range(0, len(texts), batch) for r in score(texts[i:i + batch])]
            yield pd.DataFrame(out, columns=["sentiment", "confidence"])
    return checked.withColumn("_s", scorer(F.col(text))).withColumns({
        "sentiment": F.col("_s.sentiment"), "confidence": F.col("_s.confidence"), "model": F.lit(model)}).drop("_s")


def per_group(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One metrics row per group from a caller's function, e.g. one strategy evaluation per placebo run.

    Groups are series of one row per session, so each fits a task.
    """
    def call(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(keys, key)), **run(pdf)}])
    return df.groupBy(*keys).applyInPandas(call, schema)


def allocate(returns: DataFrame, keys: list[str], symbols: list[str], solver: Callable[[pd.DataFrame], dict[str, float]],
             ts: str = "ts", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Weights per (keys, symbol) from a caller's solver on each training matrix; weights outside bounds fail."""
    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = pdf.pivot(index=ts, columns="symbol", values="ret").reindex(columns=symbols).dropna()
        weights = solver(matrix)
        if any(not low - 1e-9 <= w <= high + 1e-9 for w in weights.values()):
            raise ValueError("solver returned weights outside the bounds")
        return pd.DataFrame([{**dict(zip(keys, key)), "symbol": s, "w": float(w)} for s, w in weights.items()])
    fields = ", ".join(f"`{k}` {returns.schema[k].dataType.simpleString()}" for k in keys)
    return returns.groupBy(*keys).applyInPandas(solve, f"{fields}, symbol string, w double")
