"""Rolling windows and features against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwise.functions.rolling import Rolling, split_history
from barwise.operators import price_features as pf
from tests.conftest import series

S = Rolling()


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))


def column(df, name):
    return df.orderBy("ts").toPandas()[name].astype(float).to_numpy()


def test_rolling_statistics_match_pandas(spark):
    x = walk(120)
    x[40] = np.nan
    df = series(spark, [None if np.isnan(v) else v for v in x])
    p = pd.Series(x)
    out = df.select("ts", S.mean("close", 10).alias("m"), S.sd("close", 10).alias("s"), S.quantile("close", 0.9, 10).alias("q"),
                    S.quantile("close", 0.5, 20, min_obs=5).alias("qm"), S.skew("close", 20).alias("g"), S.kurt("close", 20).alias("k")
                    ).orderBy("ts").toPandas().astype({c: float for c in ("m", "s", "q", "qm", "g", "k")})
    r = p.rolling(10)
    want = {"m": r.mean(), "s": r.std(), "q": r.quantile(0.9), "qm": p.rolling(20, min_periods=5).median(),
            "g": p.rolling(20).skew(), "k": p.rolling(20).kurt()}
    for name, expected in want.items():
        np.testing.assert_allclose(out[name], expected, rtol=1e-8, atol=1e-8, equal_nan=True, err_msg=name)


def test_rsi_matches_pandas_ewm(spark):
    x = pd.Series(walk(200, 3))
    d = x.diff()
    up = d.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    down = (-d).clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    got = column(pf.rsi(series(spark, x)), "rsi_14")
    np.testing.assert_allclose(got, 100 - 100 / (1 + up / down), rtol=1e-10, equal_nan=True)


def test_decayed_sum_carries_over_blocks(spark):
    n, keep = 900, 0.2
    x = np.random.default_rng(5).normal(size=n)
    got = column(pf.decayed_sum(series(spark, x, column="x"), {"x": "y"}, keep), "y")
    want, y = [], 0.0
    for v in x:
        y = keep * y + v
        want.append(y)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)


def test_split_history_gives_the_same_windows(spark):
    df = series(spark, walk(700, 9)).unionByName(series(spark, walk(650, 10), symbol="B"))
    whole = df.withColumn("m", S.mean("close", 50)).withColumn("z", S.zscore("close", 50))
    cut = split_history(df, head_rows=60, rows_per_chunk=200)
    c = Rolling(("symbol", "chunk"))
    parts = cut.withColumn("m2", c.mean("close", 50)).withColumn("z2", c.zscore("close", 50)).where("NOT is_head")
    j = whole.join(parts.select("symbol", "ts", "m2", "z2"), ["symbol", "ts"])
    assert j.count() == 1350
    assert j.where("NOT (m <=> m2) AND abs(m - m2) > 1e-9").count() == 0
    assert j.where("(m IS NULL) <> (m2 IS NULL)").count() == 0


def test_split_history_rejects_a_long_head(spark):
    with pytest.raises(ValueError):
        split_history(series(spark, [1, 2]), 10, 10)


def test_parkinson_constant_range_and_lag(spark):
    df = series(spark, [100] * 25, high=101.0, low=99.0)
    got = column(pf.parkinson(df), "parkinson_lag_20")
    assert np.isnan(got[:20]).all()
    np.testing.assert_allclose(got[20:], np.sqrt(252 * np.log(101 / 99) ** 2 / (4 * np.log(2))))


def test_range_features_refuse_synthetic_ranges(spark):
    df = series(spark, [100] * 25, high=101.0, low=99.0, synthetic_range=True)
    with pytest.raises(Exception, match="synthetic"):
        pf.parkinson(df).collect()


def test_future_bars_never_change_history(spark):
    x = walk(150, 4)
    y = x.copy()
    y[100:] *= 1.5
    frames = []
    for v in (x, y):
        b = series(spark, v, open=v * 1.001, high=v * 1.01, low=v * 0.99, volume=np.arange(150) + 100.0)
        frames.append(pf.signal_extensions(pf.price_volume_features(b)).where("ts < '2020-04-10'"))
    cols = [c for c in frames[0].columns if c not in ("symbol", "ts")]
    a, b = (f.orderBy("ts").toPandas()[cols].astype(float) for f in frames)
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)


def test_peer_correlation_equals_pairwise_mean(spark):
    rng = np.random.default_rng(2)
    data = {s: walk(60, i) for i, s in enumerate("ABCD")}
    df = None
    for s, v in data.items():
        one = series(spark, v, symbol=s)
        df = one if df is None else df.unionByName(one)
    got = pf.average_peer_correlation(df).toPandas().pivot(index="ts", columns="symbol", values="peer_corr")
    r = pd.DataFrame(data).pct_change()
    for s in data:
        pairs = pd.concat([r[s].rolling(20).corr(r[p]) for p in data if p != s], axis=1).mean(axis=1)
        np.testing.assert_allclose(got[s].to_numpy(), pairs.to_numpy(), rtol=1e-9, equal_nan=True)
    assert rng is not None


def test_calendar_grid_keeps_gaps(spark):
    df = series(spark, [1, 2, 3]).where("ts <> '2020-01-02'").unionByName(series(spark, [5, 6, 7], symbol="B"))
    cal = spark.sql("SELECT explode(sequence(date'2020-01-01', date'2020-01-03')) AS session")
    g = pf.returns(pf.on_grid(df, "calendar", cal))
    assert g.count() == 6
    assert g.where("symbol = 'A' AND ret IS NOT NULL").count() == 0
    assert g.where("symbol = 'B' AND ret IS NOT NULL").count() == 2


def test_volatility_features_need_side_series(spark):
    v = walk(80)
    df = series(spark, v, high=v * 1.01, low=v * 0.99, vix=20.0)
    with_side = pf.volatility_features(df)
    without = pf.volatility_features(df.drop("vix"), vix=None)
    assert "vrp_vix" in with_side.columns and "vrp_vix" not in without.columns
    assert without.where(F.col("rv_term_5_20").isNotNull()).count() == 60


def test_spillover_rejects_non_positive_volatility(spark):
    df = series(spark, [1, 2, 3], volume=1.0).unionByName(series(spark, [2, 3, 4], symbol="B", volume=1.0))
    vix = series(spark, [20, -1, 20], column="vix").drop("symbol")
    with pytest.raises(Exception, match="positive"):
        pf.spillover_features(df, "A", "B", vix).collect()


def test_order_statistics_of_half_blocks_equal_each_frame():
    """Ties, gaps and starts of a series, for frames longer and shorter than it."""
    from barwise.functions.order_statistics import quantiles, shares
    rng = np.random.default_rng(8)
    for n, rows in ((5, 43), (12, 12), (12, 7), (30, 200), (1, 9)):
        x = rng.normal(size=rows).round(1)
        gaps = np.where(rng.random(rows) < 0.1, np.nan, x)
        for values in (x, gaps, np.full(rows, np.nan)):
            frame = pd.Series(values).rolling(n, min_periods=n)
            low, high = quantiles(values, n, [(0.5, n), (0.9, n)])
            np.testing.assert_allclose(low, frame.quantile(0.5), atol=1e-12)
            np.testing.assert_allclose(high, frame.quantile(0.9), atol=1e-12)
            np.testing.assert_allclose(quantiles(values, n, [(0.25, max(1, n // 2))])[0], pd.Series(values).rolling(n, min_periods=max(1, n // 2)).quantile(0.25), atol=1e-12)
            np.testing.assert_allclose(shares(values, n), frame.rank(pct=True), atol=1e-12)


def test_order_statistics_as_columns(spark):
    from barwise.functions.order_statistics import Quantile, Share, with_order_statistics
    rng = np.random.default_rng(9)
    a, b = (rng.normal(size=80).round(2).tolist() for _ in range(2))
    df = series(spark, a, "A").unionByName(series(spark, b, "B")).repartition(3)
    got = with_order_statistics(df, {"mid": Quantile("close", 0.5, 20), "pct": Share("close", 20)})
    assert got.columns == [*df.columns, "mid", "pct"]
    for symbol, values in (("A", a), ("B", b)):
        own = got.where(F.col("symbol") == symbol).orderBy("ts").toPandas()
        np.testing.assert_allclose(own["mid"].astype(float), pd.Series(values).rolling(20).quantile(0.5), atol=1e-12)
        np.testing.assert_allclose(own["pct"].astype(float), pd.Series(values).rolling(20).rank(pct=True), atol=1e-12)
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan
