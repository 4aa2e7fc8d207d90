"""Backtests, books and metrics: analytic values and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwise.operators import backtest as bt
from barwise.operators import evaluation as ev
from barwise.operators import metrics as mt
from barwise.operators import portfolio as pt
from tests.conftest import series
from tests.test_features import walk


def ledger_of(spark, net):
    return series(spark, net, column="net", gross=0.0, position=1.0, turnover=0.0, cost=0.0)


def test_drawdown_starts_at_initial_capital(spark):
    m = mt.metric_block(ledger_of(spark, [-0.20, 0.0, 0.0])).first()
    assert m.max_dd == pytest.approx(-0.20)
    assert m.hit_rate == 0.0 and m.sortino is not None


def test_metrics_against_numpy(spark):
    r = np.random.default_rng(1).normal(0.001, 0.01, 300)
    m = mt.metric_block(ledger_of(spark, r)).first()
    eq = np.cumprod(1 + r)
    assert m.sharpe == pytest.approx(r.mean() / r.std(ddof=1) * 252 ** 0.5)
    assert m.sortino == pytest.approx(r.mean() / np.sqrt((np.minimum(r, 0) ** 2).mean()) * 252 ** 0.5)
    assert m.cagr == pytest.approx(eq[-1] ** (252 / 300) - 1)
    assert m.max_dd == pytest.approx((eq / np.maximum(1, np.maximum.accumulate(eq)) - 1).min())
    assert m.tail_loss_5pct == pytest.approx(r[r <= np.quantile(r, 0.05)].mean())
    flat = mt.metric_block(ledger_of(spark, [0.0, 0.0, 0.0])).first()
    assert flat.sharpe is None and flat.calmar is None


def signal_frame(spark, n=120, seed=3):
    c = walk(n, seed)
    df = series(spark, c)
    rng = np.random.default_rng(seed)
    s = bt.Rolling()
    return df.withColumns({"ret": s.pct_change("close"), "fwd_ret": s.lead("close") / F.col("close") - 1.0,
                           "signal": F.when(F.rand(7) > 0.5, 0.7).otherwise(0.3)}), rng


def test_position_uses_yesterdays_signal_and_costs_add_up(spark):
    df, _ = signal_frame(spark)
    df = df.withColumn("signal", F.when(F.dayofmonth("ts") % 3 == 0, 0.7).otherwise(0.3))
    p = bt.backtest(df, "signal", threshold=0.5).orderBy("ts").toPandas()
    want = (p.signal > 0.5).astype(float).shift(1)
    np.testing.assert_allclose(p.position, (want * p.scale).clip(-1, 1).fillna(0))
    np.testing.assert_allclose(p.gross - p.net, p.cost, atol=1e-15)
    np.testing.assert_allclose(p.cost, p.turnover * 6 / 10000)
    assert p.turnover.iloc[0] == abs(p.position.iloc[0])
    late = bt.backtest(df, "signal", bt.Execution(delay=2), threshold=0.5).orderBy("ts").toPandas()
    np.testing.assert_allclose(late.staged[2:].to_numpy(dtype=float), p.staged[:-2].to_numpy(dtype=float), equal_nan=True)


def test_hold_rule_first_change_is_free(spark):
    df = series(spark, [1, 0, 1, 0, 0, 0, 1], column="want")
    got = [r.staged for r in bt.hold_rule(df, "want", 3).orderBy("ts").collect()]
    assert got == [1, 1, 1, 0, 0, 0, 1]


def test_leg_switch_is_charged_on_both_sides(spark):
    n = 60
    df = series(spark, [1] * n, column="strength", base_fwd=0.01, other_fwd=0.02).withColumn("strategy", F.lit("s"))
    df = df.withColumn("k", F.dayofyear("ts")).withColumn("leg", F.when(F.col("k") <= 40, "BASE").otherwise("OTHER"))
    df = df.withColumn("risk", F.when(F.col("k") % 2 == 0, 0.001).otherwise(-0.001))
    p = bt.backtest_legs(df, "strength", "leg", {"BASE": "base_fwd", "OTHER": "other_fwd"}, threshold=0.5, risk="risk").orderBy("ts").toPandas()
    i = int(np.flatnonzero(p.held_leg == "OTHER")[0])
    assert i == 41
    assert p.turnover[i] == pytest.approx(abs(p.position[i - 1]) + abs(p.position[i]))
    assert p.gross[i] == pytest.approx(p.position[i] * 0.02)
    with pytest.raises(Exception, match="leg"):
        bt.backtest_legs(df.withColumn("leg", F.lit("X")), "strength", "leg", {"BASE": "base_fwd"}, threshold=0.5, risk="risk").collect()


def test_execution_settings_are_checked():
    with pytest.raises(ValueError):
        bt.Execution(delay=-1)
    with pytest.raises(ValueError):
        bt.Execution(fee_bps=float("nan"))


def ramp(spark, n=100):
    return spark.createDataFrame([(f"S{i:03d}", pd.Timestamp("2024-01-03").to_pydatetime(), float(i), f"sec{i % 10}") for i in range(n)],
                                 "symbol string, ts timestamp, signal double, sector string")


def test_decile_book_on_a_ramp(spark):
    w = {r.symbol: r.w for r in pt.decile_book(ramp(spark), max_weight=0.05, sector_gross=9, sector_net=9).collect()}
    assert sum(v > 0 for v in w.values()) == 10 and sum(v < 0 for v in w.values()) == 10
    assert w["S000"] == pytest.approx(0.05) and w["S099"] == pytest.approx(-0.05)
    flipped = {r.symbol: r.w for r in pt.decile_book(ramp(spark), long_low=False, max_weight=0.05, sector_gross=9, sector_net=9).collect()}
    assert flipped["S099"] > 0 > flipped["S000"]
    assert all(r.w == 0 for r in pt.decile_book(ramp(spark, 15)).collect())


def weekly(spark, n=220, symbols=6, seed=5):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2020-01-01", periods=n)
    rows = []
    for i in range(symbols):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for t, v in zip(days, c):
            rows.append((f"S{i}", t.to_pydatetime(), float(v), float(rng.normal()), ["equity", "fixed_income"][i % 2], float(rng.uniform(10, 90))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double, signal double, asset_class string, vix double")


def test_weekly_books_keep_their_limits(spark):
    df = weekly(spark)
    book = pt.inverse_vol_book(df, min_assets=4)
    audit = pt.limit_audit(book, {"max_abs_weight": 0.15, "max_gross": 0.5, "max_class_gross": 0.4, "max_abs_net": 0.2}, "equity").first()
    assert audit.passed and audit.max_gross > 0
    caps = {"equity": 0.2, "fixed_income": 0.15}
    mag = pt.magnitude_book(df, class_caps=caps, min_assets=4)
    audit = pt.limit_audit(mag, {"max_abs_weight": 0.12, "max_gross": 1.0, "max_class_gross": 0.2, "max_abs_net": 0.4}).first()
    assert audit.passed and audit.max_gross > 0


def test_two_state_turnover_rule_equals_a_loop(spark):
    df = weekly(spark, 400, seed=11)
    caps = {"equity": 0.3, "fixed_income": 0.3}
    free = pt.magnitude_book(df, class_caps=caps, min_assets=4, turnover_cap=1e9)
    got = pt.magnitude_book(df, class_caps=caps, min_assets=4, turnover_cap=8.0)
    wide = lambda b: b.where(F.weekday("ts") == 2).toPandas().pivot(index="ts", columns="symbol", values="w").sort_index()
    raw, have = wide(free), wide(got)
    prev, want, cuts = np.zeros(raw.shape[1]), [], 0
    for row in raw.to_numpy():
        if 26 * np.abs(row - prev).sum() > 8.0:
            row, cuts = row * 0.7, cuts + 1
        want.append(row)
        prev = row
    assert 0 < cuts < len(want)
    np.testing.assert_allclose(have.to_numpy(), np.array(want), atol=1e-12)


@pytest.mark.parametrize("block", [256, 7])
def test_turnover_control_equals_a_loop(spark, block):
    rng = np.random.default_rng(4)
    n = 40
    m = rng.normal(0, 0.1, (n, 3))
    m[10:20] = m[10]
    days = pd.date_range("2024-01-01", periods=n)
    rows = [("s", f"S{j}", days[i].to_pydatetime(), float(m[i, j])) for i in range(n) for j in range(3)]
    df = spark.createDataFrame(rows, "strategy string, symbol string, ts timestamp, w double")
    got = pt.turnover_control(df, 0.2, block=block).toPandas().pivot(index="ts", columns="symbol", values="w").to_numpy()
    prev, want = np.zeros(3), []
    for row in m:
        d = np.abs(row - prev).sum()
        prev = prev + (row - prev) * (0.2 / d) if d > 0.2 else row
        want.append(prev)
    np.testing.assert_allclose(got, np.array(want), atol=1e-12)


def test_turnover_control_carries_symbols_and_strategies_without_rows(spark):
    """B has no row in the second block and strategy t none in the first; both books are carried."""
    d = [f"2024-01-0{i}" for i in range(1, 7)]
    rows = [("s", "A", d[0], 0.4), ("s", "B", d[0], 0.4), ("s", "A", d[2], 0.4), ("s", "A", d[4], 0.4), ("s", "B", d[5], 0.4), ("t", "A", d[3], 0.1), ("t", "A", d[1], 0.5)]
    df = spark.createDataFrame(rows, "strategy string, symbol string, ts string, w double").withColumn("ts", F.col("ts").cast("timestamp"))
    for block in (1, 2, 100):
        got = {(r.strategy, r.symbol, str(r.ts)[:10]): round(r.w, 9) for r in pt.turnover_control(df, 0.2, block=block).collect()}
        assert got == {("s", "A", d[0]): 0.1, ("s", "B", d[0]): 0.1, ("s", "A", d[2]): 0.3, ("s", "A", d[4]): 0.4, ("s", "B", d[5]): 0.3,
                       ("t", "A", d[1]): 0.2, ("t", "A", d[3]): 0.1}
    assert pt.turnover_control(df.limit(0)).count() == 0


def test_drawdown_state_has_hysteresis(spark):
    df = series(spark, [-0.12, 0.02, 0.05, 0.05, 0.0], column="ret", one=1.0)
    got = [r.state for r in pt.drawdown_control(df, "ret", "one").orderBy("ts").collect()]
    assert got == [1.0, 0.5, 0.5, 0.5, 1.0]


def test_book_returns_lag_one_session(spark):
    df = series(spark, [100, 110, 121, 133.1])
    w = df.select("symbol", "ts", F.when(F.dayofmonth("ts") == 1, 1.0).otherwise(1.0).alias("w"))
    p = bt.portfolio_returns(w, df).orderBy("ts").toPandas()
    np.testing.assert_allclose(p.gross, [0, 0.1, 0.1, 0.0], atol=1e-12)
    np.testing.assert_allclose(p.turnover, [0, 1, 0, 0])


def test_fold_plan_layout():
    plan = ev.fold_plan(100, ev.FoldConfig(train=40, val=10, test=10, step=10, purge=2, embargo=3))
    assert plan[0] == dict(fold=1, train_lo=0, train_hi=40, val_lo=42, val_hi=52, test_lo=55, test_hi=65)
    assert len(plan) == 4 and plan[-1]["test_hi"] == 95
    rolling = ev.fold_plan(100, ev.FoldConfig(40, 10, 10, 10, 2, 3, expanding=False))
    assert rolling[1]["train_hi"] - rolling[1]["train_lo"] == 40
    with pytest.raises(ValueError):
        ev.fold_plan(50, ev.FoldConfig(40, 10, 10, 10))
    with pytest.raises(ValueError):
        ev.FoldConfig(step=300, test=252)


def test_candidate_catalogue_counts():
    groups = [{"hold": [1, 5], "c": [0.1, 1.0, 10.0]}, {"rate": [0.1], "trees": [50, 100]}]
    rows = ev.candidate_catalogue(groups)
    assert len(rows) == 8 and rows[0] == {"candidate": 0, "hold": 1, "c": 0.1} and rows[7]["trees"] == 100


def test_hold_rule_equals_the_walk(spark):
    import random
    rng = random.Random(3)
    for hold in (1, 2, 5):
        wish = [rng.choice([None, 0.0, 1.0, 1.0, -1.0]) for _ in range(120)]
        df = spark.createDataFrame([("A", i, v) for i, v in enumerate(wish)] + [("B", i, 0.0) for i in range(3)], "symbol string, ts int, want double")
        got = [r.staged for r in bt.hold_rule(df, "want", hold).where("symbol = 'A'").orderBy("ts").collect()]
        current, last, want = 0.0, -hold, []
        for i, v in enumerate(0.0 if v is None else v for v in wish):
            if v != current and i - last >= hold:
                current, last = v, i
            want.append(current)
        assert got == want


def test_missing_outcome_inside_a_series_is_rejected(spark):
    rows = [("A", i, 1.0, 1.0, v) for i, v in enumerate([None, 0.01, None, 0.02, None])]
    df = spark.createDataFrame(rows, "symbol string, ts int, staged double, scale double, fwd_ret double")
    with pytest.raises(Exception, match="no finite outcome"):
        bt.price(df, bt.Execution()).collect()
    assert bt.price(df.where("ts <> 2"), bt.Execution()).count() == 4
