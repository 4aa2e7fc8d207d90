"""Normal distribution, resampling, multiple testing and fitted models."""

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.functions import scoring
from barwise.functions.normal import norm_cdf, norm_ppf
from barwise.operators import governance as gov
from barwise.operators import models
from barwise.operators import statistics as st
from tests.conftest import series

N = NormalDist()


def test_normal_functions(spark):
    xs = [-8.0, -3.0, -0.6, 0.0, 0.3, 0.7, 2.5, 6.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("c")).collect():
        assert r.c == pytest.approx(0.5 * math.erfc(-r.x / 2 ** 0.5), rel=1e-13)
    ps = [1e-10, 0.001, 0.07, 0.08, 0.5, 0.93, 0.999]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", norm_ppf(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(N.inv_cdf(r.p), abs=1e-12)
    assert spark.range(1).select(norm_ppf(F.lit(0.0)).alias("z")).first().z is None


def test_adjusted_pvalues(spark):
    df = spark.createDataFrame([("f", f"t{i}", p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "family string, t string, p double")
    got = {r.t: r for r in st.adjust_pvalues(df, "p", ("family",), "t").collect()}
    assert got["t0"].bonferroni == pytest.approx(0.04)
    assert [got[f"t{i}"].holm for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert [got[f"t{i}"].bh for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_deflated_sharpe_follows_the_formula(spark):
    row = spark.range(1).select(
        st.expected_max_sharpe(F.lit(48), F.lit(500)).alias("e"), st.expected_max_sharpe(F.lit(1), F.lit(500)).alias("one"),
        st.deflated_sharpe_pvalue(F.lit(1.5), F.lit(48), F.lit(500), F.lit(-0.3), F.lit(4.0)).alias("p")).first()
    g = 0.5772156649015329
    z = (1 - g) * N.inv_cdf(1 - 1 / 48) + g * N.inv_cdf(1 - 1 / (48 * math.e))
    assert row.e == pytest.approx(z / 499 ** 0.5) and row.one == 0.0
    sr = 1.5 / 252 ** 0.5
    term = 1 + 0.3 * sr + 0.75 * sr * sr
    t = 499 ** 0.5 * (sr - (term / 499) ** 0.5 * z) / term ** 0.5
    assert row.p == pytest.approx(1 - N.cdf(t), abs=1e-12)


def test_bootstrap_equals_expanded_blocks(spark):
    r = np.random.default_rng(2).normal(0.001, 0.01, 95)
    df = series(spark, r, column="net")
    got = {x.b: x.sharpe for x in st.bootstrap_sharpe(df, n_boot=6, block=20, seed=1).collect()}
    m = 1_000_003

    def mix(b, k):
        x = (1 * 1_299_709 % m + b * 7_919 + k * 104_729) % m
        y = (x * x + x * 31 + 17) % m
        return (y * y + y * 101 + x) % m
    for b in range(6):
        s = np.concatenate([r[(v := mix(b, k) % 76):v + 20] for k in range(5)])[:95]
        assert got[b] == pytest.approx(s.mean() / s.std(ddof=1) * 252 ** 0.5, rel=1e-9)


def test_permutation_keeps_values_and_missing_rows(spark):
    v = [1.0, 2.0, None, 4.0, 5.0, 6.0]
    df = series(spark, v, column="x")
    out = st.permute(df, ["x"], 3).toPandas()
    for _, g in out.groupby("run"):
        g = g.sort_values("ts")
        assert np.isnan(g.x.iloc[2]) and sorted(g.x.dropna()) == [1, 2, 4, 5, 6]
    assert out.groupby("run").x.apply(lambda s: tuple(s.fillna(-1))).nunique() > 1


def test_placebo_statistics(spark):
    null = spark.createDataFrame([("A", float(i)) for i in range(19)], "symbol string, sharpe double")
    obs = spark.createDataFrame([("A", 17.5)], "symbol string, sharpe double")
    r = st.placebo_statistics(null, obs).first()
    assert r.percentile == pytest.approx(18 / 19) and r.adjusted_p == pytest.approx(2 / 20)


def test_ranks_name_every_half_once(spark):
    for n in (4, 7, 10):
        masks = [r.m for r in spark.range(math.comb(n, n // 2)).select(st.half_mask(F.col("id"), n).alias("m")).collect()]
        assert sorted(masks) == sorted(sum(1 << f for f in c) for c in combinations(range(n), n // 2))
    last = spark.range(1).select(st.half_mask(F.lit(math.comb(24, 12) - 1), 24).alias("m")).first().m
    assert last == sum(1 << f for f in range(12, 24))


def test_overfitting_counts_every_half_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(st, "SPLITS_PER_ROW", 50)
    rng = np.random.default_rng(6)
    scores = {k: rng.normal(size=(5, 9)).round(1) for k in "ab"}
    rows = [(k, v, f, float(x[v, f])) for k, x in scores.items() for v in range(5) for f in range(9)]
    got = {r.key: r for r in st.overfitting_probability(spark.createDataFrame(rows, "key string, variant int, fold_no int, sharpe double"), 9, keys=("key",)).collect()}
    for k, x in scores.items():
        bad = 0
        for half in combinations(range(9), 4):
            rest = [f for f in range(9) if f not in half]
            ins, oos = x[:, list(half)].sum(axis=1) / 4, x[:, rest].sum(axis=1) / 5
            best = max(range(5), key=lambda v: (ins[v], -v))
            bad += sum(o > oos[best] for o in oos) / 4 >= 0.5
        assert got[k].n_splits == 126 and got[k].pbo == pytest.approx(bad / 126, abs=2 / 126)


def test_many_folds_need_no_list_of_halves(spark):
    rows = [(v, f, float(v + (f % 3) * 0.1)) for v in range(2) for f in range(16)]
    df = st.overfitting_probability(spark.createDataFrame(rows, "variant int, fold_no int, sharpe double"), 16)
    assert "65280" not in df._jdf.queryExecution().toString()
    r = df.first()
    assert r.n_splits == math.comb(16, 8) and r.pbo == 0.0


def test_prefix_scan_equals_a_walk(spark):
    from barwise.functions.scan import prefix
    rng = np.random.default_rng(7)
    rows = [(k, i, float(rng.integers(0, 50)) if rng.random() > 0.2 else None) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "k string, seq int, v double").repartition(5)
    for width in (7, 1000):
        got = prefix(df, ["k"], "seq", {"hi": ("v", "max"), "lo": ("v", "min"), "total": ("v", "sum")}, width)
        assert got.columns == ["k", "seq", "v", "hi", "lo", "total"]
        for r in got.collect():
            before = [v for k, i, v in rows if k == r.k and i < r.seq and v is not None]
            assert (r.hi, r.lo, r.total) == ((max(before), min(before), sum(before)) if before else (None, None, None))


def test_overfitting_extremes(spark):
    rows = [(v, f, float(v)) for v in range(4) for f in range(4)]
    best = st.overfitting_probability(spark.createDataFrame(rows, "variant int, fold_no int, sharpe double"), 4).first()
    assert best.pbo == 0.0 and best.n_splits == 6
    few = st.overfitting_probability(spark.createDataFrame(rows, "variant int, fold_no int, sharpe double"), 3).first()
    assert few.pbo is None


def test_logistic_matches_newton_and_ignores_test_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) * [1, 5] + [0, 3]
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.2 * x[:, 1] + 0.3)))).astype(int)
    rows = [("g", float(a), float(b), int(c)) for (a, b), c in zip(x, y)]
    df = spark.createDataFrame(rows, "g string, a double, b double, label int")
    scale, coef = models.fit_logistic(df, ["a", "b"], "label", ["g"])
    z = np.column_stack([np.ones(300), (x - x.mean(0)) / x.std(0)])
    b = np.zeros(3)
    ridge = np.array([0, 1, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ b))
        b += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * b)
    np.testing.assert_allclose(coef.first()["_b"], b, rtol=1e-6)
    test = spark.createDataFrame([("g", 0.5, None)], "g string, a double, b double")
    p = models.predict_logistic(test, ["a", "b"], scale, coef, ["g"]).first().p
    assert 0 < p < 1


def test_gates_never_pass_on_unknown_evidence(spark):
    base = dict(experiment="e", median_sharpe=1.0, mean_sharpe=1.0, full_max_dd=-0.1, survives_cost=True, survives_delay=True,
                positive_prob=0.9, percentile=1.0, adjusted_p=0.04, placebo_runs=20, single_fold_share=0.3, annual_turnover=5.0,
                integrity_ok=True, lookahead_ok=True, trials=1, family_searches=1)
    ok = gov.decide(gov.gate_checks(spark.createDataFrame([base]))).first()
    assert ok.decision == "CANDIDATE" and ok.failed_gates == ""
    df = spark.createDataFrame([base]).withColumn("adjusted_p", F.lit(None).cast("double"))
    assert gov.decide(gov.gate_checks(df)).first().failed_gates == "placebo_separates"
    strict = gov.GateConfig(correction="bonferroni_family", max_family_searches=5)
    none = spark.createDataFrame([{**base, "family_searches": 0}])
    assert "family_history_mandatory" in gov.decide(gov.gate_checks(none, strict)).first().failed_gates
    many = spark.createDataFrame([{**base, "family_searches": 4}])
    assert "family_selection_corrected" in gov.decide(gov.gate_checks(many, strict)).first().failed_gates


def test_text_scoring_checks_inputs(spark):
    def loader():
        return lambda texts: [(0.5, float(len(t))) for t in texts]
    df = spark.createDataFrame([(1, "abc"), (2, "hello")], "id int, text string")
    got = {r.id: r.confidence for r in scoring.score_texts(df, "text", loader, "m", batch=1).collect()}
    assert got == {1: 3.0, 2: 5.0}
    with pytest.raises(Exception, match="empty"):
        scoring.score_texts(df.unionByName(spark.createDataFrame([(3, " ")], "id int, text string")), "text", loader, "m").collect()


def test_allocator_bounds(spark):
    df = series(spark, [0.01, 0.02, -0.01], column="ret").withColumn("fold", F.lit(1))
    with pytest.raises(Exception, match="bounds"):
        scoring.allocate(df, ["fold"], ["A"], lambda m: {"A": 2.0}).collect()


def test_exact_quantile_equals_numpy(spark):
    from barwise.operators.metrics import exact_quantile
    rng = np.random.default_rng(3)
    values = [*rng.lognormal(size=200), 0.0, 0.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([("A", float(v)) for v in values] + [("B", 2.0), ("C", None)], "k string, v double")
    for q in (0.0, 0.05, 0.5, 0.731, 1.0):
        got = {r["k"]: (r["quantile"], r["n"]) for r in exact_quantile(df, "v", q, ["k"]).collect()}
        assert got["A"] == (pytest.approx(np.quantile(values, q)), 205) and got["B"] == (2.0, 1) and "C" not in got


def test_worlds_differ_only_after_the_split(spark):
    from barwise.operators import evaluation as ev
    df = series(spark, [1.0, 2.0, 3.0, 4.0]).withColumn("volume", F.lit(5.0))
    split = F.lit("2020-01-03").cast("timestamp")
    x = ev.worlds_of(df, F.col("ts") >= split, {"price": {"close": F.col("close") * 10}, "volume": {"volume": F.lit(0.0)}})
    got = {(r.world, r.ts.day): (r.close, r.volume) for r in x.collect()}
    assert len(got) == 12 and got["base", 4] == got["price", 2][:0] + (4.0, 5.0)
    assert got["price", 3] == (30.0, 5.0) and got["price", 2] == (2.0, 5.0) and got["volume", 4] == (4.0, 0.0)


def test_the_audit_finds_a_feature_that_reads_the_future(spark):
    from barwise.functions.rolling import Rolling
    from barwise.operators import evaluation as ev
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 5.0], "A").unionByName(series(spark, [2.0, 2.0, 1.0, 4.0, 7.0], "B"))
    s = Rolling(("world", "symbol"))
    build = lambda rows: rows.withColumns({"past": s.lag("close"), "future": s.lead("close", 2)})
    split = F.lit("2020-01-04").cast("timestamp")
    worlds = {"price": {"close": F.col("close") + 1.0}, "other": {"close": F.when(F.col("symbol") == "B", 0.0).otherwise(F.col("close"))}}
    got = {(r.dimension, r.feature): (r.checked_rows, r.n_changed, r.passed) for r in ev.leakage_audit(df, build, ["past", "future"], split, worlds).collect()}
    assert got == {("price", "past"): (6, 0, True), ("other", "past"): (6, 0, True), ("price", "future"): (6, 4, False), ("other", "future"): (6, 2, False)}
