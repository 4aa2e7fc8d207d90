"""Catalogue search: fits, ledgers and selection against direct calculations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwise.operators import backtest as bt
from barwise.operators import evaluation as ev
from barwise.operators import metrics as mt
from barwise.operators import models, search
from barwise.operators.search import Candidate

FEATURES = ["a", "b", "c"]


def panel(spark, folds=2, symbols=("A", "B"), n=170):
    rng = np.random.default_rng(11)
    parts = []
    for s in symbols:
        for fold in range(1, folds + 1):
            x = rng.normal(size=(n, 3))
            x[rng.random(x.shape) < 0.05] = np.nan
            fwd = rng.normal(0, 0.01, n) + 0.004 * np.nan_to_num(x[:, 0])
            split = np.array(["train"] * 90 + ["val"] * 45 + ["test"] * 35)
            parts.append(pd.DataFrame({"symbol": s, "fold": fold, "split": split, "ts": pd.date_range("2020-01-01", periods=n), **{f: x[:, i] for i, f in enumerate(FEATURES)},
                                       "label": (fwd > 0).astype(float), "fwd_ret": fwd, "scale": rng.uniform(0.2, 1.0, n)}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf)
    return df.withColumns({f: F.when(~F.isnan(f), F.col(f)) for f in FEATURES}), pdf


def candidates():
    out = [Candidate(i, "logistic", c, 0, 0, h, m) for i, (c, h, m) in enumerate([(0.05, 1, None), (0.5, 3, None), (8.0, 5, None), (0.5, 1, (0, 2)), (2.0, 10, (1,)),
                                                                                (20.48, 2, (0, 1)), (0.01, 1, None), (1.0, 20, None), (1.0, 1, (2,)), (4.0, 3, None)])]
    return out + [Candidate(10 + i, "boosting", r, n, d, h, m) for i, (r, n, d, h, m) in enumerate([
        (0.1, 5, 1, 1, None), (0.1, 12, 1, 3, None), (0.1, 12, 2, 3, None), (0.3, 5, 3, 1, None), (0.3, 12, 2, 5, None), (0.05, 12, 3, 1, None),
        (0.1, 5, 2, 2, (0, 1)), (0.2, 12, 1, 1, (2,)), (0.3, 12, 3, 10, None), (0.3, 5, 1, 8, None)])]


def one_tree(x, y, p, depth):
    """Leaf (rows, value) pairs of a tree grown node by node on binned values."""
    edges = [np.unique(np.quantile(c, np.arange(1, search.BINS) / search.BINS)) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)])

    def grow(test, level):
        rest = (y - p)[test]
        best = None
        if level < depth:
            for j in range(x.shape[1]):
                for cut in range(search.BINS - 1):
                    low = codes[j][test] <= cut
                    if min(low.sum(), (~low).sum()) >= search.LEAST_LEAF:
                        gain = rest[low].sum() ** 2 / low.sum() + rest[~low].sum() ** 2 / (~low).sum()
                        if best is None or gain > best[0] + 1e-12:
                            best = gain, j, cut
        if best is None:
            return {"value": rest.sum() / max((p * (1 - p))[test].sum(), 1e-12)}
        _, j, cut = best
        low = codes[j] <= cut
        return {"j": j, "edge": edges[j][cut] if cut < len(edges[j]) else np.inf, "low": grow(test & low, level + 1), "high": grow(test & ~low, level + 1)}
    return grow(np.ones(len(x), bool), 0)


def value(tree, row):
    while "value" not in tree:
        tree = tree["low"] if row[tree["j"]] < tree["edge"] else tree["high"]
    return tree["value"]


def boosted(x, y, new, rate, trees, depth):
    f = np.full(len(x), np.log(y.mean() / (1 - y.mean())))
    g = np.full(len(new), f[0])
    for _ in range(trees):
        tree = one_tree(x, y, 1 / (1 + np.exp(-f)), depth)
        f = f + rate * np.array([value(tree, r) for r in x])
        g = g + rate * np.array([value(tree, r) for r in new])
    return 1 / (1 + np.exp(-g))


@pytest.fixture(scope="module")
def fits(spark):
    """Probabilities of 20 candidates on one window: all at once, and one by one."""
    df, pdf = panel(spark, 1, ("A",))
    train, rows = pdf[pdf.split == "train"], pdf[pdf.split == "val"]
    told = search.probabilities(train[FEATURES].to_numpy(), train["label"].to_numpy(), rows[FEATURES].to_numpy(), candidates())
    return df, train, rows, told


def test_boosted_fits_equal_trees_grown_one_by_one(fits):
    _, train, rows, told = fits
    x, new = search.scaled(train[FEATURES].to_numpy(), rows[FEATURES].to_numpy())
    for c in candidates()[10:]:
        at = list(c.features or range(3))
        np.testing.assert_allclose(told[c.fit], boosted(x[:, at], train["label"].to_numpy(), new[:, at], c.strength, c.trees, c.depth), atol=1e-9)


def test_logistic_fits_equal_the_distributed_ones(spark, fits):
    df, _, rows, told = fits
    for c in candidates()[:10]:
        names = [FEATURES[i] for i in (c.features or range(3))]
        scale, coef = models.fit_logistic(df.where("split = 'train'"), names, "label", ["symbol"], c.strength)
        got = [r.p for r in models.predict_logistic(df.where("split = 'val'"), names, scale, coef, ["symbol"]).orderBy("ts").collect()]
        np.testing.assert_allclose(told[c.fit], got, atol=1e-7)


def test_validation_scores_equal_ledgers_of_each_candidate(spark):
    """20 candidates: threshold and figures against the window jobs, one candidate and threshold at a time."""
    df, pdf = panel(spark, 1, ("A",))
    thresholds = [0.4, 0.5, 0.6]
    every = candidates()
    got = {r.candidate: r for r in search.validation_scores(df, FEATURES, every, thresholds).collect()}
    assert len(got) == len(every)
    train, rows = pdf[pdf.split == "train"], pdf[pdf.split == "val"].sort_values("ts")
    told = search.probabilities(train[FEATURES].to_numpy(), train["label"].to_numpy(), rows[FEATURES].to_numpy(), every)
    for c in every:
        x = spark.createDataFrame(rows[["symbol", "ts", "fwd_ret", "scale"]].assign(p=told[c.fit]))
        x = x.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
        x = x.withColumn("_d", F.when(F.col("p") > F.col("threshold"), 1.0).otherwise(0.0)).withColumn("_w", F.lag("_d").over(bt.Window.partitionBy("threshold").orderBy("ts")))
        led = bt.price(bt.hold_rule(x, "_w", c.hold, ("threshold",)), bt.Execution(), ("threshold",))
        m = {r.threshold: r for r in mt.metric_block(led, ["threshold"]).collect()}
        usable = [t for t in thresholds if m[t].sharpe is not None and m[t].trade_count > 0]
        best = max(usable, key=lambda t: (round(m[t].sharpe, 12), round(m[t].max_dd, 12), -t)) if usable else thresholds[1]
        r = got[c.candidate]
        assert r.threshold == best and r.trades == m[best].trade_count and r.n == 45
        assert r.max_dd == pytest.approx(m[best].max_dd, abs=1e-12)
        assert (r.sharpe is None) == (m[best].sharpe is None)
        if r.sharpe is not None:
            assert r.sharpe == pytest.approx(m[best].sharpe, abs=1e-9)


def test_selection_reads_no_test_rows_and_pools_returns(spark):
    df, pdf = panel(spark)
    every = candidates()
    scores = search.validation_scores(df, FEATURES, every, [0.4, 0.5, 0.6]).cache()
    spoiled = df.withColumn("fwd_ret", F.when(F.col("split") == "test", 9.0).otherwise(F.col("fwd_ret")))
    again = search.validation_scores(spoiled, FEATURES, every, [0.4, 0.5, 0.6])
    assert scores.exceptAll(again).count() == 0
    best = ev.best_candidate(scores, ["symbol", "fold"]).drop("sharpe").join(scores.select("symbol", "fold", "candidate", "threshold"), ["symbol", "fold", "candidate"])
    led = search.chosen_ledger(df, best, FEATURES, every)
    assert led.count() == 4 * 35 and led.select("symbol", "fold", "candidate").distinct().count() == 4
    pooled = {(r.symbol, r.candidate): r for r in search.pooled_sharpe(scores, ["symbol"]).collect()}
    for symbol in "AB":
        own = {r.fold: r for r in scores.where((F.col("symbol") == symbol) & (F.col("candidate") == 0)).collect()}
        nets = []
        for fold, r in own.items():
            w = pdf[(pdf.symbol == symbol) & (pdf.fold == fold)]
            train, rows = w[w.split == "train"], w[w.split == "val"]
            p = search.probabilities(train[FEATURES].to_numpy(), train["label"].to_numpy(), rows[FEATURES].to_numpy(), every[:1])[every[0].fit]
            nets.append(search.ledgers((p > r.threshold).astype(float)[:, None], 1, rows["scale"].to_numpy(), rows["fwd_ret"].to_numpy(), bt.Execution())[0][:, 0])
        whole = np.concatenate(nets)
        assert pooled[symbol, 0].n == len(whole) == 90
        if whole.std() > 0:
            assert pooled[symbol, 0].sharpe == pytest.approx(whole.mean() / whole.std(ddof=1) * np.sqrt(252), abs=1e-9)


def test_catalogue_numbers_the_grids_in_order():
    every = search.catalogue()
    assert len(every) == 48 + 216 + 96 + 1600 and [c.candidate for c in every] == list(range(1960))
    assert every[0] == Candidate(0, "logistic", 0.05, 0, 0, 1) and every[47].hold == 20 and every[47].strength == 8.0
    assert every[48] == Candidate(48, "boosting", 0.01, 50, 1, 3) and every[264].family == "logistic" and every[-1] == Candidate(1959, "boosting", 0.15, 200, 4, 30)
    assert len(search.catalogue([None, (0, 1)])) == 3920


def test_model_rows_stem_from_stored_bars(spark, sf):
    """Fits read a table of bars, not the trades behind them, as often as they like; the bars are the same."""
    from barwise.plans import q_evaluation as qe
    from barwise.sources import views
    assert not [p for p in qe.model_frame(spark, sf).inputFiles() if "lineitem" in p]
    stored, made = qe.stored_bars(spark, sf), views.bars(spark, sf)
    assert stored.count() == made.count() and stored.exceptAll(made).count() == 0


def test_shuffled_features_stem_from_stored_bars(spark, sf, monkeypatch):
    """The permuted rows are read once per column, fold and Newton step, the trades only for the bars."""
    from barwise.plans import q_evaluation as qe
    seen = []

    def fit(train, *_):
        seen.extend(train.inputFiles())
        raise InterruptedError
    monkeypatch.setattr(qe.models, "fit_logistic", fit)
    with pytest.raises(InterruptedError):
        qe.feature_shuffle(spark, sf)
    assert seen and not [p for p in seen if "lineitem" in p]
