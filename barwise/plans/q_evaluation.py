"""Walk-forward evaluation, search, stress and placebo checked against SQL (WF, RB, PL, AG-14/23/24, SR-4..6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.rolling import Rolling
from barwise.operators import backtest as bt
from barwise.operators import evaluation as ev
from barwise.operators import metrics as mt
from barwise.operators import models
from barwise.operators import portfolio as pt
from barwise.operators import price_features as pf
from barwise.operators import search
from barwise.operators.information import INFO_FEATURES, information_features
from barwise.operators import statistics as st
from barwise.plans import q_books, q_windows
from barwise.plans.catalogue import DAY, _win, out, query, s_lag, sel, sql, stages
from barwise.plans.q_backtest import S_SHARPE, SIGNAL_STAGES, momentum_ledger, path_ctes, signals
from barwise.plans.q_windows import BASE_STAGES, LIQ_STAGES, RET, grid_bars
from barwise.session import ensure_checkpoint_dir
from barwise.sources import files, views

S = Rolling()
CFG = ev.FoldConfig(train=300, val=150, test=150, step=150, purge=5, embargo=5)
THRESHOLDS = [0.45, 0.50, 0.55, 0.60]

PLAN_CTE = """np AS (SELECT count(DISTINCT ts) AS n FROM bars),
plan AS (SELECT i + 1 AS fold, 0 AS train_lo, 300 + 150 * i AS train_hi, 305 + 150 * i AS val_lo, 455 + 150 * i AS val_hi, 460 + 150 * i AS test_lo, 610 + 150 * i AS test_hi
  FROM (SELECT unnest(range((n - 610) // 150 + 1)) AS i FROM np))"""
VOL_SQL = (f"CASE WHEN count(ret) {_win(20, 1)} = 20 THEN stddev_samp(ret) {_win(20, 1)} END")
SCALE_SQL = f"coalesce(CASE WHEN ({VOL_SQL}) <> 0 THEN least(0.10 / (({VOL_SQL}) * sqrt(252.0)), 1.0) END, 0.0)"
EVAL_CTE = stages("bars", {**SIGNAL_STAGES[0], "mom": f"close / {s_lag('close', 20)} - 1", "mom5": f"close / {s_lag('close', 5)} - 1"},
                  {"scale": SCALE_SQL, "p": "1 / (1 + exp(-20 * mom))", "sno": "dense_rank() OVER (ORDER BY ts) - 1"}, name="e") + ",\n" + PLAN_CTE + """,
lab AS (SELECT e2.*, fold, 'train' AS split FROM e2 JOIN plan ON sno >= train_lo AND sno < train_hi UNION ALL
  SELECT e2.*, fold, 'val' FROM e2 JOIN plan ON sno >= val_lo AND sno < val_hi UNION ALL
  SELECT e2.*, fold, 'test' FROM e2 JOIN plan ON sno >= test_lo AND sno < test_hi)"""


def fled(src, keys, name="led"):
    order = f"OVER (PARTITION BY {keys} ORDER BY ts)"
    return f"""{name}0 AS (SELECT *, lag(dir) {order} AS staged FROM {src}),
{name}1 AS (SELECT *, CASE WHEN staged IS NULL THEN 0.0 ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, staged * scale)) END AS position FROM {name}0),
{name}2 AS (SELECT *, position * coalesce(fwd_ret, 0) AS gross, abs(position - coalesce(lag(position) {order}, 0)) AS turnover FROM {name}1),
{name} AS (SELECT *, turnover * 6 / 10000.0 AS cost, gross - turnover * 6 / 10000.0 AS net FROM {name}2)"""


def plan_of(bars):
    return ev.fold_plan(bars.select("ts").distinct().count(), CFG)


def frame(spark, sf):
    """Bars with returns, features, causal scale and global session number."""
    b = views.bars(spark, sf)
    x = signals(spark, sf, b).withColumns({"mom": S.pct_change("close", 20), "mom5": S.pct_change("close", 5)})
    x = x.withColumns({"scale": bt.vol_scale("ret", bt.Execution(), S), "p": 1.0 / (1.0 + F.exp(-20.0 * F.col("mom")))})
    return pt.session_index(x), plan_of(b)


@query("wf_01_fold_table", sql("SELECT * FROM plan", "bars", ctes=PLAN_CTE))
def fold_table(spark, sf):
    rows = plan_of(views.bars(spark, sf))
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} long" for k in rows[0]))


@query("jn_11_fold_labels", sql("SELECT symbol, fold, split, count(*) AS n_rows, strftime(min(ts), '%Y-%m-%d') AS first, "
                                "strftime(max(ts), '%Y-%m-%d') AS last FROM lab GROUP BY 1, 2, 3", "bars", ctes=EVAL_CTE))
def fold_labels(spark, sf):
    x, plan = frame(spark, sf)
    return ev.label_folds(x, plan).groupBy("symbol", "fold", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), views.day(F.min("ts")).alias("first"), views.day(F.max("ts")).alias("last"))


@query("wf_02_locked_test", sql("SELECT fold, count(DISTINCT ts) AS n_test, sha256(string_agg(DISTINCT strftime(ts, '%Y-%m-%d'), ',' ORDER BY strftime(ts, '%Y-%m-%d'))) AS test_hash "
                                "FROM lab WHERE split = 'test' GROUP BY 1", "bars", ctes=EVAL_CTE))
def locked_test(spark, sf):
    x, plan = frame(spark, sf)
    return ev.freeze_test(ev.label_folds(x, plan), "view", "cfg").select("fold", F.col("n_test").cast("long").alias("n_test"), "test_hash")


@query("wf_02_lock_violations", sql("SELECT fold, CASE WHEN fold = 2 THEN 'test_membership' ELSE 'dataset' END AS violation FROM plan WHERE fold IN (2, 3)", "bars", ctes=PLAN_CTE))
def lock_violations(spark, sf):
    """A session is dropped from fold 2 and fold 3 claims another data set; both must surface."""
    x, plan = frame(spark, sf)
    lab = ev.label_folds(x, plan)
    lock = ev.freeze_test(lab, "view", "cfg")
    first = lab.where("fold = 2 AND split = 'test'").agg(F.min("session_no")).scalar()
    now = ev.freeze_test(lab.withColumn("_drop", first).where(~((F.col("fold") == 2) & (F.col("session_no") == F.col("_drop")))), "view", "cfg")
    now = now.withColumn("dataset_id", F.when(F.col("fold") == 3, "other").otherwise(F.col("dataset_id")))
    return ev.verify_test(lock, now)


# ---- thresholds and one continuous out-of-sample ledger ------------------------------

THR = ", ".join(f"({t})" for t in THRESHOLDS)
WF_CTE = EVAL_CTE + f""",
thr(threshold) AS (VALUES {THR}),
vt AS (SELECT lab.*, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN p > threshold THEN 1.0 ELSE 0.0 END AS dir FROM lab CROSS JOIN thr WHERE split = 'val'),
""" + fled("vt", "symbol, fold, threshold", "vl") + ",\n" + path_ctes("vl", "symbol, fold, threshold", name="vm") + f""",
vs AS (SELECT symbol, fold, threshold, {S_SHARPE('net')} AS sharpe, min(dd) AS max_dd, count(*) FILTER (WHERE turnover > 1e-9) AS trades FROM vm GROUP BY 1, 2, 3),
vr AS (SELECT symbol, fold, threshold, row_number() OVER (PARTITION BY symbol, fold ORDER BY round(sharpe, 12) DESC, round(max_dd, 12) DESC, threshold) AS rk FROM vs WHERE sharpe IS NOT NULL AND trades > 0),
bestt AS (SELECT k.symbol, k.fold, coalesce(vr.threshold, 0.55) AS threshold FROM (SELECT DISTINCT symbol, fold FROM vs) k LEFT JOIN vr ON vr.symbol = k.symbol AND vr.fold = k.fold AND rk = 1),
ot AS (SELECT lab.*, threshold, CASE WHEN p > threshold THEN 1.0 ELSE 0.0 END AS dir FROM lab JOIN bestt USING (symbol, fold) WHERE split = 'test'),
""" + fled("ot", "symbol", "ol") + ",\n" + path_ctes("ol", "symbol, fold", name="om") + f""",
fm AS (SELECT symbol, fold, {S_SHARPE('net')} AS sharpe, min(dd) AS max_dd, count(*) FILTER (WHERE turnover > 1e-9) AS trade_count, product(1 + net) - 1 AS net_return FROM om GROUP BY 1, 2)"""


def walk_forward(spark, sf):
    """(thresholds, one out-of-sample ledger per symbol across folds)."""
    x, plan = frame(spark, sf)
    lab = ev.label_folds(x, plan, splits=("val", "test"))
    chosen = ev.choose_threshold(lab.where("split = 'val'"), THRESHOLDS, ["symbol", "fold"])
    test = lab.where("split = 'test'").join(chosen, ["symbol", "fold"])
    test = test.withColumn("dir", F.when(F.col("p") > F.col("threshold"), 1.0).otherwise(0.0))
    return chosen, ev.ledger(test, ["symbol"])


@query("sr_04_best_threshold", sql("SELECT symbol, fold, CAST(threshold AS DOUBLE) AS threshold FROM bestt", "bars", ctes=WF_CTE))
def best_threshold(spark, sf):
    return walk_forward(spark, sf)[0]


@query("wf_04_walk_forward_ledger", sql(sel("ol", ["symbol", "fold", DAY], ["position", "gross", "net"], 8), "bars", ctes=WF_CTE))
def walk_forward_ledger(spark, sf):
    x = walk_forward(spark, sf)[1].withColumn("session", views.day())
    return out(x, "symbol", "fold", "session", r=["position", "gross", "net"], digits=8)


def fold_metrics(led, keys=("symbol", "fold")):
    return mt.with_path(led, list(keys)).groupBy(*keys).agg(
        mt.sharpe("net").alias("sharpe"), F.min("drawdown").alias("max_dd"), F.count_if(F.col("turnover") > 1e-9).alias("trade_count"),
        mt.total_return("net").alias("net_return"))


@query("ag_14_experiment_summary", sql("""SELECT symbol, round(avg(sharpe), 6) + 0.0 AS mean_sharpe, round(quantile_cont(sharpe, 0.5), 6) + 0.0 AS median_sharpe,
  round(min(max_dd), 6) + 0.0 AS worst_dd, CAST(sum(trade_count) AS BIGINT) AS trades, count(*) FILTER (WHERE sharpe > 0) AS positive_folds, count(*) AS n_folds,
  round(max(greatest(coalesce(sharpe, 0), 0)) / nullif(sum(greatest(coalesce(sharpe, 0), 0)), 0), 6) + 0.0 AS single_fold_share FROM fm GROUP BY symbol""", "bars", ctes=WF_CTE))
def experiment_summary(spark, sf):
    x = ev.summarise_folds(fold_metrics(walk_forward(spark, sf)[1]), ["symbol"])
    return out(x, "symbol", "trades", "positive_folds", "n_folds", r=["mean_sharpe", "median_sharpe", "worst_dd", "single_fold_share"])


# ---- candidate search -------------------------------------------------------------------

CAND_CTE = EVAL_CTE + """,
cd AS (SELECT lab.*, candidate, CASE candidate WHEN 0 THEN sign(mom) WHEN 1 THEN -sign(mom) WHEN 2 THEN sign(mom5) ELSE -sign(mom5) END AS dir
  FROM lab CROSS JOIN (VALUES (0), (1), (2), (3)) c(candidate)),
""" + fled("(SELECT * FROM cd WHERE split <> 'train')", "symbol, fold, split, candidate", "cl") + f""",
cs AS (SELECT symbol, fold, candidate, {S_SHARPE('net')} AS sharpe FROM cl WHERE split = 'val' GROUP BY 1, 2, 3),
cb AS (SELECT symbol, fold, candidate, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY (sharpe IS NULL), round(coalesce(sharpe, 0), 12) DESC, candidate) AS rk FROM cs) WHERE rk = 1),
tw AS (SELECT cl.* FROM cl JOIN cb USING (symbol, fold, candidate) WHERE split = 'test'),
tl AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS to2 FROM tw),
ps AS (SELECT symbol, candidate, {S_SHARPE('net')} AS sharpe FROM cl WHERE split = 'val' AND fold < (SELECT max(fold) FROM plan) GROUP BY 1, 2),
pw AS (SELECT symbol, candidate, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY (sharpe IS NULL), round(coalesce(sharpe, 0), 12) DESC, candidate) AS rk FROM ps) WHERE rk = 1)"""


def candidates(x):
    """The candidate axis as exploded literal directions."""
    d = [F.signum("mom"), -F.signum("mom"), F.signum("mom5"), -F.signum("mom5")]
    cells = F.array(*[F.struct(F.lit(i).alias("candidate"), c.alias("dir")) for i, c in enumerate(d)])
    return x.withColumn("_c", F.explode(cells)).withColumns({"candidate": F.col("_c.candidate"), "dir": F.col("_c.dir")}).drop("_c")


def candidate_ledger(spark, sf):
    x, plan = frame(spark, sf)
    lab = ev.label_folds(x, plan, splits=("val", "test"))
    return ev.ledger(candidates(lab), ["symbol", "fold", "split", "candidate"]), plan


def candidate_scores(led, keys):
    return led.groupBy(*keys, "candidate").agg(mt.sharpe("net").alias("sharpe"))


@query("sr_05_best_candidate_per_fold", sql("SELECT symbol, fold, candidate, round(sharpe, 6) + 0.0 AS sharpe FROM cb", "bars", ctes=CAND_CTE))
def best_per_fold(spark, sf):
    led, _ = candidate_ledger(spark, sf)
    x = ev.best_candidate(candidate_scores(led.where("split = 'val'"), ["symbol", "fold"]), ["symbol", "fold"])
    return out(x, "symbol", "fold", "candidate", r=["sharpe"])


@query("wf_05_nested_discovery", sql(f"SELECT symbol, fold, candidate, {DAY}, round(position, 8) + 0.0 AS position, round(to2, 8) + 0.0 AS turnover, "
                                     "round(gross - to2 * 6 / 10000.0, 8) + 0.0 AS net FROM tl", "bars", ctes=CAND_CTE))
def nested_discovery(spark, sf):
    """Each fold trades its own validation winner; turnover is recomputed on the merged path."""
    led, _ = candidate_ledger(spark, sf)
    best = ev.best_candidate(candidate_scores(led.where("split = 'val'"), ["symbol", "fold"]), ["symbol", "fold"]).drop("sharpe")
    path = led.where("split = 'test'").join(best, ["symbol", "fold", "candidate"])
    path = path.withColumn("turnover", F.abs(F.col("position") - F.coalesce(S.lag("position"), F.lit(0.0))))
    x = bt.charge(path, 5.0, 1.0).withColumn("session", views.day())
    return out(x, "symbol", "fold", "candidate", "session", r=["position", "turnover", "net"], digits=8)


@query("sr_06_campaign_winner", sql("SELECT symbol, candidate, round(sharpe, 6) + 0.0 AS sharpe FROM pw", "bars", ctes=CAND_CTE))
def campaign_winner(spark, sf):
    led, plan = candidate_ledger(spark, sf)
    dev = led.where((F.col("split") == "val") & (F.col("fold") < len(plan)))
    return out(ev.best_candidate(candidate_scores(dev, ["symbol"]), ["symbol"]), "symbol", "candidate", r=["sharpe"])


@query("wf_07_search_and_confirm", sql(f"SELECT symbol, candidate, count(*) AS n_obs, round({S_SHARPE('net')}, 6) + 0.0 AS sharpe, round(product(1 + net) - 1, 6) + 0.0 AS net_return "
                                       "FROM cl JOIN (SELECT symbol, candidate FROM pw) USING (symbol, candidate) WHERE split = 'test' AND fold = (SELECT max(fold) FROM plan) GROUP BY 1, 2",
                                       "bars", ctes=CAND_CTE))
def search_and_confirm(spark, sf):
    """Candidates ranked on pooled validation returns; the winner is read once on the last test window."""
    led, plan = candidate_ledger(spark, sf)
    dev = led.where((F.col("split") == "val") & (F.col("fold") < len(plan)))
    win = ev.best_candidate(candidate_scores(dev, ["symbol"]), ["symbol"]).drop("sharpe")
    x = led.where((F.col("split") == "test") & (F.col("fold") == len(plan))).join(win, ["symbol", "candidate"])
    x = x.groupBy("symbol", "candidate").agg(F.count(F.lit(1)).alias("n_obs"), mt.sharpe("net").alias("sharpe"), mt.total_return("net").alias("net_return"))
    return out(x, "symbol", "candidate", "n_obs", r=["sharpe", "net_return"])


@query("wf_10_catalogue_scores", sql(f"SELECT candidate, round(avg(sharpe), 6) + 0.0 AS mean_sharpe, count(*) AS n_scored FROM cs GROUP BY 1", "bars", ctes=CAND_CTE))
def catalogue_scores(spark, sf):
    led, _ = candidate_ledger(spark, sf)
    x = candidate_scores(led.where("split = 'val'"), ["symbol", "fold"]).groupBy("candidate").agg(
        F.avg("sharpe").alias("mean_sharpe"), F.count(F.lit(1)).alias("n_scored"))
    return out(x, "candidate", "n_scored", r=["mean_sharpe"])


SPLIT_CTE = EVAL_CTE + f""",
fx AS (SELECT *, sno < 600 AS is_train FROM e2),
fd AS (SELECT fx.*, k.symbol IS NOT NULL, CASE WHEN p > t THEN 1.0 ELSE 0.0 END AS dir FROM fx JOIN (SELECT symbol, quantile_cont(p, 0.5) AS t FROM fx WHERE is_train GROUP BY 1) k USING (symbol) WHERE sno >= 610),
dly(delay) AS (VALUES (0), (1), (2), (3)),
fz AS (SELECT fd.*, delay, CASE delay WHEN 0 THEN lag(dir, 1) OVER w WHEN 1 THEN lag(dir, 2) OVER w WHEN 2 THEN lag(dir, 3) OVER w ELSE lag(dir, 4) OVER w END AS st FROM fd CROSS JOIN dly
  WINDOW w AS (PARTITION BY symbol, delay ORDER BY ts)),
f9 AS (SELECT *, coalesce(st * scale, 0) AS position FROM fz),
f8 AS (SELECT *, position * coalesce(fwd_ret, 0) AS gross, abs(position - coalesce(lag(position) OVER (PARTITION BY symbol, delay ORDER BY ts), 0)) AS turnover FROM f9)"""


@query("wf_08_fixed_split_confirmation", sql("SELECT symbol, delay, fee::DOUBLE AS fee, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252.0), 6) + 0.0 AS sharpe FROM "
                                             "(SELECT *, gross - turnover * (fee + 1) / 10000.0 AS net FROM f8 CROSS JOIN (VALUES (0.0), (5.0), (10.0), (20.0)) f(fee)) GROUP BY 1, 2, 3",
                                             "bars", ctes=SPLIT_CTE))
def fixed_split(spark, sf):
    """One threshold from the training part, then cost 0/5/10/20 x delay 0..3 on the rest."""
    x, _ = frame(spark, sf)
    thr = x.where("session_no < 600").groupBy("symbol").agg(F.percentile("p", F.lit(0.5)).alias("t"))
    test = x.where("session_no >= 610").join(thr, "symbol").withColumn("dir", F.when(F.col("p") > F.col("t"), 1.0).otherwise(0.0))
    test = test.withColumns({f"_d{d}": S.lag("dir", 1 + d) for d in range(4)})
    grid = F.explode(F.array(*[F.struct(F.lit(d).alias("delay"), F.col(f"_d{d}").alias("staged")) for d in range(4)]))
    led = bt.price(test.withColumn("_g", grid).select("*", "_g.*").drop("_g"), bt.Execution(), ("symbol", "delay"))
    led = led.withColumn("fee", F.explode(F.array(*[F.lit(v) for v in (0.0, 5.0, 10.0, 20.0)])))
    led = bt.charge(led, F.col("fee"), 1.0)
    return out(led.groupBy("symbol", "delay", "fee").agg(mt.sharpe("net").alias("sharpe")), "symbol", "delay", "fee", r=["sharpe"])


# ---- fitted models (no SQL twin) ------------------------------------------------------------

FEATURES = ["mom_63", "trend_50", "mean_reversion_20", "rv_20", "volume_z_20"]


def stored_bars(spark, sf):
    """Bars written once, for queries of many jobs: their number is bounded by symbols and sessions, the trades behind them are not."""
    path = files.scratch(spark, "bars")
    views.bars(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def model_frame(spark, sf):
    b = stored_bars(spark, sf)
    x = pf.labels(pf.price_volume_features(b), 1)
    x = x.withColumn("scale", bt.vol_scale("ret", bt.Execution(), S))
    return ev.label_folds(pt.session_index(x), plan_of(b))


def fitted(spark, sf, features=FEATURES, c=1.0):
    lab = model_frame(spark, sf)
    scale, coef = models.fit_logistic(lab.where("split = 'train'"), features, "label", ["symbol", "fold"], c)
    return models.predict_logistic(lab.where("split <> 'train'"), features, scale, coef, ["symbol", "fold"])


@query("wf_03_fold_logistic")
def fold_logistic(spark, sf):
    """All (symbol, fold) logistic models at once; fit on train rows, scored on validation and test."""
    x = fitted(spark, sf)
    return x.groupBy("symbol", "fold", "split").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2.0))).alias("brier"))


@query("wf_03_fold_boosting")
def fold_boosting(spark, sf):
    """Gradient boosting of each fold's pooled training rows on Spark ML (five trees a fold)."""
    lab = model_frame(spark, sf).persist()
    parts = []
    for fold in lab.select("fold").distinct().orderBy("fold").collect():
        own = lab.where(F.col("fold") == fold["fold"])
        x = models.boosted_trees(own.where("split = 'train'"), own.where("split = 'test'"), FEATURES, "label", trees=5)
        parts.append(x.groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p")))
    return reduce(DataFrame.unionByName, parts)


# ---- search over the catalogue of fitted models (no SQL twin) ---------------------------------

CATALOGUE_SCORES: dict[tuple[str, str], DataFrame] = {}  # by application and folder: three queries read the same table


def catalogue_scores_of(spark, sf):
    """Validation scores of all 1,960 candidates on every (symbol, fold); written once in an application."""
    lab = model_frame(spark, sf)
    ensure_checkpoint_dir(spark)
    key = spark.sparkContext.applicationId, sf
    if key not in CATALOGUE_SCORES:
        CATALOGUE_SCORES[key] = search.validation_scores(lab, FEATURES, search.catalogue(), THRESHOLDS).checkpoint()
    return lab, CATALOGUE_SCORES[key]


@query("wf_10_model_catalogue")
def model_catalogue(spark, sf):
    """The catalogue with the mean validation Sharpe of each candidate over symbols and folds."""
    _, scores = catalogue_scores_of(spark, sf)
    mean = scores.groupBy("candidate").agg(F.avg("sharpe").alias("mean_sharpe"), F.count(F.lit(1)).alias("n_scored"), F.sum("trades").alias("trades"))
    return search.catalogue_table(spark, search.catalogue()).join(mean, "candidate")


@query("wf_05_model_discovery")
def model_discovery(spark, sf):
    """Each fold trades the best of 1,960 candidates by its own validation window; hold and lag restart per fold, turnover is that of the merged path."""
    lab, scores = catalogue_scores_of(spark, sf)
    best = ev.best_candidate(scores, ["symbol", "fold"]).drop("sharpe").join(scores.select("symbol", "fold", "candidate", "threshold"), ["symbol", "fold", "candidate"])
    led = search.chosen_ledger(lab, best, FEATURES, search.catalogue())
    path = led.withColumn("turnover", F.abs(F.col("position") - F.coalesce(S.lag("position"), F.lit(0.0))))
    return bt.charge(path, 5.0, 1.0).select("symbol", "fold", "candidate", views.day().alias("session"), "position", "turnover", "net")


@query("wf_07_model_confirmation")
def model_confirmation(spark, sf):
    """Winner per symbol on pooled validation returns of all folds but the last; read once on the last test window, as is, with higher fees and with delay."""
    lab, scores = catalogue_scores_of(spark, sf)
    last = lab.agg(F.max("fold")).scalar()
    dev = scores.withColumn("_last", last)
    pooled = search.pooled_sharpe(dev.where(F.col("fold") < F.col("_last")), ["symbol"])
    best = ev.best_candidate(pooled, ["symbol"]).drop("sharpe")
    chosen = dev.where(F.col("fold") == F.col("_last")).join(best, ["symbol", "candidate"]).select("symbol", "fold", "candidate", "threshold")
    variants = {"base": bt.Execution(), "cost": bt.Execution(fee_bps=20.0), "delay": bt.Execution(delay=1)}
    parts = [search.chosen_ledger(lab, chosen, FEATURES, search.catalogue(), cfg=cfg).groupBy("symbol", "candidate").agg(
        F.count(F.lit(1)).alias("n_obs"), mt.sharpe("net").alias("sharpe"), mt.total_return("net").alias("net_return")).withColumn("variant", F.lit(name))
        for name, cfg in variants.items()]
    return reduce(DataFrame.unionByName, parts)


ABLATION = ev.FoldConfig(train=250, val=60, test=80, step=80, purge=5, embargo=5)


@query("wf_09_source_ablation")
def source_ablation(spark, sf):
    """Price features against price and news features on hourly bars: test Sharpe, AUC and Brier of the same folds, and the difference."""
    bars = views.hourly_bars(spark, sf)
    x = pf.labels(pf.price_volume_features(bars), 1).withColumn("scale", bt.vol_scale("ret", bt.Execution(), S))
    news = information_features(bars, views.pit_events(spark, sf), pin="later").select("symbol", "ts", *INFO_FEATURES)
    plan = ev.fold_plan(bars.select("ts").distinct().count(), ABLATION)
    lab = ev.label_folds(pt.session_index(x.join(news, ["symbol", "ts"])), plan, splits=("train", "test"))
    features = [*FEATURES[1:], *INFO_FEATURES]
    price = tuple(range(len(FEATURES) - 1))
    every = [search.Candidate(0, "logistic", 1.0, 0, 0, 1, price), search.Candidate(1, "logistic", 1.0, 0, 0, 1, None)]
    chosen = lab.select("symbol", "fold").distinct().withColumn("candidate", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("threshold", F.lit(0.5))
    led = search.chosen_ledger(lab, chosen, features, every).join(lab.where("split = 'test'").select("symbol", "fold", "ts", "label"), ["symbol", "fold", "ts"])
    m = led.groupBy("symbol", "candidate").agg(mt.sharpe("net").alias("sharpe"), F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2.0))).alias("brier"))
    m = m.join(mt.auc(led.where("label IS NOT NULL"), "label", "p", ["symbol", "candidate"]).select("symbol", "candidate", "auc"), ["symbol", "candidate"])
    of = lambda k: m.where(F.col("candidate") == k).select("symbol", *[F.col(c).alias(f"{c}_{'with_news' if k else 'price'}") for c in ("sharpe", "auc", "brier")])
    return of(0).join(of(1), "symbol").withColumn("auc_delta", F.col("auc_with_news") - F.col("auc_price"))


@query("rb_03_parameter_perturbation")
def parameter_perturbation(spark, sf):
    """Refit with C x {0.5, 0.8, 1.25, 2} and the base, thresholds pinned; all in one job."""
    lab = model_frame(spark, sf)
    factors = (1.0, 0.5, 0.8, 1.25, 2.0)
    every = [search.Candidate(i, "logistic", c, 0, 0, 1) for i, c in enumerate(factors)]
    chosen = lab.select("symbol", "fold").distinct().withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(len(factors) - 1)))).withColumn("threshold", F.lit(0.5))
    led = search.chosen_ledger(lab, chosen, FEATURES, every)
    x = led.groupBy("symbol", "candidate").agg(mt.sharpe("net").alias("sharpe"), mt.total_return("net").alias("net_return"))
    base = x.where("candidate = 0").select("symbol", F.col("sharpe").alias("base_sharpe"))
    x = x.where("candidate > 0").join(base, "symbol")
    return x.select("symbol", F.array(*[F.lit(f) for f in factors])[F.col("candidate")].alias("multiplier"), "sharpe", "net_return", (F.col("sharpe") - F.col("base_sharpe")).alias("sharpe_delta"))


# ---- stresses of inputs and leakage -------------------------------------------------------------

def s_mix(*parts, seed=0, m=1_000_003):
    k = (7919, 104729, 15485863)
    total = " + ".join([str(seed * 1299709 % m)] + [f"(({p})::BIGINT % {m}) * {k[i] % m}" for i, p in enumerate(parts)])
    x = f"(({total}) % {m})"
    y = f"(({x} * {x} + {x} * 31 + 17) % {m})"
    return f"(({y} * {y} + {y} * 101 + {x}) % {m})"


@query("rb_04_missing_data_stress", sql(
    f"SELECT symbol, count(*) AS n_rows, count(mr) AS kept_mr, count(rv) AS kept_rv, round(sum(mr), 6) + 0.0 AS sum_mr FROM (SELECT symbol, "
    f"CASE WHEN {s_mix('rn', seed=3)} >= 100000 THEN mean_reversion_20 END AS mr, CASE WHEN {s_mix('rn', seed=4)} >= 100000 THEN rv_20 END AS rv "
    "FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM f3)) GROUP BY 1", "bars", ctes=stages("bars", *BASE_STAGES)))
def missing_data(spark, sf):
    """About a tenth of feature cells masked by an integer hash; the time axis stays."""
    x = pf.price_volume_features(views.bars(spark, sf)).withColumn("rn", F.row_number().over(S.order))
    x = ev.mask_cells(x, ["mean_reversion_20", "rv_20"], 0.1, "rn", seed=3)
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.count("mean_reversion_20").alias("kept_mr"), F.count("rv_20").alias("kept_rv"),
                                   (F.round(F.sum("mean_reversion_20"), 6) + F.lit(0.0)).alias("sum_mr"))


LEAK_COLS = ["mom_63", "trend_50", "mean_reversion_20", "rv_20", "regime_high_vol", "rel_strength", "volume_z_20"]
LEAK_WORLDS = ("price", "volume", "cross_asset", "target")
SPLIT = "1998-06-01"


def _leak_sql() -> str:
    """Clean features have no changed row; the planted one reads the next close, so the last bar of each changed symbol before the split differs."""
    planted = "SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nxt FROM bars"
    hit = f"FROM ({planted}) WHERE ts < DATE '{SPLIT}' AND nxt >= DATE '{SPLIT}'"
    n_bars = f"(SELECT count(*) FROM bars WHERE ts < DATE '{SPLIT}')"
    changed = {"price": f"(SELECT count(*) {hit})", "cross_asset": f"(SELECT count(*) {hit} AND symbol <> 'ECONOMY')"}
    parts = [f"SELECT '{w}' AS dimension, '{c}' AS feature, {n_bars} AS checked_rows, CAST(0 AS BIGINT) AS n_changed" for w in LEAK_WORLDS for c in LEAK_COLS]
    parts += [f"SELECT '{w}', 'planted_next_close', {n_bars}, CAST({changed.get(w, '0')} AS BIGINT)" for w in LEAK_WORLDS]
    parts += [f"SELECT '{w}', '{c}', (SELECT count(*) FROM hbars WHERE ts < TIMESTAMP '2024-01-15 00:00:00'), CAST(0 AS BIGINT)" for w in ("event_content", "event_add_remove") for c in INFO_FEATURES]
    return "SELECT *, n_changed = 0 AS passed FROM (" + " UNION ALL ".join(parts) + ")"


@query("rb_07_leakage_audit", sql(_leak_sql(), "bars", "hbars"))
def leakage(spark, sf):
    """Six dimensions: features of changed futures must agree before the change; one planted feature reads the next close and is found."""
    split = F.lit(SPLIT).cast("timestamp")
    bump = 1.0 + (F.dayofyear("ts") % 7 + 1) / 100.0
    prices = {c: F.col(c) * bump for c in ("open", "high", "low", "close")}
    other = {c: F.when(F.col("symbol") != "ECONOMY", v).otherwise(F.col(c)) for c, v in prices.items()}
    worlds = {"price": prices, "volume": {"volume": F.col("volume") * bump}, "cross_asset": other, "target": {"label": 1 - F.col("label"), "fwd_ret": -F.col("fwd_ret")}}
    s = Rolling(("world", "symbol"))

    def build(rows):
        return pf.price_volume_features(rows, s).withColumn("planted_next_close", s.lead("close"))
    x = ev.leakage_audit(pf.labels(views.bars(spark, sf)), build, [*LEAK_COLS, "planted_next_close"], split, worlds)
    news = ev.event_audit(views.hourly_bars(spark, sf), views.pit_events(spark, sf), lambda bars, events: information_features(bars, events, pin="later"),
                          list(INFO_FEATURES), F.to_timestamp(F.lit("2024-01-15T00:00:00Z")))
    return x.unionByName(news).select("dimension", "feature", "checked_rows", "n_changed", "passed")


@query("ag_26_history_delta", sql("SELECT 'ret' AS feature, round(max(abs(a - b)), 6) + 0.0 AS max_delta, count(*) AS checked_rows FROM (SELECT close / lag(close) OVER w - 1 AS a, "
                                  "CASE WHEN lag(close) OVER w IS NOT NULL THEN (close * CASE WHEN day(ts) = 1 THEN 1.01 ELSE 1 END) / (lag(close) OVER w * CASE WHEN day(lag(ts) OVER w) = 1 THEN 1.01 ELSE 1 END) - 1 END AS b "
                                  "FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))", "bars"))
def history_delta(spark, sf):
    b = views.bars(spark, sf)
    moved = b.withColumn("close", F.col("close") * F.when(F.dayofmonth("ts") == 1, 1.01).otherwise(1.0))
    x = ev.history_delta(pf.returns(b), pf.returns(moved), ["ret"])
    return out(x, "feature", "checked_rows", r=["max_delta"])


# ---- book stresses --------------------------------------------------------------------------------

@query("rb_06_book_stress", sql(
    f"SELECT delay, multiple::DOUBLE AS multiple, round({S_SHARPE('net')}, 6) + 0.0 AS sharpe, round(product(1 + net) - 1, 6) + 0.0 AS net_return, round(sum(turnover) / (count(*) / 252.0), 6) + 0.0 AS annual_turnover "
    "FROM (SELECT *, gross - turnover * 6 * multiple / 10000.0 AS net FROM dz CROSS JOIN (VALUES (1.0), (2.0), (3.0)) m(multiple)) GROUP BY 1, 2",
    "bars", ctes=q_books.MAG_CTE + """,
dw AS (SELECT symbol, ts, delay, close, CASE delay WHEN 0 THEN lag(w, 1) OVER s WHEN 1 THEN lag(w, 2) OVER s ELSE lag(w, 4) OVER s END AS ew0, lead(close) OVER s / close - 1 AS fwd
  FROM nb CROSS JOIN (VALUES (0), (1), (3)) d(delay) WINDOW s AS (PARTITION BY symbol, delay ORDER BY ts)),
dx AS (SELECT *, coalesce(ew0, 0) AS ew FROM dw),
dy AS (SELECT *, abs(ew - coalesce(lag(ew) OVER (PARTITION BY symbol, delay ORDER BY ts), 0)) AS d FROM dx),
dz AS (SELECT ts, delay, coalesce(sum(ew * fwd), 0) AS gross, sum(d) AS turnover FROM dy GROUP BY 1, 2)"""))
def book_stress(spark, sf):
    """Cost x1,2,3 and weight delay 0,1,3 on the weekly book, built once."""
    w = q_books.magnitude(spark, sf).select("symbol", "ts", "w")
    w = w.withColumns({"_w0": F.col("w"), **{f"_w{d}": F.coalesce(S.lag("w", d), F.lit(0.0)) for d in (1, 3)}})
    lagged = F.explode(F.array(*[F.struct(F.lit(d).alias("delay"), F.col(f"_w{d}").alias("w")) for d in (0, 1, 3)]))
    grid = w.withColumn("_g", lagged).select("symbol", "ts", "_g.*")
    per = bt.portfolio_returns(grid, grid_bars(spark, sf), keys=("delay",))
    per = per.withColumn("multiple", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    per = per.withColumn("net", F.col("gross") - F.col("turnover") * 6.0 * F.col("multiple") / 10000.0)
    x = per.groupBy("delay", "multiple").agg(mt.sharpe("net").alias("sharpe"), mt.total_return("net").alias("net_return"),
                                             (F.sum("turnover") / (F.count(F.lit(1)) / 252.0)).alias("annual_turnover"))
    return out(x, "delay", "multiple", r=["sharpe", "net_return", "annual_turnover"])


@query("rg_03_book_end_to_end", sql(
    f"SELECT fold, count(*) AS n_obs, round({S_SHARPE('net')}, 6) + 0.0 AS sharpe, round(product(1 + net) - 1, 6) + 0.0 AS net_return, round(sum(turnover), 6) + 0.0 AS turnover FROM "
    "(SELECT x4.*, dense_rank() OVER (ORDER BY ts) - 1 AS sno FROM x4) JOIN plan ON sno >= test_lo AND sno < test_hi GROUP BY 1",
    "bars", ctes=q_books.MAG_CTE + ",\n" + q_books.CASH_SQL + ",\n" + PLAN_CTE))
def book_end_to_end(spark, sf):
    """Bars to signal, weekly book, lagged returns, excess over cash, folds and fold metrics."""
    x = pt.session_index(q_books.excess_returns(spark, sf))
    x = ev.label_folds(x, plan_of(views.bars(spark, sf)), splits=("test",))
    x = x.groupBy("fold").agg(F.count(F.lit(1)).alias("n_obs"), mt.sharpe("net").alias("sharpe"), mt.total_return("net").alias("net_return"), F.sum("turnover").alias("turnover"))
    return out(x, "fold", "n_obs", r=["sharpe", "net_return", "turnover"])


# ---- classification metrics -------------------------------------------------------------------------

SCORED = f"sc AS (SELECT d.lang, l.quality AS label, {s_mix('l.doc_id')} % 200 / 200.0 AS p FROM labels l JOIN documents d USING (doc_id))"


def scored(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", "lang")
    x = views.table(spark, sf, "labels").join(d, "doc_id")
    return x.select("lang", F.col("quality").alias("label"), ((ev.mix("doc_id") % 200) / 200.0).alias("p"))


@query("ag_23_auc", sql("""SELECT lang, round((sum(CASE WHEN label = 1 THEN r END) - np * (np + 1) / 2.0) / nullif(np * (count(*) - np), 0), 8) AS auc, np AS n_pos, count(*) - np AS n_neg
  FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS r, count(*) FILTER (WHERE label = 1) OVER (PARTITION BY lang) AS np FROM sc) GROUP BY lang, np""", ctes=SCORED))
def auc(spark, sf):
    x = mt.auc(scored(spark, sf), "label", "p", ["lang"])
    return x.select("lang", F.round("auc", 8).alias("auc"), "n_pos", "n_neg")


@query("ag_24_brier", sql("SELECT lang, round(avg(pow(p - label, 2)), 8) AS brier FROM sc GROUP BY 1", ctes=SCORED))
def brier(spark, sf):
    return scored(spark, sf).groupBy("lang").agg(F.round(F.avg(F.pow(F.col("p") - F.col("label"), F.lit(2.0))), 8).alias("brier"))


# ---- placebo, bootstrap, multiple testing -------------------------------------------------------------

RUNS = 20
PL_CTE = EVAL_CTE + f""",
pz AS (SELECT *, CASE WHEN ok THEN sum(CAST(ok AS INTEGER)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 END AS pos FROM (SELECT *, fwd_ret IS NOT NULL AS ok FROM e2)),
pr0 AS (SELECT pz.*, run FROM pz CROSS JOIN (SELECT unnest(range({RUNS})) AS run)),
dn AS (SELECT symbol, run, row_number() OVER (PARTITION BY symbol, run ORDER BY {s_mix('pos // BLK', 'run', seed=5)}, pos) - 1 AS pos, fwd_ret AS nf FROM pr0 WHERE ok),
px AS (SELECT pr0.* REPLACE (CASE WHEN ok THEN nf ELSE fwd_ret END AS fwd_ret), signal AS dir FROM pr0 LEFT JOIN dn USING (symbol, run, pos)),
""" + fled("px", "symbol, run", "pq") + f""",
nul AS (SELECT symbol, run, {S_SHARPE('net')} AS sharpe FROM pq GROUP BY 1, 2),
""" + fled("(SELECT *, signal AS dir FROM e2)", "symbol", "oq") + f""",
obs AS (SELECT symbol, {S_SHARPE('net')} AS sharpe FROM oq GROUP BY 1),
pst AS (SELECT symbol, o.sharpe AS observed, count(*) AS n_runs, count(*) FILTER (WHERE n.sharpe < o.sharpe) / count(*)::DOUBLE AS percentile,
  (1 + count(*) FILTER (WHERE n.sharpe >= o.sharpe)) / (count(*) + 1)::DOUBLE AS adjusted_p, avg(n.sharpe) AS null_mean, quantile_cont(n.sharpe, 0.5) AS null_median,
  stddev_samp(n.sharpe) AS null_sd, quantile_cont(n.sharpe, 0.95) AS null_p95 FROM nul n JOIN obs o USING (symbol) GROUP BY symbol, o.sharpe)"""


def null_runs(spark, sf, block=1):
    x, _ = frame(spark, sf)
    y = st.permute(x.withColumnRenamed("signal", "dir"), ["fwd_ret"], RUNS, block=block, seed=5)
    null = ev.ledger(y, ["symbol", "run"]).groupBy("symbol", "run").agg(mt.sharpe("net").alias("sharpe"))
    obs = ev.ledger(x.withColumnRenamed("signal", "dir"), ["symbol"]).groupBy("symbol").agg(mt.sharpe("net").alias("sharpe"))
    return null, obs


for _b, _n in ((1, "pl_01_pair_permutation"), (21, "pl_01_block_permutation")):
    def _run(spark, sf, b=_b):
        return out(null_runs(spark, sf, b)[0], "symbol", "run", r=["sharpe"])
    query(_n, sql("SELECT symbol, run, round(sharpe, 6) + 0.0 AS sharpe FROM nul", "bars", ctes=PL_CTE.replace("BLK", str(_b))))(_run)

PSTATS = ["observed", "percentile", "adjusted_p", "null_mean", "null_median", "null_sd", "null_p95", "mc_se"]


@query("pl_02_placebo_statistics", sql(sel("(SELECT *, sqrt(adjusted_p * (1 - adjusted_p) / (n_runs + 1)) AS mc_se FROM pst)", ["symbol", "n_runs"], PSTATS), "bars", ctes=PL_CTE.replace("BLK", "1")))
def placebo_stats(spark, sf):
    return out(st.placebo_statistics(*null_runs(spark, sf)), "symbol", "n_runs", r=PSTATS)


@query("sx_02_adjusted_pvalues", sql("""SELECT symbol, round(p, 6) AS p, round(least(1, p * n), 6) AS bonferroni,
  round(least(1, min(p * n / r) OVER (ORDER BY p, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh,
  round(least(1, max(p * (n - r + 1)) OVER (ORDER BY p, symbol ROWS UNBOUNDED PRECEDING)), 6) AS holm
  FROM (SELECT symbol, adjusted_p AS p, count(*) OVER () AS n, row_number() OVER (ORDER BY adjusted_p, symbol) AS r FROM pst)""", "bars", ctes=PL_CTE.replace("BLK", "1")))
def adjusted_pvalues(spark, sf):
    x = st.placebo_statistics(*null_runs(spark, sf)).select("symbol", F.col("adjusted_p").alias("p")).withColumn("family", F.lit("momentum"))
    x = st.adjust_pvalues(x, "p", ("family",), "symbol")
    return x.select("symbol", *[F.round(c, 6).alias(c) for c in ("p", "bonferroni", "bh", "holm")])


@query("pl_01_feature_shuffle")
def feature_shuffle(spark, sf):
    """Each feature column permuted on its own, models refitted per column, fold and run (three runs)."""
    b = stored_bars(spark, sf)
    x = pf.labels(pf.price_volume_features(b), 1).withColumn("scale", bt.vol_scale("ret", bt.Execution(), S))
    y = reduce(DataFrame.unionByName, [st.permute(x, [c], 3, seed=1).withColumn("shuffled", F.lit(c)) for c in FEATURES])
    lab = ev.label_folds(pt.session_index(y), plan_of(b))
    by = ["symbol", "shuffled", "fold", "run"]
    scale, coef = models.fit_logistic(lab.where("split = 'train'"), FEATURES, "label", by)
    p = models.predict_logistic(lab.where("split = 'test'"), FEATURES, scale, coef, by)
    led = ev.ledger(p.withColumn("dir", F.when(F.col("p") > 0.5, 1.0).otherwise(0.0)), ["symbol", "shuffled", "run"])
    return led.groupBy("symbol", "shuffled", "run").agg(mt.sharpe("net").alias("sharpe"))


@query("pl_03_session_permutation", sql(
    f"SELECT run, round({S_SHARPE('net')}, 6) + 0.0 AS sharpe FROM pb GROUP BY 1", "bars", ctes=q_books.WEEK_CTE + f""",
sd AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM w1 WHERE signal IS NOT NULL)),
sr AS (SELECT ts, pos, run FROM sd CROSS JOIN (SELECT unnest(range(5)) AS run)),
ss AS (SELECT run, ts AS src, row_number() OVER (PARTITION BY run ORDER BY {s_mix('pos', 'run', seed=2)}, pos) - 1 AS pos FROM sr),
mp AS (SELECT sr.run, sr.ts, src FROM sr JOIN ss USING (run, pos)),
pw AS (SELECT b.symbol, b.ts, r.run, b.close, q.signal AS sig FROM w1 b CROSS JOIN (SELECT unnest(range(5)) AS run) r LEFT JOIN mp ON mp.run = r.run AND mp.ts = b.ts LEFT JOIN w1 q ON q.symbol = b.symbol AND q.ts = mp.src),
px AS (SELECT *, coalesce(last_value(CASE WHEN isodow(ts) = 3 THEN coalesce(sign(sig), 0) / 6.0 END IGNORE NULLS) OVER (PARTITION BY run, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS w FROM pw),
pe AS (SELECT *, coalesce(lag(w) OVER s, 0) AS ew, lead(close) OVER s / close - 1 AS fwd FROM px WINDOW s AS (PARTITION BY run, symbol ORDER BY ts)),
pf AS (SELECT *, abs(ew - coalesce(lag(ew) OVER (PARTITION BY run, symbol ORDER BY ts), 0)) AS d FROM pe),
pb AS (SELECT run, ts, coalesce(sum(ew * fwd), 0) - sum(d) * 6 / 10000.0 AS net FROM pf GROUP BY 1, 2)"""))
def session_permutation(spark, sf):
    """Whole cross-sections of the signal moved between sessions, the book rebuilt per run."""
    x = q_books.week_frame(spark, sf).select("symbol", "ts", "close", "signal")
    y = st.permute_sessions(x, "signal", 5, seed=2)
    y = y.withColumn("target", F.when(F.weekday("ts") == 2, F.coalesce(F.signum("signal"), F.lit(0.0)) / 6.0))
    book = pt.hold_targets(y, ("run", "symbol"))
    per = bt.portfolio_returns(book.select("run", "symbol", "ts", "w"), grid_bars(spark, sf), keys=("run",))
    return out(per.groupBy("run").agg(mt.sharpe("net").alias("sharpe")), "run", r=["sharpe"])


BOOT = 100
BOOT_CTE = EVAL_CTE + ",\n" + fled("(SELECT *, signal AS dir FROM e2)", "symbol", "oq") + f""",
bp AS (SELECT symbol, net, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM oq),
bz AS (SELECT DISTINCT symbol, n FROM bp),
bd AS (SELECT symbol, n, b, k, {s_mix('b', 'k', seed=42)} % greatest(n - 20 + 1, 1) AS start FROM (SELECT symbol, n, b, unnest(range(CAST(ceil(n / 20.0) AS BIGINT))) AS k FROM bz CROSS JOIN (SELECT unnest(range({BOOT})) AS b))),
be AS (SELECT symbol, b, start + j AS pos FROM bd CROSS JOIN (SELECT unnest(range(20)) AS j) WHERE k * 20 + j < n),
bs AS (SELECT symbol, b, {S_SHARPE('net')} AS sharpe FROM be JOIN bp USING (symbol, pos) GROUP BY 1, 2)"""


@query("sx_01_block_bootstrap", sql("""SELECT symbol, round(avg(sharpe), 6) + 0.0 AS mean, round(quantile_cont(sharpe, 0.025), 6) + 0.0 AS low, round(quantile_cont(sharpe, 0.975), 6) + 0.0 AS high,
  count(*) FILTER (WHERE sharpe > 0) / count(*)::DOUBLE AS positive_prob, count(*) AS n_boot FROM bs GROUP BY 1""", "bars", ctes=BOOT_CTE))
def block_bootstrap(spark, sf):
    """The SQL expands every resampled row; Spark looks blocks up in prefix sums."""
    x = st.bootstrap_summary(st.bootstrap_sharpe(momentum_ledger(spark, sf), n_boot=BOOT))
    return out(x, "symbol", "n_boot", "positive_prob", r=["mean", "low", "high"])


# z of 1 - 1/48 and of 1 - 1/(48 e) for the SQL side, from the standard library.
from math import e as _E  # noqa: E402
from statistics import NormalDist as _ND  # noqa: E402

_Z1, _Z2 = _ND().inv_cdf(1 - 1 / 48), _ND().inv_cdf(1 - 1 / (48 * _E))


@query("sx_03_deflated_sharpe", sql(f"""SELECT symbol, round(sqrt(v) * (0.4227843350984671 * {_Z1!r} + 0.5772156649015329 * {_Z2!r}), 6) + 0.0 AS expected_max,
  round(sqrt(n - 1) * (sr - sqrt(v) * (0.4227843350984671 * {_Z1!r} + 0.5772156649015329 * {_Z2!r})) / sqrt(term), 4) + 0.0 AS t_stat FROM (
  SELECT *, term / (n - 1) AS v FROM (SELECT *, 1 - sk * sr + (ku - 1) / 4 * sr * sr AS term FROM (
    SELECT symbol, count(*) AS n, avg(net) / stddev_samp(net) AS sr, sum(pow(net - m, 3)) / count(*) / pow(stddev_pop(net), 3) AS sk, sum(pow(net - m, 4)) / count(*) / pow(stddev_pop(net), 4) AS ku
    FROM (SELECT *, avg(net) OVER (PARTITION BY symbol) AS m FROM oq) GROUP BY 1)))""", "bars", ctes=EVAL_CTE + ",\n" + fled("(SELECT *, signal AS dir FROM e2)", "symbol", "oq")))
def deflated_sharpe(spark, sf):
    from barwise.functions.normal import norm_ppf
    m = momentum_ledger(spark, sf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), mt.sharpe("net").alias("sharpe"), F.skewness("net").alias("sk"), (F.kurtosis("net") + 3.0).alias("ku"))
    trials = F.lit(48)
    p = st.deflated_sharpe_pvalue(F.col("sharpe"), trials, F.col("n"), F.col("sk"), F.col("ku"))
    sr = F.col("sharpe") / mt.ANNUAL
    v = (1.0 - F.col("sk") * sr + (F.col("ku") - 1.0) / 4.0 * sr * sr) / (F.col("n") - 1)
    x = m.withColumn("pv", p).withColumns({"expected_max": st.expected_max_sharpe(trials, F.col("n"), v), "t_stat": -norm_ppf(F.col("pv"))})
    return x.select("symbol", (F.round("expected_max", 6) + F.lit(0.0)).alias("expected_max"), (F.round("t_stat", 4) + F.lit(0.0)).alias("t_stat"))


@query("sx_04_overfitting_probability", sql("""SELECT symbol, avg(CAST(rank / (nv - 1)::DOUBLE >= 0.5 AS INTEGER)) AS pbo, count(*) AS n_splits FROM (
  SELECT symbol, split, any_value(nv) AS nv, count(*) FILTER (WHERE oos > bo) AS rank FROM (SELECT *, count(*) OVER w AS nv, first_value(oos) OVER (PARTITION BY symbol, split ORDER BY ins DESC, candidate) AS bo FROM pf
    WINDOW w AS (PARTITION BY symbol, split)) GROUP BY 1, 2) GROUP BY 1""", "bars", ctes=CAND_CTE + """,
fs AS (SELECT symbol, candidate, fold - 1 AS f, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252.0) AS sharpe FROM cl WHERE split = 'test' GROUP BY 1, 2, 3),
nf AS (SELECT max(f) + 1 AS n FROM fs),
sp AS (SELECT split FROM (SELECT unnest(range(CAST(1 AS BIGINT) << CAST(n AS BIGINT))) AS split, n FROM nf) WHERE bit_count(split) = n // 2 AND n >= 4),
pf AS (SELECT symbol, split, candidate, avg(sharpe) FILTER (WHERE (split >> CAST(f AS BIGINT)) & 1 = 1) AS ins, avg(sharpe) FILTER (WHERE (split >> CAST(f AS BIGINT)) & 1 = 0) AS oos
       FROM fs CROSS JOIN sp GROUP BY 1, 2, 3)"""))
def overfitting(spark, sf):
    led, plan = candidate_ledger(spark, sf)
    m = led.where("split = 'test'").groupBy("symbol", "candidate", (F.col("fold") - 1).alias("fold_no")).agg(mt.sharpe("net").alias("sharpe"))
    return st.overfitting_probability(m, len(plan), variant="candidate", keys=("symbol",))


# ---- frozen replays and side joins ---------------------------------------------------------------------

@query("wf_06_frozen_replay", sql(f"SELECT symbol, delay, fee::DOUBLE AS fee, round({S_SHARPE('net')}, 6) + 0.0 AS sharpe, round(sum(turnover), 6) + 0.0 AS turnover FROM (SELECT *, gross - turnover * (fee + 1) / 10000.0 AS net FROM rz "
                                  "CROSS JOIN (VALUES (5.0), (20.0)) f(fee)) GROUP BY 1, 2, 3", "bars", ctes=WF_CTE + """,
ry AS (SELECT ot.*, delay, CASE delay WHEN 0 THEN lag(dir, 1) OVER w ELSE lag(dir, 3) OVER w END AS stg FROM ot CROSS JOIN (VALUES (0), (2)) d(delay) WINDOW w AS (PARTITION BY symbol, delay ORDER BY ts)),
rx AS (SELECT *, coalesce(stg * scale, 0) AS position FROM ry),
rz AS (SELECT *, position * coalesce(fwd_ret, 0) AS gross, abs(position - coalesce(lag(position) OVER (PARTITION BY symbol, delay ORDER BY ts), 0)) AS turnover FROM rx)"""))
def frozen_replay(spark, sf):
    """The out-of-sample directions re-priced at other costs and delays; nothing is refitted."""
    test = walk_forward(spark, sf)[1].select("symbol", "ts", "dir", "scale", "fwd_ret").withColumns({f"_d{d}": S.lag("dir", 1 + d) for d in (0, 2)})
    grid = F.explode(F.array(*[F.struct(F.lit(d).alias("delay"), F.col(f"_d{d}").alias("staged")) for d in (0, 2)]))
    led = bt.price(test.withColumn("_g", grid).select("*", "_g.*").drop("_g"), bt.Execution(), ("symbol", "delay"))
    led = bt.charge(led.withColumn("fee", F.explode(F.array(F.lit(5.0), F.lit(20.0)))), F.col("fee"), 1.0)
    x = led.groupBy("symbol", "delay", "fee").agg(mt.sharpe("net").alias("sharpe"), F.sum("turnover").alias("turnover"))
    return out(x, "symbol", "delay", "fee", r=["sharpe", "turnover"])


@query("jn_07_benchmark_join", sql(f"SELECT symbol, {DAY}, benchmark, round(bench_close, 6) + 0.0 AS bench_close, round(corr_close, 6) + 0.0 AS corr_close FROM gb", "bars", ctes="g AS (SELECT * FROM bars),\n" + q_windows.MAPPED_CTE))
def benchmark_join(spark, sf):
    b = views.bars(spark, sf)
    mapping = F.create_map(*[F.lit(x) for kv in q_windows.BENCH.items() for x in kv])
    pairs = b.select("symbol").distinct().withColumn("benchmark", mapping[F.col("symbol")])
    x = pf.with_benchmarks(b, pairs, "STANDARD").withColumn("session", views.day())
    return out(x, "symbol", "session", "benchmark", r=["bench_close", "corr_close"])


@query("jn_08_side_series_join", sql(f"SELECT symbol, {DAY}, round(vix, 9) + 0.0 AS vix FROM bars LEFT JOIN (SELECT ts, close / 50.0 AS vix FROM bars WHERE symbol = 'PROMO') USING (ts)", "bars"))
def side_series(spark, sf):
    x = q_windows.with_vix(views.bars(spark, sf)).withColumn("session", views.day())
    return out(x, "symbol", "session", r=["vix"], digits=9)
