"""Performance and risk metrics per group of a return ledger.

A ledger holds one row per (keys, ts) with net, gross, position and turnover.
Path statistics use windows over the group, everything else is one grouped
aggregation on the same partitioning, so a metric block costs one shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.rolling import Rolling, safe_div
from barwise.operators.validation import finite

ANNUAL = math.sqrt(252.0)


def annual_volatility(r) -> Column:
    return F.stddev_samp(r) * ANNUAL


def sharpe(r) -> Column:
    return safe_div(F.avg(r), F.stddev_samp(r)) * ANNUAL


def sortino(r, target: float = 0.0) -> Column:
    r = F.col(r) if isinstance(r, str) else r
    short = F.least(r - target, F.lit(0.0))
    return F.when(F.count(r) >= 2, safe_div(F.avg(r) - target, F.sqrt(F.avg(short * short))) * ANNUAL)


def total_return(r) -> Column:
    r = F.col(r) if isinstance(r, str) else r
    return F.product(F.lit(1.0) + r) - 1.0


def cagr(r) -> Column:
    r = F.col(r) if isinstance(r, str) else r
    equity = F.product(F.lit(1.0) + r)
    return F.when(equity <= 0, -1.0).otherwise(F.pow(F.greatest(equity, F.lit(0.0)), 252.0 / F.count(r)) - 1.0)


def hit_rate(r) -> Column:
    r = F.col(r) if isinstance(r, str) else r
    return safe_div(F.count_if(r > 0), F.count_if(r != 0))


def with_path(df: DataFrame, keys, r: str = "net", ts: str = "ts") -> DataFrame:
    """Add equity, drawdown (capital starts at 1) and the 5 % quantile of the group."""
    s = Rolling(tuple(keys), ts)
    x = df.where(finite(F.col(r))).withColumn("equity", F.product(1.0 + F.col(r)).over(s.so_far))
    return x.withColumns({
        "drawdown": F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(s.so_far)) - 1.0,
        "q05": F.percentile(r, F.lit(0.05)).over(Window.partitionBy(*keys))})


def tail_loss(r: str = "net") -> Column:
    """Mean of the returns at or below the group's 5 % quantile (needs ``with_path``)."""
    return F.avg(F.when(F.col(r) <= F.col("q05"), F.col(r)))


def metric_block(ledger: DataFrame, keys=("symbol",), ts: str = "ts") -> DataFrame:
    keys = list(keys)
    s = Rolling(tuple(keys), ts)
    x = with_path(ledger, keys, "net", ts).withColumn("_move", F.abs(F.col("position") - s.lag("position")))
    x = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), sharpe("net").alias("sharpe"), sortino("net").alias("sortino"),
        cagr("net").alias("cagr"), F.min("drawdown").alias("max_dd"), annual_volatility("net").alias("ann_vol"),
        hit_rate("net").alias("hit_rate"), tail_loss("net").alias("tail_loss_5pct"),
        total_return("net").alias("net_return"), total_return("gross").alias("gross_return"),
        (F.coalesce(F.sum("_move"), F.lit(0.0)) / (F.count(F.lit(1)) / 252.0)).alias("turnover_annual"),
        F.avg(F.abs("position")).alias("avg_exposure"), F.count_if(F.col("turnover") > 1e-9).alias("trade_count"),
        F.sum("turnover").alias("total_turnover"), F.sum("cost").alias("total_cost"))
    return x.withColumns({"calmar": safe_div("cagr", F.abs("max_dd")),
                          "cost_drag": F.col("gross_return") - F.col("net_return")})


METRICS = ("sharpe", "sortino", "cagr", "calmar", "max_dd", "ann_vol", "hit_rate", "tail_loss_5pct", "net_return",
           "gross_return", "cost_drag", "turnover_annual", "avg_exposure", "total_turnover", "total_cost")


def stress_summary(ledger: DataFrame, keys, ts: str = "ts") -> DataFrame:
    """One row per scenario; turnover here charges the first bar."""
    keys = list(keys)
    x = with_path(ledger, keys, "net", ts).groupBy(*keys).agg(
        sharpe("net").alias("sharpe"), sharpe("gross").alias("gross_sharpe"), total_return("net").alias("net_return"),
        total_return("gross").alias("gross_return"), F.min("drawdown").alias("max_dd"),
        (F.sum("turnover") / (F.count(F.lit(1)) / 252.0)).alias("annual_turnover"),
        F.sum("fee_cost").alias("fee_cost"), F.sum("slippage_cost").alias("slippage_cost"))
    return x.withColumn("cost_drag", F.col("gross_return") - F.col("net_return"))


STRESS = ("sharpe", "gross_sharpe", "net_return", "gross_return", "max_dd", "annual_turnover", "fee_cost",
          "slippage_cost", "cost_drag")


def beta(df: DataFrame, keys, r: str, benchmark: str) -> DataFrame:
    """Slope of r on the benchmark over rows where both exist."""
    both = df.where(finite(F.col(r)) & finite(F.col(benchmark)))
    return both.groupBy(*keys).agg(safe_div(F.covar_samp(r, benchmark), F.var_samp(benchmark)).alias("beta"))


def concentration(weights: DataFrame, keys=("ts",)) -> DataFrame:
    """Herfindahl index of absolute weights per session; zero when flat."""
    a = F.abs("w")
    return weights.groupBy(*keys).agg(
        F.coalesce(safe_div(F.sum(a * a), F.sum(a) * F.sum(a)), F.lit(0.0)).alias("hhi"))


def risk_report(book: DataFrame, weights: DataFrame, benchmark: DataFrame, keys=("strategy",), ts: str = "ts") -> DataFrame:
    """Risk row per strategy: book (net), weight matrix and a benchmark (ts, bench)."""
    keys = list(keys)
    s = Rolling(tuple(keys), ts)
    x = with_path(book, keys, "net", ts).join(benchmark, ts, "left")
    # Correlation runs over common rows only, as the two series are first intersected.
    common = x.where(finite(F.col("bench"))).withColumn("_c", s.corr("net", "bench", 60))
    core = x.groupBy(*keys).agg(
        annual_volatility("net").alias("annualized_vol"), F.min("drawdown").alias("max_drawdown"),
        (-F.max("q05")).alias("var_95_daily"), (-tail_loss("net")).alias("cvar_95_daily"),
        F.min("net").alias("worst_single_day"), F.count(F.lit(1)).alias("n_obs"))
    rel = common.groupBy(*keys).agg(
        safe_div(F.covar_samp("net", "bench"), F.var_samp("bench")).alias("beta_to_benchmark"),
        F.max("_c").alias("max_60d_correlation"))
    w = Rolling(tuple([*keys, "symbol"]), ts)
    moved = weights.withColumn("_d", F.abs(F.col("w") - F.coalesce(w.lag("w"), F.lit(0.0))))
    a = F.abs("w")
    per = moved.groupBy(*keys, ts).agg(
        F.sum(a).alias("g"), F.sum("_d").alias("t"),
        F.coalesce(safe_div(F.sum(a * a), F.sum(a) * F.sum(a)), F.lit(0.0)).alias("hhi"))
    expo = per.groupBy(*keys).agg(
        F.avg("g").alias("avg_gross_exposure"), F.max("g").alias("max_gross_exposure"),
        (F.sum("t") / (F.count(F.lit(1)) / 252.0)).alias("annual_turnover"),
        F.percentile("hhi", F.lit(0.5)).alias("concentration_hhi_median"), F.max("hhi").alias("concentration_hhi_worst"))
    return core.join(rel, keys, "left").join(expo, keys, "left")


RISK = ("annualized_vol", "max_drawdown", "var_95_daily", "cvar_95_daily", "worst_single_day", "beta_to_benchmark",
        "max_60d_correlation", "avg_gross_exposure", "max_gross_exposure", "annual_turnover",
        "concentration_hhi_median", "concentration_hhi_worst")


def regime_table(df: DataFrame, flags: list[str], keys=("symbol",), ts: str = "ts") -> DataFrame:
    """Per flag and level (and over all rows): n, Sharpe, drawdown of the segment path, total return."""
    pieces = F.explode(F.array(
        F.struct(F.lit("all").alias("regime"), F.lit("all").alias("level")),
        *[F.struct(F.lit(f).alias("regime"), F.col(f).cast("string").alias("level")) for f in flags]))
    x = df.withColumn("_p", pieces).withColumns({"regime": F.col("_p.regime"), "level": F.col("_p.level")})
    x = x.where("level IS NOT NULL")
    by = [*keys, "regime", "level"]
    return with_path(x, by, "net", ts).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), sharpe("net").alias("sharpe"), F.min("drawdown").alias("max_dd"),
        total_return("net").alias("total_return"))


def quartile_of_rank(rank: Column, n: Column, bins: int = 4) -> Column:
    """Bin of a 1-based rank when ranks are cut at even quantiles (lowest bin closed)."""
    return F.greatest(F.ceil(F.lit(bins) * (rank - 1) / (n - 1)) - 1, F.lit(0)).cast("int")


def auc(df: DataFrame, label: str, score: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """ROC AUC per group from rank sums with ties at half weight.

    Rows are first counted per distinct score, and score ranges (cut at the
    group's own quantiles) are summed before the running count, so no task orders
    a whole group, however narrow its scores are.
    """
    cuts = df.withColumn("_one", F.lit(1)).groupBy("_one", *keys).agg(
        F.array_distinct(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], 10_000)).alias("_cuts"))
    counts = df.groupBy(*keys, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    counts = counts.withColumn("_one", F.lit(1)).join(cuts, ["_one", *keys]).withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c <= F.col("_score")))).drop("_one", "_cuts")
    blocks = counts.groupBy(*keys, "_b").agg(F.sum("_neg").alias("_bn"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_bn").over(before), F.lit(0))).drop("_bn")
    inside = Window.partitionBy(*keys, "_b").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    x = counts.withColumn("_in", F.coalesce(F.sum("_neg").over(inside), F.lit(0))).join(blocks, [*keys, "_b"])
    wins = F.sum(F.col("_pos") * (F.col("_start") + F.col("_in") + F.col("_neg") / 2.0))
    return x.groupBy(*keys).agg(
        safe_div(wins, F.sum("_pos") * F.sum("_neg").cast("double")).alias("auc"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))


def exact_quantile(df: DataFrame, value: str, q: float, keys: list[str], name: str = "quantile") -> DataFrame:
    """Interpolated quantile of values from 0 up per group, and their number ``n``, without a buffer of a whole group.

    Values are counted in ranges 1/256 of a power of two wide; only the ranges that hold the two ranks around the
    quantile are ordered.
    """
    x = df.where(F.col(value) >= 0).select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_one"))
    x = x.withColumn("_b", F.coalesce(F.floor(F.log2("_v") * 256), F.lit(-1 << 40)))
    by = ["_one", *keys]
    ranges = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy("_b")
    ranges = ranges.withColumns({"_before": F.sum("_c").over(w) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    at = (F.col("_n") - 1) * q
    ranges = ranges.withColumns({"_lo": F.floor(at), "_hi": F.ceil(at), "_part": at - F.floor(at)})
    inside = lambda r: (F.col(r) >= F.col("_before")) & (F.col(r) < F.col("_before") + F.col("_c"))
    near = x.join(ranges.where(inside("_lo") | inside("_hi")), [*by, "_b"])
    near = near.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_v")) - 1)
    ends = near.groupBy(*by).agg(F.max(F.when(F.col("_r") == F.col("_lo"), F.col("_v"))).alias("_a"), F.max(F.when(F.col("_r") == F.col("_hi"), F.col("_v"))).alias("_z"),
                                 F.first("_part").alias("_part"), F.first("_n").alias("n"))
    return ends.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_part")).alias(name), "n")
