"""Resampling, placebo and multiple-testing statistics as grouped Spark jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.normal import norm_cdf, norm_ppf
from barwise.functions.rolling import Rolling, safe_div
from barwise.operators.evaluation import mix

ANNUAL = math.sqrt(252.0)
EULER_GAMMA = 0.5772156649015329


def bootstrap_sharpe(df: DataFrame, r: str = "net", n_boot: int = 500, block: int = 20, seed: int = 42,
                     keys=("symbol",), ts: str = "ts") -> DataFrame:
    """Sharpe of moving-block resamples per (keys, b).

    A resample is a list of blocks, and the sums of a block are differences of
    prefix sums, so each block costs two lookups instead of ``block`` rows.
    """
    keys = list(keys)
    s = Rolling(tuple(keys), ts)
    clean = df.where(F.col(r).isNotNull() & ~F.isnan(r))
    pre = clean.select(*keys, (F.row_number().over(s.order) - 1).cast("long").alias("pos"),
                       F.sum(r).over(s.so_far).alias("p1"), F.sum(F.col(r) * F.col(r)).over(s.so_far).alias("p2"))
    size = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    draws = size.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn(
        "k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))))
    draws = draws.withColumn("start", mix("b", "k", seed=seed) % F.greatest(F.col("n") - block + 1, F.lit(1)))
    length = F.least(F.lit(block), F.col("n") - F.col("k") * block)
    ends = F.array(F.struct((F.col("start") + length - 1).alias("pos"), F.lit(1.0).alias("sign")),
                   F.struct((F.col("start") - 1).alias("pos"), F.lit(-1.0).alias("sign")))
    ends = draws.select(*keys, "n", "b", F.explode(ends).alias("e")).select(*keys, "n", "b", "e.pos", "e.sign").where("pos >= 0")
    sums = ends.join(pre, [*keys, "pos"]).groupBy(*keys, "b").agg(
        F.first("n").alias("n"), F.sum(F.col("sign") * F.col("p1")).alias("s1"), F.sum(F.col("sign") * F.col("p2")).alias("s2"))
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1)
    return sums.select(*keys, "b", safe_div(F.col("s1") / F.col("n"), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("_s")).withColumn(
        "sharpe", F.col("_s") * ANNUAL).drop("_s")


def bootstrap_summary(draws: DataFrame, keys=("symbol",)) -> DataFrame:
    return draws.groupBy(*keys).agg(
        F.avg("sharpe").alias("mean"), F.percentile("sharpe", F.lit(0.025)).alias("low"),
        F.percentile("sharpe", F.lit(0.975)).alias("high"),
        (F.count_if(F.col("sharpe") > 0) / F.count("sharpe")).alias("positive_prob"), F.count(F.lit(1)).alias("n_boot"))


# ---- placebo -----------------------------------------------------------------------

def permute(df: DataFrame, columns: list[str], runs: int, keys=("symbol",), ts: str = "ts", block: int = 1,
            seed: int = 0) -> DataFrame:
    """Rows per run with ``columns`` permuted among the rows where they are all present.

    The permutation is a sort by an integer hash of (position, run); with
    ``block`` > 1 whole blocks of positions move together.  Rows without values keep theirs.
    """
    keys = list(keys)
    s = Rolling(tuple(keys), ts)
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    x = df.withColumn("_ok", ok)
    x = x.withColumn("_pos", F.when(F.col("_ok"), F.sum(F.col("_ok").cast("int")).over(s.so_far) - 1))
    x = x.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    donors = x.where("_ok").withColumn("_blk", F.floor(F.col("_pos") / block))
    w = Window.partitionBy(*keys, "run").orderBy(mix("_blk", "run", seed=seed), "_pos")
    donors = donors.select(*keys, "run", (F.row_number().over(w) - 1).alias("_pos"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    y = x.join(donors, [*keys, "run", "_pos"], "left")
    return y.withColumns({c: F.when(F.col("_ok"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).drop(
        "_ok", "_pos", *[f"_new_{c}" for c in columns])


def permute_sessions(df: DataFrame, column: str, runs: int, ts: str = "ts", seed: int = 0) -> DataFrame:
    """Move whole cross-sections of a signal between the sessions that have one, per run."""
    days = df.where(F.col(column).isNotNull()).select(ts).distinct().withColumn("_pos", F.row_number().over(Window.orderBy(ts)) - 1)
    days = days.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    w = Window.partitionBy("run").orderBy(mix("_pos", "run", seed=seed), "_pos")
    target = days.select("run", ts, "_pos")
    source = days.select("run", F.col(ts).alias("_from"), (F.row_number().over(w) - 1).alias("_pos"))
    pairs = target.join(source, ["run", "_pos"]).select("run", ts, "_from")
    donors = df.select("symbol", F.col(ts).alias("_from"), F.col(column).alias("_sig"))
    moved = pairs.join(donors, "_from").select("run", ts, "symbol", F.col("_sig").alias(column))
    base = df.drop(column).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return base.join(moved, ["run", ts, "symbol"], "left")


def placebo_statistics(null: DataFrame, observed: DataFrame, keys=("symbol",), score: str = "sharpe") -> DataFrame:
    """Position of the observed score in the null runs and its Monte-Carlo p-value."""
    x = null.select(*keys, F.col(score).alias("v")).where(F.col("v").isNotNull()).join(
        observed.select(*keys, F.col(score).alias("obs")), list(keys))
    n = F.count(F.lit(1))
    y = x.groupBy(*keys).agg(
        F.first("obs").alias("observed"), n.alias("n_runs"), (F.count_if(F.col("v") < F.col("obs")) / n).alias("percentile"),
        ((F.lit(1) + F.count_if(F.col("v") >= F.col("obs"))) / (n + 1)).alias("adjusted_p"), F.avg("v").alias("null_mean"),
        F.percentile("v", F.lit(0.5)).alias("null_median"), F.stddev_samp("v").alias("null_sd"),
        F.percentile("v", F.lit(0.95)).alias("null_p95"))
    return y.withColumn("mc_se", F.sqrt(F.col("adjusted_p") * (1 - F.col("adjusted_p")) / (F.col("n_runs") + 1)))


# ---- multiple testing ------------------------------------------------------------------

def adjust_pvalues(df: DataFrame, p: str, family: tuple[str, ...], tie: str) -> DataFrame:
    """Bonferroni, Benjamini-Hochberg and Holm adjusted p-values per family of tests."""
    up = Window.partitionBy(*family).orderBy(p, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*family))
    x = df.withColumns({"_r": F.row_number().over(up), "_n": n})
    from_end = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.lit(1.0)
    return x.withColumns({
        "bonferroni": F.least(one, F.col(p) * F.col("_n")),
        "bh": F.least(one, F.min(F.col(p) * F.col("_n") / F.col("_r")).over(from_end)),
        "holm": F.least(one, F.max(F.col(p) * (F.col("_n") - F.col("_r") + 1)).over(so_far))}).drop("_r", "_n")


def expected_max_sharpe(n_trials: Column, n_obs: Column, variance: Column | None = None) -> Column:
    """Expected best per-period Sharpe of independent noise trials."""
    default = F.lit(1.0) / (n_obs - 1)
    v = default if variance is None else F.coalesce(F.when(variance > 0, variance), default)
    n = F.greatest(n_trials.cast("double"), F.lit(2.0))
    z1, z2 = norm_ppf(F.lit(1.0) - F.lit(1.0) / n), norm_ppf(F.lit(1.0) - F.lit(1.0) / (n * math.e))
    value = F.sqrt(v) * ((1.0 - EULER_GAMMA) * z1 + EULER_GAMMA * z2)
    return F.when((n_trials < 1) | (n_obs < 2), None).when(n_trials == 1, 0.0).otherwise(value)


def deflated_sharpe_pvalue(sharpe: Column, n_trials: Column, n_obs: Column, skew: Column, kurt: Column,
                           variance: Column | None = None) -> Column:
    """Probability of the annualised Sharpe without an edge after ``n_trials`` attempts (kurt is not excess)."""
    sr = sharpe / ANNUAL
    term = F.greatest(F.lit(1.0) - skew * sr + (kurt - 1.0) / 4.0 * sr * sr, F.lit(1e-12))
    own = term / (n_obs - 1)
    v = own if variance is None else F.coalesce(F.when(variance > 0, variance), own)
    t = F.sqrt((n_obs - 1).cast("double")) * (sr - expected_max_sharpe(n_trials, n_obs, v)) / F.sqrt(term)
    return F.lit(1.0) - norm_cdf(t)  # each normal function binds its argument once


SPLITS_PER_ROW = 4096  # halves that one row is exploded to


def half_mask(rank: Column, n: int) -> Column:
    """The ``rank``-th of the C(n, n / 2) halves of n folds as a bit mask, by the combinatorial number system.

    From the highest fold down: fold c belongs to the half when rank is at least C(c, k), with k members still to place.
    """
    ways = F.array(*[F.array(*[F.lit(math.comb(c, k)).cast("long") for k in range(n // 2 + 1)]) for c in range(n)])

    def place(st, c):
        below = F.get(F.get(ways, c), st["k"])
        taken = (st["k"] > 0) & (st["rank"] >= below)
        return F.struct(F.when(taken, st["rank"] - below).otherwise(st["rank"]).alias("rank"), (st["k"] - taken.cast("int")).alias("k"),
                        F.when(taken, st["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c))).otherwise(st["mask"]).alias("mask"))
    begin = F.struct(rank.cast("long").alias("rank"), F.lit(n // 2).alias("k"), F.lit(0).cast("long").alias("mask"))
    return F.aggregate(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), begin, place)["mask"]


def overfitting_probability(matrix: DataFrame, n_folds: int, variant: str = "variant", fold: str = "fold_no",
                            score: str = "sharpe", keys=()) -> DataFrame:
    """Share of all C(n, n / 2) fold halves whose in-sample winner lands in the worse half out of sample.

    ``matrix``: one row per (keys, variant, fold 0..n-1); the variants of a key with their fold scores make one row.
    It is exploded to ranges of halves, the ranges are dealt over the tasks, and each half is counted out from its rank
    there: no list of halves exists anywhere, and only the verdicts are summed up.
    """
    keys = list(keys)
    if n_folds < 4:
        return matrix.groupBy(*keys).agg(F.lit(None).cast("double").alias("pbo"), F.lit(0).cast("long").alias("n_splits"))
    checked = F.when(F.col(score).isNull() | F.isnan(score), F.raise_error(F.lit("fold scores must be finite")).cast("double")).otherwise(F.col(score))
    per = matrix.withColumn("_v", checked).groupBy(*keys, variant).agg(F.sort_array(F.collect_list(F.struct(F.col(fold).cast("int").alias("f"), F.col("_v").alias("v")))).alias("s"))
    per = per.groupBy(*keys).agg(F.collect_list(F.struct((-F.col(variant)).alias("t"), F.col("s").alias("s"))).alias("_m"))
    total = math.comb(n_folds, n_folds // 2)
    dealt = per.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((total - 1) // SPLITS_PER_ROW)))).repartition(*keys, "_b")
    first = F.col("_b").cast("long") * SPLITS_PER_ROW
    ranks = F.sequence(first, F.least(first + SPLITS_PER_ROW, F.lit(total).cast("long")) - 1)
    x = dealt.select(*keys, "_m", F.explode(ranks).alias("_rank")).withColumn("_mask", half_mask(F.col("_rank"), n_folds))

    def mean(series, inside: bool):
        bit = lambda p: F.call_function("shiftright", F.col("_mask"), p["f"]).bitwiseAND(F.lit(1).cast("long"))
        wanted = F.filter(series, lambda p: bit(p) == (1 if inside else 0))
        return F.aggregate(wanted, F.lit(0.0), lambda acc, p: acc + p["v"]) / F.size(wanted)
    x = x.withColumn("_p", F.transform("_m", lambda m: F.struct(mean(m["s"], True).alias("ins"), m["t"].alias("t"), mean(m["s"], False).alias("oos"))))
    x = x.withColumn("_best", F.array_max("_p")["oos"])  # highest in sample, then the lower variant
    worse = F.size(F.filter("_p", lambda p: p["oos"] > F.col("_best")))
    bad = safe_div(worse, F.size("_p") - 1) >= 0.5
    return x.groupBy(*keys).agg(F.avg(bad.cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_splits"))


def robustness_score(cost_ok: Column, delay_ok: Column, stability: Column, boot: Column, placebo: Column, share: Column) -> Column:
    """0.5 plus signed components, bounded to [0, 1]."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    total = (F.lit(0.5) + F.when(cost_ok, 0.25).otherwise(-0.25) + F.when(delay_ok, 0.25).otherwise(-0.25)
             + unit(stability) * 0.20 + unit(boot) * 0.15 + unit(placebo) * 0.15 - unit(share) * 0.20)
    return unit(total)
