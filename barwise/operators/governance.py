"""Registry, search ledger, promotion gates and paper evidence as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.rolling import safe_div
from barwise.functions.scan import ROWS_PER_CHUNK, prefix


@dataclass(frozen=True)
class GateConfig:
    min_median_sharpe: float = 0.0
    min_mean_sharpe: float = 0.0
    max_drawdown: float = -0.50
    min_boot_prob: float = 0.60
    min_percentile: float = 0.95
    max_adjusted_p: float = 0.10
    min_placebo_runs: int = 20
    max_fold_share: float = 0.60
    max_turnover: float = 60.0
    correction: str = "none"
    max_family_searches: int = 1


def stress_survival(stress: DataFrame, keys, fee_level: float = 10.0, delay_level: int = 1) -> DataFrame:
    """Positive Sharpe at every stressed fee and delay; no stressed row means not survived."""
    fee, lag = F.col("fee_bps") >= fee_level, F.col("delay") >= delay_level
    good = F.coalesce(F.col("sharpe") > 0, F.lit(False))
    flag = lambda c: (F.count_if(c) > 0) & (F.count_if(c & ~good) == 0)
    return stress.groupBy(*keys).agg(flag(fee).alias("survives_cost"), flag(lag).alias("survives_delay"))


def gate_checks(evidence: DataFrame, cfg: GateConfig = GateConfig(), key: str = "experiment") -> DataFrame:
    """(experiment, gate, passed) from one evidence row each; unknown evidence never passes."""
    c = F.col
    def family_gate(name: str, ok: Column) -> Column:
        return F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed"))
    within_cap = c("family_searches") <= cfg.max_family_searches
    if cfg.correction != "none":
        alpha = cfg.max_adjusted_p / F.greatest(c("family_searches"), F.lit(1))
        family = (F.when(c("family_searches") == 0, family_gate("family_history_mandatory", F.lit(False)))
                  .when(~within_cap, family_gate("family_search_within_cap", F.lit(False)))
                  .otherwise(family_gate("family_selection_corrected", c("adjusted_p") <= alpha)))
    else:
        family = family_gate("family_search_within_cap", within_cap)
    rules: dict[str, Column] = {
        "median_sharpe_positive": c("median_sharpe") > cfg.min_median_sharpe,
        "mean_sharpe_positive": c("mean_sharpe") > cfg.min_mean_sharpe,
        "drawdown_within_limit": c("full_max_dd") >= cfg.max_drawdown,
        "cost_stress_survives": c("survives_cost"), "delay_stress_survives": c("survives_delay"),
        "bootstrap_positive": c("positive_prob") >= cfg.min_boot_prob,
        "placebo_separates": (c("percentile") >= cfg.min_percentile) & (c("adjusted_p") <= cfg.max_adjusted_p),
        "placebo_sample_adequate": c("placebo_runs") >= cfg.min_placebo_runs,
        "not_single_fold": c("single_fold_share") <= cfg.max_fold_share,
        "turnover_plausible": c("annual_turnover") <= cfg.max_turnover,
        "data_integrity": c("integrity_ok"), "lookahead_resolved": c("lookahead_ok"), "trials_recorded": c("trials") >= 1}
    cells = [F.struct(F.lit(n).alias("gate"), r.alias("passed")) for n, r in rules.items()]
    x = evidence.withColumn("_g", F.explode(F.array(*cells, family)))
    return x.select(key, F.col("_g.gate").alias("gate"), F.coalesce(F.col("_g.passed"), F.lit(False)).alias("passed"))


def decide(checks: DataFrame, key: str = "experiment") -> DataFrame:
    names = lambda ok: F.array_join(F.sort_array(F.collect_list(F.when(F.col("passed") == ok, F.col("gate")))), ",")
    return checks.groupBy(key).agg(
        F.when(F.bool_and("passed"), "CANDIDATE").otherwise("RESEARCH_ONLY").alias("decision"),
        names(False).alias("failed_gates"), names(True).alias("passed_gates"))


def search_class(trials: Column) -> Column:
    return F.when(trials <= 1, "single").when(trials <= 48, "bounded").otherwise("broad")


def leaderboard(records: DataFrame) -> DataFrame:
    """Flat columns of nested experiment records with the size class of their search."""
    return records.select(
        "experiment_id", "strategy", "target", F.array_join("features", ",").alias("features"), "trials", "promotion_state",
        F.col("net_metrics.total").alias("net_total"), F.col("gross_metrics.total").alias("gross_total"),
        F.col("oos_metrics.bars").alias("bars"), F.col("oos_metrics.turnover").alias("turnover"),
        F.element_at("bootstrap_interval", 1).alias("boot_low"), F.element_at("bootstrap_interval", 2).alias("boot_high"),
        search_class(F.col("trials")).alias("search_class"))


def attempts(ledger: DataFrame) -> DataFrame:
    """Per family: attempts = distinct linked ids plus unlinked outcomes, starts, searches, unresolved starts."""
    starts = ledger.where("stage = 'started'").select("family_id", "attempt_id", F.lit(1).alias("s")).distinct()
    done = ledger.where("stage <> 'started'").select("family_id", "attempt_id", F.lit(1).alias("d"))
    linked = done.where("attempt_id IS NOT NULL").distinct()
    x = starts.join(linked, ["family_id", "attempt_id"], "full_outer").groupBy("family_id").agg(
        F.count(F.lit(1)).alias("linked"), F.count("s").alias("started"), F.count_if(F.col("d").isNull()).alias("unresolved"))
    y = ledger.groupBy("family_id").agg(F.count_if((F.col("stage") != "started") & F.col("attempt_id").isNull()).alias("unlinked"),
                                        F.count_if(F.col("stage") == "completed").alias("searches"))
    return y.join(x, "family_id", "left").na.fill(0).select(
        "family_id", (F.col("linked") + F.col("unlinked")).alias("attempts"), "started", "unresolved", "searches")


def unused_windows(requested: DataFrame, claims: DataFrame) -> DataFrame:
    """Requests whose (dataset, test window) was never claimed before."""
    return requested.join(claims.select("dataset_hash", "test_window").distinct(), ["dataset_hash", "test_window"], "left_anti")


def trial_counts(ledger: DataFrame, order: str = "seq", width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Cumulative trials per family and rows recorded below the high-water mark; ``order`` numbers the rows of a family."""
    x = prefix(ledger, ["family_id"], order, {"high_water": ("recorded", "max"), "_before": ("n_trials", "sum")}, width)
    return x.withColumns({"total": F.coalesce("_before", F.lit(0)) + F.col("n_trials"),
                          "violation": F.coalesce(F.col("recorded") < F.col("high_water"), F.lit(False))}).drop("_before")


def paper_evidence(steps: DataFrame, calendar: DataFrame, loss_limit: float = 0.02, days_validated: int = 5,
                   days_live: int = 60, max_breaches: int = 0, max_failures: int = 0) -> DataFrame:
    """Per account: official sessions observed, breaches, failures, drawdown, gates and state."""
    x = steps.join(calendar.select("session"), "session", "left_semi")
    y = x.groupBy("account").agg(
        F.count_distinct("session").alias("n_days"), F.count_if("breach").alias("n_breaches"),
        F.count_if(~F.col("reconciled")).alias("n_failures"), F.min("drawdown").alias("max_drawdown"))
    ok = ((F.col("n_days") >= days_validated) & (F.col("n_breaches") <= max_breaches) & (F.col("n_failures") <= max_failures)
          & (F.col("max_drawdown") >= -loss_limit))
    return y.withColumns({"all_gates": ok, "state": F.when(ok & (F.col("n_days") >= days_live), "LIVE_ELIGIBLE").when(
        ok, "PAPER_VALIDATED").otherwise("PAPER_READY")})


# ---- feature registry --------------------------------------------------------------

# Rows of history each feature family needs before its first value.
HISTORY = {
    "price_volume": {"mom_63": 64, "mom_252": 253, "trend_50": 50, "mean_reversion_20": 21, "rv_20": 21, "vol_ratio_10_60": 61,
                     "volume_z_20": 20, "log_dollar_volume_20": 20, "rel_strength": 2, "regime_drawdown": 60, "regime_high_vol": 1},
    "liquidity": {"amihud_1d": 2, "amihud_5d": 6, "amihud_20d": 21, "volume_imbalance": 20, "volume_shock": 20, "price_pressure": 21,
                  "pressure_lag1": 22, "pressure_lag2": 23, "pressure_lag3": 24, "liquidity_ratio": 20, "spread_proxy": 5,
                  "kyles_lambda": 6, "liquidity_innovation": 25},
}


def feature_registry(spark) -> DataFrame:
    """(source, feature, required_history, rule, version) for the registered features."""
    rows = [(s, f, n, "trailing window ending at the bar", "1") for s, fs in HISTORY.items() for f, n in fs.items()]
    return spark.createDataFrame(rows, "source string, feature string, required_history int, availability_rule string, version string")


def registry_hash(registry: DataFrame, keys=("source",)) -> DataFrame:
    text = F.concat_ws("|", "feature", F.col("required_history").cast("string"), "availability_rule", "version")
    return registry.groupBy(*keys).agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(text)), "\n"), 256), 1, 16).alias("registry_hash"),
                                       F.count(F.lit(1)).alias("n_features"))


def first_values(features: DataFrame, names: list[str], keys=("symbol",), ts: str = "ts") -> DataFrame:
    """Row number of the first value of every feature per series, to hold against the registry."""
    w = Window.partitionBy(*keys).orderBy(ts)
    x = features.withColumn("_n", F.row_number().over(w))
    wide = x.groupBy(*keys).agg(*[F.min(F.when(F.col(n).isNotNull(), F.col("_n"))).alias(n) for n in names])
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("first_row")) for n in names]))
    return wide.select(*keys, cells.alias("c")).select(*keys, "c.feature", "c.first_row")


def assemble_panel(index: DataFrame, sources: dict[str, DataFrame], select: list[str] | None = None, exclude=(), contract: dict | None = None,
                   keys=("symbol", "ts")) -> DataFrame:
    """Features of the selected sources on the rows of ``index``, by one equi-join per source.

    Names must be registered for their source in ``contract`` (``HISTORY`` by default), unique over the sources,
    and excluded names must exist; anything else is an error.
    """
    contract, keys = HISTORY if contract is None else contract, list(keys)
    chosen = list(sources) if select is None else list(select)
    if unknown := [s for s in chosen if s not in sources or s not in contract]:
        raise ValueError(f"unknown sources {unknown}")
    names = {s: [c for c in sources[s].columns if c not in keys] for s in chosen}
    every = [n for own in names.values() for n in own]
    if unregistered := sorted(n for s, own in names.items() for n in own if n not in contract[s]):
        raise ValueError(f"features outside the contract {unregistered}")
    if repeated := sorted({n for n in every if every.count(n) > 1}):
        raise ValueError(f"features of several sources {repeated}")
    if absent := sorted(set(exclude) - set(every)):
        raise ValueError(f"excluded features that no source has {absent}")
    panel = index.select(*keys)
    for s in chosen:
        panel = panel.join(sources[s].select(*keys, *[n for n in names[s] if n not in exclude]), keys, "left")
    return panel
