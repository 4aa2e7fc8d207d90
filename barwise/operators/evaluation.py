"""Walk-forward folds, fold ledgers, candidate selection and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.rolling import Rolling, safe_div
from barwise.operators import backtest as bt
from barwise.operators import metrics as mt


@dataclass(frozen=True)
class FoldConfig:
    train: int = 1260
    val: int = 252
    test: int = 252
    step: int = 252
    purge: int = 5
    embargo: int = 5
    expanding: bool = True

    def __post_init__(self):
        if self.step > self.test or min(self.train, self.val, self.test, self.step) < 1 or min(self.purge, self.embargo) < 0:
            raise ValueError("fold windows must be positive and step must not exceed test")


def fold_plan(n: int, cfg: FoldConfig = FoldConfig()) -> list[dict]:
    """[train][purge][validation][embargo][test] bounds per fold, half-open, over n sessions.

    At most n / step rows; the only thing the driver holds.
    """
    start = cfg.train + cfg.purge + cfg.val + cfg.embargo
    if n < start + cfg.test:
        raise ValueError(f"index too short for one fold: {n} bars, {start + cfg.test} needed")
    plan = []
    for i, test_lo in enumerate(range(start, n - cfg.test + 1, cfg.step)):
        val_lo = test_lo - cfg.embargo - cfg.val
        train_hi = val_lo - cfg.purge
        plan.append(dict(fold=i + 1, train_lo=0 if cfg.expanding else train_hi - cfg.train, train_hi=train_hi,
                         val_lo=val_lo, val_hi=val_lo + cfg.val, test_lo=test_lo, test_hi=test_lo + cfg.test))
    return plan


def label_folds(df: DataFrame, plan: list[dict], position: str = "session_no", splits=("train", "val", "test")) -> DataFrame:
    """One row per (row, fold, split) it belongs to, by exploding matching bounds: no join, no shuffle."""
    hits = F.array_compact(F.array(*[
        F.when((F.col(position) >= p[f"{s}_lo"]) & (F.col(position) < p[f"{s}_hi"]),
               F.struct(F.lit(p["fold"]).alias("fold"), F.lit(s).alias("split")))
        for p in plan for s in splits]))
    return df.withColumn("_f", F.explode(hits)).withColumns({"fold": F.col("_f.fold"), "split": F.col("_f.split")}).drop("_f")


def freeze_test(labelled: DataFrame, dataset_id: str, config_id: str, ts: str = "ts") -> DataFrame:
    """Lock row per fold: hash of the full test membership with its data set and configuration."""
    days = labelled.where("split = 'test'").groupBy("fold").agg(
        F.sort_array(F.collect_set(F.date_format(ts, "yyyy-MM-dd"))).alias("d"))
    return days.select("fold", F.size("d").alias("n_test"), F.sha2(F.array_join("d", ","), 256).alias("test_hash"),
                       F.lit(dataset_id).alias("dataset_id"), F.lit(config_id).alias("config_id"))


def verify_test(lock: DataFrame, now: DataFrame) -> DataFrame:
    """Folds whose membership, data set or configuration differs from the lock (or is malformed)."""
    a, b = lock.alias("a"), now.alias("b")
    x = a.join(b, "fold", "full_outer")
    reason = F.when(F.col("a.test_hash").isNull() | (F.length("a.test_hash") != 64), "malformed_or_missing_lock").when(
        F.col("b.test_hash").isNull(), "fold_missing").when(
        ~F.col("a.test_hash").eqNullSafe(F.col("b.test_hash")), "test_membership").when(
        ~F.col("a.dataset_id").eqNullSafe(F.col("b.dataset_id")), "dataset").when(
        ~F.col("a.config_id").eqNullSafe(F.col("b.config_id")), "configuration")
    return x.select("fold", reason.alias("violation")).where("violation IS NOT NULL")


def ledger(df: DataFrame, keys, cfg: bt.Execution = bt.Execution(), ts: str = "ts") -> DataFrame:
    """Ledger from ``dir``, a precomputed ``scale`` and ``fwd_ret``; the path restarts per key."""
    s = Rolling(tuple(keys), ts)
    x = df.withColumn("staged", s.lag("dir", bt.EXECUTION_LAG + cfg.delay))
    return bt.price(x, cfg, keys, ts)


def choose_threshold(val: DataFrame, candidates: list[float], keys, cfg: bt.Execution = bt.Execution(), score: str = "p",
                     ts: str = "ts") -> DataFrame:
    """Best threshold per key on validation rows: Sharpe, then drawdown; the middle one when none trades."""
    keys = list(keys)
    grid = F.explode(F.array(*[F.lit(float(t)) for t in candidates]))
    x = val.withColumn("threshold", grid)
    x = x.withColumn("dir", F.when(F.col(score) > F.col("threshold"), 1.0).otherwise(0.0))
    m = mt.metric_block(ledger(x, [*keys, "threshold"], cfg, ts), [*keys, "threshold"], ts)
    middle = float(candidates[len(candidates) // 2])
    ok = F.col("sharpe").isNotNull() & (F.col("trade_count") > 0)
    # Scores are compared at 12 digits, so equal paths tie whatever the summation order.
    rank = F.struct(F.round("sharpe", 12).alias("s"), F.round("max_dd", 12).alias("d"), (-F.col("threshold")).alias("t"))
    best = F.max_by("threshold", F.when(ok, rank))
    return m.groupBy(*keys).agg(F.coalesce(best, F.lit(middle)).alias("threshold"))


def best_candidate(scores: DataFrame, keys, candidate: str = "candidate", score: str = "sharpe") -> DataFrame:
    """Highest finite score per key; missing scores last, ties to the lower candidate."""
    order = F.struct(F.col(score).isNotNull().alias("has"), F.round(F.coalesce(F.col(score), F.lit(0.0)), 12).alias("s"), (-F.col(candidate)).alias("c"))
    return scores.groupBy(*keys).agg(F.max_by(candidate, order).alias(candidate), F.max_by(score, order).alias(score))


def summarise_folds(folds: DataFrame, keys) -> DataFrame:
    """Experiment summary from one row per (keys, fold) with sharpe, max_dd, trade_count."""
    pos = F.greatest(F.coalesce("sharpe", F.lit(0.0)), F.lit(0.0))
    return folds.groupBy(*keys).agg(
        F.avg("sharpe").alias("mean_sharpe"), F.percentile("sharpe", F.lit(0.5)).alias("median_sharpe"),
        F.min("max_dd").alias("worst_dd"), F.sum("trade_count").alias("trades"),
        F.count_if(F.col("sharpe") > 0).alias("positive_folds"), F.count(F.lit(1)).alias("n_folds"),
        safe_div(F.max(pos), F.sum(pos)).alias("single_fold_share"))


def candidate_catalogue(groups: list[dict[str, list]]) -> list[dict]:
    """Deterministic grid: the products of each group's value lists, numbered in order."""
    from itertools import product
    rows = []
    for g in groups:
        names = list(g)
        for values in product(*[g[n] for n in names]):
            rows.append({"candidate": len(rows), **dict(zip(names, values))})
    return rows


# ---- stress of inputs ------------------------------------------------------------

def mix(*parts, seed: int = 0, modulus: int = 1_000_003):
    """Small integer hash both Spark and SQL can evaluate: position, run and seed to [0, modulus)."""
    total = F.lit(seed * 1_299_709 % modulus).cast("long")
    for i, p in enumerate(parts):
        total = total + F.col(p).cast("long") % modulus * F.lit((7_919, 104_729, 15_485_863)[i] % modulus)
    x = total % modulus
    y = (x * x + x * 31 + 17) % modulus
    return (y * y + y * 101 + x) % modulus


def mask_cells(df: DataFrame, columns: list[str], share: float, position: str, seed: int = 0) -> DataFrame:
    """Null a fixed pseudo-random share of the cells of some columns; rows and time stay."""
    x = df
    for i, c in enumerate(columns):
        x = x.withColumn(c, F.when(mix(position, seed=seed + i) >= int(share * 1_000_003), F.col(c)))
    return x


def history_delta(before: DataFrame, after: DataFrame, columns: list[str], keys=("symbol", "ts")) -> DataFrame:
    """Largest change of any feature over shared history; a value on one side only counts as infinite."""
    a, b = before.select(*keys, *columns), after.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    x = a.join(b, list(keys), "full_outer")
    pieces = [F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNull() & F.col(f"_{c}").isNull(), 0.0).otherwise(
        F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")), F.lit(float("inf")))).alias("d")) for c in columns]
    x = x.select(F.explode(F.array(*pieces)).alias("p"))
    return x.groupBy(F.col("p.feature").alias("feature")).agg(
        F.max("p.d").alias("max_delta"), F.count(F.lit(1)).alias("checked_rows")).withColumn("passed", F.col("max_delta") < 1e-12)


def worlds_of(rows: DataFrame, later, worlds: dict[str, dict[str, Column]]) -> DataFrame:
    """``rows`` once per world in a column ``world``: "base" as they are, the others with the named columns replaced where ``later`` holds."""
    x = rows.withColumn("world", F.explode(F.array(*[F.lit(w) for w in ("base", *worlds)])))
    touched = sorted({c for cells in worlds.values() for c in cells})
    changes = {}
    for c in touched:
        value = F.col(c)
        for w, cells in worlds.items():
            if c in cells:
                value = F.when((F.col("world") == w) & later, cells[c]).otherwise(value)
        changes[c] = value
    return x.withColumns(changes)


def compare_worlds(features: DataFrame, columns: list[str], worlds: list[str], keys=("symbol", "ts"), tolerance: float = 1e-12) -> DataFrame:
    """Per world and feature: rows looked at, rows that differ from the base world, and by how much at most.

    The worlds of a row meet in one aggregation by ``keys``; a value on one side only counts as an infinite difference.
    """
    own = lambda w, c: F.max(F.when(F.col("world") == w, F.col(c))).alias(f"{w}__{c}")
    x = features.groupBy(*keys).agg(*[own(w, c) for w in ("base", *worlds) for c in columns])

    def delta(w: str, c: str) -> Column:
        a, b = F.col(f"base__{c}"), F.col(f"{w}__{c}")
        return F.when(a.isNull() & b.isNull(), 0.0).otherwise(F.coalesce(F.abs(a - b), F.lit(float("inf"))))
    cells = F.array(*[F.struct(F.lit(w).alias("dimension"), F.lit(c).alias("feature"), delta(w, c).alias("d")) for w in worlds for c in columns])
    x = x.select(F.explode(cells).alias("p")).groupBy("p.dimension", "p.feature").agg(
        F.count(F.lit(1)).alias("checked_rows"), F.count_if(F.col("p.d") > tolerance).alias("n_changed"), F.max("p.d").alias("max_delta"))
    return x.withColumn("passed", F.col("n_changed") == 0)


def leakage_audit(rows: DataFrame, build, columns: list[str], split: Column, worlds: dict[str, dict[str, Column]], ts: str = "ts") -> DataFrame:
    """Change only rows from ``split`` on, one dimension per world, and compare the features before it; all worlds in one job.

    ``build`` maps rows with a column ``world`` to features; it must treat (world, symbol) as a series and a world as a market.
    """
    made = build(worlds_of(rows, F.col(ts) >= split, worlds))
    return compare_worlds(made.where(F.col(ts) < split), columns, list(worlds), ("symbol", ts))


def event_audit(bars: DataFrame, events: DataFrame, build, columns: list[str], split: Column, ts: str = "ts") -> DataFrame:
    """The audit for dated events: from ``split`` on their content is changed in one world, in another a third is removed and a third doubled.

    ``build`` maps (bars, events) to features per symbol; worlds are told apart by a prefix of the symbol.
    """
    later = F.col("availability_time") >= split
    worlds = {"event_content": {"sentiment": -F.col("sentiment") + 0.1, "novelty": 1.0 - F.col("novelty")}, "event_add_remove": {}}
    x = worlds_of(events, later, worlds)
    moved = (F.col("world") == "event_add_remove") & later
    ids = F.when(moved & (F.col("event_id") % 3 == 0), F.array().cast("array<bigint>")).when(
        moved & (F.col("event_id") % 3 == 1), F.array(F.col("event_id").cast("long"), F.col("event_id").cast("long") + 1_000_000_007)).otherwise(
        F.array(F.col("event_id").cast("long")))
    number = F.when(F.col("world") == "base", 0).when(F.col("world") == "event_content", 1).otherwise(2)  # an event is one of its world
    x = x.withColumn("event_id", F.explode(ids)).withColumn("event_id", F.col("event_id") * 3 + number)
    x = x.withColumn("symbol", F.concat_ws("|", "world", "symbol")).drop("world")
    grid = bars.withColumn("world", F.explode(F.array(*[F.lit(w) for w in ("base", *worlds)]))).withColumn("symbol", F.concat_ws("|", "world", "symbol")).drop("world")
    made = build(grid, x).where(F.col(ts) < split)
    named = made.withColumns({"world": F.split("symbol", "[|]", 2)[0], "symbol": F.split("symbol", "[|]", 2)[1]})
    return compare_worlds(named, columns, list(worlds), ("symbol", ts), 1e-9)
