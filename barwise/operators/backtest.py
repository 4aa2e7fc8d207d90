"""Delayed close-to-close backtests as window jobs.

``fwd_ret[t]`` is close[t+1]/close[t]-1 and is earned by the position decided
``1 + delay`` bars earlier; risk scaling uses returns up to t-1 only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.rolling import Rolling, clip, safe_div

VOL_BARS = 20
EXECUTION_LAG = 1


@dataclass(frozen=True)
class Execution:
    fee_bps: float = 5.0
    slippage_bps: float = 1.0
    delay: int = 0
    target_vol: float = 0.10
    max_position: float = 1.0

    def __post_init__(self):
        numbers = (self.fee_bps, self.slippage_bps, self.target_vol, self.max_position)
        if not all(math.isfinite(v) for v in numbers) or self.delay < 0 or self.target_vol <= 0:
            raise ValueError("execution settings must be finite, with delay >= 0 and target_vol > 0")


def direction(signal: str, threshold: float | None) -> Column:
    """Raw signal, or 1/0 against a threshold (a null signal is flat)."""
    if threshold is None:
        return F.col(signal).cast("double")
    return F.when(F.col(signal) > threshold, 1.0).otherwise(0.0)


def vol_scale(risk: str, cfg: Execution, s: Rolling) -> Column:
    """target / annualised volatility of the previous 20 bars, capped, 0 while unknown."""
    vol = s.sd(risk, VOL_BARS, 1) * math.sqrt(252.0)
    return F.coalesce(clip(safe_div(F.lit(cfg.target_vol), vol), high=cfg.max_position), F.lit(0.0))


def hold_rule(df: DataFrame, wanted: str, hold: int, keys=("symbol",), ts: str = "ts", name: str = "staged",
              flat=0.0) -> DataFrame:
    """Follow ``wanted`` but change at most every ``hold`` bars (the first change is free).

    Each bar points at the bar of the next change, were it a change itself: the
    first one ``hold`` bars on or later that wants something else.  That is a
    matter of windows and runs of equal wishes; the chain of pointers from the
    first wish is followed over one array per series, which the calendar bounds.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(ts)
    x = df.withColumn("_v", F.coalesce(F.col(wanted), F.lit(flat))).withColumn("_i", F.row_number().over(w) - 1)
    ends = F.lead("_v").over(w).isNull() | (F.lead("_v").over(w) != F.col("_v"))
    x = x.withColumn("_end", F.min(F.when(ends, F.col("_i"))).over(w.rowsBetween(0, Window.unboundedFollowing)))
    later = F.lead("_v", hold).over(w)
    x = x.withColumn("_next", F.when(later != F.col("_v"), F.col("_i") + hold).otherwise(F.lead("_end", hold).over(w) + 1))
    series = x.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_next"))).alias("_p"),
                                  F.min(F.when(F.col("_v") != F.lit(flat), F.col("_i"))).alias("_at"))

    def follow(acc, _):
        to = F.get(F.col("_p")["_next"], acc["at"])
        return F.struct(to.alias("at"), F.when(to.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(to))).alias("out"))
    begin = F.struct(F.col("_at").alias("at"), F.array("_at").alias("out"))
    chain = F.aggregate(F.sequence(F.lit(1), F.ceil(F.size("_p") / hold).cast("int")), begin, follow)["out"]
    changes = series.where("_at IS NOT NULL").select(*keys, F.explode(chain).alias("_i"), F.lit(True).alias("_changed"))
    x = x.join(changes, [*keys, "_i"], "left").withColumn(
        name, F.coalesce(F.last(F.when(F.col("_changed"), F.col("_v")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(flat)))
    return x.select(*df.columns, name)


def checked_outcome(fwd: str, keys=("symbol",), ts: str = "ts") -> Column:
    """The forward return; one that is missing or infinite between the first and the last bar of its series is an error."""
    w = Window.partitionBy(*keys).orderBy(ts)
    inside = F.lag(ts).over(w).isNotNull() & F.lead(ts).over(w).isNotNull()
    broken = F.isnan(fwd) | (F.abs(fwd) == float("inf"))
    return F.when(broken | (inside & F.col(fwd).isNull()), F.raise_error(F.concat(F.lit("no finite outcome at "), F.col(ts).cast("string"))).cast("double")).otherwise(F.col(fwd))


def price(df: DataFrame, cfg: Execution, keys=("symbol",), ts: str = "ts", fwd: str = "fwd_ret") -> DataFrame:
    """Ledger columns from ``staged`` and ``scale``: position, gross, turnover, costs, net."""
    s = Rolling(tuple(keys), ts)
    m = cfg.max_position
    x = df.withColumn("position", F.coalesce(clip(F.col("staged") * F.col("scale"), -m, m), F.lit(0.0)))
    x = x.withColumns({
        "gross": F.col("position") * F.coalesce(checked_outcome(fwd, keys, ts), F.lit(0.0)),
        "turnover": F.abs(F.col("position") - F.coalesce(s.lag("position"), F.lit(0.0)))})
    return charge(x, cfg.fee_bps, cfg.slippage_bps)


def charge(ledger: DataFrame, fee_bps, slippage_bps) -> DataFrame:
    """Costs and net from turnover; the rates may be numbers or columns."""
    fee, slip = (x if isinstance(x, Column) else F.lit(float(x)) for x in (fee_bps, slippage_bps))
    return ledger.withColumns({
        "fee_cost": F.col("turnover") * fee / 10000.0, "slippage_cost": F.col("turnover") * slip / 10000.0,
        "cost": F.col("turnover") * (fee + slip) / 10000.0,
        "net": F.col("gross") - F.col("turnover") * (fee + slip) / 10000.0})


def backtest(df: DataFrame, signal: str, cfg: Execution = Execution(), threshold: float | None = None, hold: int = 1,
             keys=("symbol",), ts: str = "ts", fwd: str = "fwd_ret", risk: str = "ret") -> DataFrame:
    """One ledger per key from a signal, forward returns and observable risk returns."""
    s = Rolling(tuple(keys), ts)
    x = df.withColumn("_raw", direction(signal, threshold)).withColumn("scale", vol_scale(risk, cfg, s))
    x = x.withColumn("staged", s.lag("_raw", EXECUTION_LAG + cfg.delay))
    if hold > 1:
        x = hold_rule(x.withColumnRenamed("staged", "_want"), "_want", hold, keys, ts).drop("_want")
    return price(x, cfg, keys, ts, fwd).drop("_raw")


def backtest_legs(df: DataFrame, signal: str, leg: str, leg_returns: dict[str, str], cfg: Execution = Execution(),
                  threshold: float | None = None, hold: int = 1, keys=("strategy",), ts: str = "ts",
                  risk: str | None = None) -> DataFrame:
    """Backtest whose traded asset is chosen with the signal and held until a permitted change.

    ``leg_returns`` maps asset -> forward-return column.  Decision and leg are
    delayed together; a switch between assets is charged on both sides.
    """
    if hold < 1:
        raise ValueError("hold must be at least one bar")
    s = Rolling(tuple(keys), ts)
    known = F.col(leg).isNull() | F.col(leg).isin(list(leg_returns))
    active = F.coalesce(direction(signal, threshold), F.lit(0.0)) != 0
    want = F.when(~known, F.raise_error(F.lit("unknown leg"))).when(active, F.col(leg))
    mean_fwd = sum((F.col(c) for c in leg_returns.values()), F.lit(0.0)) / float(len(leg_returns))
    x = df.withColumn("_want0", want).withColumn("_risk", s.lag(mean_fwd) if risk is None else F.col(risk))
    x = x.withColumns({"_want": F.coalesce(s.lag("_want0", EXECUTION_LAG + cfg.delay), F.lit("")),
                       "scale": vol_scale("_risk", cfg, s)})
    x = hold_rule(x, "_want", hold, keys, ts, "held_leg", flat="")
    m = cfg.max_position
    held = F.col("held_leg") != ""
    realised = F.coalesce(*[F.when(F.col("held_leg") == a, checked_outcome(c, keys, ts)) for a, c in leg_returns.items()], F.lit(0.0))
    x = x.withColumn("position", F.when(held, clip("scale", -m, m)).otherwise(0.0)).withColumn(
        "gross", F.col("position") * realised)
    before, before_leg = F.coalesce(s.lag("position"), F.lit(0.0)), F.coalesce(s.lag("held_leg"), F.lit(""))
    switched = (before_leg != "") & held & (before_leg != F.col("held_leg"))
    x = x.withColumn("turnover", F.when(switched, F.abs(before) + F.abs("position")).otherwise(
        F.abs(F.col("position") - before)))
    return charge(x, cfg.fee_bps, cfg.slippage_bps).drop("_want0", "_want", "_risk")


def portfolio_returns(weights: DataFrame, bars: DataFrame, fee_bps: float = 5.0, slippage_bps: float = 1.0,
                      keys=(), ts: str = "ts", weight_delay: int = 0) -> DataFrame:
    """Book returns: weights (keys.., symbol, ts, w) executed one session later.

    Per-symbol lag and lead, then one partial sum per session.
    """
    s = Rolling((*keys, "symbol"), ts)
    x = weights.join(bars.select("symbol", ts, "close"), ["symbol", ts])
    x = x.withColumns({
        "_w": F.coalesce(s.lag("w", 1 + weight_delay), F.lit(0.0)),
        "_fwd": safe_div(s.lead("close"), "close") - 1.0})
    x = x.withColumn("_d", F.abs(F.col("_w") - F.coalesce(s.lag("_w"), F.lit(0.0))))
    per = x.groupBy(*keys, ts).agg(
        F.coalesce(F.sum(F.col("_w") * F.col("_fwd")), F.lit(0.0)).alias("gross"), F.sum("_d").alias("turnover"))
    return charge(per, fee_bps, slippage_bps)


def excess(book: DataFrame, cash: DataFrame, ts: str = "ts") -> DataFrame:
    """Gross and net above the forward return of a cash proxy (ts, cash_fwd)."""
    c = F.coalesce("cash_fwd", F.lit(0.0))
    return book.join(cash, ts, "left").withColumns({"net": F.col("net") - c, "gross": F.col("gross") - c}).drop("cash_fwd")


def replay(directions: DataFrame, scenarios: DataFrame | list[dict], cfg: Execution = Execution(), keys=("symbol",),
           ts: str = "ts", fwd: str = "fwd_ret", risk: str = "ret") -> DataFrame:
    """Re-price frozen directions under many cost and delay points in one job.

    ``directions`` holds ``dir`` (before any lag).  Scenarios (name, fee,
    slippage, delay) become an exploded array on each row; delays are lags of
    the same ordered series.
    """
    s = Rolling(tuple(keys), ts)
    delays = sorted({int(p["delay"]) for p in scenarios})
    x = directions.withColumns({f"_d{d}": s.lag("dir", EXECUTION_LAG + d) for d in delays})
    x = x.withColumn("scale", vol_scale(risk, cfg, s))
    points = F.array(*[F.struct(
        F.lit(p["name"]).alias("scenario"), F.lit(float(p["fee"])).alias("fee_bps"),
        F.lit(float(p["slippage"])).alias("slippage_bps"), F.lit(int(p["delay"])).alias("delay"),
        F.col(f"_d{int(p['delay'])}").alias("staged")) for p in scenarios])
    x = x.withColumn("_p", F.explode(points)).select(*[c for c in x.columns if not c.startswith("_d")], "_p.*")
    by = (*keys, "scenario")
    ledger = price(x, cfg, by, ts, fwd)
    return charge(ledger, F.col("fee_bps"), F.col("slippage_bps"))
