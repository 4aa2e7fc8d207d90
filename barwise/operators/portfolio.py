"""Books of target weights from signals: limits, schedules and risk scaling.

Inputs are long rows on the calendar grid.  Cross-section steps are windows by
session (one row per symbol), holding is a window by symbol.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.rolling import Rolling, clip, safe_div
from barwise.operators.metrics import exact_quantile
from barwise.session import ensure_checkpoint_dir

WEDNESDAY = 2
TURNOVER_BLOCK = 256  # sessions of a job


def cross_zscore(df: DataFrame, columns: list[str], ts: str = "ts", suffix: str = "_xz") -> DataFrame:
    """(x - mean) / sd of each session; null where the session has no spread."""
    w = Window.partitionBy(ts)
    return df.withColumns({f"{c}{suffix}": safe_div(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)) for c in columns})


def mean_available(columns: list[str]) -> Column:
    """Mean of the non-null terms."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    seen = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return safe_div(total, seen)


def mean_signed(terms: dict[str, int]) -> Column:
    """Signed mean; null as soon as one term is null."""
    return sum((F.col(c) * float(sign) for c, sign in terms.items()), F.lit(0.0)) / float(len(terms))


def session_index(df: DataFrame, ts: str = "ts", name: str = "session_no") -> DataFrame:
    """Number sessions from 0; the distinct sessions are bounded by the calendar."""
    days = df.select(ts).distinct().withColumn(name, F.row_number().over(Window.orderBy(ts)) - 1)
    return df.join(days, ts)


def hold_targets(df: DataFrame, keys=("symbol",), ts: str = "ts", target: str = "target") -> DataFrame:
    """Carry targets to the next rebalance; flat before the first."""
    s = Rolling(tuple(keys), ts)
    return df.withColumn("w", F.coalesce(F.last(target, True).over(s.so_far), F.lit(0.0)))


def decile_book(df: DataFrame, *, long_pct: float = 10, short_pct: float = 10, max_weight: float = 0.02,
                sector_net: float = 0.10, sector_gross: float = 0.20, gross: float = 1.0, min_members: int = 20,
                every: int = 5, long_low: bool = True, neutral: bool = True, ts: str = "ts", keys=()) -> DataFrame:
    """Equal-weight low/high decile book with stock and sector caps.

    ``df`` has symbol, ts, signal, sector on the full grid; a null signal means
    not tradable that session.  Ties rank by symbol.
    """
    x = session_index(df, ts).withColumn("_rebalance", F.col("session_no") % every == 0)
    by_ts = Window.partitionBy(*keys, ts)
    valid = F.col("signal").isNotNull()
    order = Window.partitionBy(*keys, ts).orderBy(F.col("signal").asc_nulls_last(), "symbol")
    x = x.withColumns({"_rank": F.row_number().over(order), "_n": F.count("signal").over(by_ts)})

    def leg(pct):
        return F.least(F.col("_n"), F.greatest(F.lit(1), F.bround(F.col("_n") * float(pct) / 100.0).cast("long")))
    low, high = (long_pct, short_pct) if long_low else (short_pct, long_pct)
    bottom, top = valid & (F.col("_rank") <= leg(low)), valid & (F.col("_rank") > F.col("_n") - leg(high))
    is_long, is_short = (bottom, top) if long_low else (top, bottom)
    x = x.withColumn("_side", F.when(F.col("_n") < min_members, 0).when(is_long, 1).when(is_short, -1).otherwise(0))
    n_side = lambda v: F.count_if(F.col("_side") == v).over(by_ts)
    x = x.withColumns({"_nl": n_side(1), "_ns": n_side(-1)})
    leg_gross = F.when((F.col("_nl") > 0) & (F.col("_ns") > 0), gross / 2.0).otherwise(gross)
    raw = F.when(F.col("_side") == 1, leg_gross / F.col("_nl")).when(F.col("_side") == -1, -leg_gross / F.col("_ns")).otherwise(0.0)
    x = x.withColumn("_w", clip(raw, -max_weight, max_weight))
    sector = Window.partitionBy(*keys, ts, "sector")
    x = x.withColumns({"_sg": F.sum(F.abs("_w")).over(sector), "_sn": F.abs(F.sum("_w").over(sector))})
    scale = F.least(F.lit(1.0), F.when(F.col("_sg") > sector_gross, sector_gross / F.col("_sg")).otherwise(1.0),
                    F.when(F.col("_sn") > sector_net, sector_net / F.col("_sn")).otherwise(1.0))
    x = x.withColumn("_w", clip(F.col("_w") * scale, -max_weight, max_weight))
    if neutral:
        x = x.withColumns({"_ls": F.sum(F.greatest("_w", F.lit(0.0))).over(by_ts),
                           "_ss": F.sum(F.greatest(-F.col("_w"), F.lit(0.0))).over(by_ts)})
        both = (F.col("_ls") > 0) & (F.col("_ss") > 0)
        down = F.least("_ls", "_ss") / F.greatest("_ls", "_ss")
        bigger = F.when(F.col("_ls") > F.col("_ss"), F.col("_w") > 0).otherwise(F.col("_w") < 0)
        x = x.withColumn("_w", F.when(both & bigger, F.col("_w") * down).otherwise(F.col("_w")))
    x = x.withColumn("target", F.when(F.col("_rebalance"), F.col("_w")))
    return hold_targets(x, (*keys, "symbol"), ts).drop(
        "session_no", "_rebalance", "_rank", "_n", "_side", "_nl", "_ns", "_w", "_sg", "_sn", "_ls", "_ss")


def _scaled_to(cap, total: Column) -> Column:
    return F.when(total > cap, cap / total).otherwise(1.0)


def _ex_ante_vol(x: DataFrame, keys, ts: str, bars: int) -> DataFrame:
    """sqrt(252 w'Cov w) per session, as the variance of the book's trailing returns.

    Each row brings its last ``bars`` returns; summing weight * return position
    by position gives the book's path, so no covariance matrix or pair of
    symbols is formed.
    """
    live = x.where("_w <> 0")
    path = live.groupBy(*keys, ts).agg(F.array(*[F.sum(F.col("_w") * F.col("_hist")[i]) for i in range(bars)]).alias("_p"))
    mean = F.aggregate("_p", F.lit(0.0), lambda a, v: a + v) / float(bars)
    path = path.withColumn("_m", mean)
    var = F.aggregate("_p", F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))) / float(bars - 1)
    return path.select(*keys, ts, F.sqrt(var * 252.0).alias("ex_ante_vol"))


def _risk_columns(df: DataFrame, keys, ts: str, bars: int, weekday: int) -> DataFrame:
    s = Rolling((*keys, "symbol"), ts)
    x = df.withColumn("ret", s.pct_change("close"))
    w = s.rows(bars)
    full = F.count("ret").over(w) == bars
    miss = F.sum(F.col("close").isNull().cast("int")).over(s.rows(20))
    return x.withColumns({
        "_vol": F.when(full, F.stddev_samp("ret").over(w)) * math.sqrt(252.0),
        "_hist": F.when(full & (F.weekday(ts) == weekday), F.collect_list("ret").over(w)), "_missing": miss})


def inverse_vol_book(df: DataFrame, *, weekday: int = WEDNESDAY, vol_bars: int = 60, target_vol: float = 0.10,
                     gross: float = 0.50, max_weight: float = 0.15, class_cap: float = 0.40, equity_net: float = 0.20,
                     equity_class: str = "equity", min_assets: int = 12, vix_stop: float = 80.0, ts: str = "ts",
                     keys=()) -> DataFrame:
    """Weekly signed inverse-volatility book.

    ``df``: symbol, ts, close, signal, asset_class, vix (nullable) on the grid.
    Only the sign of the signal is used; caps are never re-grossed.
    """
    x = _risk_columns(df, keys, ts, vol_bars, weekday)
    week = F.weekday(ts) == weekday
    x = x.withColumn("_ok", F.col("signal").isNotNull() & (F.col("_vol") > 0))
    by = Window.partitionBy(*keys, ts)
    x = x.withColumns({"_n": F.count_if("_ok").over(by), "_inv": F.when(F.col("_ok"), F.signum("signal") / F.col("_vol")).otherwise(0.0)})
    live = (F.col("_n") >= min_assets) & ~F.coalesce(F.col("vix") > vix_stop, F.lit(False))
    book = x.where(week).withColumn("_g", F.sum(F.abs("_inv")).over(by))
    book = book.withColumn("_w", F.coalesce(clip(F.when(live, safe_div(F.col("_inv") * gross, "_g")), -max_weight, max_weight), F.lit(0.0)))
    group = Window.partitionBy(*keys, ts, "asset_class")
    book = book.withColumn("_w", F.col("_w") * _scaled_to(class_cap, F.sum(F.abs("_w")).over(group)))
    equity = F.col("asset_class") == equity_class
    net = F.abs(F.sum(F.when(equity, F.col("_w")).otherwise(0.0)).over(by))
    book = book.withColumn("_w", F.when(equity, F.col("_w") * _scaled_to(equity_net, net)).otherwise(F.col("_w")))
    book = book.join(_ex_ante_vol(book, keys, ts, vol_bars), [*keys, ts], "left")
    scale = F.coalesce(_scaled_to(target_vol, F.col("ex_ante_vol")), F.lit(1.0))
    book = book.select(*keys, "symbol", ts, (F.col("_w") * scale).alias("target"))
    return hold_targets(df.join(book, [*keys, "symbol", ts], "left"), (*keys, "symbol"), ts)


# Gross caps per asset class of the magnitude book.
CLASS_CAPS = {"us_equity": 0.50, "international_equity": 0.30, "fixed_income": 0.40, "commodity": 0.20}


def magnitude_book(df: DataFrame, *, class_caps: dict[str, float] = CLASS_CAPS, weekday: int = WEDNESDAY,
                   vol_bars: int = 60, position_vol: float = 0.08, target_vol: float = 0.10, gross_cap: float = 1.0,
                   net_cap: float = 0.40, max_weight: float = 0.12, min_assets: int = 12, vix_level: float = 75.0,
                   vix_gross: float = 0.30, max_missing: int = 5, turnover_cap: float = 8.0,
                   turnover_scale: float = 0.70, ts: str = "ts", keys=()) -> DataFrame:
    """Weekly book sized by signal / volatility with class, gross, net, risk and turnover limits."""
    x = _risk_columns(df, keys, ts, vol_bars, weekday)
    by = Window.partitionBy(*keys, ts)
    x = x.where(F.weekday(ts) == weekday)
    x = x.withColumn("_ok", F.col("signal").isNotNull() & F.col("_vol").isNotNull() & (F.col("_missing") <= max_missing))
    x = x.withColumn("_n", F.count_if("_ok").over(by))
    raw = F.when(F.col("_ok") & (F.col("_n") >= min_assets), F.col("signal") * safe_div(F.lit(position_vol), "_vol"))
    x = x.withColumn("_w", F.coalesce(clip(raw, -max_weight, max_weight), F.lit(0.0)))
    cap = F.create_map(*[F.lit(v) for kv in class_caps.items() for v in kv])[F.col("asset_class")]
    group = Window.partitionBy(*keys, ts, "asset_class")
    total = F.sum(F.abs("_w")).over(group)
    x = x.withColumn("_w", F.col("_w") * F.when(total > cap, cap / total).otherwise(1.0))
    x = x.withColumn("_w", F.col("_w") * _scaled_to(gross_cap, F.sum(F.abs("_w")).over(by)))
    x = x.withColumn("_w", F.col("_w") * _scaled_to(net_cap, F.abs(F.sum("_w").over(by))))
    x = x.join(_ex_ante_vol(x, keys, ts, vol_bars), [*keys, ts], "left")
    x = x.withColumn("_w", F.col("_w") * F.coalesce(_scaled_to(target_vol, F.col("ex_ante_vol")), F.lit(1.0)))
    stressed = F.coalesce(F.col("vix") > vix_level, F.lit(False))
    x = x.withColumn("_w", F.when(stressed, F.col("_w") * _scaled_to(vix_gross, F.sum(F.abs("_w")).over(by))).otherwise(F.col("_w")))
    scale = _turnover_states(x, keys, ts, turnover_cap, turnover_scale)
    x = x.join(scale, [*keys, ts]).select(*keys, "symbol", ts, (F.col("_w") * F.col("_scale")).alias("target"))
    return hold_targets(df.join(x, [*keys, "symbol", ts], "left"), (*keys, "symbol"), ts)


def _turnover_states(x: DataFrame, keys, ts: str, cap: float, scale: float) -> DataFrame:
    """Scale of each weekly book when a too-large change against the last adjusted book is cut.

    The last book was kept (1) or cut (scale), so each week is a map on two
    states: it forces one state, keeps the state or swaps it.  The state is the
    last forced one flipped by the parity of swaps since; three windows, no loop.
    """
    s = Rolling((*keys, "symbol"), ts)
    prev = F.coalesce(s.lag("_w"), F.lit(0.0))
    per = x.withColumns({"_a": F.abs(F.col("_w") - prev), "_b": F.abs(F.col("_w") - prev * scale)}).groupBy(*keys, ts).agg(
        (0.5 * 52.0 * F.sum("_a") > cap).alias("from_kept"), (0.5 * 52.0 * F.sum("_b") > cap).alias("from_cut"))
    p = Rolling(tuple(keys), ts) if keys else Rolling(("_all",), ts)
    per = per if keys else per.withColumn("_all", F.lit(0))
    forced = F.col("from_kept") == F.col("from_cut")
    swap = F.col("from_kept") & ~F.col("from_cut")
    per = per.withColumn("_swaps", F.sum(swap.cast("int")).over(p.so_far))
    per = per.withColumns({
        "_base": F.coalesce(F.last(F.when(forced, F.col("from_kept").cast("int")), True).over(p.so_far), F.lit(0)),
        "_since": F.col("_swaps") - F.coalesce(F.last(F.when(forced, F.col("_swaps")), True).over(p.so_far), F.lit(0))})
    cut = (F.col("_base") + F.col("_since")) % 2 == 1
    return per.select(*keys, ts, F.when(cut, scale).otherwise(1.0).alias("_scale"))


def position_limits(weights: DataFrame, max_weight: float = 0.40, max_gross: float = 1.0, keys=("ts",)) -> DataFrame:
    w = Window.partitionBy(*keys)
    x = weights.withColumn("w", clip("w", -max_weight, max_weight))
    return x.withColumn("w", F.col("w") * _scaled_to(max_gross, F.sum(F.abs("w")).over(w)))


def turnover_control(weights: DataFrame, max_daily: float = 0.20, keys=("strategy",), ts: str = "ts", block: int = TURNOVER_BLOCK) -> DataFrame:
    """Move at most ``max_daily`` of total weight per session toward the target book.

    The step of a session depends on the adjusted book before it, summed over
    symbols, so sessions follow one another.  They are taken in blocks of
    ``block``: a task folds a block of one strategy from the book at the end of
    the block before, which is carried as a table (one row per symbol).  There
    are as many jobs as blocks, whatever is limited; a task holds a block's rows
    of one strategy, and a lost one repeats its block alone.
    """
    spark, keys = weights.sparkSession, list(keys)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/turnover-{uuid.uuid4().hex}"
    base = weights.select(*keys, "symbol", ts, "w")
    # one row per session of the calendar
    place = F.row_number().over(Window.orderBy(ts)) - 1
    starts = [r[0] for r in base.select(ts).distinct().withColumn("_n", place).where(F.col("_n") % block == 0).orderBy(ts).collect()]
    numbered = reduce(lambda c, t: c + (F.col(ts) >= F.lit(t)).cast("int"), starts[1:], F.lit(0))
    base.withColumn("_block", numbered).write.partitionBy("_block").parquet(f"{folder}/targets")
    fields = base.schema.fields
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    targets = spark.read.schema(f"{typed}, _block int").parquet(f"{folder}/targets")

    def fold(rows: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        whole = pd.concat([carried, rows], ignore_index=True)
        names, symbols = pd.factorize(whole["symbol"])
        book = np.zeros(len(symbols))
        known = len(carried)
        book[names[:known]] = carried["w"].to_numpy()
        rows = rows.assign(_s=names[known:]).sort_values(ts, kind="stable")
        s, w, adj = rows["_s"].to_numpy(), rows["w"].to_numpy(), np.empty(len(rows))
        for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows[ts].to_numpy().astype("int64"))) + 1):
            own = s[at]
            gap = w[at] - book[own]
            moved = np.abs(gap).sum()
            book[own] = book[own] + gap * (max_daily / moved) if moved > max_daily else w[at]
            adj[at] = book[own]
        # the book at the end: one row per symbol, without a session
        of = rows.head(1) if len(rows) else carried.head(1)
        end = pd.DataFrame({**{k: of[k].iat[0] for k in keys}, "symbol": symbols, ts: pd.NaT, "w": book})
        return pd.concat([rows.assign(w=adj)[[f.name for f in fields]], end[[f.name for f in fields]]], ignore_index=True)
    carried = spark.createDataFrame([], base.schema)
    for b in range(len(starts)):
        rows = targets.where(F.col("_block") == b).drop("_block")
        done = rows.groupBy(*keys).cogroup(carried.groupBy(*keys)).applyInPandas(fold, typed)
        done.write.parquet(f"{folder}/books/part={b}")
        carried = spark.read.schema(base.schema).parquet(f"{folder}/books/part={b}").where(F.col(ts).isNull())
    if not starts:
        return base
    return spark.read.schema(f"{typed}, part int").parquet(f"{folder}/books").where(F.col(ts).isNotNull()).drop("part")


def drawdown_control(df: DataFrame, ret: str, weight: str, trigger: float = -0.10, release: float = -0.04,
                     reduced: float = 0.5, keys=("symbol",), ts: str = "ts") -> DataFrame:
    """Halve the weight after yesterday's drawdown reached the trigger, until it recovered to the release."""
    s = Rolling(tuple(keys), ts)
    x = df.withColumn("_eq", F.product(1.0 + F.coalesce(F.col(ret), F.lit(0.0))).over(s.so_far))
    x = x.withColumn("_dd", F.col("_eq") / F.greatest(F.lit(1.0), F.max("_eq").over(s.so_far)) - 1.0)
    x = x.withColumn("_prev", F.coalesce(s.lag("_dd"), F.lit(0.0)))
    mark = F.when(F.col("_prev") <= trigger, reduced).when(F.col("_prev") >= release, 1.0)
    x = x.withColumn("state", F.coalesce(F.last(mark, True).over(s.so_far), F.lit(1.0)))
    return x.withColumn("w", F.col(weight) * F.col("state")).drop("_eq", "_dd", "_prev")


def single_target(df: DataFrame, signal: str, target_vol: float = 0.10, max_position: float = 1.0, vol_bars: int = 20,
                  keys=("symbol",), ts: str = "ts") -> DataFrame:
    """Volatility target, drawdown control, clip; the rest is cash."""
    s = Rolling(tuple(keys), ts)
    vol = s.sd("ret", vol_bars, 1) * math.sqrt(252.0)
    raw = clip(safe_div(F.lit(target_vol), vol), high=max_position)
    x = df.withColumn("_base", F.coalesce(clip(F.col(signal) * raw, -max_position, max_position), F.lit(0.0)))
    x = drawdown_control(x, "ret", "_base", keys=keys, ts=ts)
    return x.withColumn("w", clip("w", -max_position, max_position)).withColumn("cash", 1.0 - F.abs("w")).drop("_base")


def limit_audit(weights: DataFrame, limits: dict[str, float], net_class: str | None = None, ts: str = "ts",
                keys=(), atol: float = 1e-10) -> DataFrame:
    """Largest weight, gross, class gross and net over all sessions against their limits."""
    a = F.abs("w")
    in_net = F.lit(True) if net_class is None else F.col("asset_class") == net_class
    per_class = weights.groupBy(*keys, ts, "asset_class").agg(
        F.max(a).alias("mw"), F.sum(a).alias("cg"), F.sum(F.when(in_net, F.col("w")).otherwise(0.0)).alias("net"))
    per = per_class.groupBy(*keys, ts).agg(F.max("mw").alias("mw"), F.sum("cg").alias("g"), F.max("cg").alias("cg"),
                                           F.abs(F.sum("net")).alias("net"))
    x = per.groupBy(*keys).agg(F.max("mw").alias("max_abs_weight"), F.max("g").alias("max_gross"),
                               F.max("cg").alias("max_class_gross"), F.max("net").alias("max_abs_net"))
    ok = F.lit(True)
    for name, cap in limits.items():
        ok = ok & (F.col(name) <= cap + atol)
    return x.withColumn("passed", ok)


def capacity_millions(weights: DataFrame, bars: DataFrame, participation: float = 0.01, ts: str = "ts", keys=()) -> DataFrame:
    """5 % quantile of the assets a book can run when trading ``participation`` of mean dollar volume."""
    s = Rolling((*keys, "symbol"), ts)
    x = weights.join(bars.select("symbol", ts, "close", "volume"), ["symbol", ts], "left")
    x = x.withColumn("_adv", s.mean(F.col("close") * F.col("volume"), 20)).withColumn("_t", F.abs(F.col("w") - s.lag("w")))
    cap = F.when(F.col("_t") > 1e-12, participation * F.col("_adv") / F.col("_t"))
    x = exact_quantile(x.withColumn("_cap", cap), "_cap", 0.05, list(keys))
    return x.select(*keys, (F.col("quantile") / 1e6).alias("capacity_millions"), F.col("n").alias("n_trades"))
