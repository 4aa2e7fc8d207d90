"""Price, volume and volatility features as stacked window stages.

Each function takes long bars (symbol, ts, open, high, low, close, volume) and
returns them with feature columns added.  Every stage reuses one window
partitioning, so a whole family costs a single shuffle by symbol.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.normal import norm_ppf
from barwise.functions.order_statistics import Quantile, Share, with_order_statistics
from barwise.functions.rolling import Rolling, clip, safe_div

ANNUAL = math.sqrt(252.0)


def on_grid(bars: DataFrame, grid: str = "observed", calendar: DataFrame | None = None,
            required=("open", "high", "low", "close", "volume")) -> DataFrame:
    """``observed`` drops rows with a null input; ``calendar`` keeps every session.

    On the calendar grid absent bars are null rows, so returns never bridge a gap.
    """
    if grid == "observed":
        return bars.na.drop(subset=list(required))
    if calendar is None:
        raise ValueError("the calendar grid needs a calendar")
    sessions = calendar.select(F.col("session").cast("timestamp").alias("ts"))
    # One array of session dates (bounded by the calendar) as a scalar subquery.
    days = sessions.agg(F.array_sort(F.collect_set("ts")).alias("_days")).scalar()
    full = bars.select("symbol").distinct().select("symbol", F.explode(days).alias("ts"))
    return full.join(bars, ["symbol", "ts"], "left")


def returns(bars: DataFrame, s: Rolling = Rolling()) -> DataFrame:
    return bars.withColumns({
        "ret": s.pct_change("close"),
        "log_ret": F.ln(safe_div("close", s.lag("close")))})


def momentum(bars: DataFrame, n: int, s: Rolling = Rolling(), name: str | None = None) -> DataFrame:
    return bars.withColumn(name or f"momentum_{n}", s.pct_change("close", n))


def price_volume_features(bars: DataFrame, s: Rolling = Rolling(), market: str | None = None) -> DataFrame:
    """The eleven baseline features.

    Relative strength needs the mean return of each session over all symbols (of
    the same market, where ``s`` has further keys): a small per-session aggregate joined back, not a window over one session.
    """
    x = returns(bars, s)
    market_keys = [*[k for k in s.keys if k != "symbol"], s.ts]
    mean_ret = x.groupBy(*market_keys).agg(F.avg("ret").alias("_market_ret"))
    x = x.join(mean_ret, market_keys)
    x = x.withColumns({
        "mom_63": s.pct_change("close", 63), "mom_252": s.pct_change("close", 252),
        "trend_50": safe_div("close", s.mean("close", 50)) - 1.0,
        "mean_reversion_20": -s.zscore("ret", 20),
        "rv_20": s.sd("ret", 20) * ANNUAL, "_rv_10": s.sd("ret", 10) * ANNUAL,
        "_rv_60": s.sd("ret", 60) * ANNUAL,
        "volume_z_20": s.zscore("volume", 20),
        "_dollar": s.mean(F.col("close") * F.col("volume"), 20),
        "rel_strength": F.col("ret") - F.col("_market_ret"),
        "regime_drawdown": safe_div("close", s.high("close", 60)) - 1.0})
    return x.withColumns({
        "vol_ratio_10_60": safe_div("_rv_10", "_rv_60"),
        "log_dollar_volume_20": F.when(F.col("_dollar") > 0, F.ln("_dollar")),
        "regime_high_vol": F.coalesce(
            (F.col("_rv_60") > s.quantile("_rv_60", 0.5, 252, min_obs=60)).cast("double"), F.lit(0.0)),
    }).drop("_market_ret", "_rv_10", "_rv_60", "_dollar")


BASELINE_FEATURES = ("mom_63", "mom_252", "trend_50", "mean_reversion_20", "rv_20", "vol_ratio_10_60",
                     "volume_z_20", "log_dollar_volume_20", "rel_strength", "regime_drawdown", "regime_high_vol")


def labels(bars: DataFrame, horizon: int = 1, s: Rolling = Rolling()) -> DataFrame:
    """Forward return over ``horizon`` bars and its sign label; null at the tail."""
    fwd = safe_div(s.lead("close", horizon), F.col("close")) - 1.0
    return bars.withColumn("fwd_ret", fwd).withColumn(
        "label", F.when(F.col("fwd_ret").isNotNull(), (F.col("fwd_ret") > 0).cast("int")))


def decayed_sum(df: DataFrame, columns: dict[str, str], keep: float, s: Rolling = Rolling()) -> DataFrame:
    """y_t = keep * y_{t-1} + x_t per series, without a row loop (null counts as 0).

    Summed in closed form inside blocks of rows, with the end of the two blocks
    before carried in; anything older has decayed below the smallest double.
    """
    block = int(280 / -math.log10(keep))
    before = s.order.rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("_t", F.row_number().over(s.order) - 1)
    x = x.withColumns({"_block": F.floor(F.col("_t") / block), "_p": F.col("_t") % block})
    inside = (Window.partitionBy(*s.keys, "_block").orderBy(s.ts)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keep_p = F.pow(F.lit(keep), F.col("_p").cast("double"))
    last_row = F.col("_p") == block - 1
    zero = F.lit(0.0)
    x = x.withColumns({f"_l_{d}": F.sum(F.coalesce(F.col(c), zero) / keep_p).over(inside) * keep_p for c, d in columns.items()})
    x = x.withColumns({f"_q_{d}": F.last(F.when(last_row, F.col(f"_l_{d}")), True).over(before) for d in columns.values()})
    x = x.withColumns({f"_e_{d}": F.when(last_row, F.col(f"_l_{d}") + F.coalesce(F.col(f"_q_{d}"), zero) * keep ** block)
                       for d in columns.values()})
    x = x.withColumns({d: F.col(f"_l_{d}") + F.coalesce(F.last(f"_e_{d}", True).over(before), zero) * keep_p * keep
                       for d in columns.values()})
    return x.drop("_t", "_block", "_p", *[f"_{k}_{d}" for k in "lqe" for d in columns.values()])


def recursive_mean(df: DataFrame, columns: dict[str, str], alpha: float, min_obs: int,
                   s: Rolling = Rolling()) -> DataFrame:
    """Exponentially weighted mean started at the first value (no bias adjustment).

    y_t = (1-alpha) y_{t-1} + alpha x_t.  Inputs may be null only before the
    first value of a series.
    """
    first = next(iter(columns))
    x = df.withColumn("_seen", F.count(F.col(first)).over(s.so_far))
    x = x.withColumns({f"_x_{c}": F.col(c) * F.when(F.col("_seen") == 1, 1.0).otherwise(alpha) for c in columns})
    x = decayed_sum(x, {f"_x_{c}": d for c, d in columns.items()}, 1.0 - alpha, s)
    x = x.withColumns({d: F.when(F.col("_seen") >= min_obs, F.col(d)) for d in columns.values()})
    return x.drop("_seen", *[f"_x_{c}" for c in columns])


def rsi(bars: DataFrame, n: int = 14, s: Rolling = Rolling()) -> DataFrame:
    """Wilder's relative strength index."""
    change = F.col("close") - s.lag("close")
    x = bars.withColumn("_chg", change).withColumns({
        "_gain": clip("_chg", low=0.0), "_loss": clip(-F.col("_chg"), low=0.0)})
    x = recursive_mean(x, {"_gain": "_up", "_loss": "_down"}, 1.0 / n, n, s)
    return x.withColumn(f"rsi_{n}", 100.0 - safe_div(F.lit(100.0), 1.0 + safe_div("_up", "_down"))).drop(
        "_chg", "_gain", "_loss", "_up", "_down")


def signal_extensions(bars: DataFrame, s: Rolling = Rolling()) -> DataFrame:
    """Nine further price/volume signals; refuses rows with synthetic ranges."""
    bars = reject_synthetic(bars)
    x = rsi(returns(bars, s), 14, s)
    x = x.withColumns({
        "overnight_gap": safe_div("open", s.lag("close")) - 1.0,
        "intraday_ret": safe_div("close", "open") - 1.0,
        "day_range_pos": safe_div(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
        "bollinger_20": safe_div(F.col("close") - s.mean("close", 20), 2.0 * s.sd("close", 20)),
        "pos_52w": safe_div(F.col("close") - s.low("close", 252), s.high("close", 252) - s.low("close", 252)),
        "_rv": s.sd("ret", 20) * ANNUAL,
        "_vchg": F.ln(safe_div("volume", s.lag("volume"))),
        "_illiq": safe_div(F.abs("ret"), F.col("close") * F.col("volume"))})
    return x.withColumns({
        "vol_of_vol_20": s.sd("_rv", 20), "pv_corr_20": s.corr("ret", "_vchg", 20),
        "amihud_20": s.mean("_illiq", 20)}).drop("_rv", "_vchg", "_illiq")


EXTENSION_FEATURES = ("overnight_gap", "intraday_ret", "day_range_pos", "rsi_14", "bollinger_20", "pos_52w",
                      "vol_of_vol_20", "pv_corr_20", "amihud_20")


def reject_synthetic(bars: DataFrame) -> DataFrame:
    """Fail the job on bars whose high/low were invented from the close."""
    if "synthetic_range" not in bars.columns:
        return bars
    flag = F.when(F.coalesce("synthetic_range", F.lit(False)),
                  F.raise_error(F.lit("range features refuse synthetic ranges")).cast("boolean")).otherwise(F.lit(True))
    return bars.where(flag)


def parkinson(bars: DataFrame, n: int = 20, s: Rolling = Rolling(), lagged: bool = True) -> DataFrame:
    """Range volatility over the n bars before the current one (or up to it)."""
    bars = reject_synthetic(bars)
    term = F.pow(F.ln(safe_div("high", "low")), F.lit(2.0)) / (4.0 * math.log(2.0))
    name = "parkinson_lag" if lagged else "parkinson"
    return bars.withColumn("_p", term).withColumn(
        f"{name}_{n}", F.sqrt(252.0 * s.mean("_p", n, 1 if lagged else 0))).drop("_p")


def liquidity_features(bars: DataFrame, s: Rolling = Rolling(), market_cap: str | None = None) -> DataFrame:
    x = on_grid(bars, required=("high", "low", "close", "volume"))
    x = x.withColumn("ret", s.pct_change("close")).withColumns({
        "_dv": F.col("close") * F.col("volume"), "_range": F.ln(safe_div("high", "low"))})
    x = x.withColumn("_illiq", safe_div(F.abs("ret"), "_dv")).withColumns({
        "_v20": s.mean("volume", 20), "_v5": s.mean("volume", 5)})
    x = x.withColumns({
        "amihud_1d": s.mean("_illiq", 1), "amihud_5d": s.mean("_illiq", 5), "amihud_20d": s.mean("_illiq", 20),
        "volume_imbalance": safe_div(F.signum("ret") * F.col("volume"), "_v20"),
        "volume_shock": safe_div(F.col("volume") - F.col("_v20"), s.sd("volume", 20)),
        "price_pressure": safe_div("ret", s.sd("ret", 20)) * safe_div("volume", "_v20"),
        "liquidity_ratio": safe_div("_v5", "_v20"), "spread_proxy": s.mean("_range", 5),
        "kyles_lambda": safe_div(F.abs(s.total("ret", 5)), s.total("volume", 5))})
    more = {f"pressure_lag{k}": s.lag("price_pressure", k) for k in (1, 2, 3)}
    more["liquidity_innovation"] = s.zscore("amihud_5d", 20)
    if market_cap:
        x = x.withColumn("turnover", safe_div("_dv", market_cap))
        more["turnover_5d"] = s.mean("turnover", 5)
    return x.withColumns(more).drop("_dv", "_range", "_illiq", "_v20", "_v5")


LIQUIDITY_FEATURES = ("amihud_1d", "amihud_5d", "amihud_20d", "volume_imbalance", "volume_shock", "price_pressure",
                      "pressure_lag1", "pressure_lag2", "pressure_lag3", "liquidity_ratio", "spread_proxy",
                      "kyles_lambda", "liquidity_innovation")


def volatility_features(bars: DataFrame, s: Rolling = Rolling(), vix: str | None = "vix",
                        vxn: str | None = None) -> DataFrame:
    """Volatility risk premium, regime, tail-shape and range features.

    Implied-volatility features exist only when the side series is present.
    """
    side = [c for c in (vix, vxn) if c]
    x = on_grid(bars, required=("high", "low", "close", *side))
    x = parkinson(x, 20, s, lagged=False).withColumn("ret", s.pct_change("close"))
    x = x.withColumns({f"_rv{n}": s.sd("ret", n) * ANNUAL for n in (5, 10, 20, 60)})
    x = x.withColumn("_neg", clip("ret", high=0.0))
    x = with_order_statistics(x, {"_rv_mid": Quantile("_rv20", 0.5, 252), "_rv_top": Quantile("_rv20", 0.9, 252)}, s.keys, s.ts)
    step = {
        "rv_term_5_20": safe_div("_rv5", "_rv20"), "rv_term_10_60": safe_div("_rv10", "_rv60"),
        "vol_regime_high": _above(F.col("_rv20"), F.col("_rv_mid")),
        "vol_regime_extreme": _above(F.col("_rv20"), F.col("_rv_top")),
        "vol_trend": safe_div("_rv20", s.lag("_rv20", 20)), "vol_momentum": s.pct_change("_rv20", 10),
        "vol_mean_revert": s.zscore("_rv20", 252),
        "skew_20": s.skew("ret", 20), "skew_60": s.skew("ret", 60),
        "kurt_20": s.kurt("ret", 20), "kurt_60": s.kurt("ret", 60),
        "downside_vol_20": s.sd("_neg", 20) * ANNUAL,
        "vov_10": s.sd("_rv10", 10) * ANNUAL, "vov_20": s.sd("_rv20", 20) * ANNUAL,
        "jump_signal": safe_div(F.abs("ret"), F.col("_rv5") / ANNUAL),
        "consecutive_same": F.abs(s.total(F.signum("ret"), 5)),
        "vol_acceleration": s.pct_change("parkinson_20", 5)}
    for name, col in (("vix", vix), ("vxn", vxn)):
        if col:
            step[f"vrp_{name}"] = F.col(col) - F.col("_rv20") * 100.0
    x = x.withColumns(step)
    last = {"downside_ratio": safe_div("downside_vol_20", "_rv20")}
    for name, col in (("vix", vix), ("vxn", vxn)):
        if col:
            last[f"vrp_{name}_norm"] = safe_div(f"vrp_{name}", "_rv20")
    if vix:
        last["vrp_zscore"] = s.zscore("vrp_vix", 60)
    return x.withColumns(last).drop("_rv5", "_rv10", "_rv20", "_rv60", "_neg", "_rv_mid", "_rv_top")


VOLATILITY_FEATURES = ("rv_term_5_20", "rv_term_10_60", "vrp_vix", "vrp_vix_norm", "vrp_zscore", "vol_regime_high",
                       "vol_regime_extreme", "vol_trend", "vol_momentum", "vol_mean_revert", "skew_20", "skew_60",
                       "kurt_20", "kurt_60", "downside_vol_20", "downside_ratio", "vov_10", "vov_20", "jump_signal",
                       "consecutive_same", "vol_acceleration")


def _above(x: Column, level: Column) -> Column:
    """1 above the level, 0 otherwise and while the level is not known yet."""
    return F.coalesce((x > level).cast("int"), F.lit(0))


def overnight_features(bars: DataFrame, s: Rolling = Rolling(), vix: str | None = "vix") -> DataFrame:
    x = on_grid(bars, required=("open", "high", "low", "close", "volume", *([vix] if vix else [])))
    prev = s.lag("close")
    x = x.withColumns({
        "overnight_1d": safe_div(F.col("open") - prev, prev),
        "intraday_1d": safe_div(F.col("close") - F.col("open"), F.col("open")),
        "_ret": s.pct_change("close"), "_gap": F.abs(F.col("open") - prev)})
    x = x.withColumns({
        "overnight_5d": s.mean("overnight_1d", 5), "overnight_20d": s.mean("overnight_1d", 20),
        "intraday_5d": s.mean("intraday_1d", 5),
        "overnight_vol_ratio": safe_div(s.sd("overnight_1d", 20), s.sd("_ret", 20)),
        "gap_size": F.abs("overnight_1d"), "overnight_skew": s.skew("overnight_1d", 60),
        "vix_regime": s.mean(vix, 20) if vix else F.lit(None).cast("double"),
        "fill_ratio": safe_div(F.col("high") - F.col("low"), F.col("_gap"))})
    return x.withColumns({f"{c}_lag1": s.lag(c) for c in ("overnight_20d", "overnight_5d", "intraday_5d")}).drop(
        "_ret", "_gap")


OVERNIGHT_FEATURES = ("overnight_1d", "overnight_5d", "overnight_20d", "intraday_1d", "intraday_5d",
                      "overnight_vol_ratio", "gap_size", "overnight_skew", "vix_regime", "fill_ratio",
                      "overnight_20d_lag1", "overnight_5d_lag1", "intraday_5d_lag1")


def spillover_features(bars: DataFrame, base: str, other: str, vix: DataFrame) -> DataFrame:
    """Ratio of two symbols with its bands, volume and implied-volatility regime.

    ``vix`` holds (ts, vix).  Non-positive implied volatility fails the job.
    """
    s = Rolling(keys=("pair",))
    leg = {}
    for tag, name in (("base", base), ("other", other)):
        leg[tag] = bars.where(F.col("symbol") == name).select(
            "ts", F.col("close").alias(f"{tag}_close"), F.col("volume").alias(f"{tag}_volume"))
    checked = vix.withColumn("vix", F.when(
        F.col("vix") <= 0, F.raise_error(F.lit("implied volatility must be positive")).cast("double")
    ).otherwise(F.col("vix")))
    x = leg["base"].join(leg["other"], "ts", "full_outer").join(checked, "ts", "full_outer")
    x = x.withColumn("pair", F.lit(f"{other}/{base}")).withColumn("ratio", safe_div("other_close", "base_close"))
    x = x.withColumns({
        "ratio_ma20": s.mean("ratio", 20), "ratio_sd20": s.sd("ratio", 20), "ratio_z": s.zscore("ratio", 20),
        "vol_regime": safe_div(s.mean("vix", 20), "vix"),
        "base_volume_z": s.zscore("base_volume", 20), "other_volume_z": s.zscore("other_volume", 20)})
    return x.withColumns({"ratio_z_lag1": s.lag("ratio_z", 1), "ratio_z_lag3": s.lag("ratio_z", 3)})


SPILLOVER_FEATURES = ("ratio", "ratio_ma20", "ratio_sd20", "ratio_z", "ratio_z_lag1", "ratio_z_lag3", "vol_regime",
                      "base_volume_z", "other_volume_z")


def with_benchmarks(bars: DataFrame, mapping: DataFrame, correlation_benchmark: str) -> DataFrame:
    """Attach the class benchmark close and the correlation benchmark close by equi-join.

    ``mapping`` holds (symbol, benchmark).
    """
    closes = bars.select("ts", F.col("symbol").alias("benchmark"), F.col("close").alias("bench_close"))
    corr = bars.where(F.col("symbol") == correlation_benchmark).select("ts", F.col("close").alias("corr_close"))
    return (bars.join(mapping, "symbol", "left").join(closes, ["ts", "benchmark"], "left").join(corr, "ts", "left"))


def factor_reversion_features(bars: DataFrame, correlation_benchmark: str, s: Rolling = Rolling(),
                              beta_window: int = 60, norm_window: int = 252) -> DataFrame:
    """Five reversion features per symbol; needs ``with_benchmarks`` columns.

    Terms of a symbol against itself are undefined and set to null.
    """
    x = bars.withColumns({"ret": s.pct_change("close"), "_b": s.pct_change("bench_close"),
                          "_m": s.pct_change("corr_close")})
    x = x.withColumns({"_rv20": s.sd("ret", 20) * ANNUAL, "_rv252": s.sd("ret", 252) * ANNUAL})
    x = with_order_statistics(x, {"_ret_mid": Quantile("ret", 0.5, 252), "_pct": Share("_rv20", 252)}, s.keys, s.ts)
    x = x.withColumns({
        "_beta": safe_div(s.cov("ret", "_b", beta_window), _paired_var(s, "_b", "ret", beta_window)),
        "_corr": s.corr("ret", "_m", beta_window),
        "momentum_deviation": s.pct_change("close", 20) - F.col("_ret_mid"),
        "_dd": safe_div(F.col("close") - s.high("close", 252), s.high("close", 252))})
    pct = F.when(F.col("_pct") == 1.0, 0.999).when(F.col("_pct") == 0.0, 0.001).otherwise(F.col("_pct"))
    return x.withColumns({
        "beta_z": F.when(F.col("symbol") != F.col("benchmark"), s.zscore("_beta", norm_window)),
        "correlation_extreme": F.when(F.col("symbol") != correlation_benchmark, s.zscore("_corr", norm_window)),
        "drawdown_recovery": safe_div("_dd", "_rv252"), "_pct": pct}).withColumn("volatility_percentile", norm_ppf(F.col("_pct"))).drop(
        "_pct", "_ret_mid", "_b", "_m", "_beta", "_corr", "_rv20", "_rv252", "_dd")


def _paired_var(s: Rolling, x: str, other: str, n: int) -> Column:
    return s.var(F.when(F.col(other).isNotNull(), F.col(x)), n)


REVERSION_FEATURES = ("beta_z", "momentum_deviation", "volatility_percentile", "correlation_extreme",
                      "drawdown_recovery")


def average_peer_correlation(bars: DataFrame, n: int = 20, s: Rolling = Rolling()) -> DataFrame:
    """Mean correlation of each symbol with every other one over the last n bars.

    No pair of symbols is ever formed.  With returns standardised inside the
    frame, the correlations of symbol i with all others sum to the dot product
    of its vector with (sum of all vectors - its own vector), so one n-element
    sum per session is enough and cost is linear in the number of symbols.
    Needs the calendar grid, so that equal positions are equal sessions.
    """
    x = bars if "ret" in bars.columns else bars.withColumn("ret", s.pct_change("close"))
    w = s.rows(n)
    usable = (F.count("ret").over(w) == n) & (F.stddev_samp("ret").over(w) > 0)
    x = x.withColumns({"_hist": F.when(usable, F.collect_list("ret").over(w)),
                       "_mean": F.avg("ret").over(w), "_sd": F.stddev_samp("ret").over(w)})
    x = x.withColumn("_z", F.transform("_hist", lambda v: (v - F.col("_mean")) / F.col("_sd")))
    sums = x.where("_z IS NOT NULL").groupBy(s.ts).agg(
        F.array(*[F.sum(F.col("_z")[i]) for i in range(n)]).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    x = x.join(sums, s.ts, "left")
    dot = F.aggregate(F.zip_with("_z", "_sum", lambda z, t: z * (t - z)), F.lit(0.0), lambda a, v: a + v)
    return x.withColumn("peer_corr", F.when(F.col("_z").isNotNull() & (F.col("_n") > 1),
                                            dot / (n - 1) / (F.col("_n") - 1))).drop(
        "_hist", "_mean", "_sd", "_z", "_sum", "_n")


def volatility_shock_features(bars: DataFrame, s: Rolling = Rolling(), norm_bars: int = 232,
                              corr_bars: int = 252) -> DataFrame:
    """Five shock features on the calendar grid (the norm excludes the latest 21 bars)."""
    x = average_peer_correlation(bars.withColumn("ret", s.pct_change("close")), 20, s)
    x = x.withColumn("_rv", F.sqrt(s.mean(F.col("ret") * F.col("ret"), 20) * 252.0))
    x = x.withColumns({"_ref": s.mean("_rv", norm_bars, 21), "_refsd": s.sd("_rv", norm_bars, 21),
                       "skew_20": s.skew("ret", 20), "_corr_ref": s.mean("peer_corr", corr_bars, 1)})
    x = x.withColumn("_shock", clip(safe_div(F.col("_rv") - F.col("_ref"), "_refsd"), low=0.0))
    return x.withColumns({
        "vshock_1d": s.lag("_shock"), "vshock_5d": s.mean("_shock", 5, 1),
        "vol_mean_rev": safe_div("_rv", "_ref"),
        "correlation_spike": F.col("peer_corr") - F.col("_corr_ref")}).drop(
        "_rv", "_ref", "_refsd", "_corr_ref", "_shock")


SHOCK_FEATURES = ("vshock_1d", "vshock_5d", "vol_mean_rev", "skew_20", "correlation_spike")
