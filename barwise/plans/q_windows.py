"""Window features checked against SQL (inventory group WN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions.normal import norm_cdf
from barwise.functions.rolling import Rolling
from barwise.operators import price_features as pf
from barwise.plans.catalogue import (DAY, ORD, _win, out, query, s_avg, s_lag, s_pair, s_q, s_sd, s_stat, s_z, sel, sql,
                                     stages)
from barwise.sources import views

S = Rolling()
A = "sqrt(252.0)"


def day(df):
    return df.withColumn("session", views.day())


RET = {"ret": f"close / {s_lag('close')} - 1"}


def _single(name, stage_list, cols, build, digits=6, view="bars"):
    """Register one feature list: SQL stages over a bar view and its Spark twin."""
    final = f"f{len(stage_list)}"

    @query(name, sql(sel(final, ["symbol", DAY], cols, digits), view, ctes=stages(view, *stage_list)))
    def run(spark, sf):
        source = views.bars(spark, sf) if view == "bars" else views.cross_section_bars(spark, sf)
        return out(day(build(source)), "symbol", "session", r=cols, digits=digits)
    return run


_single("wn_01_returns", [{"ret": f"close / {s_lag('close')} - 1", "log_ret": f"ln(close / {s_lag('close')})"}],
        ["ret", "log_ret"], pf.returns)
_single("wn_02_momentum", [{"mom_63": f"close / {s_lag('close', 63)} - 1", "mom_252": f"close / {s_lag('close', 252)} - 1"}],
        ["mom_63", "mom_252"], lambda b: pf.momentum(pf.momentum(b, 63, name="mom_63"), 252, name="mom_252"))

BASE_STAGES = [
    RET,
    {"mkt": "avg(ret) OVER (PARTITION BY ts)", "mom_63": f"close / {s_lag('close', 63)} - 1",
     "mom_252": f"close / {s_lag('close', 252)} - 1", "trend_50": f"close / ({s_avg('close', 50)}) - 1",
     "mean_reversion_20": f"-({s_z('ret', 20)})", "rv_20": f"({s_sd('ret', 20)}) * {A}",
     "rv10": f"({s_sd('ret', 10)}) * {A}", "rv60": f"({s_sd('ret', 60)}) * {A}", "volume_z_20": s_z("volume", 20),
     "dollar": s_avg("(close * volume)", 20), "regime_drawdown": f"close / ({s_stat('max', 'close', 60)}) - 1"},
    {"rel_strength": "ret - mkt", "vol_ratio_10_60": "rv10 / nullif(rv60, 0)",
     "log_dollar_volume_20": "CASE WHEN dollar > 0 THEN ln(dollar) END",
     "regime_high_vol": f"coalesce(CAST(rv60 > ({s_q('rv60', 0.5, 252, 60)}) AS DOUBLE), 0.0)"},
]
_single("wn_11_baseline_panel", BASE_STAGES, list(pf.BASELINE_FEATURES), pf.price_volume_features)
for _name, _cols in {"wn_03_trend": ["trend_50"], "wn_04_mean_reversion": ["mean_reversion_20"],
                     "wn_05_realized_volatility": ["rv_20"], "wn_06_volatility_ratio": ["vol_ratio_10_60"],
                     "wn_07_volume_zscore": ["volume_z_20"], "wn_08_log_dollar_volume": ["log_dollar_volume_20"],
                     "wn_09_relative_strength": ["rel_strength"],
                     "wn_10_market_regime": ["regime_drawdown", "regime_high_vol"]}.items():
    _single(_name, BASE_STAGES, _cols, pf.price_volume_features)

_single("wn_12_forward_label",
        [{"fwd_ret": f"lead(close, 5) {ORD} / close - 1", "hit": "0"},
         {"label": "CASE WHEN fwd_ret IS NOT NULL THEN CAST(fwd_ret > 0 AS INTEGER) END"}],
        ["fwd_ret", "label"], lambda b: pf.labels(b, 5))

Q = "(13.0/14.0)"
_t = f"(count(chg) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1)"


def _ewm(x):
    return (f"CASE WHEN t + 1 >= 14 THEN pow({Q}, t) * sum(CASE WHEN {x} IS NULL THEN NULL WHEN t = 0 THEN {x} "
            f"ELSE {x} / 14.0 * pow({Q}, -t) END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) END")


EXT_STAGES = [
    {**RET, "chg": f"close - {s_lag('close')}"},
    {"t": _t, "gain": "CASE WHEN chg IS NOT NULL THEN greatest(chg, 0) END",
     "loss": "CASE WHEN chg IS NOT NULL THEN greatest(-chg, 0) END",
     "overnight_gap": f"open / {s_lag('close')} - 1", "intraday_ret": "close / open - 1",
     "day_range_pos": "(close - low) / nullif(high - low, 0)",
     "bollinger_20": f"(close - ({s_avg('close', 20)})) / nullif(2 * ({s_sd('close', 20)}), 0)",
     "pos_52w": f"(close - ({s_stat('min', 'close', 252)})) / nullif(({s_stat('max', 'close', 252)}) - ({s_stat('min', 'close', 252)}), 0)",
     "rv": f"({s_sd('ret', 20)}) * {A}", "vchg": f"ln(volume / {s_lag('volume')})",
     "illiq": "abs(ret) / nullif(close * volume, 0)"},
    {"up": _ewm("gain"), "down": _ewm("loss"), "vol_of_vol_20": s_sd("rv", 20),
     "pv_corr_20": s_pair("corr", "ret", "vchg", 20), "amihud_20": s_avg("illiq", 20)},
    {"rsi_14": "100 - 100 / (1 + up / nullif(down, 0))"},
]
_single("wn_22_extension_panel", EXT_STAGES, list(pf.EXTENSION_FEATURES), pf.signal_extensions, digits=9)
for _name, _col in {"wn_13_overnight_gap": "overnight_gap", "wn_14_intraday_return": "intraday_ret",
                    "wn_15_day_range_position": "day_range_pos", "wn_16_wilder_rsi": "rsi_14",
                    "wn_17_bollinger_position": "bollinger_20", "wn_18_year_position": "pos_52w",
                    "wn_19_vol_of_vol": "vol_of_vol_20", "wn_20_price_volume_corr": "pv_corr_20",
                    "wn_21_amihud": "amihud_20"}.items():
    _single(_name, EXT_STAGES, [_col], pf.signal_extensions, digits=9)

PARK = "pow(ln(high / low), 2) / (4 * ln(2.0))"
_single("wn_23_parkinson_lagged", [{"p": PARK}, {"parkinson_lag_20": f"sqrt(252 * ({s_avg('p', 20, 1)}))"}],
        ["parkinson_lag_20"], pf.parkinson)

LIQ_STAGES = [
    {**RET, "dv": "close * volume", "rng": "ln(high / low)"},
    {"illiq": "abs(ret) / nullif(dv, 0)", "v20": s_avg("volume", 20), "v5": s_avg("volume", 5)},
    {"amihud_1d": s_avg("illiq", 1), "amihud_5d": s_avg("illiq", 5), "amihud_20d": s_avg("illiq", 20),
     "volume_imbalance": "sign(ret) * volume / nullif(v20, 0)",
     "volume_shock": f"(volume - v20) / nullif({s_sd('volume', 20)}, 0)",
     "price_pressure": f"ret / nullif({s_sd('ret', 20)}, 0) * (volume / nullif(v20, 0))",
     "liquidity_ratio": "v5 / nullif(v20, 0)", "spread_proxy": s_avg("rng", 5),
     "kyles_lambda": f"abs({s_stat('sum', 'ret', 5)}) / nullif({s_stat('sum', 'volume', 5)}, 0)"},
    {**{f"pressure_lag{k}": s_lag("price_pressure", k) for k in (1, 2, 3)},
     "liquidity_innovation": s_z("amihud_5d", 20)},
]
_single("wn_24_liquidity_panel", LIQ_STAGES, list(pf.LIQUIDITY_FEATURES), pf.liquidity_features, digits=9)
for _name, _cols in {"wn_25_volume_imbalance": ["volume_imbalance"], "wn_26_volume_shock": ["volume_shock"],
                     "wn_27_price_pressure": ["price_pressure", "pressure_lag1", "pressure_lag2", "pressure_lag3"],
                     "wn_28_liquidity_ratio": ["liquidity_ratio"], "wn_30_spread_proxy": ["spread_proxy"],
                     "wn_31_kyles_lambda": ["kyles_lambda"],
                     "wn_32_liquidity_innovation": ["liquidity_innovation"]}.items():
    _single(_name, LIQ_STAGES, _cols, pf.liquidity_features, digits=9)


@query("wn_29_turnover", sql(sel("f2", ["symbol", DAY], ["turnover", "turnover_5d"], 9), "bars", ctes="""
cap AS (SELECT p_type AS symbol, sum(p_retailprice) AS market_cap FROM part GROUP BY 1),
b AS (SELECT bars.*, market_cap FROM bars LEFT JOIN cap USING (symbol)),
""" + stages("b", {"turnover": "close * volume / market_cap"}, {"turnover_5d": s_avg("turnover", 5)})))
def turnover(spark, sf):
    cap = views.table(spark, sf, "part").groupBy(F.col("p_type").alias("symbol")).agg(
        F.sum("p_retailprice").alias("market_cap"))
    b = views.bars(spark, sf).join(cap, "symbol", "left")
    x = pf.liquidity_features(b, market_cap="market_cap")
    return out(day(x), "symbol", "session", r=["turnover", "turnover_5d"], digits=9)


SIDE = "PROMO"
VIX_CTE = f"vixs AS (SELECT ts, close / 50.0 AS vix FROM bars WHERE symbol = '{SIDE}'),\n" \
          "vb AS (SELECT bars.*, vix FROM bars LEFT JOIN vixs USING (ts) WHERE vix IS NOT NULL)"


def with_vix(bars):
    """Bars with the side series attached by session (left join on ts)."""
    vix = bars.where(F.col("symbol") == SIDE).select("ts", (F.col("close") / 50.0).alias("vix"))
    return bars.join(vix, "ts", "left")


VOL_STAGES = [
    {**RET, "p": PARK},
    {"pk": f"sqrt(252 * ({s_avg('p', 20)}))", **{f"rv{n}": f"({s_sd('ret', n)}) * {A}" for n in (5, 10, 20, 60)},
     "neg": "CASE WHEN ret IS NOT NULL THEN least(ret, 0) END"},
    {"rv_term_5_20": "rv5 / nullif(rv20, 0)", "rv_term_10_60": "rv10 / nullif(rv60, 0)",
     "vrp_vix": "vix - rv20 * 100",
     "vol_regime_high": f"coalesce(CAST(rv20 > ({s_q('rv20', 0.5, 252)}) AS INTEGER), 0)",
     "vol_regime_extreme": f"coalesce(CAST(rv20 > ({s_q('rv20', 0.9, 252)}) AS INTEGER), 0)",
     "vol_trend": f"rv20 / {s_lag('rv20', 20)}", "vol_momentum": f"rv20 / {s_lag('rv20', 10)} - 1",
     "vol_mean_revert": s_z("rv20", 252), "skew_20": s_stat("skewness", "ret", 20),
     "skew_60": s_stat("skewness", "ret", 60), "kurt_20": s_stat("kurtosis", "ret", 20),
     "kurt_60": s_stat("kurtosis", "ret", 60), "downside_vol_20": f"({s_sd('neg', 20)}) * {A}",
     "vov_10": f"({s_sd('rv10', 10)}) * {A}", "vov_20": f"({s_sd('rv20', 20)}) * {A}",
     "jump_signal": f"abs(ret) / nullif(rv5 / {A}, 0)", "consecutive_same": f"abs({s_stat('sum', 'sign(ret)', 5)})",
     "vol_acceleration": f"pk / {s_lag('pk', 5)} - 1"},
    {"downside_ratio": "downside_vol_20 / nullif(rv20, 0)", "vrp_vix_norm": "vrp_vix / nullif(rv20, 0)",
     "vrp_zscore": s_z("vrp_vix", 60)},
]


def _vol(name, cols):
    @query(name, sql(sel("f4", ["symbol", DAY], cols), "bars", ctes=VIX_CTE + ",\n" + stages("vb", *VOL_STAGES)))
    def run(spark, sf):
        x = pf.volatility_features(with_vix(views.bars(spark, sf)))
        return out(day(x), "symbol", "session", r=cols)


for _name, _cols in {
    "wn_33_volatility_panel": list(pf.VOLATILITY_FEATURES), "wn_34_variance_premium": ["vrp_vix", "vrp_vix_norm", "vrp_zscore"],
    "wn_35_volatility_regimes": ["vol_regime_high", "vol_regime_extreme"],
    "wn_36_volatility_trend": ["vol_trend", "vol_momentum"], "wn_37_volatility_reversion": ["vol_mean_revert"],
    "wn_38_skew_kurtosis": ["skew_20", "skew_60", "kurt_20", "kurt_60"],
    "wn_39_downside_volatility": ["downside_vol_20", "downside_ratio"], "wn_40_vol_of_vol_annual": ["vov_10", "vov_20"],
    "wn_41_jump_signal": ["jump_signal"], "wn_42_consecutive_sign": ["consecutive_same"],
    "wn_43_range_acceleration": ["vol_acceleration"],
}.items():
    _vol(_name, _cols)

ON_STAGES = [
    {**RET, "overnight_1d": f"(open - {s_lag('close')}) / {s_lag('close')}", "intraday_1d": "(close - open) / open",
     "gap": f"abs(open - {s_lag('close')})"},
    {"overnight_5d": s_avg("overnight_1d", 5), "overnight_20d": s_avg("overnight_1d", 20),
     "intraday_5d": s_avg("intraday_1d", 5),
     "overnight_vol_ratio": f"({s_sd('overnight_1d', 20)}) / nullif({s_sd('ret', 20)}, 0)",
     "gap_size": "abs(overnight_1d)", "overnight_skew": s_stat("skewness", "overnight_1d", 60),
     "vix_regime": s_avg("vix", 20), "fill_ratio": "(high - low) / nullif(gap, 0)"},
    {f"{c}_lag1": s_lag(c) for c in ("overnight_20d", "overnight_5d", "intraday_5d")},
]


@query("wn_44_overnight_panel", sql(sel("f3", ["symbol", DAY], pf.OVERNIGHT_FEATURES, 9), "bars",
                                    ctes=VIX_CTE + ",\n" + stages("vb", *ON_STAGES)))
def overnight(spark, sf):
    x = pf.overnight_features(with_vix(views.bars(spark, sf)))
    return out(day(x), "symbol", "session", r=pf.OVERNIGHT_FEATURES, digits=9)


SPILL_STAGES = [
    {"ratio_ma20": s_avg("ratio", 20), "ratio_sd20": s_sd("ratio", 20), "ratio_z": s_z("ratio", 20),
     "vol_regime": f"({s_avg('vix', 20)}) / vix", "base_volume_z": s_z("base_volume", 20),
     "other_volume_z": s_z("other_volume", 20)},
    {"ratio_z_lag1": s_lag("ratio_z", 1), "ratio_z_lag3": s_lag("ratio_z", 3)},
]
SPILL_CTE = """vixs AS (SELECT ts, close / 50.0 AS vix FROM bars WHERE symbol = 'PROMO'),
ba AS (SELECT ts, close AS base_close, volume AS base_volume FROM bars WHERE symbol = 'STANDARD'),
ot AS (SELECT ts, close AS other_close, volume AS other_volume FROM bars WHERE symbol = 'ECONOMY'),
sp AS (SELECT *, 'ECONOMY/STANDARD' AS symbol, other_close / base_close AS ratio
       FROM ba FULL JOIN ot USING (ts) FULL JOIN vixs USING (ts))"""


def spill(spark, sf):
    b = views.bars(spark, sf)
    vix = b.where(F.col("symbol") == SIDE).select("ts", (F.col("close") / 50.0).alias("vix"))
    return pf.spillover_features(b, "STANDARD", "ECONOMY", vix)


@query("wn_45_spillover_panel", sql(sel("f2", [DAY], pf.SPILLOVER_FEATURES), "bars",
                                    ctes=SPILL_CTE + ",\n" + stages("sp", *SPILL_STAGES)))
def spillover(spark, sf):
    return out(day(spill(spark, sf)), "session", r=pf.SPILLOVER_FEATURES)


# Class benchmarks of the view: fixed mapping from symbol to benchmark symbol.
BENCH = {"STANDARD": "STANDARD", "LARGE": "STANDARD", "MEDIUM": "STANDARD", "SMALL": "ECONOMY",
         "ECONOMY": "ECONOMY", "PROMO": "ECONOMY"}
GRID_CTE = """cal AS (SELECT DISTINCT ts FROM {v}), syms AS (SELECT DISTINCT symbol FROM {v}),
g AS (SELECT syms.symbol, cal.ts, open, high, low, close, volume FROM syms CROSS JOIN cal LEFT JOIN {v} b
      ON b.symbol = syms.symbol AND b.ts = cal.ts)"""
MAPPED_CTE = "mp(symbol, benchmark) AS (VALUES " + ", ".join(
    f"('{k}','{v}')" for k, v in BENCH.items()) + """),
gb AS (SELECT g.*, mp.benchmark, x.close AS bench_close, y.close AS corr_close FROM g JOIN mp USING (symbol)
  LEFT JOIN g x ON x.symbol = mp.benchmark AND x.ts = g.ts LEFT JOIN g y ON y.symbol = 'STANDARD' AND y.ts = g.ts)"""
REV_CTE = GRID_CTE.format(v="dbars") + ",\n" + MAPPED_CTE


def rev_stages(bw=60, zw=252):
    return [
        {**RET, "b": f"bench_close / {s_lag('bench_close')} - 1", "m": f"corr_close / {s_lag('corr_close')} - 1"},
        {"pairvar": s_stat("var_samp", "(CASE WHEN ret IS NOT NULL THEN b END)", bw),
         "cov": s_pair("covar_samp", "ret", "b", bw), "corr60": s_pair("corr", "ret", "m", bw),
         "rv20": f"({s_sd('ret', 20)}) * {A}", "rv252": f"({s_sd('ret', 252)}) * {A}",
         "momentum_deviation": f"close / {s_lag('close', 20)} - 1 - ({s_q('ret', 0.5, 252)})",
         "mx": s_stat("max", "close", 252)},
        {"beta": "cov / nullif(pairvar, 0)", "hist": f"CASE WHEN count(rv20) {_win(252)} = 252 THEN list(rv20) {_win(252)} END"},
        {"beta_z": f"CASE WHEN symbol <> benchmark THEN {s_z('beta', zw)} END",
         "correlation_extreme": f"CASE WHEN symbol <> 'STANDARD' THEN {s_z('corr60', zw)} END",
         "drawdown_recovery": "(close - mx) / mx / nullif(rv252, 0)",
         "pct": "(len(list_filter(hist, lambda v: v < rv20)) + (len(list_filter(hist, lambda v: v = rv20)) + 1) / 2.0) / 252.0"},
        {"volatility_pct": "CASE WHEN pct = 1 THEN 0.999 WHEN pct = 0 THEN 0.001 ELSE pct END"},
    ]


def reversion(spark, sf):
    b = views.common_bars(spark, sf)
    grid = union_grid(b)
    mapping = F.create_map(*[F.lit(x) for kv in BENCH.items() for x in kv])
    pairs = b.select("symbol").distinct().withColumn("benchmark", mapping[F.col("symbol")])
    x = pf.factor_reversion_features(pf.with_benchmarks(grid, pairs, "STANDARD"), "STANDARD")
    # The normal score is undone so that SQL can check the rank share behind it.
    return x.withColumn("volatility_pct", norm_cdf(F.col("volatility_percentile")))


def _rev(name, cols):
    @query(name, sql(sel("f5", ["symbol", DAY], cols), "dbars", ctes=REV_CTE + ",\n" + stages("gb", *rev_stages())))
    def run(spark, sf):
        return out(day(reversion(spark, sf)), "symbol", "session", r=cols)


_rev("wn_46_rolling_beta_z", ["beta_z"])
_rev("wn_47_momentum_deviation", ["momentum_deviation"])
_rev("wn_48_volatility_percentile", ["volatility_pct"])
_rev("wn_49_correlation_extreme", ["correlation_extreme"])
_rev("wn_50_drawdown_recovery", ["drawdown_recovery"])
_rev("wn_51_reversion_stack", ["beta_z", "momentum_deviation", "volatility_pct", "correlation_extreme", "drawdown_recovery"])


SHOCK_TAIL = ",\n" + stages("g", RET, name="r") + """,
pairs AS (SELECT a.symbol, a.ts, b.symbol AS peer, a.ret AS ra, b.ret AS rb FROM r1 a JOIN r1 b ON a.ts = b.ts AND a.symbol <> b.symbol),
pc AS (SELECT symbol, ts, CASE WHEN count(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1 END) OVER w = 20 THEN corr(ra, rb) OVER w END AS c
  FROM pairs WINDOW w AS (PARTITION BY symbol, peer ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
pm AS (SELECT symbol, ts, avg(c) AS peer_corr FROM pc GROUP BY symbol, ts),
sh AS (SELECT r1.*, peer_corr FROM r1 LEFT JOIN pm USING (symbol, ts))"""
SHOCK_CTE, PEER_CTE = (GRID_CTE.format(v=v) + SHOCK_TAIL for v in ("dbars", "bars"))
SHOCK_STAGES = [
    {"rv": f"sqrt(({s_avg('(ret*ret)', 20)}) * 252)"},
    {"refm": s_avg("rv", 232, 21), "refsd": s_sd("rv", 232, 21), "skew_20": s_stat("skewness", "ret", 20),
     "cref": s_avg("peer_corr", 252, 1)},
    {"shock": "CASE WHEN refsd <> 0 AND rv IS NOT NULL THEN greatest((rv - refm) / refsd, 0) END"},
    {"vshock_1d": s_lag("shock"), "vshock_5d": s_avg("shock", 5, 1), "vol_mean_rev": "rv / nullif(refm, 0)",
     "correlation_spike": "peer_corr - cref"},
]


def union_grid(b):
    return pf.on_grid(b, "calendar", b.select(F.to_date("ts").alias("session")).distinct())


def grid_bars(spark, sf, cross_section=False):
    return union_grid(views.cross_section_bars(spark, sf) if cross_section else views.bars(spark, sf))


@query("wn_52_volatility_shock_panel", sql(sel("f4", ["symbol", DAY], pf.SHOCK_FEATURES), "dbars",
                                           ctes=SHOCK_CTE + ",\n" + stages("sh", *SHOCK_STAGES)))
def shock(spark, sf):
    return out(day(pf.volatility_shock_features(union_grid(views.common_bars(spark, sf)))), "symbol", "session", r=pf.SHOCK_FEATURES)


@query("jn_10_peer_correlation", sql(sel("sh", ["symbol", DAY], ["peer_corr"]), "bars", ctes=PEER_CTE))
def peer_correlation(spark, sf):
    x = pf.average_peer_correlation(grid_bars(spark, sf))
    return out(day(x), "symbol", "session", r=["peer_corr"])
