"""Backtests, metric blocks and stress replays checked against SQL (AG, BT, RB, JN-9/13/14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions.rolling import Rolling, safe_div
from barwise.operators import backtest as bt
from barwise.operators import metrics as mt
from barwise.operators import portfolio as pt
from barwise.operators import price_features as pf
from barwise.plans import q_sources
from barwise.plans.catalogue import DAY, out, query, s_avg, s_lag, s_sd, s_stat, s_z, sel, sql, stages
from barwise.plans.q_windows import RET, SPILL_CTE, SPILL_STAGES, spill
from barwise.sources import views

UNB = "ROWS UNBOUNDED PRECEDING"
PKEY = "symbol"


def cum(expr, keys=PKEY):
    return f"{expr} OVER (PARTITION BY {keys} ORDER BY ts {UNB})"


SIGNAL_STAGES = [{**RET, "fwd_ret": "lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1",
                  "signal": f"sign(close / {s_lag('close', 20)} - 1)"}]


def signals(spark, sf, bars=None):
    s = Rolling()
    b = bars if bars is not None else views.bars(spark, sf)
    x = pf.labels(pf.returns(b), 1)
    return x.withColumn("signal", F.signum(s.pct_change("close", 20)))


def ledger_ctes(src, staged, keys=PKEY, fee="5", slip="1", scale_col=None, name="led"):
    """SQL ledger over ``src`` (symbol, ts, ret, fwd_ret) with a staged-direction expression."""
    order = f"OVER (PARTITION BY {keys} ORDER BY ts)"
    vol = (f"CASE WHEN count(ret) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN "
           f"stddev_samp(ret) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END")
    return f"""{name}0 AS (SELECT *, {staged} AS staged, {vol} AS vol FROM {src}),
{name}1 AS (SELECT *, CASE WHEN staged IS NULL THEN 0.0 ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, staged * coalesce(
   CASE WHEN vol IS NOT NULL AND vol <> 0 THEN least(0.10 / (vol * sqrt(252.0)), 1.0) END, 0.0))) END AS position FROM {name}0),
{name}2 AS (SELECT *, position * coalesce(fwd_ret, 0) AS gross, abs(position - coalesce(lag(position) {order}, 0)) AS turnover FROM {name}1),
{name} AS (SELECT *, turnover * ({fee}) / 10000.0 AS fee_cost, turnover * ({slip}) / 10000.0 AS slippage_cost,
   turnover * (({fee}) + ({slip})) / 10000.0 AS cost, gross - turnover * (({fee}) + ({slip})) / 10000.0 AS net FROM {name}2)"""


LAG1 = f"lag(signal, 1) OVER (PARTITION BY symbol ORDER BY ts)"
MOM_CTES = stages("bars", *SIGNAL_STAGES) + ",\n" + ledger_ctes("f1", LAG1)


def led_sql(body):
    return sql(body, "bars", ctes=MOM_CTES)


def momentum_ledger(spark, sf):
    return bt.backtest(signals(spark, sf), "signal")


q_sources.register_record_queries(led_sql)


def path_ctes(src, keys=PKEY, r="net", name="m"):
    return f"""{name}1 AS (SELECT *, {cum(f'product(1.0 + {r})', keys)} AS eq, abs(position - lag(position) OVER (PARTITION BY {keys} ORDER BY ts)) AS mv,
   quantile_cont({r}, 0.05) OVER (PARTITION BY {keys}) AS q05 FROM {src} WHERE {r} IS NOT NULL),
{name} AS (SELECT *, eq / greatest(1.0, {cum('max(eq)', keys)}) - 1 AS dd FROM {name}1)"""


def S_SHARPE(x):
    return f"avg({x}) / nullif(stddev_samp({x}), 0) * sqrt(252.0)"


S_BLOCK = {
    "n_obs": "count(*)", "sharpe": S_SHARPE("net"),
    "sortino": "CASE WHEN count(net) >= 2 THEN avg(net) / nullif(sqrt(avg(least(net, 0) * least(net, 0))), 0) * sqrt(252.0) END",
    "cagr": "CASE WHEN product(1 + net) <= 0 THEN -1 ELSE pow(greatest(product(1 + net), 0), 252.0 / count(*)) - 1 END",
    "max_dd": "min(dd)", "ann_vol": "stddev_samp(net) * sqrt(252.0)",
    "hit_rate": "count(*) FILTER (WHERE net > 0) / nullif(count(*) FILTER (WHERE net <> 0), 0)::DOUBLE",
    "tail_loss_5pct": "avg(net) FILTER (WHERE net <= q05)", "net_return": "product(1 + net) - 1",
    "gross_return": "product(1 + gross) - 1", "turnover_annual": "coalesce(sum(mv), 0) / (count(*) / 252.0)",
    "avg_exposure": "avg(abs(position))", "trade_count": "count(*) FILTER (WHERE turnover > 1e-9)",
    "total_turnover": "sum(turnover)", "total_cost": "sum(cost)"}


def block_sql(src, keys=PKEY, cols=mt.METRICS, extra=("n_obs", "trade_count"), name="blk"):
    inner = "SELECT " + keys + ", " + ", ".join(f"{e} AS {c}" for c, e in S_BLOCK.items()) + f" FROM {src} GROUP BY {keys}"
    outer = f"(SELECT *, cagr / nullif(abs(max_dd), 0) AS calmar, gross_return - net_return AS cost_drag FROM ({inner}))"
    return sel(outer, [*keys.split(", "), *extra], cols)


@query("bt_02_momentum_ledger", led_sql(sel("led", ["symbol", DAY], ["position", "gross", "turnover", "cost", "net"], 8)))
def ledger(spark, sf):
    x = momentum_ledger(spark, sf).withColumn("session", views.day())
    return out(x, "symbol", "session", r=["position", "gross", "turnover", "cost", "net"], digits=8)


@query("bt_01_vol_target_scale", led_sql(
    f"SELECT symbol, {DAY}, round(coalesce(CASE WHEN vol <> 0 THEN least(0.10 / (vol * sqrt(252.0)), 1.0) END, 0.0), 6) + 0.0 AS scale FROM led0"))
def vol_target(spark, sf):
    x = signals(spark, sf)
    return out(x.withColumn("scale", bt.vol_scale("ret", bt.Execution(), Rolling())).withColumn("session", views.day()),
               "symbol", "session", r=["scale"])


def _block(name, cols, extra=()):
    @query(name, sql(block_sql("m", cols=cols, extra=extra), "bars", ctes=MOM_CTES + ",\n" + path_ctes("led")))
    def run(spark, sf):
        return out(mt.metric_block(momentum_ledger(spark, sf)), "symbol", *extra, r=cols)


_block("ag_11_metric_block", mt.METRICS, ("n_obs", "trade_count"))
for _n, _c in {"ag_01_annual_volatility": ["ann_vol"], "ag_02_sharpe": ["sharpe"], "ag_03_sortino": ["sortino"],
               "ag_04_max_drawdown": ["max_dd"], "ag_05_cagr": ["cagr"], "ag_06_calmar": ["calmar"],
               "ag_07_hit_rate": ["hit_rate"], "ag_08_tail_loss": ["tail_loss_5pct"]}.items():
    _block(_n, _c)


@query("ag_09_value_at_risk", led_sql("SELECT symbol, round(-quantile_cont(net, 0.05), 8) + 0.0 AS var_95, "
                                      "round(-quantile_cont(net, 0.01), 8) + 0.0 AS var_99 FROM led GROUP BY symbol"))
def value_at_risk(spark, sf):
    x = momentum_ledger(spark, sf).groupBy("symbol").agg((-F.percentile("net", F.lit(0.05))).alias("var_95"),
                                                         (-F.percentile("net", F.lit(0.01))).alias("var_99"))
    return out(x, "symbol", r=["var_95", "var_99"], digits=8)


BENCH_CTE = "bch AS (SELECT ts, fwd_ret AS bench FROM f1 WHERE symbol = 'STANDARD')"


@query("ag_10_beta", sql("SELECT symbol, round(covar_samp(net, bench) / nullif(var_samp(bench), 0), 6) + 0.0 AS beta FROM led JOIN bch USING (ts) "
                         "WHERE bench IS NOT NULL GROUP BY symbol", "bars", ctes=MOM_CTES + ",\n" + BENCH_CTE))
def beta(spark, sf):
    sig = signals(spark, sf)
    bench = sig.where(F.col("symbol") == "STANDARD").select("ts", F.col("fwd_ret").alias("bench"))
    return out(mt.beta(momentum_ledger(spark, sf).join(bench, "ts"), ["symbol"], "net", "bench"), "symbol", r=["beta"])


@query("jn_13_benchmark_intersection", sql("SELECT symbol, count(*) AS n_common FROM led JOIN bch USING (ts) WHERE bench IS NOT NULL GROUP BY 1",
                                           "bars", ctes=MOM_CTES + ",\n" + BENCH_CTE))
def common_sessions(spark, sf):
    bench = signals(spark, sf).where((F.col("symbol") == "STANDARD") & F.col("fwd_ret").isNotNull()).select("ts")
    return momentum_ledger(spark, sf).join(bench, "ts").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_common"))


# ---- holding rule and selected legs --------------------------------------------

def hold_ctes(want, hold, name="h", src="f1", keys="symbol", flat="0.0::DOUBLE"):
    """Recursive walk over row numbers, all series at once."""
    return f"""{name}b AS MATERIALIZED (SELECT *, coalesce({want}, {flat}) AS want, row_number() OVER (PARTITION BY {keys} ORDER BY ts) AS rn FROM {src}),
{name}s(k, rn, cur, since) AS (SELECT DISTINCT {keys}, 0::BIGINT, {flat}, {hold}::BIGINT FROM {name}b
  UNION ALL SELECT s.k, b.rn, CASE WHEN b.want <> s.cur AND s.since + 1 >= {hold} THEN b.want ELSE s.cur END,
    CASE WHEN b.want <> s.cur AND s.since + 1 >= {hold} THEN 0 ELSE s.since + 1 END FROM {name}s s JOIN {name}b b ON b.{keys} = s.k AND b.rn = s.rn + 1),
{name} AS (SELECT b.*, s.cur AS held FROM {name}b b JOIN {name}s s ON s.k = b.{keys} AND s.rn = b.rn)"""


@query("bt_03_minimum_hold", sql(
    sel("led", ["symbol", DAY], ["position", "net"], 8), "bars",
    ctes=stages("bars", *SIGNAL_STAGES) + ",\n" + hold_ctes(LAG1, 10) + ",\n" + ledger_ctes("h", "held")))
def minimum_hold(spark, sf):
    x = bt.backtest(signals(spark, sf), "signal", hold=10).withColumn("session", views.day())
    return out(x, "symbol", "session", r=["position", "net"], digits=8)


LEG_CTE = (SPILL_CTE.replace("FULL JOIN ot USING (ts) FULL JOIN vixs USING (ts)", "JOIN ot USING (ts) JOIN vixs USING (ts)") + ",\n"
           + stages("sp", *SPILL_STAGES, name="z") + """,
lg AS (SELECT *, CASE WHEN ratio_z > 0 THEN 'STANDARD' WHEN ratio_z IS NOT NULL THEN 'ECONOMY' END AS leg, abs(ratio_z) AS strength,
  lead(base_close) OVER (ORDER BY ts) / base_close - 1 AS base_fwd, lead(other_close) OVER (ORDER BY ts) / other_close - 1 AS other_fwd FROM z2)""")


def legs(spark, sf):
    s = Rolling(("pair",))
    x = spill(spark, sf).where("base_close IS NOT NULL AND other_close IS NOT NULL AND vix IS NOT NULL").select(
        "pair", "ts", "base_close", "other_close", "ratio")
    x = x.withColumn("ratio_z", s.zscore("ratio", 20))
    leg = F.when(F.col("ratio_z") > 0, "STANDARD").when(F.col("ratio_z").isNotNull(), "ECONOMY")
    return x.withColumns({"leg": leg, "strength": F.abs("ratio_z"),
                          "base_fwd": safe_div(s.lead("base_close"), "base_close") - 1.0,
                          "other_fwd": safe_div(s.lead("other_close"), "other_close") - 1.0})


@query("jn_09_selected_leg_return", sql(
    f"SELECT {DAY}, leg, round(CASE leg WHEN 'STANDARD' THEN base_fwd WHEN 'ECONOMY' THEN other_fwd END, 8) + 0.0 AS leg_return FROM lg",
    "bars", ctes=LEG_CTE))
def selected_leg(spark, sf):
    x = legs(spark, sf).withColumn("leg_return", F.when(F.col("leg") == "STANDARD", F.col("base_fwd")).when(
        F.col("leg") == "ECONOMY", F.col("other_fwd"))).withColumn("session", views.day())
    return out(x, "session", "leg", r=["leg_return"], digits=8)


LEG_LED = """lq0 AS (SELECT *, lag((base_fwd + other_fwd) / 2.0) OVER (ORDER BY ts) AS risk FROM lg),
lq1 AS (SELECT *, CASE WHEN count(risk) OVER w = 20 THEN stddev_samp(risk) OVER w END AS vol FROM lq0
  WINDOW w AS (ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
""" + hold_ctes("lag(CASE WHEN strength > 1.0 THEN leg END) OVER (ORDER BY ts)", 10, src="lq1", flat="''") + """,
lq2 AS (SELECT *, CASE WHEN held <> '' THEN coalesce(CASE WHEN vol <> 0 THEN least(0.10 / (vol * sqrt(252.0)), 1.0) END, 0.0) ELSE 0.0 END AS position,
  CASE held WHEN 'STANDARD' THEN coalesce(base_fwd, 0) WHEN 'ECONOMY' THEN coalesce(other_fwd, 0) ELSE 0 END AS realised FROM h),
lq3 AS (SELECT *, coalesce(lag(position) OVER (ORDER BY ts), 0) AS pp, coalesce(lag(held) OVER (ORDER BY ts), '') AS ph FROM lq2),
lq4 AS (SELECT *, CASE WHEN ph <> '' AND held <> '' AND ph <> held THEN abs(pp) + abs(position) ELSE abs(position - pp) END AS turnover,
  position * realised AS gross FROM lq3)"""


@query("bt_04_selected_asset", sql(
    f"SELECT {DAY}, held AS held_leg, round(position, 8) + 0.0 AS position, round(turnover, 8) + 0.0 AS turnover, "
    "round(gross - turnover * 6 / 10000.0, 8) + 0.0 AS net FROM lq4", "bars", ctes=LEG_CTE + ",\n" + LEG_LED))
def selected_asset(spark, sf):
    x = bt.backtest_legs(legs(spark, sf), "strength", "leg", {"STANDARD": "base_fwd", "ECONOMY": "other_fwd"},
                         threshold=1.0, hold=10, keys=("pair",))
    return out(x.withColumn("session", views.day()), "session", "held_leg", r=["position", "turnover", "net"], digits=8)


# ---- scenario replays -----------------------------------------------------------

COST_POINTS = [dict(name=f"fee{f:g}", fee=f, slippage=1.0, delay=0) for f in (0.0, 2.5, 5.0, 10.0, 20.0)]
SLIP_POINTS = [dict(name=f"slip{s:g}", fee=5.0, slippage=s, delay=0) for s in (0.0, 1.0, 2.0, 5.0, 10.0)]
DELAY_POINTS = [dict(name=f"delay{d}", fee=5.0, slippage=1.0, delay=d) for d in (0, 1, 2, 3)]


def _grid_ctes(points):
    vals = ", ".join(f"('{p['name']}', {p['fee']}, {p['slippage']}, {p['delay']})" for p in points)
    d = " ".join(f"WHEN {p} THEN lag(signal, {1 + p}) OVER (PARTITION BY symbol, scenario ORDER BY ts)"
                 for p in sorted({q["delay"] for q in points}))
    keys = "symbol, scenario"
    return (stages("bars", *SIGNAL_STAGES) + f",\ngrid(scenario, fee, slip, delay) AS (VALUES {vals}),\n"
            "gx AS (SELECT * FROM f1 CROSS JOIN grid),\n" + ledger_ctes("gx", f"CASE delay {d} END", keys, "fee", "slip")
            + ",\n" + path_ctes("led", keys))


S_STRESS = {"sharpe": S_SHARPE("net"), "gross_sharpe": S_SHARPE("gross"), "net_return": "product(1 + net) - 1",
            "gross_return": "product(1 + gross) - 1", "max_dd": "min(dd)", "annual_turnover": "sum(turnover) / (count(*) / 252.0)",
            "fee_cost": "sum(fee_cost)", "slippage_cost": "sum(slippage_cost)",
            "cost_drag": "product(1 + gross) - product(1 + net)"}


def stress_sql(src, keys):
    return ("SELECT " + keys + ", " + ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in S_STRESS.items())
            + f" FROM {src} GROUP BY {keys}")


def replayed(spark, sf, points):
    return bt.replay(signals(spark, sf).withColumnRenamed("signal", "dir"), points)


def _stress(name, points):
    @query(name, sql(stress_sql("m", "symbol, scenario"), "bars", ctes=_grid_ctes(points)))
    def run(spark, sf):
        return out(mt.stress_summary(replayed(spark, sf, points), ["symbol", "scenario"]), "symbol", "scenario", r=mt.STRESS)


_stress("rb_01_cost_stress", COST_POINTS)
_stress("rb_01_slippage_stress", SLIP_POINTS)
_stress("rb_02_delay_stress", DELAY_POINTS)
_stress("ag_15_stress_summary", COST_POINTS[:2])


@query("jn_14_scenario_grid", sql("SELECT scenario, count(*) AS n_rows, round(sum(net), 6) + 0.0 AS net FROM led GROUP BY 1", "bars",
                                  ctes=_grid_ctes(COST_POINTS + DELAY_POINTS[1:])))
def scenario_grid(spark, sf):
    x = replayed(spark, sf, COST_POINTS + DELAY_POINTS[1:])
    return out(x.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("net").alias("net")), "scenario", "n_rows", r=["net"])


@query("rb_05_accounting_assertions", sql("""SELECT symbol, 0::BIGINT AS cost_gap, 0::BIGINT AS fee_gap, 0::BIGINT AS delay_gap, count(*) AS n_rows
  FROM led GROUP BY symbol""", "bars", ctes=MOM_CTES))
def accounting(spark, sf):
    """Reconciliation counts that must be zero: gross-net = cost, fee = turnover x rate, delay only shifts directions."""
    s = Rolling(("symbol",))
    base = momentum_ledger(spark, sf)
    late = bt.backtest(signals(spark, sf), "signal", bt.Execution(delay=2)).select("symbol", "ts", F.col("staged").alias("late"))
    x = base.join(late, ["symbol", "ts"]).withColumn("_want", s.lag("staged", 2))
    return x.groupBy("symbol").agg(
        F.count_if(F.abs(F.col("gross") - F.col("net") - F.col("cost")) > 1e-12).alias("cost_gap"),
        F.count_if(F.abs(F.col("fee_cost") - F.col("turnover") * 5.0 / 10000.0) > 1e-15).alias("fee_gap"),
        F.count_if(~F.col("late").eqNullSafe(F.col("_want"))).alias("delay_gap"), F.count(F.lit(1)).alias("n_rows"))


# ---- regimes, terciles, side series -----------------------------------------------

REG_CTE = MOM_CTES + """,
fl AS (SELECT led.*, CAST(ret > 0 AS INTEGER) AS up, CASE WHEN vol IS NULL THEN NULL WHEN vol * sqrt(252.0) > 0.9 THEN 'high' ELSE 'low' END AS volreg FROM led),
rg AS (SELECT *, 'all' AS regime, 'all' AS level FROM fl UNION ALL SELECT *, 'up', CAST(up AS VARCHAR) FROM fl WHERE up IS NOT NULL
  UNION ALL SELECT *, 'volreg', volreg FROM fl WHERE volreg IS NOT NULL),
""" + path_ctes("rg", "symbol, regime, level")


@query("ag_16_regime_segments", sql(
    "SELECT symbol, regime, level, count(*) AS n, " + ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in {
        "sharpe": S_SHARPE("net"), "max_dd": "min(dd)", "total_return": "product(1 + net) - 1"}.items())
    + " FROM m GROUP BY 1, 2, 3", "bars", ctes=REG_CTE))
def regimes(spark, sf):
    s = Rolling()
    x = momentum_ledger(spark, sf).withColumn("_v", s.sd("ret", 20, 1) * 252.0 ** 0.5)
    x = x.withColumns({"up": (F.col("ret") > 0).cast("int"),
                       "volreg": F.when(F.col("_v") > 0.9, "high").when(F.col("_v").isNotNull(), "low")})
    return out(mt.regime_table(x, ["up", "volreg"]), "symbol", "regime", "level", "n", r=["sharpe", "max_dd", "total_return"])


def side_ledger(spark, sf):
    """Ledger rows with the implied-volatility level, its rank and the half of the path."""
    b = views.bars(spark, sf)
    vix = b.where(F.col("symbol") == "PROMO").select("ts", (F.col("close") / 50.0).alias("vix"))
    x = momentum_ledger(spark, sf).join(vix, "ts")
    from pyspark.sql import Window
    w = Window.partitionBy("symbol")
    return x.withColumns({"n": F.count(F.lit(1)).over(w), "rk": F.row_number().over(w.orderBy("vix", "ts")),
                          "tk": F.row_number().over(w.orderBy("ts"))})


SIDE_CTE = MOM_CTES + """,
sv AS (SELECT led.*, v.close / 50.0 AS vix FROM led JOIN bars v ON v.symbol = 'PROMO' AND v.ts = led.ts),
sr AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY vix, ts) AS rk,
  row_number() OVER (PARTITION BY symbol ORDER BY ts) AS tk FROM sv)"""


@query("ag_17_subperiods", sql(f"""SELECT symbol, round({S_SHARPE('CASE WHEN tk <= n // 2 THEN net END')}, 6) + 0.0 AS first_half,
  round({S_SHARPE('CASE WHEN tk > n // 2 THEN net END')}, 6) + 0.0 AS second_half,
  round(product(CASE WHEN year(ts) = 1998 THEN 1 + net END) - 1, 6) + 0.0 AS year_return,
  round(product(CASE WHEN rk > n - 5 THEN 1 + net END) - 1, 6) + 0.0 AS top_vix_return, round(corr(net, vix), 6) + 0.0 AS corr_vix
  FROM sr GROUP BY symbol""", "bars", ctes=SIDE_CTE))
def subperiods(spark, sf):
    x = side_ledger(spark, sf)
    half = F.floor(F.col("n") / 2)
    x = x.groupBy("symbol").agg(
        mt.sharpe(F.when(F.col("tk") <= half, F.col("net"))).alias("first_half"),
        mt.sharpe(F.when(F.col("tk") > half, F.col("net"))).alias("second_half"),
        (F.product(F.when(F.year("ts") == 1998, 1.0 + F.col("net"))) - 1.0).alias("year_return"),
        (F.product(F.when(F.col("rk") > F.col("n") - 5, 1.0 + F.col("net"))) - 1.0).alias("top_vix_return"),
        F.corr("net", "vix").alias("corr_vix"))
    return out(x, "symbol", r=["first_half", "second_half", "year_return", "top_vix_return", "corr_vix"])


@query("sr_08_quartile_bins", sql(f"""SELECT symbol, CAST(greatest(ceil(4.0 * (rk - 1) / (n - 1)) - 1, 0) AS INTEGER) AS quartile, count(*) AS n_rows,
  round({S_SHARPE('net')}, 6) + 0.0 AS sharpe FROM sr GROUP BY 1, 2""", "bars", ctes=SIDE_CTE))
def quartiles(spark, sf):
    x = side_ledger(spark, sf).withColumn("quartile", mt.quartile_of_rank(F.col("rk"), F.col("n")))
    x = x.groupBy("symbol", "quartile").agg(F.count(F.lit(1)).alias("n_rows"), mt.sharpe("net").alias("sharpe"))
    return out(x, "symbol", "quartile", "n_rows", r=["sharpe"])


@query("sr_07_top_side_sessions", sql("SELECT strftime(ts, '%Y-%m-%d') AS session, round(close / 50.0, 9) AS vix FROM bars WHERE symbol = 'PROMO' "
                                      "ORDER BY close DESC, ts LIMIT 5", "bars"))
def top_sessions(spark, sf):
    """The five sessions with the highest side series; top-k is the feature."""
    b = views.bars(spark, sf).where(F.col("symbol") == "PROMO")
    return b.orderBy(F.desc("close"), "ts").limit(5).select(
        views.day().alias("session"), F.round(F.col("close") / 50.0, 9).alias("vix"))


# ---- single-target construction ------------------------------------------------------

DDC_CTE = stages("bars", *SIGNAL_STAGES) + f""",
d1 AS (SELECT *, {cum('product(1.0 + coalesce(ret, 0))')} AS eq, ({s_sd('ret', 20, 1)}) * sqrt(252.0) AS v FROM f1),
d2 AS (SELECT *, eq / greatest(1.0, {cum('max(eq)')}) - 1 AS ddx,
  CASE WHEN signal IS NULL OR v IS NULL OR v = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, signal * least(0.10 / v, 1.0))) END AS base FROM d1),
d3 AS (SELECT *, coalesce(lag(ddx) OVER (PARTITION BY symbol ORDER BY ts), 0) AS prev FROM d2),
d4 AS (SELECT *, coalesce(last_value(CASE WHEN prev <= -0.10 THEN 0.5 WHEN prev >= -0.04 THEN 1.0 END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY ts {UNB}), 1.0) AS state FROM d3)"""


@query("pf_06_drawdown_control", sql(f"SELECT symbol, {DAY}, CAST(state AS DOUBLE) AS state FROM d4", "bars", ctes=DDC_CTE))
def drawdown_control(spark, sf):
    x = pt.drawdown_control(signals(spark, sf).withColumn("one", F.lit(1.0)), "ret", "one")
    return x.select("symbol", views.day().alias("session"), "state")


@query("pf_07_single_target", sql(f"SELECT symbol, {DAY}, round(base * state, 8) + 0.0 AS w, round(1 - abs(base * state), 8) + 0.0 AS cash FROM d4",
                                  "bars", ctes=DDC_CTE))
def single_target(spark, sf):
    x = pt.single_target(signals(spark, sf), "signal").withColumn("session", views.day())
    return out(x, "symbol", "session", r=["w", "cash"], digits=8)
