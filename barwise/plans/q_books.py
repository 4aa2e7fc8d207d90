"""Cross-sections, books and their returns checked against SQL (WN-53..55, SR, PF, BT-5/6, AG-12/13/18, VAL-22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions.rolling import Rolling, safe_div
from barwise.operators import backtest as bt
from barwise.operators import metrics as mt
from barwise.operators import portfolio as pt
from barwise.operators import price_features as pf
from barwise.plans.catalogue import DAY, out, query, s_avg, s_sd, s_stat, sel, sql, stages
from barwise.plans.q_backtest import S_SHARPE, path_ctes
from barwise.plans.q_windows import GRID_CTE, LIQ_STAGES, RET, SHOCK_CTE, SHOCK_STAGES, grid_bars, union_grid
from barwise.sources import views

S = Rolling()


def xz(c):
    return f"({c} - avg({c}) OVER (PARTITION BY ts)) / nullif(stddev_samp({c}) OVER (PARTITION BY ts), 0)"


# ---- composite signals -------------------------------------------------------------

TERMS = ["lim1", "lim5", "limsd", "volratio", "illiq20"]
COMP_CTE = stages("xbars", *LIQ_STAGES, name="q") + ",\n" + stages(
    "q4", {"lim1": "volume_imbalance", "lim5": s_avg("volume_imbalance", 5), "limsd": s_sd("volume_imbalance", 20),
           "volratio": "volume / nullif(v20, 0)", "illiq20": "amihud_20d"},
    {f"{t}_xz": xz(t) for t in TERMS},
    {"composite": "(" + " + ".join(f"coalesce({t}_xz, 0)" for t in TERMS) + ") / nullif(" +
                  " + ".join(f"CAST({t}_xz IS NOT NULL AS INTEGER)" for t in TERMS) + ", 0)"}, name="c")


def composite(spark, sf):
    x = pf.liquidity_features(views.cross_section_bars(spark, sf))
    x = x.withColumns({"lim1": F.col("volume_imbalance"), "lim5": S.mean("volume_imbalance", 5),
                       "limsd": S.sd("volume_imbalance", 20), "volratio": safe_div("volume", S.mean("volume", 20)),
                       "illiq20": F.col("amihud_20d")})
    x = pt.cross_zscore(x, TERMS)
    return x.withColumn("composite", pt.mean_available([f"{t}_xz" for t in TERMS]))


@query("wn_53_cross_zscore", sql(sel("c2", ["symbol", DAY], [f"{t}_xz" for t in TERMS]), "xbars", ctes=COMP_CTE))
def cross_zscore(spark, sf):
    x = composite(spark, sf).withColumn("session", views.day())
    return out(x, "symbol", "session", r=[f"{t}_xz" for t in TERMS])


@query("wn_54_composite_signal", sql(sel("c3", ["symbol", DAY], ["composite"]), "xbars", ctes=COMP_CTE))
def composite_signal(spark, sf):
    return out(composite(spark, sf).withColumn("session", views.day()), "symbol", "session", r=["composite"])


SIGNS = {"vshock_1d": -1, "vshock_5d": -1, "vol_mean_rev": -1, "skew_20": 1, "correlation_spike": -1}
SIGNED_STAGES = [*SHOCK_STAGES, {f"{t}_xz": xz(t) for t in SIGNS},
                 {"signal": "(" + " + ".join(f"{t}_xz * {v}" for t, v in SIGNS.items()) + ") / 5.0"}]


@query("wn_55_signed_composite", sql(sel("k6", ["symbol", DAY], ["signal"]), "dbars",
                                     ctes=SHOCK_CTE + ",\n" + stages("sh", *SIGNED_STAGES, name="k")))
def signed_composite(spark, sf):
    """All five terms required, default norms."""
    x = pf.volatility_shock_features(union_grid(views.common_bars(spark, sf)))
    x = pt.cross_zscore(x, list(SIGNS))
    x = x.withColumn("signal", pt.mean_signed({f"{t}_xz": v for t, v in SIGNS.items()}))
    return out(x.withColumn("session", views.day()), "symbol", "session", r=["signal"])


# ---- decile book ---------------------------------------------------------------------

DECILE = dict(long_pct=20, short_pct=20, max_weight=0.15, sector_net=0.10, sector_gross=0.35, min_members=10, every=5)
DECILE_CTE = COMP_CTE + ",\n" + GRID_CTE.format(v="xbars") + """,
p0 AS (SELECT g.symbol, g.ts, g.close, g.volume, composite AS signal, 'sector' || CAST(CAST(substr(g.symbol, 7) AS INTEGER) % 4 AS VARCHAR) AS sector,
  dense_rank() OVER (ORDER BY g.ts) - 1 AS sno FROM g LEFT JOIN c3 ON c3.symbol = g.symbol AND c3.ts = g.ts),
p1 AS (SELECT *, count(signal) OVER (PARTITION BY ts) AS n, row_number() OVER (PARTITION BY ts ORDER BY signal ASC NULLS LAST, symbol) AS rk FROM p0),
p2 AS (SELECT *, least(n, greatest(1, CAST(round_even(n * 20 / 100.0, 0) AS BIGINT))) AS leg FROM p1),
p3 AS (SELECT *, CASE WHEN n < 10 OR signal IS NULL THEN 0 WHEN rk <= leg THEN 1 WHEN rk > n - leg THEN -1 ELSE 0 END AS side FROM p2),
p4 AS (SELECT *, count(*) FILTER (WHERE side = 1) OVER (PARTITION BY ts) AS nl, count(*) FILTER (WHERE side = -1) OVER (PARTITION BY ts) AS ns FROM p3),
p5 AS (SELECT *, greatest(-0.15, least(0.15, CASE side WHEN 1 THEN (CASE WHEN ns > 0 THEN 0.5 ELSE 1.0 END) / nl
  WHEN -1 THEN -(CASE WHEN nl > 0 THEN 0.5 ELSE 1.0 END) / ns ELSE 0.0 END)) AS w0 FROM p4),
p6 AS (SELECT *, sum(abs(w0)) OVER (PARTITION BY ts, sector) AS sg, abs(sum(w0) OVER (PARTITION BY ts, sector)) AS sn FROM p5),
p7 AS (SELECT *, w0 * least(1.0, CASE WHEN sg > 0.35 THEN 0.35 / sg ELSE 1.0 END, CASE WHEN sn > 0.10 THEN 0.10 / sn ELSE 1.0 END) AS w1 FROM p6),
p8 AS (SELECT *, sum(greatest(w1, 0)) OVER (PARTITION BY ts) AS ls, sum(greatest(-w1, 0)) OVER (PARTITION BY ts) AS ss FROM p7),
p9 AS (SELECT *, CASE WHEN ls > 0 AND ss > 0 AND ((ls > ss AND w1 > 0) OR (ls <= ss AND w1 < 0)) THEN w1 * least(ls, ss) / greatest(ls, ss) ELSE w1 END AS w2 FROM p8),
bk AS (SELECT symbol, ts, close, volume, sector, coalesce(last_value(CASE WHEN sno % 5 = 0 THEN w2 END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0.0) AS w FROM p9)"""


def decile(spark, sf, **change):
    grid = grid_bars(spark, sf, cross_section=True)
    sig = composite(spark, sf).select("symbol", "ts", F.col("composite").alias("signal"))
    x = grid.join(sig, ["symbol", "ts"], "left").withColumn(
        "sector", F.concat(F.lit("sector"), (F.substring("symbol", 7, 4).cast("int") % 4).cast("string")))
    return pt.decile_book(x, **{**DECILE, **change})


@query("pf_01_decile_book", sql(sel("bk", ["symbol", DAY], ["w"]), "xbars", ctes=DECILE_CTE))
def decile_book(spark, sf):
    return out(decile(spark, sf).withColumn("session", views.day()), "symbol", "session", r=["w"])


@query("sr_01_decile_legs", sql(f"SELECT {DAY}, count(*) FILTER (WHERE side = 1) AS n_long, count(*) FILTER (WHERE side = -1) AS n_short "
                                "FROM p3 WHERE sno % 5 = 0 GROUP BY ts", "xbars", ctes=DECILE_CTE))
def decile_legs(spark, sf):
    """Leg sizes at each rebalance, seen through an uncapped book."""
    x = pt.session_index(decile(spark, sf, max_weight=1.0, sector_net=9.0, sector_gross=9.0, neutral=False))
    return x.where("session_no % 5 = 0").groupBy("ts").agg(
        F.count_if(F.col("w") > 0).alias("n_long"), F.count_if(F.col("w") < 0).alias("n_short")).select(
        views.day().alias("session"), "n_long", "n_short")


@query("sr_02_rebalance_sessions", sql(
    f"SELECT {DAY}, sno % 5 = 0 AS every_fifth, isodow(ts) = 3 AS wednesday FROM (SELECT DISTINCT ts, sno FROM p0)", "xbars", ctes=DECILE_CTE))
def rebalance_sessions(spark, sf):
    x = pt.session_index(views.cross_section_bars(spark, sf)).select("ts", "session_no").distinct()
    return x.select(views.day().alias("session"), (F.col("session_no") % 5 == 0).alias("every_fifth"),
                    (F.weekday("ts") == 2).alias("wednesday"))


@query("sr_03_hold_forward", sql(
    f"""SELECT symbol, {DAY}, round(coalesce(last_value(CASE WHEN isodow(ts) = 3 THEN close END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0.0), 6) + 0.0 AS w FROM bars""", "bars"))
def hold_forward(spark, sf):
    b = views.bars(spark, sf).withColumn("target", F.when(F.weekday("ts") == 2, F.col("close")))
    return out(pt.hold_targets(b).withColumn("session", views.day()), "symbol", "session", r=["w"])


@query("pf_04_position_limits", sql(
    f"""SELECT symbol, {DAY}, round(v * CASE WHEN g > 0.3 THEN 0.3 / g ELSE 1 END, 8) + 0.0 AS w
  FROM (SELECT *, sum(abs(v)) OVER (PARTITION BY ts) AS g FROM (SELECT *, greatest(-0.05, least(0.05, w)) AS v FROM bk))""", "xbars", ctes=DECILE_CTE))
def position_limits(spark, sf):
    x = pt.position_limits(decile(spark, sf), 0.05, 0.3).withColumn("session", views.day())
    return out(x, "symbol", "session", r=["w"], digits=8)


RETURNS_CTE = """e1 AS (SELECT symbol, ts, sector, w, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts), 0) AS ew,
   lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd, close, volume FROM bk),
e2 AS (SELECT *, abs(ew - coalesce(lag(ew) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS d FROM e1),
pr AS (SELECT ts, coalesce(sum(ew * fwd), 0) AS gross, sum(d) AS turnover, coalesce(sum(ew * fwd), 0) - sum(d) * 6 / 10000.0 AS net FROM e2 GROUP BY ts)"""


@query("bt_05_book_returns", sql(f"SELECT {DAY}, round(gross, 8) + 0.0 AS gross, round(turnover, 8) + 0.0 AS turnover, "
                                 "round(turnover * 5 / 10000.0, 8) + 0.0 AS fee_cost, round(net, 8) + 0.0 AS net FROM pr",
                                 "xbars", ctes=DECILE_CTE + ",\n" + RETURNS_CTE))
def book_returns(spark, sf):
    book = decile(spark, sf)
    x = bt.portfolio_returns(book.select("symbol", "ts", "w"), grid_bars(spark, sf, cross_section=True))
    return out(x.withColumn("session", views.day()), "session", r=["gross", "turnover", "fee_cost", "net"], digits=8)


@query("jn_12_weights_on_closes", sql("SELECT symbol, count(*) AS n_rows, count(*) FILTER (WHERE w <> 0) AS n_live FROM bk WHERE close IS NOT NULL GROUP BY 1",
                                      "xbars", ctes=DECILE_CTE))
def weights_on_closes(spark, sf):
    closes = views.cross_section_bars(spark, sf).select("symbol", "ts")
    x = decile(spark, sf).select("symbol", "ts", "w").join(closes, ["symbol", "ts"])
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("w") != 0).alias("n_live"))


@query("ag_12_concentration", sql(f"SELECT {DAY}, round(coalesce(sum(w * w) / nullif(pow(sum(abs(w)), 2), 0), 0), 8) + 0.0 AS hhi FROM bk GROUP BY ts",
                                  "xbars", ctes=DECILE_CTE))
def concentration(spark, sf):
    return out(mt.concentration(decile(spark, sf)).withColumn("session", views.day()), "session", r=["hhi"], digits=8)


@query("ag_18_capacity", sql(
    """SELECT round(quantile_cont(0.01 * adv / t, 0.05) / 1e6, 8) AS capacity_millions, count(*) AS n_trades
  FROM (SELECT abs(w - lag(w) OVER (PARTITION BY symbol ORDER BY ts)) AS t,
          CASE WHEN count(close * volume) OVER z = 20 THEN avg(close * volume) OVER z END AS adv FROM bk
        WINDOW z AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  WHERE t > 1e-12 AND adv IS NOT NULL""", "xbars", ctes=DECILE_CTE))
def capacity(spark, sf):
    x = pt.capacity_millions(decile(spark, sf).select("symbol", "ts", "w"), grid_bars(spark, sf, cross_section=True))
    return out(x, "n_trades", r=["capacity_millions"], digits=8)


RISK_CTE = DECILE_CTE + ",\n" + RETURNS_CTE + ",\np AS (SELECT *, 'decile' AS strategy FROM pr),\n" + path_ctes(
    "(SELECT *, 0.0 AS position FROM p)", "strategy") + """,
bm AS (SELECT m.*, fwd AS bench FROM m LEFT JOIN (SELECT ts, fwd FROM e1 WHERE symbol = 'Brand#1') b USING (ts)),
cc AS (SELECT *, CASE WHEN count(*) OVER w = 60 AND stddev_samp(net) OVER w > 0 THEN corr(net, bench) OVER w END AS c FROM bm WHERE bench IS NOT NULL
  WINDOW w AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
xp AS (SELECT ts, sum(abs(w)) AS g, sum(abs(w - pw)) AS t, coalesce(sum(w * w) / nullif(pow(sum(abs(w)), 2), 0), 0) AS hhi
  FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts), 0) AS pw FROM bk) GROUP BY ts)"""
RISK_SQL = {
    "annualized_vol": "(SELECT stddev_samp(net) * sqrt(252.0) FROM m)", "max_drawdown": "(SELECT min(dd) FROM m)",
    "var_95_daily": "(SELECT -max(q05) FROM m)", "cvar_95_daily": "(SELECT -avg(net) FILTER (WHERE net <= q05) FROM m)",
    "worst_single_day": "(SELECT min(net) FROM m)", "beta_to_benchmark": "(SELECT covar_samp(net, bench) / var_samp(bench) FROM cc)",
    "max_60d_correlation": "(SELECT max(c) FROM cc)", "avg_gross_exposure": "(SELECT avg(g) FROM xp)",
    "max_gross_exposure": "(SELECT max(g) FROM xp)", "annual_turnover": "(SELECT sum(t) / (count(*) / 252.0) FROM xp)",
    "concentration_hhi_median": "(SELECT quantile_cont(hhi, 0.5) FROM xp)", "concentration_hhi_worst": "(SELECT max(hhi) FROM xp)"}


@query("ag_13_risk_report", sql("SELECT 'decile' AS strategy, (SELECT count(*) FROM m) AS n_obs, " + ", ".join(
    f"round({e}, 6) + 0.0 AS {c}" for c, e in RISK_SQL.items()), "xbars", ctes=RISK_CTE))
def risk_report(spark, sf):
    book = decile(spark, sf).withColumn("strategy", F.lit("decile"))
    grid = grid_bars(spark, sf, cross_section=True)
    net = bt.portfolio_returns(book.select("strategy", "symbol", "ts", "w"), grid, keys=("strategy",))
    bench = grid.where("symbol = 'Brand#1'").withColumn("bench", safe_div(S.lead("close"), "close") - 1.0).select("ts", "bench")
    x = mt.risk_report(net, book.select("strategy", "symbol", "ts", "w"), bench)
    return out(x, "strategy", "n_obs", r=mt.RISK)


@query("wn_57_max_rolling_correlation", sql("SELECT 'decile' AS strategy, round(max(c), 6) + 0.0 AS max_60d_correlation FROM cc", "xbars", ctes=RISK_CTE))
def max_correlation(spark, sf):
    return risk_report(spark, sf).select("strategy", "max_60d_correlation")


# ---- weekly books ----------------------------------------------------------------------

CLASSES = {"STANDARD": "equity", "LARGE": "equity", "MEDIUM": "equity", "SMALL": "fixed_income", "ECONOMY": "fixed_income",
           "PROMO": "commodity"}
CAPS = {"equity": 0.20, "fixed_income": 0.15, "commodity": 0.10}
WEEK_CTE = GRID_CTE.format(v="bars") + """,
w0 AS (SELECT g.*, CASE symbol WHEN 'STANDARD' THEN 'equity' WHEN 'LARGE' THEN 'equity' WHEN 'MEDIUM' THEN 'equity' WHEN 'PROMO' THEN 'commodity'
   ELSE 'fixed_income' END AS asset_class, close / lag(close) OVER s - 1 AS ret, close / lag(close, 20) OVER s - 1 AS mom,
   row_number() OVER s AS rn FROM g WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
w1 AS (SELECT w0.*, """ + f"-({xz('mom')})" + """ AS signal, CASE WHEN count(ret) OVER z = 20 THEN stddev_samp(ret) OVER z * sqrt(252.0) END AS vol,
   count(*) FILTER (WHERE close IS NULL) OVER z AS missing, max(CASE WHEN symbol = 'PROMO' THEN close / 50.0 END) OVER (PARTITION BY ts) AS vix FROM w0
   WINDOW z AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
wk AS (SELECT * FROM w1 WHERE isodow(ts) = 3)"""


def _ex_ante_sql(src, name):
    return f"""{name} AS (SELECT ts, sqrt(var_samp(p) * 252.0) AS eav FROM (SELECT b.ts, r.rn, sum(b.w * r.ret) AS p FROM {src} b JOIN w1 r
  ON r.symbol = b.symbol AND r.rn BETWEEN b.rn - 19 AND b.rn WHERE b.w <> 0 GROUP BY b.ts, r.rn) GROUP BY ts)"""


def week_frame(spark, sf):
    g = grid_bars(spark, sf)
    cls = F.create_map(*[F.lit(v) for kv in CLASSES.items() for v in kv])[F.col("symbol")]
    vix = g.where("symbol = 'PROMO'").select("ts", (F.col("close") / 50.0).alias("vix"))
    x = g.withColumns({"mom": S.pct_change("close", 20), "asset_class": cls})
    x = pt.cross_zscore(x, ["mom"]).withColumn("signal", -F.col("mom_xz"))
    return x.join(vix, "ts", "left")


INV = dict(vol_bars=20, min_assets=3, vix_stop=20.0, max_weight=0.12, class_cap=0.25, equity_net=0.10, target_vol=0.06)
INV_CTE = WEEK_CTE + """,
i1 AS (SELECT *, signal IS NOT NULL AND vol > 0 AS ok FROM wk),
i2 AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY ts) AS n, CASE WHEN ok THEN sign(signal) / vol ELSE 0.0 END AS inv FROM i1),
i3 AS (SELECT *, sum(abs(inv)) OVER (PARTITION BY ts) AS gsum, n >= 3 AND NOT coalesce(vix > 20.0, false) AS live FROM i2),
i4 AS (SELECT *, CASE WHEN live AND gsum > 0 THEN greatest(-0.12, least(0.12, inv * 0.5 / gsum)) ELSE 0.0 END AS w FROM i3),
i5 AS (SELECT * REPLACE (w * CASE WHEN sum(abs(w)) OVER (PARTITION BY ts, asset_class) > 0.25 THEN 0.25 / sum(abs(w)) OVER (PARTITION BY ts, asset_class) ELSE 1 END AS w) FROM i4),
i6 AS (SELECT *, abs(sum(w) FILTER (WHERE asset_class = 'equity') OVER (PARTITION BY ts)) AS en FROM i5),
i7 AS (SELECT * REPLACE (CASE WHEN asset_class = 'equity' AND en > 0.10 THEN w * 0.10 / en ELSE w END AS w) FROM i6),
""" + _ex_ante_sql("i7", "iv") + """,
i8 AS (SELECT i7.symbol, i7.ts, w * CASE WHEN eav > 0.06 THEN 0.06 / eav ELSE 1 END AS target FROM i7 LEFT JOIN iv USING (ts)),
ib AS (SELECT w1.symbol, w1.ts, asset_class, close, coalesce(last_value(target IGNORE NULLS) OVER (PARTITION BY w1.symbol ORDER BY w1.ts ROWS UNBOUNDED PRECEDING), 0.0) AS w
  FROM w1 LEFT JOIN i8 ON i8.symbol = w1.symbol AND i8.ts = w1.ts)"""


def inverse_vol(spark, sf):
    return pt.inverse_vol_book(week_frame(spark, sf), **INV)


@query("pf_02_inverse_vol_book", sql(sel("ib", ["symbol", DAY], ["w"]), "bars", ctes=INV_CTE))
def inverse_vol_book(spark, sf):
    return out(inverse_vol(spark, sf).withColumn("session", views.day()), "symbol", "session", r=["w"])


LIMITS = dict(max_abs_weight=0.12, max_gross=0.5, max_class_gross=0.25, max_abs_net=0.10)


@query("val_22_limit_audit", sql("""SELECT round(max(mw), 8) AS max_abs_weight, round(max(g), 8) AS max_gross, round(max(cg), 8) AS max_class_gross,
  round(max(net), 8) AS max_abs_net, true AS passed FROM (SELECT ts, max(mw) AS mw, sum(cg) AS g, max(cg) AS cg, abs(sum(en)) AS net FROM (
    SELECT ts, asset_class, max(abs(w)) AS mw, sum(abs(w)) AS cg, sum(CASE WHEN asset_class = 'equity' THEN w ELSE 0 END) AS en FROM ib GROUP BY 1, 2) GROUP BY ts)""",
                                 "bars", ctes=INV_CTE))
def limit_audit(spark, sf):
    x = pt.limit_audit(inverse_vol(spark, sf), LIMITS, "equity")
    return out(x, "passed", r=list(LIMITS), digits=8)


MAG = dict(class_caps=CAPS, vol_bars=20, min_assets=3, max_weight=0.10, gross_cap=0.40, net_cap=0.10, target_vol=0.04, vix_level=19.0,
           vix_gross=0.15, turnover_cap=8.0, turnover_scale=0.70)
MAG_CTE = WEEK_CTE + """,
n1 AS (SELECT *, signal IS NOT NULL AND vol IS NOT NULL AND missing <= 5 AS ok, CASE asset_class WHEN 'equity' THEN 0.20 WHEN 'fixed_income' THEN 0.15 ELSE 0.10 END AS cap FROM wk),
n2 AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY ts) AS n FROM n1),
n3 AS (SELECT *, CASE WHEN ok AND n >= 3 AND vol <> 0 THEN greatest(-0.10, least(0.10, signal * 0.08 / vol)) ELSE 0.0 END AS w FROM n2),
n4 AS (SELECT * REPLACE (w * CASE WHEN sum(abs(w)) OVER (PARTITION BY ts, asset_class) > cap THEN cap / sum(abs(w)) OVER (PARTITION BY ts, asset_class) ELSE 1 END AS w) FROM n3),
n5 AS (SELECT * REPLACE (w * CASE WHEN sum(abs(w)) OVER (PARTITION BY ts) > 0.40 THEN 0.40 / sum(abs(w)) OVER (PARTITION BY ts) ELSE 1 END AS w) FROM n4),
n6 AS (SELECT * REPLACE (w * CASE WHEN abs(sum(w) OVER (PARTITION BY ts)) > 0.10 THEN 0.10 / abs(sum(w) OVER (PARTITION BY ts)) ELSE 1 END AS w) FROM n5),
""" + _ex_ante_sql("n6", "nv") + """,
n7 AS (SELECT n6.* REPLACE (w * CASE WHEN eav > 0.04 THEN 0.04 / eav ELSE 1 END AS w) FROM n6 LEFT JOIN nv USING (ts)),
n8 AS (SELECT * REPLACE (CASE WHEN vix > 19.0 AND sum(abs(w)) OVER (PARTITION BY ts) > 0.15 THEN w * 0.15 / sum(abs(w)) OVER (PARTITION BY ts) ELSE w END AS w) FROM n7),
n9 AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k, sum(abs(w - p)) * 26 AS a, sum(abs(w - 0.7 * p)) * 26 AS b
  FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts), 0) AS p FROM n8) GROUP BY ts),
na(k, s) AS (SELECT 0::BIGINT, 1.0::DOUBLE UNION ALL SELECT n9.k, CASE WHEN (CASE WHEN na.s = 1.0 THEN a ELSE b END) > 8.0 THEN 0.7 ELSE 1.0 END
  FROM na JOIN n9 ON n9.k = na.k + 1),
nt AS (SELECT n8.symbol, n8.ts, n8.w * na.s AS target FROM n8 JOIN n9 USING (ts) JOIN na USING (k)),
nb AS (SELECT w1.symbol, w1.ts, asset_class, close, coalesce(last_value(target IGNORE NULLS) OVER (PARTITION BY w1.symbol ORDER BY w1.ts ROWS UNBOUNDED PRECEDING), 0.0) AS w
  FROM w1 LEFT JOIN nt ON nt.symbol = w1.symbol AND nt.ts = w1.ts)"""


def magnitude(spark, sf):
    return pt.magnitude_book(week_frame(spark, sf), **MAG)


@query("pf_03_magnitude_book", sql(sel("nb", ["symbol", DAY], ["w"]), "bars", ctes=MAG_CTE))
def magnitude_book(spark, sf):
    """The SQL walks the weekly turnover rule step by step; Spark uses the two-state window form."""
    return out(magnitude(spark, sf).withColumn("session", views.day()), "symbol", "session", r=["w"])


CASH_SQL = """x1 AS (SELECT symbol, ts, coalesce(lag(w) OVER s, 0) AS ew, lead(close) OVER s / close - 1 AS fwd FROM nb WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
x2 AS (SELECT *, abs(ew - coalesce(lag(ew) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS d FROM x1),
x3 AS (SELECT ts, coalesce(sum(ew * fwd), 0) AS gross, sum(d) AS turnover FROM x2 GROUP BY ts),
x4 AS (SELECT x3.ts, gross - coalesce(c.fwd, 0) AS gross, turnover, gross - turnover * 6 / 10000.0 - coalesce(c.fwd, 0) AS net FROM x3 LEFT JOIN (SELECT ts, fwd FROM x1 WHERE symbol = 'ECONOMY') c USING (ts))"""


def excess_returns(spark, sf):
    g = grid_bars(spark, sf)
    book = bt.portfolio_returns(magnitude(spark, sf).select("symbol", "ts", "w"), g)
    cash = g.withColumn("cash_fwd", safe_div(S.lead("close"), "close") - 1.0).where("symbol = 'ECONOMY'").select("ts", "cash_fwd")
    return bt.excess(book, cash)


@query("bt_06_excess_over_cash", sql(f"SELECT {DAY}, round(gross, 8) + 0.0 AS gross, round(net, 8) + 0.0 AS net FROM x4", "bars", ctes=MAG_CTE + ",\n" + CASH_SQL))
def excess_over_cash(spark, sf):
    return out(excess_returns(spark, sf).withColumn("session", views.day()), "session", r=["gross", "net"], digits=8)


@query("pf_05_turnover_control", sql(
    f"SELECT symbol, {DAY}, round(w, 6) + 0.0 AS w FROM (SELECT ts, unnest(syms) AS symbol, unnest(v) AS w FROM tr JOIN tv USING (k))", "bars", ctes=INV_CTE + """,
tv AS MATERIALIZED (SELECT ts, row_number() OVER (ORDER BY ts) AS k, list(symbol ORDER BY symbol) AS syms, list(w ORDER BY symbol) AS t FROM ib GROUP BY ts),
tr(k, v) AS (SELECT 0::BIGINT, [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0, 0.0] UNION ALL
  SELECT tv.k, CASE WHEN d > 0.05 THEN list_transform(list_zip(tv.t, tr.v), lambda x: x[2] + (x[1] - x[2]) * (0.05 / d)) ELSE tv.t END
  FROM (SELECT tv.k, tv.t, tr.v, list_sum(list_transform(list_zip(tv.t, tr.v), lambda x: abs(x[1] - x[2]))) AS d FROM tr JOIN tv ON tv.k = tr.k + 1) tv, LATERAL (SELECT tv.v) tr(v))"""))
def turnover_control(spark, sf):
    book = inverse_vol(spark, sf).select(F.lit("weekly").alias("strategy"), "symbol", "ts", "w")
    x = pt.turnover_control(book, 0.05).withColumn("session", views.day())
    return out(x, "symbol", "session", r=["w"])


# ---- set operations -----------------------------------------------------------------------

@query("st_01_union_of_frames", sql(f"SELECT symbol, {DAY}, close FROM bars WHERE symbol IN ('ECONOMY', 'SMALL') UNION ALL "
                                    f"SELECT symbol, {DAY}, close FROM bars WHERE symbol = 'LARGE'", "bars"))
def union_frames(spark, sf):
    b = views.bars(spark, sf).select("symbol", views.day().alias("session"), "close")
    return b.where("symbol IN ('ECONOMY', 'SMALL')").unionByName(b.where("symbol = 'LARGE'"))


@query("st_02_missing_sessions", sql(
    f"SELECT symbol, {DAY} FROM (SELECT symbol, ts FROM g EXCEPT SELECT symbol, ts FROM bars)", "bars", ctes=GRID_CTE.format(v="bars")))
def missing_sessions(spark, sf):
    b = views.bars(spark, sf)
    return grid_bars(spark, sf).select("symbol", "ts").join(b.select("symbol", "ts"), ["symbol", "ts"], "left_anti").select(
        "symbol", views.day().alias("session"))


@query("st_03_common_sessions", sql(f"SELECT {DAY} FROM (SELECT ts FROM bars WHERE symbol = 'SMALL' INTERSECT SELECT ts FROM bars WHERE symbol = 'LARGE')", "bars"))
def intersect_sessions(spark, sf):
    b = views.bars(spark, sf)
    return b.where("symbol = 'SMALL'").select("ts").intersect(b.where("symbol = 'LARGE'").select("ts")).select(views.day().alias("session"))


@query("st_04_distinct_scenarios", "SELECT DISTINCT l_discount AS fee, l_tax AS slippage FROM lineitem")
def distinct_scenarios(spark, sf):
    return views.table(spark, sf, "lineitem").select(F.col("l_discount").alias("fee"), F.col("l_tax").alias("slippage")).dropDuplicates()


@query("rg_04_flat_feature_panel", sql(
    f"SELECT {DAY}, " + ", ".join(f"round(max(CASE WHEN symbol = '{s}' THEN {f} END), 6) + 0.0 AS {s}_{f}" for s in ("ECONOMY", "SMALL") for f in ("ret", "mom"))
    + " FROM f1 GROUP BY ts", "bars", ctes=stages("bars", {**RET, "mom": "close / lag(close, 63) OVER (PARTITION BY symbol ORDER BY ts) - 1"})))
def flat_panel(spark, sf):
    """One column per symbol and feature, for diagnostics and manifests."""
    x = pf.momentum(pf.returns(views.bars(spark, sf)), 63, name="mom")
    wide = x.groupBy("ts").pivot("symbol", ["ECONOMY", "SMALL"]).agg(F.first("ret", True).alias("ret"), F.first("mom", True).alias("mom"))
    cols = [c for c in wide.columns if c != "ts"]
    return out(wide.withColumn("session", views.day()), "session", r=cols)
