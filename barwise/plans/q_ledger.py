"""Fill ledger, settlement, controls and governance checked against SQL (LG, AG-19..22, FN, PR, RG, JN-15/16, SR-9/10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.operators import governance as gov
from barwise.operators import ledger as lg
from barwise.operators import metrics as mt
from barwise.operators import price_features as pf
from barwise.operators import statistics as st
from barwise.operators import validation as val
from barwise.plans import q_backtest, q_evaluation, q_sources
from barwise.plans.catalogue import out, query, sel, sql, stages
from barwise.plans.q_backtest import S_SHARPE, led_sql
from barwise.plans.q_windows import LIQ_STAGES
from barwise.sources import views

WIDTH = 8000  # small chunks, so the small tables exercise chunk borders

POS_CTE = """fr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY seq) AS rn FROM fills),
pw(account, symbol, rn, seq, q0, q, basis0, basis, realized) AS (SELECT DISTINCT account, symbol, 0::BIGINT, NULL::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM fr
  UNION ALL SELECT f.account, f.symbol, f.rn, f.seq, p.q, p.q + signed_qty, p.basis,
    CASE WHEN p.q * signed_qty >= 0 THEN p.basis + quantity * price WHEN quantity > abs(p.q) THEN abs(p.q + signed_qty) * price ELSE p.basis * abs(p.q + signed_qty) / abs(p.q) END,
    CASE WHEN p.q * signed_qty >= 0 THEN 0.0 ELSE sign(p.q) * (price - p.basis / abs(p.q)) * least(quantity, abs(p.q)) END
  FROM pw p JOIN fr f ON f.account = p.account AND f.symbol = p.symbol AND f.rn = p.rn + 1),
pos AS MATERIALIZED (SELECT w.*, f.session FROM pw w JOIN fr f USING (seq))"""


@query("lg_01_position_path", sql(
    "SELECT seq, q AS q_after, round(coalesce(basis / nullif(abs(q), 0), 0) + 3.3e-8, 6) + 0.0 AS avg_after, round(realized + 3.3e-8, 6) + 0.0 AS realized FROM pos", "fills", ctes=POS_CTE))
def position_path(spark, sf):
    x = lg.positions(views.fills(spark, sf), WIDTH)
    # A small offset on both sides keeps exact decimal ties off the rounding edge.
    x = x.withColumns({c: F.col(c) + 3.3e-8 for c in ("avg_after", "realized")})
    return out(x, "seq", "q_after", r=["avg_after", "realized"])


@query("lg_01_final_positions", sql("SELECT account, symbol, arg_max(q, rn) AS quantity, round(coalesce(arg_max(basis, rn) / nullif(abs(arg_max(q, rn)), 0), 0) + 3.3e-8, 6) + 0.0 AS avg_entry, "
                                    "round(sum(realized) + 3.3e-8, 5) + 0.0 AS realized_pnl, count(*) AS n_fills FROM pos GROUP BY 1, 2", "fills", ctes=POS_CTE))
def final_positions(spark, sf):
    x = lg.final_positions(views.fills(spark, sf), WIDTH)
    return x.select("account", "symbol", "quantity", (F.round(F.col("avg_entry") + 3.3e-8, 6) + F.lit(0.0)).alias("avg_entry"),
                    (F.round(F.col("realized_pnl") + 3.3e-8, 5) + F.lit(0.0)).alias("realized_pnl"), "n_fills")


EQ_CTE = POS_CTE + """,
dd AS (SELECT DISTINCT session FROM marks), kk AS (SELECT DISTINCT account, symbol FROM fills),
pd AS (SELECT account, symbol, session, arg_max(q, seq) AS q, arg_max(basis, seq) AS basis, sum(realized) AS r FROM pos GROUP BY 1, 2, 3),
hg AS (SELECT account, symbol, session, coalesce(last_value(q IGNORE NULLS) OVER w, 0) AS quantity, coalesce(last_value(basis IGNORE NULLS) OVER w, 0) AS basis,
  coalesce(sum(r) OVER w, 0) AS realized_pnl, last_value(mark IGNORE NULLS) OVER w AS mark
  FROM kk CROSS JOIN dd LEFT JOIN pd USING (account, symbol, session) LEFT JOIN marks USING (symbol, session) WINDOW w AS (PARTITION BY account, symbol ORDER BY session ROWS UNBOUNDED PRECEDING)),
hp AS (SELECT account, session, sum(coalesce(quantity * mark, 0)) AS position_value, sum(realized_pnl) AS realized_pnl, sum(coalesce(quantity * mark - sign(quantity) * basis, 0)) AS unrealized_pnl,
  count(*) FILTER (WHERE abs(quantity) > 1e-12) AS open_positions FROM hg GROUP BY 1, 2),
fl AS (SELECT account, session, sum(-signed_qty * price - quantity * price * 5 / 10000.0) AS flow, sum(quantity * price * 5 / 10000.0) AS fee FROM fills GROUP BY 1, 2),
e1 AS (SELECT hp.*, 1000000.0 + coalesce(sum(flow) OVER w, 0) AS cash, coalesce(sum(fee) OVER w, 0) AS fees FROM hp LEFT JOIN fl USING (account, session) WINDOW w AS (PARTITION BY account ORDER BY session ROWS UNBOUNDED PRECEDING)),
e2 AS (SELECT *, cash + position_value AS value FROM e1),
e3 AS (SELECT *, greatest(1000000.0, max(value) OVER (PARTITION BY account ORDER BY session ROWS UNBOUNDED PRECEDING)) AS peak FROM e2),
eq AS (SELECT *, (value - peak) / peak AS drawdown, value - 1000000.0 AS net_pnl, value - 1000000.0 - (realized_pnl + unrealized_pnl - fees) AS identity_gap FROM e3)"""
SES = "strftime(session, '%Y-%m-%d') AS session"
MONEY = ["cash", "value", "net_pnl", "realized_pnl", "unrealized_pnl", "fees"]


def books(spark, sf):
    f = views.fills(spark, sf)
    return f, views.marks(f)


def ses(df):
    return df.withColumn("session", F.date_format("session", "yyyy-MM-dd"))


@query("lg_02_equity_drawdown", sql(sel("eq", ["account", SES, "open_positions"], ["cash", "value", "peak", "drawdown"], 5), "fills", "marks", ctes=EQ_CTE))
def equity(spark, sf):
    return out(ses(lg.equity(*books(spark, sf), width=WIDTH)), "account", "session", "open_positions", r=["cash", "value", "peak", "drawdown"], digits=5)


@query("ag_22_daily_settlement", sql(sel("(SELECT *, abs(identity_gap) <= 1e-6 AS identity_valid FROM eq)", ["account", SES, "identity_valid"], MONEY, 2), "fills", "marks", ctes=EQ_CTE))
def settlement(spark, sf):
    return out(ses(lg.settlement(*books(spark, sf), width=WIDTH)), "account", "session", "identity_valid", r=MONEY, digits=2)


COST_SQL = "SELECT {k}, round(sum(n * 5 / 10000.0), 6) AS fees, round(sum(n * 1 / 10000.0), 6) AS slippage, round(sum(n * 0.5 / 10000.0), 6) AS spread, round(sum(n), 4) AS notional, round(sum(n * 6.5 / 10000.0), 6) AS total FROM (SELECT *, quantity * price AS n FROM fills) GROUP BY {k}"


@query("ag_19_cost_attribution", sql(COST_SQL.format(k="account"), "fills"))
def costs(spark, sf):
    x = lg.cost_attribution(views.fills(spark, sf))
    return x.select("account", *[F.round(c, 6).alias(c) for c in ("fees", "slippage", "spread", "total")], F.round("notional", 4).alias("notional"))


STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'PENDING' ELSE 'REJECTED' END"


def order_rows(spark, sf):
    s = F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("REJECTED")
    return views.fills(spark, sf).withColumn("status", s)


@query("ag_20_order_status_counts", sql(f"SELECT {SES}, count(*) FILTER (WHERE s = 'FILLED') AS filled, count(*) FILTER (WHERE s = 'PENDING') AS pending, count(*) FILTER (WHERE s = 'REJECTED') AS rejected "
                                        f"FROM (SELECT session, {STATUS_SQL} AS s FROM fills) GROUP BY fills.session".replace("GROUP BY fills.session", "GROUP BY 1"), "fills"))
def status_counts(spark, sf):
    return ses(lg.order_status_counts(order_rows(spark, sf), ["FILLED", "PENDING", "REJECTED"]))


@query("ag_21_reconciliation", sql("""SELECT account, symbol, sum(signed_qty) AS expected, sum(signed_qty) + 1 AS actual FROM fills WHERE account = 3 GROUP BY 1, 2
  UNION ALL SELECT account, 'CASH', round(1000000.0 + sum(-signed_qty * price - quantity * price * 5 / 10000.0), 4), round(1000000.0 + sum(-signed_qty * price - quantity * price * 5 / 10000.0) + 10, 4) FROM fills WHERE account = 4 GROUP BY 1""", "fills"))
def reconciliation(spark, sf):
    """Reported books are the computed ones with account 3 and the cash of account 4 moved."""
    f, m = books(spark, sf)
    rep = lg.final_positions(f, WIDTH).withColumn("quantity", F.col("quantity") + F.when(F.col("account") == 3, 1.0).otherwise(0.0))
    cash = lg.equity(f, m, width=WIDTH).groupBy("account").agg(F.max_by("cash", "session").alias("cash"))
    cash = cash.withColumn("cash", F.col("cash") + F.when(F.col("account") == 4, 10.0).otherwise(0.0))
    x = lg.reconcile(f, rep, cash)
    return x.select("account", "symbol", F.round("expected", 4).alias("expected"), F.round("actual", 4).alias("actual"))


EXPO = ["gross_notional", "short_notional", "cash", "reserved_buy_cash", "equity", "gross_exposure", "short_margin_required", "available_cash"]


@query("lg_03_exposure_margin", sql(sel("""(SELECT account, gross_notional, short_notional, cash, coalesce(reserved, 0) AS reserved_buy_cash, greatest(cash + v, 0) AS equity,
   gross_notional / greatest(greatest(cash + v, 0), 1) AS gross_exposure, short_notional * 1.5 AS short_margin_required, cash - coalesce(reserved, 0) AS available_cash FROM (
   SELECT account, sum(abs(n)) AS gross_notional, sum(greatest(-n, 0)) AS short_notional, sum(q * coalesce(mark, 0)) AS v FROM (SELECT *, (q + p) * coalesce(mark, 0) AS n FROM (
     SELECT account, symbol, sum(CASE WHEN o_orderstatus <> 'O' THEN signed_qty ELSE 0 END) AS q, sum(CASE WHEN o_orderstatus = 'O' THEN signed_qty ELSE 0 END) AS p FROM fills GROUP BY 1, 2)
     LEFT JOIN (SELECT symbol, arg_max(mark, session) AS mark FROM marks GROUP BY 1) USING (symbol)) GROUP BY 1)
   JOIN (SELECT account, 1000000.0 + sum(-signed_qty * price - quantity * price * 5 / 10000.0) AS cash FROM fills WHERE o_orderstatus <> 'O' GROUP BY 1) USING (account)
   LEFT JOIN (SELECT account, sum(quantity * price * 1.0005) AS reserved FROM fills WHERE o_orderstatus = 'O' AND side = 'BUY' GROUP BY 1) USING (account))""", ["account"], EXPO, 4), "fills", "marks"))
def exposure(spark, sf):
    f, m = books(spark, sf)
    return out(lg.exposure(f.where("o_orderstatus <> 'O'"), m, f.where("o_orderstatus = 'O'"), width=WIDTH), "account", r=EXPO, digits=4)


# ---- hash chains -----------------------------------------------------------------------

PAY = "(account::VARCHAR || ';' || strftime(session, '%Y-%m-%d') || ';' || n::VARCHAR || ';' || q::BIGINT::VARCHAR)"
CHAIN_CTE = f"""dayf AS (SELECT account, session, count(*) AS n, sum(quantity) AS q FROM fills GROUP BY 1, 2),
cp AS MATERIALIZED (SELECT *, {PAY} AS payload, row_number() OVER (PARTITION BY account ORDER BY session) AS rn FROM dayf),
ch(account, rn, session, payload, previous_hash, report_hash) AS (SELECT DISTINCT account, 0::BIGINT, NULL::DATE, '', '', '' FROM cp
  UNION ALL SELECT c.account, c.rn, c.session, c.payload, h.report_hash, sha256(h.report_hash || '|' || c.payload) FROM ch h JOIN cp c ON c.account = h.account AND c.rn = h.rn + 1)"""


def report_chain(spark, sf):
    d = views.fills(spark, sf).groupBy("account", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("q"))
    text = F.concat_ws(";", F.col("account").cast("string"), F.date_format("session", "yyyy-MM-dd"), F.col("n").cast("string"), F.col("q").cast("long").cast("string"))
    return lg.chain_reports(d.withColumn("payload", text), "payload")


@query("ag_22_report_chain", sql(f"SELECT account, {SES}, previous_hash, report_hash FROM ch WHERE rn > 0", "fills", ctes=CHAIN_CTE))
def chained(spark, sf):
    return ses(report_chain(spark, sf)).select("account", "session", "previous_hash", "report_hash")


@query("fn_09_chain_verify", sql("SELECT account, count(*) FILTER (WHERE day(session) = 13) AS broken_digests, 0::BIGINT AS broken_links, count(*) AS n_reports FROM dayf GROUP BY 1", "fills", ctes=CHAIN_CTE.split(",\ncp AS")[0]))
def chain_verify(spark, sf):
    """Payloads of the 13th are altered after the fact; digests break there and only there."""
    x = report_chain(spark, sf).withColumn("payload", F.when(F.dayofmonth("session") == 13, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return lg.verify_chain(x, "payload").groupBy("account").agg(
        F.count_if("broken_digest").alias("broken_digests"), F.count_if("broken_link").alias("broken_links"), F.count(F.lit(1)).alias("n_reports"))


# ---- monitoring ---------------------------------------------------------------------------

AS_OF = "2001-12-31"


def state(spark, sf):
    f, m = books(spark, sf)
    orders = order_rows(spark, sf)
    e = lg.equity(f, m, width=WIDTH)
    a = lg.alerts(e, orders, lg.holdings(f, m, WIDTH), AS_OF)
    ack = orders.where("status = 'REJECTED' AND seq % 2 = 0").select("account", F.concat(F.lit("order_rejected:"), F.col("seq").cast("string")).alias("dedupe_key"))
    return f, m, orders, e, a, ack


ALERT_CTE = EQ_CTE + f""",
la AS (SELECT account, max(session) AS session, arg_max(net_pnl, session) AS net_pnl, arg_max(value, session) AS value FROM eq GROUP BY 1),
al AS (SELECT account, 'DATA_STALENESS' AS category, 'CRITICAL' AS severity, 'data_staleness' AS dedupe_key FROM la WHERE DATE '{AS_OF}' - session > 3
  UNION ALL SELECT account, 'PNL_THRESHOLD', 'CRITICAL', 'pnl_loss_threshold' FROM la WHERE net_pnl / 1000000.0 <= -0.02
  UNION ALL SELECT account, 'ORDER_REJECTION', 'WARNING', 'order_rejected:' || seq::VARCHAR FROM fills WHERE o_orderstatus = 'P'
  UNION ALL SELECT h.account, 'POSITION_LIMIT', 'WARNING', 'position_limit:' || symbol FROM (SELECT account, symbol, arg_max(quantity * mark, session) AS mv FROM hg GROUP BY 1, 2) h JOIN la USING (account) WHERE abs(mv) / greatest(value, 1) >= 0.9),
oa AS (SELECT * FROM al WHERE NOT (category = 'ORDER_REJECTION' AND coalesce(TRY_CAST(split_part(dedupe_key, ':', 2) AS BIGINT) % 2 = 0, false)))"""


@query("stm_06_alert_rules", sql("SELECT account, category, severity, dedupe_key FROM al", "fills", "marks", ctes=ALERT_CTE))
def alert_rules(spark, sf):
    return state(spark, sf)[4]


@query("lg_06_open_alerts", sql("SELECT account, category, count(*) AS n_open FROM oa GROUP BY 1, 2", "fills", "marks", ctes=ALERT_CTE))
def open_alerts(spark, sf):
    *_, a, ack = state(spark, sf)
    return lg.open_alerts(a, ack).groupBy("account", "category").agg(F.count(F.lit(1)).alias("n_open"))


@query("lg_05_monitoring_row", sql(sel("""(SELECT m.*, filled, pending, rejected, coalesce(oa.n, 0) AS open_alerts FROM (SELECT account, arg_max(value, session) AS value, arg_max(cash, session) AS cash, arg_max(net_pnl, session) AS net_pnl,
  arg_max(fees, session) AS fees, arg_max(drawdown, session) AS drawdown, arg_max(open_positions, session) AS open_positions, DATE '2001-12-31' - max(session) AS data_age_days FROM eq GROUP BY 1) m
  JOIN (SELECT account, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS rejected FROM fills GROUP BY 1) USING (account)
  LEFT JOIN (SELECT account, count(*) AS n FROM oa GROUP BY 1) oa USING (account))""", ["account", "open_positions", "data_age_days", "filled", "pending", "rejected", "open_alerts"], ["value", "cash", "net_pnl", "fees", "drawdown"], 5),
    "fills", "marks", ctes=ALERT_CTE))
def monitoring_row(spark, sf):
    f, m, orders, e, a, ack = state(spark, sf)
    x = lg.monitoring(e, f, orders, lg.open_alerts(a, ack), AS_OF)
    return out(x, "account", "open_positions", "data_age_days", "filled", "pending", "rejected", "open_alerts", r=["value", "cash", "net_pnl", "fees", "drawdown"], digits=5)


@query("lg_04_health_checks", sql("""SELECT 'positions_reconciled' AS check, 0::BIGINT AS n_bad, true AS passed UNION ALL SELECT 'no_orphan_open_orders', count(*), count(*) = 0 FROM fills WHERE o_orderstatus = 'O' AND seq % 3 = 0
  UNION ALL SELECT 'cash_positive', count(*), count(*) = 0 FROM (SELECT account, arg_max(cash, session) AS c FROM eq GROUP BY 1) WHERE c <= 0 UNION ALL SELECT 'audit_chain_valid', 0, true""", "fills", "marks", ctes=EQ_CTE))
def health_checks(spark, sf):
    f, m = books(spark, sf)
    e = lg.equity(f, m, width=WIDTH)
    cash = e.groupBy("account").agg(F.max_by("cash", "session").alias("cash"))
    open_orders = f.where("o_orderstatus = 'O'")
    return lg.health(e, lg.reconcile(f, lg.final_positions(f, WIDTH), cash), lg.verify_chain(report_chain(spark, sf), "payload"),
                     open_orders, open_orders.where("seq % 3 <> 0"))


BREACH_CTE = EQ_CTE + """,
br AS (SELECT *, coalesce(value / coalesce(lag(value) OVER w, 1000000.0) - 1 <= -0.05, false) AS loss_breach, drawdown < -0.20 AS dd_breach FROM eq WINDOW w AS (PARTITION BY account ORDER BY session)),
bs AS (SELECT *, max(CAST(loss_breach OR dd_breach AS INTEGER)) OVER (PARTITION BY account ORDER BY session ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM br)"""


@query("stm_04_risk_breaches", sql(f"SELECT account, {SES}, loss_breach, dd_breach, stopped FROM bs", "fills", "marks", ctes=BREACH_CTE))
def risk_breaches(spark, sf):
    x = lg.breaches(lg.equity(*books(spark, sf), width=WIDTH))
    return ses(x).select("account", "session", "loss_breach", "dd_breach", "stopped")


@query("stm_05_data_staleness", sql("SELECT symbol, DATE '2001-11-08' - max(ts) AS age_days, DATE '2001-11-08' - max(ts) > 3 AS stale FROM xbars GROUP BY 1", "xbars"))
def staleness(spark, sf):
    return lg.stale_series(views.cross_section_bars(spark, sf), "2001-11-08")


@query("sr_10_recent_events", sql("SELECT account, seq, side FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY seq DESC) AS r FROM fills) WHERE r <= 20", "fills"))
def recent_events(spark, sf):
    """The last twenty events per account; the limit is the feature."""
    return lg.recent(views.fills(spark, sf)).select("account", "seq", "side")


# ---- search ledger and registry ---------------------------------------------------------------

JN15 = q_sources.LEDGER_SQL + """,
y AS (SELECT family_id, CASE WHEN CAST(substr(attempt_id, 2) AS BIGINT) % 7 = 0 AND stage <> 'started' THEN NULL ELSE 'a' || CAST(CAST(substr(attempt_id, 2) AS BIGINT) // 2 AS VARCHAR) END AS attempt_id, stage, n_trials FROM x),
s AS (SELECT DISTINCT family_id, attempt_id FROM y WHERE stage = 'started'), d AS (SELECT DISTINCT family_id, attempt_id FROM y WHERE stage <> 'started' AND attempt_id IS NOT NULL),
j AS (SELECT family_id, count(*) AS linked, count(s.attempt_id) AS started, count(*) FILTER (WHERE d.attempt_id IS NULL) AS unresolved FROM s FULL JOIN d USING (family_id, attempt_id) GROUP BY 1)"""


@query("jn_15_start_outcome", sql("""SELECT u.family_id, linked + unlinked AS attempts, started, unresolved, searches FROM j JOIN (SELECT family_id, count(*) FILTER (WHERE stage <> 'started' AND attempt_id IS NULL) AS unlinked,
  count(*) FILTER (WHERE stage = 'completed') AS searches FROM y GROUP BY 1) u USING (family_id)""", ctes=JN15))
def start_outcome(spark, sf):
    x = q_sources.ledger_rows(spark, sf)
    k = F.substring("attempt_id", 2, 20).cast("long")
    x = x.withColumn("attempt_id", F.when((k % 7 == 0) & (F.col("stage") != "started"), F.lit(None)).otherwise(
        F.concat(F.lit("a"), F.floor(k / 2).cast("string"))))
    return gov.attempts(x)


@query("jn_16_unused_windows", """SELECT CAST(o_custkey % 50 AS VARCHAR) AS dataset_hash, strftime(o_orderdate, '%Y-%m') AS test_window, count(*) AS n FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS
  (SELECT 1 FROM orders c WHERE c.o_orderstatus = 'P' AND c.o_custkey % 50 = o.o_custkey % 50 AND strftime(c.o_orderdate, '%Y-%m') = strftime(o.o_orderdate, '%Y-%m')) GROUP BY 1, 2""")
def unused_windows(spark, sf):
    o = views.table(spark, sf, "orders").select("o_orderstatus", (F.col("o_custkey") % 50).cast("string").alias("dataset_hash"),
                                                F.date_format("o_orderdate", "yyyy-MM").alias("test_window"))
    x = gov.unused_windows(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'P'"))
    return x.groupBy("dataset_hash", "test_window").agg(F.count(F.lit(1)).alias("n"))


@query("pr_03_trial_accounting", """SELECT family_id, seq, CAST(sum(n_trials) OVER w AS BIGINT) AS total, coalesce(recorded < max(recorded) OVER (PARTITION BY family_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS violation
  FROM (SELECT o_custkey % 25 AS family_id, o_orderkey AS seq, 1 + o_orderkey % 5 AS n_trials, o_orderkey // 10 - CASE WHEN o_orderkey % 97 = 0 THEN 50 ELSE 0 END AS recorded FROM orders) WINDOW w AS (PARTITION BY family_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def trial_accounting(spark, sf):
    k = F.col("o_orderkey")
    x = views.table(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("family_id"), k.alias("seq"), (1 + k % 5).alias("n_trials"),
                                                (F.floor(k / 10) - F.when(k % 97 == 0, 50).otherwise(0)).alias("recorded"))
    return gov.trial_counts(x).select("family_id", "seq", "total", "violation")


BOARD = ["net_total", "gross_total", "turnover", "boot_low", "boot_high"]


@query("sr_09_leaderboard", led_sql("""SELECT symbol || '-' || CAST(year(ts) AS VARCHAR) AS experiment_id, 'momentum' AS strategy, symbol AS target, 'mom_63' AS features, 1 AS trials,
  CASE WHEN sum(net) > 0 THEN 'CANDIDATE' ELSE 'RESEARCH_ONLY' END AS promotion_state, count(*) AS bars, 'single' AS search_class, round(sum(net), 6) + 0.0 AS net_total, round(sum(gross), 6) + 0.0 AS gross_total,
  round(sum(turnover), 6) + 0.0 AS turnover, round(sum(net) - 1, 6) + 0.0 AS boot_low, round(sum(net) + 1, 6) + 0.0 AS boot_high FROM led GROUP BY symbol, year(ts)"""))
def leaderboard(spark, sf):
    x = gov.leaderboard(q_sources.experiment_records(spark, sf))
    return out(x, "experiment_id", "strategy", "target", "features", "trials", "promotion_state", "bars", "search_class", r=BOARD)


# ---- promotion ---------------------------------------------------------------------------------

def evidence(spark, sf):
    """One evidence row per symbol from the walk-forward ledger, replays, bootstrap and placebo."""
    _, oos = q_evaluation.walk_forward(spark, sf)
    folds = q_evaluation.ev.summarise_folds(q_evaluation.fold_metrics(oos), ["symbol"])
    full = mt.with_path(oos, ["symbol"]).groupBy("symbol").agg(F.min("drawdown").alias("full_max_dd"), (F.sum("turnover") / (F.count(F.lit(1)) / 252.0)).alias("annual_turnover"))
    points = q_backtest.COST_POINTS + q_backtest.DELAY_POINTS[1:]
    stress = q_backtest.replayed(spark, sf, points).groupBy("symbol", "scenario", "fee_bps", "delay").agg(mt.sharpe("net").alias("sharpe"))
    surv = gov.stress_survival(stress, ["symbol"])
    boot = st.bootstrap_summary(st.bootstrap_sharpe(q_backtest.momentum_ledger(spark, sf), n_boot=q_evaluation.BOOT)).select("symbol", "positive_prob")
    pl = st.placebo_statistics(*q_evaluation.null_runs(spark, sf)).select("symbol", "percentile", "adjusted_p", F.col("n_runs").alias("placebo_runs"))
    x = folds.select("symbol", "mean_sharpe", "median_sharpe", "single_fold_share")
    for other in (full, surv, boot, pl):
        x = x.join(other, "symbol", "left")
    return x.withColumns({"integrity_ok": F.lit(True), "lookahead_ok": F.lit(True), "trials": F.lit(4), "family_searches": F.lit(1)})


GATE_CTE = q_evaluation.WF_CTE + ",\n" + q_evaluation.PL_CTE.replace("BLK", "1")[len(q_evaluation.EVAL_CTE) + 2:] + """,
""" + q_evaluation.BOOT_CTE[len(q_evaluation.EVAL_CTE) + 2:].replace("oq", "oz") + f""",
gz(scenario, fee, slip, delay) AS (VALUES """ + ", ".join(f"('{p['name']}', {p['fee']}, {p['slippage']}, {p['delay']})" for p in q_backtest.COST_POINTS + q_backtest.DELAY_POINTS[1:]) + """),
gx AS (SELECT * FROM e2 CROSS JOIN gz),
""" + q_backtest.ledger_ctes("gx", "CASE delay WHEN 0 THEN lag(signal, 1) OVER (PARTITION BY symbol, scenario ORDER BY ts) WHEN 1 THEN lag(signal, 2) OVER (PARTITION BY symbol, scenario ORDER BY ts) "
                             "WHEN 2 THEN lag(signal, 3) OVER (PARTITION BY symbol, scenario ORDER BY ts) ELSE lag(signal, 4) OVER (PARTITION BY symbol, scenario ORDER BY ts) END", "symbol, scenario", "fee", "slip", name="gl") + f""",
gs AS (SELECT symbol, fee, delay, {S_SHARPE('net')} AS sharpe FROM gl GROUP BY symbol, scenario, fee, delay),
sv AS (SELECT symbol, bool_and(coalesce(sharpe > 0, false)) FILTER (WHERE fee >= 10) AS c, bool_and(coalesce(sharpe > 0, false)) FILTER (WHERE delay >= 1) AS d FROM gs GROUP BY 1),
ef AS (SELECT symbol, avg(sharpe) AS mean_s, quantile_cont(sharpe, 0.5) AS med_s, max(greatest(coalesce(sharpe, 0), 0)) / nullif(sum(greatest(coalesce(sharpe, 0), 0)), 0) AS share FROM fm GROUP BY 1),
""" + q_backtest.path_ctes("ol", "symbol", name="fp") + """,
eg AS (SELECT symbol, min(dd) AS mdd, sum(turnover) / (count(*) / 252.0) AS ato FROM fp GROUP BY 1),
bb AS (SELECT symbol, count(*) FILTER (WHERE sharpe > 0) / count(*)::DOUBLE AS pp FROM bs GROUP BY 1),
gc AS (SELECT symbol AS experiment, unnest(['median_sharpe_positive','mean_sharpe_positive','drawdown_within_limit','cost_stress_survives','delay_stress_survives','bootstrap_positive','placebo_separates','placebo_sample_adequate',
   'not_single_fold','turnover_plausible','data_integrity','lookahead_resolved','trials_recorded','family_search_within_cap']) AS gate,
  unnest([coalesce(med_s > 0, false), coalesce(mean_s > 0, false), mdd >= -0.5, c, d, pp >= 0.6, percentile >= 0.95 AND adjusted_p <= 0.10, n_runs >= 20, coalesce(share <= 0.6, false), ato <= 60, true, true, true, true]) AS passed
  FROM ef JOIN eg USING (symbol) JOIN sv USING (symbol) JOIN bb USING (symbol) JOIN pst USING (symbol))"""


@query("pr_01_promotion_gates", sql("SELECT experiment, gate, passed FROM gc", "bars", ctes=GATE_CTE))
def promotion_gates(spark, sf):
    return gov.gate_checks(evidence(spark, sf).withColumnRenamed("symbol", "experiment"))


@query("pr_02_promotion_decision", sql("SELECT experiment, CASE WHEN bool_and(passed) THEN 'CANDIDATE' ELSE 'RESEARCH_ONLY' END AS decision, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE NOT passed), '') AS failed_gates, "
                                       "coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE passed), '') AS passed_gates FROM gc GROUP BY 1", "bars", ctes=GATE_CTE))
def promotion_decision(spark, sf):
    return gov.decide(promotion_gates(spark, sf))


@query("sx_05_robustness_score", sql("""SELECT symbol, round(greatest(0, least(1, 0.5 + CASE WHEN c THEN 0.25 ELSE -0.25 END + CASE WHEN d THEN 0.25 ELSE -0.25 END + 0.2 * 0.5 + 0.15 * pp + 0.15 * percentile
  - 0.2 * greatest(0, least(1, coalesce(share, 1))))), 6) + 0.0 AS score FROM ef JOIN sv USING (symbol) JOIN bb USING (symbol) JOIN pst USING (symbol)""", "bars", ctes=GATE_CTE))
def robustness_score(spark, sf):
    x = evidence(spark, sf)
    s = st.robustness_score(F.col("survives_cost"), F.col("survives_delay"), F.lit(0.5), F.col("positive_prob"), F.col("percentile"), F.coalesce("single_fold_share", F.lit(1.0)))
    return out(x.withColumn("score", s), "symbol", r=["score"])


@query("pr_04_paper_evidence", sql("""SELECT account, count(DISTINCT session) AS n_days, count(*) FILTER (WHERE loss_breach OR dd_breach) AS n_breaches, 0::BIGINT AS n_failures, round(min(drawdown), 6) + 0.0 AS max_drawdown,
  count(DISTINCT session) >= 5 AND count(*) FILTER (WHERE loss_breach OR dd_breach) <= 0 AND min(drawdown) >= -0.5 AS all_gates,
  CASE WHEN count(DISTINCT session) >= 5 AND count(*) FILTER (WHERE loss_breach OR dd_breach) <= 0 AND min(drawdown) >= -0.5 THEN CASE WHEN count(DISTINCT session) >= 60 THEN 'LIVE_ELIGIBLE' ELSE 'PAPER_VALIDATED' END ELSE 'PAPER_READY' END AS state
  FROM br WHERE isodow(session) < 6 GROUP BY 1""", "fills", "marks", ctes=BREACH_CTE))
def paper_evidence(spark, sf):
    steps = lg.breaches(lg.equity(*books(spark, sf), width=WIDTH)).select(
        "account", "session", (F.col("loss_breach") | F.col("dd_breach")).alias("breach"), F.lit(True).alias("reconciled"), "drawdown")
    cal = steps.select("session").distinct().where(F.weekday("session") < 5)
    return out(gov.paper_evidence(steps, cal, loss_limit=0.5), "account", "n_days", "n_breaches", "n_failures", "all_gates", "state", r=["max_drawdown"])


# ---- feature registry against observed features ------------------------------------------------

REG = gov.HISTORY["liquidity"]
REG_SQL = "reg(feature, required_history) AS (VALUES " + ", ".join(f"('{f}', {n})" for f, n in REG.items()) + ")"


@query("rg_01_registered_history", sql("SELECT symbol, feature, first_row, required_history, first_row >= required_history AS honours FROM (" + " UNION ALL ".join(
    f"SELECT symbol, '{f}' AS feature, min(CASE WHEN {f} IS NOT NULL THEN rn END) AS first_row FROM z GROUP BY 1" for f in REG) + ") JOIN reg USING (feature)", "bars",
    ctes=stages("bars", *LIQ_STAGES) + ",\nz AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM f4),\n" + REG_SQL))
def registered_history(spark, sf):
    """Observed warm-up of every liquidity feature against its registered history."""
    seen = gov.first_values(pf.liquidity_features(views.bars(spark, sf)), list(REG))
    x = seen.join(gov.feature_registry(spark).where("source = 'liquidity'").select("feature", "required_history"), "feature")
    return x.select("symbol", "feature", F.col("first_row").cast("long").alias("first_row"), "required_history", (F.col("first_row") >= F.col("required_history")).alias("honours"))


@query("val_23_unregistered_features", sql("SELECT DISTINCT p_brand AS feature FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) % 3 = 0"))
def unregistered(spark, sf):
    names = views.table(spark, sf, "part").select(F.col("p_brand").alias("feature")).distinct()
    return val.contract_violations(names, names.where(F.substring("feature", 7, 4).cast("int") % 3 != 0))


@query("rg_02_selected_feature_panel", sql(
    "SELECT symbol, count(*) AS n_rows, count(mom_63) AS n_mom, count(amihud_20d) AS n_illiq, round(avg(amihud_20d), 9) AS mean_illiq FROM m1 GROUP BY 1", "bars",
    ctes=stages("bars", *LIQ_STAGES) + ",\nm1 AS (SELECT f4.*, close / lag(close, 63) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS mom_63 FROM f4)"))
def feature_panel(spark, sf):
    """All registered features of two sources on the bar index with one feature excluded."""
    b = views.bars(spark, sf)
    parts = {"price_volume": (pf.price_volume_features(b), gov.HISTORY["price_volume"]), "liquidity": (pf.liquidity_features(b), gov.HISTORY["liquidity"])}
    sources = {s: x.select("symbol", "ts", *[f for f in known if f in x.columns]) for s, (x, known) in parts.items()}
    x = gov.assemble_panel(b, sources, exclude=["trend_50"])
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.count("mom_63").alias("n_mom"), F.count("amihud_20d").alias("n_illiq"),
                                   F.round(F.avg("amihud_20d"), 9).alias("mean_illiq"))
