"""Positions, profit, settlement and controls from a table of fills.

Fills: account, symbol, seq (unique), session, side, quantity, price,
signed_qty.  An account may hold most fills, so running quantities and average
costs are chunked scans; everything per session is aggregated first.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.rolling import Rolling, safe_div
from barwise.functions.scan import ROWS_PER_CHUNK, affine_scan, running_total

FEE_BPS, SLIPPAGE_BPS, SPREAD_BPS = 5.0, 1.0, 0.5
INITIAL_CASH = 1_000_000.0
KEY = ("account", "symbol")


def positions(fills: DataFrame, width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Every fill with quantity and average cost before and after it and its realised profit.

    Quantity is a running sum.  The cost basis |q| x average is an affine
    recurrence once quantities are known: adding adds the notional, reducing
    scales it, crossing zero restarts it.
    """
    x = running_total(fills, KEY, "seq", "signed_qty", width, "q_before")
    q, d, px = F.col("q_before"), F.col("signed_qty"), F.col("price")
    after = q + d
    adds, crosses = q * d >= 0, F.abs(d) > F.abs(q)
    x = x.withColumns({
        "q_after": after,
        "_a": F.when(adds, 1.0).when(crosses, 0.0).otherwise(F.coalesce(safe_div(F.abs(after), F.abs(q)), F.lit(0.0))),
        "_b": F.when(adds, F.abs(d) * px).when(crosses, F.abs(after) * px).otherwise(0.0)})
    x = affine_scan(x, KEY, "seq", "_a", "_b", "_basis")
    avg = F.coalesce(safe_div("_basis", F.abs("q_before")), F.lit(0.0))
    x = x.withColumn("avg_before", avg).withColumn("basis_after", F.col("_a") * F.col("_basis") + F.col("_b"))
    closed = F.when(F.col("q_before") * F.col("signed_qty") >= 0, 0.0).otherwise(F.least(F.abs("signed_qty"), F.abs("q_before")))
    return x.withColumns({
        "realized": F.signum("q_before") * (F.col("price") - F.col("avg_before")) * closed,
        "avg_after": F.coalesce(safe_div("basis_after", F.abs("q_after")), F.lit(0.0))}).drop("_a", "_b", "_basis", "chunk")


def final_positions(fills: DataFrame, width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Quantity, average entry and realised profit per (account, symbol)."""
    p = positions(fills, width)
    return p.groupBy(*KEY).agg(
        F.max_by("q_after", "seq").alias("quantity"), F.max_by("avg_after", "seq").alias("avg_entry"),
        F.sum("realized").alias("realized_pnl"), F.count(F.lit(1)).alias("n_fills"))


def cost_columns(fills: DataFrame) -> DataFrame:
    n = F.abs(F.col("quantity") * F.col("price"))
    return fills.withColumns({"notional": n, "fee": n * FEE_BPS / 10000.0, "slippage": n * SLIPPAGE_BPS / 10000.0,
                              "spread": n * SPREAD_BPS / 10000.0})


def cost_attribution(fills: DataFrame, keys=("account",)) -> DataFrame:
    return cost_columns(fills).groupBy(*keys).agg(
        F.sum("fee").alias("fees"), F.sum("slippage").alias("slippage"), F.sum("spread").alias("spread"), F.sum("notional").alias("notional")
    ).withColumn("total", F.col("fees") + F.col("slippage") + F.col("spread"))


def sessions_of(marks: DataFrame) -> DataFrame:
    """(session, day): the calendar of the marks, numbered from 0."""
    days = marks.select("session").distinct()
    return days.select("session", (F.row_number().over(Window.orderBy("session")) - 1).alias("day"))


def position_intervals(fills: DataFrame, width: int = ROWS_PER_CHUNK) -> DataFrame:
    """One row per change of a position: quantity and basis from ``session`` until ``until`` (null: none later), and the profit realised that session."""
    p = positions(fills, width).groupBy(*KEY, "session").agg(
        F.max_by("q_after", "seq").alias("quantity"), F.max_by("basis_after", "seq").alias("basis"), F.sum("realized").alias("realized"))
    return p.withColumn("until", Rolling(KEY, "session").lead("session"))


def carried_marks(marks: DataFrame) -> DataFrame:
    """(symbol, day, mark): the last positive mark so far, on every session from the first one on."""
    s = Rolling(("symbol",), "day")
    days = sessions_of(marks)
    end = days.agg(F.max("day")).scalar()
    valid = marks.where("mark > 0").join(days, "session").select("symbol", "day", "mark")
    valid = valid.withColumn("_to", F.coalesce(s.lead("day") - 1, end))
    return valid.select("symbol", F.explode(F.sequence("day", "_to")).alias("day"), "mark")


def holding_days(fills: DataFrame, marks: DataFrame, width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per (account, symbol, session) with an open position or a fill: quantity, basis, profit realised that session and the carried mark.

    Positions are intervals between fills; a session has a row only while one is open, or when it is closed.  So rows grow
    with fills and open days, not with accounts times symbols times the calendar.
    """
    days = sessions_of(marks)
    end = days.agg(F.max("day")).scalar() + 1
    x = position_intervals(fills, width).join(days.withColumnRenamed("day", "_from"), "session").join(
        days.select(F.col("session").alias("until"), F.col("day").alias("_to")), "until", "left")
    last = F.when(F.abs("quantity") > 1e-12, F.coalesce("_to", end) - 1).otherwise(F.col("_from"))
    x = x.select(*KEY, "quantity", "basis", "realized", "_from", F.explode(F.sequence(F.col("_from"), last)).alias("day"))
    x = x.withColumn("realized", F.when(F.col("day") == F.col("_from"), F.col("realized")).otherwise(0.0)).drop("_from")
    return x.join(days, "day").join(carried_marks(marks), ["symbol", "day"], "left").select(*KEY, "session", "quantity", "basis", "realized", "mark")


def holdings(fills: DataFrame, marks: DataFrame, width: int = ROWS_PER_CHUNK) -> DataFrame:
    """The rows of ``holding_days`` with an open position."""
    return holding_days(fills, marks, width).where(F.abs("quantity") > 1e-12).drop("realized")


def equity(fills: DataFrame, marks: DataFrame, initial_cash: float = INITIAL_CASH, width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per (account, session of the calendar): cash, value, running peak, drawdown and profit split."""
    flow = cost_columns(fills).groupBy("account", "session").agg(
        F.sum(-F.col("signed_qty") * F.col("price") - F.col("fee")).alias("_flow"), F.sum("fee").alias("_fee"),
        F.sum("slippage").alias("_slip"), F.sum("spread").alias("_spread"))
    value = F.coalesce(F.col("quantity") * F.col("mark"), F.lit(0.0))
    gain = F.coalesce(F.col("quantity") * F.col("mark") - F.signum("quantity") * F.col("basis"), F.lit(0.0))
    opened = holding_days(fills, marks, width).groupBy("account", "session").agg(
        F.sum(value).alias("position_value"), F.sum(gain).alias("unrealized_pnl"), F.sum("realized").alias("_realized"),
        F.count_if(F.abs("quantity") > 1e-12).alias("open_positions"))
    days = sessions_of(marks).agg(F.array_sort(F.collect_set("session"))).scalar()
    s = Rolling(("account",), "session")
    cum = lambda c: F.coalesce(F.sum(c).over(s.so_far), F.lit(0.0))
    x = fills.select("account").distinct().select("account", F.explode(days).alias("session"))
    x = x.join(opened, ["account", "session"], "left").join(flow, ["account", "session"], "left")
    x = x.na.fill(0.0, ["position_value", "unrealized_pnl"]).na.fill(0, ["open_positions"])
    x = x.withColumns({"cash": F.lit(initial_cash) + cum("_flow"), "fees": cum("_fee"), "slippage_cost": cum("_slip"),
                       "spread_cost": cum("_spread"), "realized_pnl": cum("_realized")}).drop("_flow", "_fee", "_slip", "_spread", "_realized")
    x = x.withColumn("value", F.col("cash") + F.col("position_value"))
    x = x.withColumn("peak", F.greatest(F.lit(initial_cash), F.max("value").over(s.so_far)))
    return x.withColumns({"drawdown": F.when(F.col("peak") > 0, (F.col("value") - F.col("peak")) / F.col("peak")).otherwise(0.0),
                          "net_pnl": F.col("value") - initial_cash})


def settlement(fills: DataFrame, marks: DataFrame, initial_cash: float = INITIAL_CASH, width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Daily report rows with the accounting identity."""
    x = equity(fills, marks, initial_cash, width)
    gap = F.col("net_pnl") - (F.col("realized_pnl") + F.col("unrealized_pnl") - F.col("fees"))
    return x.withColumn("identity_gap", gap).withColumn("identity_valid", F.abs("identity_gap") <= 1e-6)


def chain_reports(df: DataFrame, payload: str, keys=("account",), order: str = "session") -> DataFrame:
    """Add previous_hash and report_hash = sha256(previous | payload) along each key.

    A key has one report per session, so a group is bounded by the calendar.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        prev, before, after = "", [], []
        for text in pdf[payload]:
            before.append(prev)
            prev = hashlib.sha256(f"{prev}|{text}".encode()).hexdigest()
            after.append(prev)
        return pdf.assign(previous_hash=before, report_hash=after)
    return df.groupBy(*keys).applyInPandas(chain, f"{fields}, previous_hash string, report_hash string")


def verify_chain(df: DataFrame, payload: str, keys=("account",), order: str = "session") -> DataFrame:
    """Rows whose link or digest is broken; needs only the row before, no recursion."""
    s = Rolling(tuple(keys), order)
    x = df.withColumn("_prev", F.coalesce(s.lag("report_hash"), F.lit("")))
    link = F.col("previous_hash") != F.col("_prev")
    digest = F.sha2(F.concat_ws("|", F.col("previous_hash"), F.col(payload)), 256) != F.col("report_hash")
    return x.withColumns({"broken_link": link, "broken_digest": digest}).drop("_prev")


def reconcile(fills: DataFrame, reported: DataFrame, reported_cash: DataFrame, initial_cash: float = INITIAL_CASH) -> DataFrame:
    """Discrepancies of reported quantities (1e-9) and cash (1e-6) against the fills."""
    want = fills.groupBy(*KEY).agg(F.sum("signed_qty").alias("expected"))
    pos = want.join(reported.select(*KEY, F.col("quantity").alias("actual")), list(KEY), "full_outer").na.fill(0.0, ["expected", "actual"])
    pos = pos.where(F.abs(F.col("expected") - F.col("actual")) > 1e-9)
    cash = cost_columns(fills).groupBy("account").agg(
        (F.lit(initial_cash) + F.sum(-F.col("signed_qty") * F.col("price") - F.col("fee"))).alias("expected"))
    cash = cash.join(reported_cash.select("account", F.col("cash").alias("actual")), "account", "full_outer").withColumn("symbol", F.lit("CASH"))
    cash = cash.where(F.abs(F.col("expected") - F.col("actual")) > 1e-6)
    return pos.select(*KEY, "expected", "actual").unionByName(cash.select(*KEY, "expected", "actual"))


def exposure(fills: DataFrame, marks: DataFrame, open_orders: DataFrame, margin: float = 1.5,
             initial_cash: float = INITIAL_CASH, width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Gross and short notional with pending orders, margin, reserved and available cash per account."""
    last = marks.groupBy("symbol").agg(F.max_by("mark", "session").alias("mark"))
    held = fills.groupBy(*KEY).agg(F.sum("signed_qty").alias("q"))
    pend = open_orders.groupBy(*KEY).agg(F.sum("signed_qty").alias("p"))
    x = held.join(pend, list(KEY), "full_outer").join(last, "symbol", "left").na.fill(0.0, ["q", "p"])
    n = (F.col("q") + F.col("p")) * F.coalesce("mark", F.lit(0.0))
    per = x.groupBy("account").agg(F.sum(F.abs(n)).alias("gross_notional"), F.sum(F.greatest(-n, F.lit(0.0))).alias("short_notional"),
                                   F.sum(F.col("q") * F.coalesce("mark", F.lit(0.0))).alias("_value"))
    cash = cost_columns(fills).groupBy("account").agg(
        (F.lit(initial_cash) + F.sum(-F.col("signed_qty") * F.col("price") - F.col("fee"))).alias("cash"))
    res = open_orders.where("side = 'BUY'").groupBy("account").agg(
        F.sum(F.col("quantity") * F.col("price") * (1.0 + FEE_BPS / 10000.0)).alias("reserved_buy_cash"))
    y = per.join(cash, "account", "left").join(res, "account", "left").na.fill(0.0, ["reserved_buy_cash"])
    eq = F.greatest(F.col("cash") + F.col("_value"), F.lit(0.0))
    return y.withColumns({"equity": eq, "gross_exposure": F.col("gross_notional") / F.greatest(eq, F.lit(1.0)),
                          "short_margin_required": F.col("short_notional") * margin,
                          "available_cash": F.col("cash") - F.col("reserved_buy_cash")}).drop("_value")


def order_status_counts(orders: DataFrame, statuses: list[str], keys=("session",), status: str = "status") -> DataFrame:
    return orders.groupBy(*keys).agg(*[F.count_if(F.col(status) == v).alias(v.lower()) for v in statuses])


def recent(events: DataFrame, n: int = 20, keys=("account",), order: str = "seq") -> DataFrame:
    """Last n events per account.

    The n best of each sequence range come first, so the final ranking never
    sees more than n rows per range of a hot account.
    """
    x = events.withColumn("_part", F.spark_partition_id())
    local = Window.partitionBy(*keys, "_part").orderBy(F.desc(order))
    x = x.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
    return x.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r", "_part")


def health(equity_rows: DataFrame, discrepancies: DataFrame, chain: DataFrame, open_orders: DataFrame, pending: DataFrame) -> DataFrame:
    """Four checks, each passed when its query has no rows."""
    def check(name: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad", (F.col("n_bad") == 0).alias("passed"))
    last = equity_rows.groupBy("account").agg(F.max_by("cash", "session").alias("cash"))
    return (check("positions_reconciled", discrepancies)
            .unionByName(check("no_orphan_open_orders", open_orders.join(pending.select("seq"), "seq", "left_anti")))
            .unionByName(check("cash_positive", last.where("cash <= 0")))
            .unionByName(check("audit_chain_valid", chain.where("broken_link OR broken_digest"))))


def alerts(equity_rows: DataFrame, orders: DataFrame, holding: DataFrame, as_of: str, max_age_days: int = 3,
           loss: float = 0.02, max_position: float = 1.0, initial_cash: float = INITIAL_CASH) -> DataFrame:
    """Rule queries unioned; one open alert per account and dedupe key."""
    last = equity_rows.groupBy("account").agg(F.max("session").alias("session"), F.max_by("net_pnl", "session").alias("net_pnl"),
                                              F.max_by("value", "session").alias("value"))
    def rows(df, category, severity, key):
        return df.select("account", F.lit(category).alias("category"), F.lit(severity).alias("severity"), key.alias("dedupe_key"))
    stale = rows(last.where(F.datediff(F.lit(as_of).cast("date"), "session") > max_age_days), "DATA_STALENESS", "CRITICAL", F.lit("data_staleness"))
    pnl = rows(last.where(F.col("net_pnl") / initial_cash <= -loss), "PNL_THRESHOLD", "CRITICAL", F.lit("pnl_loss_threshold"))
    rejected = rows(orders.where("status = 'REJECTED'"), "ORDER_REJECTION", "WARNING", F.concat(F.lit("order_rejected:"), F.col("seq").cast("string")))
    final = holding.join(last, ["account", "session"]).withColumn("mv", F.col("quantity") * F.col("mark"))
    weight = F.abs("mv") / F.greatest("value", F.lit(1.0))
    big = rows(final.where(weight >= max_position * 0.9), "POSITION_LIMIT", "WARNING", F.concat(F.lit("position_limit:"), F.col("symbol")))
    return stale.unionByName(pnl).unionByName(rejected).unionByName(big).dropDuplicates(["account", "dedupe_key"])


def open_alerts(alert_rows: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    return alert_rows.join(acknowledgements.select("account", "dedupe_key"), ["account", "dedupe_key"], "left_anti")


def monitoring(equity_rows: DataFrame, fills: DataFrame, orders: DataFrame, open_alert_rows: DataFrame, as_of: str) -> DataFrame:
    """One row per account: value, cash, profit, fees, drawdown, orders, data age, open alerts."""
    by = lambda c: F.max_by(c, "session").alias(c)
    last = equity_rows.groupBy("account").agg(
        *[by(c) for c in ("value", "cash", "net_pnl", "realized_pnl", "unrealized_pnl", "fees", "drawdown", "open_positions")],
        F.datediff(F.lit(as_of).cast("date"), F.max("session")).alias("data_age_days"))
    status = order_status_counts(orders, ["FILLED", "PENDING", "REJECTED"], ("account",))
    alerts_n = open_alert_rows.groupBy("account").agg(F.count(F.lit(1)).alias("open_alerts"))
    return last.join(status, "account", "left").join(alerts_n, "account", "left").na.fill(0, ["open_alerts", "filled", "pending", "rejected"])


def breaches(equity_rows: DataFrame, daily_loss: float = 0.05, max_drawdown: float = 0.20) -> DataFrame:
    """Sessions that break the daily-loss or drawdown limit and the sticky stop that follows."""
    s = Rolling(("account",), "session")
    prev = F.coalesce(s.lag("value"), F.lit(INITIAL_CASH))
    x = equity_rows.withColumn("day_ret", safe_div(F.col("value") - prev, prev))
    x = x.withColumns({"loss_breach": F.coalesce(F.col("day_ret") <= -daily_loss, F.lit(False)), "dd_breach": F.col("drawdown") < -max_drawdown})
    hit = (F.col("loss_breach") | F.col("dd_breach")).cast("int")
    return x.withColumn("_h", hit).withColumn("stopped", F.max("_h").over(s.so_far) == 1).drop("_h")


def stale_series(rows: DataFrame, as_of: str, max_age_days: int = 3, key: str = "symbol", ts: str = "ts") -> DataFrame:
    x = rows.groupBy(key).agg(F.max(ts).alias("last"))
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("last"))
    return x.select(key, age.alias("age_days"), (age > max_age_days).alias("stale"))
