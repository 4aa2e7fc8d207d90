"""Bars, events, fills and calendars derived from the supplied star schema.

Every view is a plain lazy DataFrame.  Bars come from one partial hash
aggregation per (symbol, session): first and last trade are ``min_by`` and
``max_by`` of one decimal that packs the order of trades (a struct would force a
sort of all trades), so a symbol that holds most of them is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.session import pin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def packed(*parts: tuple[Column, int]) -> Column:
    """Non-negative integers, each with its number of digits (38 in all), as one decimal in the same order."""
    if sum(digits for _, digits in parts) > 38:
        raise ValueError("a decimal holds 38 digits")
    text = F.concat(*[F.lpad(c.cast("string"), digits, "0") for c, digits in parts])
    return text.cast("decimal(38,0)")


def ohlcv_from_trades(trades: DataFrame, order: Column) -> DataFrame:
    """(symbol, ts, px, qty) and the order of trades -> one bar per (symbol, ts)."""
    return trades.groupBy("symbol", "ts").agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"),
        F.min("px").alias("low"), F.max_by("px", order).alias("close"),
        F.sum("qty").alias("volume"))


def bars(spark: SparkSession, sf_dir: str, by: str = "p_type") -> DataFrame:
    """Daily bars; one symbol per part attribute ``by``."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(by).alias("symbol"), "p_retailprice")
    line = table(spark, sf_dir, "lineitem")
    px = F.col("p_retailprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    trades = line.join(part, line.l_partkey == part.p_partkey).select(
        "symbol", F.to_date("l_shipdate").cast("timestamp").alias("ts"), px.alias("px"),
        F.col("l_quantity").alias("qty"),
        packed((F.col("l_orderkey"), 14), (F.col("l_linenumber"), 2), (F.col("l_partkey"), 12), (F.col("l_suppkey"), 10)).alias("place"))
    return ohlcv_from_trades(trades, F.col("place"))


def common_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the sessions on which every symbol trades."""
    b = bars(spark, sf_dir)
    symbols = b.select("symbol").distinct().count()
    return b.join(b.groupBy("ts").count().where(F.col("count") == symbols).select("ts"), "ts", "left_semi")


def cross_section_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, by="p_brand")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    trades = raw.select(F.col("event_type").alias("symbol"),
                        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
                        F.col("value").alias("px"), F.lit(1.0).alias("qty"),
                        packed((F.unix_micros(F.col("ts").cast("timestamp")), 18), (F.col("event_id"), 18)).alias("place"))
    return ohlcv_from_trades(trades, F.col("place"))


def pit_events(spark: SparkSession, sf_dir: str, revisions: bool = True) -> DataFrame:
    """Dated events with separate event, publication and availability times."""
    raw = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    published = ts + F.make_dt_interval(hours=F.col("event_id") % 3)
    k = F.get_json_object("props", "$.k").cast("int")
    first = raw.select(
        "event_id", F.col("event_type").alias("symbol"), ts.alias("event_time"),
        published.alias("publication_time"),
        (published + F.make_dt_interval(hours=(F.col("event_id") % 5) * 6)).alias("availability_time"),
        F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"),
        F.col("value").cast("string").alias("raw_value"), F.col("value").cast("string").alias("processed_value"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50.0) / 500.0)).alias("sentiment"),
        ((F.col("event_id") % 10) / 10.0).alias("novelty"),
        F.concat(F.lit("topic"), (k % 10).cast("string")).alias("topic"),
        F.lit(0).alias("revision"))
    if not revisions:
        return first
    second = first.where(F.col("event_id") % 20 == 0).withColumns({
        "revision": F.lit(1), "sentiment": -F.col("sentiment"),
        "availability_time": F.col("availability_time") + F.make_dt_interval(days=F.lit(1))})
    return first.unionByName(second)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions: (account, symbol, seq, ts, side, quantity, price, signed_qty)."""
    o = table(spark, sf_dir, "orders")
    buy = (F.col("o_orderstatus") == "F") | ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0))
    qty = (F.lit(1) + F.col("o_orderkey") % 7).cast("double")
    return o.select(
        (F.col("o_custkey") % 10).alias("account"), F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("session"),
        F.when(buy, "BUY").otherwise("SELL").alias("side"), qty.alias("quantity"),
        (F.col("o_totalprice") / 1000.0).alias("price"),
        F.when(buy, qty).otherwise(-qty).alias("signed_qty"), "o_orderstatus")


def marks(fill_rows: DataFrame) -> DataFrame:
    """Session mark per symbol: the price of the last fill of that session."""
    return fill_rows.groupBy("symbol", "session").agg(F.max_by("price", "seq").alias("mark"))


def calendar(bar_rows: DataFrame, weekdays_only: bool = False, ts: str = "ts") -> DataFrame:
    """Every date between the first and last session, optionally Monday to Friday."""
    span = bar_rows.agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("session"))
    return days.where(F.weekday("session") < 5) if weekdays_only else days


def day(ts: str | Column = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
