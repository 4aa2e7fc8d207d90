"""Scans, sinks and round trips checked against SQL (inventory groups SRC, SNK, AGG-0)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.plans.catalogue import DAY, out, query, sel, sql
from barwise.sources import files, views

OHLCV = ["open", "high", "low", "close", "volume"]
BAR_SQL = sel("bars", ["symbol", DAY], OHLCV)


def _day(df):
    return df.withColumn("session", views.day())


def _out(df):
    return out(_day(df), "symbol", "session", r=OHLCV)


@query("src_01_long_csv", sql(BAR_SQL + " WHERE symbol IN ('ECONOMY', 'PROMO')", "bars"))
def long_csv(spark, sf):
    """Bars written as CSV to the shared folder and scanned with schema and symbol filter."""
    path = files.scratch(spark, "bars-csv")
    b = views.bars(spark, sf).withColumnRenamed("ts", "timestamp").select("timestamp", "symbol", *OHLCV)
    b.write.option("header", True).csv(path)
    return _out(files.read_long_csv(spark, path, ["ECONOMY", "PROMO"]))


@query("src_02_wide_csv", sql(
    f"SELECT symbol, {DAY}, close AS open, close AS high, close AS low, close, volume, true AS synthetic_range FROM bars", "bars"))
def wide_csv(spark, sf):
    b = views.bars(spark, sf)
    names = files.symbol_list(b)
    wide = b.groupBy(F.col("ts").alias("timestamp")).pivot("symbol", names).agg(
        F.first("close").alias("c"), F.first("volume").alias("v"))
    wide = wide.select("timestamp", *[F.col(f"{n}_c").alias(f"Close_{n}") for n in names],
                       *[F.col(f"{n}_v").alias(f"Volume_{n}") for n in names])
    return _day(files.wide_to_long(wide)).select("symbol", "session", *OHLCV, "synthetic_range")


@query("src_03_provider_rows", sql(
    sel("bars", ["symbol", DAY], OHLCV) + " WHERE day(ts) <> 13", "bars"))
def provider_rows(spark, sf):
    """Text columns in provider layout; the 13th of each month arrives without a close."""
    b = views.bars(spark, sf)
    raw = b.select(F.date_format("ts", "yyyy-MM-dd").alias("Date"), "symbol",
                   *[F.col(c).cast("string").alias(c.title()) for c in OHLCV if c != "close"],
                   F.when(F.dayofmonth("ts") != 13, F.col("close").cast("string")).alias("Close"))
    return _out(files.normalise_provider(raw, F.col("symbol")))


BENT = "CASE WHEN day(ts) % 5 = 0 THEN high * 1.003 WHEN day(ts) % 7 = 0 THEN low * 0.996 ELSE open END"


@query("src_04_containment_repair", sql(
    f"SELECT symbol, {DAY}, round(greatest(low, least(high, o)), 6) AS open, o < low OR o > high AS repaired "
    f"FROM (SELECT *, {BENT} AS o FROM bars)", "bars"))
def containment_repair(spark, sf):
    b = views.bars(spark, sf)
    d = F.dayofmonth("ts")
    bent = b.withColumn("open", F.when(d % 5 == 0, F.col("high") * 1.003).when(d % 7 == 0, F.col("low") * 0.996)
                        .otherwise(F.col("open")))
    x = _day(files.repair_containment(bent))
    return x.select("symbol", "session", F.round("open", 6).alias("open"), "repaired")


@query("src_05_universe_list", "SELECT DISTINCT upper(trim(p_brand)) AS symbol FROM part ORDER BY 1 LIMIT 20")
def universe_list(spark, sf):
    """The first twenty names of a distinct ordered list; the limit is the feature."""
    raw = views.table(spark, sf, "part").select(F.concat(F.lit(" "), F.lower("p_brand")).alias("symbol"))
    return files.universe(raw, 20)


SECTOR_SQL = """x AS (SELECT symbol, CASE WHEN CAST(substr(symbol, 7) AS INTEGER) % 4 = 3 THEN 'Unknown'
  ELSE 'sector' || CAST(CAST(substr(symbol, 7) AS INTEGER) % 4 AS VARCHAR) END AS sector, volume FROM xbars)"""


def brand_sectors(spark, sf):
    """JSON map rows built from the brands; every fourth brand is left out."""
    brands = views.table(spark, sf, "part").select("p_brand").distinct()
    number = F.substring("p_brand", 7, 4).cast("int") % 4
    rows = brands.where(number != 3).select(F.to_json(F.create_map(
        F.col("p_brand"), F.concat(F.lit("sector"), number.cast("string")))).alias("value"))
    return files.sector_map(rows)


@query("src_06_sector_map", sql("SELECT sector, count(*) AS n_bars, count(DISTINCT symbol) AS n_symbols, "
                                "sum(volume) AS volume FROM x GROUP BY 1", "xbars", ctes=SECTOR_SQL))
def sector_join(spark, sf):
    x = files.with_sector(views.cross_section_bars(spark, sf), brand_sectors(spark, sf))
    return x.groupBy("sector").agg(F.count(F.lit(1)).alias("n_bars"), F.count_distinct("symbol").alias("n_symbols"),
                                   F.sum("volume").alias("volume"))


@query("src_07_market_data_load", sql(
    sel("bars", ["symbol", DAY], OHLCV) + " WHERE ts >= DATE '1997-01-01' AND ts < DATE '1999-01-01' "
    "AND symbol IN ('ECONOMY','STANDARD','SMALL')", "bars"))
def market_data(spark, sf):
    return _out(files.load_bars(views.bars(spark, sf), ["ECONOMY", "STANDARD", "SMALL"], "1997-01-01", "1999-01-01"))


@query("src_08_liquid_universe", sql(
    """SELECT symbol, count(*) AS n_obs, round(avg(volume), 6) AS mean_volume FROM xbars
       WHERE symbol <> 'Brand#1' GROUP BY 1
       HAVING avg(volume) >= (SELECT avg(volume) FROM xbars)""", "xbars"))
def liquid(spark, sf):
    b = views.cross_section_bars(spark, sf)
    floor = b.agg(F.avg("volume")).first()[0]
    kept, _, _ = files.liquid_universe(b, floor, "Brand#1")
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_obs"), F.round(F.avg("volume"), 6).alias("mean_volume"))


@query("src_09_wide_panel", sql(
    f"SELECT {DAY}, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {s}" for s in
                                  ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM bars GROUP BY ts", "bars"))
def wide_panel(spark, sf):
    names = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    return _day(files.to_panel(views.bars(spark, sf), "close", names)).select("session", *names)


@query("src_10_snapshot_scan", sql(BAR_SQL, "bars"))
def snapshot(spark, sf):
    """Write-once snapshot partitioned by session year, read back."""
    from datetime import datetime
    path = files.save_snapshot(views.bars(spark, sf), files.scratch(spark, "snap"), "bars", datetime(2024, 1, 2))
    return _out(files.load_snapshot(spark, path))


@query("snk_01_snapshot_metadata", sql(
    "SELECT count(*) AS n_rows, count(DISTINCT symbol) AS symbols, strftime(min(ts), '%Y-%m-%d') AS first, "
    "strftime(max(ts), '%Y-%m-%d') AS last FROM bars", "bars"))
def snapshot_metadata(spark, sf):
    from datetime import datetime
    path = files.save_snapshot(views.bars(spark, sf), files.scratch(spark, "snap"), "bars", datetime(2024, 1, 2))
    meta = spark.read.json(path + ".meta")
    return meta.select(F.col("rows").alias("n_rows"), "symbols", F.substring("first", 1, 10).alias("first"),
                       F.substring("last", 1, 10).alias("last"))


_LANE = "sum(('0x' || substr(d, {}, 15))::UBIGINT::HUGEINT)::VARCHAR"


@query("agg_00_dataset_hash", sql(
    "SELECT sha256(" + " || '|' || ".join(["count(*)::VARCHAR"] + [_LANE.format(1 + 15 * i) for i in range(4)])
    + ") AS hash_full, substr(sha256(" + " || '|' || ".join(["count(*)::VARCHAR"] + [_LANE.format(1 + 15 * i) for i in range(4)])
    + "), 1, 16) AS hash16 FROM d", "bars", ctes="""d AS (SELECT sha256(strftime(ts, '%Y-%m-%d') || 'T00:00:00,' || symbol || ','
    || printf('%.10f,%.10f,%.10f,%.10f,%.10f', open, high, low, close, volume)) AS d
    FROM (SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars))"""))
def content_hash(spark, sf):
    b = views.bars(spark, sf).withColumns({c: F.round(c, 6) for c in OHLCV})
    return files.dataset_hash(b)


LEDGER_SQL = """x AS (SELECT 'family' || CAST(o_custkey % 25 AS VARCHAR) AS family_id, 'a' || CAST(o_orderkey AS VARCHAR) AS attempt_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'started' ELSE 'aborted' END AS stage, 1 + o_orderkey % 5 AS n_trials
  FROM orders)"""


def ledger_rows(spark, sf):
    """Search-ledger rows from orders: a start for each, an outcome for the finished ones."""
    o = views.table(spark, sf, "orders")
    stage = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "started").otherwise("aborted")
    return o.select(
        F.concat(F.lit("family"), (F.col("o_custkey") % 25).cast("string")).alias("family_id"),
        F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("attempt_id"), stage.alias("stage"),
        F.lit("grid").alias("search_type"), (1 + F.col("o_orderkey") % 5).alias("n_trials"),
        F.when(stage == "completed", "done").alias("outcome"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("meta"))


LEDGER_AGG = "SELECT family_id, stage, count(*) AS n_rows, CAST(sum(n_trials) AS BIGINT) AS n_trials FROM x GROUP BY 1, 2"


@query("snk_03_ledger_append", sql(LEDGER_AGG, ctes=LEDGER_SQL))
def ledger_append(spark, sf):
    """Start and outcome rows appended in two batches, then scanned strictly."""
    path = files.scratch(spark, "ledger")
    rows = ledger_rows(spark, sf)
    files.append_ledger(rows.where("stage = 'started'"), path)
    files.append_ledger(rows.where("stage <> 'started'"), path)
    back = files.read_records(spark, path, files.LEDGER_SCHEMA)
    return back.groupBy("family_id", "stage").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_trials").alias("n_trials"))


def experiment_records(spark, sf):
    """One nested experiment record per symbol and year, from the momentum ledger."""
    from barwise.plans import q_backtest
    ledger = q_backtest.momentum_ledger(spark, sf)
    per = ledger.groupBy("symbol", F.year("ts").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("net").alias("net"), F.sum("gross").alias("gross"), F.sum("turnover").alias("to"))
    fields = {
        "experiment_id": F.concat_ws("-", "symbol", F.col("y").cast("string")), "strategy": F.lit("momentum"),
        "features": F.array(F.lit("mom_63")), "universe": F.array("symbol"), "target": F.col("symbol"),
        "timeframe": F.lit("1d"), "train_period": F.array(F.lit("none")), "validation_period": F.array(F.lit("none")),
        "test_period": F.array(F.col("y").cast("string")), "trials": F.lit(1), "dataset_version": F.lit("view"),
        "feature_version": F.lit("1"), "strategy_version": F.lit("1"), "code_version": F.lit("1"), "seed": F.lit(42),
        "gross_metrics": F.struct(F.col("gross").alias("total")), "net_metrics": F.struct(F.col("net").alias("total")),
        "costs": F.lit(5.0), "slippage": F.lit(1.0), "oos_metrics": F.struct(F.col("n").alias("bars"), F.col("to").alias("turnover")),
        "bootstrap_interval": F.array(F.col("net") - 1.0, F.col("net") + 1.0),
        "robustness": F.create_map(F.lit("delay"), F.col("net")), "placebo_statistics": F.create_map(F.lit("p"), F.lit(0.5)),
        "information_sources": F.array(F.lit("price_volume")),
        "promotion_state": F.when(F.col("net") > 0, "CANDIDATE").otherwise("RESEARCH_ONLY")}
    return per.select(*[c.alias(n) for n, c in fields.items()])


RECORD_SQL = ("SELECT symbol || '-' || CAST(year(ts) AS VARCHAR) AS experiment_id, count(*) AS bars, "
              "round(sum(net), 6) + 0.0 AS net_total, round(sum(turnover), 6) + 0.0 AS turnover FROM led "
              "GROUP BY symbol, year(ts)")


def _record_rows(df):
    return df.select("experiment_id", F.col("oos_metrics.bars").alias("bars"),
                     (F.round("net_metrics.total", 6) + F.lit(0.0)).alias("net_total"),
                     (F.round("oos_metrics.turnover", 6) + F.lit(0.0)).alias("turnover"))


def register_record_queries(led_sql):
    @query("snk_02_registry_append", led_sql(RECORD_SQL))
    def registry_append(spark, sf):
        path = files.scratch(spark, "registry")
        rec = experiment_records(spark, sf)
        files.append_records(rec, None, path)
        return _record_rows(files.read_records(spark, path, rec.schema))

    @query("src_11_registry_scan", led_sql(
        "SELECT promotion_state, count(*) AS n_records FROM (SELECT CASE WHEN sum(net) > 0 THEN 'CANDIDATE' ELSE "
        "'RESEARCH_ONLY' END AS promotion_state FROM led GROUP BY symbol, year(ts)) GROUP BY 1"))
    def registry_scan(spark, sf):
        path = files.scratch(spark, "registry")
        rec = experiment_records(spark, sf)
        files.append_records(rec, None, path)
        return files.read_records(spark, path, rec.schema).groupBy("promotion_state").agg(F.count(F.lit(1)).alias("n_records"))

    @query("snk_04_run_artifacts", led_sql(
        f"SELECT symbol, {DAY}, round(net, 6) + 0.0 AS net, round(position, 6) + 0.0 AS position FROM led"))
    def run_artifacts(spark, sf):
        from barwise.plans import q_backtest
        led = q_backtest.momentum_ledger(spark, sf)
        folder = files.scratch(spark, "run")
        manifest = led.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.sum("net").alias("net")).select(
            "symbol", F.struct("bars", "net").alias("result"))
        files.write_run({"ledger": led}, manifest, folder)
        return out(_day(spark.read.parquet(f"{folder}/ledger")), "symbol", "session", r=["net", "position"])
