"""Reading and writing bars, universes, snapshots and ledgers."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.session import ensure_checkpoint_dir

BAR_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampType()), T.StructField("symbol", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")])
PRICE_COLUMNS = ("open", "high", "low", "close")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- scans ----------------------------------------------------------------

def read_long_csv(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """Long bars from CSV; malformed rows fail the read."""
    raw = spark.read.schema(BAR_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    bars = raw.withColumnRenamed("timestamp", "ts")
    return bars.where(F.col("symbol").isin(symbols)) if symbols else bars


def wide_to_long(wide: DataFrame, ts: str = "timestamp") -> DataFrame:
    """``Close_<SYM>``/``Volume_<SYM>`` columns to bars flagged as synthetic ranges."""
    names = [c[len("Close_"):] for c in wide.columns if c.startswith("Close_")]
    absent = [n for n in names if f"Volume_{n}" not in wide.columns]
    if not names or absent:
        raise ValueError(f"wide bars need Close_ and Volume_ columns; missing volume for {absent}")
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("symbol"), F.col(f"`Close_{n}`").cast("double").alias("close"),
                 F.col(f"`Volume_{n}`").cast("double").alias("volume")) for n in names]))
    long = wide.select(F.col(ts).alias("ts"), cells.alias("c")).select("ts", "c.*").where("close IS NOT NULL")
    return long.select("ts", "symbol", F.col("close").alias("open"), F.col("close").alias("high"),
                       F.col("close").alias("low"), "close", "volume", F.lit(True).alias("synthetic_range"))


def normalise_provider(raw: DataFrame, symbol: str | Column, zone: str = "UTC") -> DataFrame:
    """Provider rows (Date, Open .. Volume) to bars; rows without a close are dropped."""
    sym = F.lit(symbol) if isinstance(symbol, str) else symbol
    named = {c.lower(): c for c in raw.columns}
    numbers = [F.col(named[c]).cast("double").alias(c) for c in (*PRICE_COLUMNS, "volume")]
    when = F.to_utc_timestamp(F.col(named["date"]).cast("timestamp"), zone)
    return raw.select(when.alias("ts"), sym.alias("symbol"), *numbers).na.drop(subset=["close"])


def repair_containment(bars: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Move open/close that lie outside [low, high] by at most ``tolerance`` into the band.

    A larger breach fails the job.  ``repaired`` marks changed rows.
    """
    def breach(c):
        return F.greatest(safe(F.col("low") - F.col(c), "low"), safe(F.col(c) - F.col("high"), "high"), F.lit(0.0))

    def safe(num, base):
        return F.try_divide(num, F.abs(F.col(base)))
    worst = F.greatest(breach("open"), breach("close"))
    fixed = bars.withColumn("_worst", worst).withColumn("repaired", F.when(
        F.col("_worst") > tolerance,
        F.raise_error(F.concat(F.lit("price outside the bar range for "), F.col("symbol"))).cast("boolean")
    ).otherwise(F.col("_worst") > 0))
    return fixed.withColumns({
        c: F.greatest("low", F.least("high", c)) for c in ("open", "close")}).drop("_worst")


def containment_breach(bars: DataFrame) -> DataFrame:
    """Relative size by which each bar's open or close leaves its range."""
    gap = F.greatest(*[F.try_divide(F.col("low") - F.col(c), F.abs("low")) for c in ("open", "close")],
                     *[F.try_divide(F.col(c) - F.col("high"), F.abs("high")) for c in ("open", "close")], F.lit(0.0))
    return bars.withColumn("breach", gap)


def universe(raw: DataFrame, first: int | None = None) -> DataFrame:
    """Distinct upper-case symbols in order, optionally the first ``first``."""
    clean = raw.select(F.upper(F.trim("symbol")).alias("symbol")).where(
        F.col("symbol").isNotNull() & ~F.col("symbol").isin("", "SYMBOL")).distinct().orderBy("symbol")
    return clean.limit(first) if first else clean


def sector_map(json_rows: DataFrame) -> DataFrame:
    """One JSON object per row (symbol -> sector) to (symbol, sector)."""
    return json_rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("symbol", "sector"))


def with_sector(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Left join; symbols without a sector are ``Unknown``."""
    return bars.join(sectors, "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def load_bars(bars: DataFrame, symbols: list[str] | None, start: str, end: str) -> DataFrame:
    """Symbol and half-open period filter, both pushed to the scan."""
    x = bars.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return x.where(F.col("symbol").isin(symbols)) if symbols else x


def liquid_universe(bars: DataFrame, min_volume: float, side_symbol: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(liquid bars, side series, coverage): symbols whose mean volume reaches the floor."""
    stock = bars.where(F.col("symbol") != side_symbol)
    stats = stock.groupBy("symbol").agg(F.avg("volume").alias("mean_volume"), F.count(F.lit(1)).alias("n_obs"))
    kept = stats.where(F.col("mean_volume") >= min_volume)
    side = bars.where(F.col("symbol") == side_symbol).select("ts", F.col("close").alias("level"))
    return stock.join(kept.select("symbol"), "symbol", "left_semi"), side, stats.withColumn(
        "kept", F.col("mean_volume") >= min_volume)


def symbol_list(bars: DataFrame) -> list[str]:
    """Symbols as a driver list; for pivots on export only."""
    return [r[0] for r in bars.select("symbol").distinct().orderBy("symbol").collect()]


def to_panel(bars: DataFrame, field: str, symbols: list[str]) -> DataFrame:
    """Wide ts x symbol frame of one field (export only; the library stays long)."""
    return bars.groupBy("ts").pivot("symbol", symbols).agg(F.first(field, True))


# ---- hashes and sinks -------------------------------------------------------

def dataset_hash(bars: DataFrame, columns=(*PRICE_COLUMNS, "volume"), ts: str = "ts") -> DataFrame:
    """One-row content hash that ignores row order and partitioning.

    Row digests are added up in four 60-bit lanes, so the hash is a plain
    partial aggregation: no sort and no list of rows at any scale.
    """
    text = F.concat_ws(",", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), "symbol",
                       *[F.format_string("%.10f", F.col(c)) for c in columns])
    rows = bars.select(F.sha2(text, 256).alias("d"))
    lanes = [F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")).cast("string")
             for i in range(4)]
    total = rows.agg(F.count(F.lit(1)).cast("string").alias("n"), *[x.alias(f"l{i}") for i, x in enumerate(lanes)])
    return total.select(F.sha2(F.concat_ws("|", "n", "l0", "l1", "l2", "l3"), 256).alias("hash_full")).withColumn(
        "hash16", F.substring("hash_full", 1, 16))


def save_snapshot(bars: DataFrame, folder: str, name: str, stamp: datetime, files_per_year: int = 4) -> str:
    """Write-once parquet snapshot plus a metadata record; an existing target is an error.  Raise ``files_per_year`` with the table."""
    digest = dataset_hash(bars).first()["hash16"]
    path = f"{folder}/{stamp:%Y%m%dT%H%M%SZ}_{name}_{digest}"
    spread = F.pmod(F.xxhash64("symbol", "ts"), F.lit(files_per_year))
    (bars.withColumn("session_year", F.year("ts")).repartition("session_year", spread)
     .write.mode("errorifexists").partitionBy("session_year").parquet(path))
    meta = bars.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"),
                    F.min("ts").alias("first"), F.max("ts").alias("last")).withColumns(
        {"name": F.lit(name), "hash": F.lit(digest), "path": F.lit(path)})
    meta.coalesce(1).write.mode("errorifexists").json(path + ".meta")
    return path


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".csv", ".csv.gz")):
        return read_long_csv(spark, path)
    return spark.read.parquet(path).drop("session_year")


# Fields every experiment record must carry.
REQUIRED_RECORD_FIELDS = (
    "strategy", "features", "universe", "target", "timeframe", "train_period", "validation_period", "test_period",
    "trials", "dataset_version", "feature_version", "strategy_version", "code_version", "seed", "gross_metrics",
    "net_metrics", "costs", "slippage", "oos_metrics", "bootstrap_interval", "robustness", "placebo_statistics",
    "information_sources", "promotion_state")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_records(new: DataFrame, existing: DataFrame | None, path: str, required=REQUIRED_RECORD_FIELDS) -> None:
    """Append experiment records as JSON lines; missing fields and ids that the target (or ``existing``) has are errors."""
    key = "experiment_id"
    missing = [c for c in (key, *required) if c not in new.columns]
    if missing:
        raise ValueError(f"experiment record lacks {missing}")
    if existing is None and path_exists(new.sparkSession, path):
        existing = new.sparkSession.read.schema(new.select(key).schema).json(path)
    repeated = new.groupBy(key).count().where("count > 1").limit(1).count()
    if repeated or (existing is not None and new.join(existing, key, "left_semi").limit(1).count()):
        raise ValueError("experiment id already recorded")
    new.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON-lines ledger; a corrupt line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


LEDGER_SCHEMA = ("family_id string, attempt_id string, stage string, search_type string, n_trials long, "
                 "outcome string, meta map<string,string>")


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append start or outcome rows; the stage must be started, completed or aborted."""
    bad = rows.where(~F.col("stage").isin("started", "completed", "aborted") | F.col("stage").isNull()).limit(1).count()
    if bad:
        raise ValueError("ledger stage must be started, completed or aborted")
    rows.select(*[c.split()[0] for c in LEDGER_SCHEMA.split(", ")]).write.mode("append").json(path)


def write_run(tables: dict[str, DataFrame], manifest: DataFrame, folder: str) -> None:
    """Write the tables of one run and its nested manifest once."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    manifest.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("errorifexists").text(
        f"{folder}/manifest")
