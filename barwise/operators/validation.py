"""Data-quality rules.  Each rule is a predicate for a bad row.

All row rules of a contract are counted in one aggregation; grouped rules
(duplicates, order, coverage) are one aggregation each.  Reports are rows
(rule, n_bad); ``enforce`` turns a report into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
BAR_COLUMNS = ("ts", "symbol", *PRICES, "volume")


class DataQualityError(ValueError):
    """A rule of the data contract is broken."""


def count_rules(df: DataFrame, rules: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rule, n_bad) for every rule from one pass over the rows."""
    counts = [F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()]
    wide = df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_bad")) for n in rules]))
    return wide.select(*keys, pairs.alias("r")).select(*keys, "r.rule", "r.n_bad")


def enforce(report: DataFrame) -> None:
    broken = report.where("n_bad > 0").orderBy("rule").collect()
    if broken:
        raise DataQualityError("; ".join(f"{r['rule']}: {r['n_bad']}" for r in broken))


def require_columns(df: DataFrame, columns=BAR_COLUMNS) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataQualityError(f"missing columns {missing}")
    if df.limit(1).count() == 0:
        raise DataQualityError("no rows")


def require_zoned_time(df: DataFrame, column: str = "ts") -> None:
    """Only zone-aware timestamps carry an unambiguous instant."""
    if not isinstance(df.schema[column].dataType, T.TimestampType):
        raise DataQualityError(f"{column} must be a timestamp with time zone, got {df.schema[column].dataType}")


def parse_zoned(text: Column) -> Column:
    """Timestamp from text with an explicit offset; anything else is null."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def bar_rules() -> dict[str, Column]:
    c = F.col
    inside = lambda x: (c(x) >= c("low")) & (c(x) <= c("high"))
    any_of = lambda xs: __import__("functools").reduce(lambda a, b: a | b, xs)
    return {
        "timestamp_missing": c("ts").isNull(),
        "symbol_missing": c("symbol").isNull() | (F.length(F.trim("symbol")) == 0),
        "value_missing": any_of([c(x).isNull() | F.isnan(c(x)) for x in (*PRICES, "volume")]),
        "open_outside_range": ~inside("open"), "close_outside_range": ~inside("close"),
        "high_below_low": c("high") < c("low"),
        "price_not_positive_finite": any_of([(c(x) <= 0) | ~finite(c(x)) for x in PRICES]),
        "volume_not_finite": ~finite(c("volume")), "volume_negative": c("volume") < 0,
    }


def validate_bars(bars: DataFrame) -> DataFrame:
    """Row rules plus both duplicate rules and the all-zero volume rule."""
    rows = count_rules(bars, bar_rules())
    return (rows.unionByName(duplicates(bars, "ts", "duplicate_bar"))
            .unionByName(duplicates(bars, F.to_date("ts"), "duplicate_session"))
            .unionByName(bars.agg(F.max("volume").alias("m")).select(
                F.lit("volume_all_zero").alias("rule"), F.when(F.col("m") > 0, 0).otherwise(1).cast("long").alias("n_bad"))))


def duplicates(bars: DataFrame, time: Column | str, rule: str) -> DataFrame:
    time = F.col(time) if isinstance(time, str) else time
    groups = bars.groupBy("symbol", time.alias("_t")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_bad")).select(F.lit(rule).alias("rule"), "n_bad")


def ingest_order(df: DataFrame, seq: str, ts: str = "ts", rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Rows whose time is earlier than that of the row ingested before them.

    Ordered inside ranges of the sequence; range edges are compared on the
    per-range first and last rows, so nothing sorts the whole table.
    """
    x = df.select(F.col(seq).alias("_s"), F.col(ts).alias("_t")).withColumn(
        "_b", F.floor(F.col("_s") / rows_per_bucket))
    inner = x.withColumn("_p", F.lag("_t").over(Window.partitionBy("_b").orderBy("_s"))).agg(
        F.count_if(F.col("_t") < F.col("_p")).alias("n"))
    edges = x.groupBy("_b").agg(F.min_by("_t", "_s").alias("f"), F.max_by("_t", "_s").alias("l"))
    edge = edges.withColumn("p", F.lag("l").over(Window.orderBy("_b"))).agg(F.count_if(F.col("f") < F.col("p")).alias("n"))
    return inner.unionByName(edge).agg(F.sum("n").alias("n_bad")).select(F.lit("ingest_order").alias("rule"), "n_bad")


def strict_range_contract(bars: DataFrame) -> DataFrame:
    """Contract of range features: exact types, positive finite, unique and ordered, no synthetic ranges."""
    for name in (*PRICES, "volume"):
        if not isinstance(bars.schema[name].dataType, T.DoubleType):
            raise DataQualityError(f"{name} must be double")
    require_zoned_time(bars)
    rules = {"not_positive_finite": bar_rules()["price_not_positive_finite"],
             "range_inverted": F.col("high") < F.col("low")}
    if "synthetic_range" in bars.columns:
        rules["synthetic_range"] = F.col("synthetic_range")
    return count_rules(bars, rules).unionByName(duplicates(bars, "ts", "duplicate_bar"))


def panel_completeness(bars: DataFrame, field: str, allow_zero: bool = False) -> DataFrame:
    """Cells a full sessions x symbols panel lacks, and bad values among those present."""
    low = F.col(field) < 0 if allow_zero else F.col(field) <= 0
    return bars.agg(
        (F.count_distinct("ts") * F.count_distinct("symbol") - F.count(F.lit(1))).alias("missing_cells"),
        F.count_if(~finite(F.col(field)) | low).alias("bad_cells"))


def coverage_report(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per symbol: observations, expected and missing sessions, closures, weekend and zero-volume bars."""
    obs = bars.select("symbol", F.to_date("ts").alias("session"), "volume")
    marked = obs.join(calendar.select("session", F.lit(True).alias("is_session")), "session", "left")
    open_day = F.coalesce("is_session", F.lit(False))
    weekend = F.weekday("session") >= 5
    per = marked.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("session").alias("first"), F.max("session").alias("last"),
        F.count_if(open_day).alias("_hits"), F.count_if(~open_day).alias("n_observed_closures"),
        F.count_if(weekend).alias("n_weekend_bars"), F.count_if(~open_day & ~weekend).alias("n_holiday_bars"),
        F.count_if(F.col("volume") == 0).alias("n_zero_volume"))
    # Sessions inside [first, last] from ranks of the calendar, looked up by date: no range join.
    ranks = _calendar_ranks(calendar, per)
    a = ranks.select(F.col("day").alias("first"), F.col("upto").alias("_ua"), F.col("is_day").alias("_ia"))
    b = ranks.select(F.col("day").alias("last"), F.col("upto").alias("_ub"))
    return (per.join(a, "first").join(b, "last")
            .withColumn("n_expected_sessions", F.col("_ub") - F.col("_ua") + F.col("_ia"))
            .withColumn("n_missing_sessions", F.col("n_expected_sessions") - F.col("_hits"))
            .drop("_hits", "_ua", "_ub", "_ia"))


def _calendar_ranks(calendar: DataFrame, per: DataFrame) -> DataFrame:
    days = (calendar.select(F.col("session").alias("day"), F.lit(1).alias("is_day"))
            .unionByName(per.select(F.col("first").alias("day"), F.lit(0).alias("is_day")))
            .unionByName(per.select(F.col("last").alias("day"), F.lit(0).alias("is_day"))))
    one = days.groupBy("day").agg(F.max("is_day").alias("is_day"))
    return one.withColumn("upto", F.sum("is_day").over(
        Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def boundary_coverage(bars: DataFrame, requested: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Per requested symbol: does it start and end on the expected sessions with enough rows?"""
    inside = calendar.where((F.col("session") >= F.lit(start).cast("date")) & (F.col("session") < F.lit(end).cast("date")))
    bounds = inside.agg(F.min("session").alias("a"), F.max("session").alias("b"), F.count(F.lit(1)).alias("n"))
    per = bars.groupBy("symbol").agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"),
                                     F.count(F.lit(1)).alias("n_obs"))
    x = requested.join(per, "symbol", "left").withColumns({
        "expected_first": bounds.select("a").scalar(), "expected_last": bounds.select("b").scalar(),
        "n_expected": bounds.select("n").scalar()})
    return x.select("symbol", F.coalesce("n_obs", F.lit(0)).alias("n_obs"), "n_expected",
                    F.col("first").isNull().alias("absent"),
                    F.coalesce(F.col("first") > F.col("expected_first"), F.lit(True)).alias("late_start"),
                    F.coalesce(F.col("last") < F.col("expected_last"), F.lit(True)).alias("early_end"),
                    (F.coalesce("n_obs", F.lit(0)) < F.col("n_expected") / 10).alias("too_few"))


# ---- events ------------------------------------------------------------------

EVENT_COLUMNS = ("event_id", "symbol", "event_time", "publication_time", "availability_time", "source",
                 "raw_value", "processed_value")


def event_rules(df: DataFrame) -> dict[str, Column]:
    c = F.col
    exempt = F.coalesce(c("provider_rule_exception"), F.lit(False)) if "provider_rule_exception" in df.columns else F.lit(False)
    return {
        "event_id_missing": c("event_id").isNull(),
        "time_missing": c("event_time").isNull() | c("publication_time").isNull() | c("availability_time").isNull(),
        "published_before_event": (c("publication_time") < c("event_time")) & ~exempt,
        "available_before_publication": (c("availability_time") < c("publication_time")) & ~exempt,
    }


def normalise_events(events: DataFrame) -> DataFrame:
    missing = [c for c in EVENT_COLUMNS if c not in events.columns]
    if missing:
        raise DataQualityError(f"events lack {missing}")
    for name in ("event_time", "publication_time", "availability_time"):
        require_zoned_time(events, name)
    if "provider_rule_exception" in events.columns and not isinstance(
            events.schema["provider_rule_exception"].dataType, T.BooleanType):
        raise DataQualityError("provider_rule_exception must be boolean")
    rev = F.coalesce(F.col("revision").cast("int"), F.lit(0)) if "revision" in events.columns else F.lit(0)
    return events.withColumn("revision", rev)


def identity_conflicts(events: DataFrame) -> DataFrame:
    """(event_id, revision) groups whose repeats disagree; a null counts as a value.

    min/max and null flags replace distinct sets, so the check is one partial aggregation.
    """
    def varied(c, null_counts=True):
        differ = F.coalesce(F.min(c) != F.max(c), F.lit(False))
        if not null_counts:
            return differ
        nulls = F.count_if(F.col(c).isNull())
        return differ | ((nulls > 0) & (nulls < F.count(F.lit(1))))
    fields = ("raw_value", "processed_value", "source", "event_time", "publication_time", "availability_time")
    parts = [varied(f).alias(f) for f in fields]
    if "sentiment" in events.columns:
        parts.append(varied("sentiment", False).alias("sentiment"))
    names = [*fields, *(["sentiment"] if "sentiment" in events.columns else [])]
    x = events.groupBy("event_id", "revision").agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    bad = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    return x.withColumn("conflicts", F.array_join(bad, ",")).where("conflicts <> ''").select(
        "event_id", "revision", "n_rows", "conflicts")


# ---- features and outcomes ----------------------------------------------------

def feature_quality(features: DataFrame, names: list[str], max_null: float = 0.5, max_z: float = 10.0,
                    required=(), skip_first: str | None = None) -> DataFrame:
    """Per feature: null share, infinities, constancy and largest |z|, with flags.

    Two passes of partial aggregation; the second reads the one-row moments as a
    scalar, so no row is joined.  ``skip_first`` names a boolean column marking
    warm-up rows that the constancy check ignores.
    """
    missing = [c for c in required if c not in features.columns]
    if missing:
        raise DataQualityError(f"missing features {missing}")
    live = ~F.col(skip_first) if skip_first else F.lit(True)
    good = lambda n: F.when(finite(F.col(n)), F.col(n))
    tracked = lambda n: F.when(live, good(n))
    aggs = []
    for n in names:
        aggs += [F.avg(good(n)).alias(f"{n}__m"), F.stddev_samp(good(n)).alias(f"{n}__s"), F.count(good(n)).alias(f"{n}__n"),
                 F.count_if(F.col(n).isNull() | F.isnan(F.col(n))).alias(f"{n}__null"),
                 F.count_if(F.abs(F.col(n)) == float("inf")).alias(f"{n}__inf"),
                 F.coalesce(F.min(tracked(n)) == F.max(tracked(n)), F.lit(False)).alias(f"{n}__const"),
                 F.max(good(n)).alias(f"{n}__hi"), F.min(good(n)).alias(f"{n}__lo")]
    wide = features.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    # The largest |z| sits at the extreme values, so the single pass above is enough.
    items = [F.struct(
        F.lit(n).alias("feature"), F.try_divide(F.col(f"{n}__null"), F.col("rows")).alias("null_share"),
        F.col(f"{n}__inf").alias("n_inf"), F.col(f"{n}__const").alias("constant"),
        F.when((F.col(f"{n}__n") > 10) & (F.col(f"{n}__s") > 0), F.greatest(
            (F.col(f"{n}__hi") - F.col(f"{n}__m")) / F.col(f"{n}__s"),
            (F.col(f"{n}__m") - F.col(f"{n}__lo")) / F.col(f"{n}__s"))).alias("max_abs_z")) for n in names]
    x = wide.select(F.explode(F.array(*items)).alias("f")).select("f.*")
    return x.withColumns({"mostly_null": F.col("null_share") > max_null,
                          "outlier": F.coalesce(F.col("max_abs_z") > max_z, F.lit(False))})


def outcome_gaps(df: DataFrame, outcome: str, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Per key: non-finite outcomes other than one null at the last timestamp of the data."""
    last = df.agg(F.max(ts)).scalar()
    bad = ~finite(F.col(outcome))
    at_end = F.col(outcome).isNull() & (F.col(ts) == F.col("_last"))
    x = df.withColumn("_last", last)
    return x.groupBy(*keys).agg(F.count_if(bad & ~at_end).alias("n_gaps"), F.count_if(bad & at_end).alias("n_end_nulls"))


def contract_violations(produced: DataFrame, registered: DataFrame) -> DataFrame:
    """Produced feature names that no registry entry covers."""
    return produced.join(registered.select("feature"), "feature", "left_anti")
