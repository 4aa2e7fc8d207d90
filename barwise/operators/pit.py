"""Point-in-time events: availability, revisions and story clusters.

Bars are a bounded grid; events are not, and one symbol, topic or story may
hold a large part of them.  Events are therefore joined to bars by day,
aggregated to (symbol, bar) before any window, and clustered inside
independent stretches of time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.operators.validation import require_zoned_time

WINDOW_HOURS = 12


def available_asof(events: DataFrame, when: str) -> DataFrame:
    """Events known at ``when`` (ISO time with an offset)."""
    require_zoned_time(events, "availability_time")
    if not (when.endswith("Z") or when[-6:-5] in "+-"):
        raise ValueError("the as-of time needs an explicit offset")
    return events.where(F.col("availability_time") <= F.to_timestamp(F.lit(when)))


def number_bars(bars: DataFrame) -> DataFrame:
    """(symbol, ts, bar_no) with bars numbered from 0 per symbol."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return bars.select("symbol", "ts").withColumn("bar_no", F.row_number().over(w) - 1)


def first_eligible_bar(events: DataFrame, bars: DataFrame, time: str = "availability_time") -> DataFrame:
    """Add ``first_bar``/``first_bar_ts``: the first bar at or after ``time``, null when there is none.

    The lookup table has one row per (symbol, day): that day's bars and the
    first bar of a later day.  Events meet it by an equi-join on day, so a hot
    symbol is spread over its days and no event is sorted.
    """
    grid = number_bars(bars).withColumn("_day", F.to_date("ts"))
    per_day = grid.groupBy("symbol", "_day").agg(
        F.sort_array(F.collect_list(F.struct("ts", "bar_no"))).alias("_bars"))
    days = events.select("symbol", F.to_date(time).alias("_day")).distinct()
    w = Window.partitionBy("symbol").orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    lookup = per_day.join(days, ["symbol", "_day"], "full_outer").withColumn(
        "_later", F.first(F.get("_bars", F.lit(0)), True).over(w))
    x = events.withColumn("_day", F.to_date(time)).join(lookup, ["symbol", "_day"], "left")
    same_day = F.get(F.filter("_bars", lambda b: b["ts"] >= F.col(time)), F.lit(0))
    hit = F.coalesce(same_day, F.col("_later"))
    return x.withColumns({"first_bar": hit["bar_no"], "first_bar_ts": hit["ts"]}).drop("_day", "_bars", "_later")


def available_per_bar(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Per bar: how many event rows are available and when the latest became so.

    The set of events known at a bar is the union of those first eligible at
    it or before, so counts are cumulated over bars and no pairs are made.
    """
    arrivals = first_eligible_bar(events, bars).where("first_bar IS NOT NULL").groupBy("symbol", "first_bar").agg(
        F.count(F.lit(1)).alias("_n"), F.max("availability_time").alias("_last"))
    grid = number_bars(bars).join(arrivals.withColumnRenamed("first_bar", "bar_no"), ["symbol", "bar_no"], "left")
    w = Window.partitionBy("symbol").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.select("symbol", "ts", "bar_no", F.coalesce("_n", F.lit(0)).alias("n_new"),
                       F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("n_available"),
                       F.max("_last").over(w).alias("latest_available"))


def revision_intervals(events: DataFrame) -> DataFrame:
    """Bars [first_bar, until_bar) in which each revision is the latest eligible one.

    Needs ``first_bar``.  Repeats of one revision collapse to the earliest
    available row by a partial aggregation; the window then sees one row per
    revision of an event.  ``until_bar`` is null for revisions never replaced.
    """
    kept = [c for c in events.columns if c not in ("event_id", "revision")]
    first = events.groupBy("event_id", "revision").agg(
        F.min_by(F.struct(*kept), F.struct("availability_time", "publication_time")).alias("_r")
    ).select("event_id", "revision", "_r.*")
    higher = Window.partitionBy("event_id").orderBy(F.desc("revision")).rowsBetween(Window.unboundedPreceding, -1)
    x = first.withColumn("until_bar", F.min("first_bar").over(higher))
    live = F.col("first_bar").isNotNull() & (F.col("until_bar").isNull() | (F.col("until_bar") > F.col("first_bar")))
    return x.where(live)


# ---- story clusters ------------------------------------------------------------

def assign_stories(events: DataFrame, order: tuple[str, ...] = ("availability_time", "publication_time"),
                   hours: int = WINDOW_HOURS, pin: str = "all") -> DataFrame:
    """Add ``canonical_id`` and ``is_copy`` by greedy leader clustering.

    Rows of a (symbol, topic) are taken in ``order``; a row within ``hours`` of
    an earlier leader's event time is a copy of the earliest such leader,
    otherwise it leads.  Blank topics never cluster.  ``pin`` "all": nor does an
    event that has several rows among ``events``, whenever they come.  "later":
    nor do its rows after the first in ``order``, so that a row never changes
    what was known before it.  "none": every row takes part.

    Of rows with the same event time only the first in order can lead, so the
    leaders are found among distinct times, which the clock bounds and not the
    number of rows.  Stretches of time that are further apart than the window
    don't touch; each is read once in order, and all that is held of it are its
    leaders, one per window at most.  Rows then meet the leaders around them.
    """
    span = hours * 3_600_000_000
    x = events.withColumns({
        "_et": F.unix_micros("event_time"),
        "_key": F.struct(*[F.unix_micros(c).alias(c) for c in order], F.col("event_id"), F.col("revision"))})
    usable = F.coalesce(F.length(F.trim("topic")), F.lit(0)) > 0
    if pin != "none":
        many = x.groupBy("event_id").agg(F.count(F.lit(1)).alias("_rows"), F.min("_key").alias("_earliest"))
        x = x.join(many, "event_id")
        usable = usable & (F.col("_rows") == 1 if pin == "all" else F.col("_key") == F.col("_earliest"))
    x = x.withColumn("_bucket", F.when(usable, F.floor(F.col("_et") / span))).drop("_earliest", "_rows")
    near = _near(story_leaders(x.where("_bucket IS NOT NULL"), span))
    hits = F.filter("_near", lambda c: F.abs(c["_et"] - F.col("_et")) <= span)
    out = x.join(near, ["symbol", "topic", "_bucket"], "left").withColumn("_best", F.array_min(hits)["_key"])
    leader = F.coalesce("_best.event_id", F.col("event_id"))
    return out.withColumns({"canonical_id": leader, "is_copy": F.coalesce(F.col("_best") != F.col("_key"), F.lit(False))}).drop(
        "_et", "_key", "_bucket", "_near", "_best")


def story_leaders(rows: DataFrame, span: int) -> DataFrame:
    """(symbol, topic, _home, _c) of every leader, ``_c`` holding its key and event time."""
    first = rows.groupBy("symbol", "topic", "_bucket", "_et").agg(F.min("_key").alias("_key"))
    in_order = first.join(_stretches(first, span), ["symbol", "topic", "_bucket"]).select(
        "symbol", "topic", "_stretch", "_bucket", "_et", "_key").repartition("symbol", "topic", "_stretch").sortWithinPartitions(
        "symbol", "topic", "_stretch", "_key")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, times = None, []  # event times of the leaders of one stretch, ascending
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("symbol", "topic", "_stretch", "_et")))
            leads = []
            for symbol, topic, stretch, t in rows:
                if (symbol, topic, stretch) != group:
                    group, times = (symbol, topic, stretch), []
                at = bisect_left(times, t)
                free = not (at < len(times) and times[at] - t <= span) and not (at and t - times[at - 1] <= span)
                if free:
                    times.insert(at, t)
                leads.append(free)
            yield batch.filter(pa.array(leads, pa.bool_()))
    leaders = in_order.mapInArrow(lead, in_order.schema)
    return leaders.select("symbol", "topic", F.col("_bucket").alias("_home"), F.struct("_key", "_et").alias("_c"))


def _stretches(rows: DataFrame, span: int) -> DataFrame:
    """Per (symbol, topic, bucket): the stretch of linked buckets it belongs to."""
    per = rows.groupBy("symbol", "topic", "_bucket").agg(F.min("_et").alias("_lo"), F.max("_et").alias("_hi"))
    w = Window.partitionBy("symbol", "topic").orderBy("_bucket")
    cut = F.coalesce((F.col("_lo") - F.lag("_hi").over(w) > span).cast("int"), F.lit(0))
    per = per.withColumn("_cut", cut)
    stretch = F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per.select("symbol", "topic", "_bucket", stretch.alias("_stretch"))


def _around(df: DataFrame, column: str, offsets: tuple[int, ...]) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.array(*[F.col(column) + d for d in offsets])))


def _near(leaders: DataFrame) -> DataFrame:
    """Leaders of each bucket and its neighbours as an array of at most three."""
    return _around(leaders, "_home", (-1, 0, 1)).groupBy("symbol", "topic", "_bucket").agg(F.collect_list("_c").alias("_near"))


def deduplicate(events: DataFrame, hours: int = WINDOW_HOURS) -> DataFrame:
    """Keep the first-published copy of each story; corroboration counts it and its copies."""
    x = assign_stories(events, ("publication_time",), hours, pin="none")
    absorbed = x.where("is_copy").groupBy("symbol", "topic", F.col("canonical_id").alias("event_id")).agg(
        F.count(F.lit(1)).alias("_absorbed"))
    kept = x.where("NOT is_copy")
    # The leader row of a story is the first revision row kept under its id.
    w = Window.partitionBy("event_id").orderBy("publication_time", "revision")
    kept = kept.withColumn("_lead", F.row_number().over(w) == 1).join(absorbed, ["symbol", "topic", "event_id"], "left")
    extra = F.when(F.col("_lead"), F.coalesce("_absorbed", F.lit(0))).otherwise(0).cast("double")
    base = F.coalesce(F.col("corroboration"), F.lit(0.0)) if "corroboration" in events.columns else F.lit(1.0)
    return kept.withColumn("corroboration", base + extra).drop("_absorbed", "_lead", "canonical_id", "is_copy")
