"""Decayed news features per bar from point-in-time events.

Only story leaders count; of each event only its latest eligible revision
does.  Everything additive is aggregated to one row per (symbol, bar) and then
decayed along the bars; nothing ever pairs bars with events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.rolling import Rolling, safe_div
from barwise.operators.pit import assign_stories, first_eligible_bar, number_bars, revision_intervals
from barwise.operators.price_features import decayed_sum
from barwise.session import ensure_checkpoint_dir

INFO_FEATURES = ("info_sentiment", "info_abs_sentiment", "info_attention", "info_source_breadth", "info_novelty",
                 "info_disagreement", "info_intensity", "info_corroboration")


def information_features(bars: DataFrame, events: DataFrame, half_life: float = 5.0, deduplicate: bool = True, pin: str = "all") -> DataFrame:
    """Eight features for every bar; zeros where no event is live.  With ``pin`` "later" no row changes the past (see ``assign_stories``)."""
    keep = 0.5 ** (1.0 / half_life)
    stories = assign_stories(events, pin=pin) if deduplicate else events.withColumns(
        {"canonical_id": F.col("event_id"), "is_copy": F.lit(False)})
    # Read four times below; written once to the checkpoint folder instead of clustering four times.
    ensure_checkpoint_dir(events.sparkSession)
    placed = first_eligible_bar(stories, bars).where("first_bar IS NOT NULL").select(
        "symbol", "event_id", "revision", "canonical_id", "is_copy", "source", "sentiment", "novelty",
        "publication_time", "availability_time", "first_bar").checkpoint()
    live = revision_intervals(placed.where("NOT is_copy")).select(
        "symbol", "event_id", "first_bar", "until_bar", F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("sentiment", F.lit(0.0)).alias("s"), F.coalesce("novelty", F.lit(0.0)).alias("nov"))
    grid = number_bars(bars)
    x = grid.join(_moment_changes(live, keep), ["symbol", "bar_no"], "left")
    x = x.join(_breadth_changes(live), ["symbol", "bar_no"], "left")
    x = x.join(_copy_peaks(placed.where("is_copy")), ["symbol", "bar_no"], "left")
    x = x.join(_intensity(grid, live, half_life), ["symbol", "bar_no"], "left")
    s = Rolling(("symbol",), "bar_no")
    x = x.withColumns({"_live": F.coalesce(F.sum("_dn").over(s.so_far), F.lit(0)),
                       "_breadth": F.coalesce(F.sum("_db").over(s.so_far), F.lit(0)),
                       "_peak": F.greatest(F.lit(1), F.max("_peak").over(s.so_far))})
    x = decayed_sum(x, {"_dw": "_w", "_ds": "_s", "_da": "_a", "_dv": "_v"}, keep, s)
    on = F.col("_live") > 0

    def mean(c) -> Column:
        return F.when(on, F.coalesce(safe_div(c, "_w"), F.lit(0.0))).otherwise(0.0)
    x = x.withColumns({"info_sentiment": mean("_s"), "info_abs_sentiment": mean("_a"), "info_novelty": mean("_v")})
    return x.select(
        "symbol", "ts", "bar_no", "info_sentiment", "info_abs_sentiment",
        F.log1p(F.col("_live").cast("double")).alias("info_attention"),
        F.col("_breadth").cast("double").alias("info_source_breadth"), "info_novelty",
        (F.abs("info_sentiment") - F.col("info_abs_sentiment")).alias("info_disagreement"),
        F.when(on, F.coalesce("_intensity", F.lit(0.0))).otherwise(0.0).alias("info_intensity"),
        F.when(on, F.col("_peak").cast("double")).otherwise(0.0).alias("info_corroboration"))


def _moment_changes(live: DataFrame, keep: float) -> DataFrame:
    """Per (symbol, bar): weight entering with new rows less the decayed weight of replaced ones."""
    gone = F.when(F.col("until_bar").isNotNull(), F.struct(
        F.col("until_bar").alias("bar_no"), (-F.pow(F.lit(keep), (F.col("until_bar") - F.col("first_bar")).cast("double"))).alias("w"),
        F.lit(-1).alias("n")))
    came = F.struct(F.col("first_bar").alias("bar_no"), F.lit(1.0).alias("w"), F.lit(1).alias("n"))
    x = live.withColumn("_e", F.explode(F.array_compact(F.array(came, gone)))).select("symbol", "s", "nov", "_e.*")
    return x.groupBy("symbol", "bar_no").agg(
        F.sum("n").alias("_dn"), F.sum("w").alias("_dw"), F.sum(F.col("w") * F.col("s")).alias("_ds"),
        F.sum(F.col("w") * F.abs("s")).alias("_da"), F.sum(F.col("w") * F.col("nov")).alias("_dv"))


def _breadth_changes(live: DataFrame) -> DataFrame:
    """Change in the number of distinct live sources; at most one row per (symbol, source, bar) is ordered."""
    gone = F.when(F.col("until_bar").isNotNull(), F.struct(F.col("until_bar").alias("bar_no"), F.lit(-1).alias("n")))
    came = F.struct(F.col("first_bar").alias("bar_no"), F.lit(1).alias("n"))
    x = live.withColumn("_e", F.explode(F.array_compact(F.array(came, gone)))).groupBy("symbol", "source", "_e.bar_no").agg(
        F.sum("_e.n").alias("n"))
    s = Rolling(("symbol", "source"), "bar_no")
    x = x.withColumn("c", F.sum("n").over(s.so_far)).withColumn("p", F.coalesce(s.lag("c"), F.lit(0)))
    step = (F.col("c") > 0).cast("int") - (F.col("p") > 0).cast("int")
    return x.groupBy("symbol", "bar_no").agg(F.sum(step).alias("_db"))


def _copy_peaks(copies: DataFrame) -> DataFrame:
    """Largest 1 + copies reached at each bar; copies are counted per (story, bar) before they are cumulated."""
    per = copies.groupBy("symbol", "canonical_id", F.col("first_bar").alias("bar_no")).agg(F.count(F.lit(1)).alias("n"))
    s = Rolling(("symbol", "canonical_id"), "bar_no")
    per = per.withColumn("c", F.sum("n").over(s.so_far) + 1)
    return per.groupBy("symbol", "bar_no").agg(F.max("c").alias("_peak"))


def _intensity(grid: DataFrame, live: DataFrame, half_life: float) -> DataFrame:
    """max |s| * 0.5^(age / half-life) over the rows live at each bar.

    A stabbing maximum: log2|s| + first_bar/half-life does not depend on the
    bar, and each interval of bars is cut into at most 2 log2(bars) aligned
    blocks.  Blocks are maximised by partial aggregation; every bar then looks
    up the log2(bars) blocks above it.
    """
    last = grid.groupBy("symbol").agg((F.max("bar_no") + 1).alias("_end"))
    depth = F.ceil(F.log2(F.col("_end").cast("double"))).cast("int") + 1
    x = live.where("s <> 0").join(last, "symbol").withColumn("_r", F.coalesce("until_bar", "_end"))
    x = x.withColumn("key", F.log2(F.abs("s")) + F.col("first_bar") / half_life)
    # Equal intervals collapse before they are cut.
    x = x.groupBy("symbol", F.col("first_bar").cast("long").alias("l"), F.col("_r").cast("long").alias("r")).agg(F.max("key").alias("key"))
    empty = F.array().cast("array<struct<level:int,block:bigint>>")

    def cut(st, level):
        left = F.when(st["l"] < st["r"], st["l"])
        take_l = F.when((left % 2) == 1, F.struct(level.cast("int").alias("level"), st["l"].alias("block")))
        l2 = F.when((st["l"] % 2) == 1, st["l"] + 1).otherwise(st["l"])
        take_r = F.when((l2 < st["r"]) & ((st["r"] % 2) == 1), F.struct(level.cast("int").alias("level"), (st["r"] - 1).alias("block")))
        r2 = F.when((st["r"] % 2) == 1, st["r"] - 1).otherwise(st["r"])
        return F.struct(F.shiftright(l2, 1).alias("l"), F.shiftright(r2, 1).alias("r"),
                        F.concat(st["out"], F.array_compact(F.array(take_l, take_r))).alias("out"))
    start = F.struct(F.col("l").alias("l"), F.col("r").alias("r"), empty.alias("out"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.col("r").cast("double") + 1.0)).cast("int"))
    blocks = x.withColumn("_b", F.explode(F.aggregate(steps, start, cut)["out"]))
    blocks = blocks.groupBy("symbol", F.col("_b.level").alias("level"), F.col("_b.block").alias("block")).agg(F.max("key").alias("key"))
    probes = grid.join(last, "symbol").withColumn("level", F.explode(F.sequence(F.lit(0), depth))).withColumn(
        "block", F.expr("shiftright(CAST(bar_no AS BIGINT), level)"))
    return probes.join(blocks, ["symbol", "level", "block"]).groupBy("symbol", "bar_no").agg(
        F.pow(F.lit(2.0), F.max("key") - F.first("bar_no") / half_life).alias("_intensity"))
