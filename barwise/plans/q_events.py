"""Point-in-time joins and news features checked against SQL (JN-1..6, WN-56, AG-25, STM-7 batch side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.operators import pit
from barwise.operators.information import INFO_FEATURES, information_features
from barwise.plans.catalogue import out, query, sel, sql
from barwise.sources import views

HOUR = "strftime(ts, '%Y-%m-%d %H') AS hour"


def hour(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH").alias("hour")


@query("jn_01_available_asof", sql("SELECT symbol, revision, count(*) AS n FROM ev WHERE availability_time <= TIMESTAMP '2024-01-11 06:00:00' GROUP BY 1, 2", "ev"))
def available(spark, sf):
    x = pit.available_asof(views.pit_events(spark, sf), "2024-01-11T06:00:00Z")
    return x.groupBy("symbol", "revision").agg(F.count(F.lit(1)).alias("n"))


@query("jn_02_events_per_bar", sql(
    f"""SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H') AS hour, count(e.event_id) AS n_available,
  strftime(max(e.availability_time), '%Y-%m-%d %H:%M:%S') AS latest FROM hbars b
  LEFT JOIN ev e ON e.symbol = b.symbol AND e.availability_time <= b.ts GROUP BY b.symbol, b.ts""", "hbars", "ev"))
def events_per_bar(spark, sf):
    x = pit.available_per_bar(views.hourly_bars(spark, sf), views.pit_events(spark, sf))
    return x.select("symbol", hour(), "n_available", F.date_format("latest_available", "yyyy-MM-dd HH:mm:ss").alias("latest"))


FIRST_CTE = """fb AS (SELECT ev.*, (SELECT min(ts) FROM hbars b WHERE b.symbol = ev.symbol AND b.ts >= ev.availability_time) AS fts FROM ev),
nb AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM hbars),
pl AS (SELECT fb.*, nb.bar_no AS first_bar FROM fb LEFT JOIN nb ON nb.symbol = fb.symbol AND nb.ts = fb.fts)"""


@query("jn_03_first_eligible_bar", sql("SELECT event_id, revision, first_bar, strftime(fts, '%Y-%m-%d %H') AS hour FROM pl", "hbars", "ev", ctes=FIRST_CTE))
def first_bar(spark, sf):
    x = pit.first_eligible_bar(views.pit_events(spark, sf), views.hourly_bars(spark, sf))
    return x.select("event_id", "revision", F.col("first_bar").cast("long").alias("first_bar"), hour("first_bar_ts"))


@query("jn_04_latest_revision", sql(
    """SELECT event_id, revision, first_bar, (SELECT min(q.first_bar) FROM pl q WHERE q.event_id = pl.event_id AND q.revision > pl.revision) AS until_bar
  FROM pl WHERE first_bar IS NOT NULL AND coalesce(until_bar > first_bar, true)""", "hbars", "ev", ctes=FIRST_CTE))
def latest_revision(spark, sf):
    x = pit.first_eligible_bar(views.pit_events(spark, sf), views.hourly_bars(spark, sf))
    return pit.revision_intervals(x).select("event_id", "revision", F.col("first_bar").cast("long").alias("first_bar"),
                                            F.col("until_bar").cast("long").alias("until_bar"))


def story_ctes(order, pin, name="cl"):
    nrev = "count(*) OVER (PARTITION BY event_id)" if pin else "1"
    return f"""{name}e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, topic ORDER BY {order}) AS rn FROM (SELECT *, {nrev} AS nrev FROM ev) WHERE nrev = 1),
{name}r(symbol, topic, rn, leaders, event_id, revision, canonical_id, is_copy) AS (
  SELECT DISTINCT symbol, topic, 0::BIGINT, []::STRUCT(et TIMESTAMP, id BIGINT)[], NULL::BIGINT, NULL::INTEGER, NULL::BIGINT, false FROM {name}e
  UNION ALL SELECT symbol, topic, rn, CASE WHEN len(hit) = 0 THEN list_append(leaders, {{'et': et, 'id': eid}}) ELSE leaders END, eid, rev,
    CASE WHEN len(hit) = 0 THEN eid ELSE hit[1].id END, len(hit) > 0
  FROM (SELECT c.symbol, c.topic, e.rn, c.leaders, e.event_id AS eid, e.revision AS rev, e.event_time AS et,
          list_filter(c.leaders, lambda x: abs(epoch_us(x.et) - epoch_us(e.event_time)) <= 43200000000) AS hit
        FROM {name}r c JOIN {name}e e ON e.symbol = c.symbol AND e.topic = c.topic AND e.rn = c.rn + 1)),
{name} AS (SELECT ev.*, coalesce(r.canonical_id, ev.event_id) AS canonical_id, coalesce(r.is_copy, false) AS is_copy FROM ev
  LEFT JOIN {name}r r ON r.event_id = ev.event_id AND r.revision = ev.revision)"""


STORY_CTE = story_ctes("availability_time, publication_time, event_id", True)


@query("jn_05_story_clusters", sql("SELECT event_id, revision, canonical_id, is_copy FROM cl", "ev", ctes=STORY_CTE))
def stories(spark, sf):
    return pit.assign_stories(views.pit_events(spark, sf)).select("event_id", "revision", "canonical_id", "is_copy")


@query("jn_06_static_dedup", sql(
    """SELECT event_id, revision, 1.0::DOUBLE + CASE WHEN lead_row THEN coalesce(n, 0) ELSE 0 END AS corroboration FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY publication_time, revision) = 1 AS lead_row FROM cl WHERE NOT is_copy) k
  LEFT JOIN (SELECT canonical_id AS cid, count(*) AS n FROM cl WHERE is_copy GROUP BY 1) c ON c.cid = k.event_id""",
    "ev", ctes=story_ctes("publication_time, event_id, revision", False)))
def static_dedup(spark, sf):
    return pit.deduplicate(views.pit_events(spark, sf)).select("event_id", "revision", "corroboration")


INFO_CTE = STORY_CTE + """,
nb AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM hbars),
pl AS MATERIALIZED (SELECT cl.*, (SELECT min(bar_no) FROM nb WHERE nb.symbol = cl.symbol AND nb.ts >= cl.availability_time) AS first_bar FROM cl),
lv AS MATERIALIZED (SELECT p.*, (SELECT min(q.first_bar) FROM pl q WHERE q.event_id = p.event_id AND q.revision > p.revision) AS until_bar FROM pl p
  WHERE NOT is_copy AND first_bar IS NOT NULL),
ag AS (SELECT nb.symbol, nb.ts, nb.bar_no, count(lv.event_id) AS n, sum(pow(0.5, (bar_no - first_bar) / 5.0)) AS w,
  sum(pow(0.5, (bar_no - first_bar) / 5.0) * sentiment) AS ws, sum(pow(0.5, (bar_no - first_bar) / 5.0) * abs(sentiment)) AS wa,
  sum(pow(0.5, (bar_no - first_bar) / 5.0) * novelty) AS wn, count(DISTINCT source) AS breadth,
  max(abs(sentiment) * pow(0.5, (bar_no - first_bar) / 5.0)) AS mx
  FROM nb LEFT JOIN lv ON lv.symbol = nb.symbol AND lv.first_bar <= nb.bar_no AND coalesce(lv.until_bar > nb.bar_no, true) GROUP BY 1, 2, 3),
cp AS (SELECT nb.symbol, nb.bar_no, canonical_id, count(*) AS n FROM nb JOIN pl ON pl.symbol = nb.symbol AND is_copy AND first_bar <= nb.bar_no GROUP BY 1, 2, 3),
cm AS (SELECT symbol, bar_no, 1 + max(n) AS c FROM cp GROUP BY 1, 2),
inf AS (SELECT ag.symbol, ag.ts, coalesce(ws / w, 0) AS info_sentiment, coalesce(wa / w, 0) AS info_abs_sentiment, ln(1 + ag.n) AS info_attention,
  breadth::DOUBLE AS info_source_breadth, coalesce(wn / w, 0) AS info_novelty, coalesce(abs(ws / w) - wa / w, 0) AS info_disagreement,
  coalesce(mx, 0) AS info_intensity, CASE WHEN ag.n > 0 THEN coalesce(c, 1) ELSE 0 END::DOUBLE AS info_corroboration
  FROM ag LEFT JOIN cm USING (symbol, bar_no))"""


@query("wn_56_information_features", sql(sel("inf", ["symbol", HOUR], INFO_FEATURES, 9), "hbars", "ev", ctes=INFO_CTE))
def information(spark, sf):
    x = information_features(views.hourly_bars(spark, sf), views.pit_events(spark, sf))
    return out(x.withColumn("hour", hour()), "symbol", "hour", r=INFO_FEATURES, digits=9)


@query("ag_25_source_breadth", sql("SELECT symbol, max(info_source_breadth) AS max_breadth, round(avg(info_source_breadth), 6) AS mean_breadth FROM inf GROUP BY 1",
                                   "hbars", "ev", ctes=INFO_CTE))
def breadth(spark, sf):
    x = information_features(views.hourly_bars(spark, sf), views.pit_events(spark, sf))
    return x.groupBy("symbol").agg(F.max("info_source_breadth").alias("max_breadth"), F.round(F.avg("info_source_breadth"), 6).alias("mean_breadth"))


@query("jn_17_outer_alignment", sql(
    f"SELECT b.symbol, strftime(b.ts, '%Y-%m-%d') AS session, round(s.info, 6) + 0.0 AS info FROM bars b LEFT JOIN ("
    "SELECT p.p_type AS symbol, CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS info FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
    "JOIN part p ON p_partkey = l_partkey GROUP BY 1, 2) s USING (symbol, ts)", "bars"))
def outer_alignment(spark, sf):
    """A second feature frame aligned to the bar index; absent rows are null."""
    p = views.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("symbol"))
    o = views.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    li = views.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    info = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "symbol", F.to_date("o_orderdate").cast("timestamp").alias("ts")).agg(F.avg("o_totalprice").alias("info"))
    x = views.bars(spark, sf).select("symbol", "ts").join(info, ["symbol", "ts"], "left")
    return out(x.withColumn("session", views.day()), "symbol", "session", r=["info"])
