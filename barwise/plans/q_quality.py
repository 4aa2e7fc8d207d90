"""Data-quality rules checked against SQL (inventory group VAL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.operators import price_features as pf
from barwise.operators import validation as val
from barwise.plans.catalogue import query, sql, stages
from barwise.plans.q_windows import LIQ_STAGES, RET
from barwise.sources import views

# A deterministic set of damaged bars, the same in Spark and SQL.
DAMAGED_SQL = """bad AS (SELECT CASE WHEN day(ts) = 3 THEN NULL WHEN day(ts) = 4 THEN '' ELSE symbol END AS symbol, ts,
  CASE WHEN day(ts) = 5 THEN high + 1 ELSE open END AS open, CASE WHEN day(ts) = 6 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN day(ts) = 7 THEN NULL WHEN day(ts) = 8 THEN -close WHEN day(ts) = 9 THEN 'Infinity'::DOUBLE ELSE close END AS close,
  CASE WHEN day(ts) = 10 THEN -volume ELSE volume END AS volume FROM bars)"""


def damaged(spark, sf):
    b, d = views.bars(spark, sf), F.dayofmonth("ts")
    return b.withColumns({
        "symbol": F.when(d == 3, F.lit(None).cast("string")).when(d == 4, "").otherwise(F.col("symbol")),
        "open": F.when(d == 5, F.col("high") + 1).otherwise(F.col("open")),
        "high": F.when(d == 6, F.col("low") - 1).otherwise(F.col("high")),
        "close": F.when(d == 7, F.lit(None).cast("double")).when(d == 8, -F.col("close"))
        .when(d == 9, F.lit(float("inf"))).otherwise(F.col("close")),
        "volume": F.when(d == 10, -F.col("volume")).otherwise(F.col("volume"))})


RULES_SQL = {
    "timestamp_missing": "ts IS NULL", "symbol_missing": "symbol IS NULL OR length(trim(symbol)) = 0",
    "value_missing": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL",
    "open_outside_range": "NOT (open >= low AND open <= high)", "close_outside_range": "NOT (close >= low AND close <= high)",
    "high_below_low": "high < low",
    "price_not_positive_finite": " OR ".join(f"({c} IS NULL OR {c} <= 0 OR isinf({c}))" for c in ("open", "high", "low", "close")),
    "volume_not_finite": "volume IS NULL OR isinf(volume)", "volume_negative": "volume < 0"}


def _rules(names):
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {RULES_SQL[n]}) AS n_bad FROM bad" for n in names)


DUP = "SELECT '{rule}' AS rule, coalesce(sum(n), 0)::BIGINT AS n_bad FROM (SELECT count(*) AS n FROM {src} GROUP BY symbol, {t} HAVING count(*) > 1)"


@query("val_01_bar_contract", sql(
    _rules(RULES_SQL) + " UNION ALL " + DUP.format(rule="duplicate_bar", src="bad", t="ts") + " UNION ALL "
    + DUP.format(rule="duplicate_session", src="bad", t="ts")
    + " UNION ALL SELECT 'volume_all_zero', CASE WHEN max(volume) > 0 THEN 0 ELSE 1 END::BIGINT FROM bad", "bars", ctes=DAMAGED_SQL))
def bar_contract(spark, sf):
    return val.validate_bars(damaged(spark, sf))


def _rule_query(name, rules):
    @query(name, sql(_rules(rules), "bars", ctes=DAMAGED_SQL))
    def run(spark, sf):
        table = val.bar_rules()
        return val.count_rules(damaged(spark, sf), {r: table[r] for r in rules})


_rule_query("val_03_symbol_rule", ["symbol_missing"])
_rule_query("val_04_missing_values", ["value_missing"])
_rule_query("val_08_containment", ["open_outside_range", "close_outside_range", "high_below_low"])
_rule_query("val_09_positive_prices", ["price_not_positive_finite"])
_rule_query("val_10_volume_rules", ["volume_not_finite", "volume_negative"])

STAMP_SQL = """SELECT 'unparsed' AS rule, count(*) FILTER (WHERE o_orderkey % 3 = 0 OR o_orderkey % 11 = 0) AS n_bad, count(*) AS n_rows FROM orders"""


@query("val_02_timestamp_rule", STAMP_SQL)
def timestamp_rule(spark, sf):
    """Text times: every third lacks an offset, every eleventh is not a time."""
    o = views.table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 11 == 0, "no time Z").when(
        F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    return o.select(val.parse_zoned(text).alias("t")).agg(
        F.lit("unparsed").alias("rule"), F.count_if(F.col("t").isNull()).alias("n_bad"), F.count(F.lit(1)).alias("n_rows"))


TRADES = "SELECT p_type AS symbol, l_shipdate AS ts FROM lineitem JOIN part ON l_partkey = p_partkey"


@query("val_05_duplicate_bars", f"WITH x AS ({TRADES}) " + DUP.format(rule="duplicate_bar", src="x", t="ts"))
def duplicate_bars(spark, sf):
    """Raw trades, not yet aggregated to bars, repeat (ts, symbol)."""
    p = views.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("symbol"))
    t = views.table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return val.duplicates(t.withColumn("ts", F.col("l_shipdate").cast("timestamp")), "ts", "duplicate_bar")


@query("val_06_duplicate_sessions", sql(DUP.format(rule="duplicate_session", src="hbars", t="CAST(ts AS DATE)"), "hbars"))
def duplicate_sessions(spark, sf):
    return val.duplicates(views.hourly_bars(spark, sf), F.to_date("ts"), "duplicate_session")


@query("val_07_ingest_order", "SELECT 'ingest_order' AS rule, count(*) AS n_bad FROM (SELECT o_orderdate AS t, "
       "lag(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE t < p")
def ingest_order(spark, sf):
    return val.ingest_order(views.table(spark, sf, "orders"), "o_orderkey", "o_orderdate", rows_per_bucket=1000)


@query("val_11_range_contract", sql(
    "SELECT 'not_positive_finite' AS rule, count(*) FILTER (WHERE " + RULES_SQL["price_not_positive_finite"] + ") AS n_bad FROM bad "
    "UNION ALL SELECT 'range_inverted', count(*) FILTER (WHERE high < low) FROM bad UNION ALL "
    "SELECT 'synthetic_range', count(*) FILTER (WHERE day(ts) = 11) FROM bad UNION ALL "
    + DUP.format(rule="duplicate_bar", src="bad", t="ts"), "bars", ctes=DAMAGED_SQL))
def range_contract(spark, sf):
    return val.strict_range_contract(damaged(spark, sf).withColumn("synthetic_range", F.dayofmonth("ts") == 11))


@query("val_12_panel_completeness", sql(
    "SELECT count(DISTINCT ts) * count(DISTINCT symbol) - count(*) AS missing_cells, "
    "count(*) FILTER (WHERE close IS NULL OR isinf(close) OR close <= 0) AS bad_cells FROM bad", "bars", ctes=DAMAGED_SQL))
def panel(spark, sf):
    return val.panel_completeness(damaged(spark, sf), "close")


CAL_SQL = """span AS (SELECT min(ts) AS a, max(ts) AS b FROM bars),
cal AS (SELECT CAST(d AS DATE) AS session FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM span)
  WHERE isodow(d) < 6 AND NOT (month(d) = 12 AND day(d) = 25))"""


def exchange_calendar(bars):
    c = views.calendar(bars, weekdays_only=True)
    return c.where(~((F.month("session") == 12) & (F.dayofmonth("session") == 25)))


@query("val_13_missing_bar_report", sql("""SELECT symbol, n_obs, strftime(first, '%Y-%m-%d') AS first, strftime(last, '%Y-%m-%d') AS last,
  (SELECT count(*) FROM cal WHERE session BETWEEN first AND last) AS n_expected_sessions,
  (SELECT count(*) FROM cal WHERE session BETWEEN first AND last) - hits AS n_missing_sessions,
  n_obs - hits AS n_observed_closures, n_weekend_bars, n_obs - hits - n_weekend_bars AS n_holiday_bars, n_zero_volume
FROM (SELECT symbol, count(*) AS n_obs, min(ts) AS first, max(ts) AS last, count(cal.session) AS hits,
        count(*) FILTER (WHERE isodow(ts) >= 6) AS n_weekend_bars, count(*) FILTER (WHERE volume = 0) AS n_zero_volume
      FROM bars LEFT JOIN cal ON cal.session = bars.ts GROUP BY symbol)""", "bars", ctes=CAL_SQL))
def missing_bars(spark, sf):
    b = views.bars(spark, sf)
    x = val.coverage_report(b, exchange_calendar(b))
    return x.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


@query("val_14_session_predicate", sql(
    "SELECT symbol, count(*) FILTER (WHERE session IS NOT NULL) AS on_session, count(*) FILTER (WHERE session IS NULL) AS off_session "
    "FROM bars LEFT JOIN cal ON cal.session = bars.ts GROUP BY symbol", "bars", ctes=CAL_SQL))
def session_predicate(spark, sf):
    b = views.bars(spark, sf)
    c = exchange_calendar(b).withColumn("hit", F.lit(1))
    x = b.withColumn("session", F.to_date("ts")).join(c, "session", "left")
    return x.groupBy("symbol").agg(F.count("hit").alias("on_session"), (F.count(F.lit(1)) - F.count("hit")).alias("off_session"))


@query("val_15_boundary_coverage", sql("""SELECT r.symbol, coalesce(n_obs, 0) AS n_obs, n_expected, first IS NULL AS absent,
  coalesce(first > ea, true) AS late_start, coalesce(last < eb, true) AS early_end, coalesce(n_obs, 0) < n_expected / 10 AS too_few
FROM (SELECT DISTINCT p_type AS symbol FROM part UNION SELECT 'NOT_LISTED') r
LEFT JOIN (SELECT symbol, min(ts) AS first, max(ts) AS last, count(*) AS n_obs FROM bars GROUP BY 1) p USING (symbol),
(SELECT min(session) AS ea, max(session) AS eb, count(*) AS n_expected FROM cal WHERE session >= DATE '1995-01-05' AND session < DATE '2001-11-10') e""",
                                       "bars", ctes=CAL_SQL))
def coverage(spark, sf):
    b = views.bars(spark, sf)
    want = views.table(spark, sf, "part").select(F.explode(F.array("p_type", F.lit("NOT_LISTED"))).alias("symbol")).distinct()
    return val.boundary_coverage(b, want, exchange_calendar(b), "1995-01-05", "2001-11-10")


EV_BAD_SQL = """bade AS (SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id END AS event_id,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE event_time END AS event_time,
  CASE WHEN event_id % 83 = 0 THEN event_time - INTERVAL 1 HOUR ELSE publication_time END AS publication_time,
  CASE WHEN event_id % 79 = 0 THEN event_time - INTERVAL 2 HOUR ELSE availability_time END AS availability_time,
  event_id % 2 = 0 AS exempt FROM ev)"""


@query("val_16_event_contract", sql(
    """SELECT unnest(['event_id_missing','time_missing','published_before_event','available_before_publication']) AS rule,
  unnest([count(*) FILTER (WHERE event_id IS NULL), count(*) FILTER (WHERE event_time IS NULL OR publication_time IS NULL OR availability_time IS NULL),
    count(*) FILTER (WHERE publication_time < event_time AND NOT exempt), count(*) FILTER (WHERE availability_time < publication_time AND NOT exempt)]) AS n_bad FROM bade""",
    "ev", ctes=EV_BAD_SQL))
def event_contract(spark, sf):
    e, k = views.pit_events(spark, sf), F.col("event_id")
    bad = e.withColumns({
        "provider_rule_exception": k % 2 == 0,
        "publication_time": F.when(k % 83 == 0, F.col("event_time") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("publication_time")),
        "availability_time": F.when(k % 79 == 0, F.col("event_time") - F.expr("INTERVAL 2 HOUR")).otherwise(F.col("availability_time")),
        "event_time": F.when(k % 89 != 0, F.col("event_time")),
        "event_id": F.when(k % 97 != 0, k)})
    bad = val.normalise_events(bad)
    return val.count_rules(bad, val.event_rules(bad))


CONFLICT_SQL = """rep AS (SELECT event_id, revision, source, raw_value, sentiment FROM ev UNION ALL
  SELECT event_id, revision, CASE WHEN event_id % 60 = 0 THEN 'other' ELSE source END,
         CASE WHEN event_id % 90 = 0 THEN NULL ELSE raw_value END, CASE WHEN event_id % 150 = 0 THEN sentiment + 0.5 ELSE sentiment END
  FROM ev WHERE event_id % 30 = 0)"""


@query("val_17_identity_conflicts", sql("""SELECT event_id, revision, count(*) AS n_rows, concat_ws(',',
    CASE WHEN count(DISTINCT raw_value) + CAST(count(*) > count(raw_value) AS INTEGER) > 1 THEN 'raw_value' END,
    CASE WHEN count(DISTINCT source) > 1 THEN 'source' END, CASE WHEN count(DISTINCT sentiment) > 1 THEN 'sentiment' END) AS conflicts
  FROM rep GROUP BY 1, 2 HAVING conflicts <> ''""", "ev", ctes=CONFLICT_SQL))
def conflicts(spark, sf):
    e = val.normalise_events(views.pit_events(spark, sf))
    k = F.col("event_id")
    again = e.where(k % 30 == 0).withColumns({
        "source": F.when(k % 60 == 0, "other").otherwise(F.col("source")),
        "raw_value": F.when(k % 90 != 0, F.col("raw_value")),
        "sentiment": F.when(k % 150 == 0, F.col("sentiment") + 0.5).otherwise(F.col("sentiment"))})
    return val.identity_conflicts(e.unionByName(again))


def _qc_sql(names, src):
    return " UNION ALL ".join(f"""SELECT '{n}' AS feature, round(avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share,
  count(*) FILTER (WHERE isinf({n})) AS n_inf, coalesce(min({n}) = max({n}), false) AS constant,
  round(CASE WHEN count({n}) > 10 AND stddev_samp({n}) > 0 THEN greatest((max({n}) - avg({n})) / stddev_samp({n}), (avg({n}) - min({n})) / stddev_samp({n})) END, 6) AS max_abs_z,
  avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 AS mostly_null,
  coalesce(CASE WHEN count({n}) > 10 AND stddev_samp({n}) > 0 THEN greatest((max({n}) - avg({n})) / stddev_samp({n}), (avg({n}) - min({n})) / stddev_samp({n})) END > 10, false) AS outlier FROM {src}""" for n in names)


@query("val_18_feature_quality", sql(_qc_sql(pf.LIQUIDITY_FEATURES, "f4"), "bars", ctes=stages("bars", *LIQ_STAGES)))
def feature_quality(spark, sf):
    x = val.feature_quality(pf.liquidity_features(views.bars(spark, sf)), list(pf.LIQUIDITY_FEATURES))
    return x.withColumns({c: F.round(c, 6) for c in ("null_share", "max_abs_z")})


@query("val_19_feature_constancy", sql(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE isinf({c})) AS n_inf, coalesce(min(CASE WHEN rn > 252 THEN {c} END) = "
                       f"max(CASE WHEN rn > 252 THEN {c} END), false) AS constant FROM x" for c in ("ret", "flat")),
    "bars", ctes="x0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars),\n" + stages("x0", RET, name="y")
    + ",\nx AS (SELECT *, CASE WHEN rn <= 252 THEN close ELSE 1.0 END AS flat FROM y1)"))
def feature_constancy(spark, sf):
    """A series that is constant once the warm-up of 252 rows is over."""
    s = pf.Rolling()
    x = pf.returns(views.bars(spark, sf)).withColumn("rn", F.row_number().over(s.order))
    x = x.withColumn("flat", F.when(F.col("rn") <= 252, F.col("close")).otherwise(1.0)).withColumn("warm", F.col("rn") <= 252)
    q = val.feature_quality(x, ["ret", "flat"], required=("ret",), skip_first="warm")
    return q.select("feature", "n_inf", "constant")


@query("val_20_outcome_gaps", sql(
    """SELECT symbol, count(*) FILTER (WHERE fwd IS NULL AND ts <> m) AS n_gaps, count(*) FILTER (WHERE fwd IS NULL AND ts = m) AS n_end_nulls
  FROM (SELECT symbol, ts, CASE WHEN day(ts) = 17 THEN NULL ELSE lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 END AS fwd,
        max(ts) OVER () AS m FROM bars) GROUP BY symbol""", "bars"))
def gaps(spark, sf):
    x = pf.labels(views.bars(spark, sf)).withColumn("fwd_ret", F.when(F.dayofmonth("ts") != 17, F.col("fwd_ret")))
    return val.outcome_gaps(x, "fwd_ret")


@query("val_21_synthetic_guard", sql("SELECT symbol, count(*) AS n_rows, round(sum(ln(high / low)), 6) AS log_range FROM bars GROUP BY 1", "bars"))
def synthetic_guard(spark, sf):
    """The guard passes genuine ranges through; the rejection is unit-tested."""
    b = pf.reject_synthetic(views.bars(spark, sf).withColumn("synthetic_range", F.lit(False)))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.ln(F.col("high") / F.col("low"))), 6).alias("log_range"))
