"""Streams against batch results, scalar functions and pluggable callbacks (STM, FN, UD)."""

from __future__ import annotations

from statistics import NormalDist as _ND

import numpy as np
from pyspark.sql import functions as F

from barwise.functions import scoring
from barwise.functions.normal import norm_cdf, norm_ppf
from barwise.operators import evaluation as ev
from barwise.operators import ledger as lg
from barwise.operators import metrics as mt
from barwise.operators import pit
from barwise.operators import portfolio as pt
from barwise.operators import statistics as st
from barwise.operators.information import INFO_FEATURES, information_features
from barwise.plans import q_evaluation, q_ledger
from barwise.plans.catalogue import out, query, sel, sql
from barwise.plans.q_backtest import S_SHARPE, led_sql, momentum_ledger
from barwise.plans.q_evaluation import s_mix
from barwise.sources import files, views
from barwise.streaming import jobs


def ticks(spark, sf):
    e = jobs.stream_table(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")


@query("stm_01_clean_ticks", "SELECT event_type AS symbol, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 0 GROUP BY 1")
def clean_ticks(spark, sf):
    x = jobs.drain(jobs.clean_ticks(ticks(spark, sf)), "ticks")
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total"))


@query("stm_02_last_marks", "SELECT event_type AS symbol, arg_max(value, (ts, event_id)) AS mark, count(*) AS n_ticks FROM events GROUP BY 1")
def last_marks(spark, sf):
    return jobs.drain_latest(jobs.last_marks(ticks(spark, sf)), "marks", ["symbol"], "n_ticks")


@query("stm_08_session_bars", """SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def stream_bars(spark, sf):
    """Hourly bars emitted once the watermark has passed; SQL applies the same cut."""
    x = jobs.drain(jobs.session_bars(ticks(spark, sf), "1 hour"), "bars")
    return x.select("symbol", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "open", "high", "low", "close", "volume")


CHUNKS = 4


def fill_chunks(spark, sf):
    """Fills with the chunk they arrive in: by order key, a part of them up to 3,000 keys later than their place."""
    f = views.fills(spark, sf).select("account", "symbol", "seq", "signed_qty", "price")
    top = f.agg(F.max("seq")).scalar()
    return f.withColumn("chunk", F.least(F.lit(CHUNKS - 1), F.floor((F.col("seq") + F.col("seq") % 7 * 500) * CHUNKS / top)))


@query("stm_03_running_positions", sql("SELECT account, symbol, arg_max(q, rn) AS quantity, round(coalesce(arg_max(basis, rn) / nullif(abs(arg_max(q, rn)), 0), 0), 6) + 0.0 AS avg_entry, "
                                       "round(sum(realized), 5) + 0.0 AS realized_pnl, count(*) AS n_fills FROM pos GROUP BY 1, 2", "fills", ctes=q_ledger.POS_CTE))
def stream_positions(spark, sf):
    """Stateful positions equal the batch ledger: fills come out of order in four chunks, the job restarts after each, and fills settle in between."""
    updates = jobs.replay(fill_chunks(spark, sf), "chunk", CHUNKS, lambda s: jobs.running_positions(s, 5000), "positions")
    x = jobs.newest(updates.where("kind = 'row'"), ["account", "symbol"], "n_fills")
    return x.select("account", "symbol", "quantity", (F.round("avg_entry", 6) + F.lit(0.0)).alias("avg_entry"),
                    (F.round("realized_pnl", 5) + F.lit(0.0)).alias("realized_pnl"), "n_fills")


@query("stm_03_late_fills", """WITH c AS (SELECT o_custkey % 10 AS account, o_orderpriority AS symbol, o_orderkey AS seq,
  least(3, (o_orderkey + (o_orderkey % 7) * 500) * 4 // (SELECT max(o_orderkey) FROM orders)) AS chunk FROM orders),
w AS (SELECT chunk, max(max(seq)) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM c GROUP BY chunk)
SELECT account, symbol, seq FROM c JOIN w USING (chunk) WHERE seq < top - 400""")
def late_fills(spark, sf):
    """With less disorder allowed than there is, the fills behind the watermark come out as rows of their own."""
    updates = jobs.replay(fill_chunks(spark, sf), "chunk", CHUNKS, lambda s: jobs.running_positions(s, 400), "late-fills")
    return updates.where("kind = 'late'").select("account", "symbol", F.col("number").alias("seq"))


@query("stm_04_sticky_stops", sql("SELECT account, strftime(session, '%Y-%m-%d') AS session, loss_breach, dd_breach, stopped FROM bs", "fills", "marks", ctes=q_ledger.BREACH_CTE))
def sticky_stops(spark, sf):
    """The batch equity table replayed as a stream with a sticky stop in state."""
    path = files.scratch(spark, "equity")
    e = lg.equity(*q_ledger.books(spark, sf), width=q_ledger.WIDTH).select("account", "session", "value", "drawdown")
    e.write.parquet(path)
    x = jobs.drain_latest(jobs.sticky_stops(spark.readStream.schema(e.schema).parquet(path)), "stops", ["account", "session"], "kind")
    return q_ledger.ses(x).select("account", "session", "loss_breach", "dd_breach", "stopped")


@query("stm_05_stream_staleness", """SELECT event_type AS symbol, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY 1
  HAVING epoch_us(max(ts)) // 1000 + 600000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events)""")
def stream_staleness(spark, sf):
    """Symbols that were silent for the last ten minutes of event time, reported by timers."""
    return jobs.drain(jobs.stale_symbols(ticks(spark, sf), 600_000), "stale")


@query("stm_06_stream_alerts", sql("SELECT account, category, severity, dedupe_key FROM al", "fills", "marks", ctes=q_ledger.ALERT_CTE))
def stream_alerts(spark, sf):
    """Rule hits written twice and deduplicated by stream state."""
    path = files.scratch(spark, "alerts")
    a = q_ledger.state(spark, sf)[4]
    a.unionByName(a).write.parquet(path)
    return jobs.drain(jobs.deduplicated_alerts(spark.readStream.schema(a.schema).parquet(path)), "alerts-out")


@query("stm_07_prefix_invariance", sql("SELECT symbol, count(*) AS n_bars, 0::BIGINT AS n_changed FROM hbars WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1", "hbars"))
def prefix_invariance(spark, sf):
    """News available by mid-sample, streamed in with its revisions, gives the same history as the full set (pin "later")."""
    path = files.scratch(spark, "news")
    views.pit_events(spark, sf).write.parquet(path)
    events = spark.read.parquet(path)
    seen = jobs.drain(jobs.eligible_news(spark.readStream.schema(events.schema).parquet(path)), "news-out")
    bars = views.hourly_bars(spark, sf)
    cut = "2024-01-15T00:00:00Z"
    early = information_features(bars, pit.available_asof(seen, cut), pin="later").where(F.col("ts") <= F.to_timestamp(F.lit(cut)))
    full = information_features(bars, events, pin="later")
    x = early.join(full.select("symbol", "ts", *[F.col(c).alias(f"_{c}") for c in INFO_FEATURES]), ["symbol", "ts"])
    changed = sum(((F.abs(F.col(c) - F.col(f"_{c}")) > 1e-9).cast("int") for c in INFO_FEATURES), F.lit(0)) > 0
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.count_if(changed).alias("n_changed"))


# ---- scalar functions ------------------------------------------------------------------

LINE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "


@query("fn_01_elementwise", LINE + "round(ln(l_extendedprice), 9) AS lnv, round(exp(-l_discount * 10), 9) AS ev, round(sqrt(l_quantity), 9) AS sq, abs(l_tax - l_discount) > 0.03 AS ab, "
       "CAST(sign(l_tax - l_discount) AS INTEGER) AS sg, round(pow(1 + l_discount, 3), 9) AS pw FROM lineitem")
def elementwise(spark, sf):
    x = views.table(spark, sf, "lineitem")
    d = F.col("l_tax") - F.col("l_discount")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.ln("l_extendedprice"), 9).alias("lnv"), F.round(F.exp(-F.col("l_discount") * 10), 9).alias("ev"),
                    F.round(F.sqrt("l_quantity"), 9).alias("sq"), (F.abs(d) > 0.03).alias("ab"), F.signum(d).cast("int").alias("sg"),
                    F.round(F.pow(1 + F.col("l_discount"), F.lit(3.0)), 9).alias("pw"))


@query("fn_02_clip_and_null", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE greatest(10.0, least(80.0, value)) END AS clipped, nullif(event_id % 4, 0) AS nz, "
       "CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS side FROM events")
def clip_and_null(spark, sf):
    from barwise.functions.rolling import clip
    x = views.table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return x.select("event_id", clip("v", 10.0, 80.0).alias("clipped"), F.nullif(F.col("event_id") % 4, F.lit(0)).alias("nz"),
                    F.when(F.col("value") > 50, "hi").otherwise("lo").alias("side"))


@query("fn_03_normal_round_trip", "SELECT event_id, round((event_id % 997 + 0.5) / 997.0, 9) AS p FROM events")
def normal_round_trip(spark, sf):
    """Distribution function of the quantile returns the probability (FN-3 and FN-4)."""
    p = (F.col("event_id") % 997 + 0.5) / 997.0
    return views.table(spark, sf, "events").select("event_id", p.alias("u")).select("event_id", F.round(norm_cdf(norm_ppf(F.col("u"))), 9).alias("p"))


_GRID = ", ".join(f"({i}, {_ND().inv_cdf((i + 0.5) / 997.0)!r})" for i in range(997))


@query("fn_04_normal_quantile", f"SELECT event_id, round(z::DOUBLE, 9) + 0.0 AS z FROM events JOIN (VALUES {_GRID}) g(i, z) ON i = event_id % 997")
def normal_quantile(spark, sf):
    """Quantiles against those of the standard library."""
    p = (F.col("event_id") % 997 + 0.5) / 997.0
    return views.table(spark, sf, "events").select("event_id", (F.round(norm_ppf(p), 9) + F.lit(0.0)).alias("z"))


@query("fn_05_text_hash", "SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS short FROM documents")
def text_hash(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.substring(F.sha2("text", 256), 1, 16).alias("short"))


FAM = """'{"assets":["' || array_to_string(list_sort(list(DISTINCT p_brand)), '","') || '"],"frequency":"1d","mode":"part","target":"' || p_type || '"}'"""


@query("fn_06_family_identity", f"SELECT p_type AS target, substr(sha256({FAM}), 1, 16) AS family_id, split_part(p_type || '/v1/' || substr(sha256(p_type), 1, 8), '/', 1) AS lineage FROM part GROUP BY p_type")
def family_identity(spark, sf):
    """Digest of a canonical contract (mode, sorted assets, target); the lineage drops the content hash."""
    x = views.table(spark, sf, "part").groupBy(F.col("p_type").alias("target")).agg(F.sort_array(F.collect_set("p_brand")).alias("assets"))
    contract = F.to_json(F.struct("assets", F.lit("1d").alias("frequency"), F.lit("part").alias("mode"), "target"))
    tag = F.concat_ws("/", "target", F.lit("v1"), F.substring(F.sha2("target", 256), 1, 8))
    return x.select("target", F.substring(F.sha2(contract, 256), 1, 16).alias("family_id"), F.split(tag, "/")[0].alias("lineage"))


@query("fn_07_date_parts", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(CAST(o_orderdate AS DATE) + 5, '%Y-%m-%d') AS later, "
       "CAST(floor(epoch(o_orderdate) / 43200) AS BIGINT) AS half_day FROM orders")
def date_parts(spark, sf):
    o = views.table(spark, sf, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", F.weekday("t").alias("weekday"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
                    F.date_format(F.date_add(F.to_date("t"), 5), "yyyy-MM-dd").alias("later"), F.floor(F.unix_seconds("t") / 43200).alias("half_day"))


@query("fn_08_json_records", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events")
def json_records(spark, sf):
    """Nested record to JSON and back; undefined numbers become null."""
    e = views.table(spark, sf, "events")
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rec = F.to_json(F.struct("event_id", F.from_json("props", "k int").alias("props"), F.when(~F.isnan(v), v).alias("v")))
    back = F.from_json(rec, "event_id long, props struct<k:int>, v double")
    return e.select(back.alias("r")).select("r.event_id", F.col("r.props.k").alias("k"), "r.v")


@query("fn_10_softmax_scores", """SELECT vec_id, round((exp(a) - exp(b)) / (exp(a) + exp(b) + exp(c)), 6) + 0.0 AS sentiment, round(greatest(exp(a), exp(b), exp(c)) / (exp(a) + exp(b) + exp(c)), 6) AS confidence,
  CASE WHEN a >= b AND a >= c THEN 'positive' WHEN b >= c THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)""")
def softmax_scores(spark, sf):
    e = views.table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("logits"))
    x = scoring.sentiment_from_logits(e, "logits", ["positive", "negative", "neutral"])
    return x.select("vec_id", (F.round("sentiment", 6) + F.lit(0.0)).alias("sentiment"), F.round("confidence", 6).alias("confidence"), "label")


@query("fn_11_string_ops", "SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS name, regexp_replace(p_brand, '^Brand#', '') AS code, starts_with(p_type, 'S') AS s, array_to_string(list_reverse(string_split(p_name, ' ')), '|') AS parts FROM part")
def string_ops(spark, sf):
    return views.table(spark, sf, "part").select(
        "p_partkey", F.upper(F.trim(F.concat(F.lit("  "), "p_name", F.lit(" ")))).alias("name"), F.regexp_replace("p_brand", "^Brand#", "").alias("code"),
        F.startswith(F.col("p_type"), F.lit("S")).alias("s"), F.array_join(F.reverse(F.split("p_name", " ")), "|").alias("parts"))


@query("fn_12_half_even", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(l_quantity / 2.0, 0) AS BIGINT) AS half FROM lineitem")
def half_even(spark, sf):
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.bround(F.col("l_quantity") / 2.0).cast("long").alias("half"))


@query("fn_13_annual_turnover", led_sql("SELECT symbol, round(sum(turnover) / greatest(count(*) / 252.0, 1e-9), 6) AS annual_turnover FROM led GROUP BY 1"))
def annual_turnover(spark, sf):
    x = momentum_ledger(spark, sf).groupBy("symbol").agg((F.sum("turnover") / F.greatest(F.count(F.lit(1)) / 252.0, F.lit(1e-9))).alias("annual_turnover"))
    return x.select("symbol", F.round("annual_turnover", 6).alias("annual_turnover"))


# ---- pluggable callbacks -----------------------------------------------------------------

def toy_loader():
    """Stand-in scorer for the tests: share of capitals and of letters in the whole text."""
    def score(texts):
        return [(sum(c.isupper() for c in t) / len(t) * 2 - 1, sum(c.isalpha() for c in t) / len(t)) for t in texts]
    return score


@query("ud_01_text_scores")
def text_scores(spark, sf):
    d = views.table(spark, sf, "documents").where("length(trim(text)) > 0")
    return scoring.score_texts(d.select("doc_id", "text", "lang"), "text", toy_loader, "toy").drop("text")


@query("ud_02_run_callback", sql(f"SELECT symbol, run, count(*) AS n, round({S_SHARPE('net')}, 6) + 0.0 AS sharpe FROM pq GROUP BY 1, 2", "bars", ctes=q_evaluation.PL_CTE.replace("BLK", "1")))
def run_callback(spark, sf):
    """A caller's Python metric per placebo run."""
    x, _ = q_evaluation.frame(spark, sf)
    y = st.permute(x.withColumnRenamed("signal", "dir"), ["fwd_ret"], q_evaluation.RUNS, seed=5)
    led = ev.ledger(y, ["symbol", "run"]).select("symbol", "run", "ts", "net")

    def metric(pdf):
        r = pdf["net"]
        return {"n": len(r), "sharpe": round(float(r.mean() / r.std(ddof=1) * np.sqrt(252.0)), 6) + 0.0}
    return scoring.per_group(led, ["symbol", "run"], metric, "symbol string, run int, n long, sharpe double")


@query("ud_03_registration_hook", sql("SELECT account, state FROM (SELECT account, CASE WHEN min(drawdown) >= -0.5 THEN 'REGISTERED' ELSE 'HELD' END AS state FROM eq GROUP BY 1)", "fills", "marks", ctes=q_ledger.EQ_CTE))
def registration_hook(spark, sf):
    """A decision hook is plain composition: a function from an evidence frame to a decision frame."""
    def register_and_decide(df):
        return df.select("account", F.when(F.col("dd") >= -0.5, "REGISTERED").otherwise("HELD").alias("state"))
    e = lg.equity(*q_ledger.books(spark, sf), width=q_ledger.WIDTH)
    return register_and_decide(e.groupBy("account").agg(F.min("drawdown").alias("dd")))


@query("ud_04_rolling_function", sql("SELECT symbol, strftime(ts, '%Y-%m-%d') AS session, round(list_sum(list_transform(h, lambda v: abs(v - close))) / 20.0 + 3.3e-8, 6) AS mean_gap FROM "
                                     "(SELECT *, CASE WHEN count(*) OVER w = 20 THEN list(close) OVER w END AS h FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))", "bars"))
def rolling_function(spark, sf):
    """An arbitrary function of each 20-row frame as a higher-order expression."""
    from barwise.functions.rolling import Rolling
    s = Rolling()
    x = views.bars(spark, sf)
    x = x.withColumn("h", s.stat(F.collect_list, "close", 20))
    gap = F.aggregate(F.transform("h", lambda v: F.abs(v - F.col("close"))), F.lit(0.0), lambda a, v: a + v) / 20.0
    return x.select("symbol", views.day().alias("session"), F.round(gap + 3.3e-8, 6).alias("mean_gap"))


def inverse_variance(matrix):
    inv = 1.0 / matrix.var(ddof=1)
    return (inv / inv.sum()).to_dict()


@query("ud_05_fold_allocator", sql("SELECT fold, symbol, round((1 / v) / sum(1 / v) OVER (PARTITION BY fold), 8) AS w FROM (SELECT fold, symbol, var_samp(ret) AS v FROM (SELECT *, count(ret) OVER (PARTITION BY fold, ts) AS k FROM lab WHERE split = 'train') WHERE k = 6 GROUP BY 1, 2)",
                                   "bars", ctes=q_evaluation.EVAL_CTE))
def fold_allocator(spark, sf):
    """Weights per training fold from a caller's solver (inverse variance here)."""
    x, plan = q_evaluation.frame(spark, sf)
    names = files.symbol_list(views.bars(spark, sf))
    lab = ev.label_folds(x, plan, splits=("train",)).select("fold", "symbol", "ts", "ret").where("ret IS NOT NULL")
    w = scoring.allocate(lab, ["fold"], names, inverse_variance)
    return w.select("fold", "symbol", F.round("w", 8).alias("w"))
