"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def out(df: DataFrame, *keep: str, r=(), digits: int = 6) -> DataFrame:
    """Result columns: plain ``keep`` and rounded ``r`` (negative zero removed)."""
    rounded: list[Column] = [(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) for c in r]
    return df.select(*keep, *rounded)


# ---- SQL fragments -------------------------------------------------------

def _bars_cte(name: str, column: str) -> str:
    return f"""{name}_t AS (
  SELECT p.{column} AS symbol, CAST(l.l_shipdate AS DATE) AS ts,
         p.p_retailprice*(1-l.l_discount)*(1+l.l_tax) AS px, l.l_quantity AS qty,
         ROW_NUMBER() OVER (PARTITION BY p.{column}, CAST(l.l_shipdate AS DATE)
           ORDER BY l.l_orderkey,l.l_linenumber,l.l_partkey,l.l_suppkey,l.l_extendedprice,l.l_discount,l.l_tax) AS rn,
         COUNT(*) OVER (PARTITION BY p.{column}, CAST(l.l_shipdate AS DATE)) AS n
  FROM lineitem l JOIN part p ON l.l_partkey=p.p_partkey),
{name} AS (SELECT symbol, ts, MAX(CASE WHEN rn=1 THEN px END) AS open, MAX(px) AS high, MIN(px) AS low,
       MAX(CASE WHEN rn=n THEN px END) AS close, SUM(qty) AS volume FROM {name}_t GROUP BY symbol, ts)"""


CTES = {
    "bars": _bars_cte("bars", "p_type"),
    "xbars": _bars_cte("xbars", "p_brand"),
    "hbars": """hb_t AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS hr, value AS px,
         ROW_NUMBER() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn,
         COUNT(*) OVER (PARTITION BY event_type, date_trunc('hour', ts)) AS n FROM events),
hbars AS (SELECT symbol, CAST(hr AS TIMESTAMP) AS ts, MAX(CASE WHEN rn=1 THEN px END) AS open, MAX(px) AS high, MIN(px) AS low,
       MAX(CASE WHEN rn=n THEN px END) AS close, COUNT(*)::DOUBLE AS volume FROM hb_t GROUP BY symbol, hr)""",
    "ev": """ev0 AS (
  SELECT event_id, event_type AS symbol, ts AS event_time,
         ts + to_hours(CAST(event_id % 3 AS INTEGER)) AS publication_time,
         ts + to_hours(CAST(event_id % 3 + 6 * (event_id % 5) AS INTEGER)) AS availability_time,
         'src' || CAST(user_id % 7 AS VARCHAR) AS source, CAST(value AS VARCHAR) AS raw_value,
         greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50.0) / 500.0)) AS sentiment,
         (event_id % 10) / 10.0::DOUBLE AS novelty,
         'topic' || CAST(CAST(props->>'$.k' AS INTEGER) % 10 AS VARCHAR) AS topic, 0 AS revision FROM events),
ev AS (SELECT * FROM ev0 UNION ALL
  SELECT event_id, symbol, event_time, publication_time, availability_time + INTERVAL 24 HOUR, source, raw_value,
         -sentiment, novelty, topic, 1 FROM ev0 WHERE event_id % 20 = 0)""",
    "fills": """fills AS (
  SELECT o_custkey % 10 AS account, o_orderpriority AS symbol, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS session,
         CASE WHEN buy THEN 'BUY' ELSE 'SELL' END AS side, qty AS quantity, o_totalprice / 1000.0 AS price,
         CASE WHEN buy THEN qty ELSE -qty END AS signed_qty, o_orderstatus
  FROM (SELECT *, (o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 2 = 0)) AS buy,
               CAST(1 + o_orderkey % 7 AS DOUBLE) AS qty FROM orders))""",
    "marks": "marks AS (SELECT symbol, session, arg_max(price, seq) AS mark FROM fills GROUP BY symbol, session)",
}


# Bars of the sessions on which every symbol trades, so that long windows are full.
CTES["dbars"] = CTES["bars"] + """,
dbars AS (SELECT * FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)))"""


def sql(body: str, *views: str, ctes: str = "") -> str:
    """Prefix a SELECT with the view definitions it reads."""
    parts = [CTES[v] for v in views] + ([ctes] if ctes else [])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def sel(source: str, keep=(), r=(), digits: int = 6) -> str:
    cols = list(keep) + [f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in r]
    return "SELECT " + ", ".join(cols) + f" FROM {source}"


DAY = "strftime(ts, '%Y-%m-%d') AS session"


def _win(n: int, back: int = 0) -> str:
    end = "CURRENT ROW" if back == 0 else f"{back} PRECEDING"
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + back} PRECEDING AND {end})"


ORD = "OVER (PARTITION BY symbol ORDER BY ts)"


def s_lag(x, n=1):
    return f"lag({x}, {n}) {ORD}"


def s_stat(fn, x, n, back=0, min_obs=None):
    ready = f"= {n}" if min_obs is None else f">= {min_obs}"
    call = fn.format(x) if "{" in fn else f"{fn}({x})"
    return f"CASE WHEN count({x}) {_win(n, back)} {ready} THEN {call} {_win(n, back)} END"


def s_avg(x, n, back=0):
    return s_stat("avg", x, n, back)


def s_sd(x, n, back=0):
    return s_stat("stddev_samp", x, n, back)


def s_z(x, n):
    return f"({x} - ({s_avg(x, n)})) / nullif({s_sd(x, n)}, 0)"


def s_q(x, p, n, min_obs=None):
    return s_stat("quantile_cont({}, " + str(p) + ")", x, n, 0, min_obs)


def s_pair(fn, x, y, n):
    return (f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) {_win(n)} = {n} "
            f"THEN {fn}({x}, {y}) {_win(n)} END")


def stages(base: str, *steps: dict[str, str], name: str = "f") -> str:
    """Chained CTEs; each step adds columns computed from the one before."""
    parts, prev = [], base
    for i, step in enumerate(steps):
        cur = f"{name}{i + 1}"
        parts.append(f"{cur} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in step.items()) + f" FROM {prev})")
        prev = cur
    return ",\n".join(parts)
