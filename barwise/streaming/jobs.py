"""Structured Streaming jobs for bars, positions, stops and alerts.

Each job takes a streaming DataFrame and returns one; sinks are the caller's.
``drain`` runs a bounded stream to its end and reads the written result, which
is how batch and stream are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barwise.operators.ledger import INITIAL_CASH
from barwise.sources.files import scratch


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied parquet table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available, write parquet in the shared folder and read it back."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data")
             .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def drain_latest(stream: DataFrame, name: str, keys: list[str], version: str) -> DataFrame:
    """Update-mode stream written batch by batch; the newest row per key is the result."""
    spark = stream.sparkSession
    path = scratch(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{path}/data")
    query = (stream.writeStream.outputMode("update").foreachBatch(save)
             .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(f"{path}/data")
    value = F.struct(*[c for c in stream.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct("batch_id", version)).alias("v")).select(*keys, "v.*")


# ---- ticks and bars -------------------------------------------------------------------

def clean_ticks(ticks: DataFrame, ts: str = "ts", price: str = "price", late: str = "1 hour") -> DataFrame:
    """Finite positive prices, one row per (symbol, id) inside the watermark."""
    ok = F.col(price).isNotNull() & ~F.isnan(price) & (F.col(price) > 0) & (F.col(price) != float("inf"))
    return ticks.where(ok).withWatermark(ts, late).dropDuplicatesWithinWatermark(["symbol", "event_id"])


def session_bars(ticks: DataFrame, width: str = "1 day", ts: str = "ts", price: str = "price", late: str = "1 hour") -> DataFrame:
    """Ticks to OHLCV per window; a bar is emitted once the watermark has passed its end."""
    order = F.struct(ts, "event_id")
    x = ticks.withWatermark(ts, late).groupBy("symbol", F.window(ts, width).alias("w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return x.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def last_marks(ticks: DataFrame, ts: str = "ts", price: str = "price") -> DataFrame:
    """Last valid price per symbol (update mode)."""
    ok = F.col(price).isNotNull() & ~F.isnan(price) & (F.col(price) > 0)
    order = F.struct(ts, "event_id")
    return ticks.groupBy("symbol").agg(F.max_by(F.when(ok, F.col(price)), F.when(ok, order)).alias("mark"), F.count(F.lit(1)).alias("n_ticks"))


# ---- rows that count in order --------------------------------------------------------------

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Ordered:
    """What a job does with rows that count in the order of a number.

    ``apply(state, number, values)`` returns the state after a row and the cells it shows.  ``every``: each row shows its
    cells; otherwise only the last one of an update.
    """

    order: str
    unit_ms: int  # event time of a step of the order number
    values: tuple[str, ...]
    state: str
    start: tuple
    shown: str
    apply: Callable
    every: bool = False

    @property
    def shown_names(self) -> list[str]:
        return [part.split()[0] for part in self.shown.split(",")]


BLOCK = 16_384  # numbers in one entry of the state store


class InOrder(StatefulProcessor):
    """Rows come in any order and are settled in the order of their number.

    A row waits by its number (a replay finds it taken) until the watermark is past it; an event-time timer settles what
    waits of a key that gets no rows.  A row behind the watermark comes too late to be applied in order: it goes out as it
    is, with kind "late".  Each update shows the key with its waiting rows applied too, kind "row".

    Waiting rows lie in a map by block of ``BLOCK`` numbers, each block one sorted table of bytes, so a micro-batch reads
    and writes a block once, however many of its rows it brings.  A task holds the micro-batch's rows of one key and one
    block; a key keeps as many rows as the disorder allows, whatever came before.
    """

    def __init__(self, job: Ordered, keys: list[str]):
        self.job, self.keys = job, keys
        self.row = np.dtype([("number", "<i8"), *[(v, "<f8") for v in job.values]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", self.job.state)
        self.waiting = handle.getMapState("waiting", "block long", "rows binary")

    def _read(self, block: int) -> np.ndarray:
        return np.frombuffer(self.waiting.getValue((block,))[0], self.row)

    def _wait(self, found: np.ndarray) -> None:
        """Merge rows into their blocks; of equal numbers the one that came first stays."""
        found = found[np.argsort(found["number"], kind="stable")]
        blocks, starts = np.unique(found["number"] // BLOCK, return_index=True)
        for block, rows in zip(blocks.tolist(), np.split(found, starts[1:])):
            if self.waiting.containsKey((block,)):
                rows = np.concatenate([self._read(block), rows])
            _, first = np.unique(rows["number"], return_index=True)
            self.waiting.updateValue((block,), (rows[first].tobytes(),))

    def _rows(self, key, passed: int, show: bool) -> Iterator[pd.DataFrame]:
        job = self.job
        state = tuple(self.carried.get()) if self.carried.exists() else job.start
        settled, shown, first = state, None, None
        for block in sorted(k[0] for k in self.waiting.keys()):
            if not show and first is not None:
                break
            rows = self._read(block)
            cut = int(np.searchsorted(rows["number"], passed))
            cells = []
            for i, (number, *values) in enumerate(rows.tolist() if show else rows[:cut].tolist()):
                state, shown = job.apply(state, number, values)
                if i < cut:
                    settled = state
                if job.every:
                    cells.append(shown)
            if cut == len(rows):
                self.waiting.removeKey((block,))
            else:
                if cut:
                    self.waiting.updateValue((block,), (rows[cut:].tobytes(),))
                first = int(rows["number"][cut]) if first is None else first
            if show and job.every:
                yield self._frame(key, "row", len(rows), {"number": rows["number"]}, cells)
        self.carried.update(settled)
        if first is not None:
            self.handle.registerTimer((first + 1) * job.unit_ms)
        if show and shown is not None and not job.every:
            yield self._frame(key, "row", 1, {}, [shown])

    def _frame(self, key, kind: str, n: int, given: dict, cells: list) -> pd.DataFrame:
        shown = zip(*cells) if cells else [[None] * n for _ in self.job.shown_names]
        parts = {**{k: [v] * n for k, v in zip(self.keys, key)}, "kind": [kind] * n,
                 **{c: given.get(c, [None] * n) for c in ("number", *self.job.values)}, **dict(zip(self.job.shown_names, shown))}
        return pd.DataFrame({c: pd.Series(v, dtype=None if len(v) and v[0] is not None else object) for c, v in parts.items()})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // self.job.unit_ms
        parts = []
        for pdf in rows:
            part = np.empty(len(pdf), self.row)
            for c, name in zip((self.job.order, *self.job.values), self.row.names):
                part[name] = pdf[c]
            late = part[part["number"] < passed]
            if len(late):
                yield self._frame(key, "late", len(late), {c: late[c] for c in late.dtype.names}, [])
            parts.append(part[part["number"] >= passed])
        self._wait(np.concatenate(parts))
        yield from self._rows(key, passed, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._rows(key, timerValues.getCurrentWatermarkInMs() // self.job.unit_ms, False)


def in_order(rows: DataFrame, job: Ordered, keys: list[str], at, disorder: str) -> DataFrame:
    """Stream of (keys, kind, number, values, shown): rows of ``job`` per key, late ones included.

    ``at`` is the event time of a row.  It sets the watermark and is not handed on, as Spark would drop late rows by it.
    A row without number or value is an error.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    given = [F.coalesce(F.col(c).cast(t), F.raise_error(F.lit(f"a row has no {c}"))).alias(c)
             for c, t in ((job.order, "long"), *((v, "double") for v in job.values))]
    timed = rows.withColumn("_at", at).withWatermark("_at", disorder).select(*keys, *given)
    key_types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{key_types}, kind string, number long, {', '.join(f'`{v}` double' for v in job.values)}, {job.shown}"
    return timed.groupBy(*keys).transformWithStateInPandas(InOrder(job, keys), schema, "Update", "EventTime")


def replay(rows: DataFrame, chunk: str, chunks: int, build, name: str) -> DataFrame:
    """Let the rows of chunk 0, 1, ... arrive one after the other in a job that is stopped and started again in between.

    Returns all its update rows with their ``batch_id``; a batch that is repeated overwrites its own folder.
    """
    spark = rows.sparkSession
    path = scratch(spark, name)
    source = rows.drop(chunk)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")
    for c in range(chunks):
        rows.where(F.col(chunk) == c).drop(chunk).write.mode("append").parquet(f"{path}/in")
        stream = build(spark.readStream.schema(source.schema).parquet(f"{path}/in"))
        query = (stream.writeStream.outputMode("update").foreachBatch(save)
                 .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
        query.awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return spark.read.schema(f"{fields}, batch_id long").parquet(f"{path}/out")


def newest(updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest update row of each key."""
    value = F.struct(*[c for c in updates.columns if c not in (*keys, "batch_id")])
    return updates.groupBy(*keys).agg(F.max_by(value, F.struct("batch_id", version)).alias("v")).select(*keys, "v.*")


# ---- positions and stops --------------------------------------------------------------------

def _apply_fill(q: float, basis: float, d: float, px: float) -> tuple[float, float, float]:
    after = q + d
    if q * d >= 0:
        return after, basis + abs(d) * px, 0.0
    avg = basis / abs(q)
    gain = (1.0 if q > 0 else -1.0) * (px - avg) * min(abs(d), abs(q))
    return after, abs(after) * px if abs(d) > abs(q) else basis * abs(after) / abs(q), gain


def _fill_step(state: tuple, _: int, fill: tuple) -> tuple[tuple, tuple]:
    q, basis, gain = _apply_fill(state[0], state[1], *fill)
    after = (q, basis, state[2] + gain, state[3] + 1)
    return after, (q, basis / abs(q) if q else 0.0, after[2], after[3])


FILLS = Ordered("seq", 1000, ("signed_qty", "price"), "quantity double, basis double, gain double, n long", (0.0, 0.0, 0.0, 0),
                "quantity double, avg_entry double, realized_pnl double, n_fills long", _fill_step)


def running_positions(fills: DataFrame, disorder: int = 1_000) -> DataFrame:
    """Average-cost positions per (account, symbol); fills may come up to ``disorder`` sequence numbers out of order.

    The newest row of kind "row" counts all fills so far; fills that come later than that are rows of kind "late".
    """
    return in_order(fills, FILLS, ["account", "symbol"], F.timestamp_seconds("seq"), f"{disorder} seconds")


def sticky_stops(equity: DataFrame, daily_loss: float = 0.05, max_drawdown: float = 0.20, disorder: str = "30 days") -> DataFrame:
    """Breach flags per account and session with a stop that never resets by itself; sessions may come ``disorder`` out of order.

    The newest row of a session is its result; a session that comes later than that is a row of kind "late".
    """
    def step(state: tuple, _: int, row: tuple) -> tuple[tuple, tuple]:
        previous, stopped = state
        value, drop = row
        loss = bool(value / previous - 1.0 <= -daily_loss) if previous else False
        dd = bool(drop < -max_drawdown)
        stopped = bool(stopped or loss or dd)
        return (value, stopped), (loss, dd, stopped)
    job = Ordered("day", 86_400_000, ("value", "drawdown"), "previous double, stopped boolean", (INITIAL_CASH, False),
                  "loss_breach boolean, dd_breach boolean, stopped boolean", step, every=True)
    numbered = equity.withColumn("day", F.unix_date("session").cast("long"))
    found = in_order(numbered, job, ["account"], F.col("session").cast("timestamp"), disorder)
    return found.withColumn("session", F.date_from_unix_date(F.col("number").cast("int"))).drop("number")


class Silence(StatefulProcessor):
    """Keeps the last event time of a key and reports it once ``max_age_ms`` of event time have passed without another."""

    def __init__(self, max_age_ms: int):
        self.max_age_ms = max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get()[0] if self.last.exists() else None
        last = max([int(r["_ms"]) for r in rows] + ([known] if known is not None else []))
        if last + self.max_age_ms <= timerValues.getCurrentWatermarkInMs():  # already silent for as long
            self.last.clear()
            yield Row(symbol=key[0], last_ms=last)
            return
        self.last.update((last,))
        if known is not None and known != last:
            self.handle.deleteTimer(known + self.max_age_ms)
        self.handle.registerTimer(last + self.max_age_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            last = self.last.get()[0]
            self.last.clear()
            yield Row(symbol=key[0], last_ms=last)


def stale_symbols(ticks: DataFrame, max_age_ms: int, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """One row when a symbol has been silent for ``max_age_ms`` of event time."""
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    x = ticks.withWatermark(ts, late).withColumn("_ms", F.unix_millis(ts)).select("symbol", "_ms")
    return x.groupBy("symbol").transformWithState(Silence(max_age_ms), "symbol string, last_ms long", "Append", "EventTime")


# ---- alerts and news ------------------------------------------------------------------------

def deduplicated_alerts(candidates: DataFrame, ts: str | None = None, late: str = "7 days") -> DataFrame:
    """First alert per (account, dedupe key); with an event time, keys leave the state once the watermark has passed them."""
    if ts is None:
        return candidates.dropDuplicates(["account", "dedupe_key"])
    return candidates.withWatermark(ts, late).dropDuplicatesWithinWatermark(["account", "dedupe_key"])


def eligible_news(news: DataFrame, late: str = "36 hours") -> DataFrame:
    """News admitted by availability time, one row per (event, revision) within the watermark."""
    return news.withWatermark("availability_time", late).dropDuplicatesWithinWatermark(["event_id", "revision"])
