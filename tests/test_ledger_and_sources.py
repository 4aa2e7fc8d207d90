"""Fill ledger, hash chain, files, streams and quality rejections."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwise.functions.rolling import global_row_number
from barwise.operators import ledger as lg
from barwise.operators import validation as val
from barwise.sources import files
from barwise.streaming import jobs
from tests.conftest import series


def fills(spark, rows):
    """rows: (seq, signed_qty, price)."""
    data = [(1, "A", s, pd.Timestamp("2024-01-01").date(), "BUY" if q > 0 else "SELL", float(abs(q)), float(p), float(q)) for s, q, p in rows]
    return spark.createDataFrame(data, "account long, symbol string, seq long, session date, side string, quantity double, price double, signed_qty double")


def walk_fills(rows):
    q = avg = gain = 0.0
    out = []
    for _, d, p in rows:
        if q * d >= 0:
            avg = (avg * abs(q) + p * abs(d)) / abs(q + d)
        else:
            gain += np.sign(q) * (p - avg) * min(abs(d), abs(q))
            if abs(d) > abs(q):
                avg = p
        q += d
        out.append((q, avg if q else 0.0, gain))
    return out


def test_crossing_zero_resets_the_average(spark):
    rows = [(1, 10, 100), (2, 10, 110), (3, -5, 120), (4, -25, 90), (5, 10, 80)]
    f = lg.final_positions(fills(spark, rows)).first()
    q, avg, gain = walk_fills(rows)[-1]
    assert (f.quantity, f.avg_entry, f.realized_pnl) == pytest.approx((q, avg, gain))


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_position_path_does_not_depend_on_chunks(spark, width):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.choice([-3, -2, -1, 1, 2, 3])), float(rng.uniform(50, 150))) for i in range(80)]
    got = lg.positions(fills(spark, rows), width).orderBy("seq").toPandas()
    want = np.array(walk_fills(rows))
    np.testing.assert_allclose(got.q_after, want[:, 0])
    np.testing.assert_allclose(got.avg_after, want[:, 1], rtol=1e-10, atol=1e-10)
    np.testing.assert_allclose(got.realized.cumsum(), want[:, 2], rtol=1e-10, atol=1e-10)


def test_chain_breaks_at_the_altered_row_only(spark):
    df = spark.createDataFrame([("a", d, f"p{d}") for d in range(5)], "account string, session int, payload string")
    c = lg.chain_reports(df, "payload")
    assert lg.verify_chain(c, "payload").where("broken_link OR broken_digest").count() == 0
    bad = lg.verify_chain(c.withColumn("payload", F.when(F.col("session") == 2, "x").otherwise(F.col("payload"))), "payload")
    assert [r.session for r in bad.where("broken_digest").collect()] == [2]
    gone = lg.verify_chain(c.where("session <> 2"), "payload")
    assert [r.session for r in gone.where("broken_link").collect()] == [3]


def test_stream_positions_over_two_batches_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.choice([-2, -1, 1, 2])), float(rng.uniform(50, 150))) for i in range(60)]
    f = fills(spark, rows)
    for i, part in enumerate((f.where("seq < 30"), f.where("seq >= 30"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))
        q = (jobs.running_positions(stream).writeStream.outputMode("update")
             .foreachBatch(lambda b, n, i=i: b.write.mode("append").parquet(str(tmp_path / "out")))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("kind = 'row'").orderBy(F.desc("n_fills")).first()
    q, avg, gain = walk_fills(rows)[-1]
    assert got.n_fills == 60
    assert (got.quantity, got.avg_entry, got.realized_pnl) == pytest.approx((q, avg, gain))


def test_stale_symbols_are_emitted_by_event_time(spark, tmp_path):
    t = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame({"symbol": ["A", "B", "B"], "ts": [t, t, t + pd.Timedelta(hours=10)]})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts timestamp").parquet(str(tmp_path / "in"))
    x = jobs.drain(jobs.stale_symbols(stream, 3_600_000), "stale")
    assert [r.symbol for r in x.collect()] == ["A"]


def test_snapshot_is_written_once_and_hash_ignores_order(spark, tmp_path):
    b = series(spark, [3, 1, 2], open=1.0, high=4.0, low=0.5, volume=1.0)
    when = datetime(2024, 1, 2)
    path = files.save_snapshot(b, str(tmp_path), "x", when)
    assert files.load_snapshot(spark, path).count() == 3
    with pytest.raises(Exception, match="exists"):
        files.save_snapshot(b, str(tmp_path), "x", when)
    assert files.dataset_hash(b).first() == files.dataset_hash(b.orderBy(F.desc("close"))).first()
    assert files.dataset_hash(b).first() != files.dataset_hash(b.limit(2)).first()


def test_registry_rejects_repeats_and_missing_fields(spark, tmp_path):
    from barwise.plans.q_sources import experiment_records
    rec = experiment_records(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "reg")
    files.append_records(rec, None, path)
    with pytest.raises(ValueError):
        files.append_records(rec, files.read_records(spark, path, rec.schema), path)
    with pytest.raises(ValueError):
        files.append_records(rec.drop("seed"), None, path)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text('{"family_id": "f"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_records(spark, str(tmp_path / "bad"), files.LEDGER_SCHEMA).collect()


def test_wide_bars_need_volume_and_repair_has_a_limit(spark):
    wide = spark.createDataFrame([("2024-01-01", 1.0)], "timestamp string, Close_A double")
    with pytest.raises(ValueError):
        files.wide_to_long(wide)
    b = series(spark, [100], open=110.0, high=101.0, low=99.0)
    with pytest.raises(Exception, match="range"):
        files.repair_containment(b).collect()
    near = files.repair_containment(series(spark, [100], open=101.2, high=101.0, low=99.0)).first()
    assert near.open == 101.0 and near.repaired


def test_quality_report_is_enforced(spark):
    b = series(spark, [10, 11], open=10.0, high=12.0, low=9.0, volume=5.0)
    val.enforce(val.validate_bars(b))
    with pytest.raises(val.DataQualityError, match="high_below_low"):
        val.enforce(val.validate_bars(b.withColumn("high", F.lit(1.0))))
    with pytest.raises(val.DataQualityError, match="duplicate_session"):
        val.enforce(val.validate_bars(b.unionByName(b.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")))))
    with pytest.raises(val.DataQualityError):
        val.require_zoned_time(b.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    with pytest.raises(val.DataQualityError):
        val.require_columns(b.drop("volume"))


def test_ingest_order_does_not_depend_on_ranges(spark):
    rng = np.random.default_rng(1)
    days = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 50, 200), unit="D")
    df = spark.createDataFrame(pd.DataFrame({"seq": range(200), "ts": days}))
    want = int((pd.Series(days).diff() < pd.Timedelta(0)).sum())
    for width in (1, 13, 1000):
        assert val.ingest_order(df, "seq", rows_per_bucket=width).first().n_bad == want


def test_global_row_number(spark):
    df = series(spark, range(90)).unionByName(series(spark, range(40), symbol="B"))
    x = global_row_number(df, ["symbol"], "ts", F.date_trunc("month", "ts")).where("row_no <> close + 1")
    assert x.count() == 0


@pytest.mark.parametrize("batches", [[[10, 11, 12], [1, 2, 3]], [[2, 1], [3, 2, 10], [12, 11, 1]]])
def test_stream_positions_take_fills_in_any_order(spark, tmp_path, batches):
    rows = {k: (k, 2.0 if k % 2 else -3.0, 10.0 + k) for k in (1, 2, 3, 10, 11, 12)}
    path = str(tmp_path / "in")
    schema = fills(spark, [rows[1]]).schema
    for part in batches:
        fills(spark, [rows[k] for k in part]).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        query = (jobs.running_positions(stream).writeStream.outputMode("update").foreachBatch(
            lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("kind = 'row'").orderBy(F.desc("n_fills")).first()
    q = basis = gain = 0.0
    for k in sorted(rows):
        q, basis, g = jobs._apply_fill(q, basis, rows[k][1], rows[k][2])
        gain += g
    assert (got["n_fills"], got["quantity"]) == (6, q) and got["realized_pnl"] == pytest.approx(gain)


def test_shared_folder_is_required_outside_local_mode(monkeypatch):
    from barwise.session import ensure_checkpoint_dir

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_records_are_not_appended_twice(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "x")], "experiment_id string, strategy string")
    files.append_records(rows, None, str(tmp_path / "ledger"), required=("strategy",))
    with pytest.raises(ValueError, match="already recorded"):
        files.append_records(rows, None, str(tmp_path / "ledger"), required=("strategy",))


def test_panel_assembly_checks_names(spark):
    from barwise.operators import governance as gov
    index = spark.createDataFrame([("A", 1), ("A", 2)], "symbol string, ts int")
    one = spark.createDataFrame([("A", 1, 0.5, 1.0)], "symbol string, ts int, x double, y double")
    two = spark.createDataFrame([("A", 2, 2.0)], "symbol string, ts int, z double")
    contract = {"s1": {"x": 1, "y": 1}, "s2": {"z": 1}}
    panel = gov.assemble_panel(index, {"s1": one, "s2": two}, exclude=["y"], contract=contract)
    assert panel.columns == ["symbol", "ts", "x", "z"]
    assert [tuple(r) for r in panel.orderBy("ts").collect()] == [("A", 1, 0.5, None), ("A", 2, None, 2.0)]
    assert gov.assemble_panel(index, {"s1": one, "s2": two}, select=["s2"], contract=contract).columns == ["symbol", "ts", "z"]
    for bad in (dict(sources={"s1": one, "s2": one}), dict(sources={"s1": one}, exclude=["q"]), dict(sources={"s1": one}, select=["s3"]),
                dict(sources={"s1": one.withColumn("w", one.x)})):
        with pytest.raises(ValueError):
            gov.assemble_panel(index, contract={"s1": {"x": 1, "y": 1}, "s2": {"x": 1, "y": 1}}, **bad)


def test_holdings_grow_with_open_days(spark):
    """A position held for 3 of 400 sessions makes 3 rows; equity still has every session."""
    import datetime as dt
    from barwise.operators import ledger as lg
    d0 = dt.date(2024, 1, 1)
    day = lambda i: d0 + dt.timedelta(days=i)
    fills = spark.createDataFrame([(1, "A", 1, day(10), "BUY", 5.0, 10.0, 5.0), (1, "A", 2, day(13), "SELL", 5.0, 12.0, -5.0), (1, "B", 3, day(398), "BUY", 1.0, 7.0, 1.0)],
                                  "account int, symbol string, seq long, session date, side string, quantity double, price double, signed_qty double")
    marks = spark.createDataFrame([(s, day(i), 10.0 + i % 2) for s in "AB" for i in range(400) if not (s == "A" and i == 11)], "symbol string, session date, mark double")
    held = sorted((r.symbol, (r.session - d0).days, r.mark) for r in lg.holdings(fills, marks).collect())
    assert held == [("A", 10, 10.0), ("A", 11, 10.0), ("A", 12, 10.0), ("B", 398, 10.0), ("B", 399, 11.0)]
    e = {(r.session - d0).days: r for r in lg.equity(fills, marks).collect()}
    assert len(e) == 400 and e[0].value == 1_000_000.0 and e[12].open_positions == 1 and e[13].open_positions == 0
    assert e[13].realized_pnl == pytest.approx(10.0) and e[399].realized_pnl == pytest.approx(10.0)
    assert e[399].unrealized_pnl == pytest.approx(4.0)
    assert all(abs(r.net_pnl - (r.realized_pnl + r.unrealized_pnl - r.fees)) < 1e-6 for r in e.values())


def test_fills_settle_behind_the_watermark_and_late_ones_come_out(spark):
    """Disorder of 5: chunk 1 settles fills 1 to 3 and rejects a late 4 of chunk 2, which is a row of its own."""
    rows = [(1, 1.0, 10.0, 0), (2, 1.0, 12.0, 0), (3, -1.0, 15.0, 0), (10, 2.0, 11.0, 0), (9, 1.0, 9.0, 1), (10, 99.0, 1.0, 1), (20, 1.0, 8.0, 1), (4, 5.0, 5.0, 2), (30, 1.0, 7.0, 3)]
    f = fills(spark, [r[:3] for r in rows]).withColumn("chunk", F.lit(0)).limit(0)
    schema = f.schema
    base = fills(spark, [r[:3] for r in rows])
    numbered = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "seq long, signed_qty double, chunk int")
    chunks = base.join(numbered, ["seq", "signed_qty"]).select(*[c.name for c in schema])
    updates = jobs.replay(chunks, "chunk", 4, lambda s: jobs.running_positions(s, 5), "late-test")
    late = updates.where("kind = 'late'").select("number", "signed_qty", "price").collect()
    assert [tuple(r) for r in late] == [(4, 5.0, 5.0)]
    last = jobs.newest(updates.where("kind = 'row'"), ["account", "symbol"], "n_fills").first()
    q = basis = gain = 0.0
    for _, d, px in [(1, 1.0, 10.0), (2, 1.0, 12.0), (3, -1.0, 15.0), (9, 1.0, 9.0), (10, 2.0, 11.0), (20, 1.0, 8.0), (30, 1.0, 7.0)]:
        q, basis, g = jobs._apply_fill(q, basis, d, px)
        gain += g
    assert (last.n_fills, last.quantity) == (7, q) and last.avg_entry == pytest.approx(basis / q) and last.realized_pnl == pytest.approx(gain)


def test_ordered_rows_touch_the_state_once_per_block():
    """20,000 rows of a micro-batch are a write per block of numbers; replays, late rows and the part behind the watermark count as before."""
    class State:
        def __init__(self):
            self.rows, self.calls = {}, 0

        def getValue(self, key):
            self.calls += 1
            return self.rows[key]

        def updateValue(self, key, value):
            self.calls += 1
            self.rows[key] = value

        def removeKey(self, key):
            self.calls += 1
            del self.rows[key]

        def containsKey(self, key):
            self.calls += 1
            return key in self.rows

        def keys(self):
            return iter(list(self.rows))

        def exists(self):
            return "v" in self.rows

        def get(self):
            return self.rows["v"]

        def update(self, value):
            self.rows["v"] = value

    class Handle:
        timers: list = []

        def getValueState(self, *_):
            return State()

        def getMapState(self, *_):
            return State()

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Times:
        def __init__(self, seconds):
            self.seconds = seconds

        def getCurrentWatermarkInMs(self):
            return self.seconds * 1000

    rng = np.random.default_rng(4)
    n = 20_000
    d, px = rng.choice([-2.0, -1.0, 1.0, 2.0], n), rng.uniform(50, 150, n)
    pdf = pd.DataFrame({"seq": np.arange(n), "signed_qty": d, "price": px}).sample(frac=1.0, random_state=1)
    job = jobs.InOrder(jobs.FILLS, ["account", "symbol"])
    job.init(Handle())
    want = [(0.0, 0.0, 0.0)]
    for step in zip(d, px):
        q, basis, g = jobs._apply_fill(*want[-1][:2], *step)
        want.append((q, basis, want[-1][2] + g))
    shown = pd.concat(job.handleInputRows((1, "A"), iter([pdf[:9_000], pdf[9_000:]]), Times(-1)))
    assert job.waiting.calls <= 10 and Handle.timers == [1000]
    assert (shown["n_fills"].tolist(), shown["quantity"].tolist()) == ([n], [want[-1][0]])
    assert list(job.handleExpiredTimer((1, "A"), Times(17_000), None)) == []
    assert job.carried.get()[:3] == pytest.approx(want[17_000]) and Handle.timers[-1] == 17_001_000
    again = pd.DataFrame({"seq": [16_999, 19_999], "signed_qty": [9.0, 9.0], "price": [1.0, 1.0]})
    late, row = job.handleInputRows((1, "A"), iter([again]), Times(17_000))
    assert (late["kind"].tolist(), late["number"].tolist(), late["signed_qty"].tolist()) == (["late"], [16_999], [9.0])
    assert row["n_fills"].tolist() == [n] and row["realized_pnl"].tolist() == pytest.approx([want[-1][2]])


def test_small_chunks_are_walked_without_a_call_each(spark):
    """Chunks of three numbers: only the starts per key are a grouped function, rows pass through their task in order."""
    rng = np.random.default_rng(12)
    rows = [(i, int(rng.choice([-2, -1, 1, 2])), float(rng.uniform(50, 150))) for i in range(200)]
    f = fills(spark, rows)
    two = f.unionByName(f.withColumn("account", F.lit(77).cast(f.schema["account"].dataType)))
    p = lg.positions(two, 3)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("MapInArrow") == 1
    got = {}
    for r in p.orderBy("seq").collect():
        got.setdefault(r.account, []).append((r.q_after, r.avg_after))
    want = [(q, avg) for q, avg, _ in walk_fills(rows)]
    assert len(got) == 2
    for path in got.values():
        assert np.allclose(path, want)
