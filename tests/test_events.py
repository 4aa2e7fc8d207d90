"""Events: joins, revisions, clusters and news features against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwise.operators import pit
from barwise.operators import validation as val
from barwise.operators.information import INFO_FEATURES, information_features


def make(spark, rows):
    cols = ["event_id", "symbol", "event_time", "publication_time", "availability_time", "source", "sentiment", "novelty", "topic", "revision"]
    pdf = pd.DataFrame(rows, columns=cols)
    for c in cols[2:5]:
        pdf[c] = pd.to_datetime(pdf[c], format="mixed")
    return spark.createDataFrame(pdf).withColumns({"raw_value": F.lit("v"), "processed_value": F.lit("v"), "revision": F.col("revision").cast("int")})


def random_events(spark, n=160, seed=3):
    rng = np.random.default_rng(seed)
    t0 = pd.Timestamp("2024-01-01")
    rows = []
    for i in range(n):
        et = t0 + pd.Timedelta(minutes=int(rng.integers(0, 60 * 24 * 12)))
        pub = et + pd.Timedelta(minutes=int(rng.integers(0, 300)))
        av = pub + pd.Timedelta(minutes=int(rng.integers(0, 2000)))
        topic = rng.choice(["x", "y", ""])
        rows.append((i, rng.choice(["A", "B"]), et, pub, av, f"s{i % 4}", float(rng.uniform(-1, 1)), float(rng.uniform(0, 1)), topic, 0))
        if i % 15 == 0:
            rows.append((i, rows[-1][1], et, pub, av + pd.Timedelta(days=1), f"s{i % 4}", float(rng.uniform(-1, 1)), 0.5, topic, 1))
    return make(spark, rows), rows


def brute_clusters(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][4], rows[i][3], rows[i][0]))
    many = {r[0] for r in rows if sum(q[0] == r[0] for q in rows) > 1}
    leader = {}
    for a, i in enumerate(order):
        if i in leader:
            continue
        leader[i] = i
        if rows[i][0] in many or not rows[i][8]:
            continue
        for j in order[a + 1:]:
            same = rows[j][1] == rows[i][1] and rows[j][8] == rows[i][8]
            if j not in leader and same and rows[j][0] not in many and abs(rows[j][2] - rows[i][2]) <= pd.Timedelta(hours=12):
                leader[j] = i
    return {(rows[i][0], rows[i][9]): rows[k][0] for i, k in leader.items()}


def test_clusters_match_brute_force(spark):
    ev, rows = random_events(spark)
    got = {(r.event_id, r.revision): r.canonical_id for r in pit.assign_stories(ev).collect()}
    assert got == brute_clusters(rows)


def test_static_dedup_counts_copies(spark):
    t = "2024-01-01 00:00"
    ev = make(spark, [(1, "A", t, t, t, "s", 0.1, 0.0, "x", 0), (2, "A", "2024-01-01 06:00", "2024-01-01 07:00", t, "s", 0.1, 0.0, "x", 0),
                      (3, "A", "2024-01-01 18:00", "2024-01-01 19:00", t, "s", 0.1, 0.0, "x", 0), (4, "A", t, t, t, "s", 0.1, 0.0, "", 0)])
    got = {r.event_id: r.corroboration for r in pit.deduplicate(ev).collect()}
    assert got == {1: 2.0, 3: 1.0, 4: 1.0}


def brute_features(rows, bars, symbol):
    canon = brute_clusters(rows)
    mine = [r for r in rows if r[1] == symbol]
    leaders = [r for r in mine if canon[(r[0], r[9])] == r[0]]
    out = []
    for i, t in enumerate(bars):
        best = {}
        for r in leaders:
            if r[4] <= t and (r[0] not in best or r[9] > best[r[0]][9]):
                best[r[0]] = r
        live = list(best.values())
        if not live:
            out.append([0.0] * 8)
            continue
        w = [0.5 ** (max(i - np.searchsorted(bars, r[4]), 0) / 5.0) for r in live]
        s, nv = [r[6] for r in live], [r[7] for r in live]
        mean = float(np.average(s, weights=w))
        mag = float(np.average(np.abs(s), weights=w))
        copies = [1 + sum(1 for q in mine if canon[(q[0], q[9])] == r[0] and q[0] != r[0] and q[4] <= t) for r in live]
        out.append([mean, mag, math.log1p(len(live)), float(len({r[5] for r in live})), float(np.average(nv, weights=w)),
                    abs(mean) - mag, float(max(abs(a) * b for a, b in zip(s, w))), float(max(copies))])
    return np.array(out)


def test_a_dense_topic_over_ten_years_is_read_once(spark):
    """One item an hour, three sources each: 13 hours from leader to leader, in one pass and without rounds."""
    hours = 10 * 365 * 24
    ev = spark.range(3 * hours).select(
        F.col("id").alias("event_id"), F.lit(0).alias("revision"), F.lit("A").alias("symbol"), F.lit("x").alias("topic"),
        F.timestamp_seconds(1_300_000_000 + 3600 * (F.col("id") % hours)).alias("event_time")).withColumns(
        {"availability_time": F.col("event_time"), "publication_time": F.col("event_time")})
    found = pit.assign_stories(ev)
    leaders = found.where("NOT is_copy").agg(F.count(F.lit(1)), F.max("event_id"), F.sum((F.col("event_id") % 13 != 0).cast("int"))).first()
    assert tuple(leaders) == (-(-hours // 13), (hours - 1) // 13 * 13, 0)
    assert found.where("canonical_id <> floor((event_id % 87600) / 13) * 13").count() == 0


def test_leaders_are_found_among_distinct_times(spark):
    """A hot instant reaches the ordered pass as one row."""
    t = "2024-01-01 00:00"
    ev = make(spark, [(i, "A", t, t, t, "s", 0.1, 0.0, "x", 0) for i in range(500)]).repartition(4)
    x = ev.withColumns({"_et": F.unix_micros("event_time"), "_bucket": F.lit(3), "_key": F.struct("event_id", "revision")})
    assert pit.story_leaders(x, 1).count() == 1
    assert {r.canonical_id for r in pit.assign_stories(ev).collect()} == {0}


def test_information_features_match_brute_force(spark):
    ev, rows = random_events(spark, 90, 8)
    stamps = pd.date_range("2024-01-01 05:00", periods=40, freq="9h")
    bars = spark.createDataFrame(pd.DataFrame([{"symbol": s, "ts": t} for s in "AB" for t in stamps]))
    got = information_features(bars, ev).toPandas().sort_values(["symbol", "ts"])
    for s in "AB":
        mine = got[got.symbol == s][list(INFO_FEATURES)].to_numpy(dtype=float)
        np.testing.assert_allclose(mine, brute_features(rows, stamps, s), rtol=1e-9, atol=1e-9)


def test_asof_needs_an_offset(spark):
    ev, _ = random_events(spark, 5)
    with pytest.raises(ValueError):
        pit.available_asof(ev, "2024-01-02T00:00:00")
    assert pit.available_asof(ev, "2030-01-01T00:00:00Z").count() == ev.count()


def test_after_close_news_lands_on_the_next_bar(spark):
    t = "2024-01-02 18:00"
    ev = make(spark, [(1, "A", t, t, t, "s", 0.1, 0.0, "x", 0), (2, "A", t, t, "2024-02-01", "s", 0.1, 0.0, "x", 0)])
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.to_datetime(["2024-01-02 16:00", "2024-01-05 16:00"])}))
    got = {r.event_id: r.first_bar for r in pit.first_eligible_bar(ev, bars).collect()}
    assert got == {1: 1, 2: None}


def test_event_contract_rules(spark):
    t = "2024-01-02"
    ev = make(spark, [(1, "A", t, "2024-01-01", t, "s", 0.1, 0.0, "x", 0), (2, "A", t, t, "2024-01-01", "s", 0.1, 0.0, "x", 0)])
    rules = {r.rule: r.n_bad for r in val.count_rules(ev, val.event_rules(ev)).collect()}
    assert rules["published_before_event"] == 1 and rules["available_before_publication"] == 1
    exempt = ev.withColumn("provider_rule_exception", F.lit(True))
    assert sum(r.n_bad for r in val.count_rules(exempt, val.event_rules(exempt)).collect()) == 0
    with pytest.raises(val.DataQualityError):
        val.normalise_events(ev.withColumn("provider_rule_exception", F.lit("yes")))
    with pytest.raises(val.DataQualityError):
        val.normalise_events(ev.drop("source"))


def test_identity_conflicts_count_nulls(spark):
    t = "2024-01-02"
    a = make(spark, [(1, "A", t, t, t, "s", 0.1, 0.0, "x", 0)])
    same = a.unionByName(a)
    assert val.identity_conflicts(same).count() == 0
    other = a.unionByName(a.withColumn("raw_value", F.lit(None).cast("string")))
    assert val.identity_conflicts(other).first().conflicts == "raw_value"
