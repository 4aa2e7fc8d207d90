"""N-gram Jaccard join against brute force over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from barwise.llm import jaccard


def brute(docs, words, num, den):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n):
    """Texts of 1 to 400 words; most are edited copies of earlier ones, some share a passage."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(w) + 1)
                kind = rng.random()
                if kind < 0.5 and at < len(w):
                    w[at] = rng.choice(vocab)
                elif kind < 0.75 and len(w) > 1:
                    del w[min(at, len(w) - 1)]
                else:
                    w.insert(at, rng.choice(vocab))
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 11, 14, 20, 30, 45, 80, 150, 400]))]
            if rng.random() < 0.3:
                w += passage
        texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,words,num,block", [(1, 4, 85, 256), (2, 5, 80, 256), (3, 4, 85, 8)])
def test_equals_brute_force(spark, monkeypatch, seed, words, num, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = corpus(seed, 400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, words, num).collect()}
    assert got == brute(docs, words, num, 100)


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "  \t\n", 1), (4, "A b C", 1), (5, "a B c", 1), (6, "x", 1), (6, "x", 1), (None, "a b c", 1), (8, "long " * 30000, 1), (9, "LONG " * 30001, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (None, 1, None), (8, 1, 8), (9, 1, 8)], key=str)
    kept = jaccard.keep_one(df.withColumnRenamed("n_shingles", "component_id"))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 6, 8]


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_chain_of_sets_that_share_signatures_costs_a_linear_number_of_comparisons(spark):
    """Each set shares four fifths of its words with the next one and less with others: one family by signatures, no link."""
    n = 20_000
    words = lambda i: " ".join(f"p{i}x{j}" for j in range(20))
    df = spark.createDataFrame([(i, " ".join(words(i + k) for k in range(5))) for i in range(n)], "doc_id long, text string").repartition(8)
    rule = jaccard.Rule(4, 85, 100)
    signed = df.mapInArrow(lambda it: jaccard._signed(it, rule, 0), "sig long, sid long, weak boolean")
    everyone = signed.groupBy("sig").agg({"sid": "count"}).where("`count(sid)` > 1").count()
    groups = jaccard.groups_of(jaccard.prefixes(signed, rule)).cache()
    assert everyone > 2 * n  # they do meet
    compared = groups.agg(F.sum(F.col("size") - 1)).first()[0]  # a set meets the members of its groups at most
    assert compared <= 8 * n and groups.agg({"size": "max"}).first()[0] <= 5
    found = jaccard.join(df)
    assert found.where("component_id = doc_id").count() == n


def test_a_large_group_of_near_copies_is_taken_by_its_hub(spark):
    """Every copy meets the least set; no pairs inside the group are looked at."""
    base = [f"b{j}" for j in range(200)]
    texts = [" ".join(base[:i % 190] + [f"new{i}"] + base[i % 190:]) for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert jaccard.join(df).where("component_id <> 0").count() == 0


def test_sketches_never_exclude_a_link():
    import numpy as np
    rng = np.random.default_rng(2)
    for n in (5, 300, 6000):
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 8:], rng.integers(0, 1 << 62, n // 9, dtype=np.uint64)]))
        s = jaccard.sketch(np.concatenate([a, b]), np.cumsum([0, len(a), len(b)])).view(np.uint64)
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("words,num", [(4, 85), (5, 80)])
def test_every_link_shares_a_signature_or_is_wild(words, num):
    import numpy as np
    rule = jaccard.Rule(words, num, 100)
    rng = np.random.default_rng(5)
    for n in [*range(4, 80), *range(5, 75, 2), 88, 143, 150, 383, 700]:
        base = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        most = ((100 - num) * 2 * n) // (100 + num)
        for errors in range(1, most + 1, max(1, most // 4)):
            other = base.copy()[errors // 2:] if errors > 1 else base.copy()
            other = np.concatenate((other, rng.integers(0, 1 << 62, errors - errors // 2 if errors > 1 else 1, dtype=np.uint64)))
            both = [np.unique(base), np.unique(other)]
            inter = len(np.intersect1d(*both))
            if 100 * inter < num * (len(both[0]) + len(both[1]) - inter):
                continue
            tokens, bounds = np.concatenate(both), np.cumsum([0, len(both[0]), len(both[1])])
            rows, sigs, weak, erows, codes, need = jaccard.signatures(tokens, bounds, rule)
            small = int(np.argmin(np.diff(bounds)))
            shared = np.intersect1d(sigs[rows == 0], sigs[rows == 1])
            band = int(np.searchsorted([b.low for b in jaccard.bands(rule)], max(np.diff(bounds)), side="right")) - 1
            if not weak[(rows == small) & (sigs & np.uint64(jaccard.BANDS) == band)].any():
                assert (shared & np.uint64(jaccard.BANDS) == band).sum() >= jaccard.bands(rule)[band].least
            if not len(shared):
                assert need[small] < 1
            if need[small] < 1:
                assert len(np.intersect1d(codes[erows == 0], codes[erows == 1]))


def test_rounds_over_a_small_graph_leave_few_files(spark):
    """A chain and a star in many shuffle partitions: right classes, and tables in as many files as the edges are worth."""
    from barwise.llm.common import Scratch
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(200)] + [(7, 7)]
        roots = jaccard.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
        assert len(set(roots.inputFiles())) == 1
        assert {(r["id"], r["root"]) for r in roots.collect()} == {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 301)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_unlike_sets_of_many_tokens_are_no_near_pairs(spark):
    """Sketches grow with the sets: 30 unrelated texts of 6,000 words that met by one signature make no edge."""
    import numpy as np
    rule = jaccard.Rule(5, 80, 100)
    df = spark.createDataFrame([(i, " ".join(f"u{i}x{j}" for j in range(6000))) for i in range(30)], "doc_id long, text string").repartition(4)
    everyone = np.full(jaccard.BITMAP >> 6, 0xFFFFFFFFFFFFFFFF, np.uint64)
    full = df.mapInArrow(lambda it: jaccard._sets(it, rule, 0, everyone), "sid long, n long, brief array<long>, sketch array<long>, tokens array<long>").cache()
    mixed = full.selectExpr("1L AS sig", "sid", "30L AS size", "sid AS class")
    assert jaccard.near_pairs(mixed, full, rule).count() == 0


def test_links_between_sets_with_sketches_of_different_lengths(spark):
    """2,048 tokens or fewer, and more: sketches are folded to the shorter one; so are 4,096."""
    import numpy as np
    docs = []
    for k, n in enumerate((1900, 2040, 3900, 4090)):
        base = [f"d{k}w{j}" for j in range(n + 4)]
        docs += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base + [f"more{k}x{j}" for j in range(n // 8)])), (10 * k + 2, " ".join(base[:n * 7 // 10] + [f"other{k}x{j}" for j in range(n // 3)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()} == brute(docs, 4, 85, 100)
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 62, 2000, dtype=np.uint64))
    b = np.unique(np.concatenate([a, rng.integers(0, 1 << 62, 200, dtype=np.uint64)]))
    x, y = jaccard.long_sketches([a, b])
    assert (len(x), len(y)) == (32, 64)
    assert (jaccard.fold_sketch(y, 32) == jaccard.sketch(b, np.array([0, len(b)]), 2048)[0]).all()
    gap = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<long>, b array<long>").select(jaccard._gap("a", "b")).first()[0]
    assert gap == np.bitwise_count(x.view(np.uint64) ^ jaccard.fold_sketch(y, 32).view(np.uint64)).sum() <= 200


def test_groups_of_much_the_same_members_are_one_group(spark):
    """Forty groups of a hub, each without a few members, are looked at inside once; groups that have only the hub in common stay apart."""
    alike = [(s, i, 1) for s in range(40) for i in range(500) if i == 0 or (i + s) % 50]
    apart = [(100 + s, i, 1) for s in range(3) for i in [1000, *range(1001 + 20 * s, 1021 + 20 * s)]]
    mixed = spark.createDataFrame(alike + apart, "sig long, sid long, size long").selectExpr("sig", "sid", "size", "sid AS class")
    got = jaccard.merged_groups(mixed).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["sig"], set()).add(r["sid"])
        assert r["class"] == r["sid"]
    assert sorted(map(len, groups.values())) == [21, 21, 21, 500] and all(r["size"] == len(groups[r["sig"]]) for r in got)
    assert {frozenset(g) for g in groups.values()} == {frozenset(range(500)), *(frozenset([1000, *range(1001 + 20 * s, 1021 + 20 * s)]) for s in range(3))}


def test_only_the_sets_of_near_pairs_have_their_tokens_moved(spark):
    full = spark.createDataFrame([(i * 7919, [i, i + 1]) for i in range(1000)], "sid long, tokens array<long>")
    wanted = spark.createDataFrame([(7919,), (3 * 7919,)], "sid long")
    assert sorted((r["sid"], r["tokens"]) for r in jaccard._only(full, wanted).collect()) == [(7919, [1, 2]), (3 * 7919, [3, 4])]


def test_classes_of_a_small_graph_take_few_jobs(spark):
    """The driver keeps track of every job: rounds over a path of 5,000 ids took dozens."""
    from barwise.llm.common import Scratch
    edges = spark.range(5000).selectExpr("(id * 7919) % 5003 AS a", "((id + 1) * 7919) % 5003 AS b").union(spark.range(3).selectExpr("9000L AS a", "9001 + id AS b")).repartition(6)
    want = {((i * 7919) % 5003, 0) for i in range(5001)} | {(i, 9000) for i in (9000, 9001, 9002, 9003)}
    spark.sparkContext.setJobGroup("classes of a path", "")
    try:
        roots = jaccard.components(edges, Scratch(spark))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("classes of a path"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = [(r["id"], r["root"]) for r in roots.collect()]
    assert set(got) == want and len(got) == len(want)
    assert 0 < jobs <= 6


@pytest.mark.parametrize("edges", [[], [(1, 1)], "many"])
def test_classes_of_a_graph_beyond_what_one_task_takes(spark, monkeypatch, edges):
    from barwise.llm.common import Scratch
    monkeypatch.setattr(jaccard, "EDGES", 16)
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] if edges == "many" else edges
    parent = {i: i for e in edges for i in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = [(r["id"], r["root"]) for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()]
    assert sorted(got) == sorted((i, find(i)) for i in parent)


def test_bitmap_comes_to_the_driver_as_numbers(spark):
    """Fifty thousand words of the bitmap: no Python object for each."""
    import tracemalloc

    import numpy as np
    sids = spark.range(50_000).selectExpr("id * 64 + id % 64 AS sid")
    tracemalloc.start()
    try:
        got = jaccard._bitmap(sids)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = np.zeros(jaccard.BITMAP >> 6, np.uint64)
    want[:50_000] = np.uint64(1) << (np.arange(50_000) % 64).astype(np.uint64)
    assert (got == want).all() and peak < 8 << 20
