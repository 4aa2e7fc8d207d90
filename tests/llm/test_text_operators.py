"""Secrets, decontamination, token counts, language, toxicity: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.llm import decontaminate as dc
from barwise.llm import language, secrets, token_counts, toxicity
from barwise.llm.common import fold, table

KEY = "AKIA" + "ABCDEFGH" * 2


def spans_brute(text):
    out = []
    for order, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.body, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), order, m.end(), rule.kind))
    return sorted(out)


def test_secret_spans_equal_regex(spark):
    texts = [None, "", f"é{KEY}x token = 'abc' Secret:\"s3cr3t/yes\" " + "a1" * 14, "password=abcde passwd:abcdef API_KEY = zzzzzz", "token=token: abcdefg",
             "f" * 24 + " " + "0" * 23, "x" * 100000 + f" {KEY}", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "A" * 40, "😀 apikey='longenough' 😀" + "d" * 30, "AKIA" * 30,
             "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"]
    rows = [(i if i != 3 else None, t, i) for i, t in enumerate(texts)] + [(2, "no secret here", 9), (2, f"{KEY}", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rules int")
    got = secrets.scan(df)
    assert got.columns == ["doc_id", "text", "rules", "spans"]
    for r in got.collect():
        assert [tuple(s) for s in r["spans"]] == spans_brute(r["text"])
    cut = {r["text"] for r in secrets.redact(df).collect()}
    assert "é[SECRET]x [SECRET]" not in cut and "no secret here" in cut and None in cut and "[SECRET]" in cut
    assert all(not spans_brute(t) for t in cut if t)
    assert secrets.scan(df.limit(0)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    assert secrets.trigram_query("abcd") == [[frozenset({"abc", "bcd"})]]
    alternatives = secrets.trigram_query("(?i:token|secret)=")[0]
    assert frozenset({"tok", "oke", "ken", "en="}) in alternatives and len(alternatives) == 2
    assert secrets.trigram_query("(abc)?x") == []


def test_secret_plan_is_native(spark, sf):
    plan = secrets.scan(table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "NestedLoop" not in plan


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination_equals_brute_force_both_ways(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}é" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([40, 13, 14, 5, 1, 60])] + [(6, None), (7, ""), (8, "...")]
    items.append((9, items[0][1]))
    docs = []
    for i in range(80):
        w = list(rng.choice(vocab, int(rng.integers(0, 60))))
        if i % 3 == 0:
            src = items[int(rng.integers(0, 6))][1].split()
            w[5:5] = src[:int(rng.integers(1, len(src) + 1))]
        docs.append((i, " ".join(w).upper() if i % 2 else ", ".join(w), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (None, items[0][1], "x"), (0, docs[0][1], "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, items string")
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j:j + n]), set()).add(item)
    for limit in (1000, 0):
        out = dc.scan(df, bench, broadcast_limit=limit)
        assert out.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans"]
        rows = out.collect()
        assert len(rows) == len(docs)
        for r in rows:
            w = words_of(r["text"])
            hit, found = set(), set()
            for n in {len(k) for k in windows}:
                for j in range(len(w) - n + 1):
                    if tuple(w[j:j + n]) in windows:
                        hit.update(range(j, j + n))
                        found |= windows[tuple(w[j:j + n])]
            assert (r["n_words"], r["n_hit"], sorted(r["items"])) == (len(w), len(hit), sorted(found))
    kept = dc.remove_documents(df, bench)
    assert kept.columns == df.columns
    assert {100, 101} <= {r["doc_id"] for r in kept.collect()}
    cut = dc.scan(dc.remove_spans(df, bench), bench).agg(F.max("n_hit")).first()[0]
    assert cut < 60
    assert dc.scan(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert dc.digest_of([2, 10]) == hashlib.sha256(b"10,2").hexdigest()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_add_up(spark, rule):
    texts = [(1, None, 7), (2, "", 7), (3, "one line", 7), (4, "a\n\n\nb  \n c é😀日本\n", 7), (4, "a\n\n\nb  \n c é😀日本\n", 7), (5, "x" * 300000 + "\n" + " " * 1000, 7)]
    df = spark.createDataFrame(texts, "doc_id long, text string, section int")
    out = token_counts.count(df, keep=["doc_id", "section"], rule=rule)
    assert out.columns == ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
    encoder, _ = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    total = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    for i, text, _ in texts:
        copies = 2 if i == 4 else 1
        assert total[i] == pytest.approx(copies * len(encoder.encode_ordinary(text or "")))
    fields = token_counts.count(df, ["text", "doc_id"], keep=[], rule=rule)
    assert fields.groupBy("section").count().count() == 2 and fields.count() == 12


def test_boundary_rules_on_one_token():
    starts, ends, bounds = np.array([0, 2, 6]), np.array([2, 6, 7]), np.array([0, 3, 6, 6, 7])
    assert token_counts.attribute(starts, ends, bounds, "most")[0].tolist() == [1, 1, 0, 1]
    assert token_counts.attribute(starts, ends, bounds, "first")[0].tolist() == [2, 0, 0, 1]
    counts, crossing = token_counts.attribute(starts, ends, bounds, "share")
    assert counts.tolist() == [1.25, 0.75, 0, 1] and crossing.tolist() == [1, 1, 0, 0]


def test_language_held_out_and_edges(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(fold("doc_id") != 0), F.col("lang"))
    own = language.predict(docs.where(fold("doc_id") == 0), model)
    assert own.where("lang = lang_pred").count() >= 0.97 * own.count()
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 --", "c"), (4, "a", "d"), (5, "and the thing " * 5000, "e")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[5]["lang_pred"] == "en" and got[4]["lang_pred"] in model[0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    half = spark.createDataFrame([(1, "the that and with of the ing on " * 40 + "und die der sich nicht eine keit " * 40)], "doc_id long, text string")
    assert len(language.predict(half, model).first()["languages"]) >= 1
    assert {r["lang_pred"] for r in language.predict(odd, language.train(docs.limit(0), F.col("lang"))).collect()} == {"und"}


def test_mixture_is_a_likelihood_maximum():
    rng = np.random.default_rng(1)
    likelihood = rng.random((50, 3)) + 0.01
    counts = rng.integers(1, 9, 50).astype(float)
    share, value = language.mixture(counts, np.array([0]), likelihood, np.full((1, 3), 1 / 3), 500)
    grid = [(a / 50, b / 50, 1 - (a + b) / 50) for a in range(51) for b in range(51 - a)]
    assert value[0] >= max((counts * np.log(likelihood @ np.array(g) + 1e-300)).sum() for g in grid) - 1e-6 and share.sum() == pytest.approx(1)


def test_toxicity_finds_marked_texts_and_edges(spark):
    rng = np.random.default_rng(2)
    clean = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(300):
        w = list(rng.choice(clean, 30))
        grade = int(rng.choice([0, 0, 1, 2]))
        if grade:
            w[3:3] = ["vilestem" + rng.choice(list("abcdef"))] * grade + ["awful"] * (grade == 2)
        rows.append((i, " ".join(w), 0))
        labels.append((i, grade))
    docs = spark.createDataFrame(rows + [(900, None, 0), (901, "", 0), (None, "vilestemz awful", 0), (902, "WORD1 " * 50000, 0)], "doc_id long, text string, severity int")
    grades = spark.createDataFrame(labels + [(None, 2), (950, 1)], "doc_id long, grade int")
    model = toxicity.fit(docs, grades)
    got = {r["doc_id"]: r["severity"] for r in toxicity.score(docs, model).collect()}
    for i, g in labels:
        assert (got[i] >= 0.5) == (g > 0)
    assert got[None] >= 0.5 and got[900] < 0.5 and got[901] < 0.5 and got[902] < 0.5
    assert np.mean([got[i] for i, g in labels if g == 2]) > np.mean([got[i] for i, g in labels if g == 1])
    flat = toxicity.fit(docs, grades.where("grade = 0"))
    assert toxicity.score(docs, flat).agg(F.max("severity")).first()[0] < 1e-9
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_ordinal_gradient_reaches_an_optimum():
    rng = np.random.default_rng(0)
    x = rng.random((400, 6)) < 0.4
    y = np.clip((x @ np.array([2, 1, 0, 0, -1, -2.0]) + rng.logistic(size=400)).round().astype(int), 0, 2)
    rows, cols = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(rows, cols, y, 6, 2, 0.1, steps=2000)

    def loss(w, cuts):
        z = x @ w
        above = np.stack([np.ones(400), *(1 / (1 + np.exp(c - z)) for c in cuts), np.zeros(400)])
        return -np.log(above[y, np.arange(400)] - above[y + 1, np.arange(400)]).sum() + 0.05 * (w ** 2).sum()
    best = loss(w, cuts)
    for k in range(6):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, cuts) >= best - 1e-3
