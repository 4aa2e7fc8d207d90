"""Substring removal against a dictionary of all windows; deep-shallow sorting against sorted()."""

import random
from collections import Counter

import pytest

from barwise.llm import suffix_dedup as sd


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                cover[i:i + length] = b"\x01" * length
        runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((sum(cover), runs, bytes(b for b, c in zip(r, cover) if not c)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.choice([30, 45, 60, 90])) for _ in range(6)]
    texts = [None, "", "short", "x" * 1000, "x" * 450, "ab" * 300, text(400)]
    for _ in range(120):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                at = rng.randrange(len(p))
                p = p[:at] + rng.choice("XYZ") + p[at + 1:]
            if rng.random() < 0.3:
                p = p[rng.randrange(60):]
            parts += [p, text(rng.randrange(0, 30))]
        texts.append("".join(parts))
    texts += rng.sample(texts, 10)
    texts.append(texts[6][100:900])
    return texts


@pytest.mark.parametrize("seed,group", [(1, 2000), (2, 3)])
def test_equals_brute_force(spark, seed, group):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (sum(e - s for s, e in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in sd.removed(df, group=group).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_nulls_repeats_and_clashing_columns(spark):
    long = "some words that go on " * 20
    rows = [(None, long, 1), (None, "q" * 100, 2), (7, "unique text of no copy " + "abcdefghij" * 3, 3), (7, long, 4), (7, long, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = sd.removed(df)
    assert out.columns == ["doc_id", "text", "spans", "kept"]
    got = sorted((str(r["doc_id"]), len(r["kept"])) for r in out.collect())
    assert got == [("7", 0), ("7", 0), ("7", 53), ("None", 0), ("None", 100)]
    assert sd.removed(df.limit(0)).collect() == []


def test_deep_shallow_orders_like_sorted():
    rng = random.Random(4)
    for _ in range(200):
        base = bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(0, 80)))
        strings = [base[:rng.randrange(len(base) + 1)] + bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 40))]
        order, lcp = sd.deep_shallow(strings)
        assert [strings[i] for i in order] == sorted(strings)
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            n = lcp[k]
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
