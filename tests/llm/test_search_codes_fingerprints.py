"""Fingerprints, ranked search and vector codes against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barwise.llm import fingerprints, lexical_search, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- fingerprints -------------------------------------------------------------------------

def next_text(rows, ident):
    """Text of the least larger id, of the least id after the last; brute force over rows with distinct ids."""
    larger = [r for r in rows if r[0] is not None and r[0] > ident] or [r for r in rows if r[0] is not None]
    return min(larger)[1] or ""


def bag(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return Counter(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def generalised_jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


@pytest.mark.parametrize("words", [1, 2])
def test_collision_rate_is_the_generalised_jaccard_similarity(words):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    left, right, exact = [], [], []
    for i in range(300):
        a = list(rng.choice(vocabulary, 80))
        b = a[:int(rng.integers(0, 80))] + list(rng.choice(vocabulary, int(rng.integers(1, 60))))
        left.append(" ".join(a))
        right.append(" ".join(b))
        exact.append(generalised_jaccard(bag(left[-1], words), bag(right[-1], words)))
    (a, ra), (b, rb) = fingerprints.sketches(pa.array(left), words), fingerprints.sketches(pa.array(right), words)
    found, exact = fingerprints.alike(a, ra, b, rb), np.array(exact)
    sigma = np.sqrt(exact * (1 - exact) / fingerprints.SAMPLES)
    assert abs((found - exact).mean()) < 4 * sigma.mean() / math.sqrt(len(exact)) + 1e-3
    assert np.abs(found - exact).max() < 6 * sigma.max()


def test_a_text_has_the_same_sketch_in_any_slice():
    texts = ["a b c d a", "", "x " * 5000, "a b c d a", "ä ö ü", "x " * 5000]
    whole, real = fingerprints.sketches(pa.array(texts))
    for i, t in enumerate(texts):
        own, own_real = fingerprints.sketches(pa.array([t]))
        assert (own[0] == whole[i]).all() and own_real[0] == real[i]
    assert list(real) == [True, False, True, True, True, True]
    assert fingerprints.as_text(whole, real)[1] == ""


def test_next_documents_and_edits(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BOUNDS_PER_TASK", 3)
    rng = np.random.default_rng(1)
    ids = rng.choice(10_000, 400, replace=False).tolist()
    rows = [(int(i), None if k % 50 == 0 else "" if k % 51 == 0 else " ".join(rng.choice(["ab", "É", "cd", "x"], int(rng.integers(1, 90))))) for k, i in enumerate(ids)]
    rows += [(None, "no id at all"), (None, None)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, fingerprint string, cell int").repartition(5)
    found = fingerprints.compare_with_next(docs).collect()
    assert len(found) == len(rows)
    text = {i: t or "" for i, t in rows if i is not None}
    for r in found:
        if r["doc_id"] is None:
            assert r["near_next"] is None
            continue
        own, following = text[r["doc_id"]], next_text(rows, r["doc_id"])
        k = len(own) // 4
        edited = own[:len(own) - k] + following[:k]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sketch, real = fingerprints.sketches(pa.array([own, edited, following]))
        assert [r["fingerprint"], r["edited_fingerprint"]] == fingerprints.as_text(sketch, real)[:2]
        near = fingerprints.alike(sketch[[0, 0]], real[[0, 0]], sketch[[1, 2]], real[[1, 2]])
        assert (r["near_edited"], r["near_next"]) == tuple(near)


def test_rows_of_one_id_are_dealt_over_cells(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BOUNDS_PER_TASK", 5)
    rows = [(7, f"text {i % 3}") for i in range(500)] + [(i, f"other {i}") for i in range(20, 60)] + [(3, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    cells = {r["cell"] for r in fingerprints.in_order(docs, 20).where("doc_id = 7 AND NOT ahead").select("cell").distinct().collect()}
    assert len(cells) > 10
    found = fingerprints.compare_with_next(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    for r in found:
        if r["doc_id"] == 7:
            assert r["edited_sha256"] in {hashlib.sha256(fingerprints.edit(f"text {i}", "other 20").encode()).hexdigest() for i in range(3)}
    ahead = min(({"text 0", "text 1", "text 2"}), key=lambda t: spark.sql(f"SELECT xxhash64('{t}') AS h").first()["h"])
    assert [r["edited_sha256"] for r in found if r["doc_id"] == 3] == [hashlib.sha256(fingerprints.edit("first", ahead).encode()).hexdigest()]
    assert [r["edited_sha256"] for r in found if r["doc_id"] == 59] == [hashlib.sha256(fingerprints.edit("other 59", "first").encode()).hexdigest()]


def test_fingerprints_of_few_or_no_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprints.compare_with_next(spark.createDataFrame([], schema)).collect() == []
    one = fingerprints.compare_with_next(spark.createDataFrame([(1, "abcd")], schema)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abca").hexdigest()
    alone = fingerprints.compare_with_next(spark.createDataFrame([(None, "abcd")], schema)).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abc").hexdigest() and alone["near_next"] is None
    kept = fingerprints.fingerprints(spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y")], "doc_id long, text string, fingerprint string"))
    assert kept.columns == ["doc_id", "text", "fingerprint"] and kept.select("fingerprint").distinct().count() == 1


# ---- ranked search ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=10):
    found = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    found = [(i, w) for i, w in found if w]
    n_docs, total = len(found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    out = []
    for item, text in items:
        wanted = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, w in found:
            tf, m = Counter(w), 25 + (75 * len(w) * n_docs) // total
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, c in wanted.items() if tf[t])
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def search_tables(rng, docs=300, items=12):
    vocabulary = [f"t{i}" for i in range(40)] + ["É", "ß1"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    d = [(i, text(int(rng.integers(1, 60)))) for i in range(docs)]
    d += [(docs + i, d[i][1].upper().replace("É", "É")) for i in range(60)] + [(1000, None), (1001, ""), (1002, "... !"), (1003, "t1 " * 30_000)]
    shared = text(8)
    q = [(i, shared + " " + text(6)) for i in range(items)] + [(100, None), (101, "nothing known"), (102, "t1 t1 t1 t2"), (103, "T1-t1_t1, t2")]
    return d, q


@pytest.mark.parametrize("block", [1000, 3])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "ITEMS", block)
    monkeypatch.setattr(lexical_search, "CELLS", 2000)
    d, q = search_tables(np.random.default_rng(block))
    docs = spark.createDataFrame([(*r, "x", 1) for r in d], "doc_id long, text string, item_id string, score int").repartition(6)
    items = spark.createDataFrame([(*r, 5) for r in q], "item_id long, text string, doc_id int")
    found = sorted(tuple(r) for r in lexical_search.search(docs, items).collect())
    assert found == brute_search(d, q)


def test_plan_adds_each_shared_set_once():
    rng = np.random.default_rng(0)
    for items in ([{t: 1 for t in range(1, 9)} for _ in range(5)], [{int(t): int(rng.integers(1, 3)) for t in rng.choice(30, 12, replace=False) + 1} for _ in range(20)], [{}], []):
        plan = lexical_search.mine(items)
        values = rng.integers(0, 100, (len(plan.leaves), 7))
        place = {int(t): i for i, t in enumerate(plan.leaves)}
        exact = np.array([[sum(c * values[place[t]][d] for t, c in item.items()) for d in range(7)] for item in items]).reshape(len(items), 7)
        assert (lexical_search.accumulate(plan, values) == exact).all()
        assert all(max(pair) < len(plan.leaves) + i for i, pair in enumerate(plan.pairs.tolist()))
    same = lexical_search.mine([{t: 1 for t in range(1, 9)} for _ in range(5)])
    assert len(same.pairs) == 7 and len(same.item_of) == 5  # eight terms are added up once for all five items


def test_long_items_are_mined_in_groups():
    plan = lexical_search.mine([{t: 1 for t in range(1, 3001)} for _ in range(2)])
    assert len(plan.item_of) <= 2 * -(-3000 // lexical_search.GROUP)


def test_search_without_rows_and_with_null_ids(spark):
    docs, items = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (2, "a b")], "doc_id long, text string"), spark.createDataFrame([(9, "a"), (9, "a")], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lexical_search.search(none, items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, None), (2, "-")], "doc_id long, text string"), items).collect() == []
    found = lexical_search.search(docs, items).collect()  # a row per row of the items
    assert sorted((r["item_id"], r["rank"], r["doc_id"] or 99) for r in found) == sorted([(9, 1, 2), (9, 2, 4), (9, 3, 4), (9, 4, 99)] * 2)
    assert len({r["score"] for r in found}) == 1 and found[0]["score"] > 0


# ---- vector codes -------------------------------------------------------------------------

def brute_codes(rows, parts, entries, rounds):
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], dtype=object)
    size = x.shape[1] // parts
    books = [[list(x[i][p * size:(p + 1) * size]) for i in range(min(entries, len(rows)))] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for v in x:
                own = v[p * size:(p + 1) * size]
                held[nearest(p, own)[1]].append(own)
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])]
    found = [[nearest(p, v[p * size:(p + 1) * size]) for p in range(parts)] for v in x]
    return [("".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for f in found], books


@pytest.mark.parametrize("parts, size, rounds", [(16, 4, 2), (4, 1, 3), (2, 9, 1)])
def test_codes_equal_brute_force(spark, monkeypatch, parts, size, rounds):
    monkeypatch.setattr(vector_codes, "CHUNK", 100)
    rng = np.random.default_rng(parts)
    base = [(i * 3, [float(c) for c in v]) for i, v in enumerate(rng.normal(0, 0.2, (260, parts * size)).astype(np.float32))]
    rows = base + [(1000 + i, base[i % 5][1]) for i in range(60)]  # ties
    bad = [(-5, None), (-4, [None] * (parts * size)), (-3, [float("nan")] * (parts * size)), (-2, [float("inf")] + [0.0] * (parts * size - 1)), (None, base[0][1])]
    frame = spark.createDataFrame([(i, v, None if i is None or i % 7 == 0 else i % 3, "z") for i, v in rows + bad], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    codes, books = vector_codes.compress(frame, parts, 64, rounds)
    found = vector_codes.with_label_error(codes).collect()
    kept = rows + [bad[-1]]
    exact, exact_books = brute_codes(kept, parts, 64, rounds)
    assert books.tolist() == exact_books
    assert Counter((r["id"], r["code"], r["error"]) for r in found) == Counter((i, c, e) for (i, _), (c, e) in zip(kept, exact))
    by_label = Counter()
    for r in found:
        by_label[r["label"]] += r["error"]
    assert all(r["label_error"] == by_label[r["label"]] for r in found) and None in by_label
    assert vector_codes.books_digest(books) == hashlib.sha256(",".join(str(c) for p in exact_books for e in p for c in e).encode()).hexdigest()


def test_hilbert_order_takes_single_steps():
    for d, side in ((2, 16), (3, 8)):
        grid = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
        walk = grid[np.argsort(vector_codes.hilbert_keys(grid))]
        assert np.abs(np.diff(walk, axis=0)).sum(axis=1).max() == 1


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(5)
    points, book = rng.integers(-40, 40, (30, vector_codes.BLOCK, 3)) + rng.integers(-200, 200, (30, 1, 3)), rng.integers(-200, 200, (50, 3))
    short = vector_codes.shortlists(points.min(axis=1), points.max(axis=1), book)
    dist = ((points[:, :, None, :] - book) ** 2).sum(axis=3)
    for b in range(30):
        assert set(np.flatnonzero((dist[b] == dist[b].min(axis=1)[:, None]).any(axis=0))) <= set(np.flatnonzero(short[b]))
    entry, best = vector_codes.nearest(points, short, book)
    assert (entry == dist.argmin(axis=2)).all() and (best == dist.min(axis=2)).all()
    assert short.sum() < short.size / 2


def test_codes_of_few_or_no_rows_and_wrong_shapes(spark):
    schema = "vec_id long, embedding array<double>, label string"
    codes, books = vector_codes.compress(spark.createDataFrame([(1, None, "a")], schema))
    assert vector_codes.with_label_error(codes).collect() == [] and books.size == 0
    codes, books = vector_codes.compress(spark.createDataFrame([(1, [0.0] * 16, "a"), (1, [-0.001] * 16, "a")], schema))
    assert sorted((r["id"], r["code"], r["error"]) for r in codes.collect()) == [(1, "00" * 16, 0), (1, "01" * 16, 0)] and books.shape == (16, 2, 1)
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress(spark.createDataFrame([(1, [0.0] * 16, "a"), (2, [0.0] * 32, "a")], schema))
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress(spark.createDataFrame([(1, [0.0] * 15, "a")], schema))
