"""Packing, GIF media, the hidden Markov model and the pipeline: invariants, brute force, round trips and edge cases."""

import hashlib
import math
import os
import random
import struct
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barwise.llm import gif, hmm, packing
from barwise.llm import queries as q
from barwise.llm.common import fold


def best_fit_brute(items, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(capacity - sum(x[0] for x in b) - size, i) for i, b in enumerate(bins) if sum(x[0] for x in b) + size <= capacity
                and (source < 0 or sum(x[1] == source for x in b) < per_source) and (cluster < 0 or all(x[2] != cluster for x in b))]
        if fits:
            at = min(fits)[1]
        else:
            at = len(bins)
            bins.append([])
        bins[at].append((size, source, cluster))
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_brute_force(seed):
    rng = random.Random(seed)
    items = sorted(((rng.choice([0, 3, 5, 10, 17, 40, 99, 100]), rng.randrange(-1, 3), rng.randrange(-1, 8)) for _ in range(150)), reverse=True)
    assert packing.best_fit(*zip(*items), capacity=100, per_source=2) == best_fit_brute(items, 100, 2)


def test_packing_keeps_every_word_and_rule(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 90)) + f" {i % 40}", f"s{i % 3}" if i % 7 else None, 0) for i in range(400)]
    rows += [(400, None, "s0", 0), (401, "", None, 0), (402, "long " * 777, "s1", 0), (None, "x", "s1", 0), (5, rows[5][1], "s2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id int")
    out = packing.pack(df, capacity=100, shard_rows=60).join(df.drop("bin_id").dropDuplicates(["doc_id"]), "doc_id", "left").collect()
    total = Counter()
    for r in out:
        total[r["bin_id"]] += r["size"]
    assert max(total.values()) <= 100 and sum(total.values()) == sum(len((t or "").split()) + 1 for _, t, _, _ in rows)
    own = Counter((r["bin_id"], r["source"]) for r in out if r["source"] and r["doc_id"] not in (5, None))
    assert max(own.values()) <= 2
    assert packing.pack(df.limit(0)).count() == 0


def test_gif_round_trip_and_rules():
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 5000, 16384, 40000):
        for raw in (os.urandom(n), b"ab" * (n // 2), bytes(rng.choice(b"etaoin shr") for _ in range(n))):
            frames, wrong = gif.decode(gif.encode(gif.padded(raw)))
            assert wrong is None and b"".join(f.samples for f in frames) == gif.padded(raw)
            assert all(sum(f.histogram) == 64 * frames[0].height for f in frames)
    for bits in (2, 4, 8):
        raw = bytes(rng.randrange(1 << bits) for _ in range(9000))
        assert gif.lzw_decode(gif.lzw_encode(raw, bits), bits, len(raw)) == raw


def hand_made(frames, size=(4, 2)):
    """A GIF of frames (left, top, width, height, disposal, transparent, interlaced, samples) in a palette of four greys."""
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), bytes([0, 0, 0, 80, 80, 80, 160, 160, 160, 255, 255, 255])]
    for left, top, w, h, disposal, transparent, interlaced, samples in frames:
        out.append(b"\x21\xF9\x04" + struct.pack("<BHB", disposal << 2 | (transparent >= 0), 7, max(transparent, 0)) + b"\x00")
        stream = gif.lzw_encode(samples, 2)
        out.append(b"\x2C" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced) + b"\x02" + bytes([len(stream)]) + stream + b"\x00")
    return b"".join([*out, b"\x3B"])


def test_gif_disposal_transparency_interlace_and_breaks():
    full, dot = bytes([1] * 8), bytes([3])
    nothing = gif.BINS - 1
    grey, white = 16 + 4 + 1, 63
    for disposal, after in ((1, {grey: 7, white: 1}), (2, {grey: 7, nothing: 1}), (3, {grey: 8})):
        frames, wrong = gif.decode(hand_made([(0, 0, 4, 2, 1, -1, 0, full), (1, 1, 1, 1, disposal, -1, 0, dot), (0, 0, 1, 1, 0, 2, 0, bytes([2]))]))
        assert wrong is None and [f.delay for f in frames] == [7, 7, 7]
        assert {i: n for i, n in enumerate(frames[1].histogram) if n} == {grey: 7, white: 1}
        assert {i: n for i, n in enumerate(frames[2].histogram) if n} == after
    rows = bytes(x for r in range(9) for x in [r % 4] * 2)
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    frames, _ = gif.decode(hand_made([(0, 0, 2, 9, 0, -1, 1, b"".join(rows[2 * r:2 * r + 2] for r in order))], (2, 9)))
    assert frames[0].samples == rows
    whole = hand_made([(0, 0, 4, 2, 1, -1, 0, full)] * 3)
    assert gif.decode(b"no image")[1] and gif.decode(b"")[1]
    for cut in range(13, len(whole) - 1):
        frames, wrong = gif.decode(whole[:cut])
        assert wrong and len(frames) <= 3


def test_gif_query_digests(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "é" * 40), (4, "x" * 200000), (4, "x" * 200000), (None, "a\x00b")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in q.QUERIES["op3_gif_media"](spark, str(tmp_path)).collect():
        raw = {1: "", 2: "", 3: "é" * 40, 4: "x" * 200000, None: "a\x00b"}[r["doc_id"]].encode()
        payload = gif.padded(raw)
        media = gif.encode(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    odd = spark.createDataFrame([(None, 1), (bytearray(b"GIF"), 2)], "media binary, frames int")
    got = gif.load(odd).collect()
    assert got[0]["frames"] is None and got[1]["frames"] == [] and got[1]["error"]


def test_forward_and_counts_equal_enumeration():
    rng = np.random.default_rng(0)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    docs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 3, 5, 1)]
    starts, moves, emits, total = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
    loglik = hmm.Batch(docs).forward(m, False)[0]
    for d, got in zip(docs, loglik):
        paths = list(product(range(3), repeat=len(d)))
        p = np.array([m.start[s[0]] * np.prod([m.move[a, b] for a, b in zip(s, s[1:])]) * np.prod([m.emit[o, a] for o, a in zip(d, s)]) for s in paths])
        assert got == pytest.approx(math.log(p.sum()))
        total += math.log(p.sum())
        for s, w in zip(paths, p / p.sum()):
            starts[s[0]] += w
            for a, b in zip(s, s[1:]):
                moves[a, b] += w
            for o, a in zip(d, s):
                emits[o, a] += w
    got = hmm.Batch(docs).expected(m)
    for a, b in zip(got, (starts, moves, emits, total)):
        assert np.allclose(a, b)


def test_scores_are_probabilities_and_base_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Aa", "bb", "cc", "dd", f"r{rng.randrange(50)}"]) for _ in range(rng.randrange(0, 40)))) for i in range(200)]
    rows += [(300, None), (301, ""), (None, "aa bb"), (302, "zz " * 30000), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    out = hmm.score(df, fold("doc_id") != 1, states=3, vocabulary=4, passes=2, start_rows=20).collect()
    assert len(out) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t in rows:
        if i is not None and not held(i):
            counts.update((t or "").lower().split() + ["<end>"])
    total, distinct = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in out:
        tokens = (texts[r["doc_id"]] or "").lower().split() + ["<end>"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
        assert r["training"] == (r["doc_id"] is not None and not held(r["doc_id"]))
    assert hmm.score(df.limit(0), fold("doc_id") != 1).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10 ** 9, "", "en", "s", 0), (10 ** 9, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    ids, columns = None, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        now = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert now and (ids is None or now <= ids)
        assert 10 ** 9 in now and None in now
        ids, docs = now, out.persist() if name != "packing" else out
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.drop_contaminated(spark, docs.sparkSession.read.parquet(f"{sf}/documents.parquet"), sf).count() < 200 and bench.count() == 40
