"""Hidden Markov language model: Baum-Welch counts summed across partitions, exact likelihood by the scaled forward recursion.

Tokens: words between white space with A-Z lower-cased, then one end mark.  The
``vocabulary`` most frequent training words, the end mark and one symbol for all
other words are what the states emit; another word adds its smoothed share
among the training words outside the vocabulary, so every token has a
probability above 0 and the probabilities of one place sum to 1.

The states start from a bounded sample (``start_rows`` short training documents,
an initialisation only); then each of ``passes`` Baum-Welch passes sums the
expected counts of all training documents: tasks add up their own, Spark the
rest, and states x symbols numbers come back.  Word counts stay a table: the
vocabulary is the only part that is sent to tasks, all other words meet their
counts in a join, where none is frequent.

Defined results: a null or empty text is the end mark alone; a row without id
never trains and is not held out; repeated rows are scored each; with no
training row all counts are 0 and the emissions uniform.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.llm.common import hash_sample, rows_of, written

STATES = 8
VOCABULARY = 8192
PASSES = 3
START_ROWS = 1500
START_PASSES = 12
START_TOKENS = 3000  # longest document of the initial sample
CHUNK_TOKENS = 600_000
FLUSH = 200_000  # distinct words a task holds before it emits them
WEIGHT = 20.0  # pseudo-count of the overall distribution in each state's emissions
ENCODED = T.StructType([T.StructField("syms", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()),
                        T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("tf", T.LongType())])))])


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # bytes: only A-Z change, only 0x20 and 0x09-0x0D part


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out
    for batch in batches:
        for part in rows_of(batch, "text", 1 << 20):
            for text in part.column("text").to_pylist():
                total.update(words_of(text))
            if len(total) >= FLUSH:
                yield rows()
    yield rows()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, c) over all rows of ``docs``."""
    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Corpus:
    """Totals of the training tokens and the vocabulary with its counts."""

    tokens: int  # N
    distinct: int  # V
    ends: int
    rare_tokens: int
    rare_distinct: int
    words: dict[bytes, int]  # vocabulary word -> symbol
    counts: np.ndarray  # by symbol: vocabulary, others, end

    @property
    def other(self) -> int:
        return len(self.words)

    @property
    def end(self) -> int:
        return len(self.words) + 1


def corpus(counts: DataFrame, n_docs: int, vocabulary: int = VOCABULARY) -> Corpus:
    total = counts.agg(F.count(F.lit(1)), F.sum("c")).first()
    n_words, n_tokens = total[0], total[1] or 0
    # from the largest power of two that enough words reach, so that tasks don't each hand on a vocabulary of their own
    sizes = sorted(counts.groupBy(F.floor(F.log2("c")).alias("e")).count().collect(), reverse=True)
    reached = np.cumsum([r["count"] for r in sizes]) >= vocabulary
    least = 2 ** int(sizes[int(np.argmax(reached))]["e"]) if reached.any() else 0
    top = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(vocabulary).collect()
    in_top = sum(r["c"] for r in top)
    return Corpus(n_tokens + n_docs, n_words + (n_docs > 0), n_docs, n_tokens - in_top, n_words - len(top), {bytes(r["word"]): i for i, r in enumerate(top)},
                  np.array([*[r["c"] for r in top], n_tokens - in_top, n_docs], float))


def _encode(batches: Iterator[pa.RecordBatch], known: Corpus) -> Iterator[pa.RecordBatch]:
    logs = np.log10(known.counts + 0.5)
    for batch in batches:
        for part in rows_of(batch, "__text", 1 << 20):
            syms, n_tokens, n_known, base, rare = [], [], [], [], []
            for text in part.column("__text").to_pylist():
                words = words_of(text)
                ids = [known.words.get(w, known.other) for w in words]
                others = Counter(w for w, i in zip(words, ids) if i == known.other)
                ids.append(known.end)
                a = np.array(ids, np.uint16)
                frequent = a[a != known.other]
                syms.append(a.tobytes())
                n_tokens.append(len(a))
                n_known.append(int((known.counts[frequent] > 0).sum()))
                base.append(float(logs[frequent].sum()))
                rare.append([{"word": w, "tf": n} for w, n in others.items()])
            out = [part.column(i) for i in range(part.num_columns)]
            out += [pa.array(syms, pa.binary()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base),
                    pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(out, names=[*part.schema.names, "syms", "n_tokens", "known", "base", "rare"]).drop_columns(["__text"])


# ---- the model ------------------------------------------------------------------

@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states


class Batch:
    """Documents by falling length, tokens time by time, so that step t works on the first ``active[t]`` documents."""

    def __init__(self, docs: list[np.ndarray]):
        lengths = np.array([len(d) for d in docs])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        longest = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
        self.at = np.concatenate(([0], np.cumsum(self.active)))
        t = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.syms = np.empty(int(lengths.sum()), np.int64)
        self.syms[self.at[t] + np.repeat(np.arange(len(docs)), lengths)] = np.concatenate([docs[i] for i in self.order])

    def forward(self, m: Model, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood per document (in the given order); scaled alphas and scales if ``keep``."""
        k = len(m.start)
        n = int(self.active[0]) if len(self.active) else 0
        alphas = np.empty((len(self.syms) if keep else 0, k))
        scales = np.empty(len(self.syms))
        a = None
        for t, live in enumerate(self.active):
            lo, hi = self.at[t], self.at[t + 1]
            e = m.emit[self.syms[lo:hi]]
            a = (m.start * e) if t == 0 else (a[:live] @ m.move) * e
            c = a.sum(axis=1)
            a /= c[:, None]
            scales[lo:hi] = c
            if keep:
                alphas[lo:hi] = a
        row = np.arange(len(self.syms)) - np.repeat(self.at[:-1], self.active)
        out = np.zeros(n)
        out[self.order] = np.bincount(row, weights=np.log(scales), minlength=n)
        return out, alphas, scales

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts: start, moves, emissions (symbols x states); and the log likelihood."""
        loglik, alphas, scales = self.forward(m, True)
        k = len(m.start)
        moves = np.zeros((k, k))
        b = None
        for t in range(len(self.active) - 1, -1, -1):
            lo, hi = self.at[t], self.at[t + 1]
            live = int(self.active[t])
            nxt = int(self.active[t + 1]) if t + 1 < len(self.active) else 0
            back = np.ones((live, k))
            if nxt:
                lo2, hi2 = self.at[t + 1], self.at[t + 2]
                ahead = m.emit[self.syms[lo2:hi2]] * b / scales[lo2:hi2, None]
                moves += alphas[lo:lo + nxt].T @ ahead
                back[:nxt] = ahead @ m.move.T
            alphas[lo:hi] *= back
            b = back
        emits = np.stack([np.bincount(self.syms, weights=alphas[:, s], minlength=len(m.emit)) for s in range(k)], axis=1)
        first = alphas[:int(self.active[0])].sum(axis=0) if len(self.active) else np.zeros(k)
        return first, moves * m.move, emits, float(loglik.sum())


def updated(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, counts: np.ndarray) -> Model:
    """Next model from expected counts; emissions are drawn towards the overall distribution."""
    k = len(start)
    overall = (counts + 0.5) / (counts + 0.5).sum()
    emit = emits + WEIGHT * overall[:, None]
    return Model((start + 1.0) / (start.sum() + k), (moves + 0.5) / (moves.sum(axis=1, keepdims=True) + 0.5 * k), emit / emit.sum(axis=0))


def first_model(docs: list[np.ndarray], counts: np.ndarray, states: int = STATES, passes: int = START_PASSES) -> Model:
    """States that start apart by a fixed pseudo-random tilt, fitted to the sample."""
    rng = np.random.default_rng(7)
    overall = (counts + 0.5) / (counts + 0.5).sum()
    emit = overall[:, None] * rng.gamma(1.0, 1.0, (len(counts), states))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    m = Model(np.full(states, 1.0 / states), move, emit / emit.sum(axis=0))
    for _ in range(passes if docs else 0):
        start, moves, emits, _ = Batch(docs).expected(m)
        m = updated(start, moves, emits, counts)
    return m


def _chunks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Row numbers by rising length, about CHUNK_TOKENS tokens at a time."""
    sizes = np.asarray(batch.column("n_tokens").to_numpy(zero_copy_only=False), np.int64)
    order = np.argsort(sizes, kind="stable")
    cut = np.cumsum(sizes[order]) // CHUNK_TOKENS
    for part in np.split(order, np.flatnonzero(np.diff(cut)) + 1):
        if len(part):
            yield part


def _docs(batch: pa.RecordBatch, rows: np.ndarray) -> list[np.ndarray]:
    col = batch.column("syms")
    return [np.frombuffer(col[int(i)].as_buffer(), np.uint16) for i in rows]


def _expected_counts(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    k = len(m.start)
    start, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit), 0.0
    for batch in batches:
        for rows in _chunks(batch):
            a, b, c, d = Batch(_docs(batch, rows)).expected(m)
            start += a
            moves += b
            emits += c
            total += d
    # place: emissions first, then moves, then starts, then the log likelihood
    flat = np.concatenate((emits.ravel(), moves.ravel(), start, [total]))
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["place", "v"])


def baum_welch(encoded: DataFrame, m: Model, counts: np.ndarray) -> tuple[Model, float]:
    """One pass over all rows of ``encoded`` (syms, n_tokens): the next model and the log likelihood under this one."""
    shared = encoded.sparkSession.sparkContext.broadcast(m)
    sums = encoded.select("syms", "n_tokens").mapInArrow(lambda it: _expected_counts(it, shared.value), "place int, v double").groupBy("place").agg(F.sum("v").alias("v"))
    k, symbols = len(m.start), len(m.emit)
    flat = np.zeros(symbols * k + k * k + k + 1)
    for r in sums.collect():  # states x (symbols + states + 1) + 1 rows at most
        flat[r["place"]] = r["v"]
    emits, rest = flat[:symbols * k].reshape(symbols, k), flat[symbols * k:]
    return updated(rest[k * k:k * k + k], rest[:k * k].reshape(k, k), emits, counts), float(rest[-1])


def _forward(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for rows in _chunks(batch):
            out[rows] = Batch(_docs(batch, rows)).forward(m, False)[0]
        yield batch.drop_columns(["syms"]).append_column("loglik", pa.array(out / np.log(10)))


def score(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", states: int = STATES, vocabulary: int = VOCABULARY,
          passes: int = PASSES, start_rows: int = START_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, training, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("__text"), F.coalesce(training, F.lit(False)).alias("training"))
    train = rows.where("training")
    counts = written(word_counts(train, "__text"), "word-counts")
    known = corpus(counts, train.count(), vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    base = rows.withColumn("row_id", F.monotonically_increasing_id())  # fixed by the write
    schema = T.StructType([*base.drop("__text").schema.fields, *ENCODED.fields])
    encoded = written(base.mapInArrow(lambda it: _encode(it, shared.value), schema), "encoded")

    learned = encoded.where("training")
    sample = hash_sample(learned.where(F.col("n_tokens") <= START_TOKENS).select("doc_id", "syms"), "doc_id", start_rows).collect()
    m = first_model([np.frombuffer(bytes(r["syms"]), np.uint16) for r in sample], known.counts, states)
    for _ in range(passes):
        m, _ = baum_welch(learned, m, known.counts)

    final = docs.sparkSession.sparkContext.broadcast(m)
    slim = encoded.select("row_id", "doc_id", "training", "n_tokens", "known", "base", "syms")
    likelihood = slim.mapInArrow(lambda it: _forward(it, final.value), T.StructType([*slim.drop("syms").schema.fields, T.StructField("loglik", T.DoubleType())]))
    other = encoded.select("row_id", F.explode("rare").alias("x")).select("row_id", F.col("x.word").alias("word"), F.col("x.tf").alias("tf"))
    met = other.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    of_rare = float(known.rare_tokens + 0.5 * (known.rare_distinct + 1))
    sums = met.groupBy("row_id").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 0.5)).alias("rare_base"), F.sum("tf").alias("rare_n"),
                                     F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    whole = float(known.tokens + 0.5 * (known.distinct + 1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return likelihood.join(sums, "row_id", "left").select(
        "doc_id", "training", "n_tokens", (F.col("known") + zero("rare_known")).cast("long").alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base") - F.col("n_tokens") * F.log10(F.lit(whole))).alias("base_score"),
        (F.col("loglik") + zero("rare_base") - zero("rare_n") * F.log10(F.lit(of_rare))).alias("score"))
