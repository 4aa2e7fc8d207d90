"""The registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm import (decontaminate, fingerprints, gif, hmm, jaccard, language, lexical_search, packing, secrets, suffix_dedup, token_counts, toxicity,
                         vector_codes)
from barwise.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.n, x.i, t.item_id FROM x JOIN t ON x.n = t.n AND x.g = t.g),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op9_benchmark_decontamination", OP9_SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        decontaminate.items_digest(F.col("items")).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def _secret_sql(rules) -> str:
    parts = []
    for r, rule in enumerate(rules):
        whole = f"(?s)(.*?)(?:({rule.body})|\\z)".replace("'", "''")
        size = f"sl[i] >= {rule.least}" if rule.least else "true"
        parts.append(f"""SELECT doc_id, '{rule.kind}' AS kind, {r} AS ord, s, s + hl[i] AS e FROM (
  SELECT doc_id, hl, sl, i, CAST(list_sum(gl[1:i]) + coalesce(list_sum(hl[1:i - 1]), 0) AS BIGINT) AS s FROM (
    SELECT doc_id, gl, hl, sl, unnest(range(1, len(hl) + 1)) AS i FROM (
      SELECT doc_id, list_transform(regexp_extract_all(text, '{whole}', 1), lambda x: length(x)) AS gl,
             list_transform(regexp_extract_all(text, '{whole}', 2), lambda x: length(x)) AS hl,
             list_transform(regexp_extract_all(text, '{whole}', {2 + rule.group}), lambda x: length(x)) AS sl
      FROM documents WHERE regexp_matches(text, '{rule.body.replace("'", "''")}')))
  WHERE hl[i] > 0 AND {size})""")
    return f"""WITH x AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS every
      FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)"""


@query("op1_secret_scans", _secret_sql(secrets.RULES))
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(secrets.listed(F.filter("spans", lambda s: s["ord"] < 3)), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"))


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "piece", "size", "bin_id")


@query("op7_toxicity")
def toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.grades_of(table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", *[F.col("p_at_least")[k].alias(f"p_at_least_{k + 1}") for k in range(len(model.cuts))], "severity", toxicity.rejected().alias("toxic"))


@query("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(fold("doc_id") != 0), F.col("lang"))
    found = language.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score",
                        F.concat_ws(",", F.transform("languages", lambda x: x["lang"])).alias("lang_set"), F.size("languages").cast("long").alias("n_languages"))


@query("op10_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hmm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id") != 1)
    return found.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_token_counts")
def token_counts_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "section", "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")


@query("op3_gif_media")
def gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = gif.load(gif.store(docs, keep=["doc_id", "n_bytes"]))
    payload = F.unhex(F.concat_ws("", F.transform("frames", lambda f: F.hex(f["samples"]))))
    sums = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), gif.BINS), lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    delay = F.aggregate("frames", F.lit(0), lambda acc, f: acc + f["delay"])
    feature = F.concat_ws(";", F.size("frames").cast("string"), delay.cast("string"), F.concat_ws(",", sums.cast("array<string>")))
    read = found.select("doc_id", "n_bytes", payload.alias("payload"), "media", feature.alias("feature"))
    return read.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
                       F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
                       F.sha2("media", 256).alias("media_sha256"), "feature")


@query("op8_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = suffix_dedup.removed(docs, keep=["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
c AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM c),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, g GROUP BY term, docs),
i AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms))))) AS BIGINT) AS score
      FROM i JOIN f USING (term) JOIN w USING (term) JOIN c USING (doc_id), g GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@query("op12_ranked_lexical_search", OP12_SQL)
def ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _vector_sql(rounds: int = 2) -> str:
    gap = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, p.part, min(CAST({gap} AS BIGINT) * 64 + e) AS m FROM p JOIN b{r} AS b ON p.part = b.part GROUP BY vec_id, p.part)")
        if r < rounds:
            steps.append(f"""u{r} AS (SELECT part, e, pos, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM (
  SELECT a.part, m % 64 AS e, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS c FROM a{r} AS a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part) GROUP BY part, e, pos),
b{r + 1} AS (SELECT b.part, b.e, coalesce(n.x, b.x) AS x FROM b{r} AS b LEFT JOIN (SELECT part, e, list(c ORDER BY pos) AS x FROM u{r} GROUP BY part, e) AS n ON b.part = n.part AND b.e = n.e)""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM (SELECT vec_id, v, unnest(range(0, 16)) AS part FROM k)),
b0 AS (SELECT p.part, s.e, p.x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 64) AS s JOIN p USING (vec_id)),
{", ".join(steps)},
d AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, e, pos)) AS codebooks_sha256
      FROM (SELECT part, e, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS c FROM b{rounds})),
o AS (SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN (SELECT vec_id, label FROM k) USING (vec_id), d
"""


@query("op13_vector_code_compression", _vector_sql())
def vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    found = vector_codes.with_label_error(codes)
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))
