"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch import session
from casewatch.llm import alignment, ann, bpe, extraction, language_model, near_dedup, packing, periodic, quality, substring, token_counts, topk, toxicity
from casewatch.llm import words as W

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; null ids have none."""
    return F.crc32(doc_id.cast("string")) % 5


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(), keep={"ids_crc32": F.crc32("ids")})


def toxic_model(docs: DataFrame, labels: DataFrame):
    return toxicity.fit(docs, labels, lambda doc_id: fold(doc_id) == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxic_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_model.train(docs.where(fold(F.col("doc_id")) != 1))
    scores = language_model.score(docs, model, ["doc_id"])
    return scores.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents are inserted, recounted by the next tokenizer version, and
    repeats of a text are deleted. Each batch is sent twice; the second time changes nothing."""
    text = F.coalesce("text", F.lit(""))
    old, new = "words-1", "words-2"
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.sha2(text, 256).alias("digest"),
        token_counts.count_tokens(text, old).alias("old_n_tokens"), token_counts.count_tokens(text, new).alias("new_n_tokens"),
    )
    both = docs.select(
        "doc_id", "digest", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(old).alias("old_tokenizer"), "old_n_tokens",
        F.col("source").alias("new_source"), F.col("lang").alias("new_lang"), F.lit(new).alias("new_tokenizer"), "new_n_tokens",
    )
    one = lambda side: docs.select("doc_id", "digest", "source", "lang", F.lit(old if side == "old" else new).alias("tokenizer"), F.col(f"{side}_n_tokens").alias("n_tokens"))
    firsts = docs.groupBy("digest").agg(F.min("doc_id").alias("first_doc"))
    repeats = one("new").join(firsts, "digest").where("doc_id > first_doc")
    totals = token_counts.TokenTotals(spark, session.scratch_path(spark, "token-totals"))
    for batch, deltas in (("insert", token_counts.inserts(one("old"))), ("recount", token_counts.revisions(both)), ("delete", token_counts.deletes(repeats))):
        totals.commit(batch, deltas)
        totals.commit(batch, deltas)
    return totals.totals()


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def looped(doc_id: int | None, n: int):
    """For ids whose crc32 is divisible by 10: the words from some place on repeat the first of them over and over."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), order=looped)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = found.select("doc_id", "runs", "collapsed", periodic.strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = W.stored(quality.ledger(table(spark, sf_dir, "documents")), "ledger")
    return quality.verdicts(ledger, quality.WEB_2).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails(quality.BASE.mask).alias("base_failed"), "kept", "failed",
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(F.lit(""))
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path(PIECES), keep={"groups_sha256": digest}).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_toxicity, op3_language_model, op4_nearest_neighbours, op5_substring_dedup,
        op6_html_extraction, op7_bpe, op8_order_minhash, op9_token_counts, op10_exact_top_k,
        op11_periodic_runs, op12_quality_rules, op13_tokenizer_alignment,
    )
}

ORACLES: dict[str, str] = {
    "op11_periodic_runs": r"""
WITH split AS (
    SELECT ROW_NUMBER() OVER () AS r, doc_id, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w,
        [4294967295] || LIST_TRANSFORM(STRING_SPLIT(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ASCII(c) AS BIGINT)) AS bytes
    FROM documents
), hashed AS (  -- crc32 of the id, a byte and a bit at a time
    SELECT r, doc_id, w, LEN(w) AS n, XOR(4294967295, LIST_REDUCE(bytes, lambda h, b:
        LIST_REDUCE([XOR(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: XOR(x >> 1, 3988292384 * (x & 1))))) AS h
    FROM split
), placed AS (
    SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a,
        CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p
    FROM hashed
), texts AS (
    SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE LIST_TRANSFORM(RANGE(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w
    FROM placed
), grams AS (  -- a run has 16 equal words one period apart at least
    SELECT r, n, i, ARRAY_TO_STRING(w[i + 1 : i + 16], ' ') AS gram FROM (SELECT r, n, w, UNNEST(RANGE(n - 15)) AS i FROM texts WHERE n >= 24)
), shared AS (
    SELECT r, gram FROM grams GROUP BY r, gram HAVING COUNT(*) > 1
), apart AS (
    SELECT x.r, x.i, y.i - x.i AS q FROM (SELECT * FROM grams SEMI JOIN shared USING (r, gram)) x
    JOIN (SELECT * FROM grams SEMI JOIN shared USING (r, gram)) y ON x.r = y.r AND x.gram = y.gram AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), stretches AS (
    SELECT r, q, MIN(i) AS start, COUNT(*) + 15 + q AS length
    FROM (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY r, q ORDER BY i) AS island FROM apart) GROUP BY r, q, island
), runs AS (
    SELECT r, start, length, q AS period FROM stretches WHERE length >= GREATEST(24, 3 * q)
    QUALIFY q = MIN(q) OVER (PARTITION BY r, start, length)
), gone AS (
    SELECT DISTINCT r, UNNEST(RANGE(start + period, start + length)) AS i FROM runs
), kept AS (
    SELECT r, STRING_AGG(word, ' ' ORDER BY i) AS text
    FROM (SELECT r, UNNEST(w) AS word, UNNEST(RANGE(n)) AS i FROM texts) ANTI JOIN gone USING (r, i) GROUP BY r
), best AS (
    SELECT r, COUNT(*) OVER (PARTITION BY r) AS n_runs, start, length, period,
        STRING_AGG(start || ',' || length || ',' || period || CHR(10), '') OVER (PARTITION BY r ORDER BY start, period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lines
    FROM runs QUALIFY ROW_NUMBER() OVER (PARTITION BY r ORDER BY length / CAST(period AS DOUBLE) DESC, start, period) = 1
)
SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
    CAST(1000 * length // period AS BIGINT) AS exponent_milli, SHA256(COALESCE(lines, '')) AS runs_sha256, SHA256(COALESCE(kept.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
""",
    "op12_quality_rules": r"""
WITH split AS (
    SELECT ROW_NUMBER() OVER () AS r, doc_id, COALESCE(text, '') AS text, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w,
        LIST_FILTER(STRING_SPLIT(COALESCE(text, ''), CHR(10)), lambda l: REGEXP_MATCHES(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT r, i, ARRAY_TO_STRING(w[i + 1 : i + 8], ' ') AS passage FROM (SELECT r, w, UNNEST(RANGE(LEN(w) - 7)) AS i FROM split WHERE LEN(w) >= 8)
), again AS (
    SELECT r, passage FROM windows GROUP BY r, passage HAVING COUNT(*) > 1
), covered AS (
    SELECT r, COUNT(DISTINCT i + j) AS n FROM (SELECT r, i, UNNEST(RANGE(8)) AS j FROM windows SEMI JOIN again USING (r, passage)) GROUP BY r
), measured AS (
    SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words, CAST(LENGTH(ARRAY_TO_STRING(w, '')) AS BIGINT) AS word_chars,
        CAST(LEN(REGEXP_EXTRACT_ALL(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(LEN(lines) - LEN(LIST_DISTINCT(lines)) AS BIGINT) AS n_dup_lines,
        COALESCE(covered.n, 0) AS n_repeat_words, LEN(lines) AS n_lines, LEN(REGEXP_EXTRACT_ALL(text, '\p{L}')) AS n_letters, LEN(REGEXP_EXTRACT_ALL(text, '\p{Lu}')) AS n_capitals,
        LEN(LIST_FILTER(lines, lambda l: REGEXP_MATCHES(l, '^[ \t]*[-*•‣·]'))) AS n_bullet_lines,
        LEN(LIST_FILTER(lines, lambda l: REGEXP_MATCHES(l, '(\.\.\.|…)[ \t\r]*$'))) AS n_ellipsis_lines
    FROM split LEFT JOIN covered USING (r)
), judged AS (
    SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
        + 8 * CAST(word_chars < 3 * n_words OR word_chars > 12 * n_words AS BIGINT) + 16 * CAST(100 * n_dup_lines > 30 * n_lines AS BIGINT)
        + 32 * CAST(2 * n_letters < word_chars AS BIGINT) + 64 * CAST(2 * n_capitals > n_letters AS BIGINT)
        + 128 * CAST(10 * n_bullet_lines > 9 * n_lines AS BIGINT) + 256 * CAST(10 * n_ellipsis_lines > 3 * n_lines AS BIGINT) AS failed
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM judged
""",
    "op9_token_counts": r"""
WITH counted AS (
    SELECT source, lang, doc_id, MIN(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS first_doc,
        LEN(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) AS n
    FROM documents
)
SELECT source, lang, 'words-2' AS tokenizer, COUNT(*) AS n_docs, CAST(SUM(n) AS BIGINT) AS n_tokens
FROM counted WHERE NOT COALESCE(doc_id > first_doc, FALSE) GROUP BY source, lang
""",
    "op10_exact_top_k": r"""
WITH v AS (
    SELECT vec_id, LIST_TRANSFORM(embedding, lambda x: FLOOR(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND COALESCE(LIST_BOOL_AND(LIST_TRANSFORM(embedding, lambda x: COALESCE(ISFINITE(x), FALSE))), TRUE)
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(LIST_DOT_PRODUCT(q.w, d.w) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), ranked AS (
    SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op5_substring_dedup": r"""
WITH w AS (
    SELECT doc_id, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, i, ARRAY_TO_STRING(words[i : i + 49], ' ') AS passage
    FROM (SELECT doc_id, words, UNNEST(RANGE(1, LEN(words) - 48)) AS i FROM w WHERE LEN(words) >= 50)
), firsts AS (
    SELECT passage, MIN(doc_id) AS first_doc FROM windows GROUP BY passage HAVING MIN(doc_id) < MAX(doc_id)
), gone AS (
    SELECT DISTINCT doc_id, i + j AS i FROM (
        SELECT doc_id, i, UNNEST(RANGE(0, 50)) AS j FROM windows JOIN firsts USING (passage) WHERE doc_id > first_doc
    )
), kept AS (
    SELECT doc_id, COUNT(*) AS n, STRING_AGG(word, ' ' ORDER BY i) AS text
    FROM (SELECT doc_id, UNNEST(words) AS word, UNNEST(RANGE(1, LEN(words) + 1)) AS i FROM w) ANTI JOIN gone USING (doc_id, i)
    GROUP BY doc_id
)
SELECT doc_id, CAST(LEN(words) AS BIGINT) AS n_words, CAST(LEN(words) - COALESCE(n, 0) AS BIGINT) AS n_removed,
    SHA256(COALESCE(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
}
