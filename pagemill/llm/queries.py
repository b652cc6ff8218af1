"""The queries of the training-data operators and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import cws, decontam, langid, pii, rules, simhash, spviterbi, tokenstore, toxicity, wrapper
from pagemill.llm.common import held_out, saved, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit_on(docs)).withColumn("personal", F.col("spans") != "")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~out)
    found = toxicity.score(docs, net)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), toxicity.flagged(F.col("lang"), F.col("score"), net.thresholds).alias("flagged"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_documents(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    found = langid.identify(docs, langid.fit(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.with_likeness(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    found = rules.score(docs, rules.fit(docs, table(spark, sf_dir, "labels"), ~out))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), decontam.items_digest(F.col("items")).alias("items_sha256"), "contaminated", "n_near")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return wrapper.main_text(pages, saved(wrapper.wrappers(pages)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spviterbi.encode(table(spark, sf_dir, "documents")).select("doc_id", "n_ids", "ids_crc32", "decoded")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_token_store": op3_token_store,
    "op4_language": op4_language,
    "op5_fingerprints": op5_fingerprints,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_contamination": op8_contamination,
    "op9_main_text": op9_main_text,
    "op10_sentencepiece": op10_sentencepiece,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CUT = "list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))"

ORACLE_SQL: dict[str, str] = {
    "op8_contamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, unnest({_CUT}) AS s FROM (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, n, unnest({_CUT}) AS s, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS names FROM hits GROUP BY doc_id),
tokens AS MATERIALIZED (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
counts AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
terms AS (SELECT s, unnest(string_split(s, ' ')) AS t, unnest(range(n)) AS j FROM (SELECT DISTINCT n, s FROM windows WHERE n >= {decontam.RARE_TERMS})),
ranked AS (SELECT s, t, j, row_number() OVER (PARTITION BY s ORDER BY coalesce(c, 0), j) AS r FROM terms LEFT JOIN counts USING (t)),
asked AS (SELECT s, max(t) FILTER (r = 1) AS t1, max(t) FILTER (r = 2) AS t2, max(t) FILTER (r = 3) AS t3, max(j) FILTER (r = 2) - max(j) FILTER (r = 1) AS m2, max(j) FILTER (r = 3) - max(j) FILTER (r = 1) AS m3 FROM ranked GROUP BY s),
firsts AS (SELECT doc_id, p, t2, t3, m2, m3, count(*) AS asked FROM tokens JOIN asked ON t = t1 GROUP BY ALL),
seconds AS (SELECT DISTINCT f.* FROM firsts f JOIN tokens k ON k.doc_id = f.doc_id AND k.t = f.t2 WHERE abs(k.p - f.p - f.m2) <= {decontam.SLOP}),
thirds AS (SELECT DISTINCT f.* FROM seconds f JOIN tokens k ON k.doc_id = f.doc_id AND k.t = f.t3 WHERE abs(k.p - f.p - f.m3) <= {decontam.SLOP}),
near AS (SELECT doc_id, CAST(sum(asked) AS BIGINT) AS n_near FROM thirds GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)""",
}
