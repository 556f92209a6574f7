"""The queries of this folder, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from smsward.llm.common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from smsward.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "group_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from smsward.llm import toxicity

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from smsward.llm.decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", "n_items", "n_words", "n_equal", "doc_start", "item_start")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from smsward.llm.substrings import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from smsward.llm.imatch import compare_with_edits

    made = compare_with_edits(table(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from smsward.llm import urls

    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    judged = urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from smsward.llm import quality

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from smsward.llm.bpe import encode_documents

    coded = encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from smsward.llm.language import identify

    return identify(table(spark, sf_dir, "pages", "page_id", "url", "html"), table(spark, sf_dir, "documents", "text", "lang"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from smsward.llm import pii

    found = pii.find_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("pii_base", 256).alias("base_sha256"), F.col("pii_spans").alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") or k == "pipeline"}


ORACLE: dict[str, str] = {
    "op4_substring_dedup": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        words AS (
            SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
        ), windows AS (
            SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s
            FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
        ), starts AS (
            SELECT r, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)
        ), covered AS (
            SELECT DISTINCT r, i + j AS i FROM starts, range(0, 35) AS t(j)
        ), placed AS (
            SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
        ), kept AS (
            SELECT p.r, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.i) AS text FROM placed p ANTI JOIN covered c ON p.r = c.r AND p.i = c.i GROUP BY p.r
        )
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM words d LEFT JOIN kept k ON d.r = k.r
    """,
    "op6_url_rules": r"""
        WITH parts AS (
            SELECT page_id, position('://' IN url) AS cut, substr(url, position('://' IN url) + 3) AS rest, url FROM pages
        ), split AS (
            SELECT page_id,
                   CASE WHEN cut > 0 THEN translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                   CASE WHEN cut > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
            FROM parts
        ), rules(rule_host, rule_path, verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), best AS (
            SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
            FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id
        )
        SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
        FROM split s LEFT JOIN best b USING (page_id)
    """,
}
