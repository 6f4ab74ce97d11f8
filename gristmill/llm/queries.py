"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_fingerprint, op2_substring, op3_pack, op4_quality, op5_toxicity, op6_mix, op7_language, op8_forest, op9_exact, op10_chat

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_fingerprint.fingerprints_with_groups(documents(spark, sf_dir))


def op2_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_substring.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pack.pack_documents(documents(spark, sf_dir))


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_mix.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "part", "rate")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_language.identify(documents(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_forest.near_dedup(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_exact.exact_dedup(documents(spark, sf_dir)).drop("locator")


def op10_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_chat.parse_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_remove_repeats": op2_remove_repeats,
        "op3_pack_sequences": op3_pack_sequences,
        "op4_quality_scores": op4_quality_scores,
        "op5_toxicity_scores": op5_toxicity_scores,
        "op6_mix_sources": op6_mix_sources,
        "op7_language_id": op7_language_id,
        "op8_near_dedup": op8_near_dedup,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_chat_turns": op10_chat_turns,
    }


#: Equal to a flagged window anywhere earlier; documents' ids are distinct.
REPEATS = r"""
            WITH w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
                 k AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER f AS key, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
                 s AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY n = 20, key ORDER BY doc_id, i) > 1 AS again FROM k),
                 g AS (SELECT doc_id, i, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM s),
                 a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM g GROUP BY doc_id)
            SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""

LINKED = r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
                 v AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS m FROM w),
                 k AS (SELECT doc_id, m, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n, i FROM v WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
                 s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM k WHERE n = 5 OR (m < 5 AND i = 0)),
                 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
                 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
                 l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
                 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
                 g AS (SELECT a, min(b) AS low FROM r GROUP BY a)
            SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, coalesce(low, d.doc_id) >= d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.a = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_remove_repeats": REPEATS,
        "op8_near_dedup": LINKED,
        "op9_exact_dedup": f"""
            WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
                 g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    }
