"""From raw documents to packed sequences: five stages, each on all that the one before it kept.

For all stages: columns beyond those of documents may have any names and are
kept (but for the last stage); null text is empty text; an empty table gives an
empty result; results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import op3_pack, op4_quality, op6_mix, op8_forest, op9_exact
from gristmill.llm.store import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.3).

    Every row is scored by its own text, so repeated rows stay or go together,
    and rows with a null id are scored like others. Without labels all stay.
    """
    return op4_quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z: the one with the largest doc_id (null is the smallest).

    Repeated rows are one group and leave one row; of rows that share an id,
    those with other texts stay. Empty and null texts are one group.
    """
    return op9_exact.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of at least 0.8 of five-word shingles): the smallest doc_id.

    Rows that share an id are one document and stay or go together. Texts
    without words, and rows with a null id, are linked with nothing and stay.
    """
    kept = op8_forest.near_dedup(docs, num=80, den=100).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it (whole copies), which may be never.

    Null is a source of its own. Rows that share an id get as many copies each
    as that of them with the most.
    """
    taken = op6_mix.mix(docs, partial=False).filter("copies > 0").groupBy(F.col("doc_id").alias("mixed_id")).agg(F.max("copies").alias("times"))
    rows = docs.select(F.col("doc_id").alias("own_id"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("document"))
    rows = rows.join(taken, rows["own_id"].eqNullSafe(taken["mixed_id"]))
    return rows.select("document", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens. Empty texts have their end id alone; repeated rows are packed each time."""
    return op3_pack.pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Signatures, boosted tables and token ids are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
