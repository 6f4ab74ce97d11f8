"""Exact deduplication as a stateful stream.

A first pass reduces each text to a digest and writes a feed of (digest, id,
locator). A structured stream reads the feed and keeps one entry per digest in
a RocksDB state store on the executors' disks: the identifier that stays, the
file its content was read from and the number of copies. The state has no
watermark and never expires. A digest that meets others is only a claim; the
second pass compares the full bytes of every copy with those of the text that
stays, and texts that differ under one digest are grouped by their own bytes.

Defined results: null text counts as empty; of equal texts the largest id stays
(null is the smallest); a repeated row counts towards ``group_size`` each time
and has the same verdict each time; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh_path, materialize, narrow, tidy

STATE = "spark.sql.streaming.stateStore"
#: Files are not allocated ahead of use: with many state partitions that alone takes gigabytes. A batch commits its changes,
#: not a snapshot of every partition's state, and does not read each key once more to count the rows of the state.
SETTINGS = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{STATE}.rocksdb.allowFAllocate": "false",
    f"{STATE}.rocksdb.changelogCheckpointing.enabled": "true", f"{STATE}.rocksdb.trackTotalNumberOfRows": "false",
}
SALT_ROWS = 512
BATCHES = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha256_hex(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def _bodies(col: pa.Array) -> Iterator[bytes]:
    """UTF-8 with A-Z lower-cased only; bytes.lower() leaves everything else alone."""
    for x in col.cast(pa.large_binary()):
        yield (x.as_py() or b"").lower()


def _digests(digest: Callable[[bytes], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, own, size = [], [], []
            for body in _bodies(b["text"]):
                own.append(digest(body))
                sha.append(own[-1] if digest is sha256_hex else sha256_hex(body))
                size.append(len(body))
            yield pa.RecordBatch.from_arrays([b["id"], b["locator"], pa.array(own, pa.string()), pa.array(sha, pa.string()), pa.array(size, pa.int64())], names=["id", "locator", "digest", "sha", "size"])

    return run


def keyed_state(feed_path: str, feed: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Run the stream over the feed to its end, in about ``batches`` micro-batches; one row per digest: keep_id, locator, group_size."""
    spark = feed.sparkSession
    out, log = fresh_path(spark, "dedup-state"), fresh_path(spark, "dedup-log")
    files = max(1, -(-len(feed.inputFiles()) // batches))
    own = spark.newSession()  # the settings hold for this stream alone
    for k, v in (SETTINGS | {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",)}).items():
        own.conf.set(k, v)
    stream = (
        own.readStream.schema(feed.schema).option("maxFilesPerTrigger", files).parquet(feed_path)
        .groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    )
    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True)
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    # an entry only ever grows, so its last state is its largest
    return rows.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size")).select("digest", F.col("keeper.id").alias("keep_id"), F.col("keeper.locator").alias("locator"), "group_size")


def _differing(digest: Callable[[bytes], str]):
    """Rows sorted by digest and salt, the one that stays first: those whose bytes are not its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, None
        for b in batches:
            found: dict[str, list] = {"id": [], "digest": [], "body": []}
            for i, d, salt, stays, body in zip(b["id"].to_pylist(), b["digest"].to_pylist(), b["salt"].to_pylist(), b["stays"].to_pylist(), _bodies(b["text"]), strict=True):
                if digest(body) != d:  # another row with this id
                    continue
                if (d, salt) != at:
                    at, kept = (d, salt), body
                if body != kept and not stays:
                    found["id"].append(i)
                    found["digest"].append(d)
                    found["body"].append(body)
            yield pa.RecordBatch.from_arrays([pa.array(found["id"], b["id"].type), pa.array(found["digest"], pa.string()), pa.array(found["body"], pa.binary())], names=["id", "digest", "body"])

    return run


@tidy
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], str] = sha256_hex, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, locator (where the text that stays was read)."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    path = fresh_path(spark, "dedup-feed")
    made = own.select("id", F.input_file_name().alias("locator"), "text").mapInArrow(_digests(digest), f"id {kind}, locator string, digest string, sha string, size long")
    made.write.parquet(path)
    feed = spark.read.schema(made.schema).parquet(path)
    state = materialize(narrow(keyed_state(path, feed, batches)), "dedup-keys")
    verdict = feed.join(state.withColumnRenamed("locator", "keep_locator"), "digest")

    salts = F.greatest(F.lit(1), F.ceil(F.col("group_size") / SALT_ROWS)).cast("int")
    # repeated rows are merged before the join, so that nothing above it needs a digest's rows in one task
    member = feed.select("id", "digest").distinct().join(state.filter("group_size > 1").drop("locator"), "digest")
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    member = member.select(F.col("id").alias("member"), "digest", stays.alias("stays"), F.when(stays, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), salts).cast("int"))).alias("salts"))
    rows = own.join(member, F.col("id").eqNullSafe(F.col("member"))).select("id", "text", "digest", "stays", F.explode("salts").alias("salt"))
    differ = materialize(rows.repartition("digest", "salt").sortWithinPartitions("digest", "salt", F.desc("stays")).mapInArrow(_differing(digest), f"id {kind}, digest string, body binary"), "dedup-differ")

    result = verdict.select("id", "digest", "keep_id", "group_size", "sha", "keep_locator")
    if not differ.isEmpty():
        result = _regrouped(result, differ)
    return result.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("keep_locator").alias("locator"))


@tidy
def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows, one."""
    verdict = materialize(exact_dedup(docs, id_col, text_col), "dedup-verdict")
    stay = verdict.filter("kept").groupBy(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha")).agg(F.count(F.lit(1)).alias("n"))
    stay = materialize(narrow(stay), "dedup-stay")
    several = stay.groupBy("kept_id").agg(F.sum("n").alias("n")).filter("n > 1")
    same = docs[id_col].eqNullSafe(stay["kept_id"])
    if several.isEmpty():
        return docs.join(stay, same, "left_semi")
    # rows that share an id: told apart by their text, of which one row stays
    name = "sha"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    own = docs.withColumn(name, F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower()).cast("binary"), 256))
    rows = own.join(stay, own[id_col].eqNullSafe(stay["kept_id"]) & (own[name] == stay["kept_sha"]), "left_semi")
    return rows.dropDuplicates([id_col, name]).select(docs.columns)


def _regrouped(result: DataFrame, differ: DataFrame) -> DataFrame:
    """Rows under a shared digest whose bytes are not the kept text's: groups of their own, by SHA-256 and bytes."""
    differ = differ.withColumn("sha", F.sha2("body", 256))
    groups = differ.groupBy("digest", "sha", "body").agg(F.max("id").alias("other_id"), F.count(F.lit(1)).alias("other_size")).drop("body")
    left = groups.groupBy("digest").agg(F.sum("other_size").alias("gone"))
    # a text that differs can only be a member of the kept group if its SHA-256 is also the kept text's
    out = result.join(groups, ["digest", "sha"], "left").join(left, "digest", "left")
    return out.select("id", "digest", F.coalesce("other_id", "keep_id").alias("keep_id"), F.coalesce("other_size", F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"), "sha", "keep_locator")
