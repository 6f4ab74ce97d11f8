"""Where intermediate tables go: always the folder the cluster shares.

``materialize`` cuts lineage by writing a Parquet table there and reading it
back, so a lost executor never forces more than one stage to run again. A
function marked ``tidy`` deletes, when it returns, what was written during its
call and its result does not read.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: With it Spark deletes an execution's shuffle files when it ends, and not only once the driver's heap is collected.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset: a temporary one in local mode, a folder of the warehouse on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/gristmill-work"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANED)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    conf, kind = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = kind(path)
        at.getFileSystem(conf).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete the table that ``materialize`` gave as ``df``, which nothing reads any more."""
    folders = {file.split("/")[-2] for file in df.inputFiles()}
    mine = [x for x in _written if x.rsplit("/", 1)[1] in folders]
    deleted(df.sparkSession, mine)
    _written[:] = [x for x in _written if x not in mine]


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Delete the tables that a call wrote, but for those that its result reads."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        mark = len(_written)
        out = f(*args, **kwargs)
        mine = _written[mark:]
        if isinstance(out, DataFrame) and mine:
            folders = {part for file in out.inputFiles() for part in file.split("/")[-3:]}
            used = [x for x in mine if x.rsplit("/", 1)[1] in folders]
            deleted(out.sparkSession, [x for x in mine if x not in used])
            _written[mark:] = used
        return out

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrow(df: DataFrame) -> DataFrame:
    """``df``, an aggregate whose rows are a few numbers, in an eighth of the tasks that shuffled texts get; never fewer than two a core.

    Not for joins: where Spark splits a large partition, this would put it together again.
    """
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, partitions(spark) // 8))
