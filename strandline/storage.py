"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset and all runs on one machine, as in tests, a temporary
    one; on a cluster that is an error, as executors would not see each other's files."""
    at = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all machines share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        at = _own[0]
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut of lineage that outlives
    executors, is column-pruned by later reads and is deleted by `free`, or when the session's JVM ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/strandline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


GATHERED = 65_536  # rows of a task, at least, where a table has fewer tasks than its shuffle


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df of about so many rows in a task for each core, or for each GATHERED rows if these are more; as it is where that saves
    no tasks. Steps of a loop on a small table otherwise cost as much as the partitions of a large one's shuffle."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // GATHERED))
    return df.coalesce(tasks) if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def free(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing is going to read any more: what was made from them has been stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
