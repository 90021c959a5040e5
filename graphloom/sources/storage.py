"""Tables in the folder that all executors share; lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a session on a local master may go without (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def materialize_counted(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """materialize(), and aggregates of df's rows that are made while they are written, so no second job reads the table."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(name) for name, c in figures.items()]))
    return out, seen.get


def materialize_bucketed(df: DataFrame, keys: list[str], order: str, buckets: int) -> DataFrame:
    """Write df in buckets of keys and read it as a table that knows so: joins on keys don't deal it out again.

    Rows are brought into order first, which makes files small; sortBy() would compare whole rows, after the bucket's number.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    # Dealt like the buckets, each bucket is one file.
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(order)
    dealt.write.bucketBy(buckets, *keys).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._graphloom_path, out._graphloom_table = path, name
    return out


#: Source bytes (files as they lie on disk) for each task of a shuffle that dealt() widens.
TASK_BYTES = 16 << 20


def source_bytes(df: DataFrame) -> int:
    """Size of the files that df's plan reads, each as often as it is read; 0 for sources whose size isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out by keys to more tasks than the session has by default if its sources are too large for those; else as it is."""
    parts = -(-source_bytes(df) // TASK_BYTES)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def discard(df: DataFrame | None) -> None:
    """Delete a table made by materialize() or materialize_bucketed() that nothing reads any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        spark = df.sparkSession
        if getattr(df, "_graphloom_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {df._graphloom_table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
