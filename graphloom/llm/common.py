"""What the training-data operators share: shared storage, stable inputs, literals."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: a space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of rows that a Python worker gets at once in the pipeline.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on a local
    master may go without (tests): then a folder of this machine is made once.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(df: DataFrame, text_col: str = "text") -> Column:
    """The text as a string; a null text counts as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers at most about BATCH_BYTES at once; a smaller setting stays.

    Set for the session, as a stage's result is computed after the stage has returned.
    """
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return memory that Python has freed to the system; else a worker keeps the most that any of its tasks took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema); each task gives its memory back when it ends."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays (lower() would also fold other scripts)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda that named the expression would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
