"""Order statistics, traversal rates and run logs."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that the values of a group are cut into.
BINS = 1024


def order_stats(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """min, q1, median, q3, max, mean, std (sample) of value for each group; nulls are left out.

    Quartiles are means of two places in the sorted values. Equal values are counted before anything is
    sorted. Places are made in two steps, inside ranges of values and over the counts of ranges, so no
    window holds a group.
    """
    by = by or []
    d = df.select(*by, F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    ends = d.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    counts = d.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))

    def with_group(left, right, on):
        """left with the columns of right where all of on are equal, nulls too."""
        right = right.withColumnsRenamed({c: f"_{c}" for c in on})
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return left.join(right, same).drop(*[f"_{c}" for c in on])

    counts = with_group(counts, ends, by)
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))).otherwise(0).cast("int")
    counts = counts.withColumn("bin", bin_)
    bins = counts.groupBy(*by, "bin").agg(F.sum("c").alias("in_bin"))  # BINS rows of a group at most
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("bins_before", before(Window.partitionBy(*by).orderBy("bin"), "in_bin"))
    d = with_group(counts, bins, [*by, "bin"])
    d = d.withColumn("first", F.col("bins_before") + before(Window.partitionBy(*by, "bin").orderBy("x"), "c"))
    at = lambda i: F.max(F.when(F.expr(f"{i} BETWEEN first AND first + c - 1"), F.col("x")))
    mid = lambda i, j: (at(i) + at(j)) * 0.5
    return d.groupBy(*by).agg(
        F.min("lo").alias("minimum"),
        mid("(n - 1) div 4", "n div 4").alias("firstquartile"),
        mid("(n - 1) div 2", "n div 2").alias("median"),
        mid("n - 1 - (n - 1) div 4", "n - 1 - n div 4").alias("thirdquartile"),
        F.max("hi").alias("maximum"),
        F.max("mean").alias("mean"),
        F.max("std").alias("std"),
    )


def teps_stats(runs: DataFrame, time: str = "bfs_time", edges: str = "edge_count") -> DataFrame:
    """Rates (edges a second): order statistics of seconds per edge, inverted; harmonic mean and its standard deviation."""
    s = order_stats(runs.withColumn("spe", F.col(time) / F.col(edges)), "spe")
    n = runs.agg(F.count(F.lit(1)).alias("n"))  # one row
    return s.join(F.broadcast(n)).select(
        (1 / F.col("maximum")).alias("min_teps"),
        (1 / F.col("thirdquartile")).alias("firstquartile_teps"),
        (1 / F.col("median")).alias("median_teps"),
        (1 / F.col("firstquartile")).alias("thirdquartile_teps"),
        (1 / F.col("minimum")).alias("max_teps"),
        (1 / F.col("mean")).alias("harmonic_mean_teps"),
        (F.col("std") / (F.col("mean") * F.col("mean") * F.sqrt(F.col("n") - 1))).alias("harmonic_std_teps"),
    )


def harmonic_mean(df: DataFrame, value: str) -> DataFrame:
    return df.agg((F.count(F.lit(1)) / F.sum(1 / F.col(value))).alias("harmonic_mean"))


# The lines of a text log.
TIME = r"Time for BFS (\d+) is ([\d.]+)(?: \(([\d.e+-]+)\))?"
VALIDATE = r"Validate time for BFS (\d+) is ([\d.]+)"
COUNT = r"Number of traversed edges is (\d+)$"


def parse_log(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """idx, bfs_time, validate_time, edge_count from lines(line_no, line), by log if `by` names one.

    A time is taken from its long form in brackets if there is one. A triple
    whose lines don't follow each other or don't agree has null figures. Lines meet by their numbers.
    """
    by = by or []
    get = lambda c, p, k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    kind = lambda p, step, name: lines.where(F.col("line").rlike(p)).select(*by, (F.col("line_no") - step).alias("line_no"), F.col("line").alias(name))
    d = lines.where(F.col("line").rlike(TIME) & ~F.col("line").rlike("Validate")).select(*by, "line_no", "line")
    d = d.join(kind(VALIDATE, 1, "second"), [*by, "line_no"], "left").join(kind(COUNT, 2, "third"), [*by, "line_no"], "left")
    idx = get("line", TIME, 1).cast("int")
    agrees = get("second", VALIDATE, 1).cast("int") == idx
    return d.select(
        *by,
        idx.alias("idx"),
        F.coalesce(get("line", TIME, 3), get("line", TIME, 2)).cast("double").alias("bfs_time"),
        F.when(agrees, get("second", VALIDATE, 2).cast("double")).alias("validate_time"),
        F.when(agrees, get("third", COUNT, 1).cast("long")).alias("edge_count"),
    )


def check_log(runs: DataFrame) -> dict:
    """Whether the keys of parsed runs are 0 to n - 1 without repeats (else the run is partial), and how many repeat."""
    n, ids, low, high = runs.agg(F.count(F.lit(1)), F.count_distinct("idx"), F.min("idx"), F.max("idx")).first()
    return {"runs": n, "repeated": n - ids, "partial": bool(n) and (low != 0 or high + 1 != ids)}


def complete_log(runs: DataFrame) -> DataFrame:
    """The parsed runs, if no key repeats; logs of parts of a run may be put together, but not twice."""
    if check_log(runs)["repeated"]:
        raise ValueError("the log has a key twice")
    return runs


LOG_SCHEMA = "scale int, edge_factor int, parts int, idx int, root long, bfs_time double, validate_time double, edge_count long"


def append_run(spark, path: str, scale: int, edge_factor: int, parts: int, idx: int, root: int, bfs_time: float, validate_time: float, edge_count: int) -> None:
    """Add a finished run to the log, a folder with a file for each run."""
    row = (scale, edge_factor, parts, idx, root, float(bfs_time), float(validate_time), int(edge_count))
    spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").json(path)


def finished_runs(spark, path: str, scale: int, edge_factor: int) -> dict[int, tuple[int, float, float, int]]:
    """Finished runs by key number: root, times and edges. A log of another graph is refused; of a run that is there twice the first in order counts."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {}
    log = spark.read.schema(LOG_SCHEMA).json(path)
    if not log.where((F.col("scale") != scale) | (F.col("edge_factor") != edge_factor)).isEmpty():
        raise ValueError("the log is of another graph")
    rows = log.groupBy("idx").agg(F.min(F.struct("root", "bfs_time", "validate_time", "edge_count")).alias("r")).collect()  # a row for each key
    return {r["idx"]: tuple(r["r"]) for r in rows}


def read_binary_log(data: bytes) -> dict:
    """A log of fixed layout: four 32-bit numbers, three times, and up to 64 runs of two times and a 64-bit count. Its byte order is told by the number of runs."""
    for order in "<>":
        scale, edge_factor, parts, runs = struct.unpack_from(order + "4i", data)
        if 0 <= runs <= 64:
            break
    else:
        raise ValueError("not a log")
    generation, construction, redistribution = struct.unpack_from(order + "3d", data, 16)
    times = [struct.unpack_from(order + "2dq", data, 40 + 24 * k) for k in range(runs)]
    head = {"scale": scale, "edge_factor": edge_factor, "parts": parts}
    return head | {"generation_time": generation, "construction_time": construction, "redistribution_time": redistribution, "times": times}


# Visited edges of the plain preset (edge factor 16, seeds 2 and 3) for scales 1 to 43.
_VISITED = """
32 64 128 256 512 1024 2048 4096 8192 16383 32767 65535 131070 262144 524285
1048570 2097137 4194250 8388513 16776976 33553998 67108130 134216177 268432547 536865258 1073731075 2147462776 4294927670 8589858508 17179724952
34359466407 68718955183 137437972330 274876029861 549752273512 1099505021204 2199010857419 4398023184983 8796049485746 17592103986723 35184218756936 70368458081736 140736950689206
"""
VISITED = dict(enumerate(map(int, _VISITED.split()), 1))


def expected_edges(scale: int, edge_factor: int) -> int | None:
    """Visited edges of a run over the plain preset's graph, where they are known."""
    return VISITED.get(scale) if edge_factor == 16 else None
