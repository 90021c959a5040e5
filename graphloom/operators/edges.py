"""Transforms of edge lists: rows (v0, v1), duplicates and self-loops allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..sources.storage import dealt


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("v0 <> v1")


def symmetrize(edges: DataFrame) -> DataFrame:
    """src, dst: each edge but self-loops in both directions, duplicates kept."""
    e = drop_loops(edges)
    return e.select(F.col("v0").alias("src"), F.col("v1").alias("dst")).unionByName(
        e.select(F.col("v1").alias("src"), F.col("v0").alias("dst"))
    )


def dedup(sym: DataFrame) -> DataFrame:
    return sym.select("src", "dst").distinct()


def pairs(edges: DataFrame) -> DataFrame:
    """lo, hi, n: each two joined vertices once, lo < hi, and the number of edges between them in either direction."""
    e = drop_loops(edges).select(F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"))
    return dealt(e, "lo", "hi").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def both_ways(pairs: DataFrame, *others: str) -> DataFrame:
    """src, dst (and other columns) of each pair (lo, hi) in both directions, in one reading of the pairs."""
    turn = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return pairs.select(F.inline(F.array(turn("lo", "hi"), turn("hi", "lo"))), *others)


def neighbours(edges: DataFrame) -> DataFrame:
    """dedup(symmetrize(edges)), for which half the rows are dealt out."""
    return both_ways(pairs(edges))


def dedup_stats(edges: DataFrame) -> DataFrame:
    """before, after, percent: directed edges before and after duplicates go. One shuffle, with counts made before it."""
    return pairs(edges).agg(F.coalesce(F.sum("n") * 2, F.lit(0)).alias("before"), (F.count(F.lit(1)) * 2).alias("after")).withColumn(
        "percent", F.when(F.col("before") > 0, F.col("after") * 100.0 / F.col("before"))
    )


def id_stats(edges: DataFrame) -> DataFrame:
    """all_bits (or of all ids) and scale (bits that all ids fit in), and max_weight if edges have weights."""
    most = [F.max("weight").alias("max_weight")] if "weight" in edges.columns else []
    out = edges.agg(F.coalesce(F.expr("bit_or(v0 | v1)"), F.lit(0).cast("long")).alias("all_bits"), *most)
    return out.withColumn("scale", bits.top_bit("all_bits") + 1)


def deal_by_grid(edges: DataFrame, rows: int, cols: int) -> DataFrame:
    """Edges, with weights if they have them, dealt to a grid of parts, as a means of speed only."""
    return edges.repartition(rows * cols, bits.owner_row("v0", rows), bits.owner_col("v1", rows, cols))


def deal_by_range(edges: DataFrame, parts: int) -> DataFrame:
    """Edges in even ranges of the source, sorted inside each."""
    return edges.repartitionByRange(parts, "v0", "v1").sortWithinPartitions("v0", "v1")


def shuffled(edges: DataFrame, seed: int) -> DataFrame:
    """The same edges in an order that a seed gives."""
    return edges.orderBy(F.xxhash64(F.lit(seed), "v0", "v1"))


def decode_packed(df: DataFrame, column: str = "edge") -> DataFrame:
    """v0, v1 of packed edges (functions.bits.packed_edge)."""
    e = F.col(column)
    return df.select(bits.edge_v0(e).alias("v0"), bits.edge_v1(e).alias("v1"))
