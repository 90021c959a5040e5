"""Graphs: a symmetric edge table without duplicates and loops, and the attributes of its vertices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import discard, materialize, materialize_bucketed, materialize_counted
from . import edges as E


def degree(edges: DataFrame) -> DataFrame:
    """v, degree: duplicates count, self-loops don't."""
    return E.symmetrize(edges).groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))


#: Ids of a slice in which vertices are numbered, where there are more than LEAST_SLICES of them.
SLICE_IDS, LEAST_SLICES = 1_000_000, 64


def degree_rank(edges: DataFrame, owners: int = 1) -> DataFrame:
    """v, degree, rank: by falling degree (then id) among the vertices of each owner (v mod owners).

    With few owners one window would put all their vertices in one task. Ranks
    are made in two steps instead: vertices are numbered inside slices of
    equal degree, and each slice's offset comes from the counts of
    vertices by degree and slice, which are few. Slices are ranges of ids, as many as the vertices need.
    """
    d = degree(edges).withColumn("owner", F.pmod("v", F.lit(owners)).cast("int"))
    ends = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.greatest(F.lit(LEAST_SLICES), F.expr(f"count(1) div {SLICE_IDS}")).alias("slices"))
    d = d.join(F.broadcast(ends))  # one row
    d = d.withColumn("slice", F.expr("CAST(CAST(v - lo AS DOUBLE) * slices / (hi - lo + 1) AS INT)")).drop("lo", "hi", "slices")
    counts = d.groupBy("owner", "degree", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn(
        "before",
        F.coalesce(F.sum("n").over(Window.partitionBy("owner").orderBy(F.desc("degree"), "slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("n")
    inside = F.row_number().over(Window.partitionBy("owner", "degree", "slice").orderBy("v"))
    return d.withColumn("inside", inside).join(before, ["owner", "degree", "slice"]).select("v", "degree", (F.col("before") + F.col("inside") - 1).alias("rank"))


def group_rank(edges: DataFrame, owners: int, low_bits: int) -> DataFrame:
    """v, degree, grp, rank: by falling degree inside groups of 2^low_bits local ids of each owner."""
    d = degree(edges).withColumn("owner", F.pmod("v", F.lit(owners)))
    d = d.withColumn("grp", F.shiftright(F.floor(F.col("v") / owners).cast("long"), low_bits))
    w = Window.partitionBy("owner", "grp").orderBy(F.desc("degree"), "v")
    return d.select("v", "degree", "grp", (F.row_number().over(w) - 1).cast("long").alias("rank"))


def relabel(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """v0, v1 by rank instead of id: two lookups."""
    a = ranks.select(F.col("v").alias("v0"), F.col("rank").alias("r0"))
    b = ranks.select(F.col("v").alias("v1"), F.col("rank").alias("r1"))
    return edges.join(a, "v0").join(b, "v1").select(F.col("r0").alias("v0"), F.col("r1").alias("v1"))


def low_degree_hist(edges: DataFrame, most: int = 9) -> DataFrame:
    """k, n: vertices with more than k different neighbours, for k = 0 to most."""
    deg = E.neighbours(edges).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    hist = deg.groupBy(F.least("d", F.lit(most + 1)).alias("d")).agg(F.count(F.lit(1)).alias("c"))  # most + 1 rows
    ks = hist.sparkSession.range(0, most + 1, 1, 1).select(F.col("id").cast("int").alias("k"))
    return ks.join(F.broadcast(hist), F.col("d") > F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def has_edge(vertices: DataFrame, edges: DataFrame, v: str = "v") -> DataFrame:
    """The vertices that have an edge other than a self-loop."""
    ends = E.symmetrize(edges).select(F.col("src").alias(v))
    return vertices.join(ends, v, "left_semi")


def num_vertices(edges: DataFrame) -> DataFrame:
    return E.symmetrize(edges).select("src").distinct().agg(F.count(F.lit(1)).alias("num_vertices"))


def max_used_vertex(edges: DataFrame) -> DataFrame:
    return E.drop_loops(edges).agg(F.max(F.greatest("v0", "v1")).alias("max_vertex"))


def first_neighbour(edges: DataFrame) -> DataFrame:
    """v, first_nbr, rest: the least neighbour and how many others there are."""
    return E.neighbours(edges).groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("first_nbr"), (F.count(F.lit(1)) - 1).alias("rest"))


def adjacency(edges: DataFrame) -> DataFrame:
    """v, nbrs: sorted neighbours. A row is as long as a vertex's degree; traversals use the edge table instead."""
    return E.neighbours(edges).groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def max_degree_vertex(edges: DataFrame) -> DataFrame:
    return degree(edges).orderBy(F.desc("degree"), "v").limit(1)


def skew_stats(edges: DataFrame, parts: int) -> DataFrame:
    """Totals and the greatest excess over the mean, in percent, of directed edges by part (src mod parts)."""
    by = E.neighbours(edges).groupBy(F.pmod("src", F.lit(parts)).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(
        F.sum("n").alias("total"), F.max("n").alias("most"), (F.max("n") * 100.0 * parts / F.sum("n") - 100.0).alias("excess_percent")
    )


#: A vertex with more edges has them in several buckets.
HUB = 100_000
#: Edges of a bucket, about, where the session's number of shuffle partitions makes larger ones.
BUCKET_ROWS = 4_000_000
#: Rows for each bucket, of what meets the edge table, that a task may hold by key; with more it sorts both sides.
HELD_ROWS = 2_000_000


@dataclass
class Graph:
    """adj(src, slot, dst, dst_degree) and vertices(v, degree) as tables, with their counts.

    adj is symmetric, so src stands for either end. It lies in buckets of (src, slot): a step joins it by key
    without dealing it out again. slot cuts a hub's edges into pieces of about ``hub``.
    """

    edges: DataFrame
    adj: DataFrame
    vertices: DataFrame
    num_edges: int
    num_vertices: int
    degree_sum: int = 0
    hub: int = HUB
    buckets: int = 0

    def pieces(self, rows: DataFrame, v: str = "v") -> DataFrame:
        """rows with src (their column v) and slot, once for each piece of the vertex's edges; rows have the vertex's degree."""
        last = F.greatest(F.lit(0), F.ceil(F.col("degree") / self.hub).cast("int") - 1)
        return rows.withColumns({"src": F.col(v), "slot": F.explode(F.sequence(F.lit(0), last))})

    def edges_of(self, rows: DataFrame, count: int | None = None) -> DataFrame:
        """The edges of rows(root, v, degree) by (src, slot). A task holds its rows by key, so that the edge table is read but not sorted, unless there are too many (count)."""
        near = self.pieces(rows).select("root", "src", "slot")
        return self.adj.join(near.hint("shuffle_hash") if count is not None and count <= HELD_ROWS * self.buckets else near, ["src", "slot"])


def build_graph(edges: DataFrame, parts: int | None = None, hub: int = HUB, pairs: DataFrame | None = None) -> Graph:
    """Degrees with duplicates; edges without. The edge list is read once: degrees are sums over its pairs.

    pairs: E.pairs(edges) as a table, if there is one already.
    """
    made = None
    if pairs is None:
        made = pairs = materialize(E.pairs(edges))
    degrees = E.both_ways(pairs, "n").groupBy(F.col("src").alias("v")).agg(F.sum("n").alias("degree"))
    vertices, nodes = materialize_counted(degrees, n=F.count(F.lit(1)), degrees=F.coalesce(F.sum("degree"), F.lit(0)))
    deg = vertices.select(F.col("v").alias("dst"), F.col("degree").alias("dst_degree"))
    hubs = vertices.where(F.col("degree") > hub).select(F.col("v").alias("src"), F.ceil(F.col("degree") / hub).alias("slots"))
    slot = F.pmod(F.xxhash64("dst"), F.coalesce("slots", F.lit(1).cast("long"))).cast("int").alias("slot")
    wide = E.both_ways(pairs).join(deg, "dst").join(hubs, "src", "left").select("src", slot, "dst", "dst_degree")
    n = parts or max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes["degrees"] // BUCKET_ROWS))
    adj = materialize_bucketed(wide, ["src", "slot"], "src", n)
    discard(made)
    return Graph(edges, adj, vertices, adj.count(), nodes["n"], nodes["degrees"], hub, n)
