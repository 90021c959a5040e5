"""Breadth-first search: one table for each level, the least parent for each vertex.

Several roots advance together, keyed by (root, v). In a symmetric graph the
neighbours of a level lie in the level before, in it or in the next one, so
a top-down step drops what the last two levels hold instead of all that was
reached: the work of a level follows its frontier, not the graph. A bottom-up
step starts from the unreached vertices, a table that is made when
the direction first turns and then carried forward, shrinking; it reads the edges of
these or of the frontier, whichever has fewer. Both read the edges in their buckets.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.policy import DirectionPolicy
from ..sources.storage import discard, materialize, materialize_counted
from .graph import Graph

#: Bottom-up steps look at each root's unreached vertices; with more roots than this all steps are top-down.
MOST_ROOTS = 64


@dataclass
class Traversal:
    """rows(root, v, pred, level) of all reached vertices; a row of figures for each level."""

    rows: DataFrame
    trace: list[dict] = field(default_factory=list)
    record: dict = field(default_factory=dict)


def top_down_step(graph: Graph, frontier: DataFrame, recent: DataFrame, size: int | None = None) -> DataFrame:
    """Neighbours of the frontier (of size rows, if known) that the last levels don't hold, with their least parent."""
    found = graph.edges_of(frontier, size).groupBy("root", F.col("dst").alias("v"))
    found = found.agg(F.min("src").alias("pred"), F.max("dst_degree").alias("degree"))
    return found.join(recent.select("root", "v"), ["root", "v"], "left_anti")


def unreached_vertices(graph: Graph, levels: DataFrame, roots: list[int]) -> DataFrame:
    """root, v, degree of what each of at most MOST_ROOTS roots hasn't reached."""
    if not roots:
        return levels.select("root", "v", "degree").limit(0)
    every = graph.vertices.select(F.explode(F.array(*[F.lit(r).cast("long") for r in roots])).alias("root"), "v", "degree")
    return every.join(levels.select("root", "v"), ["root", "v"], "left_anti")


def bottom_up_step(graph: Graph, frontier: DataFrame, unreached: DataFrame, size: int | None = None, from_frontier: bool = False) -> DataFrame:
    """unreached(root, v, degree) with pred: the least neighbour in the frontier, null where there is none.

    The edges between the two are looked up from either end, as the graph is symmetric: those of the unreached, which then
    meet the frontier, or those of the frontier, which then meet the unreached. The second way deals out the least
    parents only, not all edges of what is unreached. size: rows of the end that is looked up, if known.
    """
    if from_frontier:
        hits = graph.edges_of(frontier, size).groupBy("root", F.col("dst").alias("v")).agg(F.min("src").alias("pred"))
    else:
        near = frontier.select("root", F.col("v").alias("dst"))
        ends = graph.edges_of(unreached, size).select("root", "src", "dst")
        hits = ends.join(near, ["root", "dst"]).groupBy("root", F.col("src").alias("v")).agg(F.min("dst").alias("pred"))
    return unreached.select("root", "v", "degree").join(hits, ["root", "v"], "left")


def bfs(graph: Graph, roots: list[int] | DataFrame, policy: DirectionPolicy | None = None, first_level: int = 0, max_levels: int | None = None) -> Traversal:
    """Levels and least parents of all vertices that each root reaches.

    roots: vertex ids, or a DataFrame with one column of them. A root without
    edges reaches itself only; an empty list gives no rows.
    """
    spark = graph.adj.sparkSession
    if isinstance(roots, DataFrame):
        start = roots.select(F.col(roots.columns[0]).cast("long").alias("root")).distinct()
    else:
        start = spark.createDataFrame([(int(r),) for r in dict.fromkeys(roots)], "root long")
    deg = graph.vertices.select(F.col("v").alias("root"), "degree")
    frontier = materialize(
        start.join(deg, "root", "left").select(
            "root", F.col("root").alias("v"), F.col("root").alias("pred"), F.lit(first_level).alias("level"), F.coalesce("degree", F.lit(0).cast("long")).alias("degree")
        )
    )
    few = [r["root"] for r in frontier.select("root").limit(MOST_ROOTS + 1).collect()]
    policy = policy or DirectionPolicy(graph.num_edges, graph.num_vertices, by_work=graph.degree_sum)
    figures = {"size": F.count(F.when(F.col("pred").isNotNull(), 1)), "degrees": F.coalesce(F.sum(F.when(F.col("pred").isNotNull(), F.col("degree"))), F.lit(0))}
    levels, trace, level, swept, unreached = [frontier], [], first_level, None, None
    # Rows and degrees of the frontier (None: not counted) and of what is unreached.
    size, degrees = len(few) if len(few) <= MOST_ROOTS else None, None
    left = [len(few) * graph.num_vertices, len(few) * graph.degree_sum]
    while max_levels is None or level - first_level < max_levels:
        direction, level = policy.direction(), level + 1
        if direction == "top_down" or len(few) > MOST_ROOTS:
            direction, unreached = "top_down", None
            found = top_down_step(graph, frontier, reduce(DataFrame.unionByName, levels[-2:]), size)
            frontier, seen = materialize_counted(found.select("root", "v", "pred", F.lit(level).alias("level"), "degree"), **figures)
        else:
            if unreached is None:
                unreached = unreached_vertices(graph, reduce(DataFrame.unionByName, levels), few)
            from_frontier = degrees is None or degrees < left[1]
            swept, seen = materialize_counted(bottom_up_step(graph, frontier, unreached, size if from_frontier else left[0], from_frontier), **figures)
            frontier = swept.where("pred IS NOT NULL").select("root", "v", "pred", F.lit(level).alias("level"), "degree")
            unreached = swept.where("pred IS NULL").select("root", "v", "degree")
        size, degrees = seen["size"], seen["degrees"]
        left = [left[0] - size, left[1] - degrees]
        trace.append({"level": level, "direction": direction, "size": size, "edges": degrees})
        if not size:
            discard(swept if direction == "bottom_up" else frontier)
            break
        levels.append(frontier)
        policy.advance(size, degrees)
    rows = reduce(DataFrame.unionByName, levels).select("root", "v", "pred", "level")
    return Traversal(rows, trace, policy.record)


def level_hist(rows: DataFrame) -> DataFrame:
    return rows.groupBy("root", "level").agg(F.count(F.lit(1)).alias("n"))


def frontier_edges(graph: Graph, rows: DataFrame) -> DataFrame:
    """root, level, size, edges: vertices of each level and the sum of their degrees."""
    d = rows.join(graph.vertices, "v", "left")
    return d.groupBy("root", "level").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"))


def trace_frame(t: Traversal, spark) -> DataFrame:
    rows = [(r["level"], r["direction"], int(r["size"]), int(r["edges"])) for r in t.trace]
    return spark.createDataFrame(rows, "level int, direction string, size long, edges long")
