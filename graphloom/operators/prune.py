"""Pruning of tree-shaped fringes: what is left is the 2-core (and one vertex of each tree component)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.policy import DirectionPolicy
from ..sources.storage import discard, materialize, materialize_counted
from . import bfs as B
from . import edges as E
from .graph import Graph, build_graph


@dataclass
class Pruned:
    """core(src, dst) and parents(v, parent, round) of the pruned vertices; pairs(lo, hi) has each edge of the core once."""

    core: DataFrame
    parents: DataFrame
    rounds: int
    pairs: DataFrame


def prune_trees(sym: DataFrame) -> Pruned:
    """Rounds that take off all vertices with one neighbour left; of two that face each other the greater goes.

    sym has each edge in both directions; each is kept once. A vertex that goes takes one edge with it, so the
    edges that are left are those that no such (vertex, parent) equals: one join of the edges a round.
    """
    pairs, gone, rounds = materialize(E.pairs(sym.where("src < dst").toDF("v0", "v1")).select("lo", "hi")), [], 0
    while True:
        ends = E.both_ways(pairs).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("parent")).where("n = 1")
        # Two that face each other have one edge, so they are one group.
        ends = ends.select(F.col("src").alias("v"), F.least("src", "parent").alias("lo"), F.greatest("src", "parent").alias("hi"))
        ends = ends.groupBy("lo", "hi").agg(F.max("v").alias("v")).withColumn("parent", F.when(F.col("v") == F.col("hi"), F.col("lo")).otherwise(F.col("hi")))
        ends, seen = materialize_counted(ends.select("v", "parent", F.lit(rounds + 1).alias("round")), n=F.count(F.lit(1)))
        if not seen["n"]:
            discard(ends)
            break
        gone.append(ends)
        rounds += 1
        off = ends.select(F.least("v", "parent").alias("lo"), F.greatest("v", "parent").alias("hi"))
        rest = materialize(pairs.join(off, ["lo", "hi"], "left_anti"))
        discard(pairs)
        pairs = rest
    spark = sym.sparkSession
    parents = reduce(DataFrame.unionByName, gone) if gone else spark.createDataFrame([], "v long, parent long, round int")
    return Pruned(E.both_ways(pairs), parents, rounds, pairs)


def reachable_parents(pruned: Pruned) -> DataFrame:
    """Parents whose tree hangs on the component of the core vertex with the most neighbours (the least id of equals)."""
    graph = core_graph(pruned)
    top = pruned.core.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1)
    if top.isEmpty():
        return pruned.parents.limit(0)
    known = B.bfs(graph, top.select("src")).rows.select("v")
    kept = pruned.parents.limit(0)
    for r in range(pruned.rounds, 0, -1):
        here = pruned.parents.where(F.col("round") == r)
        hang = materialize(here.join(known.select(F.col("v").alias("parent")).distinct(), "parent", "left_semi").select("v", "parent", "round"))
        kept, known = kept.unionByName(hang), known.unionByName(hang.select("v"))
    return kept


def core_graph(pruned: Pruned) -> Graph:
    return build_graph(pruned.pairs.toDF("v0", "v1"), pairs=pruned.pairs.withColumn("n", F.lit(1).cast("long")))


#: Rounds that one plan follows a path through.
HOPS = 32


def path_to_core(pruned: Pruned, root: int) -> list[int]:
    """Vertices from a root along parents to a vertex that wasn't pruned. A parent goes in a later round or stays, so each round adds one vertex at most."""
    path = [root]
    for first in range(1, pruned.rounds + 1, HOPS):
        at = pruned.core.sparkSession.createDataFrame([(path[-1], [])], "at long, path array<long>")  # one row
        for r in range(first, min(first + HOPS, pruned.rounds + 1)):
            hop = pruned.parents.where(F.col("round") == r).select(F.col("v").alias("at"), "parent")
            at = hop.join(F.broadcast(at), "at", "right").select(
                F.coalesce("parent", "at").alias("at"), F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("parent"))).alias("path")
            )
        path += at.first()["path"]
    return path


def contains_parent(pruned: Pruned, vertices: DataFrame, v: str = "v") -> DataFrame:
    """The vertices that were pruned; as they have edges, they may be search keys too."""
    return vertices.join(pruned.parents.select(F.col("v").alias(v)), v, "left_semi")


def pruned_bfs(pruned: Pruned, root: int, policy: DirectionPolicy | None = None) -> DataFrame:
    """v, pred, level of what root reaches: up the tree to the core, over the core, then down all trees."""
    spark = pruned.core.sparkSession
    path = path_to_core(pruned, root)
    graph = core_graph(pruned)
    policy = policy or DirectionPolicy(graph.num_edges, graph.num_vertices)
    core = B.bfs(graph, [path[-1]], policy, first_level=len(path) - 1).rows.select("v", "pred", "level")
    climb = [(v, path[max(0, k - 1)], k) for k, v in enumerate(path)]
    over = spark.createDataFrame(climb, "v long, pred long, level int")
    known = materialize(core.where(~F.col("v").isin(path)).unionByName(over))
    return rebuild_depths(pruned, known)


def rebuild_depths(pruned: Pruned, known: DataFrame) -> DataFrame:
    """known(v, pred, level) and the pruned vertices below, one round after the other: each is one deeper than its parent."""
    out = known
    for r in range(pruned.rounds, 0, -1):
        here = pruned.parents.where(F.col("round") == r).join(known.select("v"), "v", "left_anti")
        p = out.select(F.col("v").alias("parent"), F.col("level").alias("plevel"))
        down = here.join(p, "parent").select("v", F.col("parent").alias("pred"), (F.col("plevel") + 1).cast("int").alias("level"))
        out = out.unionByName(materialize(down))
    return out
