"""Rules that every traversal must keep, against the raw edge list (loops and duplicates included)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, materialize, materialize_counted

RULES = ("v_range", "v_root_range", "v_root_parent", "v_self_parent", "v_depth", "v_boundary", "v_level_gap", "v_pred_depth", "v_tree_edge")


def edge_view(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Each raw edge with level and parent of both ends (null where unreached)."""
    a = rows.select(F.col("v").alias("v0"), F.col("level").alias("d0"), F.col("pred").alias("p0"))
    b = rows.select(F.col("v").alias("v1"), F.col("level").alias("d1"), F.col("pred").alias("p1"))
    return edges.select("v0", "v1").join(a, "v0", "left").join(b, "v1", "left")


_CROSSES = "(d0 IS NULL) <> (d1 IS NULL)"
_GAP = "d0 IS NOT NULL AND d1 IS NOT NULL AND abs(d0 - d1) > 1"


def validate(edges: DataFrame, rows: DataFrame, root: int) -> DataFrame:
    """rule, violations for RULES. rows(v, pred, level) are the reached vertices of one root."""
    rows = rows.select("v", "pred", "level")
    n = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), 1).otherwise(0)), F.lit(0)).cast("long")
    top = edges.agg(F.coalesce(F.max(F.greatest("v0", "v1")), F.lit(-1)).alias("top"))  # one row
    p = rows.select(F.col("v").alias("pv"), F.col("level").alias("plevel"))
    tree = rows.join(p, rows["pred"] == p["pv"], "left").join(F.broadcast(top))
    wrong = f"CASE WHEN v = {root} THEN level <> 0 ELSE plevel IS NULL OR level <> plevel + 1 END"
    of_rows = tree.agg(
        n("pred < -1 OR pred > top").alias("v_range"),
        F.when(F.coalesce(F.max(F.expr(f"{root} BETWEEN 0 AND top")), F.lit(False)), 0).otherwise(1).cast("long").alias("v_root_range"),
        F.when(n(f"v = {root} AND pred = {root}") > 0, 0).otherwise(1).cast("long").alias("v_root_parent"),
        n(f"pred = v AND v <> {root}").alias("v_self_parent"),
        n(wrong).alias("v_depth"),
    )
    view = edge_view(edges, rows)
    of_edges = view.agg(
        n(_CROSSES).alias("v_boundary"),
        n(_GAP).alias("v_level_gap"),
        n("v0 <> v1 AND (p1 = v0 AND (d0 IS NULL OR d1 <> d0 + 1) OR p0 = v1 AND (d1 IS NULL OR d0 <> d1 + 1))").alias("v_pred_depth"),
    )
    known = edges.select("v0", "v1").unionByName(edges.select(F.col("v1").alias("v0"), F.col("v0").alias("v1")))
    loose = rows.where(F.col("v") != root).join(known, (rows["v"] == known["v0"]) & (rows["pred"] == known["v1"]), "left_anti")
    of_trees = loose.agg(F.count(F.lit(1)).alias("v_tree_edge"))
    one = of_rows.join(of_edges).join(of_trees)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in RULES])).alias("r")).select("r.*")


def rebuilt_levels(rows: DataFrame, root: int) -> DataFrame:
    """v, rebuilt: each vertex's distance from the root along parents, null where they don't lead there.

    Pointers double in each round, so there are as many rounds as the depth has bits.
    """
    at = materialize(rows.select("v", F.when(F.col("v") == root, F.col("v")).otherwise(F.col("pred")).alias("up"), F.when(F.col("v") == root, 0).otherwise(1).alias("hops")))
    left = None
    while True:
        up = at.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        far = at.join(up, "up", "left").select("v", F.coalesce("up2", "up").alias("up"), F.when(F.col("up") == root, F.col("hops")).otherwise(F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"))
        nxt, seen = materialize_counted(far, left=F.count(F.when(F.col("up") != root, 1)))
        discard(at)
        at = nxt
        # What leads nowhere stays; a cycle never ends, but no path is longer than there are vertices.
        if not seen["left"] or seen["left"] == left:
            return at.select("v", F.when(F.col("up") == root, F.col("hops")).alias("rebuilt"))
        left = seen["left"]


def level_mismatches(rows: DataFrame, root: int) -> DataFrame:
    """mismatches: vertices whose level isn't their distance from the root along parents."""
    rows = rows.select("v", "pred", "level")
    both = rows.join(rebuilt_levels(rows, root), "v")
    return both.agg(F.count(F.when(~F.col("level").eqNullSafe(F.col("rebuilt")), 1)).alias("mismatches"))


def edge_visit_count(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Raw edges whose source is reached, without those that cross the boundary or skip a level."""
    view = edge_view(edges, rows.select("v", "pred", "level"))
    good = view.where(f"d0 IS NOT NULL AND NOT ({_CROSSES}) AND NOT ({_GAP})")
    return good.agg(F.count(F.lit(1)).alias("visited_edges"))


def samples(edges: DataFrame, rows: DataFrame, most: int = 10) -> DataFrame:
    """At most `most` edges that break a rule, for a report."""
    view = edge_view(edges, rows.select("v", "pred", "level"))
    return view.where(f"({_CROSSES}) OR ({_GAP})").orderBy("v0", "v1").limit(most)


def check(edges: DataFrame, rows: DataFrame, root: int, level: int = 2, first: bool = True) -> bool:
    """Validation level 0: none; 1: the first key only; 2: all."""
    if level == 0 or level == 1 and not first:
        return True
    return validate(edges, rows, root).where("violations > 0").isEmpty()
