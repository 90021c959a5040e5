"""Queries over graphs of the test tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import bfs as B
from ..operators import edges as E
from ..operators import graph as G
from ..operators import prune, validate
from ..operators.roots import roots_frame
from ..sources import generators, tables
from ..sources.storage import materialize
from . import stats, stream_sql
from .policy import DirectionPolicy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def edges_sql(graph: str) -> str:
    """CTEs e (raw edges), s (both directions) and g (without duplicates)."""
    return (
        f"e AS MATERIALIZED ({tables.SQL[graph]}), "
        "s AS (SELECT v0 AS src, v1 AS dst FROM e WHERE v0 <> v1 UNION ALL SELECT v1, v0 FROM e WHERE v0 <> v1), "
        "g AS MATERIALIZED (SELECT DISTINCT src, dst FROM s)"
    )


def bfs_sql(graph: str, root: str, depth: int) -> str:
    """CTEs as edges_sql, and b (v, pred, level) from one root, unrolled: depth is an upper bound for the graph."""
    out = [edges_sql(graph), f"b0 AS MATERIALIZED (SELECT r AS v, r AS pred, 0 AS level FROM ({root}))"]
    for k in range(1, depth + 1):
        seen = " AND ".join(f"dst NOT IN (SELECT v FROM b{j})" for j in range(max(0, k - 2), k))
        out.append(f"b{k} AS MATERIALIZED (SELECT dst AS v, min(src) AS pred, {k} AS level FROM g JOIN b{k - 1} ON v = src WHERE {seen} GROUP BY dst)")
    rows = " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(depth + 1))
    return ", ".join([*out, f"b AS MATERIALIZED ({rows})"])


def mix(spark, d):
    return tables.mixed(spark, d)


# Edge lists


@query(f"WITH {edges_sql('mix')} SELECT v0, v1 FROM e WHERE v0 <> v1")
def edges_no_loops(spark, d):
    return E.drop_loops(mix(spark, d))


@query(f"WITH {edges_sql('mix')} SELECT src, dst FROM s")
def symmetrize(spark, d):
    return E.symmetrize(mix(spark, d))


@query(f"WITH {edges_sql('mix')} SELECT src, dst FROM g")
def dedup_edges(spark, d):
    return E.neighbours(mix(spark, d))


@query(
    f"WITH {edges_sql('ps')}, a AS (SELECT (SELECT count(*) FROM s) AS before, (SELECT count(*) FROM g) AS after) "
    "SELECT CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, round(after * 100.0 / before, 6) AS percent FROM a"
)
def dedup_stats(spark, d):
    return E.dedup_stats(tables.part_supplier(spark, d)).withColumn("percent", F.round("percent", 6))


@query(f"WITH {edges_sql('mix')} SELECT bit_or(v0 | v1) AS all_bits, CAST(length(bin(bit_or(v0 | v1))) AS INTEGER) AS scale FROM e")
def scale_estimate(spark, d):
    return E.id_stats(mix(spark, d))


@query(
    f"WITH {edges_sql('ps')} SELECT v0, v1, CAST(v0 % 4 AS INTEGER) AS owner_row, CAST((v1 // 4) % 2 AS INTEGER) AS owner_col, "
    "CAST(v0 % 4 + (v1 // 4) % 2 * 4 AS INTEGER) AS owner, CAST(v0 % 8 AS INTEGER) AS vertex_owner, v0 // 8 AS vertex_local FROM e"
)
def grid_owner(spark, d):
    e = tables.part_supplier(spark, d)
    return e.select(
        "v0", "v1", bits.owner_row("v0", 4).alias("owner_row"), bits.owner_col("v1", 4, 2).alias("owner_col"),
        bits.edge_owner("v0", "v1", 4, 2).alias("owner"), bits.vertex_owner("v0", 4, 2).alias("vertex_owner"), bits.vertex_local("v0", 4, 2).alias("vertex_local"),
    )


@query(f"WITH {edges_sql('geo')} SELECT v0, v1 FROM e")
def decode_edge(spark, d):
    return E.decode_packed(tables.geography(spark, d).select(bits.packed_edge("v0", "v1").alias("edge")))


# Vertices


@query(f"WITH {edges_sql('ps')} SELECT src AS v, count(*) AS degree FROM s GROUP BY src")
def degree(spark, d):
    return G.degree(tables.part_supplier(spark, d))


@query(
    f"WITH {edges_sql('mix')}, d AS (SELECT src AS v, count(*) AS degree FROM s GROUP BY src) "
    "SELECT v, degree, row_number() OVER (PARTITION BY v % 4 ORDER BY degree DESC, v) - 1 AS rank FROM d"
)
def degree_rank(spark, d):
    return G.degree_rank(mix(spark, d), 4)


@query(
    f"WITH {edges_sql('mix')}, d AS (SELECT src AS v, count(*) AS degree, (src // 4) >> 6 AS grp FROM s GROUP BY src) "
    "SELECT v, degree, grp, row_number() OVER (PARTITION BY v % 4, grp ORDER BY degree DESC, v) - 1 AS rank FROM d"
)
def group_rank(spark, d):
    return G.group_rank(mix(spark, d), 4, 6)


@query(
    f"WITH {edges_sql('geo')}, d AS (SELECT src AS v, row_number() OVER (ORDER BY count(*) DESC, src) - 1 AS rank FROM s GROUP BY src) "
    "SELECT a.rank AS v0, c.rank AS v1 FROM e JOIN d a ON v0 = a.v JOIN d c ON v1 = c.v"
)
def relabel(spark, d):
    e = tables.geography(spark, d)
    return G.relabel(e, G.degree_rank(e, 1))


@query(
    f"WITH {edges_sql('mix')}, d AS (SELECT count(*) AS d FROM g GROUP BY src) "
    "SELECT CAST(k AS INTEGER) AS k, CAST((SELECT count(*) FROM d WHERE d > k) AS BIGINT) AS n FROM range(10) t(k)"
)
def low_degree_hist(spark, d):
    return G.low_degree_hist(mix(spark, d))


@query(f"WITH {edges_sql('mix')} SELECT max(greatest(v0, v1)) AS max_vertex FROM e WHERE v0 <> v1")
def max_used_vertex(spark, d):
    return G.max_used_vertex(mix(spark, d))


@query(f"WITH {edges_sql('mix')} SELECT count(DISTINCT src) AS num_vertices FROM s")
def num_vertices(spark, d):
    return G.num_vertices(mix(spark, d))


@query(f"WITH {edges_sql('co')} SELECT c_custkey + {tables.CUSTOMER} AS v FROM customer WHERE c_custkey + {tables.CUSTOMER} IN (SELECT src FROM s)")
def has_edge_semi(spark, d):
    v = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") + tables.CUSTOMER).alias("v"))
    return G.has_edge(v, tables.customer_order(spark, d))


@query(f"WITH {edges_sql('ps')} SELECT src AS v, min(dst) AS first_nbr, count(*) - 1 AS rest FROM g GROUP BY src")
def first_neighbour(spark, d):
    return G.first_neighbour(tables.part_supplier(spark, d))


@query(f"WITH {edges_sql('geo')} SELECT src AS v, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS nbrs FROM g GROUP BY src")
def adjacency(spark, d):
    return G.adjacency(tables.geography(spark, d)).select("v", F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs"))


@query(f"WITH {edges_sql('mix')} SELECT src AS v, count(*) AS degree FROM s GROUP BY src ORDER BY degree DESC, v LIMIT 1")
def max_degree_vertex(spark, d):
    return G.max_degree_vertex(mix(spark, d))


@query(
    f"WITH {edges_sql('mix')}, p AS (SELECT src % 8 AS part, count(*) AS n FROM g GROUP BY part) "
    "SELECT CAST(sum(n) AS BIGINT) AS total, max(n) AS most, round(max(n) * 100.0 * 8 / sum(n) - 100.0, 6) AS excess_percent FROM p"
)
def skew_stats(spark, d):
    return G.skew_stats(mix(spark, d), 8).withColumn("excess_percent", F.round("excess_percent", 6))


# Traversals

PART_ROOT = "SELECT min(l_partkey) AS r FROM lineitem"


def part_root(spark, d) -> int:
    return spark.read.parquet(f"{d}/lineitem.parquet").agg(F.min("l_partkey")).first()[0]


def traverse(spark, d, edges: DataFrame, roots, forced: str | None = None):
    graph = G.build_graph(edges)
    policy = DirectionPolicy(graph.num_edges, graph.num_vertices, forced=forced, by_work=graph.degree_sum)
    return graph, B.bfs(graph, roots, policy)


PS_BFS = f"WITH {bfs_sql('ps', PART_ROOT, 6)}"


@query(f"{PS_BFS} SELECT v, level FROM b")
def bfs_levels(spark, d):
    return traverse(spark, d, tables.part_supplier(spark, d), [part_root(spark, d)])[1].rows.select("v", "level")


@query(f"{PS_BFS} SELECT v, pred, level FROM b", "bfs_parents_min")
def bfs_parents_min(spark, d):
    return traverse(spark, d, tables.part_supplier(spark, d), [part_root(spark, d)])[1].rows.select("v", "pred", "level")


@query(f"{PS_BFS} SELECT level, count(*) AS n FROM b GROUP BY level")
def bfs_level_hist(spark, d):
    return B.level_hist(traverse(spark, d, tables.part_supplier(spark, d), [part_root(spark, d)])[1].rows).select("level", "n")


@query(f"WITH {bfs_sql('mix', PART_ROOT, 16)} SELECT v, pred, level FROM b")
def bfs_topdown(spark, d):
    return traverse(spark, d, mix(spark, d), [part_root(spark, d)], "top_down")[1].rows.select("v", "pred", "level")


@query(f"WITH {bfs_sql('mix', PART_ROOT, 16)} SELECT v, pred, level FROM b")
def bfs_bottomup(spark, d):
    return traverse(spark, d, mix(spark, d), [part_root(spark, d)], "bottom_up")[1].rows.select("v", "pred", "level")


_CHAIN_ROOT = f"SELECT min(o_orderkey) + {tables.ORDER} AS r FROM orders"


def chain_root(spark, d) -> int:
    return spark.read.parquet(f"{d}/orders.parquet").agg(F.min("o_orderkey")).first()[0] + tables.ORDER


@query(f"WITH {bfs_sql('chain', _CHAIN_ROOT, 45)} SELECT v, pred, level FROM b")
def bfs_chain(spark, d):
    return traverse(spark, d, tables.order_chain(spark, d), [chain_root(spark, d)])[1].rows.select("v", "pred", "level")


_ROOTS = "SELECT DISTINCT l_partkey AS r FROM lineitem ORDER BY r LIMIT 4"


def _multi_sql() -> str:
    out = [edges_sql("ps"), f"b0 AS MATERIALIZED (SELECT r AS root, r AS v, r AS pred, 0 AS level FROM ({_ROOTS}))"]
    for k in range(1, 7):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM b{j} x WHERE x.root = p.root AND x.v = dst)" for j in range(max(0, k - 2), k))
        out.append(f"b{k} AS MATERIALIZED (SELECT p.root, dst AS v, min(src) AS pred, {k} AS level FROM g JOIN b{k - 1} p ON p.v = src WHERE {seen} GROUP BY p.root, dst)")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT root, v, pred, level FROM b{k}" for k in range(7))


@query(_multi_sql())
def bfs_multi_root(spark, d):
    roots = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey").distinct().orderBy("l_partkey").limit(4)
    return traverse(spark, d, tables.part_supplier(spark, d), roots)[1].rows


@query(f"{PS_BFS} SELECT count(*) AS reached FROM b")
def bfs_reach_count(spark, d):
    return traverse(spark, d, tables.part_supplier(spark, d), [part_root(spark, d)])[1].rows.agg(F.count(F.lit(1)).alias("reached"))


@query(f"{PS_BFS}, d AS (SELECT src, count(*) AS degree FROM s GROUP BY src) SELECT level, count(*) AS size, CAST(sum(degree) AS BIGINT) AS edges FROM b JOIN d ON v = src GROUP BY level")
def frontier_edges(spark, d):
    graph, t = traverse(spark, d, tables.part_supplier(spark, d), [part_root(spark, d)])
    return B.frontier_edges(graph, t.rows).select("level", "size", "edges")


@query(
    f"{PS_BFS}, d AS (SELECT src, count(*) AS degree FROM s GROUP BY src), "
    "l AS (SELECT level, count(*) AS size, CAST(sum(degree) AS BIGINT) AS edges FROM b JOIN d ON v = src WHERE level > 0 GROUP BY level) "
    "SELECT level, size, edges FROM l UNION ALL SELECT max(level) + 1, 0, 0 FROM b"
)
def bfs_trace(spark, d):
    _, t = traverse(spark, d, tables.part_supplier(spark, d), [part_root(spark, d)], "top_down")
    return B.trace_frame(t, spark).select("level", "size", "edges")


# Packed results


def _ps_rows(spark, d):
    rows = traverse(spark, d, tables.part_supplier(spark, d), [part_root(spark, d)])[1].rows
    lost = tables.customer_order(spark, d).select(F.col("v0").alias("v"), F.lit(-1).cast("long").alias("pred"), F.lit(0xFFFF).alias("level")).distinct()
    return rows.select("v", "pred", "level").unionByName(lost)


_PACKED = f"{PS_BFS}, a AS (SELECT v, pred, level FROM b UNION ALL SELECT DISTINCT o_custkey + {tables.CUSTOMER}, -1, 65535 FROM orders)"


@query(f"{_PACKED} SELECT v, CASE WHEN pred < 0 THEN -1 ELSE (CAST(level AS BIGINT) << 48) | pred END AS packed FROM a")
def pack_pred(spark, d):
    return _ps_rows(spark, d).select("v", bits.pack_pred("level", "pred").alias("packed"))


@query(f"{_PACKED} SELECT v, pred, level AS depth FROM a")
def unpack_pred(spark, d):
    p = QUERIES["pack_pred"](spark, d)
    return p.select("v", bits.unpack_pred("packed").alias("pred"), bits.unpack_depth("packed").alias("depth"))


@query(
    "SELECT l_orderkey, l_linenumber, CAST(bit_count(l_partkey) AS INTEGER) AS ones, CAST(CASE WHEN l_partkey = 0 THEN -1 ELSE length(bin(l_partkey)) - 1 END AS INTEGER) AS top, "
    "(l_partkey + 62) // 63 * 63 AS up, (l_partkey + 62) // 63 AS blocks FROM lineitem"
)
def bit_functions(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select(
        "l_orderkey", "l_linenumber", bits.popcount("l_partkey").alias("ones"), bits.top_bit("l_partkey").alias("top"),
        bits.roundup("l_partkey", 63).alias("up"), bits.blocks("l_partkey", 63).alias("blocks"),
    )


# Validation

_BAD = {
    "level": "CASE WHEN v % 10 = 4 THEN level + 2 ELSE level END",
    "pred": "CASE WHEN v % 10 = 3 THEN v WHEN v % 10 = 5 THEN 1099511627776 ELSE pred END",
    "keep": "v % 10 <> 6",
}


def _rules_sql(rows: str) -> str:
    root = f"({PART_ROOT})"
    n = lambda cond: f"CAST(coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT)"
    return f"""{PS_BFS}, t AS MATERIALIZED ({rows}), top AS (SELECT max(greatest(v0, v1)) AS top FROM e), root AS ({PART_ROOT}),
w AS (SELECT t.*, p.level AS plevel FROM t LEFT JOIN t p ON t.pred = p.v),
x AS (SELECT v0, v1, a.level AS d0, a.pred AS p0, c.level AS d1, c.pred AS p1 FROM e LEFT JOIN t a ON v0 = a.v LEFT JOIN t c ON v1 = c.v)
SELECT 'v_range' AS rule, {n('pred < -1 OR pred > top')} AS violations FROM t, top
UNION ALL SELECT 'v_root_range', CASE WHEN r BETWEEN 0 AND top THEN 0 ELSE 1 END FROM root, top
UNION ALL SELECT 'v_root_parent', CASE WHEN (SELECT count(*) FROM t WHERE v = {root} AND pred = {root}) > 0 THEN 0 ELSE 1 END
UNION ALL SELECT 'v_self_parent', {n(f'pred = v AND v <> {root}')} FROM t
UNION ALL SELECT 'v_depth', {n(f'CASE WHEN v = {root} THEN level <> 0 ELSE plevel IS NULL OR level <> plevel + 1 END')} FROM w
UNION ALL SELECT 'v_boundary', {n('(d0 IS NULL) <> (d1 IS NULL)')} FROM x
UNION ALL SELECT 'v_level_gap', {n('abs(d0 - d1) > 1')} FROM x
UNION ALL SELECT 'v_pred_depth', {n('v0 <> v1 AND ((p1 = v0 AND (d0 IS NULL OR d1 <> d0 + 1)) OR (p0 = v1 AND (d1 IS NULL OR d0 <> d1 + 1)))')} FROM x
UNION ALL SELECT 'v_tree_edge', count(*) FROM t WHERE v <> {root} AND NOT EXISTS (SELECT 1 FROM s WHERE src = v AND dst = pred)"""


_BAD_SQL = f"SELECT v, CAST({_BAD['pred']} AS BIGINT) AS pred, {_BAD['level']} AS level FROM b WHERE {_BAD['keep']}"


def _broken(rows: DataFrame) -> DataFrame:
    return rows.where(_BAD["keep"]).select("v", F.expr(_BAD["pred"]).alias("pred"), F.expr(_BAD["level"]).alias("level"))


def _validated(spark, d, broken: bool) -> tuple[DataFrame, DataFrame, int]:
    edges, root = tables.part_supplier(spark, d), part_root(spark, d)
    rows = materialize(traverse(spark, d, edges, [root])[1].rows.select("v", "pred", "level"))
    return edges, (_broken(rows) if broken else rows), root


@query(_rules_sql("SELECT * FROM b"))
def validate_rules(spark, d):
    return validate.validate(*_validated(spark, d, False))


@query(_rules_sql(_BAD_SQL))
def validate_rules_broken(spark, d):
    return validate.validate(*_validated(spark, d, True))


def _mismatch_sql(rows: str) -> str:
    walk = f"w AS (SELECT v, 0 AS n FROM t WHERE v = ({PART_ROOT}) UNION SELECT t.v, n + 1 FROM w JOIN t ON t.pred = w.v WHERE t.v <> ({PART_ROOT}) AND n < 20)"
    return f"{PS_BFS.replace('WITH', 'WITH RECURSIVE', 1)}, t AS MATERIALIZED ({rows}), {walk} SELECT count(*) FILTER (w.n IS DISTINCT FROM t.level) AS mismatches FROM t LEFT JOIN w USING (v)"


@query(_mismatch_sql("SELECT * FROM b"))
def level_mismatches(spark, d):
    return validate.level_mismatches(*_validated(spark, d, False)[1:])


@query(_mismatch_sql(_BAD_SQL))
def level_mismatches_broken(spark, d):
    return validate.level_mismatches(*_validated(spark, d, True)[1:])


@query(f"WITH {edges_sql('ps')} SELECT v0 % 2 + (v1 // 2) % 3 * 2 AS owner, count(*) AS n, CAST(sum(v0 % 7) AS BIGINT) AS weights, max(v0 % 7) AS max_weight FROM e GROUP BY owner")
def weighted_grid(spark, d):
    e = tables.part_supplier(spark, d).withColumn("weight", F.col("v0") % 7)
    dealt = E.deal_by_grid(e, 2, 3).withColumn("owner", bits.edge_owner("v0", "v1", 2, 3).cast("long"))
    return dealt.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weights"), F.max("weight").alias("max_weight"))


_VISITS = "SELECT count(*) AS visited_edges FROM e LEFT JOIN t a ON v0 = a.v LEFT JOIN t c ON v1 = c.v WHERE a.v IS NOT NULL AND c.v IS NOT NULL AND abs(a.level - c.level) <= 1"


@query(f"{PS_BFS}, t AS (SELECT * FROM b) {_VISITS}")
def edge_visit_count(spark, d):
    return validate.edge_visit_count(*_validated(spark, d, False)[:2])


@query(f"{PS_BFS}, t AS ({_BAD_SQL}) {_VISITS}")
def edge_visit_count_broken(spark, d):
    return validate.edge_visit_count(*_validated(spark, d, True)[:2])


@query(
    f"{PS_BFS}, t AS ({_BAD_SQL}) SELECT v0, v1 FROM e LEFT JOIN t a ON v0 = a.v LEFT JOIN t c ON v1 = c.v "
    "WHERE (a.v IS NULL) <> (c.v IS NULL) OR abs(a.level - c.level) > 1 ORDER BY v0, v1 LIMIT 10"
)
def error_samples(spark, d):
    return validate.samples(*_validated(spark, d, True)[:2]).select("v0", "v1")


# Pruning, over orders hung on customers and parts joined to suppliers


def _hung(spark, d) -> DataFrame:
    return tables.part_supplier(spark, d).unionByName(tables.customer_order(spark, d)).unionByName(tables.geography(spark, d))


_HUNG = " UNION ALL ".join(f"SELECT * FROM ({tables.SQL[k]})" for k in ("ps", "co", "geo"))


def _peel_sql(rounds: int) -> str:
    """CTEs g0 .. g<rounds> (pairs left) and p1 .. p<rounds> (vertices taken off)."""
    out = [
        f"e AS MATERIALIZED ({_HUNG})",
        "g0 AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT v0 AS src, v1 AS dst FROM e WHERE v0 <> v1 UNION ALL SELECT v1, v0 FROM e WHERE v0 <> v1))",
    ]
    for k in range(1, rounds + 1):
        out.append(f"l{k} AS MATERIALIZED (SELECT src AS v, min(dst) AS parent FROM g{k - 1} GROUP BY src HAVING count(*) = 1)")
        out.append(f"p{k} AS MATERIALIZED (SELECT v, parent, {k} AS round FROM l{k} a WHERE v > parent OR NOT EXISTS (SELECT 1 FROM l{k} o WHERE o.v = a.parent AND o.parent = a.v))")
        out.append(f"g{k} AS MATERIALIZED (SELECT * FROM g{k - 1} WHERE src NOT IN (SELECT v FROM p{k}) AND dst NOT IN (SELECT v FROM p{k}))")
    return "WITH " + ", ".join(out)


@query(f"{_peel_sql(6)} SELECT src, dst FROM g6")
def two_core_edges(spark, d):
    return prune.prune_trees(E.symmetrize(_hung(spark, d))).core


@query(f"{_peel_sql(6)} " + " UNION ALL ".join(f"SELECT v, parent, round FROM p{k}" for k in range(1, 7)))
def tree_parents(spark, d):
    return prune.prune_trees(E.symmetrize(_hung(spark, d))).parents


@query(f"WITH {bfs_sql('chain', _CHAIN_ROOT, 45)} SELECT v, level FROM b")
def pruned_levels(spark, d):
    return prune.pruned_bfs(prune.prune_trees(E.symmetrize(tables.order_chain(spark, d))), chain_root(spark, d)).select("v", "level")


def _geo_root(spark, d) -> int:
    return spark.read.parquet(f"{d}/customer.parquet").agg(F.max("c_custkey")).first()[0] + tables.CUSTOMER


@query(f"WITH {bfs_sql('geo', f'SELECT max(c_custkey) + {tables.CUSTOMER} AS r FROM customer', 8)} SELECT v, level FROM b")
def depth_rebuild(spark, d):
    return prune.pruned_bfs(prune.prune_trees(E.symmetrize(tables.geography(spark, d))), _geo_root(spark, d)).select("v", "level")


_PARENTS = " UNION ALL ".join(f"SELECT v, parent, round FROM p{k}" for k in range(1, 7))


@query(
    _peel_sql(6).replace("WITH ", "WITH RECURSIVE ", 1)
    + f", pp AS MATERIALIZED ({_PARENTS}), w AS (SELECT 0 AS step, min(o_orderkey) + {tables.ORDER} AS v FROM orders UNION ALL SELECT step + 1, parent FROM w JOIN pp USING (v)) SELECT step, v FROM w"
)
def core_root_path(spark, d):
    pruned = prune.prune_trees(E.symmetrize(_hung(spark, d)))
    root = spark.read.parquet(f"{d}/orders.parquet").agg(F.min("o_orderkey")).first()[0] + tables.ORDER
    return spark.createDataFrame(list(enumerate(prune.path_to_core(pruned, root))), "step int, v long")


@query(
    _peel_sql(6).replace("WITH ", "WITH RECURSIVE ", 1)
    + f", pp AS MATERIALIZED ({_PARENTS}), top AS (SELECT src AS v FROM g6 GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), "
    "reach AS (SELECT v FROM top UNION SELECT dst FROM g6 JOIN reach ON src = v), "
    "hang AS (SELECT v, parent, round FROM pp WHERE parent IN (SELECT v FROM reach) UNION SELECT pp.v, pp.parent, pp.round FROM pp JOIN hang ON pp.parent = hang.v) "
    "SELECT v, parent, round FROM hang"
)
def reachable_parents(spark, d):
    return prune.reachable_parents(prune.prune_trees(E.symmetrize(_hung(spark, d))))


# Generators


@query(stream_sql.rmat(12))
def rmat_edges(spark, d):
    return generators.rmat_edges(spark, 12)


@query(stream_sql.rmat_tree_weighted(10))
def rmat_edges_weighted(spark, d):
    return generators.rmat_edges(spark, 10, 16, generators.TREE_WEIGHTED)


@query(stream_sql.uniform(12))
def uniform_edges(spark, d):
    return generators.uniform_edges(spark, 12)


@query(stream_sql.tree(12))
def binary_tree_edges(spark, d):
    return generators.binary_tree_edges(spark, 12)


@query(stream_sql.cycle(12))
def cycle_edges(spark, d):
    return generators.cycle_edges(spark, 12)


# The first keys of the stream in that graph.
@query("SELECT CAST(unnest(range(8)) AS INTEGER) AS idx, CAST(unnest([458, 214, 220, 966, 395, 9, 848, 777]) AS BIGINT) AS root")
def roots(spark, d):
    return roots_frame(G.build_graph(generators.rmat_edges(spark, 10)), 8)


def _rmat_bfs_sql() -> str:
    e = "e AS MATERIALIZED (SELECT a.w AS v0, c.w AS v1 FROM rm JOIN sc a ON x = a.v JOIN sc c ON y = c.v)"
    rest = bfs_sql("ps", "SELECT CAST(458 AS BIGINT) AS r", 7).split("), s AS (", 1)[1]
    return f"WITH RECURSIVE {stream_sql.rmat_ctes(10)}, {e}, s AS ({rest} SELECT level, count(*) AS n FROM b GROUP BY level"


@query(_rmat_bfs_sql())
def rmat_bfs(spark, d):
    t = B.bfs(G.build_graph(generators.rmat_edges(spark, 10)), [458])
    return B.level_hist(t.rows).select("level", "n")


# Figures of runs, from supplied times

_RUNS = "SELECT s_suppkey % 3 AS grp, 1.0 + s_suppkey % 17 / 10.0 AS bfs_time, 1000 + s_suppkey AS edge_count FROM supplier"


def _runs(spark, d) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    return s.select((k % 3).alias("grp"), (1.0 + k % 17 / 10.0).alias("bfs_time"), (1000 + k).alias("edge_count"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _order_sql(rows: str, x: str, by: str) -> str:
    at = lambda i: f"l[CAST({i} AS BIGINT) + 1]"
    return f"""SELECT {by}, round(l[1], 6) AS minimum, round(({at('(n - 1) // 4')} + {at('n // 4')}) * 0.5, 6) AS firstquartile,
  round(({at('(n - 1) // 2')} + {at('n // 2')}) * 0.5, 6) AS median, round(({at('n - 1 - (n - 1) // 4')} + {at('n - 1 - n // 4')}) * 0.5, 6) AS thirdquartile,
  round(l[n], 6) AS maximum, round(mean, 6) AS mean, round(std, 6) AS std
FROM (SELECT {by}, list(CAST({x} AS DOUBLE) ORDER BY {x}) AS l, count(*) AS n, avg(CAST({x} AS DOUBLE)) AS mean, stddev_samp(CAST({x} AS DOUBLE)) AS std FROM ({rows}) GROUP BY {by})"""


@query(_order_sql(_RUNS, "bfs_time", "grp"))
def order_stats(spark, d):
    return _rounded(stats.order_stats(_runs(spark, d), "bfs_time", ["grp"]))


@query(
    f"""WITH r AS (SELECT CAST(bfs_time AS DOUBLE) / edge_count AS spe FROM ({_RUNS})),
l AS (SELECT list(spe ORDER BY spe) AS l, count(*) AS n, avg(spe) AS m, stddev_samp(spe) AS sd FROM r)
SELECT round(1 / l[n], 6) AS min_teps, round(1 / ((l[n - (n - 1) // 4] + l[n - n // 4]) * 0.5), 6) AS firstquartile_teps,
  round(1 / ((l[(n - 1) // 2 + 1] + l[n // 2 + 1]) * 0.5), 6) AS median_teps, round(1 / ((l[(n - 1) // 4 + 1] + l[n // 4 + 1]) * 0.5), 6) AS thirdquartile_teps,
  round(1 / l[1], 6) AS max_teps, round(1 / m, 6) AS harmonic_mean_teps, round(sd / (m * m * sqrt(n - 1)), 6) AS harmonic_std_teps FROM l"""
)
def teps_stats(spark, d):
    return _rounded(stats.teps_stats(_runs(spark, d)))


@query(f"SELECT round(count(*) / sum(1 / CAST(bfs_time AS DOUBLE)), 6) AS harmonic_mean FROM ({_RUNS})")
def harmonic_mean(spark, d):
    return _rounded(stats.harmonic_mean(_runs(spark, d), "bfs_time"))


@query("SELECT CAST(s_suppkey AS INTEGER) AS idx, CAST(s_suppkey * 0.5 AS DOUBLE) AS bfs_time, CAST(s_suppkey * 2.25 AS DOUBLE) AS validate_time, s_suppkey * 7 AS edge_count FROM supplier")
def log_parse(spark, d):
    k = F.col("s_suppkey")
    text = F.array(
        F.format_string("Time for BFS %d is %.6f", k, k * 0.5),
        F.format_string("Validate time for BFS %d is %.6f", k, k * 2.25),
        F.format_string("Number of traversed edges is %d", k * 7),
    )
    lines = spark.read.parquet(f"{d}/supplier.parquet").select(k, F.posexplode(text).alias("pos", "line"))
    return stats.parse_log(lines.select((k * 3 + F.col("pos")).alias("line_no"), "line"))


_SIZES = "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey"


@query(f"WITH n AS ({_SIZES}) SELECT l_suppkey, n > CAST(trunc((SELECT sum(n) FROM n) / 10.0) AS BIGINT) AS to_bottom_up, n < CAST(trunc((SELECT count(*) FROM n) / (14.0 * 16 * 2)) AS BIGINT) AS to_top_down FROM n")
def tuning_threshold(spark, d):
    n = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("verts"))  # one row
    limits = n.join(F.broadcast(total))
    return limits.select(
        "l_suppkey", (F.col("n") > (F.col("edges") / 10.0).cast("long")).alias("to_bottom_up"), (F.col("n") < (F.col("verts") / (14.0 * 16 * 2)).cast("long")).alias("to_top_down")
    )
