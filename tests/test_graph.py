import random
import re
import struct

import pytest

from graphloom.operators import bfs as B
from graphloom.operators import edges as E
from graphloom.operators import graph as G
from graphloom.operators import prune, validate
from graphloom.plans import stats
from graphloom.plans.policy import DirectionPolicy
from graphloom.plans.run import options, register_views, report, run, seed_trials
from graphloom.plans.tuning import Tuner
from graphloom.sources import storage


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "v0 long, v1 long")


def plain_bfs(pairs, root):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    level, pred, now = {root: 0}, {root: root}, [root]
    while now:
        nxt = {}
        for v in now:
            for w in near.get(v, ()):
                if w not in level:
                    nxt[w] = min(v, nxt.get(w, v))
        for w, v in nxt.items():
            level[w], pred[w] = level[v] + 1, v
        now = list(nxt)
    return {v: (pred[v], level[v]) for v in level}


rnd = random.Random(3)
GRAPHS = {
    "path": [(0, 1), (1, 2), (2, 3)],
    "star": [(0, k) for k in range(1, 9)],
    "cycle": [(k, (k + 1) % 5) for k in range(5)],
    "tail": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5)],
    "two": [(0, 1), (1, 2), (7, 8)],
    "multi": [(0, 1), (0, 1), (1, 0), (1, 1), (1, 2), (9, 9)],
    "random": [(rnd.randrange(40), rnd.randrange(40)) for _ in range(70)],
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
@pytest.mark.parametrize("forced", [None, "top_down", "bottom_up"])
def test_bfs(spark, name, forced):
    pairs = GRAPHS[name]
    graph = G.build_graph(frame(spark, pairs))
    root = pairs[0][0]
    t = B.bfs(graph, [root], DirectionPolicy(graph.num_edges, graph.num_vertices, 2, forced=forced))
    assert {r.v: (r.pred, r.level) for r in t.rows.collect()} == plain_bfs(pairs, root)
    assert validate.check(frame(spark, pairs), t.rows, root)


@pytest.mark.parametrize("name", ["star", "tail", "two", "random"])
def test_pruned_equals_plain(spark, name):
    pairs = GRAPHS[name]
    pruned = prune.prune_trees(E.symmetrize(frame(spark, pairs)))
    for root in {pairs[0][0], pairs[-1][1], pairs[-1][0]}:
        want = {v: level for v, (_, level) in plain_bfs(pairs, root).items()}
        rows = prune.pruned_bfs(pruned, root)
        assert {r.v: r.level for r in rows.collect()} == want
        assert validate.check(frame(spark, pairs), rows, root)


def test_peel_rounds(spark):
    pruned = prune.prune_trees(E.symmetrize(frame(spark, GRAPHS["tail"])))
    assert pruned.rounds == 3
    assert {(r.v, r.parent) for r in pruned.parents.collect()} == {(5, 4), (4, 3), (3, 2)}


@pytest.mark.parametrize("forced", ["top_down", "bottom_up"])
def test_hubs_in_several_buckets(spark, forced):
    pairs = GRAPHS["star"] + GRAPHS["random"]
    graph = G.build_graph(frame(spark, pairs), hub=3)
    assert graph.adj.where("src = 0").select("slot").distinct().count() > 1
    t = B.bfs(graph, [0, 1], DirectionPolicy(graph.num_edges, graph.num_vertices, forced=forced))
    for root in (0, 1):
        assert {r.v: (r.pred, r.level) for r in t.rows.where(f"root = {root}").collect()} == plain_bfs(pairs, root)


@pytest.mark.parametrize("step", ["top_down", "bottom_up"])
def test_steps_read_edges_in_their_buckets(spark, step):
    """No exchange between the edge table and the first join, also where nothing is broadcast."""
    graph = G.build_graph(frame(spark, GRAPHS["random"]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        start = spark.createDataFrame([(0, 0, 0, 0, 5)], "root long, v long, pred long, level int, degree long")
        if step == "top_down":
            plan = B.top_down_step(graph, start, start)
        else:
            plan = B.bottom_up_step(graph, start, B.unreached_vertices(graph, start, [0]))
        lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scan = next(i for i, line in enumerate(lines) if "SelectedBucketsCount" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):  # the scan's ancestors
        if depth(line) < at:
            above.append(line)
            at = depth(line)
    first_join = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above[: first_join + 1])


def test_policy_by_work():
    p = DirectionPolicy(0, 0, by_work=1000)
    p.advance(5, 100)
    assert p.direction() == "top_down"
    p.advance(50, 760)
    assert p.direction() == "bottom_up"
    p.advance(2, 10)
    assert p.direction() == "top_down"


def test_root_without_edges_and_no_roots(spark):
    graph = G.build_graph(frame(spark, GRAPHS["path"]))
    assert [tuple(r) for r in B.bfs(graph, [99]).rows.collect()] == [(99, 99, 99, 0)]
    assert B.bfs(graph, []).rows.isEmpty()


def test_empty_graph(spark):
    edges = frame(spark, [])
    graph = G.build_graph(edges)
    assert (graph.num_edges, graph.num_vertices) == (0, 0)
    assert E.id_stats(edges).first()["scale"] == 0
    assert prune.prune_trees(E.symmetrize(edges)).rounds == 0


BROKEN = {
    "v_range": lambda v: (99, v[1]) if v[2] == 2 else v[:2],
    "v_root_parent": lambda v: (1, v[1]) if v[2] == 0 else v[:2],
    "v_self_parent": lambda v: (2, v[1]) if v[2] == 2 else v[:2],
    "v_depth": lambda v: (v[0], 5) if v[2] == 3 else v[:2],
    "v_tree_edge": lambda v: (0, 1) if v[2] == 3 else v[:2],
}


@pytest.mark.parametrize("rule", sorted(BROKEN))
def test_broken_rules(spark, rule):
    rows = [(v, *BROKEN[rule]((p, d, v))) for v, (p, d) in plain_bfs(GRAPHS["path"], 0).items()]
    df = spark.createDataFrame(rows, "v long, pred long, level int")
    found = {r.rule: r.violations for r in validate.validate(frame(spark, GRAPHS["path"]), df, 0).collect()}
    assert found[rule] > 0


def test_boundary(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "v long, pred long, level int")
    found = {r.rule: r.violations for r in validate.validate(frame(spark, GRAPHS["path"]), df, 0).collect()}
    assert found["v_boundary"] == 1
    assert validate.edge_visit_count(frame(spark, GRAPHS["path"]), df).first()[0] == 1


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8])
def test_order_stats(spark, n):
    xs = [float((7 * k) % 11) for k in range(n)]
    got = stats.order_stats(spark.createDataFrame([(x,) for x in xs], "x double"), "x").first()
    s = sorted(xs)
    assert got["firstquartile"] == (s[(n - 1) // 4] + s[n // 4]) / 2
    assert got["median"] == (s[(n - 1) // 2] + s[n // 2]) / 2
    assert got["thirdquartile"] == (s[n - 1 - (n - 1) // 4] + s[n - 1 - n // 4]) / 2


def test_log(spark, tmp_path):
    log = str(tmp_path / "log")
    assert stats.finished_runs(spark, log, 4, 16) == {}
    stats.append_run(spark, log, 4, 16, 2, 1, 7, 0.5, 0.1, 256)
    stats.append_run(spark, log, 4, 16, 2, 0, 3, 0.25, 0.2, 256)
    assert stats.finished_runs(spark, log, 4, 16) == {0: (3, 0.25, 0.2, 256), 1: (7, 0.5, 0.1, 256)}
    with pytest.raises(ValueError):
        stats.finished_runs(spark, log, 5, 16)
    runs = spark.createDataFrame([(0, 1.0), (2, 1.0)], "idx int, bfs_time double")
    assert stats.check_log(runs) == {"runs": 2, "repeated": 0, "partial": True}
    with pytest.raises(ValueError):
        stats.complete_log(runs.unionByName(runs))


@pytest.mark.parametrize("order", "<>")
def test_binary_log(order):
    data = struct.pack(order + "4i3d", 10, 16, 4, 2, 1.5, 2.5, 0.5) + struct.pack(order + "2dq", 0.25, 0.5, 99) * 2 + bytes(24 * 62)
    log = stats.read_binary_log(data)
    assert (log["scale"], log["parts"], log["construction_time"], log["times"]) == (10, 4, 2.5, [(0.25, 0.5, 99)] * 2)


def test_run_goes_on_after_its_log(spark, tmp_path, capsys):
    log = str(tmp_path / "log")
    whole = run(spark, options(["4", "-n", "3", "--log", log]))
    assert whole["ok"] and len(whole["times"]) == 3 and {n for _, _, n in whole["times"]} == {256}
    again = run(spark, options(["4", "-n", "4", "--log", log]))
    assert again["times"][:3] == whole["times"] and again["keys"][:3] == whole["keys"]
    part = run(spark, options(["4", "-n", "4", "-s", "2", "-C", "-P"]))
    assert part["keys"] == again["keys"] and len(part["times"]) == 2 and part["ok"]
    assert any("median_teps" in line for line in report(spark, part))
    assert "traversal: 1 times" in capsys.readouterr().out


def test_seed_trials():
    assert seed_trials(3)[0] == 0 and all(0 <= s < 1 << 24 for s in seed_trials(5)) and len(set(seed_trials(5))) == 5
    assert options(["5", "-S", "-r", "7"]).seed_search and options(["5", "-r", "7"]).root_seed == 7
    assert len(stats.VISITED) == 43 and stats.expected_edges(14, 16) == 262144 and stats.expected_edges(14, 8) is None


def test_views_and_pruned_vertices(spark):
    graph = G.build_graph(frame(spark, GRAPHS["tail"]))
    t = B.bfs(graph, [0])
    assert register_views(graph, t.rows, "g_") == ["g_edges", "g_adj", "g_vertices", "g_bfs"]
    assert spark.sql("SELECT count(*) FROM g_bfs JOIN g_vertices USING (v)").first()[0] == 6
    pruned = prune.prune_trees(E.symmetrize(frame(spark, GRAPHS["tail"])))
    assert {r.v for r in prune.contains_parent(pruned, graph.vertices).collect()} == {3, 4, 5}
    assert prune.path_to_core(pruned, 5) == [5, 4, 3, 2] and prune.path_to_core(pruned, 1) == [1]


def test_policy_switches_once():
    p = DirectionPolicy(1000, 10000, 5)
    p.advance(10, 50)
    assert p.direction() == "top_down"
    p.advance(60, 700)
    assert p.direction() == "bottom_up"
    p.advance(0, 0)
    assert p.direction() == "top_down" and not p.growing


def test_tuner_moves_while_faster():
    t = Tuner(10.0, 14.0)
    records = [{"num_edges": 1000, "nq_edges": 200, "pre_nq_edges": 50, "num_verts": 100, "nq_size": 1, "pre_nq_size": 2}]
    rates = iter([1.0, 2.0, 1.5, 1.0, 1.0, 1.0])
    assert t.tune(lambda a, b: (next(rates), records))[0] == pytest.approx(20.2)


def test_options():
    o = options(["5", "-R"])
    assert o.keys == 64 and o.validation == 2
    with pytest.raises(SystemExit):
        options(["5", "-s", "2", "-A"])


def test_distinct_pairs_are_dealt_to_tasks_by_size(spark, tmp_path, monkeypatch):
    """What a task of the duplicate search holds is bounded by the size of the sources, not by a number of tasks."""
    pairs = GRAPHS["random"] + GRAPHS["multi"]
    frame(spark, pairs).write.parquet(str(tmp_path / "e"))
    edges = spark.read.parquet(str(tmp_path / "e"))
    monkeypatch.setattr(storage, "TASK_BYTES", 200, raising=False)
    near = {v: {a + b - v for a, b in pairs if v in (a, b) and a != b} for v in {x for p in pairs for x in p}}
    hist = G.low_degree_hist(edges)
    assert {r.k: r.n for r in hist.collect()} == {k: sum(len(x) > k for x in near.values()) for k in range(10)}
    dealt = [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", hist._jdf.queryExecution().executedPlan().toString())]
    assert max(dealt) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {tuple(r) for r in E.neighbours(edges).collect()} == {(v, w) for v, x in near.items() for w in x}


def test_traversals_do_not_sort_the_edge_table(spark):
    """A step holds the smaller side by key; sorting all edges at each level is what made levels dear."""
    graph = G.build_graph(frame(spark, GRAPHS["random"]))
    start = spark.createDataFrame([(0, 0, 0, 0, 5)], "root long, v long, pred long, level int, degree long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for plan in (B.top_down_step(graph, start, start, 1), B.bottom_up_step(graph, start, B.unreached_vertices(graph, start, [0]), 1, True)):
            lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
            scan = next(i for i, line in enumerate(lines) if "SelectedBucketsCount" in line)
            join = max(i for i, line in enumerate(lines[:scan]) if "Join" in line)
            assert "ShuffledHashJoin" in lines[join] and not any("Sort" in line for line in lines[join:scan])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bottom_up_from_either_end(spark):
    """The edges of the frontier and those of what is unreached give the same parents, and the former don't deal out the latter."""
    pairs = GRAPHS["random"]
    graph = G.build_graph(frame(spark, pairs), hub=3)
    want = plain_bfs(pairs, pairs[0][0])
    for k in range(3):
        rows = [(0, v, p, level, graph.vertices.where(f"v = {v}").first()["degree"]) for v, (p, level) in want.items() if level <= k]
        levels = spark.createDataFrame(rows, "root long, v long, pred long, level int, degree long")
        unreached = graph.vertices.selectExpr("0L AS root", "v", "degree").join(levels.select("v"), "v", "left_anti")
        got = [{(r.v, r.pred) for r in B.bottom_up_step(graph, levels.where(f"level = {k}"), unreached, None, way).collect()} for way in (False, True)]
        assert got[0] == got[1] and {x for x in got[0] if x[1] is not None} == {(v, p) for v, (p, level) in want.items() if level == k + 1}


def test_pruning_writes_each_edge_once(spark, monkeypatch):
    """The tables of a round have one row for each edge that is left, not one for each direction."""
    written = []

    def seen(name):
        real = getattr(prune, name)

        def write(df, *a, **k):
            written.append(df.count())
            return real(df, *a, **k)

        monkeypatch.setattr(prune, name, write)

    seen("materialize")
    pruned = prune.prune_trees(E.symmetrize(frame(spark, GRAPHS["tail"] + [(7, 8), (8, 7)])))
    assert written == [7, 5, 4, 3]
    assert {tuple(r) for r in pruned.parents.collect()} == {(5, 4, 1), (8, 7, 1), (4, 3, 2), (3, 2, 3)}
    assert {tuple(r) for r in pruned.core.collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
