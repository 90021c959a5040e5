import numpy as np
import pytest

from graphloom.operators import bfs as B
from graphloom.operators import edges as E
from graphloom.operators import graph as G
from graphloom.operators import validate
from graphloom.operators.roots import sample_roots
from graphloom.plans.stats import VISITED
from graphloom.sources import generators, rng


def test_stream():
    state = rng.seed_state(2, 3)
    assert state == [3, 1, 4, 1, 1]
    out = []
    for _ in range(4):
        x, state = rng.next_uint(state)
        out.append(x)
    assert out == [322227026, 531570115, 1424981115, 1111973825]
    assert rng.doubles(2, 2, 3, 0) == pytest.approx([0.410212082829285, 0.037614701324416445], abs=1e-15)
    assert rng.scramble_keys(2, 3) == (7111014902169325161, 3043718919927570188)


def test_skip_equals_steps():
    state = rng.seed_state(5, 6)
    walked = state
    for _ in range(300):
        _, walked = rng.next_uint(walked)
    assert rng.skip(state, 0, 0, 300) == walked
    table = rng.jump_tables(300, 0)
    assert rng.jump(np.array(state, np.int64)[:, None], np.array([300]), table)[:, 0].tolist() == walked


@pytest.mark.parametrize("scale", [1, 5, 12])
def test_scramble_is_a_bijection(scale):
    keys = rng.scramble_keys(2, 3)
    assert sorted(rng.scramble(np.arange(1 << scale), scale, keys).tolist()) == list(range(1 << scale))


FIRST = {
    4: [(15, 3), (15, 12), (7, 12), (15, 15), (15, 15)],
    8: [(17, 138), (82, 127), (250, 60), (57, 6), (46, 206)],
    10: [(299, 797), (684, 861), (185, 385), (428, 328), (490, 200)],
}
ROOTS = {4: [7, 3, 1, 15], 8: [53, 55, 31, 241], 10: [458, 214, 220, 966, 395, 9, 848, 777]}
LEVELS = {4: [1, 10, 5], 8: [1, 2, 49, 178, 11], 10: [1, 8, 500, 380, 8]}
NUMBERS = {4: (256, 37, 438, 54, 16), 8: (4096, 85, 8022, 2152, 241), 10: (16384, 144, 32480, 10551, 899)}


@pytest.mark.parametrize("scale", sorted(FIRST))
def test_rmat(spark, scale):
    edges = generators.rmat_edges(spark, scale).cache()
    assert [(r.v0, r.v1) for r in edges.orderBy("edge_id").limit(5).collect()] == FIRST[scale]
    graph = G.build_graph(edges)
    n, loops, degrees, pairs, vertices = NUMBERS[scale]
    assert edges.count() == n and edges.where("v0 = v1").count() == loops
    assert graph.vertices.groupBy().sum("degree").first()[0] == degrees
    assert (graph.num_edges, graph.num_vertices) == (2 * pairs, vertices)
    roots = sample_roots(graph, len(ROOTS[scale]))
    assert roots == ROOTS[scale]
    rows = B.bfs(graph, roots[:1]).rows.cache()
    assert [r.n for r in B.level_hist(rows).orderBy("level").collect()] == LEVELS[scale]
    assert validate.edge_visit_count(edges, rows).first()[0] == VISITED[scale]
    assert validate.check(edges, rows, roots[0])


def test_edges_do_not_depend_on_partitions(spark):
    kernel = generators.Rmat(7, 16, generators.PLAIN)
    one = generators.generate(spark, kernel, parts=1)
    many = generators.generate(spark, kernel, parts=7)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_first_edges(spark):
    tree = generators.binary_tree_edges(spark, 6)
    assert tree.count() == 63
    graph = G.build_graph(tree)
    assert graph.num_vertices == 64 and graph.num_edges == 126
    cycle = E.symmetrize(generators.cycle_edges(spark, 6)).groupBy("src").count()
    assert cycle.where("count = 2").count() == 64
    weighted = generators.rmat_edges(spark, 6, 4, generators.TREE_WEIGHTED)
    assert weighted.where("weight BETWEEN 1 AND 255").count() == 256
