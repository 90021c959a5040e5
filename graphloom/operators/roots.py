"""Search keys: random vertices with an edge, the same for a graph and a seed offset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import rng
from .graph import Graph

SEEDS = (2, 3)


def sample_roots(graph: Graph, count: int, offset: tuple[int, int] = (0, 0), batch: int = 256) -> list[int]:
    """Up to count different roots, in the order of the stream; fewer if the stream's 2 N draws run out.

    N is the power of two that all ids fit in. A batch of candidates is looked up at once.
    """
    top = graph.vertices.agg(F.bit_or("v")).first()[0]
    if top is None:
        return []
    n = 1 << max(0, top.bit_length())
    state = rng.skip(rng.seed_state(SEEDS[0] + offset[0], SEEDS[1] + offset[1]), 2, 0, 0)
    out: list[int] = []
    drawn, limit = 0, 2 * n
    while len(out) < count and drawn < limit:
        some = []
        while len(some) < batch and drawn < limit:
            a, state = rng.next_double(state)
            b, state = rng.next_double(state)
            some.append(int((a + b) * n) % n)
            drawn += 2
        good = {r["v"] for r in graph.vertices.where(F.col("v").isin(sorted(set(some)))).collect()}  # at most a batch
        for v in some:
            if v in good and v not in out and len(out) < count:
                out.append(v)
    return out


def sample_deep_roots(graph: Graph, count: int, levels_of: Callable[[list[int]], list[int]], scale: int, more_than: int = 3, small: int = 6, offset: int = 0, tries: int = 100) -> list[int]:
    """Roots that all reach more than `more_than` levels; seeds go up by one until they do (not in graphs up to scale `small`)."""
    for k in range(tries):
        roots = sample_roots(graph, count, (offset + k, 0))
        if scale <= small or all(x > more_than for x in levels_of(roots)):
            return roots
    return roots


def roots_frame(graph: Graph, count: int, offset: tuple[int, int] = (0, 0)) -> DataFrame:
    rows = list(enumerate(sample_roots(graph, count, offset)))
    return graph.adj.sparkSession.createDataFrame(rows, "idx int, root long")

