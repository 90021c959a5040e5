"""A whole benchmark run: generate, build, sample keys, traverse, validate, report.

    python -m graphloom.plans.run SCALE [-e EDGE_FACTOR] [-a ALPHA] [-b BETA] [-r SEED] [-n KEYS] [-s FIRST] [-v LEVEL] [-A] [-S] [-C] [-P] [-R] [--increasing-scale] [--log FOLDER]

With --log, finished runs are added to a log one by one, and a run that was stopped goes on after those in it.
A partial run (-s) has the keys of the whole run, so logs of parts can be put together.
"""

from __future__ import annotations

import argparse
import time
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..operators import bfs as B
from ..operators import edges as E
from ..operators import prune, roots, validate
from ..operators.graph import build_graph
from ..sources import rng
from ..sources.generators import rmat_edges
from ..sources.storage import discard, materialize
from . import stats
from .policy import DirectionPolicy
from .tuning import Tuner


def options(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("scale", type=int)
    p.add_argument("-e", "--edge-factor", type=int, default=16)
    p.add_argument("-a", "--alpha", type=float, default=10.0)
    p.add_argument("-b", "--beta", type=float, default=14.0)
    p.add_argument("-n", "--keys", type=int, default=16)
    p.add_argument("-s", "--start", type=int, default=0, help="first key of a partial run")
    p.add_argument("-v", "--validation", type=int, default=2, choices=(0, 1, 2))
    p.add_argument("-r", "--root-seed", type=int, default=0, metavar="SEED", help="offset of the keys' seed")
    p.add_argument("-S", "--seed-search", action="store_true", help="take the seed with the best rate")
    p.add_argument("--seed-trials", type=int, default=100, help="seeds that a search tries")
    p.add_argument("-A", "--auto-tuning", action="store_true")
    p.add_argument("-P", "--pre-exec", action="store_true", help="traverse from all keys first, untimed")
    p.add_argument("--pre-exec-seconds", type=float, default=0.0, help="go on with that for so long")
    p.add_argument("-C", "--prune", action="store_true", help="take off tree-shaped fringes first")
    p.add_argument("-R", "--real", action="store_true", help="64 keys, all validated")
    p.add_argument("--increasing-scale", action="store_true", help="all scales from 1 up to SCALE")
    p.add_argument("--log", help="folder of the run log")
    o = p.parse_args(argv)
    if o.start and (o.auto_tuning or o.seed_search):
        p.error("a partial run can't be tuned")
    if min(o.edge_factor, o.alpha, o.beta, o.keys) <= 0 or o.start < 0:
        p.error("numbers must be above 0")
    if o.real:
        o.keys, o.validation, o.pre_exec = 64, 2, True
    return o


class Regions:
    """Seconds spent in each part of a run."""

    def __init__(self):
        self.seconds: dict[str, list[float]] = {}

    @contextmanager
    def time(self, name: str):
        began = time.perf_counter()
        yield
        self.seconds.setdefault(name, []).append(time.perf_counter() - began)

    def lines(self) -> list[str]:
        return [f"{k}: {len(x)} times, max {max(x):.3f}, min {min(x):.3f}, mean {sum(x) / len(x):.3f} s" for k, x in self.seconds.items()]


def settings(spark: SparkSession, o: argparse.Namespace, graph) -> dict:
    """What a report says about the run."""
    conf = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    return vars(o) | {c: spark.conf.get(c) for c in conf} | {"cores": spark.sparkContext.defaultParallelism, "edges": graph.num_edges, "vertices": graph.num_vertices, "hub": graph.hub}


def seed_trials(count: int) -> list[int]:
    """Seeds that a search tries: 0, then 24-bit numbers of the stream."""
    return [0, *[int(rng.doubles(1, *roots.SEEDS, k)[0] * (1 << 24)) for k in range(1, count)]]


def run(spark: SparkSession, o: argparse.Namespace, scale: int | None = None) -> dict:
    """Runs of all keys, and the report's rows."""
    scale, regions = scale or o.scale, Regions()
    with regions.time("generation"):
        edges = materialize(rmat_edges(spark, scale, o.edge_factor))
    with regions.time("construction"):
        graph = build_graph(edges)
        pruned = prune.prune_trees(E.symmetrize(edges)) if o.prune else None
    print("\n".join(f"{k}: {v}" for k, v in settings(spark, o, graph).items()))
    policy = lambda a, b: DirectionPolicy(graph.num_edges, graph.num_vertices, o.edge_factor, a, b)
    depth = lambda keys: [len(B.bfs(graph, [k], policy(o.alpha, o.beta)).trace) for k in keys]
    sample = lambda seed: roots.sample_deep_roots(graph, o.keys, depth, scale, offset=seed)

    def tuned(keys, alpha, beta):
        rates = []

        def measure(a, b):
            t = time.perf_counter()
            done = [B.bfs(graph, [k], policy(a, b)) for k in keys]
            rates.append(graph.num_edges * len(keys) / (time.perf_counter() - t))
            return rates[-1], [x.record for x in done]

        return *Tuner(alpha, beta, o.edge_factor).tune(measure), max(rates)

    alpha, beta, seed = o.alpha, o.beta, o.root_seed
    with regions.time("keys"):
        if o.seed_search:
            seed = max(seed_trials(o.seed_trials), key=lambda s: tuned(sample(s), alpha, beta)[2])
        keys = sample(seed)
    if o.auto_tuning or o.seed_search:
        with regions.time("tuning"):
            alpha, beta, _ = tuned(keys, alpha, beta)
    if o.pre_exec:
        with regions.time("pre-execution"):
            began = time.perf_counter()
            while True:
                depth(keys)
                if time.perf_counter() - began >= o.pre_exec_seconds:
                    break
    done = stats.finished_runs(spark, o.log, scale, o.edge_factor) if o.log else {}
    times, ok, expected = [], True, stats.expected_edges(scale, o.edge_factor)
    for i, key in list(enumerate(keys))[o.start :]:
        if i in done:
            if done[i][0] != key:
                raise ValueError("the log has another key")
            took, checked, n = done[i][1:]
        else:
            with regions.time("traversal"):
                t = time.perf_counter()
                if pruned:
                    rows = prune.pruned_bfs(pruned, key)
                else:
                    rows = B.bfs(graph, [key], policy(alpha, beta)).rows.select("v", "pred", "level")
                rows = materialize(rows)
                took = time.perf_counter() - t
            with regions.time("validation"):
                t = time.perf_counter()
                ok = validate.check(edges, rows, key, o.validation, i == 0)
                n = validate.edge_visit_count(edges, rows).first()[0]
                checked = time.perf_counter() - t
            discard(rows)
            if ok and o.log:
                stats.append_run(spark, o.log, scale, o.edge_factor, spark.sparkContext.defaultParallelism, i, key, took, checked, n)
        times.append((took, checked, n))
        print(f"Time for BFS {i} is {took:f} ({took:e})\nValidate time for BFS {i} is {checked:f}\nNumber of traversed edges is {n}")
        if expected and n != expected:
            print(f"A key of the largest component traverses {expected} edges")
        if not ok:
            break
    print("\n".join(regions.lines()))
    first = {k: x[0] for k, x in regions.seconds.items()}
    return {"scale": scale, "ok": ok, "times": times, "keys": keys, "seed": seed, "alpha": alpha, "beta": beta, "generation": first["generation"], "construction": first["construction"]}


def report(spark: SparkSession, result: dict) -> list[str]:
    if not result["ok"]:
        return ["No results printed for invalid run."]
    runs = spark.createDataFrame(result["times"], "bfs_time double, validate_time double, edge_count long")
    out = []
    for column, name in (("bfs_time", "time"), ("edge_count", "nedge"), ("validate_time", "validate")):
        row = stats.order_stats(runs, column).first().asDict()
        out += [f"{k}_{name}: {v}" for k, v in row.items()]
    return out + [f"{k}: {v}" for k, v in stats.teps_stats(runs).first().asDict().items()]


def register_views(graph, rows=None, prefix: str = "") -> list[str]:
    """Temporary views edges, adj, vertices (and bfs, a traversal's rows), for SQL over them."""
    views = {"edges": graph.edges, "adj": graph.adj, "vertices": graph.vertices} | ({"bfs": rows} if rows is not None else {})
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]


def main(argv=None) -> None:
    o = options(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    for scale in range(1, o.scale + 1) if o.increasing_scale else [o.scale]:
        print("\n".join(report(spark, run(spark, o, scale))))


if __name__ == "__main__":
    main()
