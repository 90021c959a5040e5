"""DuckDB SQL for the synthetic edge lists, from the definition of the stream: tests hold the kernels against it."""

from __future__ import annotations

# The stream's modulus and multipliers, its state and the scrambling constants for seeds 2 and 3, and the bits of the multipliers.
P, X, Y = (1 << 31) - 1, 107374182, 104480
STATE = (3, 1, 4, 1, 1)
KEYS = (7111014902169325161, 3043718919927570188)
BITS = (0x4519840211493211, 0x3050852102C843A5)


def _times(a, b):
    return [[sum(a[i][k] * b[k][j] for k in range(5)) % P for j in range(5)] for i in range(5)]


def _squared(times: int):
    """The step's matrix, squared so many times."""
    m = [[X, 0, 0, 0, Y]] + [[int(j == i) for j in range(5)] for i in range(4)]
    for _ in range(times):
        m = _times(m, m)
    return m


def _after(high: int, middle: int) -> list[int]:
    """STATE after high * 2^128 + middle * 2^64 steps."""
    z = list(STATE)
    n = (high << 128) + (middle << 64)
    for k in range(n.bit_length()):
        if n >> k & 1:
            z = [sum(a * b for a, b in zip(row, z)) % P for row in _squared(k)]
    return z


def states(name: str, count: str, bits: int, start: list[int], unit: int) -> str:
    """CTE name(e, z0 .. z4): the state after e jumps of 2^unit steps, by the bits of e."""
    matrix = ", ".join("(" + ", ".join([str(k), *[str(x) for row in _squared(unit + k) for x in row]]) + ")" for k in range(bits))
    names = ", ".join(f"m{i}{j}" for i in range(5) for j in range(5))
    z = ", ".join(f"CAST({x} AS BIGINT) AS z{i}" for i, x in enumerate(start))
    turn = lambda i: " + ".join(f"(m{i}{j} * z{j}) % {P}" for j in range(5))
    moved = ", ".join(f"CASE WHEN (e >> {name}_j.k) & 1 = 1 THEN ({turn(i)}) % {P} ELSE z{i} END" for i in range(5))
    return (
        f"{name}_m(k, {names}) AS (VALUES {matrix}), "
        f"{name}_j AS (SELECT range AS e, 0 AS k, {z} FROM range({count}) UNION ALL "
        f"SELECT e, {name}_j.k + 1, {moved} FROM {name}_j JOIN {name}_m ON {name}_j.k = {name}_m.k), "
        f"{name} AS (SELECT e, z0, z1, z2, z3, z4 FROM {name}_j WHERE k = {bits})"
    )


def scrambled(scale: int) -> str:
    """CTE sc(v, w): the bijection of the vertices. Only the low bits of sums and products matter."""
    n = 1 << scale
    reverse = lambda x: f"CAST(list_sum(list_transform(range({scale}), lambda i: ((({x}) >> i) & 1) << ({scale - 1} - i))) AS BIGINT)"
    once = reverse(f"(v + {sum(KEYS) % n}) * {(KEYS[0] | BITS[0]) % n} % {n}")
    twice = reverse(f"t * {(KEYS[1] | BITS[1]) % n} % {n}")
    return f"sc AS MATERIALIZED (SELECT v, {twice} AS w FROM (SELECT v, {once} AS t FROM (SELECT range AS v FROM range({n}))))"


def _named(raw: str) -> str:
    return f"SELECT e AS edge_id, a.w AS v0, c.w AS v1 FROM ({raw}) r JOIN sc a ON r.x = a.v JOIN sc c ON r.y = c.v"


def tree(scale: int) -> str:
    return f"WITH {scrambled(scale)} " + _named(f"SELECT range AS e, range + 1 AS x, (range + 1) // 2 AS y FROM range({(1 << scale) - 1})")


def cycle(scale: int) -> str:
    return f"WITH {scrambled(scale)} " + _named(f"SELECT range AS e, range AS x, (range + 1) % {1 << scale} AS y FROM range({1 << scale})")


def uniform(scale: int, edge_factor: int = 16) -> str:
    n = 1 << scale
    step = lambda a, b: f"({X} * {a} + {Y} * {b}) % {P}"
    start = states("st", str(edge_factor * n), (edge_factor * n).bit_length(), list(STATE), 64)
    return f"WITH RECURSIVE {start}, {scrambled(scale)} " + _named(
        f"SELECT e, f % {n} AS x, {step('f', 'z3')} % {n} AS y FROM (SELECT *, {step('z0', 'z4')} AS f FROM st)"
    )


def rmat_ctes(scale: int, edge_factor: int = 16, a: int = 5700, bc: int = 1900) -> str:
    """CTEs with rm(e, x, y): both ends before scrambling. A number under 7295 is drawn again."""
    n = edge_factor << scale
    row, col = f"((d >= {bc} AND d < {2 * bc}) OR d >= {2 * bc + a})", f"(d < {bc} OR d >= {2 * bc + a})"
    bit = lambda end, cond: f"{end} + CASE WHEN ok AND {cond} THEN 1 << (left_ - 1) ELSE 0 END"
    return (
        f"{states('st', str(n), n.bit_length(), list(STATE), 64)}, {scrambled(scale)}, "
        f"dr AS (SELECT e, {scale} AS left_, z0, z1, z2, z3, z4, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y FROM st UNION ALL "
        f"SELECT e, CASE WHEN ok THEN left_ - 1 ELSE left_ END, z, z0, z1, z2, z3, "
        f"{bit('x', f'({row} AND NOT (x = y AND NOT {col}))')}, {bit('y', f'({col} OR (x = y AND {row}))')} "
        f"FROM (SELECT *, z >= 7295 AS ok, z % 10000 AS d FROM (SELECT *, ({X} * z0 + {Y} * z4) % {P} AS z FROM dr WHERE left_ > 0))), "
        "rm AS (SELECT e, x, y FROM dr WHERE left_ = 0)"
    )


def rmat(scale: int, edge_factor: int = 16) -> str:
    return f"WITH RECURSIVE {rmat_ctes(scale, edge_factor)} {_named('SELECT e, x, y FROM rm')}"


def rmat_tree_weighted(scale: int, edge_factor: int = 16) -> str:
    n = edge_factor << scale
    head = (1 << scale) - 1
    ends = f"SELECT e, CASE WHEN e < {head} THEN e + 1 ELSE x END AS x, CASE WHEN e < {head} THEN (e + 1) // 2 ELSE y END AS y FROM rm"
    weights = states("wt", str(n), n.bit_length(), _after(30, 46), 0)
    return (
        f"WITH RECURSIVE {rmat_ctes(scale, edge_factor, 5500, 100)}, {weights} "
        f"SELECT edge_id, v0, v1, CAST(({X} * z0 + {Y} * z4) % {P} % 255 + 1 AS INTEGER) AS weight FROM ({_named(ends)}) JOIN wt ON edge_id = wt.e"
    )
