"""The near-dedup stage: the trie self-join's part in it, and work that grows with a group's size, not its square."""

import random

import numpy as np
import pytest

from graphloom.llm import common, simhash
from tests.llm.test_operators import docs, groups_of, plain_grams
from tests.llm.test_pipeline import plain_near


def family(m, seed=5):
    """m edits of one text, most pairs of which are a little too far apart."""
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(900)}" for _ in range(140)]
    rows = []
    for k in range(m):
        w = list(base)
        for _ in range(rnd.randrange(1, 7)):
            w[rnd.randrange(140)] = f"c{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    return rows


def components(links, names):
    at = {x: k for k, x in enumerate(names)}
    comp = groups_of(len(names), [(at[a], at[b]) for a, b in links])
    return {frozenset(x for x in names if comp[at[x]] == c) for c in comp}


def test_large_group_does_not_give_all_its_pairs(spark, monkeypatch):
    m, seen = 400, []
    materialize = common.materialize

    def counted(df):
        out = materialize(df)
        if out.columns in (["a", "b"], ["member", "root"]):
            seen.append(out.count())
        return out

    monkeypatch.setattr(common, "materialize", counted)
    rows = family(m)
    got = {r.doc_id for r in simhash.filter_stage(docs(spark, rows)).collect()}
    assert got == {i for i, _, _ in plain_near([(i, t, None) for i, t in rows])} and 1 < len(got) < m
    assert seen and max(seen) < 20 * m < m * (m - 1) / 2


def test_trie_self_join_gives_candidates(spark, monkeypatch):
    """Without the sets that meet at prefixes, texts whose fingerprints link in the trie self-join are still found."""
    rnd = random.Random(3)
    rows = []
    for k in range(60):
        w = [f"t{rnd.randrange(10**5)}" for _ in range(400)]
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(w[:-1])), (3 * k + 2, " ".join(w[:200]))]
    prints = {i: simhash.majority(simhash.grams(t)) for i, t in rows}
    near = {3 * k + 1 for k in range(60) if ((prints[3 * k] ^ prints[3 * k + 1]) & (1 << 64) - 1).bit_count() <= simhash.ERRORS}
    assert len(near) > 50
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "met_links", lambda met, parts: none)
    got = {r.doc_id for r in simhash.filter_stage(docs(spark, rows)).collect()}
    assert got == {i for i, _ in rows} - near


def test_cut_cells_and_blocks_give_the_same_groups(spark):
    rows = family(90) + [(90 + i, t.replace("b", "d")) for i, t in family(40, 6)] + [(130, "one two three"), (131, "one two three four")]
    table = docs(spark, rows)
    sets = common.materialize(simhash.gram_sets(table, np.array([], np.int64)))
    one = sets.selectExpr("fp", "doc_id AS least", "n", *simhash.SIMS)
    met = common.materialize(simhash.meetings(sets, 2).join(one.drop("least"), "fp"))
    names = [r.fp for r in sets.select("fp").distinct().collect()]
    near = [{tuple(r) for r in simhash.met_links(met, 2, cut).collect()} for cut in (simhash.MEET_ROWS, 10)]
    assert components(near[0], names) == components(near[1], names)
    # All pairs, plainly: they are joined too.
    none = spark.createDataFrame([], "member long, root long")
    every = {tuple(r) for r in simhash.other_pairs(met, none, 2).collect()}
    assert components(near[0], names) == components(every, names)
    blocks = common.materialize(sets.selectExpr("fp", "1L AS block").distinct())
    want = components([(r[0], r[1]) for r in simhash.block_links(blocks, one, table.select("doc_id", "text"), 2).collect()], names)
    cut = components([(r[0], r[1]) for r in simhash.block_links(blocks, one, table.select("doc_id", "text"), 2, 2_000).collect()], names)
    assert want == cut and len(want) > 3


@pytest.mark.parametrize("mixed", [False, True])
def test_set_links_equal_all_pairs(mixed):
    texts = [t for _, t in family(70)] + ["one two three", "one two three", "x"]
    sets = [simhash.grams(t) for t in texts]
    sides = np.array([k % 2 if mixed else 0 for k in range(len(sets))])
    plain = [plain_grams(t) for t in texts]
    like = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if like(plain[i], plain[j]) and (not mixed or sides[i] != sides[j])]
    a, b = simhash.set_links(sets, sides)
    assert set(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist())) <= set(pairs) and len(a) < len(sets)
    assert components(zip(a.tolist(), b.tolist()), range(len(sets))) == components(pairs, range(len(sets)))
