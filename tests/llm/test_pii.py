"""Personal data: the fixed patterns against a plain version on whole tables, what trees add, and long texts."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from graphloom.llm import common, pii
from tests.llm.test_operators import PLAIN, docs, valid


def plain_base(t):
    t = t or ""
    return sorted((m.start(), k, kind, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], t) if valid(kind, m[0]))


def luhn_number(rnd, n=16, ok=True):
    while True:
        v = rnd.choice("456") + "".join(rnd.choice("0123456789") for _ in range(n - 1))
        if valid("card", v) == ok:
            return v


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_all_columns_equal_plain_on_all_rows(spark, sf):
    d = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pii.op7_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, _, k, _ in base) for x in ("email", "ip", "card", "phone"))
        named = [f"{k}:{i}:{j}" for i, _, k, j in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(named) <= set(spans)
        # Added spans touch no fixed one, and no other.
        places = sorted((int(a), int(b)) for s in set(spans) - set(named) for a, b in [s.split(":")[1:]])
        assert all(b <= c for (_, b), (c, _) in zip(places, places[1:]))
        assert all(b <= i or a >= j for a, b in places for i, _, _, j in base)


def corpus(rnd, n):
    """Texts with loose forms that are personal data and look-alikes that aren't; span of the loose form or None."""
    rows, want = [], {}
    number = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    octets = lambda: [str(rnd.randrange(256)) for _ in range(4)]
    fixed = [
        lambda: f"please pay with card {luhn_number(rnd)} now",
        lambda: f"the order {luhn_number(rnd, ok=False)} was sent",
        lambda: f"the host {'.'.join(octets())} is up",
        lambda: f"see release {rnd.randrange(300, 999)}.{rnd.randrange(300, 999)}.1.2 of it",
        lambda: f"call +49 {number(2)} {number(7)} today",
        lambda: f"item +{number(2)}-{number(2)} of them",
        lambda: f"mail joe{number(2)}@example.com today",
    ]
    v = lambda: luhn_number(rnd)
    cut = lambda x, mark: mark.join(x[i : i + 4] for i in range(0, 16, 4))
    good = [
        lambda: ("please pay with card ", cut(v(), "."), " now"),
        lambda: ("the host ", "[.]".join(octets()), " is up"),
        lambda: ("mail ", f"joe{number(2)} [at] mail{number(1)} [dot] com", " today"),
        lambda: ("call ", f"{number(3)}-{number(3)}-{number(4)}", " today"),
    ]
    bad = [
        lambda: ("the order ", cut(v(), "."), " was sent"),
        lambda: ("item ", f"{number(3)}-{number(3)}-{number(4)}", " of them"),
    ]
    for _ in range(n):
        rows.append((len(rows), rnd.choice(fixed)()))
        for which, some in ((True, good), (False, bad)):
            head, x, tail = rnd.choice(some)()
            want[len(rows)] = (len(head), len(head) + len(x)) if which else None
            rows.append((len(rows), head + x + tail))
    return rows, want


def test_trees_use_context_and_add_loose_forms(spark):
    rows, want = corpus(random.Random(4), 700)
    table = common.materialize(pii.candidates(docs(spark, rows)))
    model, least = pii.fit(table)
    used = {pii.FEATURES[f] for f, _, _ in model.trees} | {pii.FEATURES[i[0]] for _, _, leaves in model.trees for i, _ in leaves if i}
    assert used & {"telling", "denying", "before", "after", "beside"}
    assert not {"luhn", "digits", "parts"} & set(pii.FEATURES)
    assert set(least) == set(pii.KINDS)
    got = {r.doc_id: [(s.start, s.stop) for s in r.every if s.kind.endswith("_like")] for r in pii.scan(docs(spark, rows)).collect()}
    found = [want[i] in got[i] for i in want if want[i]]
    wrong = sum(len(set(got[i]) - {w}) for i, w in want.items())
    assert np.mean(found) >= 0.9
    assert wrong <= 0.1 * sum(found)


def test_column_scores_equal_the_trees(spark):
    rows, _ = corpus(random.Random(5), 60)
    table = common.materialize(pii.candidates(docs(spark, rows)))
    model, _ = pii.fit(table)
    c = table.selectExpr("explode(cands) AS c").select("c.x.*")
    got = c.select("*", model.column(c_struct(c)).alias("z")).collect()
    x = np.array([[r[f] for f in pii.FEATURES] for r in got])
    assert np.allclose(model.of(x), [r.z for r in got])


def c_struct(df):
    from pyspark.sql import functions as F

    return F.struct(*[df[f].alias(f) for f in pii.FEATURES])


def test_many_matches_take_time_in_proportion(spark):
    rnd = random.Random(6)
    unit = lambda k: f"a{k}@b.com 10.0.0.{k % 256} +49 89 {k:07d} ({k % 1000:03d}) 555-7713 tel {luhn_number(rnd)} {luhn_number(rnd)}; "
    text = "".join(map(unit, range(8000)))
    numbers = " ".join(str(rnd.randrange(10, 99)) for _ in range(100_000)) + " 1.2.3" * 3 + ".4" * 50_000
    t = time.time()
    got = {r.doc_id: r for r in pii.scan(docs(spark, [(1, text), (2, numbers), (3, "a" * 1_000_000 + "@"), (4, "1" * 1_000_000)])).collect()}
    assert time.time() - t < 120
    base = plain_base(text)
    assert [(s.kind, s.start, s.stop) for s in got[1].spans] == [(k, i, j) for i, _, k, j in base]
    assert len(base) == 16_000
    assert [(s.kind, s.start, s.stop) for s in got[2].spans] == [(k, i, j) for i, _, k, j in plain_base(numbers)]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\x01 a@b.co \x01 1.2.3.4"), (3, "a@b.co"), (None, "+49 89 1234567")]
    got = pii.scan(docs(spark, rows).selectExpr("*", "1 AS spans", "2 AS cands", "3 AS t")).collect()
    assert sorted((len(r.spans) for r in got)) == [0, 0, 1, 1, 2]
    assert pii.fit(common.materialize(pii.candidates(docs(spark, rows[:2])))) is None
