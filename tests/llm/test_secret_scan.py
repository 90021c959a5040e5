"""Secret scan: the fixed patterns against a plain version on whole tables, and what the inferred automata find."""

import hashlib
import random
import re
import string

import pytest

from graphloom.llm import common, secret_scan
from tests.llm.test_operators import docs

SF = "/root/testdata/sf0.001"
AN = string.ascii_letters + string.digits
HEX = "0123456789abcdef"
CAPITALS = string.ascii_uppercase + string.digits
FORMATS = {
    "git": ("ghp_", AN, 36),
    "temporary": ("ASIA", CAPITALS, 16),
    "live": ("sk_live_", AN, 24),
    "base64": ("", AN + "+/", 40),
    "capital_hex": ("", HEX.upper(), 32),
    "short": ("", HEX, 16),
    "url": ("", AN + "-_", 43),
}
DECOYS = (
    "HELLOWORLD ORD-2024-00123 2024-01-02T10:22:33 https://a.b.com/x/y1 192.168.1.100 Section12 thisIsCamelCase snake_case_name ABCDEF 12345678 "
    "1234567890123456 v1.2.3-beta4 file_name.txt AAAAAAAAAA foo/bar/baz123 iPhone15Pro +1-202-555-0101 COVID-19-cases well-known well.known e.g. x=1"
)


def make(rnd, name):
    head, chars, n = FORMATS[name]
    return head + "".join(rnd.choice(chars) for _ in range(n))


def plain_base(t):
    """Spans of the contract's patterns, by their definition."""
    t = t or ""
    out = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, i, j) for i, _, k, j in sorted(out)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_base_equals_plain_on_all_rows(spark, sf):
    d = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = secret_scan.op3_secret_scan(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
        named = [f"{k}:{i}:{j}" for k, i, j in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r.spans.split(",")) | {""}


def test_held_out_recall_on_the_tables(spark):
    table = common.materialize(secret_scan.found(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    f = secret_scan.infer(table)
    assert set(f.automata) == {"assign", "hex"}
    assert all(a.states > 1 and f.held_out[k] >= 0.9 for k, a in f.automata.items())
    rnd = random.Random(3)
    assert f.fits("".join(rnd.choice(HEX) for _ in range(40)))
    assert not any(f.fits("".join(rnd.choice(HEX) for _ in range(n))) for n in (12, 24, 39, 41, 64))
    # Nothing in these tables but the fixed spans looks like their secrets.
    added = secret_scan.scan(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("size(added) > 0")
    assert added.count() == 0


def test_learnt_formats_are_found_where_no_pattern_looks(spark):
    rnd = random.Random(5)
    rows, planted, decoys = [], {}, set()
    for name in FORMATS:
        for _ in range(120):
            rows.append((len(rows), f'the words of it token = "{make(rnd, name)}" and more.'))
        for _ in range(60):
            v = make(rnd, name)
            text = f"before the {v} comes after, as said."
            planted[len(rows)] = (name, text, v)
            rows.append((len(rows), text))
    for k in range(200):
        some = rnd.sample(DECOYS.split(), 6)
        decoys.add(len(rows))
        rows.append((len(rows), " and ".join(some) + f" in {rnd.randrange(10**9)} of them"))
    got = {r.doc_id: r for r in secret_scan.scan(docs(spark, rows)).collect()}
    for name in FORMATS:
        mine = [(i, text, v) for i, (n, text, v) in planted.items() if n == name]
        hit = sum((text.index(v), text.index(v) + len(v)) in {(s.start, s.stop) for s in got[i].added} for i, text, v in mine)
        assert hit >= 0.9 * len(mine), name
    assert sum(len(got[i].added) for i in decoys) == 0
    stage = {r.doc_id: r.text for r in secret_scan.redact_stage(docs(spark, rows)).collect()}
    assert sum(v in stage[i] for i, (_, _, v) in planted.items()) <= 0.1 * len(planted)
    assert all(stage[i] == rows[i][1] for i in decoys)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_few_labels(n):
    rnd = random.Random(n)
    f = secret_scan.Formats({"assign": [make(rnd, "git") for _ in range(n)], "hex": []}, {("w", 40): 10, ("l", 30): 5})
    assert set(f.automata) == {"assign"} and f.automata["assign"].states >= 1
    assert f.fits(make(rnd, "git")) and not f.fits("abcdefgh1") and not f.fits(make(rnd, "temporary"))


def test_candidates():
    t = "x key=abc_12345 foo.bar well-known it's --flag a1 HELLO-WORLD 7777777 z/y9x8w7v6/q ciónabc12345 " + "k" * 21 + " Berlin"
    got = [t[i:j] for i, j in secret_scan.candidates_of(t, [])]
    assert got == ["key=abc_12345", "abc_12345", "HELLO-WORLD", "7777777", "z/y9x8w7v6/q", "y9x8w7v6", "nabc12345", "k" * 21]
    at = t.index("7777777")
    assert "7777777" not in [t[i:j] for i, j in secret_scan.candidates_of(t, [("hex", at + 3, at + 9, at + 3)])]


def test_many_spans_in_one_text():
    t = "token=ab12cd34 " * 60_000
    base = secret_scan.base_spans(t)
    assert len(base) == 60_000
    assert secret_scan.candidates_of(t, base) == []
    f = secret_scan.Formats({"assign": ["ab12cd34"]}, {})
    assert "ab12cd34" not in secret_scan.redact(t, f)


def test_edges(spark):
    assert secret_scan.redact_stage(docs(spark, [])).collect() == []
    out = {r.doc_id: r.text for r in secret_scan.redact_stage(docs(spark, [(1, None), (2, ""), (3, "token=abc123 x"), (None, "secret: xyzzy9")])).collect()}
    assert out == {1: None, 2: "", 3: "token=[SECRET] x", None: "secret: [SECRET]"}
    clash = docs(spark, [(1, "token=abc123")]).selectExpr("*", "1 AS spans", "2 AS candidates", "3 AS added")
    assert secret_scan.redact_stage(clash).first().text == "token=[SECRET]"
    assert secret_scan.scan(clash).count() == 1
