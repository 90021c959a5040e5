"""Fingerprints and likenesses of all rows against the definition, and successors however rows are dealt out."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from graphloom.llm import winnowing
from tests.llm.test_operators import IDS, TEXTS, docs

SF = "/root/testdata/sf0.001"


def plain_hashes(chars):
    """Hash of each gram by its polynomial, whole numbers."""
    mask, g = (1 << 64) - 1, winnowing.GRAM
    out = []
    for gram in [chars[i : i + g] for i in range(len(chars) - g + 1)] or [chars]:
        h = len(gram) if len(chars) < g else 0
        for c in gram:
            h = (h * winnowing._BASE + c) & mask
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & mask
        out.append((h ^ (h >> 29)) >> 32)
    return out


def plain_winnow(text):
    solid = [(i, ord(c) + 32 * (65 <= ord(c) <= 90)) for i, c in enumerate(text) if ord(c) > 32 and ord(c) not in (0xA0, 0x85)]
    if not solid:
        return []
    h, w = plain_hashes([c for _, c in solid]), winnowing.WINDOW
    kept = []
    for lo in range(max(1, len(h) - w + 1)):
        best = min(range(lo, min(lo + w, len(h))), key=lambda j: (h[j], -j))
        if not kept or kept[-1][1] != solid[best][0]:
            kept.append((h[best], solid[best][0]))
    return kept


def plain(rows):
    """What the contract and the docstring say, of all rows."""
    order = sorted([(i, t or "") for i, t in rows], key=lambda x: (x[0] is None, -(x[0] or 0), np.int64(np.uint64(xxhash.xxh64_intdigest(x[1].encode(), 42)))))
    known = {}

    def prints(t):
        if t not in known:
            known[t] = plain_winnow(t)
        return known[t]

    def like(a, b):
        a, b = {h for h, _ in prints(a)}, {h for h, _ in prints(b)}
        return len(a & b) / len(a | b) if a and b else float(len(a) == len(b))

    text = lambda t: "".join(f"{h << 32 | i:016x}" for h, i in prints(t))
    out = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(t), text(e), round(like(t, e), 9), round(like(t, following), 9)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in winnowing.fingerprints_with_edits(df).collect()], key=repr)


def test_whole_table_equals_definition(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(spark.read.parquet(f"{SF}/documents.parquet")) == plain(rows)


@pytest.fixture
def many_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("n", [1, 2, 13, 60])
def test_edge_cases_however_dealt(spark, many_partitions, n):
    many_partitions(n)
    rows = list(zip(IDS, [t if t is None else t[:400] for t in TEXTS]))
    # A third of the rows alike in id and text, equal ids with other texts, missing ids.
    rows += [(9, "one text of many equal rows")] * 40 + [(9, f"another {k} of the id") for k in range(12)] + [(None, "x y z")] * 5
    rows += [(k, f"text number {k} of them") for k in range(100, 150)]
    random.Random(2).shuffle(rows)
    assert got(docs(spark, rows).repartition(5)) == plain(rows)


def test_one_row_and_alike_rows(spark, many_partitions):
    many_partitions(8)
    assert got(docs(spark, [(4, "a lone text of one row")])) == plain([(4, "a lone text of one row")])
    assert got(docs(spark, [(4, "alike")] * 30)) == plain([(4, "alike")] * 30)
    assert got(docs(spark, [(None, None)] * 3)) == plain([(None, None)] * 3)
    assert got(docs(spark, []).selectExpr("*", "1 AS at", "2 AS ghost", "3 AS h")) == []


def test_ranges_stay_even(spark):
    n = 1000
    rows = spark.range(200_000).selectExpr("id * 7 AS doc_id", "CAST(id % 5 AS STRING) AS text", "xxhash64(id) AS h")
    ranges = winnowing._ranges(rows.select("doc_id", "h"), n)
    dealt = rows.mapInArrow(winnowing._deal(ranges), "at int, ghost int, doc_id long, text string, h long").where("ghost = 0")
    counts = [r["count"] for r in dealt.groupBy("at").count().collect()]
    assert len(counts) == n and max(counts) < 3 * 200_000 / n


def test_shuffle_is_smaller_than_the_texts(spark, many_partitions):
    """Texts are dealt out compressed."""
    many_partitions(4)
    rnd = random.Random(4)
    words = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 9))) for _ in range(1500)]
    texts = docs(spark, [(k, " ".join(rnd.choices(words, k=500))) for k in range(300)])

    def written(df):
        """Bytes of the rows that the exchange of texts writes, by its metric."""
        df.collect()
        plan, sizes = df._jdf.queryExecution().executedPlan(), []
        stack = [plan.executedPlan() if "Adaptive" in plan.nodeName() else plan]
        while stack:
            node = stack.pop()
            metric = node.metrics().get("dataSize")
            if metric.isDefined():
                sizes.append(metric.get().value())
            if "QueryStage" in node.nodeName():
                stack.append(node.plan())
            stack += [node.children().apply(k) for k in range(node.children().size())]
        return max(sizes)

    size = sum(len(r.text) for r in texts.collect())
    assert 0 < written(winnowing.fingerprints_with_edits(texts)) < 0.7 * size
    assert all(winnowing._unpack(winnowing._pack(t)) == t for t in ["", "x", "日本\U0001F600\n", "ab" * 50_000])
