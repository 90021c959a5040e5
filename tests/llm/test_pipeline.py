"""The pipeline against a plain version of its stages, and its stages on odd tables."""

import random
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import common, packing, quality_classifier, quality_rules, secret_scan, simhash
from tests.llm.test_operators import TEXTS, docs, groups_of, plain_grams, plain_repeats

SF = "/root/testdata/sf0.001"


def plain_rules(rows):
    """rows (doc_id, text, source) that the rules keep."""
    measured = []
    for i, t, host in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = len(w) < 50 or 100 * plain_repeats(t) > 50 * len(w)
        soft = 5 * len(re.findall(r"[#*$%&|<>]", t)) > len(w) or 10 * (len(lines) - len(set(lines))) > 3 * len(lines) or sum(map(len, w)) > 20 * len(w)
        measured.append((i, host, base, soft))
    by = {}
    for _, host, base, soft in measured:
        n, bad = by.get(host, (0, 0))
        by[host] = (n + 1, bad + (base or soft))
    rates = [bad / n for n, bad in by.values()]
    m, v = np.mean(rates), np.var(rates, ddof=1) if len(rates) > 1 else 0
    fits = v > 0 and m * (1 - m) > v
    weight, mean = (m * (1 - m) / v - 1, m) if fits else (10.0, 0.1)
    rate = {h: (bad + weight * mean) / (n + weight) for h, (n, bad) in by.items()}
    keep = {i for i, host, base, soft in measured if not base and not (soft and rate[host] > 0.05) and rate[host] <= 0.9}
    return [r for r in rows if r[0] in keep]


def plain_near(rows):
    sets = [plain_grams(t) for _, t, _ in rows]
    like = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    comp = groups_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if like(sets[i], sets[j])])
    return [r for k, r in enumerate(rows) if comp[k] == k]


def test_run_equals_plain_stages(spark):
    """Rules and near-dedup are plain here; the classifier's and the automata's models are taken, and applied one text at a time."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    table = common.documents(spark, SF)
    rows = sorted((r.doc_id, r.text, r.source) for r in table.collect())
    rows = plain_rules(rows)
    fitted = quality_classifier.fit(table.select("doc_id", "text"))
    rows = [r for r in rows if quality_classifier.score_text(r[1] or "", fitted) >= quality_classifier.KEEP]
    rows = plain_near(rows)
    kept = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    formats = secret_scan.infer(common.materialize(secret_scan.found(kept)))
    library = Tokenizer.from_file(packing.tokenizer_path())
    want = set()
    for i, t, _ in rows:
        ids = np.array(library.encode(secret_scan.redact(t or "", formats), add_special_tokens=False).ids + [0], "<u4")
        want |= {(i, k, lo, len(ids[lo : lo + 2048]), zlib.crc32(ids[lo : lo + 2048].tobytes())) for k, lo in enumerate(range(0, len(ids), 2048))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places[:-1]]]).tolist() and sum(n for _, n in places) <= 2048


def test_classifier_rejects_bad_documents(spark):
    d = "/root/testdata/sf0.1"
    table = common.documents(spark, d).select("doc_id", "text")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    kept = {r.doc_id for r in quality_classifier.filter_stage(table, corpus=table).select("doc_id").collect()}
    good, bad = ([i in kept for i, q in labels.items() if q == x] for x in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.02


def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_tables(spark, k):
    name, stage = stages()[k]
    empty = docs(spark, [])
    assert stage(spark, empty, SF).collect() == []
    rows = [(None, None), (1, None), (2, ""), (3, TEXTS[10]), (3, TEXTS[10]), (4, TEXTS[10]), (5, "token=abc123 " + TEXTS[16]), (6, "z" * 50_000)]
    wide = docs(spark, rows).selectExpr("*", "1 AS n_words", "2 AS score", "3 AS kept", "4 AS host", "5 AS fp", "6 AS spans", "7 AS task", "8 AS length")
    out = stage(spark, wide, SF)
    got = out.collect()
    if name == "packing":
        assert sum(r.piece == 0 for r in got) == len(rows)
        assert sum(r.length for r in got if r.doc_id in (1, 2)) == 2
        return
    assert out.columns == wide.columns
    ids = [r.doc_id for r in got]
    if name == "quality_rules":
        assert set(ids) <= {3, 4, 5}
    if name == "near_dedup":
        assert ids.count(3) == 1 and 4 not in ids and {1, 5, 6} <= set(ids) and 2 not in ids
    if name == "secrets":
        assert len(got) == len(rows) and next(r for r in got if r.doc_id == 5).text.startswith("token=[SECRET] ")


def test_texts_that_share_a_passage_stay_apart(spark):
    """Many sets that meet at the same hashes, cut into cells; a group of many near copies; all against all pairs."""
    rnd = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"q{rnd.randrange(5000)}" for _ in range(rnd.randrange(20, 200)))) for k in range(150)]
    base = [f"b{rnd.randrange(900)}" for _ in range(150)]
    for k in range(200):
        w = list(base)
        w[rnd.randrange(150)] = f"c{k}"
        rows.append((len(rows), " ".join(w)))
    rnd.shuffle(rows)
    want = {i for i, _, _ in plain_near(sorted((i, t, None) for i, t in rows))}
    assert {r.doc_id for r in simhash.filter_stage(docs(spark, rows)).collect()} == want
    old = simhash.MEET_ROWS
    sets = common.materialize(simhash.gram_sets(docs(spark, rows), np.array([], np.int64)))
    met = common.materialize(simhash.meetings(sets, 2)).join(sets.select("fp", "n", "sim").distinct(), "fp").select("h", "n", "fp", "sim")
    none = spark.createDataFrame([], "member long, root long")
    whole = {tuple(r) for r in simhash.other_pairs(met, none, 2).collect()}
    assert whole == {tuple(r) for r in simhash.other_pairs(met, none, 2, 30).collect()} and old == 20_000
