"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and their openings of four and
five characters, hashed into ``BUCKETS``. The machine gives every bucket a
weight and a vector of ``FACTORS``; besides the sum of weights, all pairs of
terms interact by the products of their vectors, so that an insult weighs more
beside a group's name than alone. It learns from a bounded sample of labelled
rows, at most ``SAMPLE`` of each label, those with the least hashes of
their ids; ``TERMS`` buckets that tell the labels apart best take part. Scores are
calibrated so that the cut with the best F1 on a part of the sample that
the weights weren't learnt from is a score of ``CUT``.

Rows whose crc32(doc_id as text) modulo 3 is 1 are held out: never learnt from.
Labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null or empty text has no terms and gets the base score;
a null doc_id counts as held out; of several labels for an id the greatest counts,
and of several texts any one is learnt from;
without labels of both kinds every score is 0; repeated rows are scored
each; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, BUCKETS, TERMS, FACTORS, CUT = 4000, 1 << 20, 3000, 6, 0.7
CACHE_WORDS = 400_000
_EDGE = ".,;:!?()[]{}\"'#*$%&|<>-_=+/"


def word_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a lower-cased word's terms."""
    w = word.strip(_EDGE)
    if not w:
        return ()
    terms = [f"w{w}"] + [f"{k}{w[:k]}" for k in (4, 5) if len(w) > k]
    return tuple(zlib.crc32(t.encode()) % BUCKETS for t in terms)


def text_buckets(text: str) -> np.ndarray:
    return np.array(sorted({b for w in set(text.lower().split()) for b in word_buckets(w)}), np.int32)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


class Machine:
    """A factorization machine over the chosen buckets."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.slots: dict[int, int] = {}
        order = rng.permutation(len(rows))
        cut = len(order) * 4 // 5
        learn, check = order[:cut], order[cut:]
        self._choose([rows[i] for i in learn], labels[learn])
        n = len(self.slots)
        self.w0, self.w, self.v = 0.0, np.zeros(n), rng.normal(0, 0.05, (n, FACTORS))
        self._learn([self.of_buckets(rows[i]) for i in learn], labels[learn], rng)
        self.scale, self.shift = 1.0, 0.0
        self._calibrate(np.array([self.raw(self.of_buckets(rows[i])) for i in check]), labels[check])

    def _choose(self, rows, labels) -> None:
        """The buckets with the greatest chi-squared between the labels, among those in five rows or more."""
        n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
        one = [r for r, y in zip(rows, labels) if y]
        none = [r for r, y in zip(rows, labels) if not y]
        count = lambda rs: np.bincount(np.concatenate([np.array([], np.int32), *rs]), minlength=BUCKETS)
        c1, c0 = count(one), count(none)
        p = (c1 + c0) / (n1 + n0)
        chi = (c1 / n1 - c0 / n0) ** 2 / np.maximum(p * (1 - p), 1e-9)
        chi[(c1 + c0) < 5] = 0
        best = np.argsort(-chi, kind="stable")[:TERMS]
        self.slots = {int(b): k for k, b in enumerate(best[chi[best] > 6.6 * (1 / n1 + 1 / n0)])}

    def of_buckets(self, buckets) -> np.ndarray:
        return np.array([self.slots[b] for b in np.asarray(buckets).tolist() if b in self.slots], np.int64)

    def raw(self, slots: np.ndarray) -> float:
        v = self.v[slots]
        s = v.sum(0)
        return self.w0 + self.w[slots].sum() + 0.5 * float((s * s).sum() - (v * v).sum())

    def _learn(self, rows, labels, rng, rounds: int = 12, rate: float = 0.1, decay: float = 2e-3) -> None:
        g0, gw, gv = 1e-6, np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(rounds):
            for i in rng.permutation(len(rows)).tolist():
                at = rows[i]
                v = self.v[at]
                s = v.sum(0)
                z = self.w0 + self.w[at].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
                d = 1 / (1 + np.exp(-min(max(z, -30), 30))) - labels[i]
                g0 += d * d
                self.w0 -= rate * d / np.sqrt(g0)
                if len(at):
                    g = d + decay * self.w[at]
                    gw[at] += g * g
                    self.w[at] -= rate * g / np.sqrt(gw[at])
                    h = d * (s - v) + decay * v
                    gv[at] += h * h
                    self.v[at] -= rate * 0.5 * h / np.sqrt(gv[at])

    def _calibrate(self, raw: np.ndarray, labels: np.ndarray) -> None:
        """Shift of the raw score that puts the cut with the best F1 at CUT; among equal cuts the middle."""
        if not len(raw) or not labels.any() or labels.all():
            return
        order = np.argsort(raw)
        r, y = raw[order], labels[order]
        hit = np.cumsum(y[::-1])[::-1]  # caught if the cut is just below each row
        f1 = 2 * hit / (np.arange(len(y), 0, -1) + y.sum())
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        k = int(best[len(best) // 2])
        cut = r[k] - 1e-6 if k == 0 else (r[k - 1] + r[k]) / 2
        self.shift = float(np.log(CUT / (1 - CUT)) - cut)

    def score(self, slots: np.ndarray) -> float:
        z = self.scale * self.raw(slots) + self.shift
        return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """A machine for docs(doc_id, text) and labels(doc_id, toxic); at most 2 * sample texts' buckets reach the driver."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = None
    for y in (0, 1):
        part = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = common.materialize(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [text_buckets(t or "").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["y", "data"])

    # At most 2 * sample ids.
    texts = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select(F.col("y").cast("int").alias("y"), "text")
    got = texts.mapInArrow(run, "y int, data binary").collect()
    y = np.array([r["y"] for r in got], float)
    if not len(y) or not y.any() or y.all():
        return None
    order = sorted(range(len(got)), key=lambda i: (got[i]["y"], bytes(got[i]["data"])))  # whatever order the tasks ended in
    return Machine([np.frombuffer(got[i]["data"], np.int32) for i in order], y[order])


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                slots = set()
                if machine is not None:
                    words = set((text or "").lower().split())
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    for w in words.difference(known):
                        known[w] = tuple(machine.slots[x] for x in word_buckets(w) if x in machine.slots)
                    for w in words:
                        slots.update(known[w])
                out.append(0.0 if machine is None else machine.score(np.array(sorted(slots), np.int64)))
            cols = [b.column(0), b.column(1), pa.array(out, pa.float64()), pa.array([int(s >= CUT) for s in out], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, fit(docs, labels))
