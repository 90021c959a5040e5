"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each document (good, bad or no vote).
Expectation-maximisation over the counts of all vote patterns (at most
3 ** labellers of them, whatever the corpus) estimates the share of good
documents and, for each class, how often each labeller gives each vote. That gives
every pattern a posterior; on a bounded sample of documents, about
``SAMPLE`` and at most twice as many, posteriors are the soft labels of a
linear scorer over hashed features (byte trigrams and bucketed measures),
which then scores every document by its whole text.

Defined cases: null and empty texts get a score like any other (all labellers
abstain); repeated rows are scored each; an empty table gives an empty result;
if no labeller ever votes bad, everything is kept; other columns are kept by
``filter_stage`` and ignored else.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 3000
BINS = 4096
#: Documents that score lower are rejected.
KEEP = 0.5
#: A text of this many words counts half by its features and half by the share of good documents.
HALF = 12

# Frequent short words of English, German, French and Spanish.
FREQUENT = set(
    "the of and to in a is that for it was on with he be by as at this are or from "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un une du que est pour dans qui par sur pas au avec "
    "el los las y del se por con una su para no lo al como".split()
)
_SYMBOL = re.compile(r"[#*$%&|<>=~^{}\\_]")

MEASURES = ("symbols", "capitals", "pipes", "shouts", "variety", "stutter", "echo", "length", "frequent")


def measures(text: str) -> tuple[int, list[float]]:
    """Number of words, and a value for each of MEASURES."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, [0.0] * len(MEASURES)
    letters = sum(map(len, words))
    low = text.lower().split()
    bare = [w.strip(".,;:!?") for w in low]
    seen = len(set(low))
    stutter = sum(a == b for a, b in zip(low, low[1:])) / n
    windows = list(zip(low, low[1:], low[2:]))
    echo = 1 - len(set(windows)) / len(windows) if windows else 0.0
    frequent = sum(w in FREQUENT for w in bare) / n
    capitals = sum(w.isupper() for w in words) / n
    return n, [len(_SYMBOL.findall(text)) / n, capitals, text.count("|") / n, text.count("!") / n, seen / n, stutter, echo, letters / n, frequent]


def _vote(value: float, good, bad) -> int:
    return 1 if good(value) else -1 if bad(value) else 0


#: A labeller: measure, fewest words it votes on, what is good, what is bad.
LABELLERS = [
    ("symbols", 1, lambda x: x < 0.03, lambda x: x > 0.15),
    ("capitals", 3, lambda x: x < 0.05, lambda x: x > 0.25),
    ("pipes", 5, lambda x: False, lambda x: x > 0.1),
    ("shouts", 5, lambda x: False, lambda x: x > 0.2),
    ("variety", 50, lambda x: x > 0.45, lambda x: x < 0.12),
    ("stutter", 10, lambda x: x < 0.03, lambda x: x > 0.2),
    ("echo", 20, lambda x: x < 0.1, lambda x: x > 0.3),
    ("length", 5, lambda x: 3 <= x <= 10, lambda x: x < 2 or x > 20),
    ("frequent", 20, lambda x: x > 0.15, lambda x: x < 0.05),
]


def votes(n: int, values: list[float]) -> list[int]:
    by = dict(zip(MEASURES, values))
    return [_vote(by[m], good, bad) if n >= least else 0 for m, least, good, bad in LABELLERS]


def pattern_of(v: list[int]) -> int:
    return sum((x + 1) * 3**k for k, x in enumerate(v))


def votes_of(pattern: int) -> list[int]:
    return [pattern // 3**k % 3 - 1 for k in range(len(LABELLERS))]


class VoteModel:
    """Share of good documents and each labeller's votes by class, by expectation-maximisation."""

    def __init__(self, counts: dict[int, int], rounds: int = 100):
        patterns = sorted(counts)
        v = np.array([votes_of(p) for p in patterns]).reshape(len(patterns), len(LABELLERS)) + 1
        w = np.array([counts[p] for p in patterns], float)
        # A document starts as good in proportion to its good votes, where one bad vote weighs as two good ones.
        good, bad = (v == 2).sum(1), (v == 0).sum(1)
        post = np.clip((good + 1) / (good + 2 * bad + 1.5), 0.05, 0.95)
        for _ in range(rounds):
            self.share = float((post * w).sum() / max(w.sum(), 1))
            self.rates = np.empty((2, len(LABELLERS), 3))
            for c, weight in enumerate((w * (1 - post), w * post)):
                for vote in range(3):
                    self.rates[c, :, vote] = ((v == vote) * weight[:, None]).sum(0) + 0.5
            self.rates /= self.rates.sum(2, keepdims=True)
            new = np.array([self.posterior(p) for p in patterns])
            if not len(new) or np.abs(new - post).max() < 1e-6:
                break
            post = new

    def posterior(self, pattern: int) -> float:
        """Probability that a document with these votes is good."""
        v = np.array(votes_of(pattern)) + 1
        at = np.arange(len(LABELLERS))
        share = min(max(self.share, 1e-3), 1 - 1e-3)
        odds = np.log(share / (1 - share)) + np.log(self.rates[1, at, v] / self.rates[0, at, v]).sum()
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


_EDGES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 2.0, 4.0, 8.0, 16.0)


def features(text: str, n: int, values: list[float]) -> np.ndarray:
    """Hashed features of a whole text: byte trigrams (damped, of length 1), and one bin for each measure's bucket."""
    out = np.zeros(BINS, np.float32)
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(data) > 2:
        h = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)
        out += np.sqrt(np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=BINS))
        out /= np.linalg.norm(out)
    if n:
        for name, x in zip(MEASURES, values):
            bucket = sum(x > e for e in _EDGES)
            out[zlib.crc32(f"{name} {bucket}".encode()) % BINS] += 1
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic scorer for soft labels y; all of x's precision, so that no product copies x."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    y = y.astype(x.dtype)
    w, m, s = (np.zeros(x.shape[1], x.dtype) for _ in range(3))
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ ((p - y) / x.dtype.type(max(1, len(y)))) + x.dtype.type(decay) * w
        m, s = x.dtype.type(0.9) * m + x.dtype.type(0.1) * g, x.dtype.type(0.999) * s + x.dtype.type(0.001) * g * g
        step = x.dtype.type(rate / np.sqrt(k) * 0.2 / (1 - 0.9**k))
        w -= step * m / (np.sqrt(s / x.dtype.type(1 - 0.999**k)) + x.dtype.type(1e-8))
    return w.astype(np.float64)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Weights of the linear scorer and the log-odds of a good document; None for a table without rows or without bad votes."""
    rows = df.select(df[id_col].cast("string").alias("doc_id"), df[text_col].alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern_of(votes(*measures(t or ""))) for t in b.column(0).to_pylist()], pa.int32())], ["pattern"])

    # At most 3 ** labellers rows reach the driver.
    counts = {r["pattern"]: r["count"] for r in common.map_arrow(rows.select("text"), vote, "pattern int").groupBy("pattern").count().collect()}
    total = sum(counts.values())
    if not any(-1 in votes_of(p) for p in counts):
        return None
    model = VoteModel(counts)

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, post = [], []
            for t in b.column(1).to_pylist():
                n, values = measures(t or "")
                data.append(features(t or "", n, values).astype(np.float16).tobytes())
                post.append(model.posterior(pattern_of(votes(n, values))))
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), pa.array(post)], ["x", "y"])

    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / total) * (1 << 30)))
    # The limit bounds repeated rows, which share a hash; its few rows are dealt out again for their features.
    drawn = rows.where(chosen).limit(2 * sample).repartition(common.partitions(df.sparkSession))
    got = common.map_arrow(drawn, vector, "x binary, y double").collect()
    if not got:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    share = min(max(model.share, 0.01), 0.99)
    return fit_linear(x, np.array([r["y"] for r in got])), float(np.log(share / (1 - share)))


def score_text(text: str, fitted: tuple[np.ndarray, float]) -> float:
    """Score of a text; the fewer its words, the less they say against the share of good documents."""
    weights, prior = fitted
    n, values = measures(text)
    z = float(features(text, n, values) @ weights[:-1] + weights[-1])
    z = (n * z + HALF * prior) / (n + HALF)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(df: DataFrame, fitted: tuple[np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [1.0 if fitted is None else score_text(t or "", fitted) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return common.map_arrow(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")), run, "doc_id long, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, fit(docs)).withColumn("kept", F.col("score") >= KEEP)


def filter_stage(docs: DataFrame, sample: int = SAMPLE, corpus: DataFrame | None = None) -> DataFrame:
    """docs without those that score below KEEP, in the same columns.

    The scorer is fitted to corpus (columns doc_id and text), or docs if there is none: where other stages have
    taken the bad documents out, what they were like is only to be seen in the rows before them.
    """
    fitted = fit((docs if corpus is None else corpus).select("doc_id", "text"), sample=sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [fitted is None or score_text(t or "", fitted) >= KEEP for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(kept, pa.bool_()))

    return common.map_arrow(docs, run, docs.schema)
