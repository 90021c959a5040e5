"""Document fingerprints by winnowing.

A text's code points, lower-cased in A-Z and without white space, give rolling
hashes of all ``GRAM``-grams; of each window of ``WINDOW`` neighbouring grams the
least hash is kept, the rightmost of equal ones, with its place in the text. So
two texts that share GRAM + WINDOW - 1 such characters share a kept hash.
A fingerprint is the kept grams in text order, 16 hex digits each: hash, then
place (in code points of the text). The likeness of two fingerprints is the
Jaccard index of their hashes.

A document's successor (the next lower doc_id; after the last, the first) is
found without one global window. Rows are sorted by falling id, rows of equal ids by a hash of their texts, and dealt
out by ranges of that order, as many as there are shuffle partitions. The bounds are quantiles of a
sample, ``PER_RANGE`` rows of each range on average, which only bear on balance. Each range's first row also goes
to the range before, as its last successor. Texts are dealt out compressed, one by one. Rows that are alike in id and text may take
several ranges: they follow each other, so each is its own successor but for the last.

Defined cases: null and empty texts have the empty fingerprint, and two empty
fingerprints have likeness 1; a text shorter than a gram is one gram; rows with
equal ids follow each other by their texts' hashes, nulls come last; a lone document is
its own successor; an empty table gives an empty result; other columns are
never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRAM, WINDOW = 12, 8
#: Sampled rows of each range.
PER_RANGE = 30

_BASE = 0x9E3779B97F4A7C15 | 1
_POWER = [pow(_BASE, k, 1 << 64) for k in range(GRAM + 1)]


def _gram_hashes(c: np.ndarray) -> np.ndarray:
    """Hash of each gram, 32 bits: polynomials of 1, 2, 4, ... characters give those of GRAM."""
    if len(c) < GRAM:  # the whole text is one gram
        h = np.uint64(len(c))
        for x in c:
            h = h * np.uint64(_BASE) + x
        grams = np.array([h])
    else:
        width, at, whole, n = 1, 0, None, len(c) - GRAM + 1
        part = c
        while width <= GRAM:
            if GRAM & width:
                piece = part[at : at + n]
                whole = piece if whole is None else whole * np.uint64(_POWER[width]) + piece
                at += width
            if 2 * width <= GRAM:
                part = part[:-width] * np.uint64(_POWER[width]) + part[width:]
            width *= 2
        grams = whole
    grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (grams ^ (grams >> np.uint64(29))) >> np.uint64(32)


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    """Least key of each window, in a few steps of doubled width."""
    if len(keys) <= window:
        return keys.min(keepdims=True)
    width = 1
    while 2 * width <= window:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = window - width
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def winnow(text: str) -> np.ndarray:
    """Kept grams of a text in its order: hash << 32 | place, unsigned."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    solid = (codes > 32) & (codes != 0xA0) & (codes != 0x85)
    places = np.flatnonzero(solid).astype(np.uint64)
    if not len(places):
        return places
    c = codes[solid].astype(np.uint64)
    c += ((c >= 65) & (c <= 90)).astype(np.uint64) * np.uint64(32)
    with np.errstate(over="ignore"):
        h = _gram_hashes(c)
    # The least key of a window has the least hash, and of equal ones the highest place.
    last = np.uint64(0xFFFFFFFF)
    kept = _least((h << np.uint64(32)) | (last - places[: len(h)]), WINDOW)
    kept = kept[np.append(True, kept[1:] != kept[:-1])]
    return (kept & (last << np.uint64(32))) | (last - (kept & last))


def as_text(kept: np.ndarray) -> str:
    return kept.astype(">u8").tobytes().hex()


def hashes(kept: np.ndarray) -> np.ndarray:
    return np.unique(kept >> np.uint64(32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """text, whose last floor(n / 2) code points make way for the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _keys(ids: pa.Array, hashed: pa.Array) -> np.ndarray:
    """Place of each row in the order (falling ids, nulls last, then hashes) as bytes that sort alike."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros(len(ids), [("null", "u1"), ("id", ">u8"), ("hash", ">u8")])
    out["null"] = null
    top = np.uint64(1 << 63)
    out["id"] = np.where(null, np.uint64(0), (~ids.fill_null(0).to_numpy(zero_copy_only=False)).view(np.uint64) ^ top)
    out["hash"] = hashed.to_numpy(zero_copy_only=False).view(np.uint64) ^ top
    return out.view("S17")


class _Ranges:
    """Bounds between ranges, and the first key of each range that has rows. A key that is several bounds takes several ranges."""

    def __init__(self, sample: np.ndarray, n: int):
        sample = np.sort(sample)
        self.n = n
        self.bounds = sample[[len(sample) * k // n for k in range(1, n)]] if len(sample) else sample
        self.first: dict[int, bytes] = {}

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last range of each key."""
        last = np.searchsorted(self.bounds, keys, "right")
        return np.minimum(np.searchsorted(self.bounds, keys, "left") + 1, last), last

    def firsts(self, keys: np.ndarray) -> dict[int, bytes]:
        """The first of these keys in each range."""
        keys = np.unique(keys)
        out: dict[int, bytes] = {}
        first, last = self.of(keys)
        for i in np.flatnonzero(first < last).tolist():
            out |= dict.fromkeys(range(first[i], last[i]), keys[i])
        lead = np.flatnonzero(np.append(True, last[1:] != last[:-1])) if len(keys) else []
        return out | {int(last[i]): keys[i] for i in lead}

    def close(self, first: dict[int, bytes]) -> None:
        self.first = first
        order = sorted(first)
        self.after = dict(zip(order, order[1:] + order[:1]))
        self.before = {b: a for a, b in self.after.items()}


def _ranges(keyed: DataFrame, n: int) -> _Ranges:
    """Ranges of rows(doc_id, h). The driver gets the sample and one key of each range."""
    total = keyed.count()
    share = min(1.0, PER_RANGE * n / max(1, total))
    got = keyed.where(F.rand(7) < share).toArrow() if total else keyed.limit(0).toArrow()
    ids, hashed = (got.column(k).combine_chunks() for k in range(2))
    ranges = _Ranges(_keys(ids, hashed), n)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, bytes] = {}
        for b in batches:
            for at, key in ranges.firsts(_keys(b.column(0), b.column(1))).items():
                found[at] = min(key, found.get(at, key))
        cols = [pa.array(list(found), pa.int32()), pa.array([k.ljust(17, b"\0") for k in found.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["at", "key"])

    least = keyed.mapInArrow(firsts, "at int, key binary").groupBy("at").agg(F.min("key").alias("key")).collect()
    ranges.close({r["at"]: bytes(r["key"]) for r in least})
    return ranges


def _deal(ranges: _Ranges):
    """Maps batches of doc_id, text, h to those of at (range), ghost (1: only a successor), doc_id, text, h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, int] = {}
        sent = set()
        heads = set(ranges.first.values())
        for b in batches:
            keys = _keys(b.column(0), b.column(2))
            first, last = ranges.of(keys)
            at = last.copy()
            for i in np.flatnonzero(first < last).tolist():  # alike rows: the first of a task goes to the last range, which must have some
                k = met[keys[i]] = met.get(keys[i], -1) + 1
                at[i] = last[i] - k % (last[i] - first[i] + 1)
            ghosts = []
            for i in np.flatnonzero(np.isin(keys, np.array(list(heads), "S17"))).tolist():
                key = keys[i].ljust(17, b"\0")
                if key not in sent and ranges.first.get(int(first[i])) == key:
                    sent.add(key)
                    ghosts.append((i, ranges.before[int(first[i])]))
            rows = b.take(pa.array([*range(len(keys)), *[i for i, _ in ghosts]]))
            place = pa.array(np.concatenate([at, [k for _, k in ghosts]]).astype(np.int32))
            kind = pa.array(np.repeat([0, 1], [len(keys), len(ghosts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([place, kind, *rows.columns], ["at", "ghost", "doc_id", "text", "h"])

    return run


def _pack(text: str) -> bytes:
    """The text's UTF-8 in zstd, after its size in eight bytes."""
    data = text.encode()
    return len(data).to_bytes(8, "big") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> str:
    size = int.from_bytes(packed[:8], "big")
    return pa.decompress(memoryview(packed)[8:], size, codec="zstd", asbytes=True).decode()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id, text, h with packed texts."""
    for b in batches:
        text = pa.array([_pack(t) for t in b.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), text, b.column(2)], ["doc_id", "text", "h"])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA, a row for each row of df."""
    rows = df.select(df[id_col].cast("long").alias("doc_id"), common.whole_text(df, text_col).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"))
    n = common.partitions(df.sparkSession)
    ranges = _ranges(rows.select("doc_id", "h"), n)
    deal = _deal(ranges)
    dealt = rows.mapInArrow(lambda batches: deal(_packed(batches)), "at int, ghost int, doc_id long, text binary, h long").repartitionById(n, "at")
    dealt = dealt.sortWithinPartitions("at", "ghost", F.col("doc_id").desc_nulls_last(), "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, held = [], 0, None

        def finish(following, kept_next):
            _, _, doc, text, kept = held
            new = edited(text, following)
            again = winnow(new)
            mine = hashes(kept)
            return (
                doc, len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(kept), as_text(again),
                likeness(mine, hashes(again)), likeness(mine, hashes(kept_next)),
            )

        def flush():
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        def close():
            """The last row of a range that no ghost followed: alike rows go on in the next range."""
            if held is not None:
                at, key, _, text, kept = held
                if ranges.first[ranges.after[at]] != key:
                    raise RuntimeError("a range lacks its last successor")
                out.append(finish(text, kept))

        for b in batches:
            keys = _keys(b.column(2), b.column(4))
            for at, ghost, doc, packed, key in zip(*[c.to_pylist() for c in b.columns[:4]], keys.tolist()):
                if held is not None and held[0] != at:
                    close()
                    held = None
                if ghost and held is None:
                    continue
                text = _unpack(packed)
                kept = winnow(text)
                if held is not None:
                    out.append(finish(text, kept))
                    size += len(text)
                # Of a range's ghosts the first one counts.
                held = None if ghost else (at, key.ljust(17, b"\0"), doc, text, kept)
                if size > 1_000_000:
                    yield flush()
                    out, size = [], 0
        close()
        if out:
            yield flush()

    return dealt.mapInArrow(run, SCHEMA)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(common.documents(spark, sf_dir).select("doc_id", "text"))
