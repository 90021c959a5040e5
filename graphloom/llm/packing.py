"""Bulk-synchronous best-fit packing of tokenised documents.

Documents become pieces of at most ``CAPACITY`` tokens, and pieces are packed
into sequences of that capacity. Best fit is done in bulk: pieces and gaps are
range-sorted by size; in each superstep the pieces of one size sweep the gaps
from their successor (the smallest gap that holds them) upwards; conflicts are
resolved by rank (the piece with rank r among those of its size takes the
place with number r among the swept gaps); the gaps shrink, and the next
superstep starts. Where no gap is left, sequences are opened.

Pieces of one size are interchangeable, and so are gaps of one size. As sizes
are whole numbers up to CAPACITY, pieces and gaps both sort into at most
CAPACITY classes, whatever the corpus. So the sweep moves runs of ranks between
class tables on the driver (at most CAPACITY counts in, a few runs for each class
out), and what grows with the corpus stays on the cluster: tokenising, ranks
(a task numbers its own pieces of each size, and sums over tasks give the
rest) and each piece's place, by a join of its size and rank with the runs.

Defined cases: a null or empty text is the single token 0; repeated rows are
packed each; an empty table gives an empty result; a null doc_id stays null;
other columns are never looked at. Ties do not matter: equal sizes are equal.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
#: New words after which a worker forgets those it hasn't met since it last did so; it holds twice as many, of some 200 bytes each.
CACHE_WORDS = 200_000

#: White space beyond ASCII, a letter whose lower case depends on its place: encoded by the library as a whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0Σ ᠎ -​    　﻿]")


# Ranges of characters whose class, lower case and normal form no edition of Unicode has changed for long. The library's
# tables may be newer or older than Python's; a word with any other character is encoded by the library.
_SETTLED = re.compile(r"[!-~\u00a1-\u024f\u0391-\u03a1\u03a4-\u03a9\u03b1-\u03c9\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Known(dict):
    """Words' ids; a word that is asked for first is encoded then. Frequent words outlive age()."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        self[word] = ids = self.encode(word) if ids is None else ids
        return ids

    def age(self) -> None:
        """Forget what wasn't asked for since the last call."""
        self.old = dict(self)
        self.clear()


class Tokens:
    """A text's ids as little-endian unsigned 32-bit bytes. Words are looked up; the library encodes a new word once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.known = _Known(self._word)

    @staticmethod
    def _bytes(ids) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _part(self, part: str) -> bytes:
        """Ids of a piece that the vocabulary's own splitting leaves whole."""
        mapped = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return self._bytes([t.id for t in self.model.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        """Ids of a word in normal form C."""
        if not _SETTLED.fullmatch(word):
            return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        if low != word and _SETTLED.fullmatch(low):
            return self.known[low]
        if low.isalpha() or len(low) == 1:
            return self._part(low)
        core = low[:-1]
        if core.isalpha() and low[-1] in ".,;:!?|":  # letters, then one mark: two pieces
            return self.known[core] + self.known[low[-1]]
        return b"".join(map(self._part, self.split.findall(low)))

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text) or "<|" in text or not unicodedata.is_normalized("NFC", text):
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.known) > CACHE_WORDS:
            self.known.age()
        return b"".join(map(self.known.__getitem__, text.split()))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_tokens: dict[str, Tokens] = {}


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, for ranks, the task and the piece's number among those of its length there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = path or tokenizer_path()
        tokens = _tokens.get(at) or _tokens.setdefault(at, Tokens(at))
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            ids, piece, start, length, crc, nth = [], [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = tokens(text or "") + b"\0\0\0\0"
                for k, lo in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[lo : lo + 4 * capacity]
                    n = len(part) // 4
                    seen[n] = seen.get(n, -1) + 1
                    ids.append(doc), piece.append(k), start.append(lo // 4), length.append(n)
                    crc.append(zlib.crc32(part)), nth.append(seen[n])
            cols = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            cols += [pa.array(crc, pa.int64()), pa.array([task] * len(ids), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return common.map_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces in each sequence, offset in it) that pack counts[length] pieces of each length."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: ranges (first sequence, sequences)
    sizes: list[int] = []
    runs, opened = [], 0

    def add(size: int, first: int, n: int) -> None:
        if n and size:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                each = capacity // length
                add(capacity, opened, -(-left // each))
                opened += -(-left // each)
                continue
            size = sizes[at]
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                sizes.pop(at)
            each = size // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, whole * each, first, each, capacity - size))
                add(size - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if left and whole < n:  # too few pieces left to fill one more gap
                runs.append((length, rank, left, first + whole, left, capacity - size))
                add(size - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            add(size, first + whole, n - whole)
    return runs


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    spark = df.sparkSession
    cut = common.materialize(pieces(df, id_col, text_col, path, capacity))
    # At most `capacity` rows.
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = spark.createDataFrame(
        best_fit(counts, capacity), "length long, run_rank long, run_n long, run_first long, run_each long, run_offset long"
    )
    held = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = held.select("task", "length", F.expr("sum(n) OVER (PARTITION BY length ORDER BY task) - n").alias("before"))
    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    # The runs are a few for each of at most `capacity` lengths.
    placed = ranked.join(
        F.broadcast(runs.withColumnRenamed("length", "run_length")),
        (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("run_rank")) & (F.col("rank") < F.col("run_rank") + F.col("run_n")),
    )
    step = F.col("rank") - F.col("run_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run_first") + F.floor(F.expr("(rank - run_rank) div run_each"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + (step % F.col("run_each")) * F.col("length")).cast("long").alias("offset"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir).select("doc_id", "text"))
