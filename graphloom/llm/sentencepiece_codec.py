"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Words of equal length advance together, one character at a time. Hashes of the
substrings that end at the character probe the sorted keys of all pieces; the
best piece that may end there is kept as a backpointer, found by maxima over
the whole batch.

What may end there depends on the model's kind. In a unigram model the best
sum of piece scores wins. In a BPE model that sum is not what the merges
give, but the merges have an equivalent local form: a segmentation is the
merges' one if and only if every two neighbouring pieces are what the merges make of their
joint text. So a piece ends at a character if the pair of it and the piece
before it passes that test, exactly one passes, and its length is the score. The test of
a pair is made once in a worker and kept in a sorted table.

A long word without spaces is cut into overlapping slices that advance together
like words. What may end at a place depends on no more places before it than the longest piece
has characters, so where a slice agrees with the one before it at that many places in
a row, it agrees from there on; where they don't agree, the search goes on place by place.

Ids equal those of the SentencePiece library. The model's path is a
parameter; a model whose normaliser isn't the identity is refused.

Defined cases: null and empty texts have no ids; repeated rows are encoded
each; characters that no piece has become byte pieces; an empty table gives an
empty result; a literal U+2581 decodes to a space, as in the library; other
columns are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

SPACE = "▁"
#: Words that a worker remembers.
CACHE_WORDS = 1_000_000
#: Words of more characters are cut into slices of this length, which overlap by LAP.
SLICE, LAP = 1024, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Pieces of a model, and the search for a text's pieces."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], unigram: bool = False, unknown: int = 0):
        """pieces: text and score by id, "" for ids that aren't ordinary pieces. byte_ids: ids of the 256 byte pieces, or none."""
        self.text = [p for p, _ in pieces]
        self.score = np.array([s for _, s in pieces] + [min(s for _, s in pieces if s > -1e8) - 10.0])
        self.byte_ids, self.unigram, self.unknown = byte_ids, unigram, unknown
        self.id_of = {p: i for i, p in enumerate(self.text) if p}
        self.longest = max(map(len, self.id_of))
        self.none = len(pieces)  # stands for a character without a piece
        keys = np.array([self._hash(p) for p in self.id_of], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.id_of.values()))[order]
        assert (self.keys[1:] != self.keys[:-1]).all()
        # By length, which upper 16 bits the keys have: rules most substrings out before the search.
        self.maybe = np.zeros((self.longest + 1, 1 << 16), bool)
        for p in self.id_of:
            self.maybe[len(p), self._hash(p) >> 48] = True
        joint = {c for p in self.id_of if len(p) > 1 for c in p} - {SPACE}
        assert not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)
        some = "".join(map(re.escape, sorted(joint)))
        self.words = re.compile(f"{SPACE}*[{some}]+|{SPACE}+|.", re.S)
        self.pair_keys, self.pair_ok = np.array([-1, 1 << 62]), np.array([False, False])
        self.known: dict[str, bytes] = {}
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in self.text]
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in ("ﬁ  x", "Å é\t　"):
            if sp.decode(sp.encode(probe)) != probe:
                raise ValueError("the model's normaliser isn't the identity")
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        pieces = [("" if special[i] else sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in range(n)) else []
        # In BPE models the scores of pieces are the negated ranks of their merges.
        scores = [s for p, s in pieces if len(p) > 1]
        unigram = any(s != round(s) for s in scores)
        return cls(pieces, byte_ids, unigram, sp.unk_id())

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def merged(self, s: str) -> list[str]:
        """What the merges make of a short text: the best-scored neighbours join first, the leftmost of equals."""
        parts = list(s)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _pairs_pass(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the pieces may stand side by side; -1 before is the start of a word."""
        key = (before + 1) * (self.none + 1) + piece
        at = np.searchsorted(self.pair_keys, key)
        new = np.unique(key[self.pair_keys[at] != key])
        if len(new):
            ok = []
            for k in new.tolist():
                b, p = divmod(k, self.none + 1)
                right = self.text[p]
                left = "" if b == 0 else self.text[b - 1]
                ok.append(self.merged(left + right) == ([left, right] if left else [right]))
            where = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_ok = np.insert(self.pair_keys, where, new), np.insert(self.pair_ok, where, ok)
            at = np.searchsorted(self.pair_keys, key)
        return self.pair_ok[at]

    def _search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words that have the same length, for each place: the piece that ends there, its length and the best sum of scores."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size).astype(np.uint64)
        h = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            h[i + 1] = h[i] * _BASE + codes[:, i] + np.uint64(1)
        power = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(self.longest + 1)]
        last = np.full((size + 1, n), -1, np.int64)  # the piece that ends at each place
        width = np.zeros((size + 1, n), np.int64)  # the backpointer: its length
        total = np.full((size + 1, n), -np.inf)
        total[0] = 0
        every = np.arange(n)
        for i in range(1, size + 1):
            free = every  # words without a piece that ends here yet
            for k in range(min(i, self.longest), 0, -1):
                sub = h[i, free] - h[i - k, free] * power[k]
                hit = np.flatnonzero(self.maybe[k, (sub >> np.uint64(48)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, sub[hit]), len(self.keys) - 1)
                found = self.keys[at] == sub[hit]
                hit, at = hit[found], at[found]
                live, piece = free[hit], self.key_ids[at]
                if k == 1:  # a character that is no piece
                    lone = np.setdiff1d(free, live, assume_unique=True)
                    live, piece = np.concatenate([live, lone]), np.concatenate([piece, np.full(len(lone), self.none)])
                if not len(live):
                    continue
                if self.unigram:
                    best = total[i - k, live] + self.score[piece]
                    more = best > total[i, live]
                    live, piece = live[more], piece[more]
                    total[i, live] = best[more]
                else:
                    before = last[i - k, live]
                    ok = (before == self.none) | (piece == self.none)
                    ok[~ok] = self._pairs_pass(before[~ok], piece[~ok])
                    live, piece = live[ok], piece[ok]
                    closed = np.zeros(n, bool)
                    closed[live] = True
                    free = free[~closed[free]]
                last[i, live], width[i, live] = piece, k
                if not len(free):
                    break
        return last, width, total

    def _equal_length(self, words: list[str]) -> list[bytes]:
        """Ids of words that have the same length."""
        n, size = len(words), len(words[0])
        last, width, _ = self._search(words)
        every = np.arange(n)
        # All words walk their backpointers together; row r of `back` has the pieces from the r-th last on.
        back, at = [], np.full(n, size)
        while (at > 0).any():
            back.append(np.where(at > 0, last[at, every], -1))
            at = np.maximum(at - width[at, every], 0)
        grid = np.stack(back[::-1], 1).astype(np.int32)
        used = grid >= 0
        flat, ends = grid[used].tobytes(), np.cumsum(used.sum(1)) * 4
        out, lo = [], 0
        special = (grid == self.none).any(1)
        for w, hi in enumerate(ends.tolist()):
            out.append(flat[lo:hi] if not special[w] else self._with_bytes(words[w], grid[w][used[w]].tolist()))
            lo = hi
        return out

    def _next_place(self, word: str, i: int, last: np.ndarray, total: np.ndarray) -> None:
        """Fill place i of one word."""
        found = [(k, self.id_of[word[i - k : i]]) for k in range(min(i, self.longest), 0, -1) if word[i - k : i] in self.id_of]
        if not found or found[-1][0] > 1:
            found.append((1, self.none))
        if self.unigram:
            total[i], last[i] = max(((total[i - k] + self.score[p], p) for k, p in found), key=lambda x: x[0])
            return
        for k, p in found:
            before = int(last[i - k])
            if self.none in (before, p) or self._pairs_pass(np.array([before]), np.array([p]))[0]:
                last[i] = p
                return

    def _long(self, word: str) -> bytes:
        """Ids of a word of more than SLICE characters."""
        size = len(word)
        last, total = np.full(size + 1, -1, np.int64), np.zeros(size + 1)
        at = list(range(0, size - LAP, SLICE - LAP))
        by_length: dict[int, list[int]] = {}
        for s in at:
            by_length.setdefault(len(word[s : s + SLICE]), []).append(s)
        tables = {}
        for some in by_length.values():
            for k in range(0, len(some), 400):
                part = some[k : k + 400]
                x, _, z = self._search([word[s : s + SLICE] for s in part])
                tables |= {s: (x[:, j].astype(np.int32), z[:, j] if self.unigram else None) for j, s in enumerate(part)}
        done = 0
        for s in at:
            x, z = tables.pop(s)
            stop = s + len(x) - 1
            same = s == 0
            if s and done - s >= self.longest:
                lap = slice(done - s - self.longest + 1, done - s + 1)
                same = (x[lap] == last[s:][lap]).all()
                if same and self.unigram:
                    ahead = total[s:][lap] - z[lap]
                    same = np.ptp(ahead) < 1e-6
            if same:
                last[done + 1 : stop + 1] = x[done - s + 1 :]
                if self.unigram:
                    total[done + 1 : stop + 1] = z[done - s + 1 :] + (total[done] - z[done - s] if s else 0.0)
            else:
                for i in range(done + 1, stop + 1):
                    self._next_place(word, i, last, total)
            done = stop
        ids, i = [], size
        while i:
            ids.append(int(last[i]))
            i -= 1 if ids[-1] == self.none else len(self.text[ids[-1]])
        ids.reverse()
        return self._with_bytes(word, ids) if self.none in ids else np.array(ids, np.int32).tobytes()

    def _with_bytes(self, word: str, ids: list[int]) -> bytes:
        """ids in which byte pieces (or the unknown piece) take the place of characters that no piece has."""
        out, at = [], 0
        for p in ids:
            if p == self.none:
                out += [self.byte_ids[b] for b in word[at].encode()] if self.byte_ids else [self.unknown]
                at += 1
            else:
                out.append(p)
                at += len(self.text[p])
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        by_length: dict[int, list[str]] = {}
        for w in set().union(*cut).difference(self.known) if cut else ():
            by_length.setdefault(len(w), []).append(w)
        for size, words in sorted(by_length.items()):
            if size > SLICE:
                self.known.update((w, self._long(w)) for w in words)
                continue
            step = max(1, 400_000 // (size + 1))
            for k in range(0, len(words), step):
                self.known.update(zip(words[k : k + step], self._equal_length(words[k : k + step])))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in cut]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    at = path or model_path()
    return _codecs.get(at) or _codecs.setdefault(at, Codec.load(at))


#: Texts are encoded in groups of about so many characters, which bounds a task's memory.
GROUP_CHARS = 4_000_000


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip (decoding gives the text again) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)

        def block(ids, texts):
            got = c.encode(texts)
            same = [c.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(got, texts)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            flat = np.concatenate(got) if got else np.array([], np.int32)
            cols = [pa.array(ids, pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(same)]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "ids", "round_trip"])

        for b in batches:
            ids, texts, chars = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i), texts.append(t or "")
                chars += len(texts[-1])
                if chars > GROUP_CHARS:
                    yield block(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield block(ids, texts)

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.documents(spark, sf_dir).select("doc_id", "text"))
