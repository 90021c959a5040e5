"""SimHash near-duplicate groups by a binary trie self-join.

Fingerprints are 64-bit majorities of the XXH64 hashes of 4-word shingles; two
fingerprints link if at most ``ERRORS`` = 4 bits differ, and linked
fingerprints form groups.

The self-join walks a binary trie from its root in pairs of nodes, adds up the
bits in which the two sides differ, and drops a pair when its errors exceed the
budget of its depth. One trie with one budget would branch far too widely near
the root, so the 64 bits are cut into five blocks and the walk is made once
from each block on, in circular order. If at most four bits differ, then from
one of the five starts the first k blocks together differ in at most k - 1
bits, for every k: that is the budget (0, 1, 2, 3, 4 by block), and no link is
lost. As the first block allows no error, its 13 bits deal the tries out to
tasks: a cell is one subtrie. A cell with more than ``CELL_ROWS`` fingerprints
is cut into pieces, and every pair of pieces becomes a cell of its own, so that
a task's memory is bounded whatever the data.

A cell returns links that span its groups, at most one for each fingerprint,
not all pairs; node pairs whose leaves already belong to one group are dropped
from the walk. The spanning links of all cells are contracted by alternating
large-star and small-star steps on the cluster.

The pipeline's stage has another rule: texts whose sets of five-word shingles
have a Jaccard index of 0.8 or more. Its candidates are the links of the same self-join on SimHash fingerprints of these sets,
and, as four bits are too few for all such pairs, sets that meet: two such sets share one of the hashes that come first in a fixed
order (a prefix of a fifth), so sets are dealt out by the hashes of their prefixes. The
order is by value, but hashes that are frequent in a sample of the texts come last, so that passages that many
documents share don't bring these together. (Any order loses no pair; the sample only bears on the work.) Where
sets meet, a Hamming budget prunes: of ``WIDE`` SimHash bits, such sets differ in some 15 % on average, and pairs over
``WIDE_BITS`` are dropped (sets of under ``FEW`` shingles, whose bits say less, are all kept). A pair of index 0.8 is beyond
it with a probability of 1e-17. No step gives all pairs: a cell returns candidates that span its groups, candidates that reach each
other form a block, and the texts of a block go to one task (a block of over ``BLOCK_GRAMS`` shingles is cut like a cell), where all
pairs that are not yet in one group are compared by their shingles and the links that span the groups are returned.

Defined cases: null and empty texts have fingerprint zero and link like any
other; copies and repeated rows share a fingerprint and so a group; a null
doc_id never names a group unless all of its ids are null; an empty table gives
an empty result; other columns are kept by ``filter_stage`` and ignored else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, SEED, ERRORS = 4, 42, 4
#: The pipeline's stage: words of a shingle, bits of ``sim`` that may differ in other_pairs, and shingles of a set that is too small for tests of bits.
WORDS, NEAR_BITS, FEW = 5, 24, 40
#: SimHash bits where sets meet, in columns of 64, and how many of them may differ.
WIDE, WIDE_BITS = 256, 96
SIMS = ["sim", *(f"sim{k}" for k in range(1, WIDE // 64))]
#: One text in COUNTED is sampled for frequent shingles; those of OFTEN texts or more are, but no more than MOST_FREQUENT.
COUNTED, OFTEN, MOST_FREQUENT = 16, 3, 1_000_000
#: As many ids of texts to be verified are broadcast (8 MB); more are joined by a shuffle.
FEW_IDS = 1_000_000
#: Shingles of a block that are compared in one task; more are cut into pieces, and each pair of pieces is a cell.
BLOCK_GRAMS = 1_000_000
#: Sets that meet at one hash and are compared in one task; more are cut into pieces, and each pair of pieces is a cell.
MEET_ROWS = 20_000
#: Cells of so many rows at most are compared many at a time.
SMALL = 32
#: Width of the blocks, from the highest bit down.
BLOCKS = (13, 13, 13, 13, 12)
CELL_ROWS = 1_000_000
#: Node pairs with at most this many leaf pairs are compared directly.
LEAF_PAIRS = 64
#: Node pairs walked at once in a task.
FRONT = 200_000


# Fingerprints


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, white space as in the contract
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
    hashes = np.array(
        [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the bit matrix of a long text
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return common.map_arrow(rows, run, "doc_id long, fp long")


# Trie self-join of one cell


def budget_of(turn: int) -> np.ndarray:
    """Errors allowed at each depth from 0 to 64 by a walk that starts at block ``turn``."""
    out = [0]
    for k, width in enumerate(BLOCKS[turn:] + BLOCKS[:turn]):
        out += [k] * width
    return np.array(out)


class _Groups:
    """Groups of the leaves of one cell."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.run_end = np.arange(1, n + 1)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = np.arange(len(self.of))
        while True:
            x, y = parent[self.of[a]], parent[self.of[b]]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (parent != (up := parent[parent])).any():
                parent = up
        self.of = parent[self.of]
        last = np.flatnonzero(np.append(self.of[1:] != self.of[:-1], True)) + 1
        self.run_end = last[np.searchsorted(last, np.arange(len(self.of)), side="right")]

    def one(self, lo, hi, lo2, hi2) -> np.ndarray:
        """Pairs of nodes whose leaves are all in one group."""
        return (self.run_end[lo] >= hi) & (self.run_end[lo2] >= hi2) & (self.of[lo] == self.of[lo2])


def trie_links(values: np.ndarray, sides: np.ndarray, turn: int = 0, errors: int = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one cell's values (uint64, turned so that block ``turn`` is on top).

    sides: 0 and 1 for the two pieces of a cut cell, which are compared with
    each other only; a cell with one side is compared with itself. Returns the
    linked values in two arrays.
    """
    order = np.lexsort((values, sides))
    v, n = values[order], len(values)
    cut = int(np.searchsorted(sides[order], 1))
    groups = _Groups(n)
    start = [[0, n, 0, n, 0]] if cut in (0, n) else [[0, cut, cut, n, 0]]
    budget = budget_of(turn)
    stack = [(min(BLOCKS), np.array(start))]  # the cell's fingerprints agree that far
    below: dict[int, np.ndarray] = {}
    while stack:
        d, pairs = stack.pop()
        if len(pairs) > FRONT:
            stack.append((d, pairs[FRONT:]))
            pairs = pairs[:FRONT]
        a0, a1, b0, b1, err = pairs.T
        same = a0 == b0
        live = (a1 > a0) & (b1 > b0) & (err <= min(budget[d], errors)) & ~(same & (a1 - a0 < 2))
        pairs = pairs[live]
        pairs = pairs[~groups.one(*pairs.T[:4])]
        if not len(pairs):
            continue
        a0, a1, b0, b1, err = pairs.T
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (d >= 64)
        if small.any():
            s = pairs[small]
            for k in range(0, len(s), 20_000):
                i, j = _leaf_pairs(s[k : k + 20_000])
                close = np.bitwise_count(v[i] ^ v[j]) <= errors
                if close.any():
                    groups.join(i[close], j[close])
            pairs = pairs[~small]
            if not len(pairs):
                continue
            a0, a1, b0, b1, err = pairs.T
        if d not in below:  # ones up to each place, in the bit that splits nodes of this depth
            below[d] = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)])
        ones = below[d]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        cross = pairs[~same]
        x, y = am[~same], bm[~same]
        stack.append(
            (
                d + 1,
                np.concatenate(
                    [
                        np.stack([a0, am, b0, bm, err], 1),
                        np.stack([am, a1, bm, b1, err], 1),
                        np.stack([a0, am, bm, b1, err + 1], 1),
                        np.stack([x, cross[:, 1], cross[:, 2], y, cross[:, 4] + 1], 1),
                    ]
                ),
            )
        )
    child = np.flatnonzero(groups.of != np.arange(n))
    return v[child], v[groups.of[child]]


def _leaf_pairs(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All leaf pairs of the given node pairs."""
    a0, a1, b0, b1 = nodes[:, :4].T
    size, width = (a1 - a0) * (b1 - b0), b1 - b0
    which = np.repeat(np.arange(len(nodes)), size)
    at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return a0[which] + at // width[which], b0[which] + at % width[which]


def _turn(values: np.ndarray, bits: int) -> np.ndarray:
    bits %= 64
    return (values << np.uint64(bits)) | (values >> np.uint64(64 - bits)) if bits else values


OFFSETS = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]


def _cells(rows: DataFrame, keys: list[str], cell_rows: int, weight: str | None = None) -> DataFrame:
    """rows(fp, ...) with i, j, side: groups of equal keys with more rows (or more weight) are cut into pieces, and each row goes to the pairs of pieces that its own is in."""
    big = rows.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("count")).where(F.col("count") > cell_rows)
    big = big.select(*keys, F.ceil(F.col("count") / (cell_rows / 2)).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    cells = F.when(
        F.col("pieces").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("pieces") - 1),
            lambda o: F.struct(
                F.least(piece, o).alias("i"), F.greatest(piece, o).alias("j"), (piece > o).cast("int").alias("side")
            ),
        )
    )
    rest = [c for c in rows.columns if c not in keys]
    return rows.join(big, keys, "left").select(*rest, *keys, F.explode(cells).alias("c")).select(*rest, *keys, "c.i", "c.j", "c.side")


def _by_cell(batches: Iterator[pa.RecordBatch], keys: slice) -> Iterator[list[np.ndarray]]:
    """The columns of each run of equal keys, whatever the batches."""
    held, key = [], None
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        k = np.stack(cols[keys], 1)
        edge = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *edge], [*edge, len(k)]):
            if hi == lo:
                continue
            if key is not None and tuple(k[lo]) != key:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            key = tuple(k[lo])
            held.append([c[lo:hi] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _whole_cells(batches: Iterator[pa.RecordBatch], keys: slice) -> Iterator[list[np.ndarray]]:
    """Columns with as many whole runs of equal keys as a batch completes."""
    held = None
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        k = np.stack(cols[keys], 1)
        edge = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        cut = int(edge[-1]) if len(edge) else 0
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def links(fps: DataFrame, parts: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """a, b: links that span the groups of the distinct fingerprints in fps.fp."""
    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(o).alias("bits")) for k, o in enumerate(OFFSETS)]))
    rows = fps.select("fp", starts.alias("s")).select("fp", "s.turn", "s.bits")
    # A cell is the 12 top bits, the width of the narrowest block.
    turned = F.expr("CASE WHEN bits = 0 THEN fp ELSE shiftleft(fp, bits) | shiftrightunsigned(fp, 64 - bits) END")
    rows = rows.select("fp", "turn", F.shiftrightunsigned(turned, 64 - BLOCKS[-1]).alias("top"))
    rows = _cells(rows, ["turn", "top"], cell_rows)
    dealt = rows.repartition(parts, "turn", "top", "i", "j").sortWithinPartitions("turn", "top", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, turn, _, _, _, side in _by_cell(batches, slice(1, 5)):
            if len(fp) > 1:
                bits = OFFSETS[int(turn[0])]
                a, b = trie_links(_turn(fp.view(np.uint64), bits), side, int(turn[0]))
                back = [_turn(x, 64 - bits).view(np.int64) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in back], ["a", "b"])

    return common.map_arrow(dealt, run, "a long, b long")


# Groups of linked fingerprints


def star_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """member, root for every vertex of edges that isn't its group's least: alternating large and small stars.

    Each round is written to the shared folder; the driver sees a count and a
    checksum only. Vertices with very many neighbours are dealt by row, and
    their minima are made before the shuffle.
    """
    now = common.materialize(
        edges.select(F.greatest(a, b).alias("member"), F.least(a, b).alias("root")).where("member <> root").distinct()
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("root").alias("member"), F.col("member").alias("root")))
        least = both.groupBy("member").agg(F.min("root").alias("m")).select("member", F.least("member", "m").alias("m"))
        large = both.where("root > member").join(least, "member").select(F.col("root").alias("member"), F.col("m").alias("root")).where("member <> root").distinct()
        least = large.groupBy("member").agg(F.min("root").alias("m"))
        small = large.join(least, "member").where("root <> m").select(F.col("root").alias("member"), F.col("m").alias("root"))
        nxt = common.materialize(small.unionByName(least.withColumnRenamed("m", "root")).distinct())
        common.discard(now)
        now = nxt
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("member", "root").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now
        seen = tuple(state)


def _named(rows: DataFrame, least: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of each of rows(doc_id, fp); least: the least doc_id of each fp; edges: links a, b of fps."""
    roots = star_components(edges)
    # Only fingerprints with links can have a smaller id elsewhere.
    linked = least.join(roots, least["fp"] == roots["member"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    first = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    names = linked.join(first, "root").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach) of each row."""
    parts = common.partitions(df.sparkSession)
    rows = common.materialize(fingerprints(df, id_col, text_col))
    least = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _named(rows, least, links(least.select("fp"), parts))


# Groups of texts with like 5-word shingles


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word, SEED)
        return h


def grams(text: str | None, hashed: dict | None = None) -> np.ndarray:
    """The different 5-word shingles of a text as sorted 64-bit hashes; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.array([], np.int64)
    hashed = _WordHashes() if hashed is None else hashed
    h = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return np.unique(out.view(np.int64))


def majority(grams: np.ndarray) -> int:
    """SimHash of a set of hashes, signed."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):
        part = grams[at : at + (1 << 16)].astype(">i8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big"))


def majorities(grams: np.ndarray) -> list[int]:
    """SimHash of WIDE bits of a set of hashes, in signed parts of 64; the first is majority(grams)."""
    out, mixed = [majority(grams)], grams.view(np.uint64)
    with np.errstate(over="ignore"):
        for _ in SIMS[1:]:
            mixed = mixed + np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
            out.append(majority(mixed.view(np.int64)))
    return out


def _name(grams: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return _signed(xxh64_intdigest(grams.tobytes(), SEED))


def frequent_grams(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of shingles that many texts share, from a sample of different texts; at most MOST_FREQUENT reach the driver."""
    some = df.select(df[text_col].cast("string").alias("text"))
    some = some.where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _WordHashes()
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(grams(t, hashed))], ["h"])

    counts = common.map_arrow(some, run, "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    top = counts.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).select("h").toArrow()
    return np.sort(top.column(0).to_numpy())


def prefix(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of n hashes, frequent ones last."""
    n = len(grams)
    if len(frequent) and n:
        late = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
        grams = np.concatenate([grams[~late], grams[late]])
    return grams[: n - (4 * n + 4) // 5 + 1]


def gram_sets(df: DataFrame, frequent: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (hash of the whole set of shingles), n (its size), SIMS (its SimHash) and prefix of each row."""
    # At most 8 MB.
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _WordHashes()
        for b in batches:
            sets = [grams(t, hashed) for t in b.column(1).to_pylist()]
            heads = [prefix(g, shared.value) for g in sets]
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads) if heads else np.array([], np.int64)))
            cols = [pa.array([f(g) for g in sets], pa.int64()) for f in (_name, len)]
            cols += [pa.array(c, pa.int64()) for c in (zip(*map(majorities, sets)) if sets else [[]] * len(SIMS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, lists], ["doc_id", "fp", "n", *SIMS, "prefix"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return common.map_arrow(rows, run, f"doc_id long, fp long, n long, {', '.join(f'{c} long' for c in SIMS)}, prefix array<long>")


def meetings(rows: DataFrame, parts: int) -> DataFrame:
    """h, fp: the different sets that meet others at a prefix hash. rows(fp, prefix) may repeat sets; a task sends each once."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            fp = b.column(0).to_numpy()
            new = np.array([x not in seen and not seen.add(x) for x in fp.tolist()], bool)
            lists = b.column(1).filter(pa.array(new))
            yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(np.repeat(fp[new], lists.value_lengths().to_numpy()))], ["h", "fp"])

    dealt = common.map_arrow(rows.select("fp", "prefix"), spread, "h long, fp long").repartition(parts, "h").sortWithinPartitions("h", "fp")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, without repeats, whose hash the row before or after has too; the last row of a batch waits for the next."""
        last, met = np.zeros((0, 2), np.int64), False
        for b in batches:
            x = np.concatenate([last, np.stack([c.to_numpy() for c in b.columns], 1)])
            x = x[np.append(True, (x[1:] != x[:-1]).any(axis=1))] if len(x) else x
            if not len(x):
                continue
            same = x[1:, 0] == x[:-1, 0]
            both = np.append(met and len(last) > 0, same) | np.append(same, False)
            kept = x[:-1][both[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0].copy()), pa.array(kept[:, 1].copy())], ["h", "fp"])
            last, met = x[-1:], bool(both[-1])
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(last[:, 0].copy()), pa.array(last[:, 1].copy())], ["h", "fp"])

    return common.map_arrow(dealt, shared, "h long, fp long")


def met_links(met: DataFrame, parts: int, meet_rows: int = MEET_ROWS) -> DataFrame:
    """a, b: links that span the groups of sets that meet and may be similar; at most one for each row of met(h, n, fp, SIMS) and cell."""
    rows = _cells(met.select("fp", "n", *SIMS, "h"), ["h"], meet_rows)
    dealt = rows.repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "fp")
    first = 2 + len(SIMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _whole_cells(batches, slice(first, first + 3)):
            fp, n, h, i, j, side = *cells[:2], *cells[first:]
            bits = [c.view(np.uint64) for c in cells[2:first]]

            def similar(x, y):
                """Whether the sets at places x and y may be similar; x and y are arrays that go together."""
                ok = ((i[x] == j[x]) | (side[x] != side[y])) & (5 * n[x] >= 4 * n[y]) & (5 * n[y] >= 4 * n[x])
                return ok & ((np.minimum(n[x], n[y]) < FEW) | (sum(np.bitwise_count(c[x] ^ c[y]).astype(np.int32) for c in bits) <= WIDE_BITS))

            starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            sizes = np.diff(np.append(starts, len(h)))
            cell, found = np.repeat(np.arange(len(starts)), sizes), []
            small = np.flatnonzero(sizes[cell] <= SMALL)
            for d in range(1, min(SMALL, len(small))):
                x, y = small[:-d], small[d:]
                same = cell[x] == cell[y]
                if not same.any():
                    break
                x, y = x[same], y[same]
                ok = similar(x, y)
                found.append((x[ok], y[ok]))
            for lo, hi in zip(starts[sizes > SMALL].tolist(), (starts + sizes)[sizes > SMALL].tolist()):
                found.append(_spanning(lo, hi, n, similar))
            if found:
                groups = _Groups(len(h))
                groups.join(*(np.concatenate(x) for x in zip(*found)))
                child = np.flatnonzero(groups.of != np.arange(len(h)))
                pairs = np.unique(np.stack([fp[child], fp[groups.of[child]]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return common.map_arrow(dealt, run, "a long, b long").distinct()


def _spanning(lo: int, hi: int, n: np.ndarray, similar) -> tuple[np.ndarray, np.ndarray]:
    """Places that are linked so that they span the groups of the cell lo:hi, whose sizes n rise.

    The group of the middle place only grows, so two sets that are in it when their turn comes need no comparison.
    """
    groups, middle = _Groups(hi - lo), (hi - lo) // 2
    left = np.append(middle, np.delete(np.arange(hi - lo), middle))
    step = 1
    while len(left):
        x, left = lo + np.sort(left[:step]), left[step:]
        y = np.arange(lo + np.searchsorted(5 * n[lo:hi], 4 * n[x[0]], "left"), lo + np.searchsorted(4 * n[lo:hi], 5 * n[x[-1]], "right"))
        a, b = np.nonzero(similar(x[:, None], y[None, :]))
        groups.join(x[a] - lo, y[b] - lo)
        left = left[groups.of[left] != groups.of[middle]]
        step = 256
    child = np.flatnonzero(groups.of != np.arange(hi - lo))
    return lo + child, lo + groups.of[child]


def other_pairs(met: DataFrame, roots: DataFrame, parts: int, meet_rows: int = MEET_ROWS) -> DataFrame:
    """a, b: all pairs of sets that meet, may be similar and are in different groups of roots(member, root).

    Their number grows with the square of a group's size, so the stage takes met_links, which tests compare with this.
    """
    named = met.join(roots, met["fp"] == roots["member"], "left").select("fp", "n", "sim", F.coalesce("root", "fp").alias("root"), "h")
    # Where all are in one group there is nothing to compare.
    several = named.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    rows = _cells(named.join(several, "h", "left_semi").select("fp", "n", "sim", "root", "h"), ["h"], meet_rows)
    dealt = rows.repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j", "n")

    def similar(n, sim, root, i, j, side, x, y):
        """Whether the sets at places x and y are to be compared; x and y are arrays that go together."""
        ok = (root[x] != root[y]) & ((i[x] == j[x]) | (side[x] != side[y])) & (5 * n[x] >= 4 * n[y]) & (5 * n[y] >= 4 * n[x])
        return ok & ((np.minimum(n[x], n[y]) < FEW) | (np.bitwise_count((sim[x] ^ sim[y]).view(np.uint64)) <= NEAR_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _whole_cells(batches, slice(4, 7)):
            fp, n, sim, root, h, i, j, side = cells
            starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            sizes = np.diff(np.append(starts, len(h)))
            cell, found = np.repeat(np.arange(len(starts)), sizes), []
            small = np.flatnonzero(sizes[cell] <= SMALL)
            for d in range(1, min(SMALL, len(small))):
                x, y = small[:-d], small[d:]
                same = cell[x] == cell[y]
                if not same.any():
                    break
                x, y = x[same], y[same]
                ok = similar(n, sim, root, i, j, side, x, y)
                found.append((x[ok], y[ok]))
            for lo, hi in zip(starts[sizes > SMALL].tolist(), (starts + sizes)[sizes > SMALL].tolist()):
                # Of any pair to be compared at least one set is outside the largest group.
                _, of = np.unique(root[lo:hi], return_inverse=True)
                outside = lo + np.flatnonzero(of != np.bincount(of).argmax())
                for k in range(0, len(outside), 256):  # by size, so that only neighbours in size are tried
                    x = outside[k : k + 256]
                    y = np.arange(lo + np.searchsorted(5 * n[lo:hi], 4 * n[x[0]], "left"), lo + np.searchsorted(4 * n[lo:hi], 5 * n[x[-1]], "right"))
                    a, b = np.nonzero(similar(n, sim, root, i, j, side, x[:, None], y[None, :]))
                    found.append((x[a], y[b]))
            if found:
                pairs = np.stack([np.concatenate([fp[x] for x, _ in found]), np.concatenate([fp[y] for _, y in found])], 1)
                pairs = np.unique(np.sort(pairs, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return common.map_arrow(dealt, run, "a long, b long").distinct()


def trie_pairs(sets: DataFrame, parts: int) -> DataFrame:
    """a, b: links that span the groups of sets(fp, sim) whose fingerprints sim link in the trie self-join; sets of one fingerprint link."""
    names = common.materialize(sets.groupBy("sim").agg(F.min("fp").alias("name")))
    alike = sets.join(names, "sim").where("fp <> name").select(F.col("fp").alias("a"), F.col("name").alias("b"))
    near = links(names.select(F.col("sim").alias("fp")), parts)
    near = near.join(names.select(F.col("sim").alias("a"), F.col("name").alias("x")), "a")
    near = near.join(names.select(F.col("sim").alias("b"), F.col("name").alias("y")), "b")
    return alike.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def set_links(sets: list[np.ndarray], sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sets that are linked so that they span the groups of sets with a Jaccard index of 0.8 or more.

    sides as in trie_links. What a set shares with all others is counted from the places of each of its shingles. The group of
    the first place taken only grows, so two sets that are in it when their turn comes need no comparison.
    """
    m, n = len(sets), np.array([len(s) for s in sets])
    mixed = len(np.unique(sides)) > 1
    owner = np.repeat(np.arange(m), n)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    owners = owner[order]
    starts = np.append(0, np.cumsum(np.bincount(code)))
    ends = np.append(0, np.cumsum(n))
    of, a, b = np.arange(m), [], []
    first = int(np.argsort(n, kind="stable")[m // 2])
    for x in [first, *(k for k in range(m) if k != first)]:
        if x != first and of[x] == of[first]:
            continue
        own = code[ends[x] : ends[x + 1]]
        size = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        shared = np.bincount(owners[at], minlength=m)
        ok = (5 * shared >= 4 * (n[x] + n - shared)) & (of != of[x])
        if mixed:
            ok &= sides != sides[x]
        met, places = np.unique(of[ok], return_index=True)
        if len(met):
            a += [x] * len(met)
            b += np.flatnonzero(ok)[places].tolist()
            of[np.isin(of, met)] = of[x]
    return np.array(a, np.int64), np.array(b, np.int64)


def block_links(blocks: DataFrame, sets: DataFrame, texts: DataFrame, parts: int, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """a, b: links that span the groups of sets of one of blocks(fp, block) whose texts have a Jaccard index of 0.8 or more.

    sets(fp, least): an id with each set; texts(doc_id, text).
    """
    ids = common.materialize(sets.join(blocks, "fp", "left_semi").select(F.col("least").alias("id")).distinct())
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    held = texts.join(ids, texts["doc_id"].eqNullSafe(ids["id"]), "left_semi")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _WordHashes()
        for b in batches:
            found = [grams(t, hashed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([f(g) for g in found], pa.int64()) for f in (_name, len)), b.column(1)], ["fp", "n", "text"])

    # Rows of one id may have different texts.
    held = common.materialize(common.map_arrow(held, name, "fp long, n long, text string").join(blocks, "fp").dropDuplicates(["fp"]))
    cells = _cells(held, ["block"], block_grams, "n")
    dealt = cells.select("fp", "text", "block", "i", "j", "side").repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j", "fp")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, key, cell = _WordHashes(), None, []

        def close():
            fps, sides, found = zip(*cell)
            a, b = (np.array(fps, np.int64)[x] for x in set_links(list(found), np.array(sides)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for fp, text, *at, side in zip(*[c.to_pylist() for c in batch.columns]):
                if at != key and cell:
                    yield close()
                    cell = []
                key = at
                cell.append((fp, side, grams(text, hashed)))
        if cell:
            yield close()

    out = common.materialize(common.map_arrow(dealt, check, "a long, b long"))
    common.discard(held)
    return out


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (of the set of shingles) and component_id (the least doc_id that links of a Jaccard index of 0.8 reach) of each row."""
    parts = common.partitions(df.sparkSession)
    texts = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    rows = common.materialize(gram_sets(texts, frequent_grams(texts)))
    sets = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in ("n", *SIMS)]))
    met = common.materialize(meetings(rows.where("n > 0"), parts))
    near = met_links(met.join(sets.select("fp", "n", *SIMS), "fp"), parts)
    near = near.unionByName(trie_pairs(sets.where("n > 0").select("fp", "sim"), parts))
    roots = star_components(near)
    common.discard(met)
    blocks = roots.select(F.col("member").alias("fp"), F.col("root").alias("block"))
    blocks = common.materialize(blocks.unionByName(roots.select(F.col("root").alias("fp"), F.col("root").alias("block")).distinct()))
    return _named(rows.select("doc_id", "fp"), sets.select("fp", "least"), block_links(blocks, sets, texts, parts))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def filter_stage(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id, in the same columns.

    Groups are those of near_groups: five-word shingles, Jaccard index 0.8.

    If doc_id has repeats, one of the rows with that id stays; of the rows without
    an id, one stays if no linked row has one.
    """
    found = common.materialize(near_groups(docs.select("doc_id", "text")))
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows, ids = keep.agg(F.count(F.lit(1)), F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).first()
    ids_kept = keep.select(F.col("doc_id").alias("kept_id")).distinct() if rows > ids else keep.select(F.col("doc_id").alias("kept_id"))
    out = docs.join(ids_kept, docs["doc_id"].eqNullSafe(ids_kept["kept_id"]), "left_semi")
    return out.dropDuplicates(["doc_id"]) if rows > ids else out
