"""Synthetic edge lists: the same edges for a size and seeds, however the work is dealt out.

``EdgeGenerator`` is the protocol: an object with ``edges(index)``, an Arrow-friendly
kernel from edge numbers to end points. spark.range() deals the numbers out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import rng


@dataclass(frozen=True)
class Preset:
    """Quadrant weights in ten-thousandths, edges put first, whether edges have weights."""

    a: int = 5700
    bc: int = 1900
    initial: str = "none"
    weighted: bool = False
    seeds: tuple[int, int] = (2, 3)
    max_weight: int = 255


PLAIN = Preset()
TREE_WEIGHTED = Preset(5500, 100, "binary_tree", True)


class EdgeGenerator(Protocol):
    def edges(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


class Kernel:
    """What the generators share: the stream's entry for each edge number, and scrambling."""

    def __init__(self, scale: int, edge_factor: int, preset: Preset):
        self.scale, self.preset = scale, preset
        self.count = edge_factor << scale
        self.tables = rng.jump_tables(self.count)
        self.start = rng.seed_state(*preset.seeds)
        self.keys = rng.scramble_keys(*preset.seeds)

    def states(self, index: np.ndarray) -> np.ndarray:
        return rng.jump(np.repeat(np.array(self.start, np.int64)[:, None], len(index), 1), index, self.tables)

    def scrambled(self, v: np.ndarray) -> np.ndarray:
        return rng.scramble(v, self.scale, self.keys)

    def weights(self, index: np.ndarray) -> np.ndarray:
        """1 to max_weight for each edge, from a stream of their own."""
        state = np.array(rng.skip(self.start, 30, 46, 0), np.int64)
        tables = rng.jump_tables(self.count, 0)
        first = rng.step(rng.jump(np.repeat(state[:, None], len(index), 1), index, tables))[0]
        return first % self.preset.max_weight + 1


class Rmat(Kernel):
    """Recursive quadrant choice; above the diagonal while both ends agree."""

    #: Draws below this are drawn again, so that the remainder has no bias.
    AGAIN = 0xFFFFFFFF % 10000

    def draw(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        states = rng.step(states)
        while (low := states[0] < self.AGAIN).any():
            states[:, low] = rng.step(states[:, low])
        return states, states[0] % 10000

    def edges(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        states = self.states(index)
        src, dst = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        a, bc = self.preset.a, self.preset.bc
        for level in range(self.scale - 1, -1, -1):
            states, x = self.draw(states)
            row = ((x >= bc) & (x < 2 * bc)) | (x >= 2 * bc + a)
            col = (x < bc) | (x >= 2 * bc + a)
            flip = (src == dst) & row & ~col
            row, col = row & ~flip, col | flip
            src += row.astype(np.int64) << level
            dst += col.astype(np.int64) << level
        return self.scrambled(src), self.scrambled(dst)


class Uniform(Kernel):
    def edges(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = (1 << self.scale) - 1
        first = rng.step(self.states(index))
        second = rng.step(first)
        return self.scrambled(first[0] & mask), self.scrambled(second[0] & mask)


def initial_edges(kind: str, scale: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End points, before scrambling, of the edges put first."""
    if kind == "binary_tree":
        return index + 1, (index + 1) // 2
    return index, (index + 1) % (1 << scale)  # a cycle through all vertices


def initial_count(kind: str, scale: int) -> int:
    return {"none": 0, "binary_tree": (1 << scale) - 1, "cycle": 1 << scale}[kind]


def generate(spark: SparkSession, kernel: Kernel, first: int = 0, last: int | None = None, parts: int | None = None) -> DataFrame:
    """edge_id, v0, v1 (and weight) of the edges numbered [first, last)."""
    preset, scale = kernel.preset, kernel.scale
    last = kernel.count if last is None else last
    head = initial_count(preset.initial, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(0).to_numpy()
            v0, v1 = kernel.edges(e)
            early = e < head
            if early.any():
                a, c = initial_edges(preset.initial, scale, e[early])
                v0, v1 = v0.copy(), v1.copy()
                v0[early], v1[early] = kernel.scrambled(a), kernel.scrambled(c)
            cols = [pa.array(e), pa.array(v0), pa.array(v1)]
            names = ["edge_id", "v0", "v1"]
            if preset.weighted:
                cols.append(pa.array(kernel.weights(e).astype(np.int32)))
                names.append("weight")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = spark.range(first, last, 1, parts or spark.sparkContext.defaultParallelism)
    return rows.mapInArrow(run, "edge_id long, v0 long, v1 long" + ", weight int" * preset.weighted)


def rmat_edges(spark: SparkSession, scale: int, edge_factor: int = 16, preset: Preset = PLAIN) -> DataFrame:
    return generate(spark, Rmat(scale, edge_factor, preset))


def uniform_edges(spark: SparkSession, scale: int, edge_factor: int = 16, preset: Preset = PLAIN) -> DataFrame:
    return generate(spark, Uniform(scale, edge_factor, preset))


def binary_tree_edges(spark: SparkSession, scale: int, seeds: tuple[int, int] = (2, 3)) -> DataFrame:
    kernel = Uniform(scale, 1, Preset(initial="binary_tree", seeds=seeds))
    return generate(spark, kernel, 0, initial_count("binary_tree", scale))


def cycle_edges(spark: SparkSession, scale: int, seeds: tuple[int, int] = (2, 3)) -> DataFrame:
    kernel = Uniform(scale, 1, Preset(initial="cycle", seeds=seeds))
    return generate(spark, kernel, 0, initial_count("cycle", scale))
