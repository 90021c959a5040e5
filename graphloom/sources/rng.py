"""The generators' random stream: a multiple recursive generator modulo 2^31 - 1 that can be entered anywhere.

A state is five numbers; a step replaces the first by a fixed combination of
the first and the last and moves the others on. Steps are 5 x 5 matrices, so a
jump of any length is a product of powers, looked up by the bytes of the length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

P = (1 << 31) - 1
# Multipliers of the first and the last number.
X, Y = 107374182, 104480

STEP = np.zeros((5, 5), object)
STEP[0, 0], STEP[0, 4] = X, Y
for _i in range(1, 5):
    STEP[_i, _i - 1] = 1


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.dot(b) % P


@lru_cache(maxsize=None)
def _power_of(k: int) -> np.ndarray:
    """STEP to the power 2^k."""
    return STEP if k == 0 else multiply(_power_of(k - 1), _power_of(k - 1))


def power(n: int) -> np.ndarray:
    """STEP to the power n."""
    out, k = np.array(np.eye(5, dtype=int), object), 0
    while n:
        if n & 1:
            out = multiply(_power_of(k), out)
        n, k = n >> 1, k + 1
    return out


def seed_state(seed1: int, seed2: int) -> list[int]:
    """State of two 64-bit seeds."""
    low = (1 << 30) - 1
    return [
        (seed1 & low) + 1,
        ((seed1 >> 30) & low) + 1,
        (seed2 & low) + 1,
        ((seed2 >> 30) & low) + 1,
        ((seed2 >> 60) << 4) + (seed1 >> 60) + 1,
    ]


def skip(state: list[int], high: int, middle: int, low: int) -> list[int]:
    """State after high * 2^128 + middle * 2^64 + low steps."""
    m = power((high << 128) + (middle << 64) + low)
    return [int(x) for x in m.dot(np.array(state, object)) % P]


def next_uint(state: list[int]) -> tuple[int, list[int]]:
    z = (X * state[0] + Y * state[4]) % P
    return z, [z, *state[:4]]


def next_double(state: list[int]) -> tuple[float, list[int]]:
    """Two numbers make one double in [0, 1)."""
    a, state = next_uint(state)
    b, state = next_uint(state)
    return a * 4.65661287524579692e-10 + b * 2.168404346990492787e-19, state


def doubles(n: int, seed1: int, seed2: int, position: int) -> list[float]:
    """n doubles of the stream from a position on."""
    state, out = skip(seed_state(seed1, seed2), 2, 0, 2 * position), []
    for _ in range(n):
        d, state = next_double(state)
        out.append(d)
    return out


def jump_tables(most: int, unit: int = 64) -> list[np.ndarray]:
    """For each byte of a number up to `most`, the 256 matrices of that many jumps of 2^unit steps."""
    base, out = power(1 << unit), []
    while True:
        table = [np.array(np.eye(5, dtype=int), object)]
        for _ in range(255):
            table.append(multiply(table[-1], base))
        out.append(np.array([t.tolist() for t in table], np.int64))
        most >>= 8
        if not most:
            return out
        base = multiply(table[-1], base)


def jump(states: np.ndarray, counts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """states (5, n) after counts[i] jumps each."""
    for k, table in enumerate(tables):
        m = table[(counts >> (8 * k)) & 255]
        states = np.stack([sum(m[:, i, j] * states[j] % P for j in range(5)) % P for i in range(5)])
    return states


def step(states: np.ndarray) -> np.ndarray:
    return np.concatenate([[(X * states[0] + Y * states[4]) % P], states[:4]])


def bit_reverse(v: np.ndarray) -> np.ndarray:
    """Each unsigned 64-bit number with its bits in reverse."""
    v = v.astype(np.uint64)
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        m, w = np.uint64(mask), np.uint64(width)
        v = ((v & m) << w) | ((v >> w) & m)
    return v.byteswap()


def scramble_keys(seed1: int, seed2: int) -> tuple[int, int]:
    state, out = skip(seed_state(seed1, seed2), 50, 7, 0), []
    for _ in range(2):
        a, state = next_uint(state)
        b, state = next_uint(state)
        out.append((a * 0xFFFFFFFF + b) & 0xFFFFFFFFFFFFFFFF)
    return out[0], out[1]


def scramble(v: np.ndarray, scale: int, keys: tuple[int, int]) -> np.ndarray:
    """A bijection of [0, 2^scale): two rounds of an odd multiple and a bit reversal, in wrapping 64-bit arithmetic."""
    a, b = keys
    shift = np.uint64(64 - scale)
    with np.errstate(over="ignore"):
        x = v.astype(np.uint64) + np.uint64((a + b) & 0xFFFFFFFFFFFFFFFF)
        # Bits that make the multipliers odd and wide.
        x = bit_reverse(x * np.uint64(a | 0x4519840211493211)) >> shift
        x = bit_reverse(x * np.uint64(b | 0x3050852102C843A5)) >> shift
    return x.astype(np.int64)
