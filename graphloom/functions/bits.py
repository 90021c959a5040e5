"""Column functions on ids and packed results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_BITS = 48
ID_MASK = (1 << ID_BITS) - 1
UNREACHED_DEPTH = 0xFFFF


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack_pred(level, pred) -> Column:
    """level << 48 | parent in one long; -1 for an unreached vertex (parent -1)."""
    packed = F.shiftleft(_c(level).cast("long"), ID_BITS).bitwiseOR(_c(pred).bitwiseAND(F.lit(ID_MASK)))
    return F.when(_c(pred) < 0, F.lit(-1).cast("long")).otherwise(packed)


def unpack_pred(packed) -> Column:
    """The parent, sign-extended from 48 bits."""
    return F.shiftright(F.shiftleft(_c(packed), 64 - ID_BITS), 64 - ID_BITS)


def unpack_depth(packed) -> Column:
    """The level; 65535 for an unreached vertex."""
    return F.shiftrightunsigned(_c(packed), ID_BITS).bitwiseAND(F.lit(0xFFFF)).cast("int")


def with_depth(packed, level) -> Column:
    """packed with another level."""
    return _c(packed).bitwiseAND(F.lit(ID_MASK)).bitwiseOR(F.shiftleft(_c(level).cast("long"), ID_BITS))


def popcount(x) -> Column:
    return F.bit_count(_c(x))


def top_bit(x) -> Column:
    """Place of the highest set bit; -1 for 0."""
    return F.when(_c(x) == 0, F.lit(-1)).otherwise(F.length(F.bin(_c(x))) - 1)


def low_bit(x) -> Column:
    """Place of the lowest set bit (trailing zeros); 64 for 0."""
    low = _c(x).bitwiseAND(F.negative(_c(x)))
    return F.when(_c(x) == 0, F.lit(64)).otherwise(F.length(F.bin(low)) - 1)


def blocks(n, size: int) -> Column:
    """Blocks of a size that n things need."""
    return F.expr(f"({_name(n)} + {size - 1}) div {size}")


def roundup(n, size: int) -> Column:
    return blocks(n, size) * size


def roundup_pow2(n) -> Column:
    """The least power of two that is n or more (1 for 1 and less)."""
    return F.when(_c(n) <= 1, F.lit(1).cast("long")).otherwise(F.expr(f"shiftleft(1L, length(bin({_name(n)} - 1)))"))


def _name(x) -> str:
    return f"`{x}`" if isinstance(x, str) else f"({x._jc.toString()})"


# Owners on a grid of rows x cols parts. Results never depend on them; they only deal work out.


def owner_row(v, rows: int) -> Column:
    return F.pmod(_c(v), F.lit(rows)).cast("int")


def owner_col(v, rows: int, cols: int) -> Column:
    return F.pmod(F.floor(_c(v) / rows), F.lit(cols)).cast("int")


def edge_owner(v0, v1, rows: int, cols: int) -> Column:
    return owner_row(v0, rows) + owner_col(v1, rows, cols) * rows


def vertex_owner(v, rows: int, cols: int) -> Column:
    return F.pmod(_c(v), F.lit(rows * cols)).cast("int")


def vertex_local(v, rows: int, cols: int) -> Column:
    return F.floor(_c(v) / (rows * cols)).cast("long")


def split_id(x, low_bits: int) -> tuple[Column, Column]:
    """High and low part of an id."""
    return F.shiftright(_c(x), low_bits), _c(x).bitwiseAND(F.lit((1 << low_bits) - 1))


def join_id(high, low, low_bits: int) -> Column:
    return F.shiftleft(_c(high), low_bits).bitwiseOR(_c(low))


def packed_edge(v0, v1) -> Column:
    """An edge of two 48-bit ids as three 32-bit words: low halves, then both high 16 bits."""
    low = lambda v: _c(v).bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda v: F.shiftright(_c(v), 32).bitwiseAND(F.lit(0xFFFF))
    return F.struct(low(v0).alias("low0"), low(v1).alias("low1"), high(v0).bitwiseOR(F.shiftleft(high(v1), 16)).alias("high"))


def edge_v0(e: Column) -> Column:
    return e["low0"].bitwiseOR(F.shiftleft(e["high"].bitwiseAND(F.lit(0xFFFF)), 32))


def edge_v1(e: Column) -> Column:
    return e["low1"].bitwiseOR(F.shiftleft(F.shiftright(e["high"], 16).bitwiseAND(F.lit(0xFFFF)), 32))
