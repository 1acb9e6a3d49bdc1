"""64-bit perceptual hashes as columns: 16 hex digits for I/O, two 32-bit halves for compute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half(hash_hex: Column, which: int) -> Column:
    """High (0) or low (1) 32 bits of a 16-digit hash as BIGINT."""
    return F.conv(F.substring(hash_hex, 1 + 8 * which, 8), 16, 10).cast("long")


def hamming_hex(a: Column, b: Column) -> Column:
    """Number of differing bits of two equal-length hex strings; unequal lengths raise."""
    bits = F.bit_count(half(a, 0).bitwiseXOR(half(b, 0))) + F.bit_count(half(a, 1).bitwiseXOR(half(b, 1)))
    return F.when(F.length(a) == F.length(b), bits).otherwise(F.raise_error(F.lit("hash lengths differ")).cast("int"))


def hamming_halves(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def fold(bits: Sequence[Column]) -> Column:
    """Booleans, first one highest, as one BIGINT: a flat sum that compiles, without arrays or lambdas."""
    out = F.lit(0).cast("long")
    for i, bit in enumerate(bits):
        out = out + F.when(bit, F.lit(1 << (len(bits) - 1 - i)).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def halves_to_hex(hi: Column, lo: Column) -> Column:
    """Two 32-bit halves as 16 hex digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 8, "0") for x in (hi, lo)])


def bits_to_hex(bits: Column) -> Column:
    """Array of 64 zero/one integers, first bit highest, as 16 hex digits."""
    cell = [F.element_at(bits, i + 1) == 1 for i in range(64)]
    return halves_to_hex(fold(cell[:32]), fold(cell[32:]))


def band(hi: Column, lo: Column, start: int, width: int) -> Column:
    """Bits [start, start + width) of the 64, counted from the highest."""
    parts = []
    for i in range(start, start + width):
        word, shift = (hi, 31 - i) if i < 32 else (lo, 63 - i)
        parts.append(F.shiftright(word, shift).bitwiseAND(F.lit(1).cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out * 2 + p
    return out


def perceptual_halves(block: Column, middle: Column) -> list[Column]:
    """Low-frequency 8x8 block against its median (``lower_middle``): 1 where a value is above it, as two halves."""
    above = [F.element_at(block, i + 1) > middle for i in range(64)]
    return [fold(above[:32]), fold(above[32:])]


def lower_middle(block: Column) -> Column:
    return F.element_at(F.array_sort(block), 32)


def difference_halves(grid: Column, columns: int = 8) -> list[Column]:
    """1 where a cell is smaller than its right neighbour, as two halves; the first column stands in after the last."""
    right = [i // columns * columns + (i + 1) % columns for i in range(64)]
    smaller = [F.element_at(grid, i + 1) < F.element_at(grid, j + 1) for i, j in enumerate(right)]
    return [fold(smaller[:32]), fold(smaller[32:])]
