"""Byte planes of an offset column, most significant first, and what can be answered from some of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from decafix.functions.bounded import fraction_bits


def bit_length(x: Column) -> Column:
    """Bits that a non-negative BIGINT takes; 0 takes none."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x))).cast("int")


def plane_count(width: int) -> int:
    return -(-width // 8)


def plane(offset: Column, width: int, k: int, padded: bool = True) -> Column:
    """Plane ``k`` of an offset of ``width`` bits. The last plane holds the trailing bits, left-aligned if padded."""
    shift = width - 8 * (k + 1)
    if shift >= 0:
        return F.shiftright(offset, shift).bitwiseAND(F.lit(255))
    rest = offset.bitwiseAND(F.lit((1 << (8 + shift)) - 1))
    return F.shiftleft(rest, -shift) if padded else rest


def _target(value: int, width: int) -> list[int]:
    value <<= -width % 8
    return list(value.to_bytes(plane_count(width), "big"))


def gt_by_planes(planes: list[Column], target: int, width: int) -> Column:
    """``offset > target`` from planes: a later plane counts only where all before it tie."""
    if target < 0:
        return F.lit(True)
    if not width or target >= 1 << width:
        return F.lit(False)
    return reduce(lambda later, pt: (pt[0] > pt[1]) | ((pt[0] == pt[1]) & later), reversed(list(zip(planes, _target(target, width), strict=True))), F.lit(False))


def eq_by_planes(planes: list[Column], target: int, width: int) -> Column:
    if target < 0 or target >= 1 << width:
        return F.lit(False)
    return reduce(lambda done, pt: done & (pt[0] == pt[1]), zip(planes, _target(target, width), strict=True), F.lit(True))


def kept_bits(width: Column | int, precision: int, asked: int) -> Column:
    """Bits of an offset that answer at ``asked`` digits: the integer bits, and those of the asked precision, up to a
    whole byte unless that is the last plane anyway."""
    width = F.lit(width) if isinstance(width, int) else width
    bits, whole = fraction_bits(precision), lambda c: F.ceil(c / 8).cast("int") * 8
    if asked > precision:
        raise ValueError(f"asked for {asked} digits of {precision}")
    integer = F.greatest(width - F.lit(bits), F.lit(0))
    if asked == 0:
        return F.least(whole(integer), width).cast("int")
    need = integer + F.lit(fraction_bits(asked))
    byte = lambda c: F.floor(c / 8)
    return F.least(F.when(byte(need) < byte(width), whole(need)).otherwise(need), width).cast("int")


def reduced(fx: Column, base: Column, width: Column, precision: int, asked: int) -> Column:
    """``fx`` with the offset's low planes zeroed, as a reader of only the first planes would see it."""
    drop = width - kept_bits(width, precision, asked)
    return base + F.call_function("shiftleft", F.call_function("shiftright", fx - base, drop), drop)
