"""Pose codes: 66 characters, two masks, or the legacy packed form, one into the other.

Bit i of a code is character i. ``m_bend`` holds bits 0..44 (bit i as 1 << i), ``m_spread`` bits 45..65 (from 1 << 0).
The legacy form is base64 of 9 bytes, bit i in byte i // 8 at 1 << (i % 8), with a newline at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

N_BITS, BEND_BITS, SPREAD_BITS = 66, 45, 21

_PLAIN = r"^[01]{66}\z"
_LEGACY = r"^[A-Za-z0-9+/]{12}\n\z"


def _number(digits: Column, base: int) -> Column:
    return F.conv(digits, base, 10).cast("bigint")


def _little_endian(text: Column, first: int, last: int) -> Column:
    """Bytes first..last of a hex string as one number, the first byte the lowest."""
    return _number(F.concat(*(F.substring(text, 2 * i + 1, 2) for i in range(last, first - 1, -1))), 16)


def masks(code: Column) -> Column:
    """``struct<m_bend, m_spread>`` of a whole code in either form; null for null, cut-off or other text."""
    plain = F.struct(
        _number(F.reverse(F.substring(code, 1, BEND_BITS)), 2).alias("m_bend"),
        _number(F.reverse(F.substring(code, BEND_BITS + 1, SPREAD_BITS)), 2).alias("m_spread"),
    )
    raw = F.hex(F.unbase64(F.substring(code, 1, 12)))
    low, high = _little_endian(raw, 0, 4), _little_endian(raw, 5, 8)
    legacy = F.struct(
        low.bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(31)), 40)).alias("m_bend"),
        F.shiftright(high, 5).alias("m_spread"),
    )
    return F.when(code.rlike(_PLAIN), plain).when(
        code.rlike(_LEGACY) & (_little_endian(F.hex(F.unbase64(F.substring(code, 1, 12))), 8, 8) < 4), legacy
    )


def plain_code(m_bend: Column, m_spread: Column) -> Column:
    """The 66 characters of two masks."""
    return F.concat(
        F.reverse(F.lpad(F.bin(m_bend), BEND_BITS, "0")), F.reverse(F.lpad(F.bin(m_spread), SPREAD_BITS, "0"))
    )


def legacy_code(m_bend: Column, m_spread: Column) -> Column:
    """The packed form with its newline."""
    low = F.lpad(F.hex(m_bend.bitwiseAND(F.lit((1 << 40) - 1))), 10, "0")
    high = F.lpad(F.hex(F.shiftright(m_bend, 40).bitwiseOR(F.shiftleft(m_spread, 5))), 8, "0")
    pairs = [F.substring(low, i, 2) for i in (9, 7, 5, 3, 1)] + [F.substring(high, i, 2) for i in (7, 5, 3, 1)]
    return F.concat(F.base64(F.unhex(F.concat(*pairs))), F.lit("\n"))


def shared_bits(bend_a: Column, spread_a: Column, bend_b: Column, spread_b: Column) -> Column:
    """Number of bits set in both codes."""
    return F.bit_count(bend_a.bitwiseAND(bend_b)) + F.bit_count(spread_a.bitwiseAND(spread_b))
