"""Deterministic randomness.

Nothing in the library draws random numbers at run time: every random choice is
a function of a seed and the row's own key, so a retried task, another
partitioning or another engine makes the same choice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hex(seed: int, *keys: Column) -> Column:
    """32 hexadecimal digits for a seed and a key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def leading_number(hex_digits: Column, digits: int) -> Column:
    """The first ``digits`` hexadecimal digits as a BIGINT."""
    return F.conv(F.substring(hex_digits, 1, digits), 16, 10).cast("bigint")


def seeded_fraction(seed: int, *keys: Column) -> Column:
    """A number in [0, 1)."""
    return leading_number(seeded_hex(seed, *keys), 8) / F.lit(float(2**32))


def mix32(value: Column) -> Column:
    """A 32-bit integer mix, far cheaper than a digest for per-element use."""
    low = F.lit(0xFFFFFFFF)
    # 31 bits in, so that neither product leaves the 64-bit range.
    a = (value.bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(2654435761)).bitwiseAND(low)
    b = (F.shiftright(a, 16).bitwiseXOR(a) * F.lit(73244475)).bitwiseAND(low)
    return F.shiftright(b, 16).bitwiseXOR(b)
