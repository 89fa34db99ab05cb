"""Signs as two-bit masks: 0 none, 1 plus, 2 minus, 3 undetermined.

The parallel sum of two signs is then their bitwise or, with 0 as identity and
conflicts and undetermined signs absorbing; the serial product keeps the mask
under plus, swaps the bits under minus and widens anything to 3 under 3.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLUS, MINUS, UNKNOWN = 1, 2, 3
CHARS = {0: "0", PLUS: "+", MINUS: "-", UNKNOWN: "?"}
MASKS = {c: m for m, c in CHARS.items()}


def encode(sign: Column) -> Column:
    return F.when(sign == "+", 1).when(sign == "-", 2).when(sign == "?", 3).when(sign == "0", 0).cast("int")


def decode(mask: Column) -> Column:
    return F.when(mask == 1, "+").when(mask == 2, "-").when(mask == 3, "?").when(mask == 0, "0")


def swap(mask: Column) -> Column:
    """The mask of the opposite sign."""
    return (F.shiftright(mask.bitwiseAND(2), 1) + F.shiftleft(mask.bitwiseAND(1), 1)).cast("int")


def times(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), 0).when((a == 3) | (b == 3), 3).when(a == 1, b).otherwise(swap(b)).cast("int")


def parallel(mask: Column) -> Column:
    """Aggregate: the sum over parallel signs; over nothing it is undetermined, which differs from a node without forcing."""
    return F.coalesce(F.bit_or(mask), F.lit(3)).cast("int")


def mul(a: int, b: int) -> int:
    """``times`` on plain numbers."""
    if not a or not b:
        return 0
    if a == 3 or b == 3:
        return 3
    return b if a == 1 else neg(b)


def neg(a: int) -> int:
    return (a & 1) << 1 | a >> 1
