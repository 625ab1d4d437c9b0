"""Integer functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_log2(x: Column) -> Column:
    """Position of the highest set bit. By digits, as a floating logarithm rounds up near powers of two; 0 gives null."""
    return F.when(x > 0, F.length(F.bin(x)) - 1).cast("int")


def high_bit(x: Column) -> Column:
    """The highest set bit alone; 0 gives null."""
    return F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), int_log2(x)))
