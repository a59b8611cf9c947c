"""Small numeric helpers that keep nulls null."""

from pyspark.sql import Column, functions as F


def clamp(value: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """``value`` limited to ``[low, high]``; null stays null, unlike with ``least`` and ``greatest``."""
    out = value
    if high is not None:
        high = high if isinstance(high, Column) else F.lit(high)
        out = F.when(value > high, high).otherwise(out)
    if low is not None:
        low = low if isinstance(low, Column) else F.lit(low)
        out = F.when(value < low, low).otherwise(out)
    return out
