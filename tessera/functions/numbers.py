"""Numbers as Python has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 3) -> Column:
    """Python's ``round(x, digits)`` for up to about 1e9: by the double's exact value, ties to the even digit.

    Spark's own ``round`` goes by the shortest decimal text and rounds ties up. Here x is cut into two halves whose products with twice the power of ten
    are exact, so its exact distance from the middle between two results decides.
    """
    power = float(10**digits)
    below = F.floor(x * F.lit(power)).cast("double")
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    low = x - high
    past = (high * F.lit(2 * power) - (below * 2.0 + 1.0)) + low * F.lit(2 * power)
    up = (past > 0) | ((past == 0) & (below % 2 != 0))
    return (below + up.cast("double")) / F.lit(power)
