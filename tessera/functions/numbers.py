"""Number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_places(value: Column, places: int = 4) -> Column:
    """A double rounded by its exact binary value, ties to even, as IEEE asks; up to 7 places, null stays null.

    The product with a power of ten is held without error as p + e (the value is split in two
    halves of 26 bits), so a value beside a tie is never taken for the tie.
    """
    scale = float(10**places)

    def run(x: Column) -> Column:
        c = x * F.lit(134217729.0)
        high = c - (c - x)
        p = x * F.lit(scale)
        e = (high * F.lit(scale) - p) + (x - high) * F.lit(scale)
        k = F.floor(p).cast("double")
        side = (p - k - F.lit(0.5)) + e
        up = F.when(side > 0, 1.0).when(side < 0, 0.0).otherwise(F.pmod(k, F.lit(2.0)))
        return (k + up) / F.lit(scale)

    # bound once in an array of one, as the value occurs many times
    return F.get(F.transform(F.array(value.cast("double")), run), F.lit(0))
