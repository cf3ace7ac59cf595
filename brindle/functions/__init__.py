"""Column helpers for names that Spark itself does not have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(c: Column, digits: int = 0) -> Column:
    """Toward zero, to so many decimal digits (negative: tens, hundreds), as a double.

    Digits are those of the shortest decimal text of the number, so truncate(0.29, 2) is 0.29.
    From 1e15 on a double has no digits after the point that count; not a number and infinity stay.
    """
    x = c.cast("double")
    exact = F.floor(F.abs(x).cast("decimal(38,18)"), F.lit(digits)).cast("double") * F.signum(x)
    large = x - x % F.lit(10.0**-digits) if digits < 0 else x
    return F.when(F.abs(x) < 1e15, exact).when(F.abs(x) < float("inf"), large).otherwise(x)


def isinf(c: Column) -> Column:
    return F.abs(c) == float("inf")


def array_reverse(c: Column) -> Column:
    return F.reverse(c)


def array_exists(c: Column, test) -> Column:
    return F.exists(c, test)


def array_forall(c: Column, test) -> Column:
    return F.forall(c, test)


def avg_distinct(c: Column) -> Column:
    """Mean of the distinct values: both parts are one distinct aggregation."""
    return F.sum_distinct(c) / F.count_distinct(c)
