"""Number columns used in ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int = 5) -> Column:
    p = float(10**digits)
    return F.floor(c * p + 0.5) / p


def percent(part: Column, whole: Column) -> Column:
    """Percent at two digits; an empty whole counts as one."""
    return F.floor(part / F.greatest(whole, F.lit(1)) * 10000 + 0.5) / 100


def sigmoid(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), 0.0).when(c >= 0, 1 / (1 + F.exp(-c))).otherwise(F.exp(c) / (1 + F.exp(c)))


def gelu(c: Column) -> Column:
    return 0.5 * c * (1 + F.tanh(0.7978845608028654 * (c + 0.044715 * c * c * c)))


def upper_median(values: Column) -> Column:
    """Middle of an array in ascending order; of two middles the higher."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def z_score(c: Column, window) -> Column:
    """Against mean and population deviation over the window; a deviation of 0 counts as 1."""
    return (c - F.avg(c).over(window)) / F.coalesce(F.nullif(F.stddev_pop(c).over(window), F.lit(0.0)), F.lit(1.0))
