"""Array-column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo=None, hi=None) -> Column:
    """Into [lo, hi]; null stays null."""
    c = given = col(c)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return F.when(given.isNotNull(), c)


def argmax(logits) -> Column:
    """Position of the first maximum, from 0."""
    a = col(logits)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def array_sum(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    return array_sum(F.zip_with(col(a), col(b), lambda u, v: u.cast("double") * v.cast("double")))


def l2_normalise(a, eps=1e-12) -> Column:
    n = F.greatest(F.sqrt(dot(a, a)), F.lit(eps))
    return F.transform(col(a), lambda v: v.cast("double") / n)
