"""Column expressions on array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _once(value: Column, use) -> Column:
    """use(value), with value evaluated once and not for each component."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column) -> Column:
    """a over its norm; the zero vector stays."""
    return _once(a, lambda v: _once(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))))


def without(a: Column, u: Column) -> Column:
    """a less its part along u."""
    return _once(dot(a, u), lambda along: F.zip_with(a, u, lambda x, y: x.cast("double") - y.cast("double") * along))


#: How much common words count for less.
SIF_A = 1e-3


def sif(count: Column, total: Column, a: float = SIF_A) -> Column:
    """Weight of a word by its share of all tokens."""
    return F.lit(a) / (F.lit(a) + count / total)
