"""Vector columns over array<float or double>, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-10))


def l2_normalize(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def is_nonzero(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)
