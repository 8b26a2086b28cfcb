"""Dense vectors as arrays: products in double precision, inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.when(s["n"] == 0, F.lit(1.0)).otherwise(s["n"])))[0]


def footprint_mb(n: Column, dim: int = 768) -> Column:
    """Megabytes of n float32 vectors."""
    return n * F.lit(dim * 4) / F.lit(1e6)
