"""Vector expressions (X-26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_double(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(_as_double(a), _as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(_as_double(a), lambda x: x * x),
                              F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def cosine(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """X-26: 1 − cosine distance.  ``b_norm`` lets a constant query vector's
    norm be computed once instead of per row."""
    nb = b_norm if b_norm is not None else l2_norm(b)
    return dot(a, b) / (l2_norm(a) * nb)
