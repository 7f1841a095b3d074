"""Dense vectors as arrays; arithmetic in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPERATURE = 0.7


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scaled_dot(a: Column | str, b: Column | str, scale: float) -> Column:
    """The scale is used as it is, without an exponential."""
    return dot(a, b) * scale


def temperature_dot(a: Column | str, b: Column | str, temperature: float = TEMPERATURE) -> Column:
    return dot(a, b) / temperature


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def normalised(a: Column | str) -> Column:
    """Null for a zero vector. The norm is a lambda's argument, so that it isn't computed again for each component."""
    own = F.transform(F.array(norm(a)), lambda size: F.when(size > 0, F.transform(_col(a), lambda x: x.cast("double") / size)))
    return F.get(own, F.lit(0))


def exp_scaled_dot(a: Column | str, b: Column | str, logit_scale: float) -> Column:
    return dot(a, b) * F.exp(F.lit(logit_scale))
