"""Column expressions over numeric arrays. Everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.bind import let


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Cosine similarity; NULL when a side has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a, b) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l2_normalize(v, eps: float = 0.0) -> Column:
    """``v / (|v| + eps)``; a zero vector stays zero."""
    scaled = lambda p: F.transform(p["v"], lambda x: F.when(p["n"] == 0.0, F.lit(0.0)).otherwise(F.try_divide(x, p["n"])))
    return let(scaled, v=as_double(v), n=norm(v) + eps)


def sigmoid(x, temperature=1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x) / t))


def clip(v, low: float = -1.0, high: float = 1.0) -> Column:
    bounded = lambda x: F.when(x.isNull(), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))
    return F.transform(as_double(v), bounded)


def peak_normalize(v, floor: float = 1e-6) -> Column:
    """Divide by the largest magnitude; a silent signal is left alone."""
    scaled = lambda s: F.when(s["p"] > 0, F.transform(s["v"], lambda x: x / F.greatest(s["p"], F.lit(floor)))).otherwise(s["v"])
    return let(scaled, v=as_double(v), p=F.array_max(F.transform(as_double(v), F.abs)))


def fix_length(v, length: int) -> Column:
    """Cut or zero-pad at the end to exactly ``length`` samples."""
    a = as_double(v)
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(F.slice(a, 1, length), pad)


def argmax(v) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(_c(v), F.array_max(_c(v))) - 1).cast("bigint")


def reparameterize(mu, logvar, eps) -> Column:
    """``mu + eps * exp(logvar / 2)`` element by element."""
    scale = F.zip_with(as_double(eps), as_double(logvar), lambda e, lv: e * F.exp(F.lit(0.5) * lv))
    return F.zip_with(as_double(mu), scale, lambda m, s: m + s)
