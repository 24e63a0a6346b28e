"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int, *parts) -> Column:
    """A text that orders rows at random, the same in every engine: md5 of seed and parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def key_number(key: Column) -> Column:
    """The first 32 bits of an md5 text, as a long."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def clamp(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def deviance(a: Column, p: Column) -> Column:
    """-a ln p - (1 - a) ln(1 - p); 0 where p is not inside (0, 1)."""
    return F.when((p <= 0) | (p >= 1) | p.isNull(), F.lit(0.0)).otherwise(-a * F.log(p) - (1 - a) * F.log(1 - p))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def dot(x: Column, y: Column, d: int | None = None) -> Column:
    """Inner product of the first d entries (all without d)."""
    if d is not None:
        x, y = F.slice(x, 1, d), F.slice(y, 1, d)
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def distance(x: Column, y: Column) -> Column:
    return norm(F.zip_with(x, y, lambda a, b: a - b))


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once, where f uses it more than once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
