"""Vectors as arrays: norms and similarity in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """Unit length, as floats; a zero vector stays. The norm is bound as a list of one: named inside the inner function, it would be
    taken anew for each element."""
    v = _col(v)
    scaled = lambda n: F.when(n == 0, v.cast("array<float>")).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float")))
    return F.get(F.transform(F.array(norm(v)), scaled), 0)


def cosine(a: Column | str, b: Column | str) -> Column:
    """In doubles, from -1 to 1; 0 if either norm is 0, null if a side is null. One root of both squares, rounded as SQL's functions
    round it: where distances are compared with each other, the last digit decides, and equal vectors have exactly 1."""
    a, b = _col(a), _col(b)
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, u: s + u)
    size = F.sqrt(product(a, a) * product(b, b))
    found = product(a, b) / size
    return F.when(size == 0, 0.0).when((found > 1) & ~F.isnan(found), 1.0).when(found < -1, -1.0).otherwise(found)
