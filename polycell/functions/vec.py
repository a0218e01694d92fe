"""Vector expressions over ARRAY<DOUBLE> columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def point(*xs) -> Column:
    """A vector of the given columns or numbers."""
    return F.array(*[(_c(x) if isinstance(x, str | Column) else F.lit(float(x))).cast("double") for x in xs])


def literal(xs) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>")


def total(xs) -> Column:
    return F.aggregate(_c(xs), F.lit(0.0), lambda a, b: a + b)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(a, s) -> Column:
    s = _c(s) if isinstance(s, str | Column) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def axpy(a, s, b) -> Column:
    """a + s * b."""
    s = _c(s) if isinstance(s, str | Column) else F.lit(float(s))
    return F.zip_with(_c(a), _c(b), lambda x, y: x + s * y)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def normalized(a) -> Column:
    """a over its norm; null for zero or non-finite vectors."""
    n = norm(a)
    return F.when((n > 0) & (n < float("inf")), F.transform(_c(a), lambda x: x / n))


def rounded(a, digits: int = 6) -> Column:
    """Rounded components, with negative zero as zero."""
    return F.transform(_c(a), lambda x: F.round(x, digits) + F.lit(0.0))


def canonical_hemisphere(a) -> Column:
    """a or -a, so that the first component that isn't zero is positive."""
    first = F.try_element_at(F.filter(_c(a), lambda x: x != 0), F.lit(1))
    return F.when(first < 0, F.transform(_c(a), lambda x: -x)).otherwise(_c(a))


def wrapped(x, low, lengths) -> Column:
    """x moved into the box [low, low + lengths) along the axes with a length, as is along those with null."""
    return F.transform(F.arrays_zip(_c(x).alias("x"), _c(low).alias("l"), _c(lengths).alias("n")), lambda t: F.when(t["n"].isNull(), t["x"]).otherwise(F.pmod(t["x"] - t["l"], t["n"]) + t["l"]))


def ray_parameter(origin, direction, start, other) -> Column:
    """Where the ray origin + t direction is as far from ``other`` as from ``start``; null where it runs away or alongside.

    (x_j - x_0).(x_0 + x_j - 2 r) / (2 u.(x_j - x_0))
    """
    d = sub(other, start)
    slope = dot(direction, d)
    return F.when(slope > 1e-14, dot(d, F.zip_with(add(start, other), _c(origin), lambda s, r: s - 2 * r)) / (2 * slope))


def ray_parameter_error(origin, direction, start, other) -> Column:
    """First-order bound of the rounding error of ray_parameter."""
    d = sub(other, start)
    return F.when(dot(direction, d) > 1e-14, F.lit(2.0**-52) * (norm(start) + norm(other) + norm(origin)) * norm(d) / dot(direction, d))


def unit_ball_volume(d: int) -> float:
    import math

    return math.pi ** (d / 2) / math.gamma(1 + d / 2)
