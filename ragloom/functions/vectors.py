"""Vector algebra as native column expressions.

Vectors are ``array<float>`` columns; all arithmetic is done in double.
Everything here is a Catalyst expression (higher-order array functions), so
it runs in the JVM next to the scan with no Python worker.

Cosine similarity is always ``dot / sqrt(|a|^2 * |b|^2)``: with integer-valued
vectors (the hashing embedder) both factors are exact, so equal similarities
compare equal bit for bit, whatever engine computes them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst does not share a computed expression referenced inside a lambda:
    ``transform(xs, x -> f(x, g(y)))`` recomputes ``g(y)`` for every element.
    Binding it first keeps the cost at one evaluation per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(v: ColumnOrName) -> Column:
    return _c(v).cast("array<double>")


def as_float32(v: ColumnOrName) -> Column:
    """Cast to ``array<float>`` (float32 elements)."""
    return _c(v).cast("array<float>")


def sq_norm(v: ColumnOrName) -> Column:
    """Sum of squares, in double."""
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(v: ColumnOrName) -> Column:
    return F.sqrt(sq_norm(v))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Dot product; null when the lengths differ (zip_with pads with null)."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def _nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clamp_unit(c: Column) -> Column:
    """Clamp to [-1, 1], keeping null (``greatest`` alone would turn null into -1)."""
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def cosine_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine in [-1, 1]; null for a zero, null or NaN-bearing vector."""
    def body(x, y):
        s = F.try_divide(dot(x, y), F.sqrt(sq_norm(x) * sq_norm(y)))
        return clamp_unit(_nan_to_null(s))
    return let(as_double(a), lambda x: let(as_double(b), lambda y: body(x, y)))


def cosine_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``a <=> b`` = 1 - cosine similarity."""
    return F.lit(1.0) - cosine_similarity(a, b)


def l2_normalise(v: ColumnOrName) -> Column:
    """Unit vector in double; null for a zero or null vector."""
    return let(as_double(v), lambda d: let(l2_norm(d), lambda n: F.when(
        n > 0, F.transform(d, lambda x: x / n))))


def to_text(v: ColumnOrName) -> Column:
    """Vector to text ``[x1,x2,...]``."""
    return F.to_json(_c(v))


def from_text(s: ColumnOrName) -> Column:
    """Text ``[x1,x2,...]`` back to ``array<float>``."""
    return F.from_json(_c(s), "array<float>")


def dimension_ok(v: ColumnOrName, dim: int) -> Column:
    """``size(v) = dim`` (false for null)."""
    return F.coalesce(F.size(_c(v)) == F.lit(dim), F.lit(False))


def has_bad_element(v: ColumnOrName) -> Column:
    """True when an element is null, NaN or infinite."""
    return F.exists(as_double(v), lambda x: x.isNull() | F.isnan(x)
                    | (F.abs(x) == F.lit(float("inf"))))
