"""Vector arithmetic on ARRAY<DOUBLE> and ARRAY<FLOAT> columns, as built-in expressions that run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
INFINITY = float("inf")


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_finite(a: Column) -> Column:
    """True if a vector holds numbers only: no nulls, NaNs or infinities."""
    return F.coalesce(F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITY)), F.lit(False))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, with the cosine held within [-1, 1]; a zero vector on either side raises."""
    size = norm(a) * norm(b)
    fail = F.raise_error(F.lit("cosine distance needs vectors with a norm above zero")).cast("double")
    return F.when(size == 0, fail).otherwise(1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), size))))


def cosine_distance_eps(a: Column, b: Column) -> Column:
    """1 - dot / max(norms, epsilon): neither clipped nor failing, and 1 for a zero vector."""
    return 1.0 - dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPSILON))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def token_distance(a: Column, b: Column) -> Column:
    return F.abs(a.cast("long") - b.cast("long")).cast("double")


def l2_normalized(a: Column) -> Column:
    """Unit vectors in single precision; a zero or non-finite vector raises."""
    single = a.cast("array<float>")
    size = F.sqrt(F.aggregate(single, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).cast("float")
    bad = F.raise_error(F.lit("expected finite embedding rows with a norm above zero")).cast("array<float>")
    return F.when((size > 0) & is_finite(single), F.transform(single, lambda x: (x / size).cast("float"))).otherwise(bad)


def pair_features(left: Column, right: Column) -> dict[str, Column]:
    """The five feature sets of a pair of unit vectors, each ARRAY<FLOAT>."""
    product = F.zip_with(left, right, lambda x, y: (x * y).cast("float"))
    cosine = F.aggregate(product, F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float"))
    gap = F.zip_with(left, right, lambda x, y: F.abs(x - y).cast("float"))
    return {
        "Cosine only": F.array(cosine),
        "Absolute difference": gap,
        "Elementwise product": product,
        "Residual only": F.zip_with(left, right, lambda x, y: (y - cosine * x).cast("float")),
        "Full pair": F.concat(gap, product),
    }


def projected(embedding: Column, coefficients: Sequence[Sequence[float]], intercept: Sequence[float]) -> Column:
    """Relation coordinates: a dot product per relation, plus its intercept. coefficients: a row per relation."""
    return F.array(*[dot(embedding, vector(w)) + F.lit(float(b)) for w, b in zip(coefficients, intercept, strict=True)])


def scaled(values: Column, median: Sequence[float], scale: Sequence[float]) -> Column:
    return F.zip_with(F.zip_with(values, vector(median), lambda x, m: x - m), vector(scale), lambda x, s: x / s)


def unscaled(values: Column, median: Sequence[float], scale: Sequence[float]) -> Column:
    return F.zip_with(F.zip_with(values, vector(scale), lambda x, s: x * s), vector(median), lambda x, m: x + m)


def mean_pooled(states: Column, mask: Column) -> Column:
    """Masked mean of token states (ARRAY<ARRAY<DOUBLE>>) over tokens; the divisor is at least 1."""
    rows = F.zip_with(states, mask, lambda h, m: F.transform(h, lambda x: x * m))
    size = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    zero = F.transform(F.get(states, F.lit(0)), lambda x: F.lit(0.0))
    added = F.aggregate(rows, zero, lambda s, h: F.zip_with(s, h, lambda x, y: x + y))
    return F.transform(added, lambda x: x / size)
