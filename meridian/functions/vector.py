"""Distance kernels as Catalyst expressions.

Both metrics accumulate in DOUBLE from the first to the last dimension, so a result is
reproducible bit for bit whatever the partitioning. With a known dimension the kernel is an
unrolled expression that stays inside whole-stage codegen; otherwise it is a higher-order fold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

L2 = "L2"
COSINE = "COSINE"
METRICS = (L2, COSINE)

#: Beyond this many dimensions generated code would outgrow one method; the fold takes over.
UNROLL_LIMIT = 128


class DimensionError(ValueError):
    """A vector's length differs from the collection's dimension."""


def check_vector(vector: Sequence[float], dim: int | None = None) -> list[float]:
    """Finite floats of the stated dimension, or DimensionError / ValueError."""
    out = [float(x) for x in vector]
    if dim is not None and len(out) != dim:
        raise DimensionError(f"vector has {len(out)} dimensions, the collection has {dim}")
    if not all(map(math.isfinite, out)):
        raise ValueError("vector elements must be finite")
    return out


def _array(vector: Column | str | Sequence[float]) -> Column:
    if isinstance(vector, str):
        vector = F.col(vector)
    if isinstance(vector, Column):
        return vector.cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in vector])


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def _items(v: Column | str | Sequence[float], dim: int) -> list[str]:
    if isinstance(v, str):
        return [f"cast(get({v}, {i}) as double)" for i in range(dim)]
    return [f"cast('{float(x)!r}' as double)" for x in v]


def _unrolled(a: str, b: str | Sequence[float], dim: int, term: str) -> Column:
    """The sum of a term over all dimensions, first to last, from one SQL text."""
    terms = [term.format(x=x, y=y) for x, y in zip(_items(a, dim), _items(b, dim), strict=True)]
    return F.expr(" + ".join(["cast(0 as double)", *terms]))


def _short(a: Column | str, b: Column | str | Sequence[float], dim: int | None) -> bool:
    return dim is not None and dim <= UNROLL_LIMIT and isinstance(a, str) and not isinstance(b, Column)


def l2_squared(a: Column | str, b: Column | str | Sequence[float], dim: int | None = None) -> Column:
    """Squared Euclidean distance (no square root); unrolled for columns given by name with a known dimension."""
    if _short(a, b, dim):
        return _unrolled(a, b, dim, "({x} - {y}) * ({x} - {y})")
    return _fold(F.zip_with(_array(a), _array(b), lambda x, y: (x - y) * (x - y)))


def dot(a: Column | str, b: Column | str | Sequence[float], dim: int | None = None) -> Column:
    if _short(a, b, dim):
        return _unrolled(a, b, dim, "{x} * {y}")
    return _fold(F.zip_with(_array(a), _array(b), lambda x, y: x * y))


def cosine_distance(a: Column | str, b: Column | str | Sequence[float], dim: int | None = None) -> Column:
    """1 - cosine similarity, clamped to [0, 2]; exactly 1 where either norm is zero."""
    norm_a = F.sqrt(dot(a, a, dim))
    norm_b = F.sqrt(dot(b, b, dim)) if isinstance(b, Column | str) else F.lit(math.sqrt(_fsum([float(x) for x in b])))
    den = norm_a * norm_b
    sim = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b, dim) / F.nullif(den, F.lit(0.0))))
    return F.when(den == 0.0, F.lit(1.0)).otherwise(F.lit(1.0) - sim)


def _fsum(xs: list[float]) -> float:
    total = 0.0
    for x in xs:
        total += x * x
    return total


def distance(metric: str, a: Column | str, b: Column | str | Sequence[float], dim: int | None = None) -> Column:
    """The kernel for a metric, chosen when the plan is built."""
    if metric == L2:
        return l2_squared(a, b, dim)
    if metric == COSINE:
        return cosine_distance(a, b, dim)
    raise ValueError(f"unknown metric {metric!r}")
