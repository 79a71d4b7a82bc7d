"""Fixed-size arrays of (r, theta) pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import MISS

SHOTS = 10


def pairs(flat: Column) -> Column:
    """A flat array as pairs; an odd length raises."""
    n = F.size(flat)
    even = F.when(n % 2 == 0, n).otherwise(F.raise_error(F.lit("odd number of values")).cast("int"))
    return F.when(even == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(even / 2 - 1, F.lit(0)).cast("int")), lambda k: F.array(F.get(flat, 2 * k), F.get(flat, 2 * k + 1))))


def padded(pairs: Column, n: int = SHOTS) -> Column:
    """The first ``n`` pairs, misses in place of those that lack, flat."""
    miss = F.array(F.lit(MISS), F.lit(MISS))
    return F.flatten(F.concat(F.slice(pairs, 1, n), F.array_repeat(miss, F.greatest(F.lit(0), n - F.size(pairs)))))


def without_misses(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: ~((F.get(p, F.lit(0)) == MISS) & (F.get(p, F.lit(1)) == MISS)))


def label_tensor(pairs: Column, n: int = SHOTS) -> Column:
    """``padded`` in single precision, as trainers take it."""
    return padded(pairs, n).cast("array<float>")
