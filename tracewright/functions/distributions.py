"""Column expressions over count vectors and distributions (arrays of doubles)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def normalize(v: Column, uniform_if_empty: bool = True) -> Column:
    """Shares of a count vector; without any mass uniform, or zeros."""
    empty = F.transform(v, lambda x: (F.lit(1.0) / F.size(v)) if uniform_if_empty else F.lit(0.0))
    return F.when(total(v) == 0, empty).otherwise(F.transform(v, lambda x: x / total(v)))


def entropy(p: Column, base: float = math.e) -> Column:
    nats = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return nats if base == math.e else nats / math.log(base)


def jsd_term(p: Column, q: Column) -> Column:
    """One coordinate's share of the Jensen-Shannon divergence, in nats."""
    m = (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return (half(p) + half(q)) / 2


def jsd(p: Column, q: Column, base: float = 2.0) -> Column:
    """Jensen-Shannon divergence of two distributions of one length."""
    return F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, jsd_term), F.lit(0.0), lambda a, x: a + x) / math.log(base))


def jsd_checked(p: Column, q: Column, base: float = 2.0) -> Column:
    """jsd of raw vectors: normalises them and raises on negative, infinite or undefined entries and unequal lengths."""
    bad = lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == F.lit(float("inf"))))
    wrong = bad(p) | bad(q) | (F.size(p) != F.size(q))
    return F.when(wrong, F.raise_error(F.lit("distributions must be finite, non-negative and of one length"))).otherwise(jsd(normalize(p), normalize(q), base))


def total_variation(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / 2


def hellinger(p: Column, q: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(p, q, lambda a, b: F.pow(F.sqrt(a) - F.sqrt(b), 2)), F.lit(0.0), lambda a, x: a + x) / 2)


def symmetric_kl(p: Column, q: Column, eps: float = 1e-9) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: (a - b) * F.log((a + eps) / (b + eps))), F.lit(0.0), lambda a, x: a + x)


def cosine_distance(p: Column, q: Column) -> Column:
    dot = F.aggregate(F.zip_with(p, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((norm(p) == 0) | (norm(q) == 0), F.lit(1.0)).otherwise(1 - dot / (norm(p) * norm(q)))
