"""Scalar building blocks as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-10
TWO_PI = 2.0 * math.pi


def clipped_ln(price: Column, floor: float = FLOOR) -> Column:
    return F.ln(F.greatest(price, F.lit(floor)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio_deviation(synthetic: Column, real: Column, guard: float = 1e-6) -> Column:
    """|s/r - 1|, or |s| where |r| is within the guard."""
    return F.when(F.abs(real) > guard, F.abs(synthetic / real - 1.0)).otherwise(F.abs(synthetic))


def guarded_ratio(numerator: Column, denominator: Column, guard: float = 1e-6, default: float = 0.0) -> Column:
    return F.when(F.abs(denominator) > guard, numerator / denominator).otherwise(F.lit(default))


def vol_ratio(short: Column, long: Column, guard: float = FLOOR) -> Column:
    """short/long, 1 where the long one is within the guard or missing."""
    return F.when(long > guard, short / long).otherwise(F.lit(1.0))


def is_finite(*columns: Column) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return test


def zero_if_missing(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def cyclic_time(ts: Column) -> dict[str, Column]:
    """Sine and cosine of hour/24, weekday/5 (Monday 0) and month/12."""
    parts = {"hour": F.hour(ts) / 24.0, "dow": F.weekday(ts) / 5.0, "month": F.month(ts) / 12.0}
    return {f"{k}_{f}": fn(TWO_PI * v) for k, v in parts.items() for f, fn in (("sin", F.sin), ("cos", F.cos))}


# Counter-based draws: equal in any engine, on any partitioning.


def word(*parts: Column) -> Column:
    """32 bits of md5 over the parts, colon-joined."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    return word(*parts) / F.lit(4294967296.0)


def uniform_index(n: Column, *parts: Column) -> Column:
    return word(*parts) % n


def normal(*parts: Column) -> Column:
    """Box-Muller from two uniforms; the first is moved off zero."""
    u = (word(*parts, F.lit("a")) + 0.5) / F.lit(4294967296.0)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(TWO_PI * uniform(*parts, F.lit("b")))


def categorical(cumulative: Column, u: Column) -> Column:
    """The first place (from 0) whose cumulative weight exceeds u times the total."""
    total = F.element_at(cumulative, -1)
    return F.least(F.size(F.filter(cumulative, lambda c: c <= u * total)), F.size(cumulative) - 1)


def log_uniform(low: float, high: float, u: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(math.log10(low)) + u * F.lit(math.log10(high) - math.log10(low)))


def integer_gene(low: int, high: int, u: Column) -> Column:
    return F.round(F.lit(float(low)) + u * float(high - low)).cast("int")


def verdict(delta: Column, good: str, bad: str) -> Column:
    return F.when(delta < 0, F.lit(good)).otherwise(F.lit(bad))
