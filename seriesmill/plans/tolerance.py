"""Tolerance protocols over a fact table (protocol, seed, val_mae, test_mae, naive_mae, real)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.operators import stats as T


def summary(runs: DataFrame, by: Sequence[str] = ("protocol",), column: str = "val_mae", naive: str | None = None) -> DataFrame:
    """Mean, deviation, range, greatest relative deviation and the recommended tolerances; naive is taken off first (fitness)."""
    runs = runs.withColumn("_x", F.col(column) - F.col(naive) if naive else F.col(column))
    return T.deviations(runs, "_x", by)


def real_gap(runs: DataFrame, by: Sequence[str] = ("protocol",)) -> DataFrame:
    """runs with `real` (boolean): relative gaps of synthetic to real runs, mean and greatest, and the tolerance they ask for."""
    real = runs.groupBy(*by).agg(*(F.avg(F.when(F.col("real"), F.col(c))).alias(f"_{c}") for c in ("val_mae", "test_mae")))
    both = runs.where("NOT real").join(real, list(by))
    gaps = both.withColumns({g: F.abs(F.col(c) - F.col(f"_{c}")) / F.col(f"_{c}") for g, c in (("val_gap", "val_mae"), ("test_gap", "test_mae"))})
    out = gaps.groupBy(*by).agg(F.avg("val_gap").alias("mean_val_gap"), F.max("val_gap").alias("max_val_gap"), F.avg("test_gap").alias("mean_test_gap"), F.max("test_gap").alias("max_test_gap"))
    return out.withColumn("tolerance", F.greatest("max_val_gap", "max_test_gap") * 1.2)


def seed_ratios(record: DataFrame, by: Sequence[str]) -> DataFrame:
    """Averages over seeds of the moments and correlations of either side and of their ratios."""
    return record.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("std_ratio", "ac_lag1_ratio", "skew_real", "skew_synth", "kurt_real", "kurt_synth")))
