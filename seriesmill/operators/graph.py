"""Quantile states and their transition graph, as edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.operators.series import BY, ordered


def quantile_edges(r: DataFrame, n_bins: int = 50, column: str = "ret", by: Sequence[str] = BY) -> DataFrame:
    """by, edges: the distinct exact quantiles at 0, 1/n, ..., 1."""
    probs = F.array(*(F.lit(k / n_bins) for k in range(n_bins + 1)))
    return r.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile(column, probs))).alias("edges"))


def quantile_states(r: DataFrame, n_bins: int = 50, column: str = "ret", by: Sequence[str] = BY) -> DataFrame:
    """state: how many inner edges are at or below the value."""
    edges = quantile_edges(r, n_bins, column, by)
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return r.join(edges, list(by)).withColumn("state", F.size(F.filter(inner, lambda e: F.col(column) >= e))).withColumn("n_states", F.size("edges") - 1).drop("edges")


def transitions(states: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """src, dst, cnt, p: followers of each state, as shares of it."""
    pairs = states.select(*by, F.col("state").alias("src"), F.lead("state").over(ordered(by)).alias("dst")).where("dst IS NOT NULL")
    edges = pairs.groupBy(*by, "src", "dst").agg(F.count("*").alias("cnt"))
    return edges.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*by, "src")))


def smoothed_transitions(states: DataFrame, add: float = 0.01, by: Sequence[str] = BY) -> DataFrame:
    """As `transitions` over every pair of 0 to the greatest state, `add` on each count."""
    top = states.groupBy(*by).agg(F.max("state").alias("_top"))
    dense = top.withColumn("src", F.explode(F.sequence(F.lit(0), "_top"))).withColumn("dst", F.explode(F.sequence(F.lit(0), "_top"))).drop("_top")
    counts = dense.join(transitions(states, by).drop("p"), [*by, "src", "dst"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return counts.withColumn("p", (F.col("cnt") + add) / F.sum(F.col("cnt") + add).over(Window.partitionBy(*by, "src")))


def frequencies(states: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    n = states.groupBy(*by, "state").agg(F.count("*").alias("n"))
    return n.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def density(states: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Share of the pairs of states that occur."""
    size = states.groupBy(*by).agg(F.max("n_states").alias("k"))
    return transitions(states, by).groupBy(*by).agg(F.count("*").alias("edges")).join(size, list(by)).withColumn("density", F.col("edges") / (F.col("k") * F.col("k")))


def walk_tables(edges: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """by, src, dsts, cums: the followers of each state and the running sums of their weights."""
    w = Window.partitionBy(*by, "src").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    cum = edges.withColumn("cum", F.sum("p").over(w))
    rows = cum.groupBy(*by, "src").agg(F.array_sort(F.collect_list(F.struct("dst", "cum"))).alias("e"))
    return rows.select(*by, "src", F.col("e.dst").alias("dsts"), F.col("e.cum").alias("cums"))
