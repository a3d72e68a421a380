"""What the operators of this subpackage share: reading, cutting lineage, hot keys, prefix sums, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmill.sources.tables import cut, cut_table, remove, remove_at_exit, shared_folder  # noqa: F401  for the operators too

#: Keys fall into so many bins by hash; a bin with more than one HOT_SHARE-th of all rows (and HOT_ROWS) is hot.
BINS, HOT_SHARE, HOT_ROWS = 1 << 13, 256, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_buckets(rows: int, per_bucket: int = 50_000, least: int = 16) -> int:
    """Buckets for a two-level rank, so that one bucket stays small at every size."""
    return max(least, -(-rows // per_bucket))


def utf8_bytes(text: Column) -> Column:
    """Bytes of the text; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, beside which no name of an operator's own can clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def columns_of(docs: DataFrame, row: str = "row") -> list[Column]:
    """The columns of docs out of `whole_row`."""
    return [F.col(row).getField(c).alias(c) for c in docs.columns]


def bin_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BINS)).cast("int")


def hot_bins(df: DataFrame, keys: Sequence[str]) -> list[tuple[int, int]]:
    """(bin, salts) of the hot bins of keys: fewer than HOT_SHARE; counts of at most BINS bins come to the driver."""
    counts = df.groupBy(bin_of(keys).alias("bin")).agg(F.count("*").alias("n")).collect()
    limit = max(sum(r.n for r in counts) / HOT_SHARE, HOT_ROWS)
    return sorted((r.bin, int(-(-r.n // limit))) for r in counts if r.n > limit)


def salts_of(keys: Sequence[str], hot: list[tuple[int, int]]) -> Column:
    """Into how many parts the rows of a row's key go: 1 unless its bin is hot."""
    if not hot:
        return F.lit(1)
    known = F.create_map(*(F.lit(x) for pair in hot for x in pair))
    return F.coalesce(F.try_element_at(known, bin_of(keys)), F.lit(1))


def join_salted(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hot: list[tuple[int, int]] | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """left join right on keys (equal names, no nulls), the rows of a hot key of left spread over several tasks.

    hot: its hot bins, if known; by: the keys that they are of, if not all.

    Only the rows of right with a key in a hot bin are repeated, once for each part. A
    row of left has its part from its place in its own partition, so that equal rows
    spread too: left must be read from a table or a checkpoint, where places are stable.
    """
    keys = list(keys)
    hot = hot_bins(left, keys) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    salts = salts_of(by or keys, hot)
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).cast("int")
    left = left.withColumn("_place", place).withColumn("_salt", F.pmod("_place", salts)).drop("_place")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def two_level_offsets(df: DataFrame, keys: list[str], bucket: str, size: Column) -> DataFrame:
    """keys, bucket, before: the sum of `size` over the lower buckets of the same keys.

    The sums are taken before any shuffle, so a key with a third of all rows costs
    as many rows here as it has buckets.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(size).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("before"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, label): label is the smallest node that node reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Minima are
    aggregated before the shuffle and joined back with hubs split among tasks; each
    round is cut by a checkpoint.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = cut(both)
    known = None
    for _ in range(rounds):
        two_way = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two_way.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = join_salted(two_way, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        current = cut(small.distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
