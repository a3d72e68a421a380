"""Series operators: (series_id, seq, ...) in, lazy DataFrames out. `by` names the keys of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions import columns as C

BY = ("series_id",)


def ordered(by: Sequence[str] = BY, order: str = "seq"):
    """A series in its order. One task sorts one series: meant for bars, which time bounds, and not for ticks."""
    return Window.partitionBy(*by).orderBy(order)


def log_returns(px: DataFrame, by: Sequence[str] = BY, floor: float | None = None) -> DataFrame:
    """ret = difference of ln(price), at the second price of each pair; floor clips prices first."""
    ln = C.clipped_ln(F.col("typical_price"), floor) if floor else F.ln("typical_price")
    return px.withColumn("ret", ln - F.lag(ln).over(ordered(by))).where("ret IS NOT NULL")


def rebuild_prices(returns: DataFrame, by: Sequence[str] = BY, anchor: bool = True) -> DataFrame:
    """returns (by, seq, ret, p0) -> typical_price = p0 * exp(running sum); with the anchor row, one before the first."""
    rows = returns.select(*by, "seq", "ret", "p0")
    if anchor:
        first = rows.groupBy(*by).agg((F.min("seq") - 1).alias("seq"), F.min_by("p0", "seq").alias("p0")).select(*by, "seq", F.lit(0.0).alias("ret"), "p0")
        rows = rows.unionByName(first)
    w = ordered(by).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("typical_price", F.exp(F.ln("p0") + F.sum("ret").over(w)))


def rescale_volatility(px: DataFrame, scale: float, by: Sequence[str] = BY) -> DataFrame:
    """Returns times scale, prices rebuilt from the first real one."""
    p0 = F.first("typical_price").over(ordered(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = log_returns(px.withColumn("p0", p0), by, C.FLOOR).withColumn("ret", F.col("ret") * scale)
    return rebuild_prices(r, by)


def zscore(df: DataFrame, column: str, params: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std by given parameters; as it is without any."""
    if column not in params:
        return df
    mean, std = params[column]
    return df.withColumn(column, (F.col(column) - mean) / std)


def standardise(df: DataFrame, columns: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """Population z-scores within a series, 1e-10 added to the deviation."""
    w = Window.partitionBy(*by)
    return df.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-10) for c in columns})


def minmax(df: DataFrame, column: str, by: Sequence[str] = BY) -> DataFrame:
    """To [0, 1] within a series; a range below 1e-10 counts as 1. lo and span undo it."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    span = F.when(hi - lo < 1e-10, F.lit(1.0)).otherwise(hi - lo)
    return df.withColumns({"lo": lo, "span": span, "scaled": (F.col(column) - lo) / span})


def unscale(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("scaled") * F.col("span") + F.col("lo"))


def rolling_std(column: str, width: int, by: Sequence[str] = BY) -> Column:
    """Sample deviation of the last `width` rows, from the second row on."""
    return F.stddev_samp(column).over(ordered(by).rowsBetween(1 - width, 0))


def rolling_std_filled(df: DataFrame, column: str, width: int, least: int, to: str, by: Sequence[str] = BY) -> DataFrame:
    """With at least `least` rows (2 or more); earlier places get the first value after them.

    Two linear passes: rows count the values from behind, and those of one count are a
    value and the gap before it. (A frame from each row to the end would be read anew for
    each row.)
    """
    frame = ordered(by).rowsBetween(1 - width, 0)
    raw = F.when(F.count(column).over(frame) >= max(2, least), F.stddev_samp(column).over(frame))
    marked = df.withColumn("_raw", raw)
    after = F.count("_raw").over(Window.partitionBy(*by).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(*by, "_after")
    return marked.withColumn("_after", after).withColumn(to, F.max("_raw").over(whole)).drop("_raw", "_after")


def regime_features(px: DataFrame, short: int = 24, long: int = 72, by: Sequence[str] = BY) -> DataFrame:
    """ret, vol, vol_ratio; rows with a missing one are dropped."""
    r = log_returns(px, by, C.FLOOR)
    r = r.withColumns({"vol": rolling_std("ret", short, by), "_long": rolling_std("ret", long, by)})
    return r.withColumn("vol_ratio", C.vol_ratio(F.col("vol"), F.col("_long"))).drop("_long").where(C.is_finite(F.col("ret"), F.col("vol"), F.col("vol_ratio")))


def hybrid_features(px: DataFrame, short: int = 6, mid: int = 24, long: int = 48, by: Sequence[str] = BY) -> DataFrame:
    """As above with minimum counts and back-filled starts; the long deviation is clipped from below."""
    r = log_returns(px, by, C.FLOOR)
    for width, least, to in ((mid, max(1, mid // 4), "vol"), (short, max(1, short // 2), "_short"), (long, max(1, long // 4), "_long")):
        r = rolling_std_filled(r, "ret", width, least, to, by)
    return r.withColumn("vol_ratio", F.col("_short") / F.greatest(F.col("_long"), F.lit(1e-10))).drop("_short", "_long")


def sliding_windows(df: DataFrame, column: str, width: int, by: Sequence[str] = BY, carry: Sequence[str] = ()) -> DataFrame:
    """by, win_idx, last_seq, x: each full window of `width` rows; `carry` comes from the last row."""
    frame = ordered(by).rowsBetween(1 - width, 0)
    out = df.select(*by, F.col("seq").alias("last_seq"), F.collect_list(column).over(frame).alias("x"), (F.row_number().over(ordered(by)) - width).cast("long").alias("win_idx"), *carry)
    return out.where(F.size("x") == width)


def check_long_enough(df: DataFrame, width: int, by: Sequence[str] = BY, what: str = "window_size") -> None:
    """Raises if a series is shorter than `width`."""
    least = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first().n or 0
    if least < width:
        raise ValueError(f"{what} is {width}, but a series has {least} rows")


def supervised_windows(df: DataFrame, column: str, width: int, horizons: Sequence[int], by: Sequence[str] = BY, carry: Sequence[str] = ()) -> DataFrame:
    """x and, for each horizon h, y_h = the value h rows after the window; rows without the furthest are dropped."""
    ahead = {f"y_{h}": F.lead(column, h).over(ordered(by)) for h in horizons}
    with_y = df.withColumns(ahead)
    return sliding_windows(with_y, column, width, by, [*ahead, *carry]).where(F.col(f"y_{max(horizons)}").isNotNull())


def strided_windows(df: DataFrame, column: str, width: int, stride: int | None = None, least: int = 4, by: Sequence[str] = BY) -> DataFrame:
    """Windows at every stride-th place (half the width); where fewer than `least`, those at every place are added."""
    stride = max(1, width // 2) if stride is None else stride
    every = sliding_windows(df, column, width, by)
    few = Window.partitionBy(*by)
    on = F.col("win_idx") % stride == 0
    marked = every.withColumn("_on", on).withColumn("_n", F.sum(on.cast("int")).over(few))
    return marked.where("_on").drop("_on", "_n").unionByName(marked.where(F.col("_n") < least).drop("_on", "_n"))


def demean_windows(windows: DataFrame, column: str = "ret", by: Sequence[str] = ("series_id", "win_idx")) -> DataFrame:
    return windows.withColumn(column, F.col(column) - F.avg(column).over(Window.partitionBy(*by)))


def runs(df: DataFrame, state: str, by: Sequence[str] = BY) -> DataFrame:
    """With run_id, numbering contiguous runs of one state."""
    change = (F.lag(state).over(ordered(by)) != F.col(state)).cast("int")
    return df.withColumn("_c", F.coalesce(change, F.lit(0))).withColumn("run_id", F.sum("_c").over(ordered(by).rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def regime_blocks(df: DataFrame, state: str, column: str = "ret", least: int = 3, by: Sequence[str] = BY) -> DataFrame:
    """Each run of at least `least` rows as one block: by, state, run_id, start, n, rets."""
    grouped = runs(df, state, by).groupBy(*by, state, "run_id")
    return grouped.agg(F.count("*").alias("n"), F.min("seq").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("seq", column))), lambda s: s[column]).alias("rets")).where(F.col("n") >= least)


def holdout(df: DataFrame, share: float = 0.15, by: Sequence[str] = BY) -> DataFrame:
    """is_val: the last max(1, int(share * n)) rows."""
    n = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(ordered(by))
    return df.withColumn("is_val", place > n - F.greatest(F.lit(1), F.floor(n * share)))


def truncate(df: DataFrame, n: int, by: Sequence[str] = BY) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(ordered(by))).where(F.col("_k") <= n).drop("_k")


def prepend(synthetic: DataFrame, real: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Synthetic rows before the real ones, numbered anew."""
    both = synthetic.withColumn("side_ord", F.lit(0)).unionByName(real.withColumn("side_ord", F.lit(1)))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy("side_ord", "seq")).cast("long") - 1)


def augment(real: DataFrame, synthetic: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Both, sorted by date; where both have a date the real row stays."""
    from seriesmill.sources.series import concat_sources, first_per_date, numbered

    both = concat_sources([real.drop("seq"), synthetic.drop("seq")])
    return numbered(first_per_date(both, by), by)


def smooth_boundaries(blocks: DataFrame, weight: float, by: Sequence[str] = BY) -> DataFrame:
    """blocks (by, block, pos, ret): the first point of a block moves towards the last of the one before.

    The last point of a block is what it was unless the block is one point long: then
    its smoothed value goes on, which a fold over such blocks gives.
    """
    w = Window.partitionBy(*by).orderBy("block")
    ends = blocks.groupBy(*by, "block").agg(F.min_by("ret", "pos").alias("first"), F.max_by("ret", "pos").alias("last"), F.count("*").alias("n"))
    # Within a run of blocks of one point: x_k' = (1 - w) x_k + w x_(k-1)'; longer ones start anew.
    anew = F.sum((F.col("n") > 1).cast("int")).over(w)
    grouped = ends.withColumn("_run", anew)
    before = F.collect_list(F.struct("first", "n", "last")).over(Window.partitionBy(*by, "_run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    out = F.aggregate(before, F.lit(None).cast("double"), lambda acc, x: F.when(x["n"] > 1, x["last"]).when(acc.isNull(), x["first"]).otherwise((1 - weight) * x["first"] + weight * acc))
    carried = grouped.withColumn("_out", out).withColumn("_prev", F.lag("_out").over(w))
    joined = blocks.join(carried.select(*by, "block", "_prev"), [*by, "block"])
    return joined.withColumn("ret", F.when((F.col("pos") == 0) & F.col("_prev").isNotNull(), (1 - weight) * F.col("ret") + weight * F.col("_prev")).otherwise(F.col("ret"))).drop("_prev")
