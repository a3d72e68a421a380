"""Statistics of returns and of two samples, one DataFrame function each.

Frames hold (series_id, seq, ret) or, for two samples, also `side` with the values
`real` and `synth`; results have one row for each series (and side).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions import columns as C
from seriesmill.operators.series import BY, log_returns, ordered

SIDES = ("series_id", "side")
# The weights of the composite score and of the sweep score.
COMPOSITE = {"js_divergence": 3.0, "ks_statistic": 2.0, "ac_lag1": 2.0, "ac_lag5": 1.5, "ac_lag24": 1.0, "hurst_diff": 2.0, "vol_cluster": 1.5, "spectral": 1.5, "skew_diff": 1.0, "kurt_diff": 1.0, "std_ratio": 2.0}
SWEEP = {"std_ratio": 3.0, "ac1_ratio": 2.0, "ac5_ratio": 1.5, "js": 2.0, "wass": 500.0, "ks": 1.0, "vc_ratio": 1.5, "hurst_diff": 2.0}


def moment_columns(column: str = "ret") -> dict[str, Column]:
    n = F.count(column).cast("double")
    return {
        "n": F.count(column), "mean": F.avg(column), "std": F.stddev_pop(column), "lo": F.min(column), "hi": F.max(column), "skew": F.skewness(column),
        "skew_unbiased": F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2), "kurt": F.kurtosis(column) + 3.0,
    }


def moments(r: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """n, mean, population std, lo, hi, population and bias-corrected skewness, raw kurtosis."""
    return r.groupBy(*by).agg(*(c.alias(k) for k, c in moment_columns().items()))


def autocorrelation(r: DataFrame, lags: Sequence[int], by: Sequence[str] = BY, absolute: bool = False, prefix: str = "ac") -> DataFrame:
    """Pearson correlation of x[:-k] and x[k:] for each lag k; 0 where a series has no more than k rows."""
    x = F.abs(F.col("ret")) if absolute else F.col("ret")
    df = r.select(*by, x.alias("_x"), *(F.lag(x, k).over(ordered(by)).alias(f"_x{k}") for k in lags))
    return df.groupBy(*by).agg(*(F.when(F.count("*") > k, F.corr(f"_x{k}", "_x")).otherwise(0.0).alias(f"{prefix}_lag{k}") for k in lags))


def leverage(r: DataFrame, lag: int = 1, by: Sequence[str] = BY) -> DataFrame:
    """Correlation of a return with the size of the one `lag` later."""
    df = r.select(*by, "ret", F.abs(F.lead("ret", lag).over(ordered(by))).alias("_later"))
    return df.groupBy(*by).agg(F.when(F.count("*") > lag, F.corr("ret", "_later")).otherwise(0.0).alias("leverage"))


def return_statistics(r: DataFrame, by: Sequence[str] = BY, lags: Sequence[int] = (1, 5, 10, 24)) -> DataFrame:
    """moments, autocorrelation, vc_lag1 and leverage of one pass: one window sort and one aggregate."""
    w, x = ordered(by), F.col("ret")
    df = r.select(*by, "ret", F.abs(x).alias("_a"), F.lag(F.abs(x)).over(w).alias("_a1"), F.lead(F.abs(x)).over(w).alias("_next"), *(F.lag(x, k).over(w).alias(f"_x{k}") for k in lags))
    n = F.count("*")
    return df.groupBy(*by).agg(
        *(c.alias(k) for k, c in moment_columns().items()), *(F.when(n > k, F.corr(f"_x{k}", "ret")).otherwise(0.0).alias(f"ac_lag{k}") for k in lags),
        F.when(n > 1, F.corr("_a1", "_a")).otherwise(0.0).alias("vc_lag1"), F.when(n > 1, F.corr("ret", "_next")).otherwise(0.0).alias("leverage"),
    )


def price_statistics(px: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """max_drawdown and span of one pass."""
    peak = F.max("typical_price").over(ordered(by).rowsBetween(Window.unboundedPreceding, 0))
    dd = px.withColumn("_dd", (F.col("typical_price") - peak) / peak)
    return dd.groupBy(*by).agg(F.min("_dd").alias("max_drawdown"), (F.max("typical_price") - F.min("typical_price")).alias("span"))


def histogram(pair: DataFrame, bins: int, key: Sequence[str] = BY) -> DataFrame:
    """key, side, bin, n, density over the range that both sides share; empty bins are left out."""
    # The range comes from partial aggregates, one row for each key, so that no raw row moves before it is counted.
    span = pair.groupBy(*key).agg(F.min("ret").alias("_lo"), F.max("ret").alias("_hi"))
    place = F.least(F.floor((F.col("ret") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    df = pair.join(span, list(key)).withColumn("bin", place)
    counts = df.groupBy(*key, "side", "bin").agg(F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    total = F.sum("n").over(Window.partitionBy(*key, "side"))
    return counts.withColumn("density", F.col("n") / total / ((F.col("_hi") - F.col("_lo")) / bins)).drop("_lo", "_hi")


def js_divergence(pair: DataFrame, bins: int = 100, key: Sequence[str] = BY, floor: float = 1e-10) -> DataFrame:
    """js: Jensen-Shannon divergence (natural log) of the two densities, `floor` added and normalised anew; js_distance: its root."""
    h = histogram(pair, bins, key).groupBy(*key, "bin").agg(F.coalesce(F.max(F.when(F.col("side") == "real", F.col("density"))), F.lit(0.0)).alias("p"), F.coalesce(F.max(F.when(F.col("side") == "synth", F.col("density"))), F.lit(0.0)).alias("q"))
    w = Window.partitionBy(*key)
    # Bins that neither side fills count by their number: each adds the floor to both sums and nothing to the divergence if the sums agree.
    empty = F.lit(bins) - F.count("*").over(w)
    h = h.withColumns({"_zp": F.sum(F.col("p") + floor).over(w) + empty * floor, "_zq": F.sum(F.col("q") + floor).over(w) + empty * floor, "_empty": empty})

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return (p * F.ln(p / m) + q * F.ln(q / m)) / 2

    full = term((F.col("p") + floor) / F.col("_zp"), (F.col("q") + floor) / F.col("_zq"))
    gap = term(floor / F.col("_zp"), floor / F.col("_zq"))
    out = h.groupBy(*key).agg((F.sum(full) + F.max(F.col("_empty") * gap)).alias("js"))
    return out.select(*key, F.greatest(F.col("js"), F.lit(0.0)).alias("js"), F.sqrt(F.greatest(F.col("js"), F.lit(0.0))).alias("js_distance"))


def _ecdf(pair: DataFrame, key: Sequence[str]) -> DataFrame:
    """For each distinct value: the shares of both sides at or below it, and the gap to the next value."""
    real = (F.col("side") == "real").cast("int")
    values = pair.groupBy(*key, "ret").agg(F.sum(real).alias("a"), F.sum(1 - real).alias("b"))
    w = Window.partitionBy(*key).orderBy("ret")
    whole = Window.partitionBy(*key)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    return values.select(*key, (F.sum("a").over(up) / F.sum("a").over(whole)).alias("fa"), (F.sum("b").over(up) / F.sum("b").over(whole)).alias("fb"), (F.lead("ret").over(w) - F.col("ret")).alias("step"))


def distances(pair: DataFrame, key: Sequence[str] = BY) -> DataFrame:
    """wasserstein and ks, of one pass over the ordered values."""
    gap = F.abs(F.col("fa") - F.col("fb"))
    return _ecdf(pair, key).groupBy(*key).agg(F.sum(gap * F.col("step")).alias("wasserstein"), F.max(gap).alias("ks"))


def ks_pvalue_of(ks: Column, n: Column, m: Column) -> Column:
    """Asymptotic (Kolmogorov's series of 100 terms), as a column."""
    x = ks * F.sqrt(n * m / (n + m))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(C.clip(2 * total, 0.0, 1.0))


def ks_pvalue(ks: float, n: int, m: int) -> float:
    """Asymptotic (Kolmogorov's series)."""
    x = ks * np.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    k = np.arange(1, 101)
    return float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k**2 * x**2)), 0, 1))


#: Mean R/S of one lag over the segments of the array p: differences, their running deviations from the mean, range over deviation.
_RESCALED = """
transform(sequence(2, greatest(2, least({max_lag}, size(p) div 4) - 1)), lag -> named_struct('lag', lag, 'rs',
  aggregate(
    filter(
      transform(sequence(0, cast(ceil((size(p) - lag) / lag) as int) - 1), seg -> transform(
        array(transform(sequence(1, lag - 1), j -> p[seg * lag + j] - p[seg * lag + j - 1])), d -> transform(
          array(aggregate(d, 0D, (a, x) -> a + x) / size(d)), mean -> transform(
            array(sqrt(aggregate(d, 0D, (a, x) -> a + (x - mean) * (x - mean)) / size(d))), std -> if(std > 0,
              aggregate(d, named_struct('at', 0D, 'lo', double('Infinity'), 'hi', double('-Infinity')),
                (a, x) -> named_struct('at', a.at + x - mean, 'lo', least(a.lo, a.at + x - mean), 'hi', greatest(a.hi, a.at + x - mean)), a -> a.hi - a.lo) / std,
              null))[0])[0])[0]),
      x -> x IS NOT NULL),
    named_struct('total', 0D, 'n', 0), (a, x) -> named_struct('total', a.total + x, 'n', a.n + 1), a -> if(a.n > 0, a.total / a.n, null))))"""


def hurst(px: DataFrame, by: Sequence[str] = BY, max_lag: int = 100, correct: bool = False) -> DataFrame:
    """Rescaled-range exponent of price differences, in [0, 1]; 0.5 with fewer than 3 lags.

    As the lag of 2 never has a value, the k-th value stands against the k-th lag from
    2 on; correct=True puts it against its own. A series is one array, read by index for
    every lag, so its rows move once; it must fit in a row (bars, not ticks).
    """
    prices = F.transform(F.array_sort(F.collect_list(F.struct("seq", "typical_price"))), lambda s: s["typical_price"])
    rows = px.groupBy(*by).agg(prices.alias("p"))
    few = F.size("p") < 12
    each = rows.select(*by, F.inline_outer(F.when(~few, F.expr(_RESCALED.format(max_lag=int(max_lag))))))
    rs = each.where(F.col("rs").isNotNull())
    x = F.col("lag") if correct else F.row_number().over(Window.partitionBy(*by).orderBy("lag")) + 1
    fit = rs.withColumn("x", F.ln(x.cast("double"))).groupBy(*by).agg(F.count("*").alias("k"), F.regr_slope(F.ln("rs"), F.col("x")).alias("slope"))
    known = px.select(*by).distinct()
    return known.join(fit, list(by), "left").select(*by, F.when(F.coalesce("k", F.lit(0)) < 3, F.lit(0.5)).otherwise(C.clip(F.col("slope"), 0.0, 1.0)).alias("hurst"))


def spectral_distance(pair: DataFrame, key: Sequence[str] = BY) -> DataFrame:
    """Root mean square of the difference of the normalised power spectra over the common length."""
    key = list(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        a, b = (pdf.loc[pdf["side"] == s, "ret"].to_numpy() for s in ("real", "synth"))
        n = min(len(a), len(b))
        out = None
        if n:
            p, q = (np.abs(np.fft.fft(x[:n])) ** 2 for x in (a, b))
            out = float(np.sqrt(np.mean((p / (p.sum() + 1e-20) - q / (q.sum() + 1e-20)) ** 2)))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in key), out]], columns=[*key, "spectral"])

    types = {f.name: f.dataType.simpleString() for f in pair.schema}
    return pair.select(*key, "side", "seq", "ret").groupBy(*key).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in key) + ", spectral double")


def mmd(pair: DataFrame, width: int = 10, key: Sequence[str] = BY, block: int = 64) -> DataFrame:
    """Squared maximum mean discrepancy (Gaussian kernel) of all windows of either side.

    gamma = 1 / (mean squared distance among the real ones + 1e-8). Windows meet in
    pairs of blocks, whose sums are added up: an array holds block x block distances.
    """
    from seriesmill.operators.series import sliding_windows

    key = list(key)
    w = sliding_windows(pair, "ret", width, [*key, "side"])
    blocks = w.groupBy(*key, "side", F.floor(F.col("win_idx") / block).alias("block")).agg(F.collect_list("x").alias("xs"))

    def square(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)

    def total(d: Column) -> Column:
        return F.aggregate(d, F.lit(0.0), lambda s, v: s + v)

    left, right = (blocks.select(*key, F.col("side").alias(f"side_{n}"), F.col("block").alias(f"block_{n}"), F.col("xs").alias(n)) for n in "ab")
    pairs = left.join(right, key).where("side_a = 'real' OR side_b = 'synth'").withColumn("part", F.concat("side_a", "side_b")).repartition(*key, "part", "block_a", "block_b")
    d = pairs.select(*key, "part", F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: square(x, y)))).alias("d"))
    gamma = d.where("part = 'realreal'").groupBy(*key).agg((1.0 / (F.sum(total(F.col("d"))) / F.sum(F.size("d")) + 1e-8)).alias("gamma"))
    sums = d.join(gamma, key).select(*key, "part", F.size("d").alias("n"), total(F.transform("d", lambda v: F.exp(-F.col("gamma") * v))).alias("k"))
    mean = lambda p: F.sum(F.when(F.col("part") == p, F.col("k"))) / F.sum(F.when(F.col("part") == p, F.col("n")))
    return sums.groupBy(*key).agg((mean("realreal") + mean("synthsynth") - 2 * mean("realsynth")).alias("mmd")).where("mmd IS NOT NULL")


def max_drawdown(px: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    peak = F.max("typical_price").over(ordered(by).rowsBetween(Window.unboundedPreceding, 0))
    return px.withColumn("_dd", (F.col("typical_price") - peak) / peak).groupBy(*by).agg(F.min("_dd").alias("max_drawdown"))


# MacKinnon's approximate p-values of the Dickey-Fuller test with a constant (1994, updated 2010).
_TAU_MAX, _TAU_MIN, _TAU_STAR = 2.74, -18.83, -1.61
_SMALL, _LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def adf_pvalue(x: np.ndarray, max_lag: int = 20) -> float:
    """Augmented Dickey-Fuller with a constant, lag by AIC up to max_lag; -1 where it can't be fitted."""
    from math import erf, sqrt

    x = np.asarray(x, float)
    d = np.diff(x)
    top = min(max_lag, len(x) // 2 - 3)
    if top < 0 or not np.isfinite(x).all() or np.ptp(x) == 0:
        return -1.0

    def regress(p: int, skip: int) -> tuple[float, float]:
        y = d[skip:]
        cols = [x[skip : len(x) - 1], *(d[skip - k : len(d) - k] for k in range(1, p + 1)), np.ones(len(y))]
        a = np.column_stack(cols)
        if len(y) <= a.shape[1]:
            return np.inf, np.nan
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        rss = float(np.sum((y - a @ beta) ** 2))
        if rss <= 0:
            return np.inf, np.nan
        aic = len(y) * (np.log(2 * np.pi) + np.log(rss / len(y)) + 1) + 2 * a.shape[1]
        cov = np.linalg.pinv(a.T @ a) * rss / (len(y) - a.shape[1])
        return aic, float(beta[0] / np.sqrt(cov[0, 0]))

    best = min(range(top + 1), key=lambda p: regress(p, top)[0])
    tau = regress(best, best)[1]
    if not np.isfinite(tau):
        return -1.0
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    z = np.polyval((_SMALL if tau <= _TAU_STAR else _LARGE)[::-1], tau)
    return float(0.5 * (1 + erf(z / sqrt(2))))


def adf(r: DataFrame, by: Sequence[str] = BY, max_lag: int = 20) -> DataFrame:
    by = list(by)
    types = {f.name: f.dataType.simpleString() for f in r.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), adf_pvalue(pdf.sort_values("seq")["ret"].to_numpy(), max_lag)]], columns=[*by, "adf_pvalue"])

    return r.select(*by, "seq", "ret").groupBy(*by).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in by) + ", adf_pvalue double")


def sides(df: DataFrame, columns: Sequence[str], key: Sequence[str] = BY) -> DataFrame:
    """(key, side, x...) -> one row: key, real_x..., synth_x..."""
    return df.groupBy(*key).agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("real", "synth") for c in columns))


def distribution_report(pair_px: DataFrame, key: Sequence[str] = BY, with_adf: bool = False) -> DataFrame:
    """pair_px (series_id, side, seq, typical_price) -> the distribution evaluator's fields."""
    by = [*key, "side"]
    r = log_returns(pair_px, by)
    base = sides(return_statistics(r, by, (1, 5, 10)), ["mean", "std", *(f"ac_lag{k}" for k in (1, 5, 10))], key)
    out = base.join(js_divergence(r, 100, key), list(key)).join(distances(r, key), list(key))
    if with_adf:
        out = out.join(sides(adf(r, by), ["adf_pvalue"], key), list(key))
    name = {"real": "real", "synth": "synthetic"}
    fields = [F.col("js").alias("kl_divergence"), F.col("wasserstein").alias("wasserstein_distance")]
    for s, long in name.items():
        fields += [F.col(f"{s}_mean").alias(f"{long}_return_mean"), F.col(f"{s}_std").alias(f"{long}_return_std"), *(F.col(f"{s}_ac_lag{k}").alias(f"{long}_autocorr_lag{k}") for k in (1, 5, 10))]
        if with_adf:
            fields.append(F.col(f"{s}_adf_pvalue").alias(f"{long}_adf_pvalue"))
    score = F.col("js") + 0.1 * F.col("wasserstein") + F.abs(F.col("real_std") - F.col("synth_std"))
    return out.select(*key, *fields, score.alias("quality_score"))


def metric_record(pair_px: DataFrame, key: Sequence[str] = BY, with_spectrum: bool = True) -> DataFrame:
    """All metrics of the comparison of two series, one row for each key."""
    by, k = [*key, "side"], list(key)
    r = log_returns(pair_px, by, C.FLOOR)
    out = sides(return_statistics(r, by), ["mean", "std", "skew", "kurt", "n", *(f"ac_lag{x}" for x in (1, 5, 10, 24)), "vc_lag1", "leverage"], key)
    out = out.join(js_divergence(r, 99, key).select(*k, "js_distance"), k).join(distances(r, key), k)
    out = out.join(sides(hurst(pair_px, by), ["hurst"], key), k).join(sides(price_statistics(pair_px, by), ["max_drawdown", "span"], key), k)
    if with_spectrum:
        out = out.join(spectral_distance(r, key), k)
    s, t = (lambda c: F.col(f"synth_{c}")), (lambda c: F.col(f"real_{c}"))
    fields = {
        "mean_ratio": C.guarded_ratio(s("mean"), t("mean"), 1e-10), "std_ratio": s("std") / t("std"), "skew_real": t("skew"), "skew_synth": s("skew"), "skew_diff": F.abs(s("skew") - t("skew")),
        "kurt_real": t("kurt"), "kurt_synth": s("kurt"), "kurt_diff": F.abs(s("kurt") - t("kurt")), "ks_statistic": F.col("ks"), "ks_pvalue": ks_pvalue_of(F.col("ks"), t("n").cast("double"), s("n").cast("double")), "js_divergence": F.col("js_distance"), "wasserstein": F.col("wasserstein"),
        "ac_lag1_real": t("ac_lag1"), "ac_lag1_synth": s("ac_lag1"), **{f"ac_lag{x}_ratio": C.guarded_ratio(s(f"ac_lag{x}"), t(f"ac_lag{x}")) for x in (1, 5, 10, 24)},
        "vol_cluster_real": t("vc_lag1"), "vol_cluster_synth": s("vc_lag1"), "vol_cluster_ratio": C.guarded_ratio(s("vc_lag1"), t("vc_lag1")), "leverage_real": t("leverage"), "leverage_synth": s("leverage"),
        "hurst_real": t("hurst"), "hurst_synth": s("hurst"), "hurst_diff": F.abs(s("hurst") - t("hurst")), "max_dd_real": t("max_drawdown"), "max_dd_synth": s("max_drawdown"), "price_range_ratio": s("span") / t("span"),
    }
    if with_spectrum:
        fields["spectral_distance"] = F.col("spectral")
    return out.select(*k, *(c.alias(name) for name, c in fields.items()), t("n").alias("n_real"), s("n").alias("n_synth"), *(c(f"ac_lag{x}").alias(f"_{side}{x}") for x in (5, 24) for side, c in (("s", s), ("t", t))))


def composite(record: DataFrame, weights: dict[str, float] | None = None, key: Sequence[str] = BY) -> DataFrame:
    """The weighted mean of eleven deviations (0 is perfect), from metric_record; also each term."""
    weights = weights or COMPOSITE
    c = F.col
    terms = {
        "js_divergence": c("js_divergence"), "ks_statistic": c("ks_statistic"), "ac_lag1": C.ratio_deviation(c("ac_lag1_synth"), c("ac_lag1_real")), "ac_lag5": C.ratio_deviation(c("_s5"), c("_t5")),
        "ac_lag24": C.ratio_deviation(c("_s24"), c("_t24")), "hurst_diff": c("hurst_diff"), "vol_cluster": C.ratio_deviation(c("vol_cluster_synth"), c("vol_cluster_real")), "spectral": c("spectral_distance"),
        "skew_diff": c("skew_diff"), "kurt_diff": c("kurt_diff") / F.greatest(c("kurt_real"), F.lit(1.0)), "std_ratio": F.abs(c("std_ratio") - 1.0),
    }
    out = record.select(*key, *(terms[k].alias(k) for k in weights))
    total = sum(weights.values())
    score = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)) / total
    return out.withColumn("score", score)


def sweep_score(record: DataFrame, key: Sequence[str] = BY) -> DataFrame:
    """The eight-term score of the sweeps, from metric_record averaged over seeds."""
    c = F.col
    part = {"std_ratio": F.abs(c("std_ratio") - 1), "ac1_ratio": F.abs(c("ac_lag1_ratio") - 1), "ac5_ratio": F.abs(c("ac_lag5_ratio") - 1), "js": c("js_divergence"), "wass": c("wasserstein"), "ks": c("ks_statistic"), "vc_ratio": F.abs(c("vol_cluster_ratio") - 1), "hurst_diff": c("hurst_diff")}
    return record.select(*key, sum((part[k] * w for k, w in SWEEP.items()), F.lit(0.0)).alias("score"))


def deviations(runs: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Over seeds: mean, std, min, max, greatest relative deviation, and the three recommended tolerances."""
    first = runs.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n"))
    safe = F.abs(F.col("mean")) > 1e-10
    # The furthest value from the mean is an end.
    furthest = F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo"))
    first = first.withColumn("max_dev", F.when(safe, furthest / F.abs(F.col("mean"))).otherwise(0.0))
    return first.withColumns({
        "tol_double": F.when(safe, F.least(2 * F.col("max_dev"), F.lit(0.5))).otherwise(0.2),
        "tol_sigma": F.greatest(F.when(safe, 3 * F.col("std") / F.abs(F.col("mean"))).otherwise(0.0), F.col("max_dev")) * 1.2,
        "tol_gap": F.col("max_dev") * 1.2,
    })
