"""Regime models: hidden Markov fits, GARCH by a grid, change points with clustering.

Fits are table functions: one group for each series (and configuration), run in
parallel; statistics of labelled returns and the GARCH grid are plain DataFrame work.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions import columns as C
from seriesmill.operators.series import BY

# The grid of the GARCH fit.
ALPHAS = (0.02, 0.05, 0.08, 0.12, 0.15, 0.20)
BETAS = (0.70, 0.75, 0.80, 0.85, 0.88, 0.90, 0.93, 0.95)


def regime_stats(labelled: DataFrame, by: Sequence[str] = (*BY, "regime"), least: int = 0) -> DataFrame:
    """n, mean, std, skew, kurt, vol_mean and the lag-1 correlation within each regime's own returns.

    Regimes of fewer than `least` rows get zero mean, skew and ar1 and the deviation of the whole series.
    """
    prev = F.lag("ret").over(Window.partitionBy(*by).orderBy("seq"))
    whole = F.stddev_pop("ret").over(Window.partitionBy(*by[:-1]))
    r = labelled.withColumns({"_prev": prev, "_all": whole})
    vol = F.avg("vol") if "vol" in labelled.columns else F.lit(None).cast("double")
    out = r.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"),
        C.zero_if_missing(F.corr("_prev", "ret")).alias("ar1"), vol.alias("vol_mean"), F.first("_all").alias("_all"),
    )
    few = F.col("n") < least
    plain = {"mean": F.lit(0.0), "skew": F.lit(0.0), "ar1": F.lit(0.0), "std": F.col("_all"), "vol_mean": F.col("_all"), "kurt": F.lit(3.0)}
    return out.select(*by, "n", *(F.when(few, plain[c]).otherwise(F.col(c)).alias(c) for c in ("mean", "std", "skew", "kurt", "ar1", "vol_mean")))


def garch_grid(r: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """by, alpha, beta, omega, ll: the Gaussian log-likelihood (without constants) of each point of the grid, variance targeted.

    The variance recursion is one fold over the ordered returns of a series that carries all points.
    """
    rows = r.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "ret"))).alias("_r"), F.avg("ret").alias("_mean"), F.var_pop("ret").alias("_var"))
    rows = rows.withColumn("_x", F.transform("_r", lambda s: s["ret"] - F.col("_mean")))
    points = [(a, b) for a in ALPHAS for b in BETAS if a + b < 0.999]
    start = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), (F.col("_var") * (1 - F.lit(a) - F.lit(b))).alias("omega"), F.col("_var").alias("s2"), F.lit(None).cast("double").alias("prev"), F.lit(0.0).alias("ll")) for a, b in points))
    step = """aggregate(_x, _start, (points, x) -> transform(points, g -> transform(
      array(if(g.prev IS NULL, g.s2, greatest(g.omega + g.alpha * g.prev * g.prev + g.beta * g.s2, 1e-20D))), s2 ->
      named_struct('alpha', g.alpha, 'beta', g.beta, 'omega', g.omega, 's2', s2, 'prev', x, 'll', g.ll - 0.5D * (ln(s2) + x * x / s2)))[0]))"""
    done = rows.withColumn("_start", start).select(*by, F.inline(F.expr(step)))
    return done.where("omega > 0").select(*by, "alpha", "beta", "omega", "ll")


def garch_fit(r: DataFrame, by: Sequence[str] = BY, least: int = 10) -> DataFrame:
    """The best point of the grid; series of fewer than `least` returns get alpha 0.05, beta 0.90 and their own variance."""
    best = garch_grid(r, by).groupBy(*by).agg(F.max_by(F.struct("alpha", "beta", "omega", "ll"), F.struct("ll", -F.col("alpha"), -F.col("beta"))).alias("g"))
    size = r.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop("ret").alias("var"))
    few = F.col("n") < least
    out = size.join(best, list(by), "left")
    a, b = (F.when(few, F.lit(d)).otherwise(F.coalesce(F.col(f"g.{c}"), F.lit(d))) for c, d in (("alpha", 0.05), ("beta", 0.90)))
    omega = F.when(few, F.col("var")).otherwise(F.coalesce(F.col("g.omega"), F.col("var") * 0.05))
    out = out.select(*by, "n", "var", a.alias("alpha"), b.alias("beta"), omega.alias("omega"))
    return out.withColumn("long_run_var", F.when(few, F.col("var")).otherwise(F.col("omega") / F.greatest(1 - F.col("alpha") - F.col("beta"), F.lit(0.001))))


@dataclass
class Hmm:
    """A Gaussian hidden Markov model."""

    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    covars: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.start)))
        for k, (m, c) in enumerate(zip(self.means, self.covars)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, k] = -0.5 * (np.sum(z * z, axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()
        return out

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        logs, move = self.log_density(x), np.log(self.move + 1e-300)
        score, back = np.log(self.start + 1e-300) + logs[0], np.zeros((len(x), len(self.start)), int)
        for t in range(1, len(x)):
            total = score[:, None] + move
            back[t] = total.argmax(axis=0)
            score = total.max(axis=0) + logs[t]
        path = np.empty(len(x), int)
        path[-1] = score.argmax()
        for t in range(len(x) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def fit_hmm(x: np.ndarray, k: int, kind: str = "full", rounds: int = 200, tol: float = 1e-3, floor: float = 1e-3) -> Hmm:
    """Baum-Welch with scaled passes; starts from the quantiles of the second feature (volatility), so equal data give equal fits."""
    n, d = x.shape
    order = np.argsort(x[:, min(1, d - 1)], kind="stable")
    parts = np.array_split(order, k)
    scale = np.cov(x.T, bias=True).reshape(d, d)
    ridge = floor * np.diag(np.maximum(np.diag(scale), 1e-12))
    means = np.array([x[p].mean(axis=0) if len(p) else x.mean(axis=0) for p in parts])
    covars = np.array([scale + ridge] * k)
    start, move = np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    model, last = Hmm(start, move, means, covars), -np.inf
    for _ in range(rounds):
        logs = model.log_density(x)
        top = logs.max(axis=1, keepdims=True)
        dens = np.exp(logs - top) + 1e-300
        fwd, norm = np.empty((n, k)), np.empty(n)
        a = model.start * dens[0]
        for t in range(n):
            if t:
                a = (fwd[t - 1] @ model.move) * dens[t]
            norm[t] = a.sum()
            fwd[t] = a / norm[t]
        bwd = np.ones((n, k))
        for t in range(n - 2, -1, -1):
            bwd[t] = model.move @ (dens[t + 1] * bwd[t + 1]) / norm[t + 1]
        ll = float(np.log(norm).sum() + top.sum())
        post = fwd * bwd
        post /= post.sum(axis=1, keepdims=True)
        pair = model.move * (fwd[:-1].T @ (dens[1:] * bwd[1:] / norm[1:, None]))
        weight = post.sum(axis=0) + 1e-12
        means = post.T @ x / weight[:, None]
        covars = np.empty((k, d, d))
        for j in range(k):
            z = x - means[j]
            covars[j] = (post[:, j, None] * z).T @ z / weight[j]
        if kind == "diag":
            covars = np.array([np.diag(np.diag(c)) for c in covars])
        elif kind == "tied":
            covars = np.array([(covars * weight[:, None, None]).sum(axis=0) / weight.sum()] * k)
        model = Hmm(post[0], pair / pair.sum(axis=1, keepdims=True), means, covars + ridge)
        if ll - last < tol:
            break
        last = ll
    return model


def _types(df: DataFrame, names: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def hmm_regimes(features: DataFrame, k: int = 4, by: Sequence[str] = BY, normalise: bool = True, kind: str = "full") -> DataFrame:
    """features (by, seq, ret, vol, vol_ratio) -> these and regime, and the model as JSON (start, move) on each row's series."""
    by = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        x = pdf[["ret", "vol", "vol_ratio"]].to_numpy(float)
        if normalise:
            x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-10)
        model = fit_hmm(x, min(k, max(1, len(x) // 2)), kind)
        pdf["regime"] = model.viterbi(x).astype("int32")
        pdf["model"] = json.dumps({"start": model.start.tolist(), "move": model.move.tolist()})
        return pdf[[*by, "seq", "ret", "vol", "vol_ratio", "regime", "model"]]

    return features.select(*by, "seq", "ret", "vol", "vol_ratio").groupBy(*by).applyInPandas(run, f"{_types(features, by)}, seq long, ret double, vol double, vol_ratio double, regime int, model string")


def pelt(x: np.ndarray, penalty: float = 3.0, least: int = 30, jump: int = 5) -> list[int]:
    """Ends of segments that minimise a Gaussian-kernel cost plus a penalty for each; candidates every `jump` places."""
    n = len(x)
    d2 = (x[:, None] - x[None, :]) ** 2
    med = np.median(d2[np.triu_indices(n, 1)]) if n > 1 else 0.0
    gram = np.exp(-np.clip(d2 / med if med > 0 else d2, 1e-2, 1e2))
    np.fill_diagonal(gram, 1.0)
    grid = np.pad(gram.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))

    def cost(a: int, b: int) -> float:
        return (b - a) - (grid[b, b] - grid[a, b] - grid[b, a] + grid[a, a]) / (b - a)

    ends = [*[e for e in range(0, n, jump) if e >= least], n]
    best, cuts, open_starts = {0: 0.0}, {0: []}, [0]
    for e in ends:
        scored = [(best[s] + cost(s, e) + penalty, s) for s in open_starts if e - s >= least]
        if not scored:
            continue
        total, s = min(scored)
        best[e], cuts[e] = total, [*cuts[s], e]
        open_starts = [s for s in open_starts if e - s < least or best[s] + cost(s, e) <= total] + [e]
    return cuts.get(n) or [n]


def ward(z: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by Ward's merging; clusters are numbered by their first member."""
    groups = [[i] for i in range(len(z))]
    while len(groups) > max(1, k):
        best = None
        for i in range(len(groups)):
            for j in range(i):
                a, b = z[groups[i]], z[groups[j]]
                gap = len(a) * len(b) / (len(a) + len(b)) * np.sum((a.mean(axis=0) - b.mean(axis=0)) ** 2)
                if best is None or gap < best[0]:
                    best = gap, i, j
        _, i, j = best
        groups[j] += groups.pop(i)
    labels = np.empty(len(z), int)
    for c, members in enumerate(sorted(map(sorted, groups))):
        labels[members] = c
    return labels


def segment_features(r: np.ndarray, bounds: Sequence[int]) -> np.ndarray:
    """Mean, deviation, bias-corrected skewness, lag-1 correlation and ln(length) of each segment; missing ones are 0."""
    out, a = [], 0
    for b in bounds:
        s = r[a:b]
        n, std = len(s), s.std()
        m3 = np.mean((s - s.mean()) ** 3)
        skew = m3 / std**3 * np.sqrt(n * (n - 1)) / (n - 2) if std > 0 and n > 2 else 0.0
        ac = np.corrcoef(s[:-1], s[1:])[0, 1] if n > 2 and std > 0 and s[:-1].std() > 0 and s[1:].std() > 0 else 0.0
        out.append([s.mean(), std, skew, ac, np.log(n)])
        a = b
    return np.nan_to_num(np.array(out))


def detect_regimes(r: DataFrame, k: int = 4, by: Sequence[str] = BY, penalty: float = 3.0, least: int = 30, jump: int = 5) -> DataFrame:
    """segment and regime of each return: change points, halving the penalty once if there are fewer segments than k, then clusters of segments."""
    by = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        x = pdf["ret"].to_numpy(float)
        bounds = pelt(x, penalty, least, jump)
        if len(bounds) < k:
            bounds = pelt(x, penalty / 2, least, jump)
        f = segment_features(x, bounds)
        z = (f - f.mean(axis=0)) / (f.std(axis=0) + 1e-10)
        labels = ward(z, k)
        sizes = np.diff([0, *bounds])
        pdf["segment"] = np.repeat(np.arange(len(bounds)), sizes).astype("int32")
        pdf["regime"] = np.repeat(labels, sizes).astype("int32")
        return pdf[[*by, "seq", "ret", "segment", "regime"]]

    return r.select(*by, "seq", "ret").groupBy(*by).applyInPandas(run, f"{_types(r, by)}, seq long, ret double, segment int, regime int")
