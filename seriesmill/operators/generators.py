"""Synthetic series: samplers as table functions, one group for each series and seed.

Draws of the relational forms come from a counter (seed, stream, place), so that they
don't depend on partitioning; the sequential samplers take a generator seeded by
series and seed. Equal model and seed give equal output.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions import columns as C
from seriesmill.operators import neural, regimes
from seriesmill.operators import series as S
from seriesmill.operators.series import BY

OUT = "series_id string, seed long, seq long, typical_price double"


def seeds(spark, n: int, first: int = 0) -> DataFrame:
    return spark.range(first, first + n).withColumnRenamed("id", "seed")


def with_seeds(df: DataFrame, n_seeds: int, first: int = 0) -> DataFrame:
    """Each row once for each seed."""
    return df.withColumn("seed", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + n_seeds - 1).cast("long"))))


def with_length(df: DataFrame, n_samples: int | DataFrame) -> DataFrame:
    """n_samples as a column: one number, or a frame (series_id, n_samples) with one for each series."""
    if isinstance(n_samples, DataFrame):
        return df.join(n_samples.select("series_id", "n_samples"), "series_id")
    return df.withColumn("n_samples", F.lit(n_samples))


def block_bootstrap(px: DataFrame, n_samples: int | DataFrame, n_seeds: int = 1, block: int = 30, first_seed: int = 42, by: Sequence[str] = BY) -> DataFrame:
    """by, seed, seq, typical_price: contiguous blocks of real prices, each scaled to start at the last price emitted.

    Block starts are uniform in [0, n - block). A draw table is expanded by row index
    and joined to the prices; the chain of scales is a running sum of ln ratios over
    the blocks. Seams repeat a price, as the scaled block starts at the last one.
    n_samples: see `with_length`.
    """
    by = list(by)
    numbered = px.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("seq")) - 1).select(*by, F.col("_i").cast("long").alias("_i"), "typical_price")
    sizes = px.groupBy(*by).agg((F.count("*") - block).alias("_max")).where("_max >= 1")
    n_blocks = F.ceil(F.col("n_samples") / block).cast("int")
    draws = with_seeds(with_length(sizes, n_samples), n_seeds, first_seed).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    draws = draws.withColumn("_start", C.uniform_index(F.col("_max"), F.col("seed"), F.col("block")))
    rows = draws.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("_i", F.col("_start") + F.col("pos"))
    rows = rows.join(numbered, [*by, "_i"])
    ends = rows.groupBy(*by, "seed", "block").agg(F.max(F.when(F.col("pos") == 0, F.ln("typical_price"))).alias("_a"), F.max(F.when(F.col("pos") == block - 1, F.ln("typical_price"))).alias("_b"))
    w = Window.partitionBy(*by, "seed").orderBy("block")
    before = F.coalesce(F.sum(F.col("_b") - F.col("_a")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.first("_a").over(w)
    scaled = rows.join(ends.select(*by, "seed", "block", "_a", before.alias("_base")), [*by, "seed", "block"])
    out = scaled.withColumn("seq", (F.col("block") * block + F.col("pos")).cast("long")).where("seq < n_samples")
    return out.select(*by, "seed", "seq", F.exp(F.col("_base") + F.ln("typical_price") - F.col("_a")).alias("typical_price"))


def markov_walk(states: DataFrame, n_samples: int, n_seeds: int = 1, first_seed: int = 42) -> DataFrame:
    """series_id, seed, step, state, ret: a walk on the transition graph of quantile states, with a value of each state's pool.

    The walk is a fold over the steps; a state without followers goes on by the
    frequencies of all states. Values are joined by their index in the pool.
    """
    from seriesmill.operators import graph

    freq = graph.frequencies(states)
    w = Window.partitionBy("series_id").orderBy("state").rowsBetween(Window.unboundedPreceding, 0)
    start = freq.withColumn("cum", F.sum("freq").over(w)).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("state", "cum"))).alias("f"))
    table = graph.walk_tables(graph.transitions(states)).groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("src", F.struct("dsts", "cums")))).alias("m"))
    base = with_seeds(start.join(table, "series_id"), n_seeds, first_seed).withColumn("f", F.struct(F.col("f.state").alias("dsts"), F.col("f.cum").alias("cums")))

    def follow(options, step):
        u = C.uniform(F.col("seed"), F.lit("walk"), step)
        return F.get(options["dsts"], C.categorical(options["cums"], u))

    def advance(acc, step):
        last = F.element_at(acc, -1)
        return F.array_append(acc, follow(F.coalesce(F.try_element_at(F.col("m"), last), F.col("f")), step))

    first = F.array(follow(F.col("f"), F.lit(0)))
    walked = base.withColumn("path", F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n_samples - 1))), first, advance))
    steps = walked.select("series_id", "seed", F.posexplode(F.slice("path", 1, n_samples)).alias("step", "state"))
    pool = states.withColumns({"k": F.row_number().over(Window.partitionBy("series_id", "state").orderBy("seq")) - 1, "n": F.count("*").over(Window.partitionBy("series_id", "state"))})
    sizes = pool.groupBy("series_id", "state").agg(F.first("n").alias("n"))
    drawn = steps.join(sizes, ["series_id", "state"]).withColumn("k", C.uniform_index(F.col("n"), F.col("seed"), F.lit("value"), F.col("step")).cast("int"))
    return drawn.join(pool.select("series_id", "state", "k", "ret"), ["series_id", "state", "k"]).select("series_id", "seed", "step", "state", "ret")


def walk_prices(walk: DataFrame, px: DataFrame) -> DataFrame:
    """Prices of a walk, from a real price drawn by the seed."""
    numbered = px.withColumn("_i", F.row_number().over(S.ordered()) - 1)
    sizes = px.groupBy("series_id").agg(F.count("*").alias("_n"))
    drawn = walk.select("series_id", "seed").distinct().join(sizes, "series_id").withColumn("_i", C.uniform_index(F.col("_n"), F.col("seed"), F.lit("anchor")).cast("int"))
    anchors = drawn.join(numbered.select("series_id", "_i", F.col("typical_price").alias("p0")), ["series_id", "_i"]).select("series_id", "seed", "p0")
    n = walk.groupBy("series_id", "seed").agg((F.max("step") + 1).alias("_n"))
    rows = walk.join(anchors, ["series_id", "seed"]).withColumn("seq", F.col("step").cast("long") + 1)
    prices = S.rebuild_prices(rows, ("series_id", "seed"))
    return prices.join(n, ["series_id", "seed"]).where(F.col("seq") < F.col("_n")).select("series_id", "seed", "seq", "typical_price")


# Sequential samplers: one NumPy function each, of a series' prices and a generator.


def rng_of(series_id: str, seed: int) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(series_id.encode()), int(seed)])


def features_of(prices: np.ndarray, short: int, long: int) -> np.ndarray:
    r = pd.Series(np.diff(np.log(np.maximum(prices, 1e-10))))
    a, b = r.rolling(short, min_periods=1).std(), r.rolling(long, min_periods=1).std()
    ratio = np.where(b > 1e-10, a / b.where(b > 1e-10, 1.0), 1.0)
    return np.column_stack([r, a, ratio])[1:]


def hybrid_features_of(prices: np.ndarray, windows: Sequence[int]) -> np.ndarray:
    short, mid, long = windows
    r = pd.Series(np.diff(np.log(np.maximum(prices, 1e-10))))
    vol = lambda w, least: r.rolling(w, min_periods=max(1, least)).std().bfill()
    return np.column_stack([r, vol(mid, mid // 4), vol(short, short // 2) / np.maximum(vol(long, long // 4), 1e-10)])


def _walk(rng: np.random.Generator, start: np.ndarray, move: np.ndarray, n: int) -> np.ndarray:
    cum_start, cum = np.cumsum(start), np.cumsum(move, axis=1)
    u, out = rng.random(n), np.empty(n, int)
    last = len(start) - 1
    for t in range(n):
        row = cum_start if t == 0 else cum[out[t - 1]]
        out[t] = min(last, int(np.searchsorted(row, u[t] * row[-1], side="right")))
    return out


def _ar1(x: np.ndarray) -> float:
    if len(x) <= 2 or x[:-1].std() == 0 or x[1:].std() == 0:
        return 0.0
    return float(np.corrcoef(x[:-1], x[1:])[0, 1])


def fit_hmm_ar(prices: np.ndarray, k: int = 4) -> dict[str, Any]:
    """Regimes of normalised features; mean, deviation and AR(1) of each regime's returns."""
    x = features_of(prices, 24, 72)
    r = x[:, 0]
    model = regimes.fit_hmm((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-10), k)
    labels = model.viterbi((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-10))
    parts = []
    for j in range(k):
        own = r[labels == j]
        few = len(own) < 5
        parts.append({"mean": 0.0 if few else float(own.mean()), "std": float(r.std() if few else own.std()), "ar1": 0.0 if few else _ar1(own), "count": len(own)})
    return {"kind": "hmm_ar", "start": model.start.tolist(), "move": model.move.tolist(), "regimes": parts, "level": float(prices.mean())}


def sample_hmm_ar(model: dict[str, Any], n: int, rng: np.random.Generator, p0: float | None = None) -> np.ndarray:
    path = _walk(rng, np.array(model["start"]), np.array(model["move"]), n)
    out, residual = np.empty(n), 0.0
    noise = rng.standard_normal(n)
    for t, k in enumerate(path.tolist()):
        g = model["regimes"][k]
        residual = g["ar1"] * residual + noise[t] * g["std"] * np.sqrt(max(1 - g["ar1"] ** 2, 0.01))
        out[t] = g["mean"] + residual
    return np.exp(np.log(model["level"] if p0 is None else p0) + np.cumsum(out))


def garch_of(r: np.ndarray) -> dict[str, float]:
    """The grid point with the greatest likelihood, all points at once."""
    x, var = r - r.mean(), float(r.var())
    if len(x) < 10:
        return {"omega": var, "alpha": 0.05, "beta": 0.90, "long_run_var": var}
    a, b = (v.ravel() for v in np.meshgrid(regimes.ALPHAS, regimes.BETAS, indexing="ij"))
    ok = a + b < 0.999
    a, b = a[ok], b[ok]
    omega = var * (1 - a - b)
    s2, ll = np.full(len(a), max(var, 1e-20)), np.zeros(len(a))
    for t in range(len(x)):
        if t:
            s2 = np.maximum(omega + a * x[t - 1] ** 2 + b * s2, 1e-20)
        ll -= 0.5 * (np.log(s2) + x[t] ** 2 / s2)
    k = int(ll.argmax())
    return {"omega": float(omega[k]), "alpha": float(a[k]), "beta": float(b[k]), "long_run_var": float(omega[k] / max(1 - a[k] - b[k], 0.001))}


def fit_hmm_garch(prices: np.ndarray, k: int = 4) -> dict[str, Any]:
    x = features_of(prices, 24, 72)
    r, z = x[:, 0], (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-10)
    model = regimes.fit_hmm(z, k)
    labels, parts = model.viterbi(z), []
    for j in range(k):
        own = r[labels == j]
        few = len(own) < 10
        garch = {"omega": float(r.var()), "alpha": 0.05, "beta": 0.90, "long_run_var": float(r.var())} if few else garch_of(own)
        parts.append({"mean": 0.0 if few else float(own.mean()), "ar1": 0.0 if few else _ar1(own), "garch": garch, "count": len(own)})
    return {"kind": "hmm_garch", "start": model.start.tolist(), "move": model.move.tolist(), "regimes": parts, "level": float(prices.mean())}


def sample_hmm_garch(model: dict[str, Any], n: int, rng: np.random.Generator, p0: float | None = None) -> np.ndarray:
    path = _walk(rng, np.array(model["start"]), np.array(model["move"]), n)
    noise, out, residual, s2 = rng.standard_normal(n), np.empty(n), 0.0, None
    for t, k in enumerate(path.tolist()):
        m = model["regimes"][k]
        g = m["garch"]
        s2 = max(g["long_run_var"] if s2 is None else g["omega"] + g["alpha"] * residual**2 + g["beta"] * s2, 1e-20)
        residual = m["ar1"] * residual + noise[t] * np.sqrt(s2)
        out[t] = m["mean"] + residual
    return np.exp(np.log(model["level"] if p0 is None else p0) + np.cumsum(out))


def fit_hybrid(prices: np.ndarray, k: int = 4, block: int = 30, smooth: float = 0.3, least: int = 3, kind: str = "full", windows: Sequence[int] = (6, 24, 48)) -> dict[str, Any]:
    """Regimes of raw features, and each regime's contiguous blocks of returns."""
    x = hybrid_features_of(prices, windows)
    model = regimes.fit_hmm(x, k, kind)
    labels, r = model.viterbi(x), x[:, 0]
    cuts = np.nonzero(np.diff(labels))[0] + 1
    blocks: list[list[list[float]]] = [[] for _ in range(k)]
    for part, lab in zip(np.split(r, cuts), np.split(labels, cuts)):
        if len(part) >= least:
            blocks[lab[0]].append(part.tolist())
    return {"kind": "hybrid", "start": model.start.tolist(), "move": model.move.tolist(), "blocks": blocks, "returns": [r[labels == j].tolist() for j in range(k)], "block": block, "smooth": smooth, "ar1": _ar1(r), "std": float(r.std())}


def sample_hybrid(model: dict[str, Any], n: int, rng: np.random.Generator, p0: float = 1.0, stitch: str = "smooth", span: int = 12) -> np.ndarray:
    """stitch: smooth (first points pulled to the last one), crossfade (over `span` points), bridge (AR(1) points between), segments (whole blocks, smoothed)."""
    start, move, size, weight = np.array(model["start"]), np.array(model["move"]), model["block"], model["smooth"]
    every = np.concatenate([np.asarray(x, float) for x in model["returns"]])
    regime = int(_walk(rng, start, move, 1)[0])
    out: list[float] = []
    while len(out) < n + size:
        blocks = model["blocks"][regime]
        if blocks:
            part = np.array(blocks[rng.integers(len(blocks))])
            if stitch != "segments" and len(part) > size:
                at = int(rng.integers(0, max(1, len(part) - size)))
                part = part[at : at + size]
        else:
            pool = np.asarray(model["returns"][regime], float)
            part = rng.choice(pool if len(pool) else every, max(3, size))
        part = part.astype(float)
        if out and stitch in ("smooth", "segments"):
            part[0] = (1 - weight) * part[0] + weight * out[-1]
        elif out and stitch == "crossfade" and len(part) >= 2 * span and len(out) >= span:
            share = np.arange(span) / span
            out[-span:] = ((1 - share) * np.array(out[-span:]) + share * part[:span]).tolist()
            part = part[span:]
        elif out and stitch == "bridge" and span:
            noise, value, a, b = model["std"] * np.sqrt(1 - model["ar1"] ** 2) * 0.3, out[-1], out[-1], part[0]
            for j in range(1, span + 1):
                value = model["ar1"] * value + (1 - model["ar1"]) * (a + (b - a) * j / (span + 1)) + rng.normal(0, noise)
                out.append(float(value))
        out += part.tolist()
        regime = int(_walk(rng, move[regime], move, 1)[0])
    return np.concatenate([[p0], np.exp(np.log(p0) + np.cumsum(out[: n - 1]))])[:n]


def fit_regime_gan(prices: np.ndarray, k: int = 4, seq_len: int = 16, epochs: int = 30, seed: int = 0) -> dict[str, Any]:
    """Change-point regimes with a small adversarial net for each; sparse ones keep a mean and a deviation."""
    r = np.diff(np.log(np.maximum(prices, 1e-10)))
    bounds = regimes.pelt(r)
    if len(bounds) < k:
        bounds = regimes.pelt(r, 1.5)
    f = regimes.segment_features(r, bounds)
    labels = regimes.ward((f - f.mean(axis=0)) / (f.std(axis=0) + 1e-10), k)
    k = int(labels.max()) + 1
    steps = np.repeat(labels, np.diff([0, *bounds]))
    move = np.full((k, k), 0.01)
    np.add.at(move, (labels[:-1], labels[1:]), 1.0)
    parts = []
    for j in range(k):
        own = r[steps == j]
        part: dict[str, Any] = {"mean": float(own.mean()), "std": float(own.std()), "count": len(own)}
        if len(own) >= 2 * seq_len:
            part["net"] = neural.train_window_gan(own, seq_len, epochs, np.random.default_rng([seed, j]))
        parts.append(part)
    freq = np.bincount(steps, minlength=k) / len(steps)
    return {"kind": "regime_gan", "start": freq.tolist(), "move": (move / move.sum(axis=1, keepdims=True)).tolist(), "regimes": parts, "seq_len": seq_len, "level": float(prices.mean())}


def sample_regime_gan(model: dict[str, Any], n: int, rng: np.random.Generator, p0: float | None = None) -> np.ndarray:
    path = _walk(rng, np.array(model["start"]), np.array(model["move"]), -(-n // model["seq_len"]))
    out = []
    for k in path.tolist():
        part = model["regimes"][k]
        out.append(neural.sample_window_gan(part["net"], rng) if "net" in part else rng.normal(part["mean"], part["std"], model["seq_len"]))
    return np.exp(np.log(model["level"] if p0 is None else p0) + np.cumsum(np.concatenate(out)[:n]))


FITS = {
    "hmm_ar": (fit_hmm_ar, sample_hmm_ar), "hmm_garch": (fit_hmm_garch, sample_hmm_garch), "hybrid": (fit_hybrid, sample_hybrid), "regime_gan": (fit_regime_gan, sample_regime_gan),
    "vae_gan": (neural.fit_vae_gan, neural.sample_vae_gan), "vae": (neural.fit_vae, neural.sample_vae_gan), "gan": (neural.fit_gan, neural.sample_vae_gan), "timegan": (neural.fit_timegan, neural.sample_timegan),
}


def fit(px: DataFrame, name: str, options: dict[str, Any] | None = None) -> DataFrame:
    """px -> series_id, kind, model (JSON), error: one fit for each series, in parallel."""
    import json

    maker, options = FITS[name][0], options or {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sid, model, error = pdf["series_id"].iloc[0], None, None
        try:
            model = json.dumps(maker(pdf.sort_values("seq")["typical_price"].to_numpy(float), **options))
        except Exception as e:  # a failed fit is a row
            error = f"{type(e).__name__}: {e}"
        return pd.DataFrame([[sid, name, model, error]], columns=["series_id", "kind", "model", "error"])

    return px.select("series_id", "seq", "typical_price").groupBy("series_id").applyInPandas(run, "series_id string, kind string, model string, error string")


def sample(models: DataFrame, n_samples: int | DataFrame, n_seeds: int = 1, first_seed: int = 42, p0: DataFrame | None = None, options: dict[str, Any] | None = None) -> DataFrame:
    """models -> OUT: one sample for each model and seed, in parallel; p0 (series_id, p0) gives first prices, n_samples the lengths (see `with_length`)."""
    import json

    options = options or {}
    rows = with_length(models.where("model IS NOT NULL"), n_samples)
    rows = rows.join(p0, "series_id", "left") if p0 is not None else rows.withColumn("p0", F.lit(None).cast("double"))
    rows = with_seeds(rows, n_seeds, first_seed).repartition("series_id", "seed")

    def run(frames):
        for pdf in frames:
            for sid, kind, body, start, seed, n in zip(*(pdf[c] for c in ("series_id", "kind", "model", "p0", "seed", "n_samples"))):
                more = dict(options) if pd.isna(start) else {**options, "p0": float(start)}
                prices = FITS[kind][1](json.loads(body), int(n), rng_of(sid, seed), **more)
                yield pd.DataFrame({"series_id": sid, "seed": int(seed), "seq": np.arange(len(prices)), "typical_price": prices})

    return rows.select("series_id", "kind", "model", "p0", "seed", "n_samples").mapInPandas(run, OUT)
