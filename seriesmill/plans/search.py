"""Hyper-parameter search: configurations are rows, a generation or a sweep is one Spark job.

Fits and scores run inside table functions, one group for each configuration; a
failure is a row with its error. Only a generation's scores come to the driver.
"""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmill.functions import columns as C
from seriesmill.operators import generators as G
from seriesmill.operators import stats as T
from seriesmill.sources.tables import cut_table

FAILED = 999.0
# The grids of the sweeps, the bounds of genes, activations by number, and which settings each stage adds.
HYBRID_GRID = {"k": [3, 4, 5, 6], "block": [15, 20, 30, 45, 60], "scale": [0.7, 0.8, 0.85, 0.9, 1.0]}
RANDOM_GRID = {"k": [2, 3, 4, 5, 6, 7, 8], "block": [10, 15, 20, 25, 30, 40, 50, 60, 80], "smooth": [0.0, 0.1, 0.2, 0.3, 0.5, 0.7], "least": [2, 3, 5, 8], "kind": ["diag", "tied"], "windows": [[6, 24, 48], [4, 12, 36], [8, 32, 64], [6, 16, 48]]}
DEFAULT_HYBRID = {"k": 4, "block": 30, "smooth": 0.3, "least": 3, "kind": "diag", "windows": [6, 24, 48]}
ACTIVATIONS = ("tanh", "relu", "elu", "selu", "swish", "gelu", "sigmoid", "linear")
GENES = {
    "latent_dim": (4, 64, "int"), "intermediate_layers": (1, 4, "int"), "initial_layer_size": (16, 128, "int"), "window_size": (48, 288, "int"),
    "discriminator_lr": (1e-5, 1e-2, "log"), "generator_lr": (1e-5, 1e-2, "log"), "disc_dropout": (0.0, 0.5, "float"),
    "learning_rate": (1e-5, 1e-2, "log"), "activation": (0, 7, "int"), "batch_size": (32, 256, "int"),
    "l2_reg": (1e-7, 1e-3, "log"), "kl_weight": (1e-5, 1e-1, "log"), "kl_anneal_epochs": (5, 50, "int"), "mmd_lambda": (1e-4, 1e-1, "log"),
    "early_patience": (20, 200, "int"), "min_delta": (1e-10, 1e-6, "log"),
}
_STAGE_GENES = [
    ["latent_dim", "intermediate_layers", "initial_layer_size", "window_size"], ["discriminator_lr", "generator_lr", "disc_dropout"], ["learning_rate", "activation", "batch_size"],
    ["l2_reg", "kl_weight", "kl_anneal_epochs", "mmd_lambda"], ["early_patience", "min_delta"],
]
STAGES = [{"name": f"stage {k}", "parameters": genes} for k, genes in enumerate(_STAGE_GENES, 1)]
#: A series that is sent as one row has at most so many prices (16 MB).
MAX_ROWS = 2_000_000
_FLAT, _AC, _DIST = None, {"js_divergence": 1.0, "ks_statistic": 1.0, "ac_lag1": 3.0, "ac_lag5": 5.0, "ac_lag24": 5.0, "hurst_diff": 2.0, "vol_cluster": 4.0, "spectral": 4.0, "skew_diff": 1.0, "kurt_diff": 1.0, "std_ratio": 1.0}, {"js_divergence": 5.0, "ks_statistic": 4.0, "ac_lag1": 2.0, "ac_lag5": 2.0, "ac_lag24": 2.0, "hurst_diff": 2.0, "vol_cluster": 2.0, "spectral": 2.0, "skew_diff": 4.0, "kurt_diff": 3.0, "std_ratio": 4.0}
SCRIPT_STAGES = [
    {"name": "wide", "size": 40, "generations": 8, "seeds": 3, "scale": 0.3, "elite": 4, "tournament": 3, "weights": _FLAT}, {"name": "correlations first", "size": 30, "generations": 8, "seeds": 3, "scale": 0.2, "elite": 4, "tournament": 3, "weights": _AC},
    {"name": "shape first", "size": 30, "generations": 6, "seeds": 3, "scale": 0.15, "elite": 4, "tournament": 3, "weights": _DIST}, {"name": "narrow", "size": 25, "generations": 8, "seeds": 4, "scale": 0.08, "elite": 5, "tournament": 3, "weights": _FLAT},
    {"name": "last steps", "size": 20, "generations": 6, "seeds": 5, "scale": 0.03, "elite": 5, "tournament": 2, "weights": _FLAT},
]


# Scores of arrays, for use inside a group.


def _corr(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and a.std() > 0 and b.std() > 0 else 0.0


def _autocorr(x: np.ndarray, lag: int) -> float:
    return _corr(x[:-lag], x[lag:]) if len(x) > lag else 0.0


def array_hurst(p: np.ndarray, max_lag: int = 100) -> float:
    values = []
    for lag in range(2, min(max_lag, len(p) // 4)):
        count = -(-(len(p) - lag) // lag)
        d = np.diff(p[: count * lag].reshape(count, lag), axis=1)
        c, s = np.cumsum(d - d.mean(axis=1, keepdims=True), axis=1), d.std(axis=1)
        if (ok := s > 0).any():
            values.append(np.mean((c.max(axis=1) - c.min(axis=1))[ok] / s[ok]))
    if len(values) < 3:
        return 0.5
    return float(np.clip(np.polyfit(np.log(np.arange(2, 2 + len(values))), np.log(values), 1)[0], 0, 1))


def array_terms(real: np.ndarray, synth: np.ndarray) -> dict[str, float]:
    """The eleven terms of the composite score, and Wasserstein's distance."""
    r, s = (np.diff(np.log(np.maximum(p, 1e-10))) for p in (real, synth))
    bins = np.linspace(min(r.min(), s.min()), max(r.max(), s.max()), 100)
    p, q = (np.histogram(x, bins, density=True)[0] + 1e-10 for x in (r, s))
    p, q = p / p.sum(), q / q.sum()
    js = max(0.0, float(np.sum(p * np.log(2 * p / (p + q)) + q * np.log(2 * q / (p + q))) / 2))
    grid = np.unique(np.concatenate([r, s]))
    gap = np.abs(np.searchsorted(np.sort(r), grid, "right") / len(r) - np.searchsorted(np.sort(s), grid, "right") / len(s))
    n = min(len(r), len(s))
    u, v = (np.abs(np.fft.fft(x[:n])) ** 2 for x in (r, s))
    moment = lambda x, k: float(np.mean((x - x.mean()) ** k) / (x.std() ** k + 1e-300))
    dev = lambda a, b: abs(a / b - 1) if abs(b) > 1e-6 else abs(a)
    return {
        "js_divergence": js**0.5, "ks_statistic": float(gap.max()), **{f"ac_lag{k}": dev(_autocorr(s, k), _autocorr(r, k)) for k in (1, 5, 24)}, "hurst_diff": abs(array_hurst(synth) - array_hurst(real)),
        "vol_cluster": dev(_autocorr(np.abs(s), 1), _autocorr(np.abs(r), 1)), "spectral": float(np.sqrt(np.mean((u / (u.sum() + 1e-20) - v / (v.sum() + 1e-20)) ** 2))), "skew_diff": abs(moment(s, 3) - moment(r, 3)),
        "kurt_diff": abs(moment(s, 4) - moment(r, 4)) / max(moment(r, 4), 1.0), "std_ratio": abs(s.std() / r.std() - 1.0), "wasserstein": float(np.sum(gap[:-1] * np.diff(grid))),
    }


def weighted(terms: dict[str, float], weights: dict[str, float] | None = None) -> float:
    weights = weights or T.COMPOSITE
    return sum(terms[k] * w for k, w in weights.items()) / sum(weights.values())


def padded(x: np.ndarray, n: int) -> np.ndarray:
    x = x[:n]
    return np.concatenate([x, np.full(n - len(x), x[-1])]) if len(x) < n else x


def rescaled(p: np.ndarray, scale: float) -> np.ndarray:
    return p if scale == 1.0 else p[0] * np.exp(np.concatenate([[0.0], np.cumsum(np.diff(np.log(np.maximum(p, 1e-10))) * scale)]))


def multi_seed(real: np.ndarray, generate: Callable[[int], np.ndarray], seeds: Sequence[int], weights: dict[str, float] | None = None, until: float | None = None) -> tuple[float, float, dict[str, float]]:
    """Mean and deviation of the score over seeds, and mean terms; seeds that fail, or would begin after `until`, are left out, none gives infinity."""
    scores, every = [], []
    for seed in seeds:
        if until and time.time() > until:
            break
        try:
            terms = array_terms(real, padded(np.asarray(generate(seed), float), len(real)))
        except Exception:
            continue
        scores.append(weighted(terms, weights))
        every.append(terms)
    if not scores:
        return float("inf"), float("inf"), {}
    return float(np.mean(scores)), float(np.std(scores)), {k: float(np.mean([t[k] for t in every])) for k in every[0]}


# Configurations as rows.


def configs_frame(spark: SparkSession, configs: Sequence[dict[str, Any]]) -> DataFrame:
    return spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(configs)], "config_id long, config string")


def param_grid(spark: SparkSession, grid: dict[str, Sequence[Any]]) -> DataFrame:
    """The product of the values of each parameter, numbered in order."""
    df = spark.range(1).select(F.lit(0).cast("long").alias("config_id"))
    for name, values in grid.items():
        one = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)))
        df = df.withColumn("_x", F.explode(one)).withColumn("config_id", F.col("config_id") * len(values) + F.col("_x.i")).withColumn(name, F.col("_x.v")).drop("_x")
    return df


def random_configs(grid: dict[str, Sequence[Any]], n: int, seed: int = 42, default: dict[str, Any] | None = None) -> list[dict[str, Any]]:
    """n distinct random points of the grid, the default before them."""
    rng, seen, out = np.random.default_rng(seed), set(), [default] if default else []
    total = int(np.prod([len(v) for v in grid.values()]))
    while len(seen) < min(n, total):
        c = {k: v[int(rng.integers(len(v)))] for k, v in grid.items()}
        key = json.dumps(c, sort_keys=True)
        if key not in seen:
            seen.add(key)
            out.append(c)
    return out


def gene_columns(genes: dict[str, tuple[float, float, str]], seed: Column, i: Column) -> dict[str, Column]:
    """A random value for each gene as a column."""
    out = {}
    for name, (lo, hi, kind) in genes.items():
        u = C.uniform(seed, F.lit(name), i)
        out[name] = C.integer_gene(int(lo), int(hi), u) if kind == "int" else C.log_uniform(lo, hi, u) if kind == "log" else F.lit(lo) + u * (hi - lo)
    return out


def _as_row(df: DataFrame, name: str, column: str = "typical_price") -> DataFrame:
    """A series as one row of an array; an error beyond MAX_ROWS."""
    rows = df.limit(MAX_ROWS + 1)
    array = F.transform(F.array_sort(F.collect_list(F.struct("seq", column))), lambda s: s[column])
    return rows.groupBy().agg(F.when(F.count("*") <= MAX_ROWS, array).otherwise(F.raise_error(F.lit(f"a series of more than {MAX_ROWS} rows"))).alias(name))


def evaluate(configs: DataFrame, fit_px: DataFrame, real_px: DataFrame, generator: str = "hybrid", n_seeds: int = 3, weights: dict[str, float] | None = None, limit_s: float | None = None) -> DataFrame:
    """configs (config_id, config JSON) -> config_id, config, score, score_std, terms, wall_s, error: one group for each configuration.

    The two price series are one row of arrays, of checked size. limit_s: after so many
    seconds a configuration gets no further seed.
    """
    rows = configs.select("config_id", "config").crossJoin(F.broadcast(_as_row(fit_px, "fit"))).crossJoin(F.broadcast(_as_row(real_px, "real")))  # one row each
    maker, sampler = G.FITS[generator]

    def run(frames):
        for pdf in frames:
            for cid, body, fit, real in zip(pdf["config_id"], pdf["config"], pdf["fit"], pdf["real"]):
                began, score, std, terms, error = time.time(), float("inf"), None, {}, None
                try:
                    options = json.loads(body)
                    scale = options.pop("scale", 1.0)
                    model = maker(np.asarray(fit, float), **options)
                    p0 = float(real[0])
                    score, std, terms = multi_seed(np.asarray(real, float), lambda seed: rescaled(sampler(model, len(real), np.random.default_rng(seed), p0=p0), scale), range(n_seeds), weights, began + limit_s if limit_s else None)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([[cid, body, score if np.isfinite(score) else FAILED, std, json.dumps(terms), time.time() - began, error]], columns=["config_id", "config", "score", "score_std", "terms", "wall_s", "error"])

    return rows.repartition("config_id").mapInPandas(run, "config_id long, config string, score double, score_std double, terms string, wall_s double, error string")


def net_options(settings: Mapping[str, Any]) -> dict[str, Any]:
    """The options of a network fit, from settings or genes; an activation may be a number."""
    activation = settings["activation"]
    size, div, layers = int(settings["initial_layer_size"]), settings["layer_size_divisor"], int(settings["intermediate_layers"])
    return {
        "width": int(settings["window_size"]), "latent": int(settings["latent_dim"]), "hidden": [max(4, size // div**i) for i in range(layers)], "epochs": int(settings["epochs"]), "batch": int(settings["batch_size"]),
        "activation": activation if isinstance(activation, str) else ACTIVATIONS[int(activation)], "kl": settings["kl_weight"], "anneal": int(settings["kl_anneal_epochs"]), "mmd": settings["mmd_lambda"], "l2": settings["l2_reg"],
        "rate": settings["learning_rate"], "adv_rate": settings["generator_lr"], "judge_rate": settings["discriminator_lr"], "judge": settings["disc_layers"], "dropout": settings["disc_dropout"],
        "patience": int(settings["early_patience"]), "warm": int(settings["start_from_epoch"]), "min_delta": settings["min_delta"], "returns": settings["use_returns"], "conditional": settings["conditional"],
    }


def utility(configs: DataFrame, train_px: DataFrame, val_px: DataFrame, settings: Mapping[str, Any], kind: str = "vae_gan", predictor: Callable[..., dict[str, float]] | None = None) -> DataFrame:
    """configs (config_id, config JSON) -> config_id, score, error: a predictor's validation error with synthetic rows in its training data less that without.

    Each configuration is a row: a network is trained, samples n_synthetic_samples rows on
    the date grid, these and the real ones are sorted by date (real ones win), and the
    predictor is trained on both. Negative: the synthetic rows help. A failure scores FAILED.
    """
    from seriesmill.operators import neural

    known, learn = dict(settings), predictor or neural.train_predictor
    own = ["typical_price", "unix"]
    train = train_px.withColumn("unix", F.unix_seconds(F.col("ts").cast("timestamp")))
    rows = configs.select("config_id", "config")
    for column, part in zip(own, ("train", "dates")):
        rows = rows.crossJoin(F.broadcast(_as_row(train, part, column)))  # one row each, of checked size
    rows = rows.crossJoin(F.broadcast(_as_row(val_px, "val")))
    start = int(train_px.sparkSession.sql(f"SELECT unix_seconds(cast('{known['start_datetime']}' as timestamp))").first()[0])
    window, horizon, epochs, batch = (int(known[k]) for k in ("window_size", "horizon", "predictor_epochs", "eval_batch_size"))

    def error_of(train: np.ndarray, val: np.ndarray) -> float:
        return learn(train, {"val": val}, window, horizon, epochs, batch, seed=0)["val"]

    def run(frames):
        baseline: dict[int, float] = {}  # once for each task: all its rows have the same series
        for pdf in frames:
            for cid, body, prices, dates, val in zip(pdf["config_id"], pdf["config"], pdf["train"], pdf["dates"], pdf["val"]):
                score, error = FAILED, None
                try:
                    real, dates, val = np.asarray(prices, float), np.asarray(dates, np.int64), np.asarray(val, float)
                    if 0 not in baseline:
                        baseline[0] = error_of(real, val)
                    model = G.FITS[kind][0](real, **net_options(known | json.loads(body)))
                    fake = G.FITS[kind][1](model, int(known["n_synthetic_samples"]), np.random.default_rng(int(known["seed"])))
                    when = start + np.arange(len(fake)) * 3600 * int(known["interval_hours"])
                    fresh = ~np.isin(when, dates)
                    both, order = np.concatenate([real, fake[fresh]]), np.argsort(np.concatenate([dates, when[fresh]]), kind="stable")
                    score = error_of(both[order], val) - baseline[0]
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([[cid, score if np.isfinite(score) else FAILED, error]], columns=["config_id", "score", "error"])

    return rows.repartition("config_id").mapInPandas(run, "config_id long, score double, error string")


def top(results: DataFrame, k: int = 10) -> DataFrame:
    return results.orderBy("score", "config_id").limit(k)


def grid_sweep(spark: SparkSession, fit_px: DataFrame, real_px: DataFrame, grid: dict[str, Sequence[Any]] | None = None, n_seeds: int = 5, margin: float = 1.3, first: int = 2) -> DataFrame:
    """All points with `first` seeds, then those within `margin` of the best with all of them: early stopping without an order."""
    grid = grid or HYBRID_GRID
    points = configs_frame(spark, [dict(zip(grid, v)) for v in itertools.product(*grid.values())])
    scored = evaluate(points, fit_px, real_px, "hybrid", first).collect()  # one row for each point of the grid
    rough = spark.createDataFrame(scored, "config_id long, config string, score double, score_std double, terms string, wall_s double, error string")
    best = min(r.score for r in scored)
    near = rough.where(F.col("score") <= best * margin).select("config_id", "config")
    return evaluate(near, fit_px, real_px, "hybrid", n_seeds).withColumn("stopped", F.lit(False)).unionByName(rough.where(F.col("score") > best * margin).withColumn("stopped", F.lit(True)))


def random_sweep(spark: SparkSession, fit_px: DataFrame, real_px: DataFrame, n: int = 300, n_seeds: int = 3, seed: int = 42, limit_s: float | None = 60.0) -> DataFrame:
    """limit_s: the time that a configuration has for its seeds."""
    return evaluate(configs_frame(spark, random_configs(RANDOM_GRID, n, seed, DEFAULT_HYBRID)), fit_px, real_px, "hybrid", n_seeds, limit_s=limit_s)


def generator_samples(fit_px: DataFrame, real_px: DataFrame, kinds: dict[str, tuple[str, dict[str, Any]]], n_seeds: int = 10) -> DataFrame:
    """kinds: label -> (fit or "block_bootstrap", options) -> series_id, generator, seed, seq, typical_price, each as long as its real series and padded with the last price."""
    real = real_px.groupBy("series_id").agg(F.count("*").alias("n_samples"), F.min_by("typical_price", "seq").alias("p0"))
    fit_px, out = fit_px.select("series_id", "seq", "typical_price"), None
    for label, (kind, options) in kinds.items():
        if kind == "block_bootstrap":
            rows = G.block_bootstrap(fit_px, real, n_seeds, options.get("block", 30), 0)
        else:
            rows = G.sample(G.fit(fit_px, kind, options), real, n_seeds, 0, real.select("series_id", "p0"))
        rows = rows.select("series_id", F.lit(label).alias("generator"), "seed", "seq", "typical_price")
        out = rows if out is None else out.unionByName(rows)
    order = Window.partitionBy("series_id", "generator", "seed").orderBy("seq")
    # Each row goes on up to the next one, the last one up to the length.
    until = F.coalesce(F.lead("seq").over(order), F.col("n_samples")) - 1
    grid = G.with_length(out, real).where("seq < n_samples").withColumn("_until", until).withColumn("seq", F.explode(F.sequence("seq", "_until")))
    price = F.last("typical_price", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return grid.select("series_id", "generator", "seed", "seq", price.alias("typical_price"))


def generator_metrics(fit_px: DataFrame, real_px: DataFrame, kinds: dict[str, tuple[str, dict[str, Any]]], n_seeds: int = 10, target: str = "d5") -> DataFrame:
    """The fact table: one metric record for each series, generator and seed, against the real series.

    All series are in one plan, whose size doesn't depend on their number. The samples
    and the pairs of series go to tables, as the metrics read them a dozen times.
    """
    key = ["series_id", "generator", "seed"]
    synth = cut_table(generator_samples(fit_px, real_px, kinds, n_seeds))
    numbers = (F.row_number().over(Window.partitionBy("series_id").orderBy("seq")) - 1).cast("long")
    real = synth.select(*key).distinct().join(real_px.select("series_id", numbers.alias("seq"), "typical_price"), "series_id")
    pair = cut_table(synth.withColumn("side", F.lit("synth")).unionByName(real.withColumn("side", F.lit("real"))))
    return T.metric_record(pair, key).withColumn("target", F.lit(target))


def ratio_sweep(train: DataFrame, val: DataFrame, test: DataFrame, fit_px: DataFrame, n_samples: Sequence[int], blocks: Sequence[int], **options: Any) -> DataFrame:
    """n_samples, block, and the errors of a predictor trained with so many bootstrap rows before the real ones; every point is a group of one job."""
    from seriesmill.plans.evaluate import predictor_errors

    arms = None
    for role, df in (("val", val), ("test", test)):
        part = df.select(F.lit(role).alias("role"), "seq", "typical_price")
        arms = part if arms is None else arms.unionByName(part)
    points = [(n, b) for n in n_samples for b in blocks]
    every = F.array(*(F.lit(f"{n}:{b}") for n, b in points))
    out = arms.unionByName(train.select(F.lit("train").alias("role"), "seq", "typical_price")).withColumn("arm", F.explode(every))
    fit_px = fit_px.select("series_id", "seq", "typical_price")
    for n, b in points:
        fake = G.block_bootstrap(fit_px, n, 1, b).select(F.lit("train").alias("role"), (F.col("seq") - n).alias("seq"), "typical_price", F.lit(f"{n}:{b}").alias("arm"))  # before the real ones
        out = out.unionByName(fake)
    got = predictor_errors(out, **options)
    part = lambda i: F.element_at(F.split("arm", ":"), i).cast("int")
    return got.select(part(1).alias("n_samples"), part(2).alias("block"), "mae_train", "mae_val", "mae_test", "error")


# Evolution: the driver holds one generation's genes and scores.


def _random_gene(rng: np.random.Generator, lo: float, hi: float, kind: str) -> Any:
    u = float(rng.random())
    if kind == "int":
        return int(round(lo + u * (hi - lo)))
    return float(10 ** (np.log10(lo) + u * (np.log10(hi) - np.log10(lo)))) if kind == "log" else lo + u * (hi - lo)


def _midpoint(lo: float, hi: float, kind: str) -> Any:
    return int(round((lo + hi) / 2)) if kind == "int" else float(10 ** ((np.log10(lo) + np.log10(hi)) / 2)) if kind == "log" else (lo + hi) / 2


def _cross(rng: np.random.Generator, a: dict, b: dict, names: Sequence[str]) -> dict:
    """Two-point crossover."""
    i, j = sorted(rng.integers(0, len(names) + 1, 2).tolist())
    return a | {n: b[n] for n in names[i:j]}


def _tournament(rng: np.random.Generator, scored: list[tuple[float, dict]], size: int) -> dict:
    return min((scored[int(rng.integers(len(scored)))] for _ in range(size)), key=lambda x: x[0])[1]


def staged_ga(spark: SparkSession, fitness: Callable[[DataFrame], DataFrame], genes: dict[str, tuple[float, float, str]] | None = None, stages: Sequence[dict[str, Any]] | None = None, size: int = 20, generations: int = 10, cross: float = 0.7, mutate: float = 0.2, patience: int = 4, seed: int = 42, resume: dict[str, Any] | None = None, log: Callable[[dict], None] | None = None) -> dict[str, Any]:
    """fitness: configs frame -> frame with config_id and score (FAILED for failures).

    Each stage adds its parameters to the active ones; parameters of later stages stay
    at their midpoints. Tournament of 3, two-point crossover, gene resets (0.3 each),
    a hall of fame of one, an end after `patience` generations without gain.
    """
    genes, stages = genes or GENES, stages or STAGES
    state = resume or {"stage": 0, "best": {n: _midpoint(*g) for n, g in genes.items()}, "score": float("inf"), "history": []}
    rng = np.random.default_rng(seed + state["stage"])
    active = [p for s in stages[: state["stage"]] for p in s["parameters"]]
    for at in range(state["stage"], len(stages)):
        active += stages[at]["parameters"]
        people = [dict(state["best"])] + [state["best"] | {n: _random_gene(rng, *genes[n]) for n in active} for _ in range(size - 1)]
        waited = 0
        for generation in range(generations):
            rows = {r.config_id: r.score for r in fitness(configs_frame(spark, people)).select("config_id", "score").collect()}
            scored = [(float(rows.get(i, FAILED)), p) for i, p in enumerate(people)]
            best = min(scored, key=lambda x: x[0])
            waited = 0 if best[0] < state["score"] else waited + 1
            if best[0] < state["score"]:
                state["score"], state["best"] = best[0], dict(best[1])
            record = {"stage": stages[at]["name"], "generation": generation, "min": best[0], "avg": float(np.mean([s for s, _ in scored])), "best": state["score"]}
            state["history"].append(record)
            if log:
                log(record)
            if waited >= patience:
                break
            people = [dict(state["best"])]
            while len(people) < size:
                child = _tournament(rng, scored, 3)
                if rng.random() < cross:
                    child = _cross(rng, child, _tournament(rng, scored, 3), active)
                if rng.random() < mutate:
                    child = child | {n: _random_gene(rng, *genes[n]) for n in active if rng.random() < 0.3}
                people.append(dict(child))
        state["stage"] = at + 1
    return state


def script_ga(spark: SparkSession, fit_px: DataFrame, real_px: DataFrame, stages: Sequence[dict[str, Any]] | None = None, seed: int = 42) -> tuple[float, dict[str, Any]]:
    """Elites, tournaments without replacement, uniform crossover and scaled steps, over stages with weights of their own."""
    rng, grid, elite = np.random.default_rng(seed), RANDOM_GRID, []

    def step(c: dict, scale: float) -> dict:
        out = dict(c)
        for name in rng.choice(list(grid), int(rng.integers(1, 4)), replace=False).tolist():
            values = grid[name]
            reach = max(1, round(scale * len(values)))
            at = values.index(out[name]) + int(rng.integers(-reach, reach + 1))
            out[name] = values[min(len(values) - 1, max(0, at))]
        return out

    best: tuple[float, dict] = (float("inf"), DEFAULT_HYBRID)
    for stage in stages or SCRIPT_STAGES:
        people = [*elite, *random_configs(grid, stage["size"], int(rng.integers(2**31)))][: stage["size"]]
        for _ in range(stage["generations"]):
            frame = evaluate(configs_frame(spark, people), fit_px, real_px, "hybrid", stage["seeds"], stage["weights"])
            scored = sorted(((r.score, people[r.config_id]) for r in frame.select("config_id", "score").collect()), key=lambda x: x[0])
            best = min(best, scored[0], key=lambda x: x[0]) if stage["weights"] is None else best
            elite = [c for _, c in scored[: stage["elite"]]]
            people = list(elite)
            while len(people) < stage["size"]:
                pick = lambda: min((scored[i] for i in rng.choice(len(scored), min(stage["tournament"], len(scored)), replace=False)), key=lambda x: x[0])[1]
                a, b = pick(), pick()
                people.append(step({k: (a if rng.random() < 0.5 else b)[k] for k in grid}, stage["scale"]))
    return best
