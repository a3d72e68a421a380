"""Plugins by kind and name: trainers, generators, evaluators, optimizers."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.config import DEFAULTS
from seriesmill.operators import generators as G
from seriesmill.operators import graph
from seriesmill.operators import series as S
from seriesmill.operators import stats as T
from seriesmill.plans import evaluate, search
from seriesmill.sources import series as src


@runtime_checkable
class Plugin(Protocol):
    plugin_params: dict[str, Any]

    def configure(self, config: dict[str, Any]) -> None: ...

    def set_params(self, **params: Any) -> None: ...


class Base:
    """Holds a session and settings; plugin_params are those that a plugin reads, with their defaults."""

    reads: tuple[str, ...] = ()
    plugin_params: dict[str, Any] = {}

    def __init_subclass__(cls, **options: Any):
        super().__init_subclass__(**options)
        cls.plugin_params = {k: DEFAULTS[k] for k in cls.reads}

    def __init__(self, config: dict[str, Any] | None = None, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession()
        self.cfg = dict(self.plugin_params) | (config or {})

    def configure(self, config: dict[str, Any]) -> None:
        self.cfg.update(config)

    def set_params(self, **params: Any) -> None:
        self.cfg.update(params)

    def option(self, key: str) -> Any:
        return self.cfg.get(key, DEFAULTS.get(key))

    def series(self, source: Any = None, key: str = "train_data") -> DataFrame:
        return src.resolve(self.spark, source, self.cfg, key)


def _external(folder: str | None):
    """train_predictor of folder/predictor.py, to be run in place of the built-in one; its text goes to the executors."""
    if not folder:
        return None
    with open(f"{folder}/predictor.py") as f:
        code = f.read()

    def learn(*args: Any, **options: Any) -> dict[str, float]:
        names: dict[str, Any] = {"__name__": "predictor"}
        exec(compile(code, "predictor.py", "exec"), names)
        return names["train_predictor"](*args, **options)

    return learn


def _net_options(plugin: Base) -> dict[str, Any]:
    return search.net_options({k: plugin.option(k) for k in NETWORK})


#: The settings of a network fit.
NETWORK = (
    "window_size", "latent_dim", "activation", "intermediate_layers", "initial_layer_size", "layer_size_divisor", "epochs", "batch_size", "kl_weight", "kl_anneal_epochs", "mmd_lambda", "l2_reg", "learning_rate", "generator_lr",
    "discriminator_lr", "disc_layers", "disc_dropout", "early_patience", "start_from_epoch", "min_delta", "use_returns", "conditional",
)


class Trainer(Base):
    """Fits a network to each series; the model is a row of a Parquet table."""

    kind, reads = "vae_gan", NETWORK

    def train(self, data: Any = None, save_to: str | None = None) -> DataFrame:
        px = self.series(data)
        S.check_long_enough(px, self.option("window_size") + 1)
        models = G.fit(px, self.kind, _net_options(self))
        path = save_to or self.cfg.get("save_model")
        if path:
            models.write.mode("overwrite").parquet(path)
            models = self.spark.read.parquet(path)
        failed = models.where("error IS NOT NULL").select("error").first()
        if failed:
            raise RuntimeError(failed.error)
        return models


class Generator(Base):
    """generate(seed, n_samples, start_datetime) -> series_id, seq, ts, typical_price."""

    kind = ""
    fits: dict[str, str] = {}
    reads = ("start_datetime", "interval_hours", "n_regimes")

    def load_model(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def fit(self) -> DataFrame:
        return G.fit(self.series(), self.kind, {k: self.option(v) for k, v in self.fits.items()})

    def _prices(self, seed: int, n: int) -> DataFrame:
        path = self.cfg.get("load_model")
        return G.sample(self.load_model(path) if path else self.fit(), n, 1, seed)

    def generate(self, seed: int, n_samples: int, start_datetime: str | None = None) -> DataFrame:
        start = start_datetime or self.option("start_datetime")
        rows = self._prices(seed, n_samples)
        return rows.select("series_id", "seq", src.at_step(F.col("seq"), start, self.option("interval_hours")).alias("ts"), "typical_price")


class BlockBootstrap(Generator):
    reads = ("start_datetime", "interval_hours", "block_size")

    def _prices(self, seed: int, n: int) -> DataFrame:
        px = self.series()
        S.check_long_enough(px, self.option("block_size") + 1, what="block_size")
        return G.block_bootstrap(px, n, 1, self.option("block_size"), seed)


class GraphWalk(Generator):
    reads = ("start_datetime", "interval_hours", "n_bins")

    def _prices(self, seed: int, n: int) -> DataFrame:
        px = self.series()
        states = graph.quantile_states(S.log_returns(px), self.option("n_bins"))
        if states.where("n_states < 3").first():
            raise ValueError("a series has fewer than 3 states: its returns hardly differ")
        return G.walk_prices(G.markov_walk(states, n, 1, seed), px)


class Network(Generator):
    """Samples a trained model; without one it trains first."""

    kind, reads = "vae_gan", ("start_datetime", "interval_hours", *NETWORK)

    def fit(self) -> DataFrame:
        return G.fit(self.series(), self.kind, _net_options(self))


class TimeGan(Generator):
    kind, fits, reads = "timegan", {"epochs": "epochs"}, ("start_datetime", "interval_hours", "epochs")


class Distribution(Base):
    def evaluate(self, synthetic: Any = None, real: Any = None) -> DataFrame:
        sides = ((self.series(synthetic, "synthetic_data"), "synth"), (self.series(real, "real_data"), "real"))
        parts = [df.select(F.lit("x").alias("series_id"), F.lit(s).alias("side"), "seq", "typical_price") for df, s in sides]
        return T.distribution_report(parts[0].unionByName(parts[1]), with_adf=True).drop("series_id")

    def evaluate_arrays(self, synthetic: Any, real: Any) -> DataFrame:
        frame = lambda x: self.spark.createDataFrame([("x", i, float(p)) for i, p in enumerate(x)], "series_id string, seq long, typical_price double")
        return self.evaluate(frame(synthetic), frame(real))


class Predictive(Base):
    reads = ("window_size", "horizon", "eval_epochs", "eval_batch_size", "predictor_dir")

    def evaluate(self, synthetic: Any = None, train: Any = None, val: Any = None, test: Any = None) -> DataFrame:
        own = [self.series(x, k) for x, k in ((train, "real_train"), (val, "real_val"), (test, "real_test"), (synthetic, "synthetic_data"))]
        return evaluate.predictive(*own, window=self.option("window_size"), horizon=self.option("horizon"), epochs=self.option("eval_epochs"), batch=self.option("eval_batch_size"), predictor=_external(self.option("predictor_dir")))


class Augmentation(Base):
    reads = ("window_size", "eval_epochs", "eval_batch_size", "predictor_root")

    def evaluate(self) -> DataFrame:
        own = [self.series(None, k) for k in ("d4_file", "d5_file", "d6_file", "synthetic_data")]
        return evaluate.augmentation(*own, baseline_path=self.cfg.get("baseline_file"), window=self.option("window_size"), epochs=self.option("eval_epochs"), batch=self.option("eval_batch_size"), predictor=_external(self.option("predictor_root")))


class Genetic(Base):
    """Stages of a genetic search over a network's settings; the fitness is what synthetic rows add to a predictor's validation error. State can be resumed."""

    reads = (
        *NETWORK, "population_size", "n_generations", "crossover_prob", "mutation_prob", "optimization_patience", "optimization_resume", "optimization_resume_file", "seed", "train_epochs", "predictor_epochs", "n_synthetic_samples",
        "start_datetime", "interval_hours", "horizon", "eval_batch_size", "predictor_root",
    )

    def optimize(self) -> dict[str, Any]:
        train, val = self.series(None, "d4_file") if self.cfg.get("d4_file") else self.series(), self.series(None, "d5_file") if self.cfg.get("d5_file") else self.series(None, "real_data")
        settings = {k: self.option(k) for k in self.reads}
        settings["epochs"] = settings["train_epochs"] or max(settings["epochs"] // 4, 50)
        file = self.option("optimization_resume_file")
        state = src.load_model(self.spark, file) if self.option("optimization_resume") and src.path_exists(self.spark, file) else None

        def fitness(configs: DataFrame) -> DataFrame:
            return search.utility(configs, train, val, settings, predictor=_external(self.option("predictor_root")))

        log = self.cfg.get("meta_training_log")
        out = search.staged_ga(
            self.spark, fitness, genes=self.cfg.get("genes"), stages=self.cfg.get("stages"), size=self.option("population_size"), generations=self.option("n_generations"), cross=self.option("crossover_prob"), mutate=self.option("mutation_prob"), patience=self.option("optimization_patience"), seed=self.option("seed"),
            resume=state, log=(lambda r: self.spark.createDataFrame([r]).write.mode("append").parquet(log)) if log else None,
        )
        if self.option("optimization_resume"):
            src.save_model(self.spark, out, file)
        if isinstance(out["best"].get("activation"), int):
            out["best"]["activation"] = search.ACTIVATIONS[out["best"]["activation"]]
        return out


def _named(base: type, kind: str, fits: dict[str, str] | None = None) -> type:
    return type(f"{kind}_{base.__name__}", (base,), {"kind": kind, "fits": fits or {}})


REGISTRY: dict[tuple[str, str], type] = {
    ("trainer", "vae_gan_trainer"): _named(Trainer, "vae_gan"), ("trainer", "vae_trainer"): _named(Trainer, "vae"), ("trainer", "gan_trainer"): _named(Trainer, "gan"),
    ("generator", "typical_price_generator"): Network, ("generator", "block_bootstrap_generator"): BlockBootstrap, ("generator", "graph_generator"): GraphWalk, ("generator", "timegan_generator"): TimeGan,
    ("generator", "regime_conditional"): _named(Generator, "hmm_ar", {"k": "n_regimes"}), ("generator", "regime_hmm_garch"): _named(Generator, "hmm_garch", {"k": "n_regimes"}),
    ("generator", "regime_bootstrap_hybrid"): _named(Generator, "hybrid", {"k": "n_regimes", "block": "block_size"}), ("generator", "regime_gan"): _named(Generator, "regime_gan", {"k": "n_regimes"}),
    ("evaluator", "distribution_evaluator"): Distribution, ("evaluator", "predictive_evaluator"): Predictive, ("evaluator", "augmentation_evaluator"): Augmentation, ("optimizer", "ga_optimizer"): Genetic,
}


def load_plugin(kind: str, name: str) -> type:
    if (kind, name) not in REGISTRY:
        raise ImportError(f"no {kind} '{name}'; there are {list_plugins(kind)}")
    return REGISTRY[kind, name]


def list_plugins(kind: str) -> list[str]:
    return sorted(n for k, n in REGISTRY if k == kind)
