"""Evaluators: predictive utility of synthetic data, and augmentation with a cached baseline."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions import columns as C
from seriesmill.operators import neural
from seriesmill.operators import series as S
from seriesmill.operators import stats as T
from seriesmill.sources import series as src

MAES = ("train", "val", "test")


def predictor_errors(arms: DataFrame, window: int = 24, horizon: int = 1, epochs: int = 5, batch: int = 64, seed: int = 0, predictor: Callable[..., dict[str, float]] | None = None) -> DataFrame:
    """arms (arm, role, seq, typical_price; role train, val or test) -> arm, mae_train, mae_val, mae_test, n_train, error: a predictor for each arm, in parallel.

    predictor takes the place of the built-in one: (train array, {role: array}, window,
    horizon, epochs, batch, seed=) -> {role: mean absolute error}.
    """
    learn = predictor or neural.train_predictor

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {k: g.sort_values("seq")["typical_price"].to_numpy(float) for k, g in pdf.groupby("role")}
        errors, why = {}, None
        try:
            errors = learn(parts["train"], {k: v for k, v in parts.items() if k != "train"}, window, horizon, epochs, batch, seed=seed)
        except Exception as e:  # an arm that fails is a row
            why = f"{type(e).__name__}: {e}"
        return pd.DataFrame([[pdf["arm"].iloc[0], *(errors.get(k) for k in MAES), len(parts.get("train", ())), why]], columns=["arm", *(f"mae_{k}" for k in MAES), "n_train", "error"])

    return arms.select("arm", "role", "seq", "typical_price").groupBy("arm").applyInPandas(run, "arm string, mae_train double, mae_val double, mae_test double, n_train long, error string")


def _arms(train: DataFrame, augmented: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    out = None
    for arm, own in (("baseline", train), ("augmented", augmented)):
        for role, df in (("train", own), ("val", val), ("test", test)):
            part = df.select(F.lit(arm).alias("arm"), F.lit(role).alias("role"), "seq", "typical_price")
            out = part if out is None else out.unionByName(part)
    return out


def _side(errors: DataFrame) -> DataFrame:
    return errors.groupBy().agg(*(F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{a}_{c}") for a in ("baseline", "augmented") for c in (*(f"mae_{k}" for k in MAES), "n_train")))


def predictive(train: DataFrame, val: DataFrame, test: DataFrame, synthetic: DataFrame, window: int = 24, horizon: int = 1, epochs: int = 5, batch: int = 64, predictor: Callable[..., dict[str, float]] | None = None) -> DataFrame:
    """One row: errors on real data and with synthetic data before it, their differences (negative: it helps), and the distribution report."""
    arms = _arms(train, S.prepend(synthetic, train), val, test)
    one = _side(predictor_errors(arms, window, horizon, epochs, batch, predictor=predictor))
    b, a = (lambda k: F.col(f"baseline_mae_{k}")), (lambda k: F.col(f"augmented_mae_{k}"))
    delta = {k: a(k) - b(k) for k in ("val", "test")}
    fields = [
        *(b(k) for k in MAES), *(a(k) for k in MAES), *(delta[k].alias(f"mae_delta_{k}") for k in delta), *((delta[k] / (b(k) + 1e-12) * 100).alias(f"mae_pct_change_{k}") for k in delta),
        F.col("baseline_n_train").alias("n_real_train"), (F.col("augmented_n_train") - F.col("baseline_n_train")).alias("n_synthetic"), F.col("augmented_n_train").alias("n_augmented_train"),
        F.lit(window).alias("window_size"), F.lit(horizon).alias("horizon"), *((delta[k] < 0).alias(f"synthetic_helps_{k}") for k in delta), C.verdict(delta["test"], "HELPS", "HURTS").alias("verdict"),
    ]
    pair = synthetic.select(F.lit("x").alias("series_id"), F.lit("synth").alias("side"), "seq", "typical_price").unionByName(train.select(F.lit("x").alias("series_id"), F.lit("real").alias("side"), "seq", "typical_price"))
    report = T.distribution_report(pair, with_adf=True).drop("series_id")
    report = report.select(*(F.col(c).alias(f"dist_{c}") for c in report.columns))
    return one.select(*fields).crossJoin(report)  # one row each


def augmentation(train: DataFrame, val: DataFrame, test: DataFrame, synthetic: DataFrame, baseline_path: str | None = None, params: dict[str, tuple[float, float]] | None = None, **options: Any) -> DataFrame:
    """One row: errors without and with synthetic rows (sorted by date, real ones win), improvements (positive: it helps) and the verdict.

    params normalises the synthetic prices first; baseline_path keeps the errors without them for the next call.
    """
    spark = train.sparkSession
    fake = S.zscore(synthetic, "typical_price", params) if params else synthetic
    arms = _arms(train, S.augment(train, fake), val, test)
    base = lambda: predictor_errors(arms.where("arm = 'baseline'"), **options)
    baseline = src.cached_parquet(spark, baseline_path, base) if baseline_path else base()
    one = _side(baseline.unionByName(predictor_errors(arms.where("arm = 'augmented'"), **options)))
    gain = {k: F.col(f"baseline_mae_{k}") - F.col(f"augmented_mae_{k}") for k in ("val", "test")}
    return one.select(
        *(F.col(f"{a}_mae_{k}").alias(f"{a}_{k}_mae") for a in ("baseline", "augmented") for k in ("val", "test")), *(gain[k].alias(f"{k}_improvement") for k in gain),
        *(F.when(F.col(f"baseline_mae_{k}") > 0, gain[k] / F.col(f"baseline_mae_{k}") * 100).otherwise(0.0).alias(f"{k}_improvement_pct") for k in gain), F.when(gain["val"] > 0, "GOOD").otherwise("BAD").alias("verdict"),
    )


def horizon_errors(pairs: DataFrame) -> DataFrame:
    """pairs (horizon, pred, y) -> horizon, mae, n; the row without a horizon covers all."""
    return pairs.groupBy(F.col("horizon")).agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"), F.count("*").alias("n")).unionByName(
        pairs.groupBy().agg(F.lit(None).cast("int").alias("horizon"), F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"), F.count("*").alias("n")).select("horizon", "mae", "n")
    )
