"""The evaluation of generators covers all series in one plan of fixed size."""

import random

from pyspark.sql import functions as F
from seriesmill.plans import search
from seriesmill.queries import KINDS, QUERIES
from seriesmill.sources import series as src

SOME = {"Block_bootstrap": ("block_bootstrap", {"block": 10}), "HMM_parametric": ("hmm_ar", {"k": 2})}


def prices(spark, lengths):
    rnd, rows = random.Random(3), []
    for name, n in lengths.items():
        price = 100.0
        for k in range(n):
            price *= 1 + rnd.gauss(0, 0.01)
            rows.append((name, k, price))
    return spark.createDataFrame(rows, "series_id string, seq long, typical_price double")


def test_each_series_as_alone_and_of_its_own_length(spark):
    fit, real = prices(spark, {"a": 150, "b": 120, "c": 200, "short": 2}), prices(spark, {"a": 40, "b": 75, "short": 30})
    own = lambda df, name: df.where(F.col("series_id") == name)
    got = search.generator_metrics(fit, real, SOME, 2).drop("_s5", "_t5", "_s24", "_t24").collect()
    assert {(r.series_id, r.generator, r.seed) for r in got} == {(s, g, k) for s in "ab" for g in SOME for k in (0, 1)}
    assert {(r.series_id, r.n_real, r.n_synth) for r in got} == {("a", 39, 39), ("b", 74, 74)}
    alone = search.generator_samples(own(fit, "b"), own(real, "b"), SOME, 2).collect()
    every = search.generator_samples(fit, real, SOME, 2)
    assert sorted(own(every, "b").collect()) == sorted(alone) and len(alone) == 4 * 75
    assert own(every, "c").isEmpty()


def test_query_has_a_plan_of_fixed_size(spark, sf_dir):
    df = QUERIES["generator_evaluation"](spark, sf_dir)
    assert df._jdf.queryExecution().analyzed().collectLeaves().size() < 100
    want = {r.series_id for r in src.all_series(spark, sf_dir).select("series_id").distinct().collect()}
    assert {(r.series_id, r.generator) for r in df.collect()} == {(s, g) for s in want for g in KINDS}
