"""Round trips, guards, determinism and plugins."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from seriesmill import cli, config, registry
from seriesmill.functions import autodiff as ad
from seriesmill.operators import generators as G
from seriesmill.operators import regimes
from seriesmill.operators import series as S
from seriesmill.operators import stats as T
from seriesmill.plans import evaluate, search, tolerance
from seriesmill.sources import series as src
from seriesmill.streaming import bars


def walk(spark, n, seed, series_id="a", scale=0.0005):
    p = 1.3 + np.cumsum(np.random.default_rng(seed).normal(0, scale, n))
    rows = spark.createDataFrame([(series_id, i, float(x)) for i, x in enumerate(p)], "series_id string, seq long, typical_price double")
    return rows.withColumn("ts", src.at_step(F.col("seq"), "2020-01-01 00:00:00"))


@pytest.fixture(scope="module")
def csv(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "walk.csv")
    src.save_csv(walk(spark, 300, 1), path)
    return path


def test_returns_and_prices_round_trip(spark):
    prices = [1.0, 1.01, 1.005, 1.02, 0.99]
    px = spark.createDataFrame([("a", i, p, prices[0]) for i, p in enumerate(prices)], "series_id string, seq long, typical_price double, p0 double")
    back = [r.typical_price for r in S.rebuild_prices(S.log_returns(px)).orderBy("seq").collect()]
    assert np.allclose(back, prices, rtol=1e-12)


def test_windows(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "series_id string, seq long, x double")
    rows = S.sliding_windows(df, "x", 3).orderBy("win_idx").collect()
    assert [r.win_idx for r in rows] == list(range(8)) and rows[0].x == [0, 1, 2] and rows[-1].x == [7, 8, 9]
    with pytest.raises(ValueError):
        S.check_long_enough(df.limit(2), 5)
    few = S.strided_windows(df, "x", 6, 3).groupBy("win_idx").count().collect()
    assert {r.win_idx: r["count"] for r in few} == {0: 2, 1: 1, 2: 1, 3: 2, 4: 1}


def test_csv_round_trip(spark, csv, tmp_path):
    px = src.load_many(spark, [csv, csv])
    assert px.count() == 300 and px.columns == ["series_id", "seq", "ts", "typical_price"]
    assert [r.typical_price for r in px.orderBy("seq").limit(5).collect()] == [r.typical_price for r in walk(spark, 300, 1).orderBy("seq").limit(5).collect()]
    bad = str(tmp_path / "bad.csv")
    spark.createDataFrame([(1,)], "x int").write.csv(bad, header=True)
    with pytest.raises(ValueError):
        src.load_csv(spark, bad)
    with pytest.raises(ValueError):
        src.resolve(spark, None, {}, "real_data")


def test_params_and_models(spark, tmp_path):
    for k, body in enumerate(({"a": {"mean": 1, "std": 2}}, {"a_mean": 1, "a_std": 2})):
        (tmp_path / f"{k}.json").write_text(json.dumps(body))
        assert src.read_params(spark, str(tmp_path / f"{k}.json")) == {"a": (1.0, 2.0)}
    src.save_model(spark, {"kind": "x", "v": [1, 2]}, str(tmp_path / "m"))
    assert src.load_model(spark, str(tmp_path / "m")) == {"kind": "x", "v": [1, 2]}
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert src.cached_parquet(spark, str(tmp_path / "c"), make).count() == src.cached_parquet(spark, str(tmp_path / "c"), make).count() == 3
    assert len(made) == 1
    src.save_metrics(spark.range(2), str(tmp_path / "log"), "parquet", append=True)
    src.save_metrics(spark.range(2), str(tmp_path / "log"), "parquet", append=True)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_equal_and_shifted_samples(spark):
    r = S.log_returns(walk(spark, 400, 2)).select("series_id", "seq", "ret")
    same = r.withColumn("side", F.lit("real")).unionByName(r.withColumn("side", F.lit("synth")))
    d = T.distances(same).first()
    assert d.wasserstein < 1e-12 and d.ks == 0 and T.js_divergence(same).first().js < 1e-12
    moved = r.withColumn("side", F.lit("real")).unionByName(r.withColumn("ret", F.col("ret") + 0.25).withColumn("side", F.lit("synth")))
    assert abs(T.distances(moved).first().wasserstein - 0.25) < 1e-9
    assert T.ks_pvalue(0.0, 100, 100) == 1.0 and T.ks_pvalue(0.9, 100, 100) < 1e-9


def test_adf():
    rng = np.random.default_rng(3)
    assert T.adf_pvalue(rng.normal(size=500)) < 0.01
    assert T.adf_pvalue(np.cumsum(rng.normal(size=500))) > 0.05
    assert T.adf_pvalue(np.ones(50)) == -1.0


def test_array_scores_agree_with_frames(spark):
    a, b = walk(spark, 300, 4), walk(spark, 300, 5)
    pair = a.withColumn("side", F.lit("real")).unionByName(b.withColumn("side", F.lit("synth")))
    row = T.composite(T.metric_record(pair)).first().asDict()
    arrays = [np.array([r.typical_price for r in df.orderBy("seq").collect()]) for df in (a, b)]
    terms = search.array_terms(*arrays)
    for k in T.COMPOSITE:
        assert math.isclose(row[k], terms[k], rel_tol=1e-6, abs_tol=1e-9), k
    assert math.isclose(row["score"], search.weighted(terms), rel_tol=1e-6)


def test_multi_seed_skips_failures():
    real = 1.3 + np.cumsum(np.random.default_rng(0).normal(0, 0.001, 200))

    def make(seed):
        if seed == 1:
            raise RuntimeError
        return real[: 150 + seed]

    mean, std, terms = search.multi_seed(real, make, range(3))
    assert np.isfinite(mean) and terms
    assert search.multi_seed(real, lambda s: 1 / 0, range(2))[0] == float("inf")


def test_hmm_finds_regimes():
    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1, 0, 1], 150)
    x = np.column_stack([rng.normal(0, np.where(truth, 3.0, 0.5)), np.where(truth, 3.0, 0.5) + rng.normal(0, 0.1, 600)])
    model = regimes.fit_hmm(x, 2)
    assert (model.viterbi(x) == truth).mean() > 0.98 and np.allclose(model.move.sum(axis=1), 1)
    for kind in ("diag", "tied"):
        assert np.isfinite(regimes.fit_hmm(x, 2, kind).covars).all()


def test_change_points_and_clusters():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 100), rng.normal(6, 1, 100), rng.normal(0, 1, 100)])
    ends = regimes.pelt(x)
    assert len(ends) == 3 and abs(ends[0] - 100) <= 5 and abs(ends[1] - 200) <= 5 and ends[-1] == 300
    assert regimes.ward(np.array([[0.0], [5.0], [0.1], [5.1]]), 2).tolist() == [0, 1, 0, 1]


def test_garch_grid_in_both_forms(spark):
    px = walk(spark, 300, 6)
    r = S.log_returns(px)
    row = regimes.garch_fit(r).first()
    own = G.garch_of(np.array([x.ret for x in r.orderBy("seq").collect()]))
    assert (row.alpha, row.beta) == (own["alpha"], own["beta"]) and math.isclose(row.omega, own["omega"], rel_tol=1e-9)


def test_gradients():
    rng = np.random.default_rng(4)
    net, x = ad.Lstm(rng, 2, 3), [rng.normal(size=(4, 2)) for _ in range(3)]
    loss = lambda: (net(x) * net(x)).mean().sqrt() + ad.bce(net(x), True)
    node = loss()
    node.backward()
    w = net.params[0]
    got = w.grad[1, 2]
    w.value[1, 2] += 1e-5
    up = float(loss().value)
    w.value[1, 2] -= 2e-5
    assert abs((up - float(loss().value)) / 2e-5 - got) < 1e-6


@pytest.mark.parametrize("kind,options", [("hmm_ar", {"k": 2}), ("hybrid", {"k": 2}), ("vae_gan", {"epochs": 2}), ("timegan", {"epochs": 1}), ("regime_gan", {"epochs": 2})])
def test_samples_depend_on_the_seed_alone(spark, kind, options):
    px = walk(spark, 200, 7).unionByName(walk(spark, 200, 8, "b"))
    models = G.fit(px, kind, options).persist()
    assert not models.where("error is not null").collect()
    key = lambda df: {(r.series_id, r.seed, r.seq): r.typical_price for r in df.collect()}
    one, two = (key(G.sample(models.repartition(n), 60, 2)) for n in (1, 5))
    assert one == two and len(one) == 240
    assert one["a", 42, 50] != one["a", 43, 50]
    models.unpersist()


def test_relational_samples_do_not_depend_on_partitions(spark):
    px = walk(spark, 200, 9)
    seen = []
    for n in ("3", "11"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, G.block_bootstrap(px, 100).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] and len(seen[0]) == 100


def test_predictive_evaluation(spark):
    parts = [walk(spark, n, k) for k, n in enumerate((200, 120, 120, 80))]
    r = evaluate.predictive(*parts, window=10, epochs=1).first().asDict()
    assert r["baseline_mae_test"] > 0 and abs(r["mae_delta_val"] - (r["augmented_mae_val"] - r["baseline_mae_val"])) < 1e-8
    assert (r["n_real_train"], r["n_synthetic"], r["n_augmented_train"]) == (200, 80, 280) and r["dist_kl_divergence"] >= 0


def test_augmentation_keeps_its_baseline(spark, tmp_path):
    parts = [walk(spark, 120, k) for k in range(4)]
    path = str(tmp_path / "base")
    a, b = (evaluate.augmentation(*parts, baseline_path=path, window=10, epochs=1).first().asDict() for _ in range(2))
    assert a == b and a["verdict"] in ("GOOD", "BAD") and spark.read.parquet(path).count() == 1


def test_staged_search_improves_and_resumes(spark):
    genes = {"x": (0.0, 1.0, "float"), "y": (1, 9, "int"), "z": (1e-4, 1e-1, "log")}
    stages = [{"name": "one", "parameters": ["x", "y"]}, {"name": "two", "parameters": ["z"]}]

    def fitness(frame):
        c = lambda n: F.get_json_object("config", f"$.{n}").cast("double")
        return frame.select("config_id", (F.abs(c("x") - 0.3) + F.abs(c("y") - 7) + F.abs(F.log10(c("z")) + 3)).alias("score"))

    out = search.staged_ga(spark, fitness, genes, stages, size=8, generations=4, seed=1)
    assert out["score"] < 2.5 and out["stage"] == 2 and out["history"][0]["min"] >= out["history"][-1]["best"]
    again = search.staged_ga(spark, fitness, genes, stages, size=4, generations=1, resume=dict(out))
    assert again["score"] == out["score"]


def test_stored_metrics_table(spark, tmp_path):
    for k in (1, 2):
        src.metrics_table(spark.range(k).select(F.col("id").alias("x")), "stored_facts", str(tmp_path / "facts"))
    assert spark.sql("SELECT count(*) AS n FROM stored_facts").first().n == 2 == spark.read.parquet(str(tmp_path / "facts")).count()


def test_back_fill_with_gaps(spark):
    rows = [("a", k, None if k in (4, 5, 11) else float(k % 4)) for k in range(12)] + [("b", 0, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, seq long, ret double")
    got = {(r.series_id, r.seq): r.vol for r in S.rolling_std_filled(df, "ret", 3, 3, "vol").collect()}
    raw = {}
    for s, k, _ in rows:
        own = [x for t, j, x in rows if t == s and k - 2 <= j <= k and x is not None]
        raw[s, k] = float(np.std(own, ddof=1)) if len(own) == 3 else None
    for s, k, _ in rows:
        want = next((raw[s, j] for j in range(k, 12) if raw.get((s, j)) is not None), None)
        assert (got[s, k] is None and want is None) or abs(got[s, k] - want) < 1e-12


def test_search_space():
    assert len(search.GENES) == 16 and len(search.STAGES) == 5
    assert sorted(p for s in search.STAGES for p in s["parameters"]) == sorted(search.GENES)
    assert [search.ACTIVATIONS[k] for k in (0, 1, 7)] == ["tanh", "relu", "linear"]
    assert set(search.GENES) <= set(config.DEFAULTS) and set(registry.NETWORK) <= set(config.DEFAULTS)


def test_activations():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 4))
    for name, f in ad.ACTIVATE.items():
        node = ad.lift(x.copy())
        f(node).sum().backward()
        moved = x.copy()
        moved[1, 2] += 1e-6
        slope = (f(ad.lift(moved)).value.sum() - f(ad.lift(x)).value.sum()) / 1e-6
        assert abs(node.grad[1, 2] - slope) < 1e-4, name


def test_fitness_is_what_synthetic_rows_add(spark):
    train, val = walk(spark, 120, 1), walk(spark, 60, 2)
    settings = config.DEFAULTS | {"window_size": 8, "epochs": 1, "predictor_epochs": 1, "n_synthetic_samples": 50, "eval_batch_size": 32, "start_datetime": "2040-01-01 00:00:00"}

    def predictor(train, others, *args, **options):
        return {"val": float(len(train))}

    configs = search.configs_frame(spark, [{"latent_dim": 3, "activation": 4}, {"window_size": 500}, {"use_returns": False, "conditional": False, "disc_layers": [5]}])
    rows = search.utility(configs, train, val, settings, predictor=predictor).orderBy("config_id").collect()
    assert [r.error is None for r in rows] == [True, False, True] and rows[1].score == search.FAILED
    assert rows[0].score == rows[2].score == 50
    same = search.utility(configs, train, val, settings | {"start_datetime": "2020-01-01 00:00:00"}, predictor=predictor).orderBy("config_id").first()
    assert 0 <= same.score < 50  # of equal dates the real row stays
    own = search.utility(configs, train, val, settings).orderBy("config_id").first()
    assert own.error is None and abs(own.score) < search.FAILED


def test_genetic_plugin(spark, csv, tmp_path):
    own = {"train_data": [csv], "real_data": csv, "window_size": 8, "train_epochs": 1, "predictor_epochs": 1, "n_synthetic_samples": 30, "population_size": 2, "n_generations": 1}
    genes = {"latent_dim": (2, 4, "int"), "activation": (0, 7, "int")}
    out = registry.load_plugin("optimizer", "ga_optimizer")(own | {"genes": genes, "stages": [{"name": "one", "parameters": list(genes)}]}, spark).optimize()
    assert out["score"] < search.FAILED and out["best"]["activation"] in search.ACTIVATIONS
    assert all(registry.load_plugin(k, n).plugin_params for k, n in registry.REGISTRY if n not in ("distribution_evaluator",))


def test_external_predictor(spark, tmp_path):
    (tmp_path / "predictor.py").write_text("def train_predictor(train, others, *args, **options):\n    return {k: 0.5 for k in ('train', *others)}\n")
    parts = [walk(spark, n, k) for k, n in enumerate((60, 40, 40, 30))]
    r = evaluate.predictive(*parts, window=10, epochs=1, predictor=registry._external(str(tmp_path))).first()
    assert r.baseline_mae_val == r.augmented_mae_test == 0.5


def test_script_search(spark):
    best, config_ = search.script_ga(spark, walk(spark, 200, 1), walk(spark, 120, 2), [{"size": 4, "generations": 1, "seeds": 1, "scale": 0.2, "elite": 2, "tournament": 2, "weights": None}])
    assert best < search.FAILED and set(config_) == set(search.RANDOM_GRID)


def test_failures_are_rows(spark):
    bad = search.evaluate(search.configs_frame(spark, [{"k": "x"}, {"k": 2}]), walk(spark, 150, 1), walk(spark, 100, 2), n_seeds=1).orderBy("config_id").collect()
    assert bad[0].score == search.FAILED and bad[0].error and bad[1].error is None


def test_tolerances(spark):
    runs = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.1), ("a", 2, 0.9)], "protocol string, seed long, val_mae double")
    r = tolerance.summary(runs).first()
    assert math.isclose(r.max_dev, 0.1, rel_tol=1e-9) and math.isclose(r.tol_double, 0.2, rel_tol=1e-9)


def test_plugins(spark, csv, tmp_path):
    assert len(registry.list_plugins("generator")) == 8 and len(registry.list_plugins("trainer")) == 3 and len(registry.list_plugins("evaluator")) == 3
    with pytest.raises(ImportError):
        registry.load_plugin("generator", "none")
    for name in ("block_bootstrap_generator", "graph_generator", "regime_conditional"):
        g = registry.load_plugin("generator", name)({"train_data": [csv], "n_bins": 10, "n_regimes": 2}, spark)
        assert isinstance(g, registry.Plugin)
        rows = g.generate(7, 50).collect()
        assert len(rows) == 50 and all(r.typical_price > 0 for r in rows)
    with pytest.raises(ValueError):
        registry.load_plugin("generator", "block_bootstrap_generator")({"train_data": [csv], "block_size": 300}, spark).generate(1, 10)
    own = registry.load_plugin("trainer", "vae_gan_trainer")({"train_data": [csv], "window_size": 12, "latent_dim": 4, "epochs": 2, "save_model": str(tmp_path / "model")}, spark)
    own.train()
    g = registry.load_plugin("generator", "typical_price_generator")({"load_model": str(tmp_path / "model")}, spark)
    a, b, c = ([r.typical_price for r in g.generate(s, 40).orderBy("seq").collect()] for s in (1, 1, 2))
    assert a == b != c
    report = registry.load_plugin("evaluator", "distribution_evaluator")({"synthetic_data": csv}, spark).evaluate(None, walk(spark, 200, 3)).first()
    assert report.kl_divergence >= 0 and 0 <= report.real_adf_pvalue <= 1


def test_settings_and_command_line(spark, csv, tmp_path):
    flags = cli.parse(["--mode", "generate", "--use_returns", "False", "--seed", "3"])
    assert flags == {"mode": "generate", "use_returns": False, "seed": 3}
    with pytest.raises(SystemExit):
        cli.parse(["--sede", "3"])
    assert config.merged({"seed": 1, "epochs": 5}, flags)["seed"] == 3 and config.merged({"epochs": 5})["epochs"] == 5
    out = str(tmp_path / "out.csv")
    cli.main(["--mode", "generate", "--generator", "block_bootstrap_generator", "--train_data", csv, "--n_samples", "40", "--output_file", out])
    assert src.load_csv(spark, out).count() == 40
    metrics = str(tmp_path / "metrics")
    cli.main(["--mode", "evaluate", "--evaluator", "distribution_evaluator", "--synthetic_data", out, "--real_data", csv, "--metrics_file", metrics])
    assert spark.read.json(metrics).first().quality_score >= 0


def test_stream_of_bars(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.concat(F.lit("event:"), "event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    e.write.parquet(str(tmp_path / "events"))
    stream = bars.stream_bars(spark.readStream.schema(e.schema).parquet(str(tmp_path / "events")))
    bars.write_bars(stream, str(tmp_path / "bars"), str(tmp_path / "state")).awaitTermination()
    got = {(r.series_id, r.ts): r.typical_price for r in spark.read.parquet(str(tmp_path / "bars")).collect()}
    want = {(r.series_id, r.ts): r.typical_price for r in src.event_bars(spark, "/root/testdata/sf0.001").select("series_id", F.col("ts").cast("timestamp").alias("ts"), "typical_price").collect()}
    assert got and all(abs(want[k] - v) < 1e-9 for k, v in got.items()) and len(got) > 0.9 * len(want)
