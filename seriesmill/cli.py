"""python -m seriesmill.cli --mode train|generate|evaluate|optimize"""

from __future__ import annotations

import argparse
import json
from typing import Any

from pyspark.sql import SparkSession

from seriesmill import config as conf
from seriesmill.registry import load_plugin
from seriesmill.sources import series as src


def parse(argv: list[str] | None = None) -> dict[str, Any]:
    """Only the flags that were given."""
    p = argparse.ArgumentParser(prog="seriesmill", argument_default=argparse.SUPPRESS)
    for name, default in conf.DEFAULTS.items():
        flags = [f"--{name}", *(["--model"] if name == "load_model" else [])]
        if isinstance(default, bool):
            p.add_argument(*flags, dest=name, type=lambda x: str(x).lower() in ("1", "true", "yes"), nargs="?", const=True)
        elif isinstance(default, list):
            p.add_argument(*flags, dest=name, nargs="+", type=type(default[0]) if default else str)
        elif name == "mode":
            p.add_argument("--mode", choices=["train", "generate", "optimize", "evaluate"])
        else:
            p.add_argument(*flags, dest=name, type=type(default) if isinstance(default, (int, float)) else str)
    return vars(p.parse_args(argv))


def run(spark: SparkSession, cfg: dict[str, Any]) -> Any:
    mode = cfg["mode"]
    spark.sparkContext.setLogLevel(cfg["log_level"])
    if mode == "train":
        return load_plugin("trainer", cfg["trainer"])(cfg, spark).train()
    if mode == "generate":
        out = load_plugin("generator", cfg["generator"])(cfg, spark).generate(cfg["seed"], cfg["n_samples"])
        src.save_csv(out, cfg["output_file"])
        return out
    if mode == "evaluate":
        out = load_plugin("evaluator", cfg["evaluator"])(cfg, spark).evaluate()
        src.save_metrics(out, cfg["metrics_file"], "json")
        return out
    out = load_plugin("optimizer", cfg["optimizer"])(cfg, spark).optimize()
    with open(cfg["optimization_parameters_file"], "w") as f:
        json.dump(out["best"], f, indent=2)
    return out


def main(argv: list[str] | None = None) -> Any:
    spark = SparkSession.builder.appName("seriesmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    flags = parse(argv)
    cfg = conf.merged(conf.load(spark, flags["load_config"]) if flags.get("load_config") else None, flags)
    if cfg["save_config"]:
        with open(cfg["save_config"], "w") as f:
            json.dump(cfg, f, indent=2)
    return run(spark, cfg)


if __name__ == "__main__":
    main()
