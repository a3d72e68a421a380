"""Sources and sinks: price series as (series_id, seq, ts, typical_price), models, metrics."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIME, PRICE = "DATE_TIME", "typical_price"


def load_csv(spark: SparkSession, path: str, time: str | None = TIME) -> DataFrame:
    """A CSV with a header; `typical_price` must be there. time=None takes the first column as the date index."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if PRICE not in df.columns:
        raise ValueError(f"CSV {path} must have a '{PRICE}' column")
    first = time or df.columns[0]
    if first not in df.columns:
        raise ValueError(f"CSV {path} must have a '{first}' column")
    return df.withColumn(first, F.col(first).cast("timestamp_ntz")).withColumn(PRICE, F.col(PRICE).cast("double")).withColumnRenamed(first, TIME)


def numbered(df: DataFrame, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("ts",)) -> DataFrame:
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)


def concat_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows with src_idx, the place of their source; no sort, no removal."""
    out = None
    for k, df in enumerate(frames):
        part = df.withColumn("src_idx", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source")
    return out


def first_per_date(df: DataFrame, keys: Sequence[str] = ("series_id",), ts: str = "ts", order: Sequence[str] = ("src_idx",)) -> DataFrame:
    """Of rows of one date the one of the earliest source stays; a partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys, ts).agg(best).select(*keys, ts, *(F.col(f"_row.{c}").alias(c) for c in rest))


def load_many(spark: SparkSession, paths: Sequence[str], series_id: str = "series") -> DataFrame:
    """Several CSVs as one series: sorted by date, dates unique, numbered from 0."""
    frames = [load_csv(spark, p).select(F.lit(series_id).alias("series_id"), F.col(TIME).alias("ts"), PRICE) for p in paths]
    return numbered(first_per_date(concat_sources(frames), order=("src_idx", PRICE))).select("series_id", "seq", "ts", PRICE)


def save_csv(df: DataFrame, path: str) -> None:
    """DATE_TIME,typical_price in order, in one file: a single series is meant."""
    df.orderBy("seq").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(TIME), PRICE).coalesce(1).write.mode("overwrite").csv(path, header=True)


def predictor_format(df: DataFrame) -> DataFrame:
    """With CLOSE = typical_price, as external predictors read it."""
    return df.withColumn("CLOSE", F.col(PRICE))


def resolve(spark: SparkSession, source: Any, config: dict[str, Any] | None = None, key: str | None = None) -> DataFrame:
    """A DataFrame, a CSV path, a list of paths, or what the config has under the key."""
    if source is None and config and key:
        source = config.get(key)
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return load_many(spark, [source])
    if isinstance(source, (list, tuple)) and source:
        return load_many(spark, source)
    raise ValueError(f"no series: neither a DataFrame nor a path was given, and the setting {key} is empty")


def date_grid(spark: SparkSession, n: int, start: str = "2020-01-01 00:00:00", interval_hours: int = 4) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("seq"), at_step(F.col("id"), start, interval_hours).alias("ts"))


def at_step(seq: Column, start: str, interval_hours: int = 4) -> Column:
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (seq * interval_hours).cast("int"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar a day of order prices: (high + low + close) / 3."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    price = (F.max("o_totalprice") + F.min("o_totalprice") + F.max_by("o_totalprice", "o_orderkey")) / 3
    return o.groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(price.cast("double").alias(PRICE)).select(F.lit("orders").alias("series_id"), "ts", PRICE)


def event_bars(spark: SparkSession, sf_dir: str, hours: int = 4) -> DataFrame:
    """Bars of `hours` for each type of event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    return bars_of(e.withColumn("series_id", F.concat(F.lit("event:"), "event_type")), hours)


def bars_of(e: DataFrame, hours: int = 4) -> DataFrame:
    """events (series_id, ts, value, event_id) downsampled to bars, (high + low + close) / 3."""
    price = (F.max("value") + F.min("value") + F.max_by("value", F.struct("ts", "event_id"))) / 3
    return e.groupBy("series_id", F.window("ts", f"{hours} hours").alias("w")).agg(price.cast("double").alias(PRICE)).select("series_id", F.col("w.start").cast("timestamp_ntz").alias("ts"), PRICE)


def all_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and event bars as numbered series."""
    return numbered(daily_bars(spark, sf_dir).unionByName(event_bars(spark, sf_dir))).select("series_id", "seq", "ts", PRICE)


def with_split(px: DataFrame, n: int = 6) -> DataFrame:
    """Chronological splits d1 to dn."""
    return px.withColumn("split", F.ntile(n).over(Window.partitionBy("series_id").orderBy("seq")))


def read_params(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    """Normalisation parameters: {column: {mean, std}} or {column_mean, column_std}."""
    raw = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    nested = {k: (float(v["mean"]), float(v["std"])) for k, v in raw.items() if isinstance(v, dict)}
    flat = {k[:-5]: (float(v), float(raw[f"{k[:-5]}_std"])) for k, v in raw.items() if k.endswith("_mean") and f"{k[:-5]}_std" in raw}
    return nested | flat


def predictor_result(raw: Column) -> dict[str, Column]:
    """MAEs of a predictor's JSON result, under either name."""
    return {f"{k}_mae": F.coalesce(F.get_json_object(raw, f"$.{name}_mae"), F.get_json_object(raw, f"$.{k}_mae")).cast("double") for k, name in (("val", "validation"), ("test", "test"))}


def save_metrics(df: DataFrame, path: str, form: str = "csv", append: bool = False) -> None:
    """A metrics sink: csv, json or parquet; append adds to a log."""
    writer = df.write.mode("append" if append else "overwrite")
    writer.option("header", True).format(form).save(path)


def metrics_table(df: DataFrame, name: str = "metrics", path: str | None = None) -> None:
    """The fact table, replaced, under a name that SQL can use; with a path it is stored there, and the name reads it."""
    if path:
        df.write.mode("overwrite").parquet(path)
        df = df.sparkSession.read.parquet(path)
    df.createOrReplaceTempView(name)


def save_model(spark: SparkSession, model: dict[str, Any], path: str) -> None:
    """A model or search state as one JSON row of a Parquet table."""
    spark.createDataFrame([(str(model.get("kind", "model")), json.dumps(model))], "kind string, body string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.parquet(path).first().body)


def path_exists(spark: SparkSession, path: str) -> bool:
    """In whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_parquet(spark: SparkSession, path: str, make) -> DataFrame:
    """Made once, read afterwards."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
