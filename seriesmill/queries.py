"""Registered queries with the SQL that checks them; each covers all series of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmill.functions import columns as C
from seriesmill.operators import generators as G
from seriesmill.operators import graph, regimes
from seriesmill.operators import series as S
from seriesmill.operators import stats as T
from seriesmill.plans import evaluate, search, tolerance
from seriesmill.sources import series as src
from seriesmill.sources.tables import cut_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Common table expressions of the oracle, independent of the operators.
PX = """
daily AS (SELECT 'orders' AS series_id, CAST(o_orderdate AS TIMESTAMP) AS ts, (max(o_totalprice) + min(o_totalprice) + arg_max(o_totalprice, o_orderkey)) / 3 AS typical_price FROM orders GROUP BY ALL),
fourh AS (SELECT 'event:' || event_type AS series_id, time_bucket(INTERVAL 4 HOUR, ts) AS ts, (max(value) + min(value) + arg_max(value, event_id)) / 3 AS typical_price FROM events GROUP BY ALL),
px AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS seq, ts, typical_price::DOUBLE AS typical_price FROM (SELECT series_id, ts, typical_price::DOUBLE AS typical_price FROM daily UNION ALL SELECT series_id, ts, typical_price::DOUBLE FROM fourh))"""
RET = PX + """,
ret0 AS (SELECT *, ln(greatest(typical_price, 1e-10)) - lag(ln(greatest(typical_price, 1e-10))) OVER (PARTITION BY series_id ORDER BY seq) AS ret FROM px),
ret AS (SELECT * FROM ret0 WHERE ret IS NOT NULL)"""
PAIR = PX + """,
splits AS (SELECT *, ntile(6) OVER (PARTITION BY series_id ORDER BY seq) AS split FROM px),
pair AS (SELECT series_id, CASE WHEN split > 3 THEN 'real' ELSE 'synth' END AS side, seq, typical_price FROM splits),
pret0 AS (SELECT *, ln(greatest(typical_price, 1e-10)) - lag(ln(greatest(typical_price, 1e-10))) OVER (PARTITION BY series_id, side ORDER BY seq) AS ret FROM pair),
pret AS (SELECT * FROM pret0 WHERE ret IS NOT NULL)"""
R6 = "round({0}, 6) + 0.0"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH {sql}" if not sql.lstrip().upper().startswith("WITH") else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def pair_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of each series as the real side, the earlier as the synthetic one."""
    px = src.with_split(src.all_series(spark, sf_dir))
    return px.select("series_id", F.when(F.col("split") > 3, "real").otherwise("synth").alias("side"), "seq", "typical_price")


def returns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.log_returns(src.all_series(spark, sf_dir), floor=C.FLOOR).select("series_id", "seq", "ts", "ret")


def pair_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.log_returns(pair_of(spark, sf_dir), T.SIDES, C.FLOOR)


# Sources


@query(f"{PX} SELECT series_id, seq, ts, round(typical_price, 6) AS typical_price FROM px")
def bars_4h(spark, sf_dir):
    return rounded(src.all_series(spark, sf_dir))


@query(f"""{PX},
s AS (SELECT *, ntile(6) OVER (PARTITION BY series_id ORDER BY seq) AS split FROM px),
u AS (SELECT 0 AS src_idx, series_id, ts, typical_price FROM s WHERE split <= 4 UNION ALL SELECT 1, series_id, ts, typical_price * 2 FROM s WHERE split >= 3),
f AS (SELECT series_id, ts, arg_min(typical_price, src_idx) AS p FROM u GROUP BY ALL)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS seq, ts, round(p, 6) AS typical_price FROM f""")
def dedupe_series(spark, sf_dir):
    px = src.with_split(src.all_series(spark, sf_dir)).drop("seq")
    both = src.concat_sources([px.where("split <= 4"), px.where("split >= 3").withColumn("typical_price", F.col("typical_price") * 2)])
    return rounded(src.numbered(src.first_per_date(both)).select("series_id", "seq", "ts", "typical_price"))


@query(f"""{PX}, s AS (SELECT *, ntile(6) OVER (PARTITION BY series_id ORDER BY seq) AS split FROM px)
SELECT series_id, 0 AS src_idx, round(typical_price, 6) AS typical_price FROM s WHERE split <= 4 UNION ALL SELECT series_id, 1, round(typical_price, 6) FROM s WHERE split >= 3""")
def concat_series(spark, sf_dir):
    px = src.with_split(src.all_series(spark, sf_dir))
    return rounded(src.concat_sources([px.where("split <= 4"), px.where("split >= 3")]).select("series_id", "src_idx", "typical_price"))


@query("g AS (SELECT unnest(range(500)) AS seq) SELECT seq, TIMESTAMP '2020-01-01 00:00:00' + seq * INTERVAL 4 HOUR AS ts FROM g")
def date_grid(spark, sf_dir):
    return src.date_grid(spark, 500)


@query(f"{PX} SELECT series_id, seq, round(typical_price, 6) AS typical_price, round(typical_price, 6) AS \"CLOSE\" FROM px")
def predictor_format(spark, sf_dir):
    return rounded(src.predictor_format(src.all_series(spark, sf_dir).select("series_id", "seq", "typical_price")))


@query("""j AS (SELECT unnest(['{"validation_mae": 0.5, "test_mae": 0.25}', '{"val_mae": 0.75, "test_mae": 1.5}', '{}']) AS body)
SELECT coalesce(body ->> '$.validation_mae', body ->> '$.val_mae')::DOUBLE AS val_mae, coalesce(body ->> '$.test_mae', body ->> '$.test_mae')::DOUBLE AS test_mae FROM j""")
def predictor_results(spark, sf_dir):
    rows = spark.createDataFrame([('{"validation_mae": 0.5, "test_mae": 0.25}',), ('{"val_mae": 0.75, "test_mae": 1.5}',), ("{}",)], "body string")
    found = src.predictor_result(F.col("body"))
    return rows.select(*(c.alias(k) for k, c in found.items()))


# Projections


@query(f"{RET} SELECT series_id, seq, ts, {R6.format('ret')} AS ret FROM ret")
def log_returns(spark, sf_dir):
    return rounded(returns_of(spark, sf_dir))


@query(f"{PX} SELECT series_id, seq, round(typical_price, 4) AS typical_price FROM px")
def rebuild_prices(spark, sf_dir):
    px = src.all_series(spark, sf_dir)
    p0 = F.first("typical_price").over(S.ordered())
    return rounded(S.rebuild_prices(S.log_returns(px.withColumn("p0", p0))).select("series_id", "seq", "typical_price"), 4)


_CYCLE = ", ".join(f"{R6.format(f'{f}(2 * pi() * {e})')} AS {k}_{f}" for k, e in (("hour", "hour(ts) / 24.0::DOUBLE"), ("dow", "(isodow(ts) - 1) / 5.0::DOUBLE"), ("month", "month(ts) / 12.0::DOUBLE")) for f in ("sin", "cos"))


@query(f"{PX} SELECT series_id, seq, {_CYCLE} FROM px")
def temporal_features(spark, sf_dir):
    px = src.all_series(spark, sf_dir)
    return rounded(px.select("series_id", "seq", *(c.alias(k) for k, c in C.cyclic_time(F.col("ts")).items())))


@query(f"""{RET} SELECT series_id, seq, {R6.format('(ret - avg(ret) OVER w) / (stddev_pop(ret) OVER w + 1e-10)')} AS ret_z, {R6.format('(typical_price - 1000.0::DOUBLE) / 250.0::DOUBLE')} AS typical_price FROM ret WINDOW w AS (PARTITION BY series_id)""")
def zscore(spark, sf_dir):
    r = S.log_returns(src.all_series(spark, sf_dir), floor=C.FLOOR)
    return rounded(S.zscore(S.standardise(r, ["ret"]), "typical_price", {"typical_price": (1000.0, 250.0)}).select("series_id", "seq", "ret_z", "typical_price"))


@query(f"""{PX}, m AS (SELECT *, min(typical_price) OVER (PARTITION BY series_id) AS lo, max(typical_price) OVER (PARTITION BY series_id) AS hi FROM px)
SELECT series_id, seq, {R6.format('(typical_price - lo) / CASE WHEN hi - lo < 1e-10 THEN 1.0 ELSE hi - lo END')} AS scaled, round(typical_price, 6) AS value FROM m""")
def minmax(spark, sf_dir):
    return rounded(S.unscale(S.minmax(src.all_series(spark, sf_dir), "typical_price")).select("series_id", "seq", "scaled", "value"))


@query(f"""{RET}, f AS (SELECT series_id, arg_min(typical_price, seq) AS p0 FROM px GROUP BY 1),
v AS (SELECT series_id, seq, exp(ln(p0) + sum(ret * 0.8::DOUBLE) OVER (PARTITION BY series_id ORDER BY seq)) AS p FROM ret JOIN f USING (series_id) UNION ALL SELECT series_id, 0, p0 FROM f)
SELECT series_id, seq, round(p, 4) AS typical_price FROM v WHERE seq < 1000""")
def vol_scale(spark, sf_dir):
    return rounded(S.truncate(S.rescale_volatility(src.all_series(spark, sf_dir), 0.8), 1000).select("series_id", "seq", "typical_price"), 4)


@query(f"""{RET}, w AS (SELECT series_id, seq, seq // 20 AS win_idx, ret FROM ret)
SELECT series_id, win_idx, seq, {R6.format('ret - avg(ret) OVER (PARTITION BY series_id, win_idx)')} AS ret FROM w""")
def demean_windows(spark, sf_dir):
    r = returns_of(spark, sf_dir).withColumn("win_idx", F.floor(F.col("seq") / 20))
    return rounded(S.demean_windows(r).select("series_id", "win_idx", "seq", "ret"))


# Windows


def _flat(windows: DataFrame, *carry: str) -> DataFrame:
    return rounded(windows.select("series_id", "win_idx", *carry, F.posexplode("x").alias("pos", "x")))


_WIN = """
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS total FROM ret),
w AS (SELECT a.series_id, a.k AS win_idx, b.k - a.k AS pos, b.ret AS x FROM n a JOIN n b ON a.series_id = b.series_id AND b.k BETWEEN a.k AND a.k + {0} - 1 WHERE a.k + {0} <= a.total)"""


@query(f"{RET}, {_WIN.format(10)} SELECT series_id, win_idx, pos::INT AS pos, {R6.format('x')} AS x FROM w")
def sliding_windows(spark, sf_dir):
    return _flat(S.sliding_windows(returns_of(spark, sf_dir), "ret", 10))


@query(f"""{RET}, {_WIN.format(5)} SELECT w.series_id, win_idx, {R6.format('n.ret')} AS y_3, pos::INT AS pos, {R6.format('x')} AS x FROM w JOIN n ON n.series_id = w.series_id AND n.k = win_idx + 4 + 3""")
def supervised_windows(spark, sf_dir):
    return _flat(S.supervised_windows(returns_of(spark, sf_dir), "ret", 5, [3]), "y_3")


@query(f"""{RET}, {_WIN.format(5)} SELECT w.series_id, win_idx, {R6.format('a.ret')} AS y_1, {R6.format('b.ret')} AS y_6, pos::INT AS pos, {R6.format('x')} AS x FROM w
JOIN n a ON a.series_id = w.series_id AND a.k = win_idx + 5 JOIN n b ON b.series_id = w.series_id AND b.k = win_idx + 10""")
def multi_horizon_windows(spark, sf_dir):
    return _flat(S.supervised_windows(returns_of(spark, sf_dir), "ret", 5, [1, 6]), "y_1", "y_6")


@query(f"{RET}, {_WIN.format(12)} SELECT series_id, win_idx, pos::INT AS pos, {R6.format('x')} AS x FROM w WHERE win_idx % 6 = 0")
def strided_windows(spark, sf_dir):
    return _flat(S.strided_windows(returns_of(spark, sf_dir), "ret", 12))


@query(f"{RET}, {_WIN.format(20)}, c AS (SELECT series_id, win_idx, seq AS last_seq, ts FROM (SELECT DISTINCT series_id, win_idx FROM w) q JOIN n USING (series_id) WHERE n.k = win_idx + 19) SELECT series_id, win_idx, last_seq, {_CYCLE} FROM c")
def training_windows(spark, sf_dir):
    r = returns_of(spark, sf_dir)
    w = S.sliding_windows(r, "ret", 20, carry=["ts"])
    return rounded(w.select("series_id", "win_idx", "last_seq", *(c.alias(k) for k, c in C.cyclic_time(F.col("ts")).items())))


@query(f"{RET} SELECT series_id, seq, {R6.format('stddev_samp(ret) OVER (PARTITION BY series_id ORDER BY seq ROWS 23 PRECEDING)')} AS vol FROM ret")
def rolling_vol(spark, sf_dir):
    return rounded(returns_of(spark, sf_dir).select("series_id", "seq", S.rolling_std("ret", 24).alias("vol")))


_FILL = """
r{0} AS (SELECT *, CASE WHEN count(*) OVER f >= {1} THEN stddev_samp(ret) OVER f END AS raw{0} FROM {2} WINDOW f AS (PARTITION BY series_id ORDER BY seq ROWS {3} PRECEDING)),
v{0} AS (SELECT *, first_value(raw{0} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s{0} FROM r{0})"""


@query(f"{RET}, {_FILL.format('m', 6, 'ret', 23)}, {_FILL.format('s', 3, 'vm', 5)}, {_FILL.format('l', 12, 'vs', 47)} SELECT series_id, seq, {R6.format('sm')} AS vol, {R6.format('ss / greatest(sl, 1e-10)')} AS vol_ratio FROM vl")
def rolling_vol_bfill(spark, sf_dir):
    return rounded(S.hybrid_features(src.all_series(spark, sf_dir)).select("series_id", "seq", "vol", "vol_ratio"))


_FEAT = """
f0 AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY series_id ORDER BY seq ROWS 23 PRECEDING) AS vol, stddev_samp(ret) OVER (PARTITION BY series_id ORDER BY seq ROWS 71 PRECEDING) AS long FROM ret),
feat AS (SELECT series_id, seq, ret, vol, CASE WHEN long > 1e-10 THEN vol / long ELSE 1.0 END AS vol_ratio FROM f0 WHERE vol IS NOT NULL),
lab AS (SELECT *, ntile(3) OVER (PARTITION BY series_id ORDER BY vol, seq) - 1 AS regime FROM feat)"""


@query(f"{RET}, {_FEAT} SELECT series_id, seq, {R6.format('ret')} AS ret, {R6.format('vol')} AS vol, {R6.format('vol_ratio')} AS vol_ratio FROM feat")
def regime_features(spark, sf_dir):
    return rounded(S.regime_features(src.all_series(spark, sf_dir)).select("series_id", "seq", "ret", "vol", "vol_ratio"))


def _labelled(spark, sf_dir):
    f = S.regime_features(src.all_series(spark, sf_dir))
    return f.withColumn("regime", F.ntile(3).over(Window.partitionBy("series_id").orderBy("vol", "seq")) - 1)


@query(f"""{RET}, {_FEAT},
c AS (SELECT *, coalesce((lag(regime) OVER (PARTITION BY series_id ORDER BY seq) <> regime)::INT, 0) AS ch FROM lab),
g AS (SELECT *, sum(ch) OVER (PARTITION BY series_id ORDER BY seq)::BIGINT AS run_id FROM c)
SELECT series_id, regime::INT AS regime, run_id, count(*) AS n, min(seq) AS start, {R6.format('sum(ret)')} AS total FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def regime_runs(spark, sf_dir):
    b = S.regime_blocks(_labelled(spark, sf_dir), "regime")
    return rounded(b.select("series_id", "regime", "run_id", "n", "start", F.aggregate("rets", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query(f"""{RET}, {_FEAT}, l AS (SELECT *, lag(ret) OVER (PARTITION BY series_id, regime ORDER BY seq) AS prev FROM lab)
SELECT series_id, regime::INT AS regime, count(*) AS n, {R6.format('avg(ret)')} AS mean, {R6.format('stddev_pop(ret)')} AS std, {R6.format('coalesce(corr(prev, ret), 0)')} AS ar1, {R6.format('avg(vol)')} AS vol_mean,
{R6.format('(avg(ret**3) - 3 * avg(ret) * avg(ret**2) + 2 * avg(ret)**3) / stddev_pop(ret)**3')} AS skew FROM l GROUP BY 1, 2""")
def regime_stats(spark, sf_dir):
    return rounded(regimes.regime_stats(_labelled(spark, sf_dir)).select("series_id", "regime", "n", "mean", "std", "ar1", "vol_mean", "skew"))


@query(f"{RET}, n AS (SELECT series_id, seq, row_number() OVER (PARTITION BY series_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY series_id) AS total FROM ret) SELECT series_id, seq, k > total - greatest(1, floor(total * 0.15::DOUBLE)) AS is_val FROM n")
def holdout(spark, sf_dir):
    return S.holdout(returns_of(spark, sf_dir)).select("series_id", "seq", "is_val")


# Statistics


@query(f"""{RET}, m AS (SELECT series_id, count(*) AS n, avg(ret) AS mean, stddev_pop(ret) AS std, min(ret) AS lo, max(ret) AS hi, skewness(ret) AS skew_unbiased, kurtosis_pop(ret) + 3 AS kurt FROM ret GROUP BY 1)
SELECT series_id, n, {R6.format('mean')} AS mean, {R6.format('std')} AS std, {R6.format('lo')} AS lo, {R6.format('hi')} AS hi, {R6.format('skew_unbiased * (n - 2) / sqrt(n * (n - 1))')} AS skew, {R6.format('skew_unbiased')} AS skew_unbiased, {R6.format('kurt')} AS kurt FROM m""")
def moments(spark, sf_dir):
    return rounded(T.moments(returns_of(spark, sf_dir)))


_LAGS = "l AS (SELECT *, " + ", ".join(f"lag(ret, {k}) OVER (PARTITION BY series_id ORDER BY seq) AS p{k}, lag(abs(ret), {k}) OVER (PARTITION BY series_id ORDER BY seq) AS a{k}" for k in (1, 5, 10, 24)) + ", lead(abs(ret)) OVER (PARTITION BY series_id ORDER BY seq) AS nx FROM ret)"


@query(f"{RET}, {_LAGS} SELECT series_id, " + ", ".join(f"{R6.format(f'corr(p{k}, ret)')} AS ac_lag{k}" for k in (1, 5, 10, 24)) + " FROM l GROUP BY 1")
def autocorr(spark, sf_dir):
    return rounded(T.autocorrelation(returns_of(spark, sf_dir), (1, 5, 10, 24)))


@query(f"{RET}, {_LAGS} SELECT series_id, {R6.format('corr(a1, abs(ret))')} AS vc_lag1 FROM l GROUP BY 1")
def vol_clustering(spark, sf_dir):
    return rounded(T.autocorrelation(returns_of(spark, sf_dir), (1,), absolute=True, prefix="vc"))


@query(f"{RET}, {_LAGS} SELECT series_id, {R6.format('corr(ret, nx)')} AS leverage FROM l GROUP BY 1")
def leverage(spark, sf_dir):
    return rounded(T.leverage(returns_of(spark, sf_dir)))


_HIST = """
b{0} AS (SELECT series_id, side, ret, min(ret) OVER (PARTITION BY series_id) AS lo, max(ret) OVER (PARTITION BY series_id) AS hi FROM pret),
h{0} AS (SELECT series_id, side, least(floor((ret - lo) / (hi - lo) * {0}), {0} - 1)::INT AS bin, count(*) AS n, any_value(hi - lo) AS span FROM b{0} GROUP BY 1, 2, 3),
d{0} AS (SELECT *, n / sum(n) OVER (PARTITION BY series_id, side) / (span / {0}) AS density FROM h{0})"""
_JS = """
g{0} AS (SELECT s.series_id, x.bin, coalesce(p.density, 0) + 1e-10 AS p, coalesce(q.density, 0) + 1e-10 AS q FROM (SELECT DISTINCT series_id FROM pret) s CROSS JOIN (SELECT unnest(range({0})) AS bin) x
  LEFT JOIN d{0} p ON p.series_id = s.series_id AND p.bin = x.bin AND p.side = 'real' LEFT JOIN d{0} q ON q.series_id = s.series_id AND q.bin = x.bin AND q.side = 'synth'),
z{0} AS (SELECT series_id, p / sum(p) OVER (PARTITION BY series_id) AS p, q / sum(q) OVER (PARTITION BY series_id) AS q FROM g{0}),
js{0} AS (SELECT series_id, greatest(0, sum((p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2)) AS js FROM z{0} GROUP BY 1)"""


@query(f"{PAIR}, {_HIST.format(99)} SELECT series_id, side, bin, n, {R6.format('density')} AS density FROM d99")
def histogram(spark, sf_dir):
    return rounded(T.histogram(pair_returns(spark, sf_dir), 99))


@query(f"{PAIR}, {_HIST.format(100)}, {_JS.format(100)} SELECT series_id, {R6.format('js')} AS js FROM js100")
def js_divergence(spark, sf_dir):
    return rounded(T.js_divergence(pair_returns(spark, sf_dir), 100).select("series_id", "js"))


@query(f"{PAIR}, {_HIST.format(99)}, {_JS.format(99)} SELECT series_id, {R6.format('sqrt(js)')} AS js_distance FROM js99")
def js_distance(spark, sf_dir):
    return rounded(T.js_divergence(pair_returns(spark, sf_dir), 99).select("series_id", "js_distance"))


_ECDF = """
ev AS (SELECT series_id, ret, count(*) FILTER (side = 'real') AS a, count(*) FILTER (side = 'synth') AS b FROM pret GROUP BY 1, 2),
ec AS (SELECT series_id, abs(sum(a) OVER w / sum(a) OVER t - sum(b) OVER w / sum(b) OVER t) AS gap, lead(ret) OVER w - ret AS step FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY ret), t AS (PARTITION BY series_id)),
dist AS (SELECT series_id, sum(gap * step) AS wasserstein, max(gap) AS ks FROM ec GROUP BY 1)"""


@query(f"{PAIR}, {_ECDF} SELECT series_id, {R6.format('wasserstein')} AS wasserstein FROM dist")
def wasserstein(spark, sf_dir):
    return rounded(T.distances(pair_returns(spark, sf_dir)).select("series_id", "wasserstein"))


@query(f"{PAIR}, {_ECDF} SELECT series_id, {R6.format('ks')} AS ks FROM dist")
def ks_stat(spark, sf_dir):
    return rounded(T.distances(pair_returns(spark, sf_dir)).select("series_id", "ks"))


_HURST = """
hn AS (SELECT {1}, typical_price, row_number() OVER (PARTITION BY {1} ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY {1}) AS n FROM {0}),
hl AS (SELECT *, unnest(range(2, least(100, n // 4))) AS lag FROM hn),
hs AS (SELECT *, i // lag AS seg, i % lag AS pos FROM hl WHERE (i // lag) * lag < n - lag),
hd AS (SELECT *, typical_price - lag(typical_price) OVER (PARTITION BY {1}, lag, seg ORDER BY pos) AS d FROM hs),
hc AS (SELECT *, sum(d) OVER (PARTITION BY {1}, lag, seg ORDER BY pos) - pos * avg(d) OVER (PARTITION BY {1}, lag, seg) AS c FROM hd WHERE d IS NOT NULL),
hr AS (SELECT {1}, lag, (max(c) - min(c)) AS r, stddev_pop(d) AS s FROM hc GROUP BY {1}, lag, seg HAVING stddev_pop(d) > 0),
hm AS (SELECT {1}, lag, avg(r / s) AS rs FROM hr GROUP BY {1}, lag),
hx AS (SELECT *, row_number() OVER (PARTITION BY {1} ORDER BY lag) + 1 AS x FROM hm),
hurst AS (SELECT {1}, CASE WHEN count(*) < 3 THEN 0.5 ELSE greatest(0, least(1, regr_slope(ln(rs), ln(x)))) END AS hurst FROM hx GROUP BY {1})"""


@query(f"{PX}, {_HURST.format('px', 'series_id')} SELECT series_id, {R6.format('hurst')} AS hurst FROM hurst")
def hurst(spark, sf_dir):
    return rounded(T.hurst(src.all_series(spark, sf_dir)))


_SPECTRUM = """
sn AS (SELECT *, row_number() OVER (PARTITION BY series_id, side ORDER BY seq) - 1 AS t, count(*) OVER (PARTITION BY series_id, side) AS c FROM pret),
sm AS (SELECT series_id, min(c) AS n FROM sn GROUP BY 1),
sx AS (SELECT sn.series_id, side, t, ret, n FROM sn JOIN sm USING (series_id) WHERE t < n),
sf AS (SELECT a.series_id, a.side, k.f, any_value(a.n) AS n, sum(ret * cos(2 * pi() * ((k.f * t) % a.n) / a.n)) AS re, sum(ret * sin(2 * pi() * ((k.f * t) % a.n) / a.n)) AS im
  FROM sx a JOIN (SELECT series_id, unnest(range(n)) AS f FROM sm) k USING (series_id) GROUP BY 1, 2, 3),
sp AS (SELECT series_id, side, f, n, (re * re + im * im) / (sum(re * re + im * im) OVER (PARTITION BY series_id, side) + 1e-20) AS p FROM sf),
spec AS (SELECT a.series_id, sqrt(avg((a.p - b.p) ** 2)) AS spectral FROM sp a JOIN sp b ON a.series_id = b.series_id AND a.f = b.f AND a.side = 'real' AND b.side = 'synth' GROUP BY 1)"""


@query(f"{PAIR}, {_SPECTRUM} SELECT series_id, {R6.format('spectral')} AS spectral FROM spec")
def spectral_distance(spark, sf_dir):
    return rounded(T.spectral_distance(pair_returns(spark, sf_dir)))


@query(f"""{PAIR},
mn AS (SELECT *, row_number() OVER (PARTITION BY series_id, side ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY series_id, side) AS c FROM pret),
mw AS (SELECT a.series_id, a.side, a.k AS w, b.k - a.k AS pos, b.ret AS x FROM mn a JOIN mn b ON a.series_id = b.series_id AND a.side = b.side AND b.k BETWEEN a.k AND a.k + 9 WHERE a.k + 10 <= a.c),
md AS (SELECT a.series_id, a.side AS s, b.side AS t, a.w AS v, b.w AS w, sum((a.x - b.x) ** 2) AS d FROM mw a JOIN mw b ON a.series_id = b.series_id AND a.pos = b.pos WHERE a.side = 'real' OR b.side = 'synth' GROUP BY ALL),
mg AS (SELECT series_id, 1 / (avg(d) + 1e-8) AS gamma FROM md WHERE s = 'real' AND t = 'real' GROUP BY 1),
mk AS (SELECT series_id, s, t, avg(exp(-gamma * d)) AS k FROM md JOIN mg USING (series_id) GROUP BY 1, 2, 3)
SELECT series_id, {R6.format("sum(CASE WHEN s = t THEN k ELSE -2 * k END)")} AS mmd FROM mk GROUP BY 1""")
def mmd(spark, sf_dir):
    return rounded(T.mmd(pair_returns(spark, sf_dir)))


@query(f"{PX}, d AS (SELECT series_id, typical_price / max(typical_price) OVER (PARTITION BY series_id ORDER BY seq) - 1 AS dd FROM px) SELECT series_id, {R6.format('min(dd)')} AS max_drawdown FROM d GROUP BY 1")
def max_drawdown(spark, sf_dir):
    return rounded(T.max_drawdown(src.all_series(spark, sf_dir)))


_SIDED = """
sl AS (SELECT *, {0}, lag(abs(ret)) OVER (PARTITION BY series_id, side ORDER BY seq) AS a1, lead(abs(ret)) OVER (PARTITION BY series_id, side ORDER BY seq) AS nx FROM pret),
sm0 AS (SELECT series_id, side, count(*) AS n, avg(ret) AS mean, stddev_pop(ret) AS std, skewness(ret) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) AS skew, kurtosis_pop(ret) + 3 AS kurt, {1}, corr(a1, abs(ret)) AS vc, corr(ret, nx) AS lev FROM sl GROUP BY 1, 2),
one AS (SELECT r.series_id, {2} FROM sm0 r JOIN sm0 s ON r.series_id = s.series_id AND r.side = 'real' AND s.side = 'synth')""".format(
    ", ".join(f"lag(ret, {k}) OVER (PARTITION BY series_id, side ORDER BY seq) AS p{k}" for k in (1, 5, 10, 24)),
    ", ".join(f"corr(p{k}, ret) AS ac{k}" for k in (1, 5, 10, 24)),
    ", ".join(f"{t}.{c} AS {t}_{c}" for t in "rs" for c in ("n", "mean", "std", "skew", "kurt", "ac1", "ac5", "ac10", "ac24", "vc", "lev")),
)
_REPORT = f"{PAIR}, {_HIST.format(100)}, {_JS.format(100)}, {_ECDF}, {_SIDED}"


@query(f"""{_REPORT} SELECT series_id, {R6.format('js')} AS kl_divergence, {R6.format('wasserstein')} AS wasserstein_distance, """ + ", ".join(f"{R6.format(f'{t}_mean')} AS {n}_return_mean, {R6.format(f'{t}_std')} AS {n}_return_std, " + ", ".join(f"{R6.format(f'{t}_ac{k}')} AS {n}_autocorr_lag{k}" for k in (1, 5, 10)) for t, n in (("r", "real"), ("s", "synthetic"))) + f""", {R6.format('js + 0.1::DOUBLE * wasserstein + abs(r_std - s_std)')} AS quality_score FROM one JOIN js100 USING (series_id) JOIN dist USING (series_id)""")
def distribution_report(spark, sf_dir):
    return rounded(T.distribution_report(pair_of(spark, sf_dir)))


@query(f"{_REPORT} SELECT series_id, {R6.format('js + 0.1::DOUBLE * wasserstein + abs(r_std - s_std)')} AS quality_score FROM one JOIN js100 USING (series_id) JOIN dist USING (series_id)")
def quality_score(spark, sf_dir):
    return rounded(T.distribution_report(pair_of(spark, sf_dir)).select("series_id", "quality_score"))


def _g(a: str, b: str, guard: str = "1e-6") -> str:
    return f"CASE WHEN abs({b}) > {guard} THEN {a} / {b} ELSE 0 END"


_RECORD = f"""{PAIR}, {_HIST.format(99)}, {_JS.format(99)}, {_ECDF}, {_SIDED}, {_HURST.format('pair', 'series_id, side')}, {_SPECTRUM},
dd0 AS (SELECT series_id, side, typical_price, typical_price / max(typical_price) OVER (PARTITION BY series_id, side ORDER BY seq) - 1 AS dd FROM pair),
dd AS (SELECT series_id, side, min(dd) AS dd, max(typical_price) - min(typical_price) AS span FROM dd0 GROUP BY 1, 2),
two AS (SELECT r.series_id, r.dd AS r_dd, s.dd AS s_dd, r.span AS r_span, s.span AS s_span, hr.hurst AS r_hurst, hs.hurst AS s_hurst FROM dd r JOIN dd s ON r.series_id = s.series_id AND r.side = 'real' AND s.side = 'synth'
  JOIN hurst hr ON hr.series_id = r.series_id AND hr.side = 'real' JOIN hurst hs ON hs.series_id = r.series_id AND hs.side = 'synth'),
rec AS (SELECT *, sqrt(js) AS jsd FROM one JOIN two USING (series_id) JOIN js99 USING (series_id) JOIN dist USING (series_id) JOIN spec USING (series_id))"""
_FIELDS = {
    "mean_ratio": _g("s_mean", "r_mean", "1e-10"), "std_ratio": "s_std / r_std", "skew_real": "r_skew", "skew_synth": "s_skew", "skew_diff": "abs(s_skew - r_skew)", "kurt_real": "r_kurt", "kurt_synth": "s_kurt", "kurt_diff": "abs(s_kurt - r_kurt)",
    "ks_statistic": "ks", "ks_pvalue": "CASE WHEN ks * sqrt(r_n * s_n / (r_n + s_n)) < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum([(CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * ks * ks * r_n * s_n / (r_n + s_n)) for k in range(1, 101)]))) END", "js_divergence": "jsd", "wasserstein": "wasserstein", "ac_lag1_real": "r_ac1", "ac_lag1_synth": "s_ac1", **{f"ac_lag{k}_ratio": _g(f"s_ac{k}", f"r_ac{k}") for k in (1, 5, 10, 24)},
    "vol_cluster_real": "r_vc", "vol_cluster_synth": "s_vc", "vol_cluster_ratio": _g("s_vc", "r_vc"), "leverage_real": "r_lev", "leverage_synth": "s_lev", "hurst_real": "r_hurst", "hurst_synth": "s_hurst", "hurst_diff": "abs(s_hurst - r_hurst)",
    "max_dd_real": "r_dd", "max_dd_synth": "s_dd", "price_range_ratio": "s_span / r_span", "spectral_distance": "spectral",
}


@query(f"{_RECORD} SELECT series_id, " + ", ".join(f"{R6.format(e)} AS {k}" for k, e in _FIELDS.items()) + " FROM rec")
def metric_record(spark, sf_dir):
    return rounded(T.metric_record(pair_of(spark, sf_dir)).select("series_id", *_FIELDS), 6)


def _dev(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) > 1e-6 THEN abs({a} / {b} - 1) ELSE abs({a}) END"


_TERMS = {
    "js_divergence": "jsd", "ks_statistic": "ks", "ac_lag1": _dev("s_ac1", "r_ac1"), "ac_lag5": _dev("s_ac5", "r_ac5"), "ac_lag24": _dev("s_ac24", "r_ac24"), "hurst_diff": "abs(s_hurst - r_hurst)",
    "vol_cluster": _dev("s_vc", "r_vc"), "spectral": "spectral", "skew_diff": "abs(s_skew - r_skew)", "kurt_diff": "abs(s_kurt - r_kurt) / greatest(r_kurt, 1)", "std_ratio": "abs(s_std / r_std - 1)",
}


@query(f"{_RECORD} SELECT series_id, " + ", ".join(f"{R6.format(e)} AS {k}" for k, e in _TERMS.items()) + ", " + R6.format("(" + " + ".join(f"{T.COMPOSITE[k]}::DOUBLE * ({e})" for k, e in _TERMS.items()) + f") / {sum(T.COMPOSITE.values())}::DOUBLE") + " AS score FROM rec")
def composite_score(spark, sf_dir):
    return rounded(T.composite(T.metric_record(pair_of(spark, sf_dir))))


_SWEEP = {"std_ratio": "abs(s_std / r_std - 1)", "ac1_ratio": f"abs({_g('s_ac1', 'r_ac1')} - 1)", "ac5_ratio": f"abs({_g('s_ac5', 'r_ac5')} - 1)", "js": "jsd", "wass": "wasserstein", "ks": "ks", "vc_ratio": f"abs({_g('s_vc', 'r_vc')} - 1)", "hurst_diff": "abs(s_hurst - r_hurst)"}


@query(f"{_RECORD} SELECT series_id, " + R6.format(" + ".join(f"{T.SWEEP[k]}::DOUBLE * ({e})" for k, e in _SWEEP.items())) + " AS score FROM rec")
def sweep_score(spark, sf_dir):
    return rounded(T.sweep_score(T.metric_record(pair_of(spark, sf_dir), with_spectrum=False)))


@query()
def adf_pvalue(spark, sf_dir):
    return T.adf(returns_of(spark, sf_dir))


# Graph

_STATES = """
qe AS (SELECT series_id, list_sort(list_distinct(quantile_cont(ret, [{0}]))) AS edges FROM ret GROUP BY 1),
st AS (SELECT r.series_id, seq, ret, len(list_filter(edges[2:len(edges) - 1], lambda e: ret >= e)) AS state, len(edges) - 1 AS n_states FROM ret r JOIN qe USING (series_id))""".format(", ".join(f"{k / 20!r}::DOUBLE" for k in range(21)))
_EDGES = """
sp0 AS (SELECT series_id, state AS src, lead(state) OVER (PARTITION BY series_id ORDER BY seq) AS dst FROM st),
ed AS (SELECT series_id, src, dst, count(*) AS cnt FROM sp0 WHERE dst IS NOT NULL GROUP BY 1, 2, 3)"""


def _states(spark, sf_dir):
    return graph.quantile_states(returns_of(spark, sf_dir), 20)


@query(f"{RET}, {_STATES} SELECT series_id, seq, state::INT AS state, n_states::INT AS n_states FROM st")
def quantile_states(spark, sf_dir):
    return _states(spark, sf_dir).select("series_id", "seq", "state", "n_states")


@query(f"{RET}, {_STATES}, {_EDGES} SELECT series_id, src::INT AS src, dst::INT AS dst, cnt, {R6.format('cnt / sum(cnt) OVER (PARTITION BY series_id, src)')} AS p FROM ed")
def transition_matrix(spark, sf_dir):
    return rounded(graph.transitions(_states(spark, sf_dir)))


@query(f"""{RET}, {_STATES}, {_EDGES}, tops AS (SELECT series_id, max(state) AS top FROM st GROUP BY 1),
dense AS (SELECT series_id, src, unnest(range(top + 1)) AS dst FROM (SELECT series_id, top, unnest(range(top + 1)) AS src FROM tops))
SELECT series_id, src::INT AS src, dst::INT AS dst, coalesce(cnt, 0) AS cnt, {R6.format('(coalesce(cnt, 0) + 0.01::DOUBLE) / sum(coalesce(cnt, 0) + 0.01::DOUBLE) OVER (PARTITION BY series_id, src)')} AS p FROM dense LEFT JOIN ed USING (series_id, src, dst)""")
def transition_smoothed(spark, sf_dir):
    return rounded(graph.smoothed_transitions(_states(spark, sf_dir)))


@query(f"{RET}, {_STATES} SELECT series_id, state::INT AS state, count(*) AS n, {R6.format('count(*) / sum(count(*)) OVER (PARTITION BY series_id)')} AS freq FROM st GROUP BY 1, 2")
def state_freq(spark, sf_dir):
    return rounded(graph.frequencies(_states(spark, sf_dir)))


@query(f"{RET}, {_STATES}, {_EDGES}, ks AS (SELECT series_id, max(n_states) AS k FROM st GROUP BY 1) SELECT series_id, count(*) AS edges, any_value(k)::INT AS k, {R6.format('count(*) / (any_value(k) * any_value(k))')} AS density FROM ed JOIN ks USING (series_id) GROUP BY 1")
def transition_density(spark, sf_dir):
    return rounded(graph.density(_states(spark, sf_dir)))


# Set operations

_SPLIT = f"{PX}, s AS (SELECT *, ntile(6) OVER (PARTITION BY series_id ORDER BY seq) AS split FROM px)"


@query(f"""{_SPLIT}, u AS (SELECT 0 AS o, * FROM s WHERE split = 1 UNION ALL SELECT 1, * FROM s WHERE split = 4)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY o, seq) - 1 AS seq, o::INT AS side_ord, round(typical_price, 6) AS typical_price FROM u""")
def prepend_synthetic(spark, sf_dir):
    px = src.with_split(src.all_series(spark, sf_dir))
    return rounded(S.prepend(px.where("split = 1"), px.where("split = 4")).select("series_id", "seq", "side_ord", "typical_price"))


@query(f"""{_SPLIT}, u AS (SELECT 0 AS o, series_id, ts, typical_price AS p FROM s WHERE split <= 3 UNION ALL SELECT 1, series_id, ts, -1.0 FROM s WHERE split BETWEEN 3 AND 4),
k AS (SELECT series_id, ts, arg_min(p, o) AS p FROM u GROUP BY 1, 2)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS seq, ts, round(p, 6) AS typical_price FROM k""")
def augment_train(spark, sf_dir):
    px = src.with_split(src.all_series(spark, sf_dir)).select("series_id", "seq", "ts", "typical_price", "split")
    fake = px.where("split between 3 and 4").withColumn("typical_price", F.lit(-1.0))
    return rounded(S.augment(px.where("split <= 3").drop("split"), fake.drop("split")).select("series_id", "seq", "ts", "typical_price"))


# Generators with relational forms

_DRAW = "('0x' || substr(md5({0}), 1, 8))::UBIGINT::BIGINT"
_BOOT = f"""
bn AS (SELECT series_id, count(*) AS n, count(*) - 30 AS mx FROM px GROUP BY 1 HAVING count(*) - 30 >= 1),
bd AS (SELECT series_id, s AS seed, b AS block, {_DRAW.format("s || ':' || b")} % mx AS st FROM bn, (SELECT unnest(range(42, 45)) AS s), (SELECT unnest(range(7)) AS b)),
bp AS (SELECT d.*, o AS pos, ln(p.typical_price) AS l FROM bd d, (SELECT unnest(range(30)) AS o) JOIN px p ON p.series_id = d.series_id AND p.seq = d.st + o),
be AS (SELECT series_id, seed, block, max(CASE WHEN pos = 0 THEN l END) AS a, max(CASE WHEN pos = 29 THEN l END) AS b FROM bp GROUP BY 1, 2, 3),
bc AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY series_id, seed ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + first_value(a) OVER (PARTITION BY series_id, seed ORDER BY block) AS base FROM be),
boot AS (SELECT series_id, seed, block * 30 + pos AS seq, exp(base + l - a) AS typical_price FROM bp JOIN bc USING (series_id, seed, block) WHERE block * 30 + pos < 200)"""


@query(f"{PX}, {_BOOT} SELECT series_id, seed, seq, round(typical_price, 4) AS typical_price FROM boot")
def block_bootstrap(spark, sf_dir):
    return rounded(G.block_bootstrap(src.all_series(spark, sf_dir), 200, n_seeds=3), 4)


@query(f"""RECURSIVE {RET}, {_STATES}, {_EDGES},
fr AS (SELECT series_id, state, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS f FROM st GROUP BY 1, 2),
ft AS (SELECT series_id, list(state ORDER BY state) AS dsts, list(cum ORDER BY state) AS cums FROM (SELECT *, sum(f) OVER (PARTITION BY series_id ORDER BY state) AS cum FROM fr) GROUP BY 1),
ep AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY series_id, src) AS p FROM ed),
et AS (SELECT series_id, src, list(dst ORDER BY dst) AS dsts, list(cum ORDER BY dst) AS cums FROM (SELECT *, sum(p) OVER (PARTITION BY series_id, src ORDER BY dst) AS cum FROM ep) GROUP BY 1, 2),
walk AS (
  SELECT series_id, s AS seed, 0 AS step, dsts[least(len(list_filter(cums, lambda c: c <= {_DRAW.format("s || ':walk:0'")} / 4294967296.0::DOUBLE * cums[-1])) + 1, len(cums))] AS state FROM ft, (SELECT unnest(range(42, 44)) AS s)
  UNION ALL
  SELECT w.series_id, w.seed, w.step + 1, coalesce(e.dsts, f.dsts)[least(len(list_filter(coalesce(e.cums, f.cums), lambda c: c <= {_DRAW.format("w.seed || ':walk:' || (w.step + 1)")} / 4294967296.0::DOUBLE * coalesce(e.cums, f.cums)[-1])) + 1, len(coalesce(e.cums, f.cums)))]
  FROM walk w JOIN ft f ON f.series_id = w.series_id LEFT JOIN et e ON e.series_id = w.series_id AND e.src = w.state WHERE w.step < 59),
pool AS (SELECT series_id, state, ret, row_number() OVER (PARTITION BY series_id, state ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY series_id, state) AS n FROM st)
SELECT w.series_id, seed, step::INT AS step, w.state::INT AS state, {R6.format('ret')} AS ret FROM walk w JOIN pool p ON p.series_id = w.series_id AND p.state = w.state AND p.k = {_DRAW.format("seed || ':value:' || step")} % p.n""".replace("RECURSIVE ", "WITH RECURSIVE ", 1))
def markov_walk(spark, sf_dir):
    return rounded(G.markov_walk(_states(spark, sf_dir), 60, n_seeds=2))


@query(f"""RECURSIVE {RET},
gx AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY seq) AS t, ret - avg(ret) OVER (PARTITION BY series_id) AS x, var_pop(ret) OVER (PARTITION BY series_id) AS v FROM ret),
gg AS (SELECT a, b FROM (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in regimes.ALPHAS)}]) AS a), (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in regimes.BETAS)}]) AS b) WHERE a + b < 0.999::DOUBLE),
gr AS (
  SELECT series_id, a, b, v * (1 - a - b) AS omega, 1::BIGINT AS t, v AS s2, x, -0.5::DOUBLE * (ln(v) + x * x / v) AS ll FROM gx, gg WHERE t = 1
  UNION ALL
  SELECT series_id, a, b, omega, t, s2, x, ll - 0.5::DOUBLE * (ln(s2) + x * x / s2) FROM (
    SELECT r.series_id, a, b, omega, g.t, greatest(omega + a * r.x * r.x + b * r.s2, 1e-20) AS s2, g.x, ll FROM gr r JOIN gx g ON g.series_id = r.series_id AND g.t = r.t + 1)),
gl AS (SELECT *, row_number() OVER (PARTITION BY series_id, a, b ORDER BY t DESC) AS k FROM gr)
SELECT series_id, a AS alpha, b AS beta, {R6.format('omega')} AS omega, round(ll, 3) AS ll FROM gl WHERE k = 1""".replace("RECURSIVE ", "WITH RECURSIVE ", 1))
def garch_grid(spark, sf_dir):
    g = regimes.garch_grid(returns_of(spark, sf_dir))
    return rounded(g.withColumn("ll", F.round("ll", 3)))


_GARCH = ORACLE["garch_grid"].rsplit("\nSELECT", 1)[0]
_OMEGA = "CASE WHEN n < 10 THEN var ELSE coalesce(omega, var * 0.05::DOUBLE) END"
_LONG = f"CASE WHEN n < 10 THEN var ELSE ({_OMEGA}) / greatest(1 - coalesce(a, 0.05::DOUBLE) - coalesce(b, 0.9::DOUBLE), 0.001::DOUBLE) END"


@query(f"""{_GARCH},
best AS (SELECT series_id, a, b, omega FROM gl WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ll DESC, a, b) = 1),
size AS (SELECT series_id, count(*) AS n, var_pop(ret) AS var FROM ret GROUP BY 1)
SELECT series_id, n, {R6.format('var')} AS var, CASE WHEN n < 10 THEN 0.05::DOUBLE ELSE coalesce(a, 0.05::DOUBLE) END AS alpha, CASE WHEN n < 10 THEN 0.9::DOUBLE ELSE coalesce(b, 0.9::DOUBLE) END AS beta,
{R6.format(_OMEGA)} AS omega, {R6.format(_LONG)} AS long_run_var FROM size LEFT JOIN best USING (series_id)""")
def garch_fit(spark, sf_dir):
    return rounded(regimes.garch_fit(returns_of(spark, sf_dir)))


@query(f"""g AS (SELECT unnest(range(1000)) AS i), d AS (SELECT i, {_DRAW.format("'7:n:' || i || ':a'")} AS a, {_DRAW.format("'7:n:' || i || ':b'")} AS b, {_DRAW.format("'7:i:' || i")} % 150 AS k, {_DRAW.format("'7:r:' || i")} / 4294967296.0::DOUBLE AS u FROM g)
SELECT i AS seq, k AS index, {R6.format('sqrt(-2 * ln((a + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) * cos(2 * pi() * b / 4294967296.0::DOUBLE)')} AS normal, round(10 ** (-5 + u * 3), 8) AS rate FROM d""")
def draws(spark, sf_dir):
    i, seed = F.col("id"), F.lit(7)
    rate = C.log_uniform(1e-5, 1e-2, C.uniform(seed, F.lit("r"), i))
    return spark.range(1000).select(i.alias("seq"), C.uniform_index(F.lit(150), seed, F.lit("i"), i).alias("index"), (F.round(C.normal(seed, F.lit("n"), i), 6) + 0.0).alias("normal"), F.round(rate, 8).alias("rate"))


@query(f"{RET}, b AS (SELECT series_id, seq // 10 AS block, seq % 10 AS pos, ret FROM ret), l AS (SELECT *, lag(ret) OVER (PARTITION BY series_id ORDER BY block, pos) AS prev FROM b) SELECT series_id, block, pos, {R6.format('CASE WHEN pos = 0 AND prev IS NOT NULL THEN 0.7::DOUBLE * ret + 0.3::DOUBLE * prev ELSE ret END')} AS ret FROM l WHERE block > 0 OR pos > 0")
def smoothed_blocks(spark, sf_dir):
    r = returns_of(spark, sf_dir)
    b = r.select("series_id", F.floor(F.col("seq") / 10).alias("block"), (F.col("seq") % 10).alias("pos"), "ret")
    return rounded(S.smooth_boundaries(b, 0.3))


# Comparisons and sweeps

_RUNS = f"{RET}, runs AS (SELECT series_id AS protocol, seq % 10 AS seed, avg(abs(ret)) AS val_mae, stddev_pop(ret) AS test_mae FROM ret GROUP BY 1, 2)"


def _runs(spark, sf_dir):
    return returns_of(spark, sf_dir).groupBy(F.col("series_id").alias("protocol"), (F.col("seq") % 10).alias("seed")).agg(F.avg(F.abs("ret")).alias("val_mae"), F.stddev_pop("ret").alias("test_mae"))


@query(f"""{_RUNS}, m AS (SELECT protocol, avg(val_mae) AS mean, stddev_pop(val_mae) AS std, min(val_mae) AS lo, max(val_mae) AS hi, count(*) AS n FROM runs GROUP BY 1),
d AS (SELECT m.*, (SELECT max(abs(r.val_mae - m.mean) / m.mean) FROM runs r WHERE r.protocol = m.protocol) AS max_dev FROM m)
SELECT protocol, {', '.join(f"{R6.format(c)} AS {c}" for c in ('mean', 'std', 'lo', 'hi', 'max_dev'))}, n, {R6.format('least(2 * max_dev, 0.5::DOUBLE)')} AS tol_double, {R6.format('greatest(3 * std / mean, max_dev) * 1.2::DOUBLE')} AS tol_sigma, {R6.format('max_dev * 1.2::DOUBLE')} AS tol_gap FROM d""")
def tolerance_summary(spark, sf_dir):
    return rounded(tolerance.summary(_runs(spark, sf_dir)))


@query(f"""{_RUNS}, r AS (SELECT protocol, avg(val_mae) AS v, avg(test_mae) AS t FROM runs WHERE seed = 0 GROUP BY 1),
g AS (SELECT protocol, abs(val_mae - v) / v AS vg, abs(test_mae - t) / t AS tg FROM runs JOIN r USING (protocol) WHERE seed > 0)
SELECT protocol, {R6.format('avg(vg)')} AS mean_val_gap, {R6.format('max(vg)')} AS max_val_gap, {R6.format('avg(tg)')} AS mean_test_gap, {R6.format('max(tg)')} AS max_test_gap, {R6.format('greatest(max(vg), max(tg)) * 1.2::DOUBLE')} AS tolerance FROM g GROUP BY 1""")
def tolerance_gap(spark, sf_dir):
    return rounded(tolerance.real_gap(_runs(spark, sf_dir).withColumn("real", F.col("seed") == 0)))


@query(f"""{RET}, l AS (SELECT series_id, seq % 6 + 1 AS horizon, ret AS y, coalesce(lag(ret) OVER (PARTITION BY series_id ORDER BY seq), 0) AS pred FROM ret)
SELECT horizon::INT AS horizon, {R6.format('avg(abs(pred - y))')} AS mae, count(*) AS n FROM l GROUP BY 1 UNION ALL SELECT NULL, {R6.format('avg(abs(pred - y))')}, count(*) FROM l""")
def horizon_errors(spark, sf_dir):
    r = returns_of(spark, sf_dir)
    pairs = r.select((F.col("seq") % 6 + 1).cast("int").alias("horizon"), F.col("ret").alias("y"), F.coalesce(F.lag("ret").over(S.ordered()), F.lit(0.0)).alias("pred"))
    return rounded(evaluate.horizon_errors(pairs))


def _list(values) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else f"{v}" for v in values) + "]"


_GRID = ", ".join(f"(SELECT unnest({_list(v)}) AS {k}, unnest(range({len(v)})) AS i{n})" for n, (k, v) in enumerate(search.HYBRID_GRID.items()))


@query(f"g AS (SELECT (i0 * 5 + i1) * 5 + i2 AS config_id, k::INT AS k, block::INT AS block, scale FROM {_GRID}) SELECT * FROM g")
def param_grid(spark, sf_dir):
    return search.param_grid(spark, search.HYBRID_GRID)


@query(f"g AS (SELECT (i0 * 5 + i1) * 5 + i2 AS config_id, k::INT AS k, block::INT AS block, scale FROM {_GRID}) SELECT config_id, k, block, scale, round(({_DRAW.format("'3:' || config_id")} / 4294967296.0::DOUBLE), 6) AS score FROM g ORDER BY score, config_id LIMIT 10")
def sweep_topk(spark, sf_dir):
    scored = search.param_grid(spark, search.HYBRID_GRID).withColumn("score", F.round(C.uniform(F.lit(3), F.col("config_id")), 6))
    return search.top(scored, 10)


_METRICS = _RECORD + ", metrics AS (SELECT split_part(series_id, ':', 1) AS generator, " + ", ".join(f"{e} AS {k}" for k, e in _FIELDS.items()) + " FROM rec)"
_SUMMARY = {"std_ratio": ("avg_std_ratio", 3), "ac_lag1_ratio": ("avg_ac1_ratio", 3), "ac_lag5_ratio": ("avg_ac5_ratio", 3), "js_divergence": ("avg_js_div", 4), "wasserstein": ("avg_wasserstein", 6), "ks_statistic": ("avg_ks_stat", 3), "skew_diff": ("avg_skew_diff", 3), "kurt_diff": ("avg_kurt_diff", 3), "vol_cluster_ratio": ("avg_vol_cluster_ratio", 3), "hurst_diff": ("avg_hurst_diff", 3), "spectral_distance": ("avg_spectral_dist", 6), "price_range_ratio": ("avg_price_range_ratio", 3)}
_RANKS = {"std_ratio": ("std_ratio", 3), "ac_lag1_ratio": ("ac1_ratio", 3), "js_divergence": ("js_div", 4), "wasserstein": ("wass", 6), "vol_cluster_ratio": ("vol_clust", 3), "hurst_diff": ("hurst_diff", 3), "spectral_distance": ("spectral", 6)}
SUMMARY_VIEW = "SELECT generator, COUNT(*) AS n_seeds, " + ", ".join(f"ROUND(AVG({c}), {d}) AS {a}" for c, (a, d) in _SUMMARY.items()) + " FROM metrics GROUP BY generator"
RANKING_VIEW = "SELECT generator, " + ", ".join(f"ROUND(AVG({c}), {d}) AS {a}" for c, (a, d) in _RANKS.items()) + " FROM metrics GROUP BY generator ORDER BY js_div ASC"


def _metrics(spark, sf_dir) -> None:
    record = T.metric_record(pair_of(spark, sf_dir))
    src.metrics_table(record.withColumn("generator", F.substring_index("series_id", ":", 1)))


@query(f"{_METRICS} {SUMMARY_VIEW}")
def generator_summary(spark, sf_dir):
    _metrics(spark, sf_dir)
    return spark.sql(SUMMARY_VIEW)


@query(f"{_METRICS} {RANKING_VIEW}")
def metric_rankings(spark, sf_dir):
    _metrics(spark, sf_dir)
    return spark.sql(RANKING_VIEW)


@query(f"{_METRICS} SELECT generator, " + ", ".join(f"{R6.format(f'avg({c})')} AS {c}" for c in ("std_ratio", "ac_lag1_ratio", "skew_real", "skew_synth", "kurt_real", "kurt_synth")) + " FROM metrics GROUP BY 1")
def seed_ratios(spark, sf_dir):
    record = T.metric_record(pair_of(spark, sf_dir), with_spectrum=False).withColumn("generator", F.substring_index("series_id", ":", 1))
    return rounded(tolerance.seed_ratios(record, ["generator"]))


# Fits, samplers and searches that SQL can't express


@query()
def hmm_regimes(spark, sf_dir):
    return regimes.hmm_regimes(S.regime_features(src.all_series(spark, sf_dir))).drop("model")


@query()
def regime_detect(spark, sf_dir):
    return regimes.detect_regimes(returns_of(spark, sf_dir))


def _sampled(kind: str, fit: dict | None = None, sample: dict | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return G.sample(G.fit(src.all_series(spark, sf_dir), kind, fit), 150, n_seeds=2, options=sample)

    return run


for _name, _args in {
    "hmm_ar_sample": ("hmm_ar", {"k": 3}), "hmm_garch_sample": ("hmm_garch", {"k": 3}), "hybrid_bootstrap": ("hybrid", {"k": 3}), "hybrid_crossfade": ("hybrid", {"k": 3}, {"stitch": "crossfade"}), "hybrid_bridge": ("hybrid", {"k": 3}, {"stitch": "bridge"}),
    "hybrid_segments": ("hybrid", {"k": 3}, {"stitch": "segments"}), "regime_gan_sample": ("regime_gan",), "vae_gan_sample": ("vae_gan",), "vae_sample": ("vae",), "gan_sample": ("gan",), "timegan_sample": ("timegan", {"epochs": 1}),
}.items():
    QUERIES[_name] = _sampled(*_args)


def _each_series(spark, sf_dir, run: Callable[[list[DataFrame]], DataFrame]) -> DataFrame:
    """run(parts d1 to d6) for every series, with its series_id; the ids alone come to the driver."""
    px, out = src.with_split(src.all_series(spark, sf_dir)), None
    for (name,) in sorted(px.select("series_id").distinct().collect()):
        own = px.where(F.col("series_id") == name)
        rows = run([own.where(f"split = {k}").select("series_id", "seq", "ts", "typical_price") for k in range(1, 7)])
        rows = rows.select(F.lit(name).alias("series_id"), *(c for c in rows.columns if c != "series_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


_WALK = ORACLE["markov_walk"].rsplit("\nSELECT", 1)[0]


@query(f"""{_WALK},
wr AS (SELECT w.series_id, seed, step, ret FROM walk w JOIN pool p ON p.series_id = w.series_id AND p.state = w.state AND p.k = {_DRAW.format("seed || ':value:' || step")} % p.n),
an AS (SELECT series_id, count(*) AS n FROM px GROUP BY 1),
a0 AS (SELECT s.series_id, seed, p.typical_price AS p0 FROM (SELECT DISTINCT series_id, seed FROM wr) s JOIN an USING (series_id) JOIN px p ON p.series_id = s.series_id AND p.seq = {_DRAW.format("seed || ':anchor'")} % n)
SELECT series_id, seed, 0::BIGINT AS seq, round(p0, 4) AS typical_price FROM a0
UNION ALL SELECT series_id, seed, step + 1, round(exp(ln(p0) + sum(ret) OVER (PARTITION BY series_id, seed ORDER BY step)), 4) FROM wr JOIN a0 USING (series_id, seed) WHERE step < 59""")
def walk_prices(spark, sf_dir):
    return rounded(G.walk_prices(G.markov_walk(_states(spark, sf_dir), 60, n_seeds=2), src.all_series(spark, sf_dir)), 4)


@query()
def predictive_report(spark, sf_dir):
    return _each_series(spark, sf_dir, lambda d: evaluate.predictive(d[3], d[4], d[5], d[2]))


@query()
def augmentation_report(spark, sf_dir):
    return _each_series(spark, sf_dir, lambda d: evaluate.augmentation(d[3], d[4], d[5], d[2]))


@query()
def random_sweep(spark, sf_dir):
    return _each_series(spark, sf_dir, lambda d: search.random_sweep(spark, d[0].unionByName(d[1]).unionByName(d[2]), d[4])).drop("wall_s")


@query()
def grid_sweep(spark, sf_dir):
    return _each_series(spark, sf_dir, lambda d: search.grid_sweep(spark, d[0].unionByName(d[1]), d[4])).drop("wall_s")


KINDS = {"HMM_GARCH": ("hmm_garch", {"k": 3}), "HMM_parametric": ("hmm_ar", {"k": 3}), "Block_bootstrap": ("block_bootstrap", {"block": 30}), "Hybrid": ("hybrid", {"k": 3})}


@query()
def generator_evaluation(spark, sf_dir):
    """Four generators fitted on d1 to d3 and scored against d5 with ten seeds, summarised for each series."""
    px = cut_table(src.with_split(src.all_series(spark, sf_dir)).select("series_id", "seq", "typical_price", "split"))
    src.metrics_table(search.generator_metrics(px.where("split <= 3"), px.where("split = 5"), KINDS), "generator_facts")
    return spark.sql(SUMMARY_VIEW.replace("SELECT generator", "SELECT series_id, generator").replace("FROM metrics GROUP BY generator", "FROM generator_facts GROUP BY series_id, generator"))


@query()
def ratio_sweep(spark, sf_dir):
    return _each_series(spark, sf_dir, lambda d: search.ratio_sweep(d[3], d[4], d[5], d[0].unionByName(d[1]), [60, 120], [10, 20]))


@query(f"""{RET}, p AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY seq) - 1 AS k, ret, count(*) OVER (PARTITION BY series_id) AS n FROM ret),
h AS (SELECT series_id, CASE WHEN k < n // 2 THEN 'a' ELSE 'b' END AS part, k, ret FROM p),
w AS (SELECT x.series_id, x.part, x.k, y.ret AS y_1 FROM h x JOIN h y ON y.series_id = x.series_id AND y.part = x.part AND y.k = x.k + 5)
SELECT series_id, part, count(*) AS windows, {R6.format('sum(y_1)')} AS total FROM w GROUP BY 1, 2""")
def windows_without_seam(spark, sf_dir):
    """Windows of two sources built apart and joined afterwards."""
    r = returns_of(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("series_id"))
    k = F.row_number().over(S.ordered()) - 1
    half = r.withColumn("part", F.when(k < F.floor(n / 2), "a").otherwise("b"))
    both = [S.supervised_windows(half.where(F.col("part") == p), "ret", 5, [1], carry=["part"]) for p in "ab"]
    return rounded(both[0].unionByName(both[1]).groupBy("series_id", "part").agg(F.count("*").alias("windows"), F.sum("y_1").alias("total")))
