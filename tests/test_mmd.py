"""Differences beyond the first windows count."""

from seriesmill.operators import stats as T


def test_mmd_reads_all_windows(spark):
    import math

    def value(late):
        rows = [("x", side, i, math.sin(i * k) * (late if side == "synth" and i >= 100 else 1.0)) for side, k in (("real", 1.0), ("synth", 1.3)) for i in range(200)]
        df = spark.createDataFrame(rows, "series_id string, side string, seq long, ret double")
        return T.mmd(df).first().mmd, T.mmd(df, block=7).first().mmd

    (a, a7), (b, b7) = value(1.0), value(3.0)
    assert abs(a - b) > 1e-3
    assert abs(a - a7) < 1e-9 and abs(b - b7) < 1e-9
