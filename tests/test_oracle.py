"""Every query with SQL of its own against DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest
from seriesmill.queries import ORACLE, QUERIES


def plain(row):
    return tuple((0.0 if x == 0 else round(x, 6)) if isinstance(x, float) and math.isfinite(x) else str(x) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    base = f"/root/testdata/{os.environ.get('ORACLE_SF', 'sf0.001')}"
    con = duckdb.connect()
    for f in os.listdir(base):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{base}/{f}'")
    rel = con.sql(ORACLE[name])
    df = QUERIES[name](spark, base)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = Counter(map(plain, rel.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
    got = Counter(map(plain, df.select(*columns).collect()))
    extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
    assert not extra and not missing, (extra, missing)
    assert got


SAMPLED = {"hmm_ar_sample", "hmm_garch_sample", "hybrid_bootstrap", "hybrid_crossfade", "hybrid_bridge", "hybrid_segments", "regime_gan_sample", "vae_gan_sample", "vae_sample", "gan_sample", "timegan_sample"}
#: Minutes at the operators' own settings; their operators are tested in test_library.
LONG = {"random_sweep", "grid_sweep", "generator_evaluation", "predictive_report", "augmentation_report", "ratio_sweep"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SAMPLED - LONG))
def test_query_has_a_row_for_every_series(spark, sf_dir, name):
    from seriesmill.sources import series as src

    want = {r.series_id for r in src.all_series(spark, sf_dir).select("series_id").distinct().collect()}
    assert {r.series_id for r in QUERIES[name](spark, sf_dir).select("series_id").collect()} <= want
    assert QUERIES[name](spark, sf_dir).count() >= 1


@pytest.mark.parametrize("name", sorted(SAMPLED))
def test_samples_have_their_length_and_plausible_returns(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).orderBy("series_id", "seed", "seq").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.series_id, r.seed), []).append(r)
    assert groups
    for own in groups.values():
        assert [r.seq for r in own] == list(range(150))
        # Prices of a walk of large returns may run out of range at its ends, but not at its start, and they move.
        assert all(r.typical_price >= 0 for r in own) and math.isfinite(own[0].typical_price)
        assert len({r.typical_price for r in own}) > 10
    seeds = {}
    for (series, _), own in groups.items():
        seeds.setdefault(series, set()).add(tuple(r.typical_price for r in own))
    assert len(seeds["orders"]) == 2  # the event series of the smallest tables have hardly more than one block
