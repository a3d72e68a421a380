"""The reports and sweeps have rows for every series."""

import pytest
from seriesmill.queries import QUERIES
from seriesmill.sources import series as src


@pytest.mark.parametrize("name", ["augmentation_report", "ratio_sweep"])
def test_rows_for_every_series(spark, sf_dir, name):
    want = {r.series_id for r in src.all_series(spark, sf_dir).select("series_id").distinct().collect()}
    assert len(want) > 1 and {r.series_id for r in QUERIES[name](spark, sf_dir).select("series_id").collect()} == want
