"""Catalog queries against their DuckDB oracle on the smallest tables.

The driver checks every query at sf0.01; this keeps a representative subset in the
unit suite (one per operator family) so it stays fast.
"""

import pytest

from conftest import SMALL
from oracle_check import compare, duck, rows_of_duck, rows_of_spark

SUBSET = [
    "q00_flagship_nutrient_by_region", "a05_feature_stats", "a06_describe", "a19_roc_auc", "p07_range_violations",
    "p10_iqr_sequential", "x01_stratified_split", "x03_stratified_folds", "f08_encode_unseen", "j02_point_in_polygon",
    "j03_nearest_fallback", "j12_asof_weather", "w01_session_history", "w02_moving_latency", "w04_recurring_deficiency",
    "r01_crop_suitability", "w05_top_and_avoid", "r10_graph_compatibility", "s13_forecast_normalize",
]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    from terroir.plans import catalog
    entry = catalog.load_all()[name]
    scols, srows = rows_of_spark(entry.fn(spark, SMALL))
    dcols, drows = rows_of_duck(con, entry.sql)
    assert scols == dcols
    ok, msg = compare(srows, drows)
    assert ok, msg


def test_every_query_has_a_function(spark):
    from terroir.plans import catalog
    entries = catalog.load_all()
    assert len(entries) >= 90
    assert all(callable(e.fn) for e in entries.values())
