"""Every registered query with SQL gives the rows of its SQL."""

import pytest

from compare import DATA, database, same_rows
from glyphtally.plans import analysis_queries, crop_queries, detection_queries, marker_queries, raster_queries, table_queries, vector_queries

PLANS = (vector_queries, raster_queries, table_queries, marker_queries, detection_queries, analysis_queries, crop_queries)
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows(spark, con, name):
    same_rows(QUERIES[name](spark, DATA), con, ORACLES[name])


def test_all_but_few_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"digit_reading", "detected_digits", "extracted_glyphs", "settled_spacings", "analysed_counts", "marker_readings", "symmetry_peaks"} and not set(ORACLES) - set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
