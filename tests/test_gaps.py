"""Mosaics that lack vectors, at the end or between others, give the rows of the SQL."""

import pytest
from pyspark.sql import functions as F

from compare import DATA, database, same_rows
from test_queries import ORACLES, QUERIES

#: Vectors left: one mosaic whole, then one that ends inside its second line, two that lack vectors in the middle and at the begin, and one of two vectors.
HELD = [*range(16), *range(16, 23), *(k for k in range(32, 48) if k not in (33, 38, 39, 40, 41, 42, 43)), *range(53, 64), 64, 65]


@pytest.fixture(scope="module")
def gaps(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("gaps"))
    spark.read.parquet(f"{DATA}/embeddings.parquet").where(F.col("vec_id").isin(HELD)).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["resampled", "varied_blur", "varied_ink", "marker_tiles"])
def test_mosaics_with_gaps(spark, gaps, name):
    same_rows(QUERIES[name](spark, gaps), database(gaps), ORACLES[name])
