"""Catalogue queries against their SQL twins on the smallest tables."""

import math
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import difference
from labelscape.catalog.oracles import ORACLES
from labelscape.catalog.queries import QUERIES, rounded

FOLDER = "/root/testdata/sf0.001"
# the longest chains are compared by compare.py on larger tables; their parts are all here
LONG = {"lr_scores", "lr_top_pairs", "lr_summary_matrix", "lr_hotspots", "lr_target_consistency", "lr_scores_recomputed",
        "pathway_topology_activity", "pathway_topology_structuremap", "pathway_mode_summary", "visium_mean_directed",
        "visium_unweighted", "pathway_points"}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LONG))
def test_query_equals_sql(spark, db, name):
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), db.execute(ORACLES[name]).df()) is None


def test_rounding_by_millionths_equals_round(spark):
    rng = random.Random(14)
    values = [rng.choice([1, 10, 1e3, 1e5, 1e6, 1e7]) * rng.uniform(-1, 1) for _ in range(3000)]
    values += [rng.randrange(-4_000_000, 4_000_000) / 2e6 for _ in range(2000)]  # every second one is half a millionth
    values += [math.nextafter((i + 0.5) / 1e6, side) for i in range(-500, 500) for side in (-9.0, 9.0)]
    values += [0.0, -0.0, -1e-9, 5e-7, -5e-7, 1e6, -1e6, 1e15, 1.7e308, -1.7e308, 5e-324, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(2)
    got = rounded(df.withColumn("w", F.col("v").cast("string"))).select("v", F.col("w").cast("double").alias("w"))
    off = got.where(~F.col("v").eqNullSafe(F.round("w", 6) + F.lit(0.0)) | (F.col("v").cast("string") == "-0.0"))
    assert got.count() == len(values) and off.collect() == []
