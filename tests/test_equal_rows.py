"""Equal points count as often as they occur, and a query joins its expression once."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from labelscape.catalog import queries as catalog
from labelscape.functions.quantiles import aggregate_distances

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("agg", ["mean", "median", "quantile"])
@pytest.mark.parametrize("weighted", [True, False])
def test_numbers_of_rows_count_as_rows(spark, agg, weighted):
    rows = [("a", float(v % 5), float(v % 3)) for v in range(40)] + [("b", None, 1.0), ("b", 2.0, 0.0), ("b", 2.0, 0.0), ("b", 9.0, 0.0), ("c", None, None)]
    each = spark.createDataFrame(rows, "g string, dist double, w double")
    equal = each.groupBy("g", "dist", "w").agg(F.count("*").alias("n"))
    want = aggregate_distances(each, ["g"], "dist", "w", agg=agg, weight_by_expression=weighted).collect()
    got = aggregate_distances(equal, ["g"], "dist", "w", agg=agg, weight_by_expression=weighted, freq="n").collect()
    assert {r["g"]: r["value"] for r in got} == pytest.approx({r["g"]: r["value"] for r in want})


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", ["lr_hotspots", "pathway_mode_summary"])
def test_expression_is_joined_once(spark, monkeypatch, name):
    made, plain = [], catalog.expression
    monkeypatch.setattr(catalog, "expression", lambda *a: made.append(a) or plain(*a))
    catalog.QUERIES[name](spark, FOLDER)
    assert len(made) == 1


def test_copies_of_entity_points_are_one_row(spark, monkeypatch):
    from labelscape.operators import entity
    cells = spark.createDataFrame([(float(i), 0.0, "ab"[i % 2]) for i in range(10)], "x double, y double, celltype string")
    points = spark.range(5000).selectExpr("double(id % 4) AS x", "1D AS y", "'g' AS entity", "1D AS weight")
    sizes, plain = [], entity.written
    monkeypatch.setattr(entity, "written", lambda df: sizes.append((out := plain(df)).count()) or out)
    once = spark.range(4).selectExpr("double(id % 4) AS x", "1D AS y", "'g' AS entity", "1250D AS weight")
    got = {r["celltype"]: r["value"] for r in entity.entity_to_cell(cells, points).collect()}
    assert max(sizes) <= 10
    assert got == pytest.approx({r["celltype"]: r["value"] for r in entity.entity_to_cell(cells, once).collect()})
