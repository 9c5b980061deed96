import pytest

from labelscape.llm import common


@pytest.mark.parametrize("bits", [1 << 24, 1 << 16, 64])
def test_filtered_joins(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    df = spark.createDataFrame([(i if i % 50 else None, f"t{i}") for i in range(400)], "k long, t string")
    keys = spark.createDataFrame([(i,) for i in range(0, 400, 7)], "k long")
    inside = {i for i in range(400) if i % 50 and i % 7 == 0}
    assert {r["k"] for r in common.having(df, keys, "k").collect()} == inside
    rest = common.lacking(df, keys, "k").collect()
    assert {r["k"] for r in rest} == {i if i % 50 else None for i in range(400)} - inside and len(rest) == 400 - len(inside)
    none = keys.limit(0)
    assert common.having(df, none, "k").count() == 0 and common.lacking(df, none, "k").count() == 400
