import random

import pytest

from labelscape.operators.matrices import searcher_findee
from labelscape.streaming import arriving

KIND = "x double, y double, celltype string"


def cloud(n, seed):
    rng = random.Random(seed)
    return [(round(rng.random(), 2), round(rng.random(), 2), rng.choice("abcd")) for _ in range(n)] + [(0.5, 0.5, "a")] * 3


def entries(df):
    return {(r["source"], r["target"]): pytest.approx(r["value"]) for r in df.collect()}


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, incoming, sources, path, mark):
    arriving.accumulate_targets(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(incoming)),
                                sources, str(path), str(mark)).awaitTermination()


def test_batches_give_the_matrix_of_one_run(spark, tmp_path):
    rows = cloud(200, 1)
    points = spark.createDataFrame([*rows, (None, 1.0, "a"), (0.1, float("nan"), "b"), (0.3, 0.3, None)], KIND)
    want = {(r["source"], r["target"]): r["value"] for r in searcher_findee(spark.createDataFrame(rows, KIND)).collect()}
    incoming, path = tmp_path / "in", tmp_path / "state"
    for i in range(3):  # two labels come late
        put(spark, incoming, [r for j, r in enumerate(rows) if (0 if r[2] in "ab" and j < 100 else 1 + j % 2) == i] + [(None, 2.0, "a"), (1.0, 1.0, None)], i)
    run(spark, incoming, points, path, tmp_path / "mark")
    assert entries(arriving.arrived(spark, str(path))) == want
    batches = sorted(path.glob("batch=*"))
    assert len(batches) == 3
    sizes = [spark.read.parquet(str(b)).count() for b in batches]
    # from an empty checkpoint every file comes again, over the state that is there
    run(spark, incoming, None, path, tmp_path / "other mark")
    assert entries(arriving.arrived(spark, str(path))) == want
    assert sum(spark.read.parquet(str(b)).count() for b in sorted(path.glob("batch=*"))) <= sum(sizes)
    # nothing new: nothing changes
    run(spark, incoming, None, path, tmp_path / "mark")
    assert entries(arriving.arrived(spark, str(path))) == want


def test_a_later_batch_stores_only_what_is_closer(spark):
    places = arriving.source_places(spark.createDataFrame([(0.0, 0.0, "s"), (0.0, 0.0, "s"), (9.0, 0.0, "s")], KIND))
    first = arriving.closer_places(places, spark.createDataFrame([(1.0, 0.0, "t")], KIND), None)
    assert sorted(r["dist"] for r in first.collect()) == [1.0, 8.0]
    second = arriving.closer_places(places, spark.createDataFrame([(7.0, 0.0, "t"), (1.0, 0.0, "t"), (3.0, 0.0, "u")], KIND), first)
    assert sorted((r["target"], r["dist"]) for r in second.collect()) == [("t", 2.0), ("u", 3.0), ("u", 6.0)]
    got = {(r["source"], r["target"]): r["value"] for r in arriving.matrix_of_closest(places, first.unionByName(second)).collect()}
    assert got == {("s", "t"): pytest.approx((2 * 1 + 2) / 3), ("s", "u"): pytest.approx((2 * 3 + 6) / 3)}


def test_before_the_first_batch(spark, tmp_path):
    arriving.source_places(spark.createDataFrame(cloud(5, 2), KIND)).write.parquet(str(tmp_path / "places"))
    assert arriving.arrived(spark, str(tmp_path)).count() == 0
