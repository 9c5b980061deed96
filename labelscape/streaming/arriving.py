"""Label matrices while target points arrive in batches: the smallest distance so far for every source place and label.

A smallest distance only falls, so batches may be merged in any order and more than once. Each micro-batch stores, under its number, the
distances that are below all stored by other batches; a batch that runs again replaces its own rows. The n-th batch
of points in random order improves a share of about 1 / n of the places, so what is stored grows with the logarithm of the number of batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelscape.functions.ranks import numbered
from labelscape.operators.matrices import axes, located
from labelscape.operators.nearest import nearest_per_label
from labelscape.sources.files import exists, listed


def source_places(points: DataFrame, *, x_col: str = "x", y_col: str = "y", z_col: str | None = None, celltype_col: str = "celltype") -> DataFrame:
    """(place, source, n, coordinates): distinct places per label, numbered, with the number of points there.

    The number stands for the place in all that is stored, so keep this table as long as the state.
    """
    coords = axes(x_col, y_col, z_col)
    for c in coords:
        points = points.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    places = located(points, coords, celltype_col).select("source", *coords, "n")
    return numbered(places, "source", *coords, name="place")


def closer_places(places: DataFrame, targets: DataFrame, state: DataFrame | None, *, x_col: str = "x", y_col: str = "y", z_col: str | None = None,
                  celltype_col: str = "celltype", strategy: str = "auto") -> DataFrame:
    """(place, target, dist) where a target of the batch is closer than all in ``state``, which may hold several rows a place and label."""
    coords = axes(x_col, y_col, z_col)
    found = nearest_per_label(places.select("place", *coords), targets, coords, celltype_col, strategy=strategy).select("place", "target", "dist")
    if state is None:
        return found
    held = state.groupBy("place", "target").agg(F.min("dist").alias("_held"))
    return found.join(held, ["place", "target"], "left").where(F.col("_held").isNull() | (F.col("dist") < F.col("_held"))).drop("_held")


def matrix_of_closest(places: DataFrame, state: DataFrame) -> DataFrame:
    """(source, target, value): the mean over a label's points of the smallest distance to each label that has arrived."""
    least = state.groupBy("place", "target").agg(F.min("dist").alias("dist"))
    return least.join(places.select("place", "source", "n"), "place").groupBy("source", "target").agg(
        (F.sum(F.col("n") * F.col("dist")) / F.sum("n")).alias("value"))


def _stored(spark: SparkSession, path: str, without: int | None = None) -> DataFrame | None:
    """All batches' rows, but for those of one batch."""
    folders = [f for f in listed(spark, path, "batch=*") if listed(spark, f, "_SUCCESS") and f.rpartition("=")[2] != str(without)]
    return spark.read.schema("place long, target string, dist double").parquet(*folders) if folders else None


def accumulate_targets(stream: DataFrame, sources: DataFrame, path: str, checkpoint: str, **columns) -> StreamingQuery:
    """Start merging all available target points of ``stream`` into the state under ``path``.

    The source places are stored there too, once: a later start goes on with the same ones and does not read ``sources``. A batch that
    failed half way or runs again gives the same state. Rows without a label or coordinate are no targets.
    """
    spark = stream.sparkSession
    if not exists(spark, f"{path}/places/_SUCCESS"):
        source_places(sources, **{k: v for k, v in columns.items() if k != "strategy"}).write.mode("overwrite").parquet(f"{path}/places")
    places = spark.read.parquet(f"{path}/places")

    def store(batch: DataFrame, number: int) -> None:
        found = closer_places(places, batch, _stored(spark, path, number), **columns)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, value) of everything that has arrived; no rows before the first batch."""
    places, state = spark.read.parquet(f"{path}/places"), _stored(spark, path)
    if state is None:
        state = spark.createDataFrame([], "place long, target string, dist double")
    return matrix_of_closest(places, state)
