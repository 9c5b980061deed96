"""Label matrices over points that arrive in batches: running sums against a fixed target table.

A mean over batches needs only the sum of distances and the count per pair of labels. Each
micro-batch writes its partial sums under its batch number, so a batch that runs again replaces
its own rows and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelscape.operators.matrices import axes, located
from labelscape.operators.nearest import nearest_sums
from labelscape.session import written


def partial_sums(points: DataFrame, targets: DataFrame, *, x_col: str = "x", y_col: str = "y", z_col: str | None = None,
                 celltype_col: str = "celltype", strategy: str = "auto") -> DataFrame:
    """(source, target, total, n) of one batch of source points."""
    coords = axes(x_col, y_col, z_col)
    sums = nearest_sums(located(points, coords, celltype_col), targets, coords, celltype_col, strategy=strategy)
    return sums.groupBy("source", "target").agg(F.sum("nd").alias("total"), F.sum("n").alias("n"))


def accumulate(stream: DataFrame, targets: DataFrame, path: str, checkpoint: str, **columns) -> StreamingQuery:
    """Start writing partial sums of all available points of ``stream`` under ``path``. The targets are brought to distinct places once."""
    kept = [*axes(columns.get("x_col", "x"), columns.get("y_col", "y"), columns.get("z_col")), columns.get("celltype_col", "celltype")]
    targets = written(targets.select(*kept).distinct())

    def store(batch: DataFrame, number: int) -> None:
        partial_sums(batch, targets, **columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def accumulated(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, value): the mean over everything stored so far."""
    return spark.read.parquet(path).groupBy("source", "target").agg(
        (F.sum("total") / F.sum("n")).alias("value"))
