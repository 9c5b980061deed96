"""Synthetic point clouds for benchmarks: modular, nested (annuli) and random layouts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _labelled(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    """One row per point with its label number; ``sizes`` holds the points per label."""
    edges = [sum(sizes[:i]) for i in range(len(sizes))]
    label = F.lit(0)
    for i, edge in enumerate(edges):
        label = F.when(F.col("id") >= edge, i).otherwise(label)
    return spark.range(sum(sizes)).withColumn("_l", label)


def modular(spark: SparkSession, centres: Sequence[tuple[float, float]], *, points: int = 200, spread: float = 1.0,
            seed: int = 0) -> DataFrame:
    """Normal clouds around given centres, one label each."""
    at = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in centres])
    return _labelled(spark, [points] * len(centres)).select(
        F.col("id").alias("cell_id"), (at[F.col("_l")]["x"] + F.randn(seed) * spread).alias("x"),
        (at[F.col("_l")]["y"] + F.randn(seed + 1) * spread).alias("y"), F.concat(F.lit("C"), F.col("_l")).alias("celltype"))


def nested(spark: SparkSession, rings: Sequence[tuple[float, float, int]], *, seed: int = 0) -> DataFrame:
    """Rings of (inner radius, outer radius, points), uniform in area, one label each."""
    inner = F.array(*[F.lit(float(a)) for a, _, _ in rings])[F.col("_l")]
    outer = F.array(*[F.lit(float(b)) for _, b, _ in rings])[F.col("_l")]
    radius = F.sqrt(inner * inner + F.rand(seed) * (outer * outer - inner * inner))
    angle = F.rand(seed + 1) * (2 * math.pi)
    rows = _labelled(spark, [n for _, _, n in rings]).withColumns({"_r": radius, "_a": angle})
    return rows.select(F.col("id").alias("cell_id"), (F.col("_r") * F.cos("_a")).alias("x"),
                       (F.col("_r") * F.sin("_a")).alias("y"), F.concat(F.lit("C"), F.col("_l")).alias("celltype"))


def scattered(spark: SparkSession, labels: int = 6, *, points: int = 300, size: float = 10.0, seed: int = 0) -> DataFrame:
    """Uniform points in a square, labels without structure."""
    return _labelled(spark, [points] * labels).select(
        F.col("id").alias("cell_id"), (F.rand(seed) * size).alias("x"), (F.rand(seed + 1) * size).alias("y"),
        F.concat(F.lit("C"), F.col("_l")).alias("celltype"))
