"""Connected components by smallest labels, as DataFrame joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscape.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``label`` for every node of an edge: the smallest node that can be reached.

    A round gives each node the smallest label around it and then that label's own label, so paths halve as they
    shrink. A hub is a key of joins only, whose other side has one row a node; minima are formed before the shuffle.
    Null ends are left out; an empty table has no nodes.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = written(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select(
        "node", F.least("node", "m").alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(
            F.min("label").alias("m"))
        met = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = written(met.join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that a task holds, as pairs of each node with the smallest one it is connected to there."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while len(nodes):
        before = label
        least = np.minimum(label[one], label[other])
        label = label.copy()
        np.minimum.at(label, one, least)
        np.minimum.at(label, other, least)
        np.minimum.at(label, before[one], least)
        np.minimum.at(label, before[other], least)
        label = label[label]
        if (label == before).all():
            break
    inner = label != np.arange(len(nodes))
    return nodes[label[inner]], nodes[inner]
