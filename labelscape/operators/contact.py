"""Local contact between ligand-expressing and receptor-expressing neighbours, all pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscape.functions.normalize import winsor_limits, winsorised
from labelscape.functions.quantiles import quantile
from labelscape.operators.spreading import product_sums
from labelscape.session import written
from labelscape.sources.points import dense


def zero_completed(expression: DataFrame, genes: DataFrame, cells) -> DataFrame:
    """(gene, value, n): the values with their counts plus one row for each gene's absent cells."""
    held = expression.groupBy("gene", "value").agg(F.count("*").alias("n"))
    absent = genes.join(expression.groupBy("gene").agg(F.count("*").alias("_have")), "gene", "left").select(
        "gene", F.lit(0.0).alias("value"), (cells - F.coalesce("_have", F.lit(0))).alias("n"))
    return held.unionByName(absent.where("n > 0"))


def scaled_expression(expression: DataFrame, reference: DataFrame, genes: DataFrame, *,
                      threshold: str | float = "q75_nonzero", upper: float = 0.99) -> DataFrame:
    """(cell_id, gene, scaled, active): winsorised value and whether it exceeds the gene's threshold.

    Cells absent from a gene are left out when their scaled value is 0 and they are not active.
    """
    if isinstance(threshold, str) and threshold != "q75_nonzero":
        raise ValueError(f"threshold {threshold!r} is neither a number nor 'q75_nonzero'")
    cells = reference.agg(F.count("*")).scalar()
    counted = written(zero_completed(expression, genes, cells))
    limits = winsor_limits(counted, ["gene"], "value", upper=upper, freq="n")
    if isinstance(threshold, str):
        cut = quantile(counted.where("value > 0"), ["gene"], "value", {"threshold": 0.75}, freq="n")
        limits = limits.join(cut, "gene", "left")
    else:
        limits = limits.withColumn("threshold", F.lit(float(threshold)))
    limits = written(limits)
    zero = winsorised(F.lit(0.0))
    filled = limits.where((zero > 0) | (F.col("threshold") < 0)).select("gene")
    rows = dense(reference, filled, expression).select("cell_id", "gene", "value").unionByName(
        expression.join(filled, "gene", "left_anti").select("cell_id", "gene", "value"))
    return rows.join(limits, "gene").select(
        "cell_id", "gene", winsorised(F.col("value")).alias("scaled"),
        F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)).cast("int").alias("active"))


def local_contact(reference: DataFrame, expression: DataFrame, edges: DataFrame, pairs: DataFrame, *,
                  min_cross_edges: int = 50, contact_expr_threshold: str | float = "q75_nonzero",
                  winsor_quantile: float = 0.99) -> DataFrame:
    """One row per (pair_id, sender, receiver) over all label pairs.

    ``edges`` is (cell_id, neighbor), ``pairs`` has pair_id, ligand, receptor. Strength is the mean
    product of scaled ligand (sender cell) and receptor (neighbour) over directed edges, coverage the
    fraction of edges with both active. Ligand values are summed per receiving cell before they meet
    the receptor, block by block, so edges are never multiplied by genes, pairs or receptors, and sums meet
    the receptor where they are made.
    """
    label = reference.select("cell_id", "celltype")
    pairs = written(pairs)
    names = pairs.select(F.col("ligand").alias("gene")).union(pairs.select("receptor")).distinct()
    scaled = written(scaled_expression(written(expression.join(names, "gene", "left_semi")), reference, names,
                                       threshold=contact_expr_threshold, upper=winsor_quantile))
    directed = written(edges.join(label.withColumnRenamed("celltype", "sender"), "cell_id").join(
        label.select(F.col("cell_id").alias("neighbor"), F.col("celltype").alias("receiver")), "neighbor"))
    crossing = written(directed.groupBy("sender", "receiver").agg(F.count("*").alias("cross_edge_count")))

    ligands = pairs.select(F.col("ligand").alias("gene")).distinct()
    places = reference.select("cell_id", "x", "y") if {"x", "y"} <= set(reference.columns) else None
    receptors = pairs.select("pair_id", "ligand", F.col("receptor").alias("gene")).join(scaled, "gene").select(
        F.col("cell_id").alias("neighbor"), "pair_id", F.col("ligand").alias("gene"), "scaled", "active")
    met = product_sums(scaled.join(ligands, "gene", "left_semi"), receptors, directed, source="cell_id", keys=["neighbor", "sender", "receiver"],
                       column="gene", values=["scaled", "active"], name="pair_id", places=places).withColumnsRenamed(
        {"scaled": "strength", "active": "both"})

    order = label.agg(F.collect_set("celltype")).scalar()
    grid = pairs.select("pair_id").distinct().select("pair_id", F.explode(order).alias("sender")).select(
        "pair_id", "sender", F.explode(order).alias("receiver"))
    full = grid.join(crossing, ["sender", "receiver"], "left").join(met, ["pair_id", "sender", "receiver"], "left")
    count = F.coalesce("cross_edge_count", F.lit(0))
    full = full.select(
        "pair_id", "sender", "receiver", count.alias("cross_edge_count"),
        F.coalesce(F.try_divide("strength", count), F.lit(0.0)).alias("contact_strength_raw"),
        F.coalesce(F.try_divide("both", count), F.lit(0.0)).alias("contact_coverage"))

    full = written(full)
    keys = ["pair_id", "receiver"]
    limits = winsor_limits(full, keys, "contact_strength_raw", upper=winsor_quantile, bounded=True)
    full = full.join(limits, keys).withColumn("contact_strength_normalized", winsorised(F.col("contact_strength_raw")))
    busy = crossing.where("sender <> receiver")
    scale = quantile(busy, [], "cross_edge_count", {"scale": 0.99}, bounded=True).agg(F.max("scale")).scalar()
    full = full.withColumn("edge_support", F.least(F.lit(1.0), F.col("cross_edge_count") / F.coalesce(scale, F.lit(1.0))))
    contact = F.sqrt(F.col("contact_strength_normalized") * F.col("contact_coverage")) * F.col("edge_support")
    return full.select(
        "pair_id", "sender", "receiver", "cross_edge_count", "contact_strength_raw", "contact_strength_normalized",
        "contact_coverage", "edge_support",
        F.when(F.col("cross_edge_count") >= int(min_cross_edges), contact).otherwise(0.0).alias("local_contact"))
