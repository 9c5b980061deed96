"""Expression tables: per-label summaries, within-cell ranks, normalisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscape.functions.normalize import min_max_positive


@dataclass
class Filled:
    """A cells x genes table without a row for every pair.

    ``rows`` (cell_id, gene, ``value``) are the pairs that hold something of their own; all others hold the value that ``rest`` has for their
    ``key``, a gene or a cell. Size: the expression's rows and one row for each gene or cell.
    """

    rows: DataFrame
    rest: DataFrame
    key: str
    value: str

    def dense(self, reference: DataFrame, genes: DataFrame) -> DataFrame:
        """A row for every cell and given gene."""
        return _grid(reference, genes).join(self.rows, ["cell_id", "gene"], "left").join(
            self.rest.withColumnRenamed(self.value, "_rest"), self.key, "left").select(
            "cell_id", "gene", F.coalesce(self.value, "_rest").alias(self.value))

    def mean_by_label(self, reference: DataFrame, genes: DataFrame) -> DataFrame:
        """(celltype, gene, ``value``): the mean over a label's cells, pairs without a row included, and no pair made for it.

        A row counts with what it has above the rest; the rest counts once for each gene or cell and label.
        """
        label = reference.select("cell_id", "celltype")
        rest = self.rest.withColumnRenamed(self.value, "_rest")
        sizes = label.groupBy("celltype").agg(F.count("*").alias("_cells"))
        if self.key == "cell_id":
            sizes = sizes.join(label.join(rest, "cell_id").groupBy("celltype").agg(F.sum("_rest").alias("_base")), "celltype", "left")
        above = self.rows.join(rest, self.key).join(label, "cell_id").groupBy("celltype", "gene").agg(
            F.sum(F.col(self.value) - F.col("_rest")).alias("_above"))
        labels = sizes.agg(F.collect_list(F.struct(*sizes.columns))).scalar()
        full = genes.select("gene").where("gene is not null").distinct().select("gene", F.inline(labels))
        if self.key == "gene":
            full = full.join(rest, "gene", "left").withColumn("_base", F.col("_cells") * F.col("_rest"))
        return full.join(above, ["celltype", "gene"], "left").select(
            "celltype", "gene", ((F.col("_base") + F.coalesce("_above", F.lit(0.0))) / F.col("_cells")).alias(self.value))


def _grid(reference: DataFrame, genes: DataFrame) -> DataFrame:
    names = genes.agg(F.collect_set("gene")).scalar()
    return reference.select("cell_id", F.explode(names).alias("gene"))


def summarize_by_celltype(expression: DataFrame, reference: DataFrame, *, detection_threshold: float = 0.0) -> DataFrame:
    """(gene, celltype, share, detected, raw, normalized).

    share: the label's part of the gene's total; detected: fraction of the label's cells above the
    threshold, cells without a value count as 0; raw = share * sqrt(detected); normalized: raw
    scaled to [0, 1] over the labels of each gene.
    """
    label = reference.select("cell_id", "celltype")
    sizes = reference.groupBy("celltype").agg(F.count("*").alias("cells"))
    above = F.sum((F.col("value") > float(detection_threshold)).cast("long"))
    held = expression.join(label, "cell_id").groupBy("gene", "celltype").agg(
        F.sum("value").alias("total"), above.alias("above"), F.count("*").alias("present"))
    labels = sizes.agg(F.collect_list(F.struct("celltype", "cells"))).scalar()
    # per gene one map over the labels, so that labels without the gene get a row as well
    packed = held.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct(
        "celltype", F.struct("total", "above", "present")))).alias("_by_label"))
    full = packed.select("gene", "_by_label", F.inline(labels)).withColumn("_h", F.col("_by_label")[F.col("celltype")])
    full = full.select("gene", "celltype", "cells", *[
        F.coalesce(F.col(f"_h.{c}"), F.lit(0)).alias(c) for c in ("total", "above", "present")])
    if detection_threshold < 0:
        full = full.withColumn("above", F.col("above") + F.col("cells") - F.col("present"))
    gene = Window.partitionBy("gene")
    whole = F.sum("total").over(gene)
    full = full.withColumn("share", F.when(whole == 0, 0.0).otherwise(F.try_divide("total", whole)))
    full = full.withColumn("detected", F.col("above") / F.col("cells"))
    full = full.withColumn("raw", F.col("share") * F.sqrt("detected"))
    return full.select("gene", "celltype", "share", "detected", "raw",
                       min_max_positive(F.col("raw"), gene).alias("normalized"))


def nonzero_ranks(expression: DataFrame, n_genes) -> DataFrame:
    """Average ascending rank (as a fraction) of each non-zero value among all genes of its cell.

    Also gives ``zero_rank``, the rank shared by the cell's absent genes. Absent genes are counted,
    not stored.
    """
    values = expression.where(F.col("value") != 0)
    cell = Window.partitionBy("cell_id")
    ordered = cell.orderBy("value")
    equal = F.count("*").over(Window.partitionBy("cell_id", "value"))
    zeros = n_genes - F.count("*").over(cell)
    below = F.sum((F.col("value") < 0).cast("long")).over(cell)
    rank = F.rank().over(ordered) + (equal - 1) / 2 + F.when(F.col("value") > 0, zeros).otherwise(0)
    return values.select("cell_id", "gene", (rank / n_genes).alias("rank"),
                         ((below + (zeros + 1) / 2) / n_genes).alias("zero_rank"))


def sparse_ranks(expression: DataFrame, reference: DataFrame, genes: DataFrame) -> Filled:
    """Ranks within each cell among the given genes: rows for values other than 0, and the rank that a cell's other genes share."""
    genes = genes.select("gene").where("gene is not null").distinct()
    n_genes = genes.agg(F.count("*")).scalar()
    own = reference.select("cell_id").distinct()
    some = nonzero_ranks(expression.join(genes, "gene", "left_semi").join(own, "cell_id", "left_semi"), n_genes)
    zero = some.groupBy("cell_id").agg(F.first("zero_rank").alias("zero_rank"))
    none = (n_genes + 1) / 2 / n_genes
    rest = own.join(zero, "cell_id", "left").select("cell_id", F.coalesce("zero_rank", none).alias("rank"))
    return Filled(some.drop("zero_rank"), rest, "cell_id", "rank")


def ranks(expression: DataFrame, reference: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell_id, gene, rank) for every cell and every given gene, zeros included; other genes do not count."""
    return sparse_ranks(expression, reference, genes).dense(reference, genes.where("gene is not null"))


def sparse_log_scale(expression: DataFrame, reference: DataFrame, genes: DataFrame, *, target_sum: float = 1e4,
                     max_value: float = 10.0) -> Filled:
    """As ``normalize_log_scale``, with rows for the expression's rows only, and what a gene's other cells have."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    logged = expression.withColumn("value", F.log1p(
        F.when(total == 0, F.col("value")).otherwise(F.try_divide(F.col("value") * target_sum, total))))
    cells = reference.agg(F.count("*")).scalar()
    moments = logged.groupBy("gene").agg(F.sum("value").alias("_s"), F.sum(F.col("value") ** 2).alias("_q"))
    moments = moments.withColumn("_n", cells).withColumn("_mean", F.col("_s") / F.col("_n"))
    spread = F.sqrt(F.greatest(F.col("_q") - F.col("_n") * F.col("_mean") ** 2, F.lit(0.0))
                    / F.greatest(F.col("_n") - 1, F.lit(1)))
    moments = moments.select("gene", "_mean", F.when(spread > 0, spread).otherwise(1.0).alias("_sd"))
    names = genes.select(F.col(genes.columns[0]).alias("gene")).distinct()

    def score(value: Column) -> Column:
        return F.least((value - F.coalesce("_mean", F.lit(0.0))) / F.coalesce("_sd", F.lit(1.0)), F.lit(float(max_value))).alias("value")

    rows = logged.where(F.col("value").isNotNull()).join(names, "gene", "left_semi").join(
        reference.select("cell_id").distinct(), "cell_id", "left_semi").join(moments, "gene", "left")
    return Filled(rows.select("cell_id", "gene", score(F.col("value"))),
                  names.join(moments, "gene", "left").select("gene", score(F.lit(0.0))), "gene", "value")


def normalize_log_scale(expression: DataFrame, reference: DataFrame, genes: DataFrame, *,
                        target_sum: float = 1e4, max_value: float = 10.0) -> DataFrame:
    """Per cell to ``target_sum``, log1p, per gene z-score (sample deviation, absent values are 0),
    values above ``max_value`` cut. Every cell and given gene gets a row."""
    return sparse_log_scale(expression, reference, genes, target_sum=target_sum, max_value=max_value).dense(
        reference, genes.select(F.col(genes.columns[0]).alias("gene")))


def counts_per_gene(expression: DataFrame) -> DataFrame:
    return expression.groupBy("gene").agg(F.sum("value").alias("count"))
