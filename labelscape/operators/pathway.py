"""Pathway activity per cell, pathway topology by gene aggregation and by activity point clouds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscape.functions.normalize import number, robust_limits, robust_scaled
from labelscape.functions.quantiles import aggregate_weighted, quantile
from labelscape.operators.expression import nonzero_ranks
from labelscape.operators.interaction import long_weights
from labelscape.session import written
from labelscape.sources.points import require

RANK_METHODS = ("rank_mean", "ucell", "aucell")
SUM_METHODS = ("weighted_sum", "progeny")
#: Pairs of a pathway and a gene that may go to every task; they are counted first.
FEW_MEMBERS = 100_000


def standard_pathways(pathways: DataFrame | Mapping, spark: SparkSession | None = None) -> DataFrame:
    """(pathway, gene, weight); weight 1 where none is given or it is no number."""
    if isinstance(pathways, Mapping):
        return long_weights(spark or SparkSession.active(), pathways, "pathway", "gene", "weight")
    require(pathways, ["pathway", "gene"], "pathway definitions")
    weight = number("weight", 1.0) if "weight" in pathways.columns else F.lit(1.0)
    return pathways.select(F.col("pathway").cast("string"), F.col("gene").cast("string"), weight.alias("weight"))


def pathway_activity(expression: DataFrame, reference: DataFrame, pathways: DataFrame, *, genes: DataFrame | None = None,
                     method: str = "rank_mean", normalize: bool = True) -> DataFrame:
    """(cell_id, pathway, value) for every cell and pathway.

    ``genes`` lists the genes of the frame, and only those count; absent values are 0. Without it the frame's genes are those of
    the expression table, a gene with a zero in it included; a gene that has no row at all must be listed.
    Rank methods average the genes' within-cell ranks by absolute weight, sum methods add weighted
    values over the sum of absolute weights. A pathway without a known gene gives 0.
    """
    if method not in RANK_METHODS + SUM_METHODS:
        raise ValueError(f"method={method!r} is unknown; use one of {RANK_METHODS + SUM_METHODS}")
    names = (genes if genes is not None else expression).select("gene").distinct()
    members = pathways.join(names, "gene", "left_semi")
    whole = members.groupBy("pathway").agg(F.sum(F.abs("weight")).alias("_all"))
    if method in RANK_METHODS:
        ranked = nonzero_ranks(expression.join(names, "gene", "left_semi"), names.agg(F.count("*")).scalar())
        none = names.agg((F.count("*") + 1) / 2 / F.count("*")).scalar()
        zero = ranked.groupBy("cell_id").agg(F.first("zero_rank").alias("_zero"))
        lift = F.abs("weight") * (F.col("rank") - F.col("zero_rank"))
        held = ranked.join(members, "gene").groupBy("cell_id", "pathway").agg(F.sum(lift).alias("_sum"))
    else:
        # a cell's genes together, so that they are added up before and not after each meets its pathways
        members, rows = written(members), expression
        if members.count() <= FEW_MEMBERS:
            members, rows = F.broadcast(members), expression.repartition("cell_id")
        held = rows.join(members, "gene").groupBy("cell_id", "pathway").agg(
            F.sum(F.col("value") * F.col("weight")).alias("_sum"))
    sets = pathways.select("pathway").distinct().agg(F.collect_list("pathway")).scalar()
    grid = reference.select("cell_id", F.explode(sets).alias("pathway"))
    full = grid.join(held, ["cell_id", "pathway"], "left").join(whole, "pathway", "left")
    total, known = F.coalesce("_sum", F.lit(0.0)), F.coalesce("_all", F.lit(0.0))
    if method in RANK_METHODS:
        full = full.join(zero, "cell_id", "left")
        base = F.coalesce("_zero", none)
        value = F.when(known == 0, 0.0).otherwise(base + F.try_divide(total, known))
    else:
        value = total / F.when(known == 0, 1.0).otherwise(known)
    out = full.select("cell_id", "pathway", value.alias("value"))
    if normalize:
        ends = out.groupBy("pathway").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
        same = F.when(F.col("_high") > 0, 1.0).otherwise(0.0)
        out = out.join(ends, "pathway").select("cell_id", "pathway", F.when(
            F.col("_low") == F.col("_high"), same).otherwise(
            (F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low"))).alias("value"))
    return out


def robust_activity(activity: DataFrame) -> DataFrame:
    """Every pathway clipped to its 0.01 and 0.99 quantiles and scaled to [0, 1]."""
    activity = written(activity)
    limits = robust_limits(activity, ["pathway"], "value")
    return activity.join(limits, "pathway").select(
        "cell_id", "pathway", robust_scaled(F.col("value")).alias("value"))


def gene_aggregate(topology: DataFrame, pathways: DataFrame, *, aggregate: str = "weighted_median") -> DataFrame:
    """(pathway, celltype, value): gene distances of a pathway aggregated per label, NULL without genes."""
    labels = topology.select("celltype").distinct().agg(F.collect_list("celltype")).scalar()
    grid = pathways.select("pathway").distinct().select("pathway", F.explode(labels).alias("celltype"))
    rows = pathways.join(topology.select("gene", "celltype", "value"), "gene").where(F.col("value").isNotNull())
    found = aggregate_weighted(rows, ["pathway", "celltype"], "value", "weight", aggregate)
    return grid.join(found, ["pathway", "celltype"], "left").select("pathway", "celltype", "value")


def activity_points(reference: DataFrame, activity: DataFrame, *, activity_mode: str = "intrinsic",
                    schedule: Sequence[float] = (0.95, 0.90, 0.80, 0.70, 0.60, 0.50),
                    min_cells: int = 50) -> tuple[DataFrame, DataFrame]:
    """Most active cells per pathway as weighted points, and (pathway, retained_cell_count,
    retained_quantile, activity_mode).

    The first quantile of the positive values (of all values if none is positive) that keeps at least
    ``min_cells`` cells is used. If none does, the ``min_cells`` highest cells are kept, ties by id,
    and the last quantile of the schedule is reported.
    """
    activity = written(activity)
    names = [f"q{i}" for i in range(len(schedule))]
    ends = activity.groupBy("pathway").agg(F.max("value").alias("_max"))
    full = activity.join(ends, "pathway")
    allowed = (F.col("value") > 0) | (F.col("_max") <= 0)
    pool = full.where(allowed)
    if schedule:
        cuts = quantile(pool, ["pathway"], "value", dict(zip(names, schedule)))
    else:
        cuts = pool.select("pathway").distinct()
    full = full.join(cuts, "pathway", "left")
    counts = full.groupBy("pathway").agg(F.count("*").alias("_n"), *[F.sum(((F.col("value") >= F.col(c)) & allowed).cast("long")).alias(f"n_{c}") for c in names],
                                         *[F.first(c).alias(c) for c in names])
    counts = written(counts)
    pick_cut, pick_q = F.lit(None).cast("double"), F.lit(None).cast("double")
    for c, q in reversed(list(zip(names, schedule))):
        enough = F.col(f"n_{c}") >= int(min_cells)
        pick_cut = F.when(enough, F.col(c)).otherwise(pick_cut)
        pick_q = F.when(enough, F.lit(float(q))).otherwise(pick_q)
    chosen = counts.select("pathway", pick_cut.alias("_cut"), pick_q.alias("_q"))
    marked = activity.join(ends, "pathway").join(chosen, "pathway")
    by_cut = marked.where(F.col("_q").isNotNull() & (F.col("value") >= F.col("_cut")) & allowed)
    # too few cells at every quantile: the pathway's highest cells; Spark limits each partition
    # to the wanted number of rows before the rows of a pathway meet
    place = F.row_number().over(Window.partitionBy("pathway").orderBy(F.desc("value"), "cell_id"))
    fallback = marked.where(F.col("_q").isNull()).withColumn("_place", place).where(
        F.col("_place") <= int(min_cells)).select("cell_id", "pathway", "value")
    retained = written(by_cut.select("cell_id", "pathway", "value").unionByName(fallback))
    last = float(schedule[-1]) if schedule else 0.5
    sizes = retained.groupBy("pathway").agg(F.count("*").alias("retained_cell_count"))
    diagnostics = chosen.join(sizes, "pathway", "left").select(
        "pathway", F.coalesce("retained_cell_count", F.lit(0)).alias("retained_cell_count"),
        F.coalesce("_q", F.lit(last)).alias("retained_quantile"), F.lit(activity_mode).alias("activity_mode"))
    points = reference.join(retained, "cell_id").select(
        "cell_id", "x", "y", "celltype", F.col("pathway").alias("entity"), F.col("value").alias("weight"))
    return points, diagnostics


def mode_summary(to_cell: DataFrame, name: str) -> DataFrame:
    """(pathway, <name>_best_celltype, <name>_best_distance): the nearest label, ties by name."""
    best = F.min(F.struct("value", "celltype")).alias("_b")
    return to_cell.where(F.col("value").isNotNull()).groupBy("pathway").agg(best).select(
        "pathway", F.col("_b.celltype").alias(f"{name}_best_celltype"), F.col("_b.value").alias(f"{name}_best_distance"))


def mode_comparison(aggregate: DataFrame, activity: DataFrame, diagnostics: DataFrame, *, primary: str,
                    structure_source: str) -> DataFrame:
    return mode_summary(aggregate, "aggregate").join(mode_summary(activity, "activity"), "pathway", "outer").join(
        diagnostics, "pathway", "left").withColumns({
            "primary_pathway_mode": F.lit(primary), "structure_map_source": F.lit(structure_source)})


def pathway_hotspots(reference: DataFrame, activity: DataFrame, to_cell: DataFrame, diagnostics: DataFrame, *,
                     q: float = 0.9) -> DataFrame:
    """Cells of the pathway nearest to any label whose activity reaches its q quantile."""
    best = to_cell.groupBy("pathway").agg(F.min("value").alias("_d")).where("_d is not null").orderBy(
        "_d", "pathway").limit(1).select("pathway")
    own = activity.join(best, "pathway", "left_semi")
    cut = quantile(own, ["pathway"], "value", {"_cut": float(q)})
    hot = own.join(cut, "pathway").where(F.col("value") >= F.col("_cut"))
    return reference.join(hot, "cell_id").join(diagnostics, "pathway", "left").select(
        "cell_id", "x", "y", "celltype", "pathway", F.col("value").alias("score"), "retained_quantile",
        "retained_cell_count", "activity_mode")
