"""Ligand-receptor scores, top pairs, hotspots and downstream target consistency."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscape.functions.normalize import geometric_mean, number, scale_to_unit, winsor_limits, winsorised
from labelscape.functions.quantiles import quantile
from labelscape.operators.anchors import Anchors
from labelscape.operators.contact import zero_completed
from labelscape.session import written
from labelscape.sources.points import require

SCORE_COLUMNS = (
    "ligand", "receptor", "sender_celltype", "receiver_celltype", "anchor_source_ligand",
    "anchor_source_receptor", "structure_map_source", "sender_anchor", "receiver_anchor", "structure_bridge",
    "sender_expr", "receiver_expr", "local_contact", "contact_strength_raw", "contact_strength_normalized",
    "contact_coverage", "cross_edge_count", "prior_confidence", "LR_score",
)


def standard_pairs(pairs: DataFrame, *, ligand_col: str = "ligand", receptor_col: str = "receptor",
                   prior_col: str | None = "evidence_weight") -> DataFrame:
    """(pair_id, ligand, receptor, prior_confidence); repeated pairs stay apart."""
    if ligand_col not in pairs.columns or receptor_col not in pairs.columns:
        raise ValueError(f"no ligand or receptor column ({ligand_col}, {receptor_col}) among {pairs.columns}")
    prior = F.lit(1.0)
    if prior_col is not None and prior_col in pairs.columns:
        prior = number(prior_col)
    out = pairs.select(F.col(ligand_col).cast("string").alias("ligand"),
                       F.col(receptor_col).cast("string").alias("receptor"), prior.alias("prior_confidence"))
    copy = F.row_number().over(Window.partitionBy("ligand", "receptor").orderBy("prior_confidence"))
    out = out.withColumn("pair_id", F.concat_ws("|", "ligand", "receptor", copy.cast("string")))
    if prior_col is not None and prior_col in pairs.columns:
        out = scale_to_unit(written(out), "prior_confidence")
    return out


def pair_scores(pairs: DataFrame, anchors: Anchors, summary: DataFrame, contact: DataFrame) -> DataFrame:
    """Geometric mean of six components times the prior, for every pair, sender and receiver."""
    near = F.least(F.greatest(1 - F.coalesce("value", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    anchor = anchors.topology.select("gene", "celltype", near.alias("anchor"), F.col("source").alias("origin"))
    level = summary.select("gene", "celltype", F.col("normalized").alias("expr"))
    side = written(anchor.join(level, ["gene", "celltype"], "left").withColumn("expr", F.coalesce("expr", F.lit(0.0))))
    sender = side.select(F.col("gene").alias("ligand"), F.col("celltype").alias("sender"),
                         F.col("anchor").alias("sender_anchor"), F.col("expr").alias("sender_expr"),
                         F.col("origin").alias("anchor_source_ligand"))
    receiver = side.select(F.col("gene").alias("receptor"), F.col("celltype").alias("receiver"),
                           F.col("anchor").alias("receiver_anchor"), F.col("expr").alias("receiver_expr"),
                           F.col("origin").alias("anchor_source_receptor"))
    bridge = anchors.structure.select(F.col("row").alias("sender"), F.col("col").alias("receiver"),
                                      (1 - F.col("value")).alias("structure_bridge"))
    full = pairs.join(contact, "pair_id").join(sender, ["ligand", "sender"]).join(
        receiver, ["receptor", "receiver"]).join(bridge, ["sender", "receiver"])
    parts = ["sender_anchor", "receiver_anchor", "structure_bridge", "sender_expr", "receiver_expr", "local_contact"]
    full = full.withColumn("LR_score", geometric_mean([F.col(p) for p in parts]) * F.col("prior_confidence"))
    full = full.withColumn("structure_map_source", F.lit(anchors.structure_source))
    full = full.withColumnsRenamed({"sender": "sender_celltype", "receiver": "receiver_celltype"})
    return full.select("pair_id", *SCORE_COLUMNS)


def ranked(scores: DataFrame) -> DataFrame:
    """Best first; equal scores by pair, sender and receiver."""
    return scores.orderBy(F.desc("LR_score"), "pair_id", "sender_celltype", "receiver_celltype")


def top_pairs(scores: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` pairs with the highest score anywhere: (lr_pair, best_score)."""
    pair = F.concat("ligand", F.lit("→"), "receptor")
    return scores.groupBy(pair.alias("lr_pair")).agg(F.max("LR_score").alias("best_score")).orderBy(
        F.desc("best_score"), "lr_pair").limit(int(n))


def summary_matrix(scores: DataFrame, n: int = 12) -> DataFrame:
    """(lr_pair, sender_receiver, value) of the top pairs; absent combinations are 0 in a pivot."""
    named = scores.select(F.concat("ligand", F.lit("→"), "receptor").alias("lr_pair"),
                          F.concat("sender_celltype", F.lit("→"), "receiver_celltype").alias("sender_receiver"), "LR_score")
    return named.join(top_pairs(scores, n).select("lr_pair"), "lr_pair", "left_semi").groupBy(
        "lr_pair", "sender_receiver").agg(F.max("LR_score").alias("value"))


def hotspots(scores: DataFrame, expression: DataFrame, reference: DataFrame, *, q: float = 0.9) -> DataFrame:
    """Cells of the best row's sender and receiver labels whose scaled expression reaches its q quantile."""
    best = ranked(scores).limit(1).select("ligand", "receptor", "sender_celltype", "receiver_celltype")
    roles = best.select("*", F.inline(F.array(
        F.struct(F.lit("sender").alias("role"), F.col("ligand").alias("feature"), F.col("sender_celltype").alias("_label")),
        F.struct(F.lit("receiver").alias("role"), F.col("receptor").alias("feature"), F.col("receiver_celltype").alias("_label")))))
    roles = written(roles)
    genes = roles.select(F.col("feature").alias("gene")).distinct()
    values = written(expression.join(genes, "gene", "left_semi"))
    counted = zero_completed(values, genes, reference.agg(F.count("*")).scalar())
    limits = written(winsor_limits(counted, ["gene"], "value", freq="n"))
    scaled = counted.join(limits, "gene").withColumn("score", winsorised(F.col("value")))
    cut = quantile(scaled, ["gene"], "score", {"cut": float(q)}, freq="n")
    cells = reference.join(roles, reference["celltype"] == roles["_label"]).withColumn("gene", F.col("feature"))
    cells = cells.join(values.select("cell_id", "gene", "value"), ["cell_id", "gene"], "left").join(
        limits, "gene").join(cut, "gene")
    cells = cells.withColumn("score", winsorised(F.coalesce("value", F.lit(0.0)))).where("score >= cut")
    return cells.select("cell_id", "x", "y", "celltype", "role", "feature", "score", "sender_celltype",
                        "receiver_celltype", "ligand", "receptor")


def long_weights(spark: SparkSession, mapping: Mapping, outer: str, inner: str, weight: str) -> DataFrame:
    """Table form of {outer: [inner, ...]} or {outer: {inner: weight}}."""
    rows = [(str(o), str(i), float(w)) for o, members in mapping.items()
            for i, w in (members.items() if isinstance(members, Mapping) else ((m, 1.0) for m in members))]
    return spark.createDataFrame(rows, f"`{outer}` string, `{inner}` string, `{weight}` double")


def _weight(df: DataFrame, column: str) -> F.Column:
    return number(column, 1.0) if column in df.columns else F.lit(1.0)


def target_consistency(scores: DataFrame, signatures: DataFrame | Mapping, prior: DataFrame, *,
                       ligand_col: str = "ligand", receiver_col: str = "receiver_celltype",
                       target_col: str = "target", prior_weight_col: str = "weight",
                       signature_gene_col: str = "gene", signature_weight_col: str = "score") -> DataFrame:
    """Scores plus the share of a ligand's prior targets found in the receiver's signature."""
    if not {ligand_col, receiver_col, "LR_score"} <= set(scores.columns):
        raise ValueError(f"scores lack one of {ligand_col}, {receiver_col}, LR_score; they have {scores.columns}")
    require(prior, [ligand_col, target_col], "prior")
    if isinstance(signatures, Mapping):
        signatures = long_weights(scores.sparkSession, signatures, receiver_col, signature_gene_col, signature_weight_col)
    require(signatures, [receiver_col, signature_gene_col], "signatures")
    targets = prior.select(F.col(ligand_col).cast("string").alias("_l"), F.col(target_col).cast("string").alias("_g"),
                           _weight(prior, prior_weight_col).alias("_w"))
    targets = targets.groupBy("_l", "_g").agg(F.sum("_w").alias("_w"))
    whole = targets.groupBy("_l").agg(F.sum("_w").alias("_total"))
    known = signatures.select(F.col(receiver_col).cast("string").alias("_r"),
                              F.col(signature_gene_col).cast("string").alias("_g"),
                              _weight(signatures, signature_weight_col).alias("_s"))
    overlap = targets.join(known, "_g").groupBy("_l", "_r").agg(F.sum(F.col("_w") * F.col("_s")).alias("_hit"))
    overlap = overlap.join(whole, "_l").withColumn(
        "_support", F.col("_hit") / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total")))
    out = scores.join(overlap.select("_l", "_r", "_support"),
                      (F.col(ligand_col) == F.col("_l")) & (F.col(receiver_col) == F.col("_r")), "left")
    out = out.withColumn("target_support", F.coalesce("_support", F.lit(0.0))).drop("_l", "_r", "_support")
    out = scale_to_unit(written(out), "target_support")
    return out.withColumns({
        "topology_supported": F.col("LR_score").cast("double"), "target_supported": F.col("target_support"),
        "topology_and_target_supported": F.sqrt(F.col("LR_score") * F.col("target_support"))})
