"""Point, reference and expression tables: validation and coercion to one shape.

A *reference* table has ``cell_id, x, y, celltype``; an *expression* table is long and sparse,
``cell_id, gene, value``, absent rows meaning 0; a *matrix* is long, ``source, target, value``.
Missing numbers are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscape.functions.normalize import number


def require(df: DataFrame, columns: list[str], what: str = "the table") -> None:
    """Stop if a column that is needed is not there."""
    absent = [c for c in dict.fromkeys(columns) if c not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks {', '.join(absent)}; it has {', '.join(df.columns)}")


def one_of(what: str, value: str, allowed) -> None:
    """Stop if an option has a value that is not known."""
    if value not in allowed:
        raise ValueError(f"{what}={value!r} is unknown; use one of {tuple(allowed)}")


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def coerce_reference(df: DataFrame, *, cell_id_col: str = "cell_id", x_col: str = "x", y_col: str = "y",
                     celltype_col: str = "celltype", order_col: str | None = None) -> DataFrame:
    """``cell_id, x, y, celltype`` with text ids and labels.

    A table without ids gets ``cell_0, cell_1, ...`` and then needs ``order_col``, because rows of
    a distributed table have no order of their own.
    """
    if celltype_col not in df.columns:
        raise ValueError(f"the reference has no label column {celltype_col}; it has {df.columns}")
    require(df, [x_col, y_col], "reference")
    if cell_id_col not in df.columns:
        if order_col is None:
            raise ValueError(f"reference needs {cell_id_col!r} or an order_col to number its rows by")
        df = df.withColumn(cell_id_col, F.concat(F.lit("cell_"), _row_position(df, order_col)))
    return df.select(
        F.col(cell_id_col).cast("string").alias("cell_id"),
        F.col(x_col).cast("double").alias("x"), F.col(y_col).cast("double").alias("y"),
        F.col(celltype_col).cast("string").alias("celltype"))


def _row_position(df: DataFrame, order_col: str) -> F.Column:
    """0-based position; ``order_col`` is assumed unique."""
    return (F.row_number().over(Window.orderBy(order_col)) - 1).cast("string")


def coerce_expression(df: DataFrame, reference: DataFrame | None = None, *, genes: DataFrame | None = None,
                      cell_id_col: str = "cell_id", gene_col: str = "gene", value_col: str = "value") -> DataFrame:
    """``cell_id, gene, value`` for the reference's cells (and the given genes); text counts as 0."""
    require(df, [cell_id_col, gene_col, value_col], "expression")
    out = df.select(F.col(cell_id_col).cast("string").alias("cell_id"),
                    F.col(gene_col).cast("string").alias("gene"), number(value_col).alias("value"))
    out = out.where((F.col("value") != 0) & F.col("gene").isNotNull())
    if genes is not None:
        out = out.join(genes.select(F.col(genes.columns[0]).cast("string").alias("gene")).distinct(),
                       "gene", "left_semi")
    if reference is not None:
        out = out.join(reference.select("cell_id"), "cell_id", "left_semi")
    return out


def wide_to_long(df: DataFrame, id_col: str, *, row: str, column: str, value: str = "value") -> DataFrame:
    """One row per (row, column) of a wide matrix; non-numbers become NULL."""
    names = [c for c in df.columns if c != id_col]
    cells = [F.struct(F.lit(c).alias(column), number(F.col(f"`{c}`").cast("string"), None).alias(value))
             for c in names]
    return df.select(F.col(id_col).cast("string").alias(row), F.inline(F.array(*cells)))


def dense(reference: DataFrame, genes: DataFrame, expression: DataFrame) -> DataFrame:
    """Every (cell, gene) with its value or 0, for the genes given (a dictionary-sized list)."""
    names = genes.agg(F.collect_set(F.col(genes.columns[0]))).scalar()
    grid = reference.select("cell_id", F.explode(names).alias("gene"))
    return grid.join(expression, ["cell_id", "gene"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0)))
