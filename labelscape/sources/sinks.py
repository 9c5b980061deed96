"""Writing results: tables as parquet or CSV, matrices as wide CSV with a row-label column."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def write_table(df: DataFrame, path: str, *, mode: str = "overwrite") -> str:
    """Folder of part files; the format follows the path's suffix. Errors are raised, not hidden."""
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).option("header", True).csv(path)
    return path


def wide(matrix: DataFrame, row: str, column: str, *, value: str = "value", fill: float | None = None) -> DataFrame:
    """One row per label; the labels of the other axis, a dictionary-sized list, become columns."""
    out = matrix.groupBy(row).pivot(column, _names(matrix, column)).agg(F.max(value)).orderBy(row)
    return out if fill is None else out.fillna(fill)


def _names(matrix: DataFrame, column: str) -> list:
    return [r[0] for r in matrix.select(column).distinct().orderBy(column).toLocalIterator()]


def line(fields: list) -> str:
    """Fields as a line of CSV text; null is nothing."""
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(["" if x is None else repr(x) if isinstance(x, float) else x for x in fields])
    return out.getvalue()


def write_matrix_csv(matrix: DataFrame, path: str, row: str, column: str, *, value: str = "value",
                     fill: float | None = None) -> str:
    """A folder of wide CSV files, each with the header; a row's values are put in a line by its task, so any number of labels will do."""
    names = _names(matrix, column)
    place = {name: i for i, name in enumerate(names)}
    header = line([row, *names])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            out = [header] if first else []
            for label, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values: list = [fill] * len(names)
                for e in entries:
                    values[place[e["k"]]] = fill if e["v"] is None else e["v"]
                out.append(line([label, *values]))
            first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    cells = matrix.groupBy(row, column).agg(F.max(value).alias("_v"))
    rows = cells.groupBy(row).agg(F.collect_list(F.struct(F.col(column).alias("k"), F.col("_v").alias("v"))).alias("_e"))
    rows.orderBy(row).mapInArrow(lines, "value string").write.mode("overwrite").text(path)
    return path


def read_lines(spark: SparkSession, path: str, *, row: str, column: str) -> DataFrame:
    """(row, column, value) of a wide CSV file or folder of such; the first column holds the row labels, empty fields are NULL."""
    text = spark.read.text(path)
    header = next(iter(text.head(1)), [""])[0]  # each file begins with it
    names = next(csv.reader([header]), [""])[1:]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fields in csv.reader(x for x in batch.column(0).to_pylist() if x and x != header):
                yield pa.RecordBatch.from_arrays([pa.array([fields[0] or None] * len(names), pa.string()), pa.array(names, pa.string()),
                                                  pa.array([x or None for x in fields[1:len(names) + 1]], pa.string())], [row, column, "value"])

    return text.mapInArrow(entries, f"`{row}` string, `{column}` string, value string")
