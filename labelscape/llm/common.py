"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscape.session import written

__all__ = ["columns_of", "give_back", "having", "input_bytes", "lacking", "make_room", "rows_of", "small_batches", "spread", "table", "unused", "written"]

#: Bits of the filter that ``having`` and ``lacking`` hand to every task, whatever the number of keys.
FILTER_BITS = 1 << 24


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts come in batches of at most ``rows`` from here on; Spark's default of 10,000 makes them tens of MB, on both sides
    of the pipe and for every core. A session that has another number keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: decides only how finely work is cut, never what is computed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, bytes_each: int = 8 << 20, least: int = 32, most: int = 1 << 16) -> int:
    """How many shards of about ``bytes_each`` the input makes."""
    return max(least, min(most, input_bytes(df) // bytes_each))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it what no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df`` to select from a table that has more of them, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def rows_of(batches: Iterable[pa.RecordBatch], size: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows, so that few long texts are held as Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


_rooms: dict[str, Callable[[], None]] = {}


def make_room(name: str, empty: Callable[[], None]) -> None:
    """Called by an operator that keeps data in its worker: that of other operators, which the worker served before, goes."""
    others = [other for other in _rooms if other != name]
    for other in others:
        _rooms.pop(other)()
    _rooms[name] = empty
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory to the system, which an idle worker would otherwise hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def among(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that holds for all ``keys`` and few others: a bit for each hash, in a bitmap of FILTER_BITS, kept in pieces of 4 KB."""
    piece = 8 * 4096

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))

    bitmap = written(keys.select(place(F.col(key)).alias("at")).groupBy(F.floor(F.col("at") / piece).alias("piece")).agg(
        F.bitmap_construct_agg(F.col("at") % piece).alias("bits")))
    held = bitmap.agg(F.map_from_entries(F.collect_list(F.struct("piece", "bits")))).scalar()

    def test(column: Column) -> Column:
        at = place(column)
        byte = F.conv(F.hex(F.substring(F.try_element_at(held, F.floor(at / piece)), (F.floor(at % piece / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        return F.coalesce(byte.cast("int").bitwiseAND(F.pow(F.lit(2), (at % 8).cast("int")).cast("int")) != 0, F.lit(False))

    return test


def having(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``keys``; most of the others are told by a filter and never shuffled."""
    return df.where(F.col(key).isNotNull() & among(keys, key)(F.col(key))).join(keys, key, "left_semi")


def lacking(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among ``keys`` or null; most are told by a filter and never shuffled."""
    maybe = F.col(key).isNotNull() & among(keys, key)(F.col(key))
    return df.where(~maybe).unionByName(df.where(maybe).join(keys, key, "left_anti"))
