"""Running numbers over a whole table without bringing it together, and bijections of such numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscape.session import written

_ROW_BITS = 33


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """``df`` with a number from 0 in the given order. Ranges of rows are sorted apart; only their sizes, a row each, meet in one task.

    The table is written, so every later use sees the same numbers.
    """
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(starts), part == F.col("_part")).withColumn(
        name, F.col("_before") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_at", "_part", "_before")


def dealt(numbers: np.ndarray, total: int, seed: int) -> np.ndarray:
    """A permutation of 0 ... total - 1, told for single numbers without a table of all.

    Four rounds of a keyed network mix the halves of the number's bits; what falls outside is mixed again until it is inside.
    """
    bits = max(2, (total - 1).bit_length())
    low = bits // 2
    high = bits - low
    keys = np.random.default_rng(seed).integers(1, 1 << 63, 4, np.uint64) | np.uint64(1)
    out = np.array(numbers, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> np.uint64(low), out[todo] & np.uint64((1 << low) - 1)
        for i, key in enumerate(keys):
            one, width = (b, high) if i % 2 == 0 else (a, low)
            mixed = (one + key) * key
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed >> np.uint64(32)) & np.uint64((1 << width) - 1)
            if i % 2 == 0:
                a = a ^ mixed
            else:
                b = b ^ mixed
        out[todo] = a << np.uint64(low) | b
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)
