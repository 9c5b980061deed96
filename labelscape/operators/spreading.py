"""Sums of sparse vectors along edges, and of their products with the vectors they arrive at, without a row for each edge and entry.

Points are dealt to blocks, neighbours in space together where coordinates are given. A block gets its edges, and once each vector that
any of its edges needs; sorted by vector, they stream through the task, which adds entries up before they are shuffled. Up to FEW_EDGES
edges, which are counted, a plain join does the same sooner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscape.operators.nearest import _extent, with_curve_position
from labelscape.session import written

#: Points in a block, and entries added up at once.
BLOCK, ENTRIES = 1024, 2_000_000
FEW_EDGES = 1_000_000


def blocks_of(places: DataFrame, id_col: str, x_col: str = "x", y_col: str = "y") -> DataFrame:
    """(id, _block): points along a space-filling curve in runs of about BLOCK; points without a place are in no run."""
    own = written(places.select(id_col, F.col(x_col).cast("double").alias("x"), F.col(y_col).cast("double").alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")))
    many = own.count()
    if not many:
        return own.select(id_col, F.lit(0).alias("_block"))
    low, high = _extent(own, ["x", "y"])
    placed = with_curve_position(own, ["x", "y"], low, high).repartitionByRange(-(-many // BLOCK), "_z", id_col)
    return written(placed.select(id_col, F.spark_partition_id().alias("_block")))


def vector_sums(rows: DataFrame, edges: DataFrame, *, source: str, keys: list[str], column: str, values: list[str],
                places: DataFrame | None = None) -> DataFrame:
    """(*keys, column, *values): for each key the sums of the vectors of all edges' sources.

    ``rows`` (source, column, *values) are the vectors' entries, ``edges`` has source and keys; an edge that occurs twice counts twice.
    ``places`` (id, x, y) says where the first key's points are; those it lacks, or all, are dealt by hash. The result's rows are unique.
    ``edges`` should be a written table, since it is counted first.
    """
    edges = edges.select(source, *keys)
    many = edges.count()
    if many <= FEW_EDGES:
        return _joined_sums(rows, edges, source, keys, column, values)
    edges = written(_dealt(edges, keys[0], many, _placed(places)))
    stream = _stream(rows, edges, source, keys, column, values).repartition("_block").sortWithinPartitions("_block", source, "_role")
    out = _sums_schema(edges, keys, column, values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edge, vector, _ in _arriving(batches, source):
            if len(edge):
                yield from _added(table, edge, vector, keys, column, values, out)

    sums = stream.mapInArrow(add, out)
    return sums.groupBy(*keys, column).agg(*[F.sum(v).alias(v) for v in values])


def product_sums(rows: DataFrame, partners: DataFrame, edges: DataFrame, *, source: str, keys: list[str], column: str, values: list[str], name: str,
                 places: DataFrame | None = None) -> DataFrame:
    """(name, *keys but the first, *values): over all edges, products of the source's entries with the partners of the first key's point.

    ``partners`` (first key, name, column, *values) meet the entries of the same ``column``; those with one ``name`` are added up. The rest as for
    ``vector_sums``, whose result would be joined to the partners. Here a block gets the partners of its points as well, and a task gives out a row
    for each name and rest of the keys in a batch.
    """
    first, rest = keys[0], keys[1:]
    edges = edges.select(source, *keys)
    partners = partners.select(F.col(first).cast(edges.schema[first].dataType).alias(first), F.col(name).cast("string").alias(name), F.col(column).cast("string").alias(column), *[F.col(v).cast("double").alias(v) for v in values])
    many = edges.count()
    if many <= FEW_EDGES:
        sums = _joined_sums(rows, edges, source, keys, column, values).withColumnsRenamed({v: f"_{v}" for v in values})
        return sums.join(partners, [first, column]).groupBy(name, *rest).agg(*[F.sum(F.col(v) * F.col(f"_{v}")).alias(v) for v in values])
    blocks = _placed(places)
    edges = written(_dealt(edges, first, many, blocks))
    packed = partners.groupBy(first).agg(F.collect_list(F.struct(F.col(name).alias("to"), F.col(column).alias("name"), *[
        F.col(v).alias(f"v{i}") for i, v in enumerate(values)])).alias("_partners"))
    # without a source, and so before the block's vectors and edges
    own = _dealt(packed, first, many, blocks).withColumn("_role", F.lit(-1))
    stream = _stream(rows, edges, source, keys, column, values).unionByName(own, allowMissingColumns=True)
    stream = stream.repartition("_block").sortWithinPartitions("_block", F.col(source).asc_nulls_first(), "_role")
    sums = _sums_schema(edges, keys, column, values)
    out = T.StructType([T.StructField(name, T.StringType()), *[edges.schema[k] for k in rest], *[T.StructField(v, T.DoubleType()) for v in values]])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # partners of the block that is coming in, and of those that began with this batch
        for table, edge, vector, own in _arriving(batches, source):
            held += [own] if own.num_rows else []
            if not len(edge) or not held:
                continue
            known = pa.Table.from_batches(held).combine_chunks()
            meet = _Partners(known, first, len(values))
            for found in _added(table, edge, vector, keys, column, values, sums):
                yield from meet.products(found, column, rest, values, out)
            held = known.filter(pc.greater_equal(known.column("_block"), table.column("_block")[-1])).to_batches()

    return stream.mapInArrow(multiply, out).groupBy(name, *rest).agg(*[F.sum(v).alias(v) for v in values])


def _joined_sums(rows: DataFrame, edges: DataFrame, source: str, keys: list[str], column: str, values: list[str]) -> DataFrame:
    return edges.join(rows, source).groupBy(*keys, column).agg(*[F.sum(F.col(v).cast("double")).alias(v) for v in values])


def _placed(places: DataFrame | None) -> DataFrame | None:
    return None if places is None else blocks_of(places, places.columns[0])


def _dealt(df: DataFrame, first: str, many: int, blocks: DataFrame | None) -> DataFrame:
    """With ``_block``, that of the point ``first`` or, where it has none, one by hash."""
    spread = F.pmod(F.xxhash64(first), F.lit(max(1, many // (8 * BLOCK)))).cast("int")
    if blocks is None:
        return df.withColumn("_block", spread)
    return df.join(blocks.select(F.col(blocks.columns[0]).alias(first), "_block"), first, "left").withColumn(
        "_block", F.coalesce("_block", -1 - spread))


def _stream(rows: DataFrame, edges: DataFrame, source: str, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """A block's edges (role 1), and once each vector that any of them needs (role 0)."""
    packed = rows.groupBy(source).agg(F.collect_list(F.struct(F.col(column).cast("string").alias("name"), *[
        F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])).alias("_entries"))
    kind = packed.schema["_entries"].dataType
    needed = edges.select("_block", source).distinct().join(packed, source)
    return needed.select("_block", source, F.lit(0).alias("_role"), "_entries", *[
        F.lit(None).cast(edges.schema[k].dataType).alias(k) for k in keys if k != source]).unionByName(
        edges.select("_block", source, F.lit(1).alias("_role"), F.lit(None).cast(kind).alias("_entries"), *[k for k in keys if k != source]))


def _sums_schema(edges: DataFrame, keys: list[str], column: str, values: list[str]) -> T.StructType:
    return T.StructType([*[edges.schema[k] for k in keys], T.StructField(column, T.StringType()), *[
        T.StructField(v, T.DoubleType()) for v in values]])


def _arriving(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(rows, places of edges in them, places of the edges' vectors, rows of partners) for every batch."""
    held = None  # the vector whose edges may go on in the next batch
    for batch in batches:
        partner = batch.column(batch.schema.get_field_index("_role")).to_numpy() < 0
        own = batch.slice(0, 0)
        if partner.any():
            own, batch = batch.filter(pa.array(partner)), batch.filter(pa.array(~partner))
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not table.num_rows:
            yield table, np.zeros(0, np.int64), np.zeros(0, np.int64), own
            continue
        role = table.column("_role").to_numpy()
        block, names = table.column("_block").to_numpy(), table.column(source).to_numpy()
        at = np.arange(len(role))
        latest = np.maximum.accumulate(np.where(role == 0, at, -1))
        fresh = np.concatenate([[True], (block[1:] != block[:-1]) | (names[1:] != names[:-1])])
        begins = np.maximum.accumulate(np.where(fresh, at, 0))
        edge = np.flatnonzero((role == 1) & (latest >= begins))
        held = table.slice(int(latest[-1]), 1).to_batches()[0] if latest[-1] >= begins[-1] else None
        yield table, edge, latest[edge], own


class _Partners:
    """Partners by point and name, as sorted arrays."""

    def __init__(self, rows: pa.Table, first: str, values: int):
        lists = rows.column("_partners").combine_chunks()
        entries, offsets = lists.flatten(), lists.offsets.to_numpy()
        coded, to = entries.field("name").dictionary_encode(), entries.field("to").dictionary_encode()
        self.points, self.names, self.to = rows.column(first).combine_chunks(), coded.dictionary, to.dictionary
        own = np.repeat(np.arange(len(self.points)), np.diff(offsets)) * max(1, len(self.names)) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(own, kind="stable")
        self.keys, self.codes = own[order], to.indices.to_numpy(zero_copy_only=False)[order]
        self.values = [entries.field(f"v{i}").to_numpy(zero_copy_only=False)[order] for i in range(values)]

    def products(self, sums: pa.RecordBatch, column: str, rest: list[str], values: list[str], out: T.StructType) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([sums])
        point, name = (pc.index_in(table.column(c).combine_chunks(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                       for c, known in ((sums.schema.names[0], self.points), (column, self.names)))
        row = np.flatnonzero((point >= 0) & (name >= 0))
        wanted = point[row] * max(1, len(self.names)) + name[row]
        begin = np.searchsorted(self.keys, wanted, side="left")
        many = np.searchsorted(self.keys, wanted, side="right") - begin
        if not many.sum():
            return
        entry = np.repeat(begin - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        row = np.repeat(row, many)
        code = np.zeros(table.num_rows, np.int64)
        for k in rest:
            part = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            code = code * (int(part.max()) + 1) + part
        code = np.unique(code, return_inverse=True)[1]
        pairs, at, place = np.unique(code[row] * len(self.to) + self.codes[entry], return_index=True, return_inverse=True)
        labels = table.select(rest).take(pa.array(row[at]))
        yield pa.RecordBatch.from_arrays(
            [self.to.take(pa.array(self.codes[entry[at]])), *[c.combine_chunks() for c in labels.columns],
             *[pa.array(np.bincount(place, table.column(v).to_numpy()[row] * mine[entry], len(pairs))) for v, mine in zip(values, self.values)]], names=out.names)


def _added(table: pa.Table, edge: np.ndarray, vector: np.ndarray, keys: list[str], column: str, values: list[str],
           out: T.StructType) -> Iterator[pa.RecordBatch]:
    """Sums over some edges of one batch, so many at a time that few entries are held."""
    lists = table.column("_entries").combine_chunks()
    entries, starts = lists.values, lists.offsets.to_numpy()
    sizes = np.diff(starts)[vector]
    coded = entries.field("name").dictionary_encode()
    names, numbers = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    amounts = [entries.field(f"v{i}").to_numpy(zero_copy_only=False) for i in range(len(values))]
    key, code = table.select(keys).take(pa.array(edge)), np.zeros(len(edge), np.int64)
    for k in keys:
        part = key.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        code = np.unique(code * (int(part.max()) + 1) + part, return_inverse=True)[1]
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), ENTRIES), side="right").tolist() + [len(edge)]
    for a, b in zip([0, *cuts[1:-1]], cuts[1:]):
        size = sizes[a:b]
        where = np.repeat(starts[vector[a:b]] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        pairs, first, place = np.unique(np.repeat(code[a:b], size) * max(1, len(names)) + numbers[where], return_index=True, return_inverse=True)
        if not len(pairs):
            continue
        owner = np.repeat(np.arange(a, b), size)[first]
        yield pa.RecordBatch.from_arrays([
            *[c.combine_chunks() for c in key.take(pa.array(owner)).columns], names.take(pa.array(numbers[where][first])),
            *[pa.array(np.bincount(place, v[where], len(pairs))) for v in amounts]], names=out.names)
