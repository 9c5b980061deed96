"""Nearest-neighbour joins: every point against the nearest point of every label, and k nearest.

Two exact plans with the same result:

``broadcast``
    Used when the target points, counted first, are at most ``broadcast_rows``. They travel to
    every task once; sources never shuffle for the search itself.

``packed``
    Used beyond that bound. Both sides are range-partitioned along a space-filling curve and cut
    into blocks of bounded size with bounding boxes, so a hot label, a dense region or a pile of
    equal coordinates spreads over as many blocks as it needs. Only block *summaries* are joined
    first, top-down from one root, dropping a pair as soon as its smallest possible distance
    exceeds the best guaranteed one for that source block and label. Then every group of source
    blocks receives each needed target block once, sorted by label, and one streaming pass per
    partition folds them into the running minimum, holding one label at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscape.functions import geometry as geo
from labelscape.session import written

BROADCAST_ROWS = 200_000
FEW_TARGETS = 30_000
FEW_BYTES = 16 << 20
SOURCE_BLOCK = 1024
TARGET_BLOCK = 256
FANOUT_BITS = 3
GROUP_BITS = 6
FOLD_ROWS = 500_000
AXES = ("_c0", "_c1", "_c2")
SEPARATOR = "\u001f"  # between the ``by`` value and the label inside ``target`` keys


def nearest_per_label(
    sources: DataFrame,
    targets: DataFrame,
    coords: list[str],
    label: str,
    *,
    by: str | None = None,
    factor: str | None = None,
    strategy: str = "auto",
    broadcast_rows: int = BROADCAST_ROWS,
    spread: bool = True,
) -> DataFrame:
    """Each source row once per target label, with ``target`` and the smallest ``dist``.

    A point is its own legal neighbour. Rows with a missing coordinate or label are ignored.
    ``by`` names a column of both sides (a sample, say) within which points may meet.
    ``factor`` names a target column that scales the distance to that target. ``spread`` hashes
    the sources over the shuffle partitions first; pass False when they are many and balanced.
    """
    targets = _targets(targets, coords, label, factor, by)
    sources = _complete(sources, coords)
    if by is not None:
        sources = sources.where(F.col(by).isNotNull())
    if strategy not in {"auto", "broadcast", "packed"}:
        raise ValueError(f"no search plan {strategy!r}; there are auto, broadcast and packed")
    if strategy != "packed":
        table, targets = _if_few(targets, broadcast_rows)
        if table is not None:
            return _broadcast_nearest(sources, table, coords, factor, spread, by)
    return _packed_join(sources, targets, coords, factor=factor, by=by)


def nearest_sums(sources: DataFrame, targets: DataFrame, coords: list[str], label: str, *, by: str | None = None,
                 strategy: str = "auto", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """([by], source, target, n, nd, w, wd): the search's result added up where it is found.

    ``sources`` has ``source``, ``n`` and ``w``; ``nd`` and ``wd`` are the sums of the smallest distances times those. A task gives a row
    for each pair of labels in a batch and not one for each source point and label.
    """
    targets = _targets(targets, coords, label, None, by)
    names = [*([by] if by else []), "source", "n", "w", *coords]
    sources = _complete(sources, coords).select(*[
        F.col(c).cast({"n": "long", "w": "double", "source": "string"}[c]).alias(c) if c in {"n", "w", "source"} else F.col(c) for c in names])
    if by is not None:
        sources = sources.where(F.col(by).isNotNull())
    if strategy not in {"auto", "broadcast", "packed"}:
        raise ValueError(f"no search plan {strategy!r}; there are auto, broadcast and packed")
    if strategy != "packed":
        table, targets = _if_few(targets, broadcast_rows)
        if table is not None:
            return _broadcast_nearest(sources, table, coords, None, True, by, _Totals)
    return _packed_join(sources, targets, coords, by=by, total=_Totals)


def cheapest(sources: DataFrame, targets: DataFrame, coords: list[str], label: str, *, factor: str, strategy: str = "auto",
             broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(source, target, cost): the least ``scale`` times scaled distance from a source's points to a label's points.

    ``sources`` has ``source`` and ``scale``. A task gives a row for each source and label in a batch, and within the batch a source's points
    share their bound: a point looks on only where it could undercut the cheapest pair so far.
    """
    targets = _targets(targets, coords, label, factor, None)
    sources = _complete(sources, coords).select(
        F.col("source").cast("string").alias("source"), F.col("scale").cast("double").alias("scale"), *coords)
    if strategy not in {"auto", "broadcast", "packed"}:
        raise ValueError(f"no search plan {strategy!r}; there are auto, broadcast and packed")
    if strategy != "packed":
        table, targets = _if_few(targets, broadcast_rows)
        if table is not None:
            return _broadcast_nearest(sources, table, coords, factor, True, None, _Cheapest)
    return _packed_join(sources, targets, coords, factor=factor, total=_Cheapest)


class _Cheapest:
    """The least cost of each source among the rows of one batch."""

    def __init__(self, batch: pa.RecordBatch, by: str | None):
        index = batch.schema.get_field_index
        coded = batch.column(index("source")).dictionary_encode(null_encoding="encode")
        self.names, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.scale = batch.column(index("scale")).to_numpy(zero_copy_only=False)

    @staticmethod
    def schema(fields, by: str | None) -> T.StructType:
        return T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("cost", T.DoubleType())])

    def least(self, best: np.ndarray) -> np.ndarray:
        out = np.full(len(self.names), np.inf)
        np.minimum.at(out, self.codes, best * self.scale)
        return out

    def lower(self, xyz, starts, low, high, cloud: geo.TargetCloud, best: np.ndarray) -> None:
        geo.lower_to_likely(xyz, cloud, best)
        # no row may be cut to below what its source has, so the slack keeps the cheapest row's own distance
        bound = np.full(len(best), np.inf)
        np.divide(self.least(best)[self.codes] * geo.SLACK, self.scale, out=bound, where=self.scale > 0)
        np.minimum(best, bound, out=best)
        geo.lower_to_nearest(xyz, starts, low, high, cloud, best)

    def rows(self, target: str, best: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.names, pa.repeat(target, len(self.names)), pa.array(self.least(best))],
                                          ["source", "target", "cost"])


class _Totals:
    """Sums over the rows of one batch of sources, which all have one ``by`` value."""

    def __init__(self, batch: pa.RecordBatch, by: str | None):
        index = batch.schema.get_field_index
        coded = batch.column(index("source")).dictionary_encode()
        self.names, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.mass = [batch.column(index(c)).to_numpy(zero_copy_only=False) for c in ("n", "w")]
        self.by = None if by is None else (by, batch.column(index(by)).slice(0, 1))

    @staticmethod
    def schema(fields, by: str | None) -> T.StructType:
        kinds = [("source", T.StringType()), ("target", T.StringType()), ("n", T.LongType()), *[(c, T.DoubleType()) for c in ("nd", "w", "wd")]]
        own = [f for f in fields if f.name == by] if by else []
        return T.StructType([*own, *[T.StructField(name, kind) for name, kind in kinds]])

    def lower(self, xyz, starts, low, high, cloud: geo.TargetCloud, best: np.ndarray) -> None:
        geo.lower_to_nearest(xyz, starts, low, high, cloud, best)

    def rows(self, target: str, dist: np.ndarray) -> pa.RecordBatch:
        n, w = self.mass
        k = len(self.names)
        sums = [np.bincount(self.codes, x, k) for x in (n, n * dist, w, w * dist)]
        columns = [self.names, pa.repeat(target, k), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])]
        names = ["source", "target", "n", "nd", "w", "wd"]
        if self.by is not None:
            columns.insert(0, self.by[1].take(pa.array(np.zeros(k, np.int64))))
            names.insert(0, self.by[0])
        return pa.RecordBatch.from_arrays(columns, names)


def k_nearest(
    points: DataFrame,
    coords: list[str],
    id_col: str,
    k: int,
    *,
    strategy: str = "auto",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The ``k`` nearest other points of every point: (id, neighbor, rank, dist).

    Order is distance, then neighbour id; ids must be unique whole numbers. Of equal places the ``k + 1`` lowest ids are targets: with
    the point itself among them, no other copy can be one of its nearest.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    points = _complete(points, coords).select(F.col(id_col).cast("long").alias(id_col), *coords)
    targets = points.select(
        F.lit(SEPARATOR).alias("target"),
        *[F.col(c).cast("double").alias(a) for c, a in zip(coords, AXES)],
        F.col(id_col).alias("_tid"),
    )
    place = F.row_number().over(Window.partitionBy(*AXES[:len(coords)]).orderBy("_tid"))
    targets = targets.withColumn("_copy", place).where(F.col("_copy") <= k + 1).drop("_copy")
    if strategy != "packed":
        table, targets = _if_few(targets, broadcast_rows)
        if table is not None:
            return _broadcast_k_nearest(points, table, coords, id_col, k)
    return _packed_join(points, targets, coords, k=k, id_col=id_col)


def _if_few(targets: DataFrame, bound: int) -> tuple[pa.Table | None, DataFrame]:
    """The targets if they are few enough to be sent to every task, else None and the targets written once.

    Where the optimizer expects few bytes, no more than the bound and one row are asked for at once. Else they are written and counted
    first, so that nothing is gathered before it is known to be small.
    """
    if int(str(targets._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= FEW_BYTES:
        table = targets.limit(bound + 1).toArrow()
        if table.num_rows <= bound:
            return table, targets
    targets = written(targets)
    return (targets.toArrow() if targets.count() <= bound else None), targets


def _complete(df: DataFrame, coords: list[str]) -> DataFrame:
    for c in coords:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def _targets(targets: DataFrame, coords, label, factor, by) -> DataFrame:
    """Distinct target coordinates per label; equal copies collapse before anything moves."""
    targets = _complete(targets, coords).where(F.col(label).isNotNull())
    within = F.lit("")
    if by is not None:
        targets = targets.where(F.col(by).isNotNull())
        within = F.col(by).cast("string")
    keys = [F.concat(within, F.lit(SEPARATOR), F.col(label).cast("string")).alias("target")]
    keys += [F.col(c).cast("double").alias(a) for c, a in zip(coords, AXES)]
    if factor is None:
        return targets.select(*keys).distinct()
    return targets.groupBy(*keys).agg(F.min(factor).alias("_factor"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _source_matrix(batch: pa.RecordBatch, coords: list[str]) -> np.ndarray:
    columns = [batch.column(batch.schema.get_field_index(c)) for c in coords]
    return np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1)


# --------------------------------------------------------------------------- broadcast plan


def _clouds(table: pa.Table, dims: int, factor: bool, ids: bool) -> list[tuple]:
    """(label, coordinates, factors, ids) per label, as plain arrays."""
    labels = np.asarray(table.column("target").to_pandas(), dtype=object)
    xyz = np.stack([table.column(AXES[i]).to_numpy() for i in range(dims)], axis=1)
    scale = table.column("_factor").to_numpy() if factor else None
    tid = table.column("_tid").to_numpy() if ids else None
    names, codes = np.unique(labels.astype(str), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[order], np.arange(len(names) + 1))
    clouds = []
    for i, name in enumerate(names):
        rows = order[edges[i]:edges[i + 1]]
        rows = rows[geo.morton_order(xyz[rows])]
        clouds.append((str(name), xyz[rows], None if scale is None else scale[rows],
                       None if tid is None else tid[rows]))
    return clouds


def _ready(clouds: list[tuple]) -> list[tuple[str, geo.TargetCloud]]:
    return [(name, geo.TargetCloud(xyz, geo.chunk_starts(len(xyz), geo.TARGET_CHUNK), tid, scale))
            for name, xyz, scale, tid in clouds]


def _rows_by(batch: pa.RecordBatch, by: str | None) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The batch split by its ``by`` value."""
    if by is None:
        yield "", batch
        return
    names = batch.column(batch.schema.get_field_index(by)).cast(pa.string()).dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    for code, name in enumerate(names.dictionary.to_pylist()):
        yield name, batch.take(pa.array(np.flatnonzero(codes == code)))


def _along_curve(sources: DataFrame, table: pa.Table, coords: list[str], *spread: str) -> DataFrame:
    """The sources in shuffle partitions, by hash or, against many targets, by region: a batch from one region rules out most of them at once."""
    if table.num_rows <= FEW_TARGETS:
        return sources.repartition(_partitions(sources), *spread)
    low, high = _table_extent(table, len(coords))
    return with_curve_position(sources, coords, low, high).repartitionByRange(
        _partitions(sources), "_z", *spread).sortWithinPartitions("_z").drop("_z")


def _broadcast_nearest(sources, table, coords, factor, spread, by, total: type | None = None) -> DataFrame:
    spark = sources.sparkSession
    clouds = spark.sparkContext.broadcast(_clouds(table, len(coords), factor is not None, False))
    if spread:
        sources = _along_curve(sources, table, coords, *coords)
    fields = sources.schema.fields

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, list] = {}
        for key, cloud in _ready(clouds.value):
            within, _, name = key.partition(SEPARATOR)
            ready.setdefault(within, []).append((name, cloud))
        for whole in batches:
            for within, batch in _rows_by(whole, by):
                if not batch.num_rows:
                    continue
                xyz = _source_matrix(batch, coords)
                order = geo.morton_order(xyz)
                xyz, batch = xyz[order], batch.take(pa.array(order))
                starts = geo.chunk_starts(len(xyz), geo.SOURCE_CHUNK)
                low, high = geo.chunk_bounds(xyz, starts)
                names = [*batch.schema.names, "target", "dist"]
                totals = total(batch, by) if total else None
                for name, cloud in ready.get(within, []):
                    best = np.full(len(xyz), np.inf)
                    if total:
                        totals.lower(xyz, starts, low, high, cloud, best)
                        yield totals.rows(name, best)
                        continue
                    geo.lower_to_nearest(xyz, starts, low, high, cloud, best)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.repeat(name, len(xyz)), pa.array(best)], names)

    out = total.schema(fields, by) if total else T.StructType([
        *fields, T.StructField("target", T.StringType()), T.StructField("dist", T.DoubleType())])
    return sources.mapInArrow(search, out)


def _neighbor_batch(own: np.ndarray, best: np.ndarray, ids: np.ndarray, id_col: str) -> pa.RecordBatch:
    row, rank = np.nonzero(np.isfinite(best))
    return pa.RecordBatch.from_arrays(
        [pa.array(own[row]), pa.array(ids[row, rank]), pa.array((rank + 1).astype(np.int32)),
         pa.array(best[row, rank])], [id_col, "neighbor", "rank", "dist"])


def _neighbor_schema(id_col: str) -> T.StructType:
    return T.StructType([
        T.StructField(id_col, T.LongType()), T.StructField("neighbor", T.LongType()),
        T.StructField("rank", T.IntegerType()), T.StructField("dist", T.DoubleType())])


def _broadcast_k_nearest(points, table, coords, id_col, k) -> DataFrame:
    clouds = points.sparkSession.sparkContext.broadcast(_clouds(table, len(coords), False, True))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _ready(clouds.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            xyz = _source_matrix(batch, coords)
            order = geo.morton_order(xyz)
            xyz = xyz[order]
            own = batch.column(batch.schema.get_field_index(id_col)).to_numpy()[order]
            starts = geo.chunk_starts(len(xyz), geo.SOURCE_CHUNK)
            low, high = geo.chunk_bounds(xyz, starts)
            best, ids = np.full((len(xyz), k), np.inf), np.zeros((len(xyz), k), dtype=np.int64)
            for _, cloud in ready:
                geo.merge_k_nearest(xyz, own, starts, low, high, cloud, best, ids)
            yield _neighbor_batch(own, best, ids, id_col)

    return _along_curve(points, table, coords, id_col).mapInArrow(search, _neighbor_schema(id_col))


# --------------------------------------------------------------------------- packed plan


def with_curve_position(df: DataFrame, columns: list[str], low: list[float], high: list[float]) -> DataFrame:
    """Add ``_z``, the position along a Z-order curve: interleaved bits of the scaled coordinates.

    Zero bits are spread in by repeated halving. Every step is a projection of its own, because it
    uses the last step's value twice; nested into one expression it would double at each step.
    """
    dims = len(columns)
    top = (1 << (62 // dims)) - 1
    # one scale for all axes, so that runs along the curve fill compact boxes
    span = max(h - l for l, h in zip(low, high)) or 1.0
    names = [f"_z{i}" for i in range(dims)]
    df = df.withColumns({
        name: F.least(F.greatest(F.floor((F.col(c).cast("double") - F.lit(base)) / F.lit(span) * top), F.lit(0)),
                      F.lit(top)).cast("long") for name, c, base in zip(names, columns, low)})
    width = 32
    while width >= 1 and dims > 1:
        shift = width * (dims - 1)
        if shift < 63:
            mask = sum(((1 << width) - 1) << start for start in range(0, 63, width * dims)) & ((1 << 63) - 1)
            df = df.withColumns({name: F.col(name).bitwiseOR(F.shiftleft(name, shift)).bitwiseAND(
                F.lit(mask).cast("long")) for name in names})
        width //= 2
    code = F.col(names[0])
    for axis in range(1, dims):
        code = code.bitwiseOR(F.shiftleft(names[axis], axis))
    return df.withColumn("_z", code).drop(*names)


def _table_extent(table: pa.Table, dims: int) -> tuple[list[float], list[float]]:
    columns = [table.column(AXES[i]).to_numpy() for i in range(dims)]
    return [float(c.min()) for c in columns], [float(c.max()) for c in columns]


def _extent(df: DataFrame, columns: list[str]) -> tuple[list[float], list[float]]:
    aggs = [F.min(F.col(c).cast("double")).alias(f"l{i}") for i, c in enumerate(columns)]
    aggs += [F.max(F.col(c).cast("double")).alias(f"h{i}") for i, c in enumerate(columns)]
    row = df.agg(*aggs).first()
    n = len(columns)
    return [row[f"l{i}"] or 0.0 for i in range(n)], [row[f"h{i}"] or 0.0 for i in range(n)]


def _pack(df: DataFrame, axes: list[str], label: str | None, block: int) -> DataFrame:
    """Written table of blocks: (label, part, seq, n, bounding box, rows)."""
    low, high = _extent(df, axes)
    lead = [label] if label else []
    rows = with_curve_position(df, axes, low, high)
    rows = rows.repartitionByRange(_partitions(df), *lead, "_z", *axes)
    rows = rows.sortWithinPartitions(*lead, "_z", *axes).drop("_z")
    rows = rows.withColumn("_part", F.spark_partition_id())
    payload = T.StructType([f for f in df.schema.fields if f.name != label])
    scaled = "_factor" in df.columns
    dims = len(axes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            index = batch.schema.get_field_index
            xyz = _source_matrix(batch, axes)
            changes = np.zeros(0, dtype=np.int64)
            if label:
                names = batch.column(index(label)).dictionary_encode()
                codes = names.indices.to_numpy(zero_copy_only=False)
                changes = np.flatnonzero(np.diff(codes)) + 1
            runs = np.concatenate([[0], changes, [batch.num_rows]])
            starts = np.concatenate(
                [np.arange(a, b, block) for a, b in zip(runs[:-1], runs[1:])]).astype(np.int64)
            offsets = np.append(starts, batch.num_rows).astype(np.int32)
            lows, highs = geo.chunk_bounds(xyz, starts)
            factor = np.ones(len(starts))
            if scaled:
                values = batch.column(index("_factor")).to_numpy(zero_copy_only=False)
                factor = np.minimum.reduceat(values, starts)
            inner = pa.StructArray.from_arrays(
                [batch.column(index(f.name)) for f in payload.fields],
                names=[f.name for f in payload.fields])
            arrays = [
                batch.column(index(label)).take(pa.array(starts)) if label
                else pa.repeat("", len(starts)),
                batch.column(index("_part")).take(pa.array(starts)).cast(pa.int64()),
                pa.array(np.arange(seq, seq + len(starts))),
                pa.array(np.diff(offsets).astype(np.int64)),
                *[pa.array(lows[:, i]) for i in range(dims)],
                *[pa.array(highs[:, i]) for i in range(dims)],
                pa.array(factor),
                pa.ListArray.from_arrays(pa.array(offsets), inner),
            ]
            seq += len(starts)
            yield pa.RecordBatch.from_arrays(
                arrays, ["label", "part", "seq", "n", *[f"l{i}" for i in range(dims)],
                         *[f"h{i}" for i in range(dims)], "f", "rows"])

    double, long = T.DoubleType(), T.LongType()
    schema = T.StructType([
        T.StructField("label", T.StringType()), T.StructField("part", long),
        T.StructField("seq", long), T.StructField("n", long),
        *[T.StructField(f"l{i}", double) for i in range(dims)],
        *[T.StructField(f"h{i}", double) for i in range(dims)],
        T.StructField("f", double), T.StructField("rows", T.ArrayType(payload)),
    ])
    return written(rows.mapInArrow(cut, schema))


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Give every block one whole number in curve order; return the tree height as well."""
    row = blocks.agg(F.max("part").alias("p"), F.max("seq").alias("s")).first()
    seq_bits = max(1, int(row["s"] or 0).bit_length())
    part_bits = max(1, int(row["p"] or 0).bit_length())
    number = F.shiftleft(F.col("part"), seq_bits).bitwiseOR(F.col("seq"))
    return blocks.withColumn("block", number), math.ceil((seq_bits + part_bits) / FANOUT_BITS)


def _nodes(blocks: DataFrame, level: int, dims: int, side: str) -> DataFrame:
    """Summaries of all blocks under each node of one tree level."""
    node = F.shiftright(F.col("block"), FANOUT_BITS * level)
    keys = [F.col("label").alias("by")]
    if side == "t":
        keys = [F.substring_index("label", SEPARATOR, 1).alias("by"), F.col("label").alias("target")]
    aggs = [F.min(f"l{i}").alias(f"{side}l{i}") for i in range(dims)]
    aggs += [F.max(f"h{i}").alias(f"{side}h{i}") for i in range(dims)]
    aggs += [F.sum("n").alias(f"{side}n"), F.min("f").alias(f"{side}f")]
    out = blocks.groupBy(*keys, node.alias(side)).agg(*aggs)
    return out.withColumn(f"{side}_up", F.shiftright(F.col(side), FANOUT_BITS))


def _closest_pairs(pairs: DataFrame, dims: int, k: int) -> DataFrame:
    """Drop pairs that cannot hold one of the nearest points of their source node and label."""
    near = far = F.lit(0.0)
    for i in range(dims):
        gap = F.greatest(F.lit(0.0), F.col(f"tl{i}") - F.col(f"sh{i}"), F.col(f"sl{i}") - F.col(f"th{i}"))
        reach = F.greatest(F.col(f"th{i}") - F.col(f"sl{i}"), F.col(f"sh{i}") - F.col(f"tl{i}"))
        near, far = near + gap * gap, far + reach * reach
    pairs = pairs.withColumn("near", F.sqrt(near) * F.col("tf")).withColumn("far", F.sqrt(far) * F.col("tf"))
    group = Window.partitionBy("by", "s", "target")
    if k == 1:
        bound = F.min("far").over(group)
    else:
        held = Window.partitionBy("by", "s", "target").orderBy("far").rangeBetween(
            Window.unboundedPreceding, Window.currentRow)
        pairs = pairs.withColumn("held", F.sum("tn").over(held))
        enough = F.min(F.when(F.col("held") >= k + 1, F.col("far"))).over(group)
        bound = F.coalesce(enough, F.lit(float("inf")))
    pairs = pairs.withColumn("bound", bound).where(F.col("near") <= F.col("bound") * geo.SLACK)
    return pairs.drop("near", "far", "bound", "held")


def _block_pairs(s_blocks, t_blocks, height: int, dims: int, k: int) -> DataFrame:
    """(source block, target block) pairs that can matter, found from the root downwards."""
    s_root, t_root = _nodes(s_blocks, height, dims, "s"), _nodes(t_blocks, height, dims, "t")
    pairs = s_root.drop("s_up").join(t_root.drop("t_up"), "by")
    s_columns = [f"s{e}{i}" for e in "lh" for i in range(dims)] + ["sn", "sf"]
    t_columns = [f"t{e}{i}" for e in "lh" for i in range(dims)] + ["tn", "tf"]
    for level in range(height - 1, -1, -1):
        s_nodes = _nodes(s_blocks, level, dims, "s")
        t_nodes = _nodes(t_blocks, level, dims, "t")
        pairs = pairs.drop(*s_columns).withColumnRenamed("s", "s_up").join(s_nodes, ["by", "s_up"]).drop("s_up")
        pairs = _closest_pairs(pairs, dims, k)
        pairs = pairs.drop(*t_columns).withColumnRenamed("t", "t_up").join(
            t_nodes.drop("by"), ["target", "t_up"]).drop("t_up")
        pairs = _closest_pairs(pairs, dims, k)
        if level % 3 == 0:
            pairs = written(pairs)
    return pairs.select("by", "s", "target", "t")


def _packed_join(sources, targets, coords, *, factor=None, k: int = 1, id_col=None, by=None, total: type | None = None) -> DataFrame:
    dims = len(coords)
    axes = list(AXES[:dims])
    if by is not None:
        sources = sources.withColumn("_by", F.col(by).cast("string"))
    # packing reads its input for the extent, the range sample and the sort: evaluate it once
    sources, targets = written(sources), written(targets)
    s_blocks, s_height = _numbered(_pack(sources, coords, None if by is None else "_by", SOURCE_BLOCK))
    t_blocks, t_height = _numbered(_pack(targets, axes, "target", TARGET_BLOCK))
    pairs = _block_pairs(s_blocks, t_blocks, max(s_height, t_height), dims, k)
    group = F.shiftright(F.col("s"), GROUP_BITS)
    needed = pairs.select("by", group.alias("group"), "target", F.col("t").alias("block")).distinct()
    payload = s_blocks.schema["rows"].dataType
    shipped = t_blocks.schema["rows"].dataType
    incoming = needed.join(
        t_blocks.select(F.col("label").alias("target"), "block", "rows"), ["target", "block"]
    ).select("by", "group", F.lit(1).alias("role"), "target", "block",
             F.lit(None).cast(payload).alias("source"), F.col("rows").alias("cloud"))
    own = s_blocks.select(
        F.col("label").alias("by"), F.shiftright(F.col("block"), GROUP_BITS).alias("group"), F.lit(0).alias("role"),
        F.lit("").alias("target"), "block", F.col("rows").alias("source"),
        F.lit(None).cast(shipped).alias("cloud"))
    stream = own.unionByName(incoming).repartition(_partitions(sources), "by", "group")
    # blocks travel whole and are taken apart after the sort, so that a task's batches are so many points and not so many blocks
    stream = stream.sortWithinPartitions("by", "group", "role", "target", "block").withColumn(
        "source", F.explode_outer("source")).withColumn("cloud", F.explode_outer("cloud")).drop("block")
    if total:
        out = total.schema(payload.elementType.fields, by)
    elif k == 1 and id_col is None:
        out = T.StructType([*payload.elementType.fields, T.StructField("target", T.StringType()),
                            T.StructField("dist", T.DoubleType())])
    else:
        out = _neighbor_schema(id_col)
    return stream.mapInArrow(_folder(coords, axes, factor is not None, k, id_col, total, by), out).drop("_by")


def _folder(coords, axes, scaled: bool, k: int, id_col: str | None, total: type | None = None, by: str | None = None):
    """Streaming pass over rows sorted by (group, role, target): sources first, then targets."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, target = None, None
        parts: list[pa.StructArray] = []
        held: list[pa.StructArray] = []
        source = None
        best = ids = None

        def load():
            table = pa.concat_arrays(parts)
            batch = pa.RecordBatch.from_struct_array(table)
            xyz = _source_matrix(batch, coords)
            starts = geo.chunk_starts(len(xyz), geo.SOURCE_CHUNK)
            return batch, xyz, starts, *geo.chunk_bounds(xyz, starts), total(batch, by) if total else None

        def reset():
            rows = len(source[1])
            if id_col is None:
                return np.full(rows, np.inf), None
            return np.full((rows, k), np.inf), np.zeros((rows, k), dtype=np.int64)

        def absorb():
            batch, xyz, starts, low, high, totals = source
            block = pa.RecordBatch.from_struct_array(pa.concat_arrays(held))
            index = block.schema.get_field_index
            cloud_xyz = _source_matrix(block, axes)
            values = block.column(index("_factor")).to_numpy() if scaled else None
            tid = block.column(index("_tid")).to_numpy() if id_col else None
            cloud = geo.TargetCloud(cloud_xyz, ids=tid, factor=values)
            if totals is not None:
                totals.lower(xyz, starts, low, high, cloud, best)
            elif id_col is None:
                geo.lower_to_nearest(xyz, starts, low, high, cloud, best)
            else:
                own = batch.column(batch.schema.get_field_index(id_col)).to_numpy()
                geo.merge_k_nearest(xyz, own, starts, low, high, cloud, best, ids)
            held.clear()

        def emit():
            batch = source[0]
            if id_col is not None:
                own = batch.column(batch.schema.get_field_index(id_col)).to_numpy()
                return _neighbor_batch(own, best, ids, id_col)
            if total:
                return source[5].rows(target.partition(SEPARATOR)[2], best)
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.repeat(target.partition(SEPARATOR)[2], batch.num_rows), pa.array(best)],
                [*batch.schema.names, "target", "dist"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            keys = [columns[c].dictionary_encode().indices.to_numpy() if c in {"by", "target"} else columns[c].to_numpy()
                    for c in ("by", "group", "role", "target")]
            cuts = (np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in keys])) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                if keys[2][i] == 0:
                    own = (columns["by"][i].as_py(), int(keys[1][i]))
                    if own != group:
                        if target is not None:
                            if held:
                                absorb()
                            yield emit()
                        group, target, source = own, None, None
                        parts.clear()
                    parts.append(columns["source"].slice(i, j - i))
                    continue
                name = columns["target"][i].as_py()
                if source is None:
                    source = load()
                if name != target:
                    if target is not None:
                        if held:
                            absorb()
                        yield emit()
                    target = name
                    best, ids = reset()
                held.append(columns["cloud"].slice(i, j - i))
                if sum(map(len, held)) >= FOLD_ROWS:
                    absorb()
        if target is not None:
            if held:
                absorb()
            yield emit()

    return fold
