"""N-gram Jaccard join with signature trees (operator 8).

Two documents link if the Jaccard similarity of their sets of word shingles reaches a threshold. The join is exact:

1. Counting. How many documents hold a shingle becomes a level, a power of two, in a table of bounded size.
2. Meeting. Ordered by level and number, the first shingles of two similar sets must share one (prefix filter). Documents
   that share such a shingle and have sizes that may link, directly or through others, form a cluster; nothing outside it can link with them.
   Equal sets count once.
3. Trees. In each cluster a signature tree holds the sets: nodes carry the OR of their members' token bitmaps and the range of
   their sizes. Two nodes are compared with each other from the top down and dropped if their sizes or the
   largest overlap that their bitmaps allow cannot reach the threshold, or if all their members are linked already. Leaves are compared exactly.
4. A cluster with more sets than a task should hold is cut into blocks. First each block is joined with itself and one
   block of its size; what that leaves unlinked is then joined block by block, except within what is linked already.

Groups of linked documents need only links that join them, so what is linked already is passed over. The number of links of each
document needs all: with ``links`` every pair of sets that sizes and bitmaps leave is compared, each in one unit of work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscape.llm.common import columns_of, give_back, having, input_bytes, lacking, make_room, rows_of, written
from labelscape.llm.components import components, stars
from labelscape.llm.shingles import shingle_set

#: The table of levels has at most 2**LEVEL_BITS bytes, whatever the input.
LEVEL_BITS = 26
#: A cluster's sets are numbered in so many slices.
SLICES = 16
#: Shingles held back by a task before it sends them on.
FLUSH = 1 << 19
#: Sets in a block, children of a tree's node.
BLOCK, FAN = 128, 8
#: A set's mark has its size class in so many low bits; classes are a quarter of the largest step between sizes that link.
CLASS_BITS, STEPS = 10, 4


def shard_bits(df: DataFrame) -> int:
    """Shards of a few MB of input each: decides how finely work is cut, not what is computed."""
    return max(6, min(16, (input_bytes(df) // (2 << 20)).bit_length()))


def digest(numbers: np.ndarray) -> bytes:
    return hashlib.blake2b(numbers.tobytes(), digest_size=16).digest()


def texts_of(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def level_bits(df: DataFrame) -> int:
    """Some entries of the table for each shingle, as far as its bound allows: decides how rare the first shingles are, not what links."""
    return max(20, min(LEVEL_BITS, (input_bytes(df) // 16).bit_length()))


def levels(texts: DataFrame, width: int, bits: int, table_bits: int) -> np.ndarray:
    """Byte i: floor(log2(documents)) of the most frequent shingle whose highest ``table_bits`` bits are i.

    Tasks count what they hold before sending it on, so a shingle that is everywhere arrives once a task.
    """
    shards = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(64 - bits)

    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        numbers, counts = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
        cuts = np.searchsorted(numbers, shards[:-1] >> np.uint64(32 - bits)).tolist() + [len(numbers)]
        low = (numbers & np.uint64(0xFFFFFFFF)).astype("<u4")
        once = counts == 1
        rows = [(shard, low[a:b][once[a:b]].tobytes(),
                 np.stack([low[a:b][~once[a:b]], counts[a:b][~once[a:b]].astype("<u4")]).tobytes())
                for shard, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                         ["shard", "once", "often"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("signature_tree", list)
        held, size = [], 0
        for batch in rows_of(batches):
            for value in batch.column(0):
                held.append(shingle_set(value.as_py(), width))
                size += len(held[-1])
            if size >= FLUSH:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)
        held.clear()
        give_back()

    def total(table: pa.Table) -> pa.Table:
        once = [np.frombuffer(v.as_py(), "<u4") for v in table.column("once")]
        often = [np.frombuffer(v.as_py(), "<u4").reshape(2, -1) for v in table.column("often")]
        numbers = np.concatenate(once + [o[0] for o in often])
        counts = np.concatenate([np.ones(sum(map(len, once)), np.int64)] + [o[1].astype(np.int64) for o in often])
        order = np.argsort(numbers)
        numbers, counts = numbers[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        counts = np.add.reduceat(counts, first)
        mine = counts > 1
        part = np.zeros(1 << (table_bits - bits), np.uint8)
        np.maximum.at(part, numbers[first][mine] >> np.uint32(32 - table_bits + bits), np.log2(counts[mine]).astype(np.uint8))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                         "part": pa.array([part.tobytes() if mine.any() else b""], pa.binary())})

    out = np.zeros(1 << table_bits, np.uint8)
    step = 1 << (table_bits - bits)
    found = texts.select("text").mapInArrow(count, "shard int, once binary, often binary").groupBy("shard").applyInArrow(
        total, "shard int, part binary").where("length(part) > 0")
    for row in found.collect():  # at most 2**LEVEL_BITS bytes in all
        out[row["shard"] * step:(row["shard"] + 1) * step] = np.frombuffer(row["part"], np.uint8)
    return out


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` must share with any set it links with."""
    return -(-percent * n // 100)


def prefix(numbers: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles, so many that two sets that link have one in common."""
    size = len(numbers) - least_overlap(len(numbers), percent) + 1
    own = level[(numbers >> np.uint64(65 - len(level).bit_length())).astype(np.int64)]
    rare = numbers[own == 0]
    if len(rare) >= size:
        return rare[:size]
    return numbers[np.lexsort((numbers, own))[:size]]


def mark_of(key: bytes, n: int, percent: int) -> int:
    """A number of the set, its size class in the low bits."""
    size = int(np.log(max(1, n)) / np.log(100 / percent) * STEPS)
    return int.from_bytes(key[:8], "little", signed=True) >> CLASS_BITS << CLASS_BITS | min(size, (1 << CLASS_BITS) - 1)


def meetings(texts: DataFrame, width: int, percent: int, bits: int, level: np.ndarray) -> DataFrame:
    """Two kinds of rows: documents (doc, key, mark, n) and, by shard, blobs of (shingle, mark); ``mark`` is a number of the set.

    Sets that meet in a task are tied there (``a``, ``b``), and only one of each size class is sent on.
    """
    shared = texts.sparkSession.sparkContext.broadcast(level)  # given up when the result has been written
    shards = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    schema = pa.schema([("doc", pa.int64()), ("key", pa.binary()), ("mark", pa.int64()), ("n", pa.int64()),
                        ("shard", pa.int32()), ("blob", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])

    def batch_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def sent(held: list[np.ndarray], marks: list[int]) -> Iterator[pa.RecordBatch]:
        numbers = np.concatenate(held)
        owner = np.repeat(np.array(marks, np.int64), [len(h) for h in held])
        numbers, owner, a, b = tied(numbers, owner)
        if len(a):
            yield batch_of(a=pa.array(a), b=pa.array(b))
        low = owner & ((1 << CLASS_BITS) - 1)
        first = np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (low[1:] != low[:-1])])
        numbers, owner = numbers[first], owner[first]
        cuts = np.searchsorted(numbers, shards).tolist() + [len(numbers)]
        rows = [(shard, np.stack([numbers[i:j].view(np.int64), owner[i:j]]).tobytes())
                for shard, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        yield batch_of(shard=pa.array([r[0] for r in rows], pa.int32()), blob=pa.array([r[1] for r in rows], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("signature_tree", list)
        table, held, marks, size = shared.value, [], [], 0
        for batch in rows_of(batches):
            keys, own, n = [], [], []
            for value in batch.column(1):
                numbers = shingle_set(value.as_py(), width)
                key = digest(numbers)
                keys.append(key)
                own.append(mark_of(key, len(numbers), percent))
                n.append(len(numbers))
                if len(numbers):
                    held.append(prefix(numbers, table, percent))
                    marks.append(own[-1])
                    size += len(held[-1])
            yield batch_of(doc=batch.column(0), key=pa.array(keys, pa.binary()), mark=pa.array(own, pa.int64()),
                           n=pa.array(n, pa.int64()))
            if size >= FLUSH:
                yield from sent(held, marks)
                held, marks, size = [], [], 0
        if size:
            yield from sent(held, marks)
        held.clear()
        give_back()

    met = written(texts.mapInArrow(run, "doc long, key binary, mark long, n long, shard int, blob binary, a long, b long"))
    shared.unpersist()
    return met


def tied(numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and marks, sorted by shingle and size class, and pairs of marks that connect what shares a shingle and may link.

    All sizes between two that may link may link with both, so it is enough to look at neighbours in that order.
    """
    low = owner & ((1 << CLASS_BITS) - 1)
    order = np.lexsort((owner, low, numbers))
    numbers, owner, low = numbers[order], owner[order], low[order]
    near = (numbers[1:] == numbers[:-1]) & (low[1:] - low[:-1] <= STEPS + 1) & (owner[1:] != owner[:-1])
    return numbers, owner, *stars(owner[:-1][near], owner[1:][near])


def clusters(met: DataFrame) -> DataFrame:
    """``mark``, ``cluster`` of every set that shares a prefix shingle with another one."""
    def meet(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(v.as_py(), "<i8").reshape(2, -1) for v in table.column("blob")]
        numbers, owner = np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs])
        _, _, a, b = tied(numbers, owner)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    across = met.where("blob is not null").select("shard", "blob").groupBy("shard").applyInArrow(meet, "a long, b long")
    within = met.where("a is not null").select("a", "b")
    return components(across.unionByName(within)).select(F.col("node").alias("mark"), F.col("label").alias("cluster"))


class Node:
    """Part of a signature tree: members, the OR of their bitmaps, their range of sizes, and the most tokens of a member that share a bit with
    another one of its tokens."""

    def __init__(self, members: np.ndarray, children: list[Node], bitmaps: np.ndarray, sizes: np.ndarray, excess: np.ndarray):
        self.members, self.children = members, children
        self.bitmap = np.bitwise_or.reduce([c.bitmap for c in children] if children else bitmaps[members], axis=0)
        self.least, self.most = sizes[members].min(), sizes[members].max()
        self.excess = excess[members].max()


def signature_tree(order: np.ndarray, bitmaps: np.ndarray, sizes: np.ndarray, excess: np.ndarray) -> Node:
    row = [Node(order[i:i + FAN], [], bitmaps, sizes, excess) for i in range(0, len(order), FAN)]
    while len(row) > 1:
        row = [Node(np.concatenate([c.members for c in row[i:i + FAN]]), row[i:i + FAN], bitmaps, sizes, excess)
               for i in range(0, len(row), FAN)]
    return row[0]


def bits_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps with about eight bits a token, and how many tokens of each set share a bit with another one."""
    width = max(512, min(1 << 16, 1 << int(8 * max(map(len, sets))).bit_length()))
    bitmaps = np.zeros((len(sets), width // 64), np.uint64)
    for row, numbers in zip(bitmaps, sets):
        flags = np.zeros(width, np.uint8)
        flags[(numbers % np.uint64(width)).astype(np.int64)] = 1
        row[:] = np.packbits(flags, bitorder="little").view(np.uint64)
    return bitmaps, np.array([len(s) for s in sets]) - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)


def linked_pairs(sets: list[np.ndarray], group: list, percent: int) -> list[tuple[int, int]]:
    """Links that join all sets which links connect: pairs of a spanning forest, given those already in one ``group`` (None: none)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bitmaps, excess = bits_of(sets)
    parent = list(range(len(sets)))
    seen: dict = {}
    for i, g in enumerate(group):
        if g is not None:
            parent[i] = seen.setdefault(g, i)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found: list[tuple[int, int]] = []

    def compare(i: int, j: int) -> None:
        small, large = int(min(sizes[i], sizes[j])), int(max(sizes[i], sizes[j]))
        if 100 * small < percent * large:
            return
        need = -(-percent * (small + large) // (100 + percent))
        if np.bitwise_count(bitmaps[i] & bitmaps[j]).sum() + min(excess[i], excess[j]) < need or find(i) == find(j):
            return
        if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= need:
            parent[find(i)] = find(j)
            found.append((i, j))

    order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], sizes))
    root = signature_tree(order, bitmaps, sizes, excess)
    stack = [(root, root)]
    while stack:
        one, other = stack.pop()
        if 100 * min(one.most, other.most) < percent * max(one.least, other.least):
            continue
        need = -(-percent * int(one.least + other.least) // (100 + percent))
        if one is not other and np.bitwise_count(one.bitmap & other.bitmap).sum() + min(one.excess, other.excess) < need:
            continue
        if len({find(int(i)) for i in one.members} | {find(int(i)) for i in other.members}) == 1:
            continue
        if not one.children and not other.children:
            for x, i in enumerate(one.members):
                for j in one.members[x + 1:] if one is other else other.members:
                    compare(int(i), int(j))
        elif one is other:
            for x, child in enumerate(one.children):
                stack.extend((child, later) for later in one.children[x + 1:])
            stack.extend((child, child) for child in one.children)  # a node's own members come before those of two nodes
        elif not other.children or (one.children and len(one.members) >= len(other.members)):
            stack.extend((child, other) for child in one.children)
        else:
            stack.extend((one, child) for child in other.children)
    return found


def all_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that link: of different sides if there are two, else any. Trees drop pairs by their bounds only."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bitmaps, excess = bits_of(sets)
    order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], sizes))
    roots = [signature_tree(order[side[order] == v], bitmaps, sizes, excess) for v in np.unique(side)]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    stack = [(roots[0], roots[-1])]
    while stack:
        one, other = stack.pop()
        if 100 * min(one.most, other.most) < percent * max(one.least, other.least):
            continue
        need = -(-percent * int(one.least + other.least) // (100 + percent))
        if one is not other and np.bitwise_count(one.bitmap & other.bitmap).sum() + min(one.excess, other.excess) < need:
            continue
        if not one.children and not other.children:
            i, j = np.repeat(one.members, len(other.members)), np.tile(other.members, len(one.members))
            if one is other:
                x, y = np.triu_indices(len(one.members), 1)
                i, j = one.members[x], one.members[y]
            small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
            most = np.bitwise_count(bitmaps[i] & bitmaps[j]).sum(axis=1, dtype=np.int64) + np.minimum(excess[i], excess[j])
            maybe = (100 * small >= percent * large) & ((100 + percent) * most >= percent * (small + large))
            left.append(i[maybe])
            right.append(j[maybe])
        elif one is other:
            for x, child in enumerate(one.children):
                stack.extend((child, later) for later in one.children[x:])
        elif not other.children or (one.children and len(one.members) >= len(other.members)):
            stack.extend((child, other) for child in one.children)
        else:
            stack.extend((one, child) for child in other.children)
    i, j = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (left, right))
    # exact overlaps: tokens get local numbers, those of one set are marked, and all sets count their marked ones
    tokens, local = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked, overlap = np.zeros(len(tokens), np.int64), np.zeros(len(i), np.int64)
    by = np.argsort(i, kind="stable")
    firsts, at = np.unique(i[by], return_index=True)
    for first, mine in zip(firsts, np.split(by, at[1:])):
        own = local[starts[first]:starts[first] + sizes[first]]
        marked[own] = 1
        overlap[mine] = np.add.reduceat(marked[local], starts)[j[mine]]
        marked[own] = 0
    linked = (100 + percent) * overlap >= percent * (sizes[i] + sizes[j])
    return i[linked], j[linked]


def counted(units: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (a, b) that connect what links in each ``unit``, and (a, n): documents that link with those of set ``a`` there, its own left out.

    ``units`` has unit, doc, key, side and copies (documents of that set).
    """
    def run(table: pa.Table) -> pa.Table:
        found: dict[bytes, tuple] = {}
        for key, text, side, copies in zip(*(table.column(c) for c in ("key", "text", "side", "copies"))):
            numbers, name = shingle_set(text.as_py(), width), key.as_py()
            if name not in found and digest(numbers) == name:  # not another text under the same document number
                found[name] = numbers, side.as_py(), copies.as_py()
        keys, (sets, side, copies) = list(found), zip(*found.values())
        one, other = all_links(list(sets), np.array(side), percent)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, one, np.array(copies)[other])
        np.add.at(n, other, np.array(copies)[one])
        a, b = stars(one, other)
        some = np.flatnonzero(n)
        return pa.table({"a": pa.array([keys[i] for i in (*a, *some)], pa.binary()),
                         "b": pa.array([keys[i] for i in b] + [None] * len(some), pa.binary()),
                         "n": pa.array([None] * len(a) + n[some].tolist(), pa.int64())})

    return units.join(texts, "doc").select("unit", "key", "side", "copies", "text").groupBy("unit").applyInArrow(
        run, "a binary, b binary, n long")


def every_unit(members: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Units for ``counted``: clusters of one block, and of larger ones each pair of blocks whose sizes may link once."""
    ends = [F.lit(0).alias("size"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("o_size"), F.lit(0).cast("long").alias("o_part")]
    small = members.join(counts.where(F.col("count") <= BLOCK), "cluster").select(
        F.struct("cluster", *ends).alias("unit"), "doc", "key", F.lit(0).alias("side"), "copies")
    large = written(blocks(members.join(counts.where(F.col("count") > BLOCK), "cluster").drop("count"), percent))
    if large.isEmpty():
        return small
    one = large.groupBy("cluster", "size", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = one.withColumnsRenamed({c: f"o_{c}" for c in one.columns})
    pairs = one.withColumn("near", F.explode(F.array("size", F.col("size") + 1))).join(
        other, (F.col("cluster") == F.col("o_cluster")) & (F.col("near") == F.col("o_size"))).where(
        (F.struct("size", "part") <= F.struct(F.col("o_size").alias("size"), F.col("o_part").alias("part")))
        & (100 * F.col("most") >= percent * F.col("o_least")) & (100 * F.col("o_most") >= percent * F.col("least")))
    unit = F.struct("cluster", "size", "part", "o_size", "o_part").alias("unit")
    mine = pairs.select(unit, "cluster", "size", "part", F.lit(0).alias("side"))
    theirs = pairs.where((F.col("size") != F.col("o_size")) | (F.col("part") != F.col("o_part"))).select(
        unit, "cluster", F.col("o_size").alias("size"), F.col("o_part").alias("part"), F.lit(1).alias("side"))
    return small.unionByName(mine.unionByName(theirs).join(large, ["cluster", "size", "part"]).select(
        "unit", "doc", "key", "side", "copies"))


def joined(units: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """What the links that a tree finds in each ``unit`` connect, as pairs (a, b) of set keys; ``units`` has unit, doc, key and group."""
    def run(table: pa.Table) -> pa.Table:
        keys, sets, group = [], [], []
        for key, text, own in zip(*(table.column(c) for c in ("key", "text", "group"))):
            numbers, name = shingle_set(text.as_py(), width), key.as_py()
            if name not in keys and digest(numbers) == name:  # not another text under the same document number
                keys.append(name)
                sets.append(numbers)
                group.append(own.as_py())
        pairs = np.array(linked_pairs(sets, group, percent) if len(sets) > 1 else [], np.int64).reshape(-1, 2)
        one, other = stars(pairs[:, 0], pairs[:, 1])
        return pa.table({"a": pa.array([keys[i] for i in one], pa.binary()), "b": pa.array([keys[j] for j in other], pa.binary())})

    return units.join(texts, "doc").select("unit", "key", "group", "text").groupBy("unit").applyInArrow(
        run, "a binary, b binary")


def blocks(members: DataFrame, percent: int, *pools: str) -> DataFrame:
    """Cut each cluster into blocks of about BLOCK sets by size class (sets that link differ by one at most), ``pools`` and key."""
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) - F.lit(1e-9)).cast("int")
    classed = members.withColumn("size", size)
    # a cluster's sets meet its counts in slices, so that a large one is many tasks' work
    counts = classed.groupBy("cluster", "size", *pools).count().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return classed.withColumn("slice", F.pmod(F.xxhash64(F.lit(SLICES), F.col("key")), F.lit(SLICES)).cast("int")).join(
        counts, ["cluster", "size", *pools, "slice"]).withColumn(
        "part", F.pmod(F.xxhash64("key"), F.ceil(F.col("count") / BLOCK))).drop("count", "slice")


def forest(members: DataFrame, counts: DataFrame, own: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of set keys that connect all sets which links connect."""
    nothing = F.lit(None).cast("binary").alias("group")
    small = members.join(counts.where(F.col("count") <= BLOCK), "cluster").select(
        F.struct(F.col("cluster"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("part")).alias("unit"), "doc", "key", nothing)
    large = written(blocks(members.join(counts.where(F.col("count") > BLOCK), "cluster").drop("count"), percent))
    # each block with itself and the first block of its size class and the class above
    first = large.where("part = 0")
    parts = large.select("cluster", "size", "part").distinct()
    whole = large.select(F.struct("cluster", "size", "part").alias("unit"), "doc", "key", nothing)
    hub = parts.withColumn("hub", F.explode(F.array("size", F.col("size") + 1))).join(
        first.select("cluster", F.col("size").alias("hub"), "doc", "key"), ["cluster", "hub"]).select(
        F.struct("cluster", "size", "part").alias("unit"), "doc", "key", nothing)
    links = written(joined(small.unionByName(whole).unionByName(hub), own, width, percent))

    if not large.isEmpty():
        # what is linked by now is a pool; small pools are thrown together; blocks of one pool need no further look
        pools = components(links).select(F.col("node").alias("key"), F.col("label").alias("group"))
        pooled = large.drop("size", "part").join(pools, "key", "left").withColumn("group", F.coalesce("group", "key"))
        sizes = pooled.groupBy("cluster", "group").count()
        pooled = pooled.join(sizes, ["cluster", "group"]).withColumn(
            "pool", F.when(F.col("count") >= BLOCK // 4, F.col("group")).otherwise(F.lit(b""))).drop("count")
        cut = written(blocks(pooled, percent, "pool"))
        one = cut.groupBy("cluster", "size", "pool", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"))
        other = one.withColumnsRenamed({c: f"o_{c}" for c in one.columns})
        later = F.struct("size", "pool", "part") <= F.struct(F.col("o_size").alias("size"), F.col("o_pool").alias("pool"), F.col("o_part").alias("part"))
        pairs = one.withColumn("near", F.explode(F.array("size", F.col("size") + 1))).join(
            other, (F.col("cluster") == F.col("o_cluster")) & (F.col("near") == F.col("o_size"))).where(
            later & ((F.col("pool") != F.col("o_pool")) | (F.col("pool") == F.lit(b"")))
            & (100 * F.col("most") >= percent * F.col("o_least")) & (100 * F.col("o_most") >= percent * F.col("least")))
        name = F.struct("cluster", "size", "pool", "part", "o_size", "o_pool", "o_part").alias("unit")
        sides = pairs.select(name, F.explode(F.array(
            F.struct("size", "pool", "part"),
            F.struct(F.col("o_size").alias("size"), F.col("o_pool").alias("pool"), F.col("o_part").alias("part")))).alias("side"))
        units = sides.select("unit", F.col("unit.cluster").alias("cluster"), "side.*").distinct().join(
            cut, ["cluster", "size", "pool", "part"]).select("unit", "doc", "key", "group")
        links = links.unionByName(written(joined(units, own, width, percent)))
    return links


def jaccard_join(df: DataFrame, *, width: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text",
                 links: bool = False) -> DataFrame:
    """Per row: key, n_shingles and component_id, the smallest key that links lead to (its own included).

    Documents link if 100 x intersection >= percent x union of their shingles. A text with fewer words than ``width`` is one
    shingle; one without words, or null, links with nothing, as does a row with a null key, whose component_id is
    null. Rows of equal key are documents of their own. Other columns are not read. With ``links`` a further column, n_links, has
    the number of other documents that each one links with.
    """
    texts = texts_of(df, key, text)
    bits = shard_bits(df)
    met = meetings(texts, width, percent, bits, levels(texts, width, bits, level_bits(df)))
    docs = met.where("key is not null").select("doc", "key", "mark", "n")
    sets = docs.where("n > 0 and doc is not null").groupBy("key", "mark", "n").agg(
        F.min("doc").alias("doc"), F.count("*").alias("copies"))
    members = written(sets.join(clusters(met), "mark"))
    own = written(having(texts, members.select("doc").distinct(), "doc"))

    counts = members.groupBy("cluster").count()
    if links:
        found = written(counted(every_unit(members, counts, percent), own, width, percent))
        more = found.where("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("more"))
        pairs = found.where("b is not null").select("a", "b")
    else:
        pairs = forest(members, counts, own, width, percent)
    labels = components(pairs)
    named = sets.select("key", "doc", "copies").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "label", F.coalesce("label", "key"))
    smallest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    classes = named.join(smallest, "label")
    if links:
        classes = classes.join(more, "key", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("more", F.lit(0)))
    classes = written(classes.select("key", "component_id", *["n_links"] * links))
    counted_ = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links")
    return docs.join(classes, "key", "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
        *[counted_] * links)


def one_of_each(df: DataFrame, *, width: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay when of each group of linked documents only the one with the smallest key does.

    Rows equal in key and text are one document; rows with a null key link with nothing and all stay.
    """
    found = written(jaccard_join(df, width=width, percent=percent, key=key, text=text).where(F.col(key).isNotNull()))
    kind = df.schema[key].dataType
    gone = found.where(F.col(key) != F.col("component_id")).select(F.col(key).cast(kind).alias(key))
    twice = found.groupBy(key).count().where("count > 1").select(F.col(key).cast(kind).alias(key))
    single = lacking(df, written(gone.union(twice).distinct()), key)
    kept = found.join(twice, key, "left_semi").where(F.col(key) == F.col("component_id")).select(F.col(key).cast(kind).alias(key)).distinct()
    return single.unionByName(having(df, kept, key).dropDuplicates([key, text])).select(*columns_of(df))


#: The join in DuckDB, over ``documents``; for tables small enough to compare all documents that share a shingle.
SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
            ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w),
    u AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reached AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
    SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, min(b) AS component_id
    FROM s JOIN reached ON s.doc_id = a GROUP BY s.doc_id, shingles"""
#: The same with n_links.
LINKS_SQL = SQL.replace("min(b) AS component_id", "min(b) AS component_id, (SELECT count(*) FROM links WHERE links.a = s.doc_id) AS n_links")
