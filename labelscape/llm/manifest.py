"""Merkle manifest of a dataset with octopus multiproofs (operator 13).

Rows are leaves of one tree for each group, groups' roots are leaves of the tree above them. A node is the hash of up to three
consecutive ones below it. Trees are built bottom up in aligned blocks of 3**7 nodes, each by one task that needs no other block.

Proofs are made for parts of many consecutive leaves. A part computes which nodes its leaves' paths need and its leaves do not give: the
union over all of them, as coordinates of tree, level and place. It fetches these once, derives what
lies between from them and its leaves, and writes every leaf's own proof from what it then holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscape.llm.common import written

ARITY, LEVELS = 3, 7
BLOCK = ARITY**LEVELS
#: Leaves of a part, about.
PART = ARITY**8
#: Number of the tree above the groups' trees.
ABOVE = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``number`` from 0 in the given order and ``range``, the number of its range of rows. Only the ranges' sizes, one row
    each, come together in a task."""
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("range", F.shiftright("at", 33))
    sizes = rows.groupBy(F.col("range").alias("of")).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("of", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), F.col("range") == F.col("of")).withColumn(
        "number", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "of", "before")


def parents(below: list[str]) -> list[str]:
    return [digest("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)]


def raised(nodes: DataFrame, base: int, *, inner: bool) -> DataFrame:
    """From ``tree``, ``n`` (nodes of its level), ``place``, ``node`` on one level: the nodes up to LEVELS higher, or up to the tree's root,
    with their ``level`` and its ``n``. Without ``inner`` only the highest ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "level", "n", "place", "node"]
        tree, n, block, held, out = None, 0, 0, [], []

        def close() -> None:
            below, left, first = held, n, block * BLOCK
            for level in range(base + 1, base + LEVELS + 1):
                if left == 1:
                    break
                below, left, first = parents(below), -(-left // ARITY), first // ARITY
                if inner or left == 1 or level == base + LEVELS:
                    out.extend((tree, level, left, first + i, node) for i, node in enumerate(below))
            if n == 1:  # the tree is this node
                out.append((tree, base, 1, 0, held[0]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])], names)

        for batch in batches:
            for t, many, place, node in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, place // BLOCK) != (tree, block):
                    if held:
                        close()
                    tree, n, block, held = t, many, place // BLOCK, []
                held.append(node)
            if len(out) > BLOCK:
                yield batch_of(out)
                out.clear()
        if held:
            close()
        if out:
            yield batch_of(out)

    return nodes.select("tree", "n", "place", "node").repartition("tree", F.floor(F.col("place") / BLOCK)).sortWithinPartitions(
        "tree", "place").mapInArrow(run, "tree long, level long, n long, place long, node string")


def built(nodes: DataFrame, *, inner: bool) -> DataFrame:
    """All that ``raised`` makes of one level, block upon block, up to every tree's root (``n`` = 1): as many rounds as the largest tree has
    times LEVELS levels."""
    made, base = [written(raised(nodes, 0, inner=inner))], 0
    while True:
        base += LEVELS
        open_ = made[-1].where((F.col("level") == base) & (F.col("n") > 1))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, made)
        made.append(written(raised(open_, base, inner=True)))


def octopus(places: np.ndarray, n: int) -> list[np.ndarray]:
    """For each level below the root of a tree of ``n`` leaves, the places that the paths of ``places`` need and they do not give."""
    out, places = [], np.unique(places)
    while n > 1:
        runs = np.unique(places // ARITY)
        every = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append(np.setdiff1d(every[every < n], places, assume_unique=True))
        places, n = runs, -(-n // ARITY)
    return out


class Grove:
    """What a part holds of one tree: its leaves, the fetched nodes, and what follows from both."""

    def __init__(self, leaves: dict[int, str], n: int, fetched: dict[tuple[int, int], str]):
        self.levels: list[dict[int, str]] = [leaves]
        missing = octopus(np.fromiter(leaves, np.int64, len(leaves)), n)
        for level, places in enumerate(missing):
            known = self.levels[-1]
            runs = {place // ARITY for place in known}
            known.update((place, fetched[level, place]) for place in places.tolist())
            self.levels.append({run: digest("".join(self.run(level, run))) for run in sorted(runs)})
        self.root = next(iter(self.levels[-1].values()))

    def run(self, level: int, run: int) -> list[str]:
        """The children of a node."""
        known = self.levels[level]
        return [known[place] for place in range(run * ARITY, run * ARITY + ARITY) if place in known]

    def siblings(self, place: int) -> list[list[str]]:
        """For each level, the others of the run."""
        out = []
        for level in range(len(self.levels) - 1):
            children = self.run(level, place // ARITY)
            del children[place % ARITY]
            out.append(children)
            place //= ARITY
        return out


def folded(node: str, place: int, siblings: list[list[str]]) -> str:
    """The root that a leaf and its siblings give."""
    for others in siblings:
        at = place % ARITY
        node, place = digest("".join([*others[:at], node, *others[at:]])), place // ARITY
    return node


def manifest(df: DataFrame, *, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", tampered: dict[str, Column] | None = None,
             siblings: bool = False) -> DataFrame:
    """The manifest of ``df`` with a proof for every row, and the check of its proof against ``tampered`` values of some fields.

    Columns: key, leaf, subroot, root, proof_sha256, folded_root, verified; with ``siblings`` also the proof itself, a list for each level,
    those of the tree above after those of the group's. Within a group leaves go by key (null first), equal keys by leaf; groups go bytewise,
    null first. Repeated rows are leaves of their own; columns other than ``fields`` do not count. An empty table gives no rows.
    """
    column = {name: F.col(f"`{name}`") for name in {*fields, group, key}}
    changed = column | (tampered or {})
    kind = df.schema[key].dataType.simpleString()
    leaves = written(df.select(column[key].alias("row_key"), column[group].cast("string").alias("of_group"), leaf(*(column[f] for f in fields)).alias("node"),
                               leaf(*(changed[f] for f in fields)).alias("other")))
    rows = numbered(leaves, *(F.col(c).asc_nulls_first() for c in ("of_group", "row_key", "node", "other")))
    # a group's first number and size, through its runs in the ranges: a large group has one row for each range
    runs = written(rows.groupBy("range", "of_group").agg(F.min("number").alias("low"), F.count("*").alias("many")))
    trees = written(numbered(runs.groupBy(F.col("of_group").alias("tree_group")).agg(F.min("low").alias("first"), F.sum("many").alias("n")), F.col("first")).select(
        "tree_group", "first", "n", F.col("number").alias("tree")))
    known = runs.join(trees, F.col("of_group").eqNullSafe(F.col("tree_group"))).select(
        F.col("range").alias("in_range"), "tree_group", "first", "n", "tree")
    place = F.col("number") - F.col("first")
    placed = written(rows.join(known, (F.col("range") == F.col("in_range")) & F.col("of_group").eqNullSafe(F.col("tree_group"))).select(
        "row_key", "node", "other", "tree", "n", place.alias("place"),
        F.floor((F.col("first") + F.floor(place / BLOCK) * BLOCK) / PART).alias("part")))

    below = written(built(placed, inner=False))
    subroots = below.where("n = 1").select(F.lit(ABOVE).cast("long").alias("tree"), F.col("tree").alias("place"), "node")
    many = trees.count()
    first = subroots.withColumn("n", F.lit(many).cast("long")).withColumn("level", F.lit(0).cast("long"))
    above = built(first, inner=True)
    names = ["tree", "level", "place", "node"]
    nodes = below.select(names).unionByName(first.select(names)).unionByName(above.select(names))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The missing coordinates of whole parts."""
        part, held = None, []

        def union() -> pa.RecordBatch:
            found = [(tree, level, p) for tree, n, low, high in held for level, places in enumerate(octopus(np.arange(low, high + 1), n)) for p in places.tolist()]
            found += [(ABOVE, level, p) for level, places in enumerate(octopus(np.array([x[0] for x in held]), many)) for p in places.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int64()), *(pa.array(x, pa.int64()) for x in (zip(*found) if found else [()] * 3))],
                                              ["part", "tree", "level", "place"])

        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and held:
                    yield union()
                    held = []
                part = p
                held.append(row)
        if held:
            yield union()

    parts = placed.groupBy("part", "tree").agg(F.first("n").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"))
    wanted = parts.select("part", "tree", "n", "low", "high").repartition("part").sortWithinPartitions("part").mapInArrow(
        needed, "part long, tree long, level long, place long")
    null = F.lit(None)
    fetched = wanted.join(nodes, ["tree", "level", "place"]).select(
        "part", "tree", "level", "place", "node", null.cast("long").alias("n"), null.cast("string").alias("other"), null.cast(kind).alias("row_key"))
    own = placed.select("part", "tree", null.cast("long").alias("level"), "place", "node", "n", "other", "row_key")

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole parts, a part's fetched nodes (with a level) and its leaves."""
        part, held = None, []

        def close() -> pa.RecordBatch:
            nodes: dict[int, dict[tuple[int, int], str]] = {}
            mine: dict[int, dict[int, str]] = {}
            size = {}
            for _, tree, level, place, node, n, _, _ in held:
                if level is None:
                    mine.setdefault(tree, {})[place] = node
                    size[tree] = n
                else:
                    nodes.setdefault(tree, {})[level, place] = node
            groves = {tree: Grove(leaves, size[tree], nodes.get(tree, {})) for tree, leaves in mine.items()}
            top = Grove({tree: grove.root for tree, grove in groves.items()}, many, nodes.get(ABOVE, {}))
            out = []
            for _, tree, level, place, node, _, other, name in held:
                if level is None:
                    inside, outside = groves[tree].siblings(place), top.siblings(tree)
                    lists = inside + outside
                    root = folded(folded(other, place, inside), tree, outside)
                    out.append((name, node, groves[tree].root, top.root, digest("".join(x for level in lists for x in level)), root, root == top.root, lists))
            columns = [pa.array(x, t) for x, t in zip(zip(*out), [key_type[0], *[pa.string()] * 5, pa.bool_(), pa.list_(pa.list_(pa.string()))])]
            return pa.RecordBatch.from_arrays(columns if siblings else columns[:-1], names)

        names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["siblings"] * siblings]
        key_type = [pa.null()]
        for batch in batches:
            key_type[0] = batch.schema.field(7).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != part and held:
                    yield close()
                    held = []
                part = row[0]
                held.append(row)
        if held:
            yield close()

    return own.unionByName(fetched).repartition("part").sortWithinPartitions("part").mapInArrow(
        proofs, f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        + ", siblings array<array<string>>" * siblings)


def without_newlines(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Tampering with every other row, told by its key's checksum: its text loses all newlines."""
    even = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 2 == 0
    return {text: F.when(even, F.replace(F.col(f"`{text}`"), F.lit("\n"), F.lit(""))).otherwise(F.col(f"`{text}`"))}


def sql(levels: int = 16) -> str:
    """The same over ``documents`` in DuckDB, for up to 3**levels leaves a tree: every level is a table."""
    def leaf_sql(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in (*FIELDS[:-1], text)) + ")"

    def up(name: str, k: int) -> str:
        return f"""
        {name}{k + 1} AS (SELECT source, p // 3 AS p, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h,
            (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY source, p // 3)"""

    def fold(name: str, k: int, before: str, after: str, place: str) -> str:
        own, path = f"{place} // {3**k}", f"[x.h FOR x IN r.hs IF x.p <> {place} // {3**k}]"
        return f"""
        {after} AS (SELECT b.* EXCLUDE (proof, folded), CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string({path}, '') END AS proof,
            CASE WHEN r.n = 1 THEN folded ELSE sha256(array_to_string([CASE WHEN x.p = {own} THEN folded ELSE x.h END FOR x IN r.hs], '')) END AS folded
            FROM {before} b JOIN (SELECT source, p // 3 AS run, any_value(n) AS n, list({{'p': p, 'h': h}} ORDER BY p) AS hs FROM {name}{k} GROUP BY source, p // 3) r
            ON r.source IS NOT DISTINCT FROM b.{'source' if name == 't' else 'top'} AND r.run = {place} // {3**(k + 1)})"""

    step = "list_reduce(list_prepend(xor(c, b), [CAST(0 AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST(ascii(d) AS UBIGINT) FOR d IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: {step}))"""
    parts = [f"""
        docs AS (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents),
        leaves AS (SELECT doc_id, source, 0 AS top, {leaf_sql('text')} AS leaf, {leaf_sql('tampered')} AS other FROM docs),
        placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS place FROM leaves),
        t0 AS (SELECT source, place AS p, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM placed)""", *(up("t", k) for k in range(levels)), f"""
        u0 AS (SELECT 0 AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, h, count(*) OVER () AS n FROM t{levels}),
        names AS (SELECT source AS name, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spot, h AS subroot FROM t{levels})""", *(up("u", k) for k in range(levels)), """
        f0 AS (SELECT p.*, spot, subroot, '' AS proof, other AS folded FROM placed p JOIN names ON p.source IS NOT DISTINCT FROM name)"""]
    parts += [fold("t", k, f"f{k}", f"f{k + 1}", "place") for k in range(levels)]
    parts += [fold("u", k, f"f{levels + k}", f"f{levels + k + 1}", "spot") for k in range(levels)]
    return "WITH" + ",".join(parts) + f"""
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
        FROM f{2 * levels} CROSS JOIN (SELECT h FROM u{levels})"""
