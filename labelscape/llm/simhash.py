"""SimHash near-duplicates by a generalised pigeonhole search (operator 12).

A fingerprint's bits are dealt to parts, bits that go together to the same part. If every fingerprint gives each part a
threshold and thresholds plus one add up to the distance plus one, then whoever lies within the distance of it lies within
the threshold of some part: otherwise each part would differ in its threshold plus one bits at least. So it needs to meet only those
whose part is one of the values within the threshold. Thresholds differ from part to part and from fingerprint to
fingerprint: dynamic programming deals them out so that values to look up and candidates expected there cost least, and parts that
hold common values get less or are not asked at all (threshold -1).

Candidates of a value are estimated from histograms of pieces of at most 13 bits over all fingerprints; pieces of one part count
as independent. The number of parts is the one whose cost, summed over all fingerprints, is smallest: few documents take five parts and
exact look-ups, more take fewer and longer parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscape.llm.common import having, lacking, rows_of, written
from labelscape.llm.components import components, stars

BITS, SEED, WIDTH = 64, 42, 4
#: Bits of a histogram's piece at most; a value is compared with so many others in the time of looking up one more.
PIECE, COMPARED = 13, 64
#: A value's fingerprints are met in blocks of at most so many; pairs are compared, and links kept, up to so many at once.
BLOCK, AT_ONCE = 512, 1 << 20


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """A bit is 1 if more than half the shingles' hashes have it, repeats included; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.append(0, ends)[:len(words) - width + 1], ends[width - 1:] - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        some = [digest(data[i:j], SEED) for i, j in zip(starts[at:at + (1 << 16)].tolist(), ends[at:at + (1 << 16)].tolist())]
        ones += bits_of(np.array(some, np.uint64)).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(starts)).tolist())


def bits_of(values: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each number, the lowest bit first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``row_key`` and ``print``, the fingerprint as a signed number, for every row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = np.array([fingerprint(value.as_py(), width) for value in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["row_key", "print"])

    return df.select(key, text).mapInArrow(run, f"row_key {kind}, print long")


def together(prints: DataFrame) -> np.ndarray:
    """The bits in an order that keeps correlated ones side by side. Pairs of ones are counted in the tasks: 4,096 sums leave them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = bits_of(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            both += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["at", "many"])

    sums = np.zeros(BITS * BITS + 1)
    for row in prints.mapInArrow(run, "at long, many long").groupBy("at").agg(F.sum("many").alias("many")).collect():
        sums[row["at"]] = row["many"]
    n = max(1.0, sums[-1])
    both = sums[:-1].reshape(BITS, BITS) / n
    mean = both.diagonal()
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    like = np.abs(both - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(like, 0)
    order = [int(like.max(axis=1).argmax())]
    left = sorted(set(range(BITS)) - set(order))
    while left:  # the bit that goes best with the last ones
        best = max(left, key=lambda i: (like[i, order[-8:]].sum(), -i))
        order.append(best)
        left.remove(best)
    return np.array(order)


def shares(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


@dataclass(frozen=True)
class Parts:
    """One way of dealing the bits: each part's bits, in pieces."""

    order: tuple[int, ...]
    many: int
    distance: int

    def pieces(self) -> list[list[tuple[int, ...]]]:
        out, at = [], 0
        for size in shares(BITS, self.many):
            part = []
            for width in shares(size, -(-size // PIECE)):
                part.append(self.order[at:at + width])
                at += width
            out.append(part)
        return out

    def widths(self) -> list[int]:
        return shares(BITS, self.many)

    def values(self, bits: np.ndarray) -> list[list[np.ndarray]]:
        """Each piece's value of every fingerprint."""
        return [[bits[:, list(piece)] @ (1 << np.arange(len(piece), dtype=np.int64)) for piece in part] for part in self.pieces()]

    def part_values(self, pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
        out = []
        for part, held in zip(self.pieces(), pieces):
            value, shift = np.zeros_like(held[0]), 0
            for piece, one in zip(part, held):
                value, shift = value | one << shift, shift + len(piece)
            out.append(value)
        return out

    def lookups(self, part: int, threshold: int) -> int:
        return sum(comb(self.widths()[part], e) for e in range(threshold + 1))


def near_counts(histogram: np.ndarray, distance: int) -> np.ndarray:
    """For each value, how many lie at exactly 0, 1, ... bits from it: one more bit may differ or not."""
    out = np.zeros((distance + 1, len(histogram)))
    out[0] = histogram
    bit, at = 1, np.arange(len(histogram))
    while bit < len(histogram):
        flipped = out[:, at ^ bit]
        out[1:] += flipped[:-1]
        bit <<= 1
    return out


@dataclass
class Plan:
    """Parts with what is known of the values: ``near[part][piece]`` from ``near_counts``, as shares of all."""

    parts: Parts
    near: list[list[np.ndarray]]
    total: int

    def costs(self, pieces: list[list[np.ndarray]]) -> np.ndarray:
        """(part, threshold + 1, fingerprint): values to look up and, in the same unit, candidates to compare."""
        distance, n = self.parts.distance, len(pieces[0][0])
        out = np.zeros((self.parts.many, distance + 2, n))
        for i, (held, near) in enumerate(zip(pieces, self.near)):
            exact = np.zeros((distance + 1, n))
            exact[0] = 1
            for value, table in zip(held, near):
                here = table[:, value]
                exact = np.stack([sum(exact[e - k] * here[k] for k in range(e + 1)) for e in range(distance + 1)])
            out[i, 1:] = np.cumsum(exact, axis=0) * self.total / COMPARED
            for t in range(distance + 1):
                out[i, t + 1] += self.parts.lookups(i, t) if t <= self.parts.widths()[i] else np.inf
        return out

    def thresholds(self, pieces: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(part, fingerprint) thresholds of least cost whose sum, each plus one, is the distance plus one; and that cost."""
        costs, room = self.costs(pieces), self.parts.distance + 1
        n = costs.shape[2]
        best = np.full((room + 1, n), np.inf)
        best[0] = 0
        taken = []
        for part in costs:
            options = np.stack([np.stack([best[r - s] + part[s] if s <= r else np.full(n, np.inf) for s in range(room + 1)]) for r in range(room + 1)])
            taken.append(options.argmin(axis=1))
            best = options.min(axis=1)
        out, left, at = np.zeros((len(costs), n), np.int64), np.full(n, room), np.arange(n)
        for i in range(len(costs) - 1, -1, -1):
            spent = taken[i][left, at]
            out[i] = spent - 1
            left = left - spent
        return out, best[room]


def plans(prints: DataFrame, distance: int, choices: tuple[int, ...]) -> list[Plan]:
    """A plan for each number of parts. Histograms are added up in tasks; at most a few ten thousand sums reach the driver."""
    order = tuple(together(prints).tolist())
    every = [Parts(order, many, distance) for many in choices]
    sizes = [1 << len(piece) for parts in every for part in parts.pieces() for piece in part]
    begin = np.cumsum([0, *sizes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(begin[-1], np.int64)
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy().view(np.uint64))
            values = [one for parts in every for part in parts.values(bits) for one in part]
            for start, size, one in zip(begin, sizes, values):
                sums[start:start + size] += np.bincount(one, minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "many"])

    found = prints.mapInArrow(run, "at long, many long").groupBy("at").agg(F.sum("many").alias("many")).toArrow()
    sums = np.zeros(begin[-1])
    sums[found.column("at").to_numpy()] = found.column("many").to_numpy()
    total = int(sums[:sizes[0]].sum())
    tables = iter([near_counts(sums[start:start + size] / max(1, total), distance) for start, size in zip(begin, sizes)])
    return [Plan(parts, [[next(tables) for _ in part] for part in parts.pieces()], total) for parts in every]


def cheapest(prints: DataFrame, choices: list[Plan]) -> Plan:
    """The plan whose costs, summed over all fingerprints, are least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(choices))
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy().view(np.uint64))
            sums += [plan.thresholds(plan.parts.values(bits))[1].sum() for plan in choices]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(choices))), pa.array(sums)], ["plan", "cost"])

    found = {row["plan"]: row["cost"] for row in prints.mapInArrow(run, "plan long, cost double").groupBy("plan").agg(F.sum("cost").alias("cost")).collect()}
    return min(enumerate(choices), key=lambda x: (found.get(x[0], 0.0), x[0]))[1]


def probes(prints: DataFrame, plan: Plan) -> DataFrame:
    """``value`` (with its part's number), ``print``, ``kept``, ``asks``: where each fingerprint is kept, in every part, and where it is looked up."""
    widths = plan.parts.widths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {}
        for batch in batches:
            own = batch.column(0).to_numpy()
            pieces = plan.parts.values(bits_of(own.view(np.uint64)))
            limits, _ = plan.thresholds(pieces)
            for i, (value, limit) in enumerate(zip(plan.parts.part_values(pieces), limits)):
                head = value | np.int64(i) << 40
                asks = limit >= 0
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(own), pa.array(np.ones(len(own), bool)), pa.array(asks)], names)
                for e in range(1, int(limit.max(initial=-1)) + 1):
                    if (widths[i], e) not in flips:
                        flips[widths[i], e] = np.array([sum(1 << b for b in some) for some in combinations(range(widths[i]), e)], np.int64)
                    mine = np.flatnonzero(limit >= e)
                    changed = (head[mine, None] ^ flips[widths[i], e][None, :]).ravel()
                    who = np.repeat(own[mine], len(flips[widths[i], e]))
                    yield pa.RecordBatch.from_arrays([pa.array(changed), pa.array(who), pa.array(np.zeros(len(who), bool)), pa.array(np.ones(len(who), bool))], names)

    names = ["value", "print", "kept", "asks"]
    return prints.mapInArrow(run, "value long, print long, kept boolean, asks boolean")


def in_units(rows: DataFrame, block: int) -> DataFrame:
    """Rows with ``one`` and ``other``: a value's kept fingerprints in blocks by hash, and for each of them its askers in blocks.

    Values with few rows are one unit. Of the others every kept row goes to all blocks of askers and every asker to all blocks of kept
    rows, so a unit has at most about 2 ``block`` rows, whatever a value has.
    """
    many = written(rows.groupBy("value").agg(F.count_if("kept").alias("n_kept"), F.count_if("asks").alias("n_asks")).where(
        (F.col("n_kept") > block) | (F.col("n_asks") > block)))
    zero = F.lit(0).cast("int")
    few = lacking(rows, many.select("value"), "value").select("*", zero.alias("one"), zero.alias("other"))
    cut = having(rows, many.select("value"), "value").join(many, "value").withColumn(
        "blocks", F.ceil(F.col("n_kept") / block).cast("int")).withColumn("askers", F.ceil(F.col("n_asks") / block).cast("int"))
    hashed = F.xxhash64("print")
    kept = cut.where("kept").select("value", "print", F.lit(True).alias("kept"), F.lit(False).alias("asks"),
                                    F.pmod(hashed, F.col("blocks")).cast("int").alias("one"), F.explode(F.sequence(zero, F.greatest(F.col("askers") - 1, zero))).alias("other"))
    asks = cut.where("asks").select("value", "print", F.lit(False).alias("kept"), F.lit(True).alias("asks"),
                                    F.explode(F.sequence(zero, F.greatest(F.col("blocks") - 1, zero))).alias("one"), F.pmod(hashed, F.greatest("askers", F.lit(1))).cast("int").alias("other"))
    return few.unionByName(kept).unionByName(asks)


def links(prints: DataFrame, distance: int = 4, *, choices: tuple[int, ...] = (5, 4, 3, 2), block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: pairs of different fingerprints that connect all within the distance, in whole groups but not every pair.

    ``prints`` has one column of distinct numbers. Every pair within the distance is found by its task, which then hands on only
    enough of them to connect what they connect.
    """
    plan = cheapest(prints, plans(prints, distance, choices))
    rows = written(probes(prints, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((5, 0), np.int64)]
        edges: list[np.ndarray] = []

        def compared(unit: np.ndarray) -> None:
            """``unit`` has whole units: value, one, other, print, flags (1 kept, 2 asks)."""
            new = np.append(True, (unit[:3, 1:] != unit[:3, :-1]).any(axis=0))
            group = np.cumsum(new) - 1
            kept, asks = np.flatnonzero(unit[4] & 1), np.flatnonzero(unit[4] & 2)
            first = np.searchsorted(group[kept], np.arange(group[-1] + 2))
            here = np.diff(first)[group[asks]]
            asks, here = asks[here > 0], here[here > 0]
            before = np.cumsum(here)
            start = 0
            while start < len(asks):  # at least one asker, at most so many comparisons
                stop = max(start + 1, int(np.searchsorted(before, (before[start - 1] if start else 0) + AT_ONCE, side="right")))
                some, n = asks[start:stop], here[start:stop]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group[some]], n)
                one, other = np.repeat(unit[3, some], n), unit[3, kept[at]]
                near = (np.bitwise_count((one ^ other).view(np.uint64)) <= distance) & (one != other)
                if near.any():
                    edges.append(np.stack([one[near], other[near]]))
                start = stop
            if sum(e.shape[1] for e in edges) > AT_ONCE:
                edges[:] = [np.stack(stars(*np.concatenate(edges, axis=1)))]

        for batch in batches:
            flags = batch.column(2).cast(pa.int64()).to_numpy() + 2 * batch.column(3).cast(pa.int64()).to_numpy()
            held.append(np.stack([*(batch.column(i).cast(pa.int64()).to_numpy() for i in (0, 4, 5, 1)), flags]))
            if sum(x.shape[1] for x in held) > 1 << 16:
                rows = np.concatenate(held, axis=1)
                whole = int(np.flatnonzero((rows[:3] != rows[:3, -1:]).any(axis=0)).max(initial=-1)) + 1
                if whole:
                    compared(rows[:, :whole])
                held = [rows[:, whole:]]
        rows = np.concatenate(held, axis=1)
        if rows.shape[1]:
            compared(rows)
        if edges:
            a, b = stars(*np.concatenate(edges, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return in_units(rows, block).select("value", "print", "kept", "asks", "one", "other").repartition("value", "one", "other").sortWithinPartitions(
        "value", "one", "other").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, distance: int = 4, *, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                    choices: tuple[int, ...] = (5, 4, 3, 2), block: int = BLOCK) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable over fingerprints within ``distance`` bits.

    Texts without words have fingerprint 0, linked like any other. Equal fingerprints are one in the search. Null keys keep their
    rows but are no component's name unless it has no other. Repeated rows stay, other columns are not read, an empty table gives no rows.
    """
    docs = written(fingerprints(df, key=key, text=text, width=width))
    classes = written(docs.groupBy("print").agg(F.min("row_key").alias("first")))
    found = components(written(links(classes.select("print"), distance, choices=choices, block=block)))
    labelled = classes.join(found.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("label", "print").alias("label"))
    names = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = written(labelled.join(names, "label").select("print", "component_id"))
    return docs.join(by_print, "print").select(F.col("row_key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
