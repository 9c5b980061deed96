"""Document fingerprints by order MinHash (operator 6).

Every k-mer of a text is numbered by how often it has occurred before. Each of the hash functions picks the few
numbered k-mers with the smallest values, puts them back into text order and hashes that tuple. Two signatures agree at
a place only if the same k-mers were picked and stand in the same order, so likeness follows edit distance and not
mere shared content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscape.llm.common import rows_of, spread

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


@dataclass(frozen=True)
class Sketch:
    """``k`` code points a k-mer, ``picks`` k-mers a tuple, ``size`` tuples a signature."""

    k: int = 6
    picks: int = 2
    size: int = 64
    seed: int = 7

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(self.seed)
        return (random.integers(0, 1 << 31, self.size, np.uint32) * np.uint32(2) + np.uint32(1),
                random.integers(0, 1 << 32, self.size, np.uint32))

    def occurrences(self, text: str) -> np.ndarray:
        """One 64-bit number for each k-mer and occurrence, in text order; a shorter text is one k-mer."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if not len(codes):
            return codes
        width = min(self.k, len(codes))
        n = len(codes) - width + 1
        grams = codes[:n].copy()
        for i in range(1, width):
            grams *= MULTIPLIER
            grams += codes[i:i + n]
        grams = mixed(grams)
        # sort by k-mer, then place: the places of equal k-mers follow each other
        bits = np.uint64(n.bit_length())
        order = np.sort((grams >> bits << bits) | np.arange(n, dtype=np.uint64))
        same = order >> bits
        first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        if len(first) < n:
            at = np.arange(n)
            start = np.zeros(n, np.int64)
            start[first] = first
            number = np.zeros(n, np.uint64)
            number[(order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = at - np.maximum.accumulate(start)
            grams = mixed(grams + number * MULTIPLIER)
        return grams

    def signature(self, text: str, factors: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """``size`` 32-bit numbers; the empty text has zeros."""
        multiply, add = factors or self.factors()
        grams = self.occurrences(text)
        if not len(grams):
            return np.zeros(self.size, np.uint32)
        short = (grams >> np.uint64(32)).astype(np.uint32)
        rows = np.arange(self.size)
        values = short[None, :] * multiply[:, None]
        values ^= add[:, None]
        picked = []
        for _ in range(min(self.picks, len(grams))):
            best = values.argmin(axis=1)
            picked.append(best)
            values[rows, best] = np.uint32(0xFFFFFFFF)
        places = np.sort(np.stack(picked, axis=1), axis=1)
        out = np.full(self.size, len(picked), np.uint64)
        for column in places.T:
            out = mixed(out * MULTIPLIER + grams[column])
        return (out >> np.uint64(32)).astype(np.uint32)


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float(np.count_nonzero(one == other)) / len(one)


def fingerprints(df: DataFrame, sketch: Sketch = Sketch(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` (hex) of every row; a null text is empty, repeated rows stay, other columns are not read."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = sketch.factors()
        for batch in rows_of(batches):
            prints = [shown(sketch.signature(value.as_py() or "", factors)) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], [key, "fingerprint"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def in_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in blocks of neighbouring keys, the largest first, each block followed by the next block's first row (``look``).

    After the last block comes the first again. Null keys come last. Rows of equal key are ordered by text, descending.
    Only the blocks' boundaries, one number each, pass the driver.
    """
    blocks = spread(df, 4 << 20)
    bounds = df.agg(F.percentile_approx(key, [i / blocks for i in range(blocks)], 20 * blocks)).head()[0] or []
    cuts = np.unique(np.array(bounds, np.int64))
    last = max(0, len(cuts) - 1)

    def block_of(keys: pa.Array) -> np.ndarray:
        if not len(cuts):
            return np.zeros(len(keys), np.int64)
        # cuts[0] is the smallest key; a null key goes with it
        values = keys.fill_null(int(cuts[0])).to_numpy(zero_copy_only=False)
        return last - np.clip(np.searchsorted(cuts, values, side="right") - 1, 0, last)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = block_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(0)], ["block", "first"])

    found = df.select(F.col(key).cast("long").alias("first")).mapInArrow(largest, "block long, first long").groupBy(
        "block").agg(F.max("first").alias("first")).orderBy("block").collect()  # one row a block
    before = {row["first"]: found[i - 1]["block"] for i, row in enumerate(found)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "look", "key", "text"]
        firsts = pa.array(list(before), pa.int64())
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block_of(keys)), pa.array(np.zeros(len(keys), bool)), keys, texts], names)
            again = np.flatnonzero(pc.is_in(keys, value_set=firsts).to_numpy(zero_copy_only=False))
            if len(again):
                keys, texts = keys.take(pa.array(again)), texts.take(pa.array(again))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([before[k.as_py()] for k in keys], pa.int64()), pa.array(np.ones(len(keys), bool)), keys, texts],
                    names)

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        dealt, "block long, look boolean, key long, text string")


def neighbour_edits(df: DataFrame, sketch: Sketch = Sketch(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form, and compare both it and the next text's with the text's own.

    The next row is that of the next smaller integer ``key`` (after the last: the first; a lone row is its own next). The edited text has its
    last floor(n/2) code points replaced by the first as many of the next text, or all. Null texts are empty, null keys come
    last, rows of equal key are ordered by text. Rows arrive in key order, so a task holds two texts at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = sketch.factors()
        held = None  # block, key, text, signature

        def row(one, following):
            _, name, own, mine = one
            half = len(own) // 2
            edited = own[:len(own) - half] + following[2][:half]
            other = sketch.signature(edited, factors)
            return (name, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(mine),
                    shown(other), likeness(mine, other), likeness(mine, following[3]))

        for batch in rows_of(batches):
            rows = []
            for block, look, name, value in zip(*(c.to_pylist() for c in batch.columns)):
                value = value or ""
                now = (block, name, value, sketch.signature(value, factors))
                if held is not None and held[0] == block:
                    rows.append(row(held, now))
                held = None if look else now
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return in_blocks(df, key, text).repartition("block").sortWithinPartitions(
        "block", "look", F.col("key").desc_nulls_last(), F.col("text").desc_nulls_last()).mapInArrow(
        run, f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
