"""Packing documents into sequences by shortest-pack-first over the histogram of lengths (operator 9).

Only the histogram, at most one number per length, decides how lengths are put together. Documents meet their places
by rank among the pieces of equal length, so nothing that grows with the corpus passes one task or the driver.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscape.llm.common import make_room, rows_of, written

END = 1
#: Entries of a worker's cache of encoded words.
CACHE = 800_000


#: A stop or comma next to another mark, with which it may form one token.
MARKS = re.compile(r"(?:[^\w \n]|_)[.,]|[.,](?:[^\w \n]|_)")


class WordEncoder:
    """Encodes text word by word. This kind of vocabulary takes lower case, and white space always separates its tokens, so words
    can be brought to few forms before they are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if "\u03a3" not in text and "\u0130" not in text:  # whose lower case depends on its place, or is two characters
            text = text.lower()
            if not MARKS.search(text):  # then every stop and comma is a token of its own
                text = text.replace(".", " . ").replace(",", " , ")
        words = text.replace("\n", " ").split(" ")
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > CACHE:
                self.forget()
                new = set(words).difference(known)
            self.learn(new)
        return b"".join(map(known.__getitem__, words))


    def learn(self, new: set[str]) -> None:
        words = list(new)
        for word, encoding in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.known[word] = np.array(encoding.ids, "<u4").tobytes()

    def forget(self) -> None:
        """Make room; short words are the ones that come again."""
        kept = {word: ids for word, ids in self.known.items() if len(word) <= 7}
        self.known.clear()
        self.known.update(kept if len(kept) < CACHE // 2 else {})


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """One per worker process, so that what it has seen serves later tasks too."""
    return WordEncoder(path)


def cut(df: DataFrame, path: str, *, size: int = 2048, end: int = END, key: str = "doc_id",
        text: str = "text") -> DataFrame:
    """Each document's ids, closed by ``end``, in pieces of ``size`` and a shorter last one.

    Columns: key, start, length, ids_crc32, doc_tokens. A null or empty text is the one id ``end``. Rows of equal key
    are documents of their own.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = encoder_of(path), np.array([end], "<u4").tobytes()
        make_room("packing", encoder_of.cache_clear)
        for batch in rows_of(batches):
            source, start, length, crc, total = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = encoder.ids(value.as_py() or "") + last
                n = len(ids) // 4
                for at in range(0, n, size):
                    piece = ids[4 * at:4 * (at + size)]
                    source.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *numbers], names)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many, lengths) of the packs for ``counts`` pieces of each length.

    Lengths go longest first, each into the shortest pack, which has the most room; equal packs are one entry with a
    count, and a count is split only where fewer pieces than packs are left.
    """
    heap: list[tuple[int, int]] = []
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(used: int, many: int, lengths: tuple[int, ...]) -> None:
        if used not in packs:
            packs[used] = []
            heapq.heappush(heap, (used, used))
        packs[used].append((many, lengths))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and heap and heap[0][0] + length <= size:
            used = heap[0][0]
            many, lengths = packs[used].pop()
            if not packs[used]:
                del packs[used]
                heapq.heappop(heap)
            moved = min(many, left)
            if many > moved:
                put(used, many - moved, lengths)
            # what has just been placed is open again at once and may take another piece of this length
            put(used + length, moved, (*lengths, length))
            left -= moved
        each = size // length  # new packs hold as many pieces of this length as fit
        full, rest = divmod(left, each)
        if full:
            put(length * each, full, (length,) * each)
        if rest:
            put(length * rest, 1, (length,) * rest)
    return sorted((many, lengths) for used in packs for many, lengths in packs[used])


def segments_of(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, first sequence, offset): ranks from there on are in consecutive sequences."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for many, lengths in patterns:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            rows.setdefault(length, []).append((first, sequence, offset))
            taken[length] = first + many
            offset += length
        sequence += many
    return {length: np.array(found, np.int64) for length, found in rows.items()}


def ranked(pieces: DataFrame, key: str) -> DataFrame:
    """Number pieces of equal length from 0. ``part`` says which task made a piece; a length's pieces are counted by
    part first, so that no task sees a whole length."""
    counts = pieces.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy(key, "start", "doc_tokens", "ids_crc32"))
    return pieces.withColumn("inside", inside).join(starts, ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("inside") - 1).drop("inside", "before")


def pack(df: DataFrame, path: str, *, size: int = 2048, end: int = END, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """``cut`` with sequence_id and offset. Sequences are filled without gaps from 0; ties go by key and start."""
    pieces = written(cut(df, path, size=size, end=end, key=key, text=text).withColumn("part", F.spark_partition_id()))
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    segments = segments_of(shortest_pack_first(counts, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = segments[int(length)]
                mine = np.flatnonzero(lengths == length)
                at = np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1
                sequence[mine] = rows[at, 1] + ranks[mine] - rows[at, 0]
                offset[mine] = rows[at, 2]
            kept = [batch.column(c) for c in (key, "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)],
                                             [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = df.schema[key].dataType.simpleString()
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return ranked(pieces, key).mapInArrow(place, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in names))
