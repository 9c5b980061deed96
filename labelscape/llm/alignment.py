"""Cross-tokenizer alignment by pointer jumping (operator 11).

Two vocabularies cut the same bytes into tokens. Tokens whose byte ranges overlap belong together, and so does what
they overlap in turn: such a group lies between two byte offsets where tokens of both end. Every token points to the
token farthest to the right that it overlaps, or to itself; following the pointers of the pointers doubles the steps of
each round, until all tokens of a group point to its last one, whose place is the group's label.

How often an id of one vocabulary lies over an id of the other is counted over all documents. Tasks count the pairs of a
unit of documents, units add up in a shuffle, and each unit gets the sums of its own pairs back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscape.llm.common import make_room, rows_of, written

#: Texts are aligned together up to so many letters, and counted together up to so many links; a longer text is alone.
TOGETHER, UNIT = 1 << 20, 1 << 20
#: Encoded words that a worker keeps, twice: when so many are new, those before them are dropped unless they came again.
CACHE = 200_000
#: A single blank before a letter, digit or printable mark. Neither tokenizer joins what stands on its two sides: the first cuts there
#: by its pattern; the second if none of its pieces has a blank behind something else.
CUT = re.compile(r"(?<=[^ ]) (?=[!-~\w])")
#: Words that CUT parts from any other one on both sides.
PLAIN = re.compile(r"[!-~\w](?:.*[^ ])?\Z", re.DOTALL)
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in own]
    return {chr(byte): byte for byte in own} | {chr(256 + i): byte for i, byte in enumerate(others)}


def overlapping(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token A, the first and the last token B that it overlaps. Both cut the same bytes without gaps."""
    starts = np.concatenate([np.zeros(1, ends_a.dtype), ends_a[:-1]])
    return np.searchsorted(ends_b, starts, side="right"), np.searchsorted(ends_b, ends_a - 1, side="right")


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The last token of each token's group, by successor doubling. Tokens A are numbered first, then tokens B.

    A token A points to the token B over its last byte. A token B points to the token A over its last byte if that
    reaches farther, and else to itself: it ends where that one ends, which is where the group ends.
    """
    n = len(ends_a)
    if not n:
        return np.zeros(0, np.int64)
    over = np.searchsorted(ends_a, ends_b - 1, side="right")
    successor = np.concatenate([n + np.searchsorted(ends_b, ends_a - 1, side="right"),
                                np.where(ends_a[over] > ends_b, over, n + np.arange(len(ends_b)))])
    while True:
        farther = successor[successor]
        if np.array_equal(farther, successor):
            return successor
        successor = farther


@dataclass
class Aligned:
    """Texts aligned together. Offsets are bytes in the joined texts; a text's tokens are ``from_a[i]:from_a[i + 1]`` and so on."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    from_a: np.ndarray
    from_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all overlapping tokens A and B."""
        first, last = overlapping(self.ends_a, self.ends_b)
        many = last - first + 1
        before = np.cumsum(many) - many
        return np.repeat(np.arange(len(many)), many), np.arange(many.sum()) - np.repeat(before - first, many)

    def from_group(self) -> np.ndarray:
        """Where each text's groups begin."""
        many = int(self.group_b[-1]) + 1 if len(self.group_b) else 0
        return np.append(self.group_b, many)[self.from_b]


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.first.encode_special_tokens = True  # their strings in a text are ordinary text
        names, letters = self.first.get_vocab(with_added_tokens=True), byte_letters()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(letters[x] for x in name) if set(name) <= letters.keys() else name.encode()
        piece = self.second.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.second.is_byte(i) else piece(i).replace("▁", " ").encode()
                        for i in range(self.second.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.bits = max(1, (len(self.bytes_b) - 1).bit_length())
        self.text_bits = max(1, (len(self.bytes_a) - 1).bit_length()) + self.bits
        self.cuts = not any(b" " in word.lstrip(b" ") for word in self.bytes_b)
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.before: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.inexact: set[str] = set()
        # an id's digits with the mark behind it: tokens A inside and at the end of their part, then tokens B
        self.shown = np.array([f"{i}{mark}".encode() for many, marks in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;"))
                               for mark in marks for i in range(many)])

    def learn(self, words: list[str]) -> None:
        """Encode words, a blank before each. Words that stay apart are encoded in one go."""
        if len(words) == 1 or not self.cuts:
            for word in words:
                self.learn_alone(word)
            return
        plain = [word for word in words if PLAIN.match(word)]
        whole = " ".join(plain)
        data, a, b = self.both(whole)
        if not plain or data is None:  # some word is not exactly its tokens
            plain = []
        stops = np.cumsum(np.fromiter((len(word.encode("utf-8", "surrogatepass")) + 1 for word in plain), np.int64, len(plain)))
        for known, ids, length in ((self.known_a, a, self.length_a), (self.known_b, b, self.length_b)):
            at = 4 * np.searchsorted(np.cumsum(length[ids]), stops, side="right")
            held = ids.astype("<u4").tobytes()
            known.update((word, held[i:j]) for word, i, j in zip(plain, [0, *at.tolist()], at.tolist()))
        for word in set(words).difference(plain):
            self.learn_alone(word)

    def learn_alone(self, word: str) -> None:
        data, a, b = self.both(word)
        self.known_a[word], self.known_b[word] = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        if data is None:
            self.inexact.add(word)

    def both(self, text: str) -> tuple[bytes | None, np.ndarray, np.ndarray]:
        """The bytes of a blank and the text, None if they are not those of its tokens, and the ids."""
        data = (" " + text).encode("utf-8", "surrogatepass")
        a, b = self.first.encode(" " + text, add_special_tokens=False).ids, self.second.encode(text)
        exact = b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b))
        return data if exact else None, np.array(a, np.int64), np.array(b, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both as unsigned 32-bit numbers; of a text that is null, empty, or not exactly the bytes of its tokens none."""
        words = [(CUT.split(text) if self.cuts else [text]) if text else [] for text in texts]
        distinct = set(chain.from_iterable(words))
        new = distinct.difference(self.known_a)
        if len(self.known_a) + len(new) > CACHE and self.known_a:
            self.before, self.known_a, self.known_b = (self.known_a, self.known_b), {}, {}
            new = distinct
        again = new.intersection(self.before[0])
        for known, before in zip((self.known_a, self.known_b), self.before):
            known.update((word, before[word]) for word in again)
        if len(new) > len(again):
            self.learn(list(new - again))
        if not self.inexact.isdisjoint(distinct):
            words = [[] if not self.inexact.isdisjoint(some) else some for some in words]
        return [b"".join(map(self.known_a.__getitem__, some)) for some in words], [b"".join(map(self.known_b.__getitem__, some)) for some in words]

    def align(self, texts: list[str | None]) -> Aligned:
        """Texts that are null, empty, or not exactly the bytes of their tokens have no tokens."""
        (a, from_a), (b, from_b) = map(joined, self.encode(texts))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        label = terminals(ends_a, ends_b)
        group = np.searchsorted(np.flatnonzero(label == np.arange(len(label))), label)
        return Aligned(a, b, ends_a, ends_b, from_a, from_b, group[:len(a)], group[len(a):])

    def written_groups(self, found: Aligned) -> list[bytes]:
        """Each text's groups, as ``a1,a2|b1;a3|b2,b3``."""
        many = np.bincount(found.group_a), np.bincount(found.group_b)
        at_a = np.arange(len(found.a)) + (np.cumsum(many[1]) - many[1])[found.group_a]
        at_b = np.arange(len(found.b)) + np.cumsum(many[0])[found.group_b]
        last_a, last_b = (np.append(x[1:] != x[:-1], True)[:len(x)] for x in (found.group_a, found.group_b))
        code = np.zeros(len(at_a) + len(at_b), np.int64)
        code[at_a] = found.a + last_a * len(self.bytes_a)
        code[at_b] = found.b + 2 * len(self.bytes_a) + last_b * len(self.bytes_b)
        rows, width = self.shown[code], self.shown.itemsize
        cuts = (found.from_a + found.from_b) * width
        data = rows.tobytes()
        return [data[cuts[i]:cuts[i + 1]].translate(None, b"\0")[:-1] for i in range(len(cuts) - 1)]

    def pairs(self, found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each text, how often they are linked, and where each text's pairs begin. A pair is a number,
        the id A above ``bits`` bits of the id B."""
        of_a, of_b = found.links()
        text = np.repeat(np.arange(len(found.from_a) - 1), np.diff(found.from_a))
        keys, times = np.unique(text[of_a] << self.text_bits | found.a[of_a] << self.bits | found.b[of_b], return_counts=True)
        begin = np.searchsorted(keys, np.arange(len(found.from_a)) << self.text_bits)
        return keys & ((1 << self.text_bits) - 1), times, begin


def joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), "<u4").astype(np.int64), np.cumsum([0, *map(len, ids)]) // 4


@lru_cache(maxsize=1)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One a worker process."""
    return Aligner(path_a, path_b)


def portions(batches: Iterator[pa.RecordBatch], together: int = TOGETHER) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Keys and texts, up to so many letters or 64 rows together."""
    for batch in rows_of(batches):
        texts, start, held = batch.column(1).to_pylist(), 0, 0
        for i, text in enumerate(texts):
            size = len(text or "")
            if i > start and held + size > together:
                yield batch.column(0).slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += size
        yield batch.column(0).slice(start), texts[start:]


def packed(slots: np.ndarray, times: np.ndarray) -> bytes:
    """Rising slots by their differences, and counts: mostly small numbers, compressed byte by byte."""
    numbers = np.concatenate([np.diff(slots, prepend=0), times]).astype("<u4")
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, many: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 8 * many, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    numbers = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(numbers[:many]), numbers[many:]


def groups(df: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``start``, ``stop``, ``a``, ``b``: every group of every text with its byte range (of a blank and the text) and ids.

    Texts without tokens have no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        make_room("alignment", aligner_of.cache_clear)
        for keys, texts in portions(batches):
            found = aligner.align(texts)
            begin = found.from_group()
            cut_a, cut_b = (np.searchsorted(x, np.arange(begin[-1] + 1)) for x in (found.group_a, found.group_b))
            text_of = np.repeat(np.arange(len(texts)), np.diff(begin))
            stops = found.ends_b[cut_b[1:] - 1]
            starts = np.append(0, stops)[:-1]
            offset = starts[begin[text_of]]
            yield pa.RecordBatch.from_arrays([
                keys.take(pa.array(text_of)), pa.array(starts - offset), pa.array(stops - offset),
                *(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids)) for cut, ids in ((cut_a, found.a), (cut_b, found.b)))],
                [key, "start", "stop", "a", "b"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, stop long, a array<long>, b array<long>")


def units(df: DataFrame, path_a: str, path_b: str, key: str, text: str, size: int = UNIT) -> DataFrame:
    """Rows of documents (``slot`` null) and, for each unit of documents, rows of its distinct pairs, numbered by ``slot``."""
    kind = df.schema[key].dataType.simpleString()
    names = ["unit", "slot", "pair", "times", "row_key", *COUNTS, "groups_sha256", "n_pairs", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        make_room("alignment", aligner_of.cache_clear)
        number, links = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []
        counted: list[np.ndarray] = []

        def unit() -> Iterator[pa.RecordBatch]:
            every, times = np.concatenate(held), np.concatenate(counted)
            pairs, slots = np.unique(every, return_inverse=True)
            many = np.array([row[-1] for row in rows])
            cuts = np.cumsum(many)[:-1]
            data = [packed(s, t) for s, t in zip(np.split(slots, cuts), np.split(times, cuts))]
            n = len(rows)
            null = pa.nulls(n, pa.int64())
            columns = [pa.array(x, pa.string() if isinstance(x[0], str) else pa.int64()) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), null.cast(pa.int32()), null, null, pa.concat_arrays(keys),
                                              *columns, pa.array(data, pa.binary())], names)
            m = len(pairs)
            totals = np.bincount(slots, weights=times, minlength=m).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(m, number)), pa.array(np.arange(m, dtype=np.int32)), pa.array(pairs), pa.array(totals), pa.nulls(m, keys[0].type),
                *(pa.nulls(m, pa.int64()) for _ in COUNTS), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names)

        for some, texts in portions(batches):
            found = aligner.align(texts)
            pairs, times, begin = aligner.pairs(found)
            keys.append(some)
            held.append(pairs)
            counted.append(times)
            n_a, n_b, n_groups = (np.diff(x) for x in (found.from_a, found.from_b, found.from_group()))
            # a group of x tokens A and y tokens B is a staircase of x + y - 1 overlaps
            for i, shown in enumerate(aligner.written_groups(found)):
                rows.append((n_a[i], n_b[i], n_groups[i], n_a[i] + n_b[i] - n_groups[i],
                             hashlib.sha256(shown).hexdigest() if shown else "", begin[i + 1] - begin[i]))
            links += int(times.sum())
            if links >= size:
                yield from unit()
                number, links, rows, keys, held, counted = number + 1, 0, [], [], [], []
        if rows:
            yield from unit()

    return df.select(key, text).mapInArrow(run, f"unit long, slot int, pair long, times long, row_key {kind}, " + ", ".join(
        f"{c} long" for c in COUNTS) + ", groups_sha256 string, n_pairs long, pairs binary")


def counted(made: DataFrame, bits: int) -> DataFrame:
    """``pair``, ``count``, ``best`` for every id pair of all documents; best: no id A is linked more often with that id B."""
    counts = written(made.where("slot is not null").groupBy("pair").agg(F.sum("times").alias("count")))
    of_b = F.col("pair").bitwiseAND((1 << bits) - 1)
    most = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("most"))  # at most a row for each id of the vocabulary
    return counts.withColumn("b", of_b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(df: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``a``, ``b``, ``count``, ``best``: how often each id of A lies over each id of B in all documents."""
    bits = aligner_of(path_a, path_b).bits
    return counted(written(units(df, path_a, path_b, key, text)), bits).select(
        F.shiftright("pair", bits).alias("a"), F.col("pair").bitwiseAND((1 << bits) - 1).alias("b"), "count", "best")


def alignments(df: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text", size: int = UNIT) -> DataFrame:
    """Both tokenizations of every text compared: sizes, links, how common the links' id pairs are, and the groups' digest.

    Columns: key, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256 string. Texts that are null, empty
    or not exactly the bytes of their tokens have zeros and an empty digest. Null keys and repeated rows are rows of their
    own; other columns are not read. An empty table gives no rows. A task holds a few MB of text, or one longer text;
    ``size`` is the number of links that are counted together.
    """
    kind = df.schema[key].dataType.simpleString()
    made = written(units(df, path_a, path_b, key, text, size))
    entries = made.where("slot is not null").select("unit", "slot", "pair")
    known = entries.join(counted(made, aligner_of(path_a, path_b).bits), "pair").select(F.col("unit").alias("of"), "slot", "count", "best")
    documents = made.where("slot is null").drop("slot", "pair", "times")

    def run(rows: pa.Table, entries: pa.Table) -> pa.Table:
        slots = entries.column("slot").to_numpy()
        count, best = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        count[slots], best[slots] = entries.column("count").to_numpy(), entries.column("best").to_numpy()
        sums = []
        for many, data in zip(rows.column("n_pairs").to_pylist(), rows.column("pairs").to_pylist()):
            at, times = unpacked(data, many) if many else (slots[:0], count[:0])
            sums.append((int(times @ best[at]), int(times @ count[at])))
        n_best, count_sum = zip(*sums) if sums else ((), ())
        return pa.table([rows.column("row_key"), *(rows.column(c) for c in COUNTS), pa.array(n_best, pa.int64()),
                         pa.array(count_sum, pa.int64()), rows.column("groups_sha256")], [key, *COUNTS, "n_best", "count_sum", "groups_sha256"])

    return documents.groupBy("unit").cogroup(known.groupBy("of")).applyInArrow(
        run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_best", "count_sum")) + ", groups_sha256 string")
