"""Byte-level BPE by prefix dynamic programming (operator 10).

For every prefix of a byte string there is exactly one token that can end its encoding. Storing that token for each
prefix makes appending exact without looking back further than the longest token, and lets an edit be
re-encoded only as far as stored tokens change.

Two neighbouring tokens can stand side by side exactly if merging their bytes never joins a fragment on the
left token's right edge with one on the right token's left edge before both have grown into larger fragments.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from labelscape.llm.common import make_room, rows_of

NEVER = 1 << 40
#: Entries of a worker's caches; beyond, they start anew.
CACHE = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens: base64 bytes and rank on each line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(word): int(rank) for word, rank in lines}


class Vocabulary:
    """Tokens by rank, and which of them may follow one another."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.tokens[rank] = word
        self.names = [str(rank) for rank in range(len(self.tokens))]
        by_end: dict[int, set[int]] = {}
        for word in ranks:
            by_end.setdefault(word[-1], set()).add(len(word))
        #: lengths of the tokens ending in a byte, longest first
        self.lengths = {end: sorted(lengths, reverse=True) for end, lengths in by_end.items()}
        self._edges: dict[int, tuple[list, list] | None] = {}
        #: answers of ``follows`` by both tokens in one number
        self.follow_keys: dict[int, bool] = {}

    def merge(self, word: bytes, whole: bool = True) -> list[bytes]:
        """Plain merging, lowest rank first; ``whole=False`` stops short of the single token ``word``."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], NEVER)
                if rank < best and (whole or len(parts) > 2):
                    best, at = rank, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: int) -> tuple[list, list] | None:
        """Fragments on the left and right edge of a token, each with the rank at which it disappears;
        None if its own bytes do not encode to it."""
        if token not in self._edges:
            word = self.tokens[token]
            if self.merge(word) != [word]:
                self._edges[token] = None
            else:
                self._edges[token] = tuple(self._edge(word, side) for side in (0, -1))
        return self._edges[token]

    def _edge(self, word: bytes, side: int) -> list[tuple[bytes, int, int]]:
        found, gone = [], NEVER
        while True:
            rank = self.ranks[word]
            found.append((word, rank if len(word) > 1 else -1, gone))
            if len(word) == 1:
                return found
            word, gone = self.merge(word, whole=False)[side], rank

    def follows(self, first: int, second: int) -> bool:
        """Whether the bytes of both tokens encode to just these two."""
        key = first << 32 | second
        known = self.follow_keys.get(key)
        if known is None:
            if len(self.follow_keys) > CACHE:
                self.follow_keys.clear()
            known = self.follow_keys[key] = self._may_follow(first, second)
        return known

    def _may_follow(self, first: int, second: int) -> bool:
        before, after = self.edges(first), self.edges(second)
        if before is None or after is None:
            return False
        for left, born_left, gone_left in before[1]:
            for right, born_right, gone_right in after[0]:
                rank = self.ranks.get(left + right)
                if rank is None:
                    continue
                when = max(rank, born_left, born_right)
                # at equal rank the merge further to the left comes first
                if when < gone_left and when <= gone_right:
                    return False
        return True

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixEncoder:
    """Encoding of one growing or edited byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _extend(self, stop: int) -> None:
        """Find the last token of each further prefix, up to ``stop`` bytes: the longest suffix token that may follow."""
        vocabulary, data, last = self.vocabulary, self.data, self.last
        rank, known, lengths = vocabulary.ranks.get, vocabulary.follow_keys, vocabulary.lengths
        for end in range(len(last) + 1, stop + 1):
            for length in lengths[data[end - 1]]:
                start = end - length
                if start < 0:
                    continue
                token = rank(data[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start - 1]
                    fits = known.get(before << 32 | token)
                    if fits is None:
                        fits = vocabulary.follows(before, token)
                else:
                    fits = vocabulary.edges(token) is not None
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of the data")

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Put ``by`` in the place of bytes ``start`` to ``end``; returns how many prefixes were computed anew.

        A prefix's token depends only on the bytes and tokens up to the longest token's length before it, so that
        many unchanged tokens in a row past the edit prove that all later ones are unchanged.
        """
        old, shift = self.last, len(by) - (end - start)
        self.data = self.data[:start] + by + self.data[end:]
        self.last, same, done = old[:start], 0, 0
        for place in range(start + 1, len(self.data) + 1):
            self._extend(place)
            token = self.last[-1]
            done += 1
            beyond = place - (start + len(by))
            if beyond > 0:
                same = same + 1 if token == old[place - shift - 1] else 0
                if same >= self.vocabulary.longest and beyond >= self.vocabulary.longest:
                    self.last.extend(old[place - shift:])
                    break
        return done

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            found.append(token)
            end -= len(self.vocabulary.tokens[token])
        return found[::-1]


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


class Encoder:
    """Encodes texts match by match; keeps the matches seen lately."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern, self.known = vocabulary_of(path), regex.compile(pattern), {}

    def ids(self, text: str) -> list[int]:
        pieces = self.pattern.findall(text)
        known = self.known
        new = set(pieces).difference(known)
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set(pieces)
            for piece in new:
                data = piece.encode("utf-8", "surrogatepass")
                whole = self.vocabulary.ranks.get(data)
                known[piece] = (whole,) if whole is not None else tuple(PrefixEncoder(self.vocabulary, data).ids())
        return list(chain.from_iterable(map(known.__getitem__, pieces)))


@lru_cache(maxsize=4)
def encoder_of(path: str, pattern: str) -> Encoder:
    """One per worker process, so that what it has seen serves later tasks too."""
    return Encoder(path, pattern)


def forget() -> None:
    encoder_of.cache_clear()
    vocabulary_of.cache_clear()


def encode(df: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text",
           digests: bool = False) -> DataFrame:
    """``key``, ``ids`` array<int> (null text: none) and ``decoded`` binary, row for row.

    ``digests=True`` gives n_tokens, ids_sha256 and decoded_sha256 in their place, so that
    the ids need not leave the worker. Repeated rows stay; other columns are not read; a null key stays null.
    """
    kind = df.schema[key].dataType.simpleString()
    columns = ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests
               else "ids array<int>, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        vocabulary = encoder.vocabulary
        make_room("bpe", forget)
        for batch in rows_of(batches):
            lists, decoded = [], []
            for value in batch.column(1):
                ids = encoder.ids(value.as_py() or "")
                data = vocabulary.decode(ids)
                if digests:
                    shown = " ".join(map(vocabulary.names.__getitem__, ids))
                    lists.append((len(ids), hashlib.sha256(shown.encode()).hexdigest()))
                    decoded.append(hashlib.sha256(data).hexdigest())
                else:
                    lists.append(ids)
                    decoded.append(data)
            if digests:
                arrays = [pa.array([n for n, _ in lists], pa.int64()), pa.array([h for _, h in lists], pa.string()),
                          pa.array(decoded, pa.string())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                arrays = [pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                names = [key, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {columns}")


def decode(df: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the ``decoded`` bytes of each row's ids (null: none)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for batch in rows_of(batches):
            decoded = [vocabulary.decode(value.as_py() or ()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], [key, "decoded"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, decoded binary")
