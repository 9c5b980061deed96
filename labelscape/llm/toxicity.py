"""Toxicity by a subsequence string kernel with Nyström landmarks (operator 2).

Two words are alike by the subsequences of letters they share, contiguous or not; every skipped letter costs a factor. A word
with letters put in between, left out or doubled thus stays near the plain one. The kernel of a word with a few landmark
words gives its Nyström features, on which a linear support vector machine is trained.

The machine learns from single words that carry their document's label; it takes the place of one trained on labelled sentences. A toxic
document need not be toxic in every word, so training alternates between finding each toxic document's most telling words and
separating those from the words of clean documents. A document scores as its worst word; a logistic curve turns that into a probability.
No phrase scores above its worst word, so texts toxic only by a combination of ordinary words are not told.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscape.llm.common import make_room, rows_of

#: single letters held apart by blanks or marks, as in "i d i o t" or "i.d.i.o.t"
SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[\s\W_]{1,3}[^\W\d_](?![^\W\d_])){2,}")
SIGNS = str.maketrans(dict.fromkeys("*-_.,;:!?'\"()[]{}<>/\\|~^+=#%&`", "") | {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
#: Longer words are seen through overlapping windows of this many letters.
LONGEST = 20
CACHE = 300_000


@dataclass(frozen=True)
class Settings:
    """``order`` letters a subsequence at most, ``decay`` for every letter it spans, ``landmarks`` of both kinds, and at most
    ``sample`` labelled documents to learn from (those with the smallest hashes)."""

    order: int = 4
    decay: float = 0.6
    landmarks: int = 96
    sample: int = 5_000
    rounds: int = 2
    telling: float = 3.0
    cost: float = 10.0


def words_of(text: str) -> set[str]:
    """Lower-case words without marks, with look-alike digits as letters; letters held apart count as a word too."""
    text = text.lower()
    found = set(text.split())
    out = {word if word.isalpha() else word.translate(SIGNS) for word in found}
    out.update("".join(c for c in match if c.isalpha()) for match in SPACED.findall(text))
    out.discard("")
    return out


def windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


class Subsequences:
    """The kernel's feature space: every subsequence of up to ``order`` letters of an alphabet, other letters left out.

    K(s, t) is the sum, over subsequences that s and t share, of decay to the power of the letters spanned in s and in t. Words
    are short, so their subsequences are listed rather than summed by recursion: all words of one
    length use the same list of positions.
    """

    def __init__(self, order: int, decay: float, alphabet: str):
        self.order, self.decay = order, decay
        self.letters = np.array(sorted(set(map(ord, alphabet))), np.uint32)
        self.base = len(self.letters) + 1  # 0 is any other letter; no feature of the landmarks has one
        self.offsets = np.cumsum([0] + [self.base ** r for r in range(1, order + 1)])
        self.size = int(self.offsets[-1])
        self._places: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def places(self, length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 1 to ``order`` letters: which shorter subsequence is continued, by which position, and decay to the power of the span."""
        if length not in self._places:
            rows, before = [], {(): 0}
            for r in range(1, self.order + 1):
                some = list(combinations(range(length), r))
                rows.append((np.array([before[p[:-1]] for p in some], np.intp), np.array([p[-1] for p in some], np.intp),
                             np.array([self.decay ** (p[-1] - p[0] + 1) for p in some], np.float32)))
                before = {p: i for i, p in enumerate(some)}
            self._places[length] = rows
        return self._places[length]

    def grid(self, words: list[str], length: int) -> np.ndarray:
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, 0).astype(np.int32).reshape(len(words), length)

    def listed(self, words: list[str], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Feature numbers (a row for each word) and weights."""
        grid = self.grid(words, length)
        number = np.zeros((len(words), 1), np.int32)
        for r, (before, last, weight) in enumerate(self.places(length)):
            if not len(last):
                return
            number = number.take(before, axis=1)
            number *= np.int32(self.base)
            number += grid.take(last, axis=1)
            yield number + np.int32(self.offsets[r]), weight

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each feature stands, and a column of values for each word; only features of these words have a row, the first is empty."""
        rows = []
        for j, word in enumerate(words):
            for numbers, weight in self.listed([word], len(word)):
                rows.append((numbers[0], np.full(len(weight), j), weight))  # every letter is in the alphabet here
        numbers, column, weight = (np.concatenate(c) for c in zip(*rows))
        used, row = np.unique(numbers, return_inverse=True)
        index = np.zeros(self.size, np.int32)
        index[used] = np.arange(1, len(used) + 1)
        values = np.zeros((len(used) + 1, len(words)), np.float32)
        np.add.at(values, (row + 1, column), weight)
        return index, values

    def products(self, words: list[str], index: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Inner products of the words' features with each column of ``values``."""
        out = np.zeros((len(words), values.shape[1]), np.float32)
        for length, at in grouped(words):
            step = max(1, (1 << 19 if values.shape[1] == 1 else 1 << 21) // (values.shape[1] * len(self.places(length)[-1][0]) + 1))
            for start in range(0, len(at), step):
                mine = at[start:start + step]
                for numbers, weight in self.listed([words[i] for i in mine], length):
                    rows = index.take(numbers)
                    if values.shape[1] == 1:
                        out[mine, 0] += values[:, 0].take(rows) @ weight
                    else:
                        out[mine] += np.einsum("wcm,c->wm", values[rows], weight)
        return out


def grouped(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    yield from by_length.items()


def self_kernel(words: list[str], order: int, decay: float) -> np.ndarray:
    """K(s, s) for each word, over all letters, by recursion on prefixes."""
    out = np.zeros(len(words), np.float32)
    for length, places in grouped(words):
        power = np.arange(length)
        gaps = np.where(power[None, :] >= power[:, None], float(decay) ** np.abs(power[None, :] - power[:, None]), 0).astype(np.float32)
        for start in range(0, len(places), 4096):
            mine = places[start:start + 4096]
            points = np.frombuffer("".join(words[i] for i in mine).encode("utf-32-le", "surrogatepass"), "<u4")
            grid = points.reshape(len(mine), length)
            match = (grid[:, :, None] == grid[:, None, :]).astype(np.float32) * np.float32(decay * decay)
            ends = match
            total = ends.sum(axis=(1, 2))
            for _ in range(1, order):
                half = (ends.reshape(-1, length) @ gaps).reshape(ends.shape)
                summed = (half.transpose(0, 2, 1).reshape(-1, length) @ gaps).reshape(ends.shape)  # its own transpose: the kernel is symmetric
                ends = np.zeros_like(match)
                ends[:, 1:, 1:] = match[:, 1:, 1:] * summed[:, :-1, :-1]
                total += ends.sum(axis=(1, 2))
            out[mine] = total
    return out


@dataclass
class Model:
    """Landmarks, the machine, and the curve from margins to probabilities.

    The machine is linear in the kernels with the landmarks, and those are linear in the landmarks' subsequences: ``folded``
    holds the weights summed up by subsequence, which gives the same margins with one look-up instead of one for each landmark.
    """

    settings: Settings
    landmarks: list[str]
    weights: np.ndarray  # of the normalised kernels, the Nyström map folded in
    bias: float
    slope: float = 4.0
    middle: float = 0.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        s = self.settings
        self.space = Subsequences(s.order, s.decay, "".join(self.landmarks))
        self.own = np.sqrt(self_kernel(self.landmarks, s.order, s.decay))
        self.fold()

    def fold(self) -> None:
        self.index, values = self.space.table(self.landmarks)
        self.values = values / self.own
        self.folded = (self.values @ self.weights.astype(np.float32))[:, None].astype(np.float32)

    def __getstate__(self) -> tuple:
        """What others need to build it again: the words seen stay here."""
        return self.settings, self.landmarks, self.weights, self.bias, self.slope, self.middle

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def features(self, words: list[str]) -> np.ndarray:
        s = self.settings
        return self.space.products(words, self.index, self.values) / np.sqrt(self_kernel(words, s.order, s.decay))[:, None]

    def margins(self, words: list[str]) -> np.ndarray:
        s = self.settings
        return self.space.products(words, self.index, self.folded)[:, 0] / np.sqrt(self_kernel(words, s.order, s.decay)) + self.bias

    def worst(self, docs: list[set[str]]) -> list[float]:
        """The largest margin of each document's words (-1 without words); words seen lately are not computed again."""
        known = self.known
        words = set().union(*docs)
        new = list(words.difference(known))
        if new:
            if len(known) + len(new) > CACHE:
                # make room; short words are the ones that come again
                kept = {word: value for word, value in known.items() if len(word) <= 7}
                known.clear()
                known.update(kept if len(kept) < CACHE // 2 else {})
                new = list(words.difference(known))
            parts = [windows(word) for word in new]
            values = self.margins([part for some in parts for part in some]).tolist()
            at = 0
            for word, some in zip(new, parts):
                known[word] = max(values[at:at + len(some)])
                at += len(some)
        return [max(map(known.__getitem__, doc), default=-1.0) for doc in docs]

    def scores(self, texts: list[str]) -> list[float]:
        """A document is as toxic as its worst word; a text without words has the margin of a clean one."""
        margins = np.array(self.worst([words_of(text) for text in texts]))
        return (1 / (1 + np.exp(-np.clip(self.slope * (margins - self.middle), -60, 60)))).tolist()


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, passes: int = 300) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6

    def loss(v):
        slack = np.maximum(0, 1 - y * (x @ v))
        return 0.5 * v @ ridge @ v + cost * (weight * slack * slack).sum()

    now = loss(w)
    for _ in range(passes):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = ridge @ w - 2 * cost * (x[on].T @ (weight[on] * y[on] * slack[on]))
        step = np.linalg.solve(ridge + 2 * cost * (x[on].T * weight[on]) @ x[on], grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-7 * before:
            break
    return w[:-1], float(w[-1])


def train(labelled: Iterable[tuple[str, int]], settings: Settings = Settings()) -> Model:
    """Learn from texts with labels 0 and 1. Without both labels, every text is scored as clean as its margin is low."""
    return learn(((words_of(text), label) for text, label in labelled), settings)


def learn(labelled: Iterable[tuple[Iterable[str], int]], settings: Settings = Settings()) -> Model:
    """Learn from the distinct words of texts with labels 0 and 1."""
    place: dict[str, int] = {}
    docs: list[list[np.ndarray]] = [[], []]
    for own, label in labelled:
        words = set(own)
        if words:
            docs[int(label)].append(np.fromiter((place.setdefault(w, len(place)) for w in sorted(words)), np.int32, len(words)))
    clean, toxic = docs
    if not toxic or not clean:
        return Model(settings, ["a"], np.zeros(1), -1.0)
    vocabulary = list(place)
    dirty, plain = (np.bincount(np.concatenate(some), minlength=len(vocabulary)) for some in (toxic, clean))
    # how far a word's share of toxic documents lies above that expected from its share of clean ones
    expected = plain * (len(toxic) / len(clean))
    telling = (dirty - expected) / np.sqrt(dirty + expected + 2.0)
    order = sorted(np.flatnonzero(telling > 0).tolist(), key=lambda i: (-telling[i], vocabulary[i]))
    often = sorted(np.flatnonzero(plain > 0).tolist(), key=lambda i: (-plain[i], vocabulary[i]))
    # surely telling: so unlikely by chance that not even the largest of as many random words would get there
    share, both = len(toxic) / (len(toxic) + len(clean)), dirty + plain
    evidence = dirty * np.log(np.maximum(dirty, 1) / (both * share)) + plain * np.log(np.maximum(plain, 1) / (both * (1 - share)))
    enough = np.log(len(vocabulary)) + settings.telling
    sure = [i for i in order if evidence[i] >= enough and len(vocabulary[i]) > 2 and expected[i] < 0.1 * dirty[i]]
    half = settings.landmarks // 2
    bad = [vocabulary[i][:LONGEST] for i in order[:4 * half] if expected[i] < 0.2 * dirty[i] and len(vocabulary[i]) > 2]
    good = [vocabulary[i][:LONGEST] for i in often[:8 * half] if len(vocabulary[i]) > 2]
    landmarks = spread_out(bad, half, settings) + spread_out(good, half, settings)
    if not landmarks:
        return Model(settings, ["a"], np.zeros(1), -1.0)
    model = Model(settings, landmarks, np.zeros(len(landmarks)), -1.0)
    gram = model.features(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T  # Nyström: kernels x inverse root of the landmarks' kernel

    def mapped(words: list[str]) -> np.ndarray:
        return model.features([w[:LONGEST] for w in words]) @ root.astype(np.float32)

    rng = np.random.default_rng(3)
    every = mapped(vocabulary)
    bent = [v for i in sure if len(vocabulary[i]) > 3 for v in disguised(vocabulary[i], rng)
            if v not in place or plain[place[v]] == 0]
    altered = mapped(bent) if bent else np.zeros((0, len(landmarks)), np.float32)
    told = np.zeros(len(vocabulary), bool)
    told[sure] = True
    often = np.array(often)
    held = np.unique(np.concatenate([often[:3000], often[rng.integers(0, len(often), 3000)]]))
    hard = np.zeros(0, np.int64)
    rank, w, b = telling, None, None
    for _ in range(settings.rounds):
        # a toxic document's witnesses: its surely telling words; where no word is sure, the word that ranks highest. A document
        # without any is left out, since its label may be wrong and its words would be taught as toxic
        chosen: Counter = Counter()
        for d in toxic:
            own = d[told[d]]
            chosen.update(own.tolist() if sure else [int(d[np.argmax(rank[d])])])
        at = np.array(sorted(chosen))
        share = np.sqrt(np.array([chosen[i] for i in at], np.float64))
        for _ in range(6):
            x = np.vstack([every[at], altered, every[held]])
            y = np.concatenate([np.ones(len(at) + len(altered)), -np.ones(len(held))])
            # a clean word weighs by how often it would be a false alarm, and at least 1 once it has been one
            alarm = np.maximum(0.04 * np.sqrt(plain[held]), np.isin(held, hard))
            weight = np.concatenate([10 + 500 * share / share.sum(), np.full(len(altered), 1.0), alarm])
            w, b = machine(x, y, weight, settings.cost)
            rank = every @ w.astype(np.float32) + b
            wrong = often[rank[often] > -0.3]  # clean words on or over the edge join, worst first
            more = np.setdiff1d(wrong[np.argsort(-rank[wrong], kind="stable")][:600], held)
            if not len(more):
                break
            held, hard = np.concatenate([held, more]), np.union1d(hard, more)
    model.weights, model.bias = root @ w, b
    model.fold()
    margins = np.array([rank[d].max() for d in (*toxic, *clean)], np.float64)
    marks = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    seen = (marks == 0) | (margins > 0)
    if (marks[seen] == 1).any():
        model.slope, model.middle = curve(margins[seen], marks[seen])
    return model


def disguised(word: str, rng: np.random.Generator, many: int = 6) -> list[str]:
    """The word with a letter put in or doubled."""
    out = []
    for _ in range(many):
        i = int(rng.integers(1, len(word)))
        out.append(word[:i] + (word[i - 1] if rng.random() < 0.3 else chr(97 + int(rng.integers(26)))) + word[i:])
    return out


def spread_out(words: list[str], many: int, settings: Settings) -> list[str]:
    """The first of at most 200 words that are not nearly the same as one taken before."""
    words = list(dict.fromkeys(words))[:200]
    if not words:
        return []
    near = Model(settings, words, np.zeros(len(words)), 0.0).features(words)
    taken: list[int] = []
    for i in range(len(words)):
        if len(taken) < many and (not taken or near[i, taken].max() < 0.8):
            taken.append(i)
    return [words[i] for i in taken]


def curve(margins: np.ndarray, marks: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the logistic curve with the least log loss, by Newton steps."""
    a, c = 4.0, 0.0
    target = np.where(marks == 1, (marks.sum() + 1) / (marks.sum() + 2), 1 / (len(marks) - marks.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins - c, -40, 40)))
        g = np.array([((p - target) * margins).sum(), -(p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins * margins).sum(), -(v * margins).sum()], [-(v * margins).sum(), v.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
        a = max(a, 0.1)
    return float(a), float(c / a)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, key: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    """Train on at most ``settings.sample`` labelled rows, those with the smallest hash of the key; other rows of a key with several
    labels count as often as they occur, rows with null text, key or label not at all."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).where("k is not null and label in (0, 1)")
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).where("text is not null").join(
        marked.orderBy(F.xxhash64("k"), "k", "label").limit(settings.sample), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            words = [" ".join(sorted(words_of(v.as_py()))) for v in batch.column(1)]  # words hold no blanks
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string()), batch.column(2)], ["k", "words", "label"])

    kind = found.schema["k"].dataType.simpleString()
    rows = found.select("k", "text", "label").mapInArrow(run, f"k {kind}, words string, label int").orderBy(
        F.xxhash64("k"), "k", "words").limit(settings.sample).select("words", "label").collect()  # bounded by ``sample``
    return learn(((row["words"].split(), row["label"]) for row in rows), settings)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and ``name`` (0 to 1); a null text is empty. ``key`` is not read. An empty table gives no rows.

    For a table that may have a column of that name choose another one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and weights only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine_ = here(shared)
        for batch in rows_of(batches):
            values = machine_.scores([v.as_py() or "" for v in batch.column(batch.schema.get_field_index(text))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


_models: dict[int, Model] = {}


def here(shared) -> Model:
    """The broadcast model; a worker that serves several tasks goes on with the words it has scored."""
    model = shared.value
    name = (tuple(model.landmarks), model.bias, model.slope)
    if name not in _models:
        _models.clear()  # one model at a time, with the words it has scored
        _models[name] = model
    model = _models[name]
    make_room("toxicity", _models.clear)
    return model
