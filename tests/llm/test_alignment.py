import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelscape.llm import alignment
from tests.llm.awkward import TEXTS, documents

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = ["Ünï cödé 中文 😀 don't  stop", "tabs\tand\nlines", " <|endoftext|> <s> </s> <unk> ", "ﬁ ligature Å", "aaaaaaaaaaaaaaa" * 40, "x", " ", "　wide", "a▁b", "nul\0 in it"]


@lru_cache
def aligner_here():
    return alignment.Aligner(*PATHS)


@pytest.fixture(scope="module")
def aligner():
    return aligner_here()


def tokens(aligner, text):
    """Ids and byte ranges of both, by the libraries alone."""
    if not text:
        return None
    data, out = (" " + text).encode(), []
    for ids, table in ((aligner.first.encode(" " + text, add_special_tokens=False).ids, aligner.bytes_a), (aligner.second.encode(text), aligner.bytes_b)):
        ranges, at = [], 0
        for i in ids:
            ranges.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != data:
            return None
        out.append(ranges)
    return out


def slow(aligner, texts):
    """Every overlap tried, groups cut where both end, counts over all texts."""
    rows, links = [], []
    for text in texts:
        found = tokens(aligner, text)
        a, b = found or ([], [])
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        shown = ";".join(",".join(str(i) for i, s, e in a if lo <= s < hi) + "|" + ",".join(str(i) for i, s, e in b if lo <= s < hi)
                         for lo, hi in zip([0, *cuts], cuts))
        links.append([(i, j) for i, s, e in a for j, x, y in b if s < y and x < e])
        rows.append((len(a), len(b), len(cuts), len(links[-1]), shown))
    count = Counter(pair for one in links for pair in one)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(n, most.get(j, 0))
    return [(*row[:4], sum(count[p] == most[p[1]] for p in one), sum(count[p] for p in one),
             hashlib.sha256(row[4].encode()).hexdigest() if row[4] else "") for row, one in zip(rows, links)], count, most


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.randoms())
def test_terminals_are_the_ends_of_groups(lengths, random):
    ends_a = np.cumsum(lengths)
    total = sum(lengths)
    ends_b = np.array(sorted({*random.sample(range(1, total + 1), random.randint(1, total)), total}))
    label = alignment.terminals(ends_a, ends_b)
    common = np.intersect1d(ends_a, ends_b)
    for i, last in enumerate([*ends_a, *ends_b]):
        assert label[i] == len(ends_a) + np.flatnonzero(ends_b == common[np.searchsorted(common, last)])[0]


def test_packed_slots_come_back():
    slots, times = np.array([0, 5, 70000, 70001]), np.array([1, 300, 2, 9])
    back = alignment.unpacked(alignment.packed(slots, times), 4)
    assert (back[0] == slots).all() and (back[1] == times).all()


def test_portions_keep_the_order():
    texts = ["a" * n for n in (1, 50, 61, 5, 200, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["k", "t"])
    parts = list(alignment.portions([batch], 60))
    assert [k.to_pylist() for k, _ in parts] == [[0, 1], [2], [3], [4], [5]] and sum((t for _, t in parts), []) == texts


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Zé'1.\t\n  \x85\x1c\u180e\u200b\u3000中▁😀-_<|>s"), max_size=40))
def test_words_encode_as_the_whole_text(text):
    one = aligner_here()
    found = tokens(one, text)
    want = [[i for i, _, _ in side] for side in found] if found else [[], []]
    assert [np.frombuffer(x, "<u4").tolist() for x, in one.encode([text])] == want


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_alignments_equal_brute_force(spark, aligner, size):
    texts = [t if t is None or len(t) < 400 else t[:400] for _, t in TEXTS] + MORE
    docs = documents(spark, list(enumerate(texts)))
    want, count, most = slow(aligner, texts)
    got = {r[0]: tuple(r)[1:] for r in alignment.alignments(docs, *PATHS, size=size).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert any(w[0] for w in want) and any(t and not w[0] for t, w in zip(texts, want))
    pairs = {(r["a"], r["b"]): (r["count"], r["best"]) for r in alignment.pair_counts(docs, *PATHS).collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in count.items()}


def test_groups_are_the_text(spark, aligner):
    texts = [*MORE, TEXTS[0][1]]
    rows = {}
    for r in alignment.groups(documents(spark, list(enumerate(texts))), *PATHS).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        data, at = (" " + text).encode(), 0
        for r in sorted(rows.get(i, []), key=lambda r: r["start"]):
            assert r["start"] == at and data[at:r["stop"]] == b"".join(aligner.bytes_a[x] for x in r["a"]) == b"".join(aligner.bytes_b[x] for x in r["b"])
            at = r["stop"]
        assert at == (len(data) if tokens(aligner, text) else 0)


def test_awkward_rows_and_no_rows(spark):
    rows = alignment.alignments(documents(spark), *PATHS).collect()
    assert len(rows) == len(TEXTS) and sum(r["doc_id"] is None for r in rows) == 2
    assert {r["n_a"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert len({tuple(r)[1:] for r in rows if r["doc_id"] in (1, 5)}) == 1
    assert alignment.alignments(documents(spark, []), *PATHS).count() == 0
