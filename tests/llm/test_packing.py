import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from labelscape.llm import packing  # noqa: E402
from tests.llm.awkward import TEXTS, documents  # noqa: E402

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_every_piece_is_packed_once(counts):
    packs = packing.shortest_pack_first(counts, 64)
    used = Counter()
    for many, lengths in packs:
        assert many > 0 and sum(lengths) <= 64
        for length in lengths:
            used[length] += many
    assert used == Counter(counts)


def test_little_padding():
    counts = Counter(np.random.default_rng(0).integers(1, 2049, 20_000).tolist())
    packs = packing.shortest_pack_first(counts, 2048)
    assert sum(k * v for k, v in counts.items()) > 0.98 * 2048 * sum(many for many, _ in packs)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBcÉ é's.,!_- \n\tΣİß3½́ \x1c中", max_size=40))
def test_word_by_word_equals_the_whole(library, text):
    want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.encoder_of(PATH).ids(text) == want


def check(rows, texts, library, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= size
    want = Counter()
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), size):
            piece = np.array(ids[start:start + size], "<u4")
            want[i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want


@pytest.mark.parametrize("size", [16, 2048])
def test_awkward_table(spark, library, size):
    check(packing.pack(documents(spark), PATH, size=size).collect(), TEXTS, library, size)


def test_one_length_holds_nearly_all(spark, library):
    texts = [(i, "same words here") for i in range(500)] + [(1000, "other words are here too")]
    check(packing.pack(documents(spark, texts).repartition(5), PATH, size=32).collect(), texts, library, 32)


def test_no_rows(spark):
    assert packing.pack(documents(spark, []), PATH).count() == 0
