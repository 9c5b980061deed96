import base64
import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from labelscape.llm import bpe  # noqa: E402
from tests.llm.awkward import TEXTS, documents  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary_of(PATH)


def test_random_bytes_encode_as_by_merging(vocabulary):
    rng = random.Random(1)
    for _ in range(400):
        data = "".join(rng.choice("aabethin  s\n.,01é中😀") for _ in range(rng.randint(1, 40))).encode()
        assert [vocabulary.tokens[i] for i in bpe.PrefixEncoder(vocabulary, data).ids()] == vocabulary.merge(data)


def test_appends_are_exact(vocabulary):
    whole = b"the encoding of every prefix is known"
    step = bpe.PrefixEncoder(vocabulary)
    for i in range(len(whole)):
        step.append(whole[i:i + 1])
        assert step.ids() == bpe.PrefixEncoder(vocabulary, whole[:i + 1]).ids()


def test_edits_are_exact_and_local(vocabulary):
    rng = random.Random(2)
    text = bytearray(" ".join(rng.choice(["token", "prefix", "edit", "near", "of"]) for _ in range(300)).encode())
    encoder = bpe.PrefixEncoder(vocabulary, bytes(text))
    for _ in range(20):
        start = rng.randint(0, len(text))
        end = min(len(text), start + rng.randint(0, 6))
        by = bytes(rng.choice(b"abc de") for _ in range(rng.randint(0, 6)))
        text[start:end] = by
        done = encoder.replace(start, end, by)
        assert encoder.data == bytes(text) and encoder.ids() == bpe.PrefixEncoder(vocabulary, bytes(text)).ids()
        assert done <= len(by) + 3 * vocabulary.longest


def test_awkward_table(spark, library):
    df = documents(spark)
    got = bpe.encode(df, PATH, P.PATTERN, digests=True).collect()
    want = []
    for i, text in TEXTS:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_decode_gives_the_bytes_back(spark):
    ids = bpe.encode(documents(spark), PATH, P.PATTERN)
    back = bpe.decode(ids, PATH).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t in TEXTS)


def test_no_rows(spark):
    assert bpe.encode(documents(spark, []), PATH, P.PATTERN, digests=True).count() == 0
