import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from labelscape.llm import simhash
from tests.llm.awkward import TEXTS, documents


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    width = min(4, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i:i + width]).encode(), seed=42).intdigest() for i in range(len(words) - width + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Smallest key reachable, every pair compared."""
    keys, label = list(prints), {k: k for k in prints}
    for _ in keys:
        for a in keys:
            for b in keys:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[b] = min(label[a], label[b])
    return label


def clustered(n, seed=3):
    """Numbers with near neighbours, chains and correlated bits."""
    rng, out = random.Random(seed), []
    base = [rng.getrandbits(64) for _ in range(6)]
    while len(out) < n:
        value = rng.choice([*base, *out[-3:]]) if rng.random() < 0.7 else rng.getrandbits(32) * 0x100000001
        for _ in range(rng.randint(0, 6)):
            value ^= 1 << rng.randrange(64)
        out.append(value)
    return sorted(set(out))


def signed(values):
    return np.array(values, np.uint64).view(np.int64).tolist()


def test_fingerprint_equals_counting():
    texts = [t for _, t in TEXTS if t is None or len(t) < 1000] + ["A b C d e", "a B c D e", "x " * 70, "one two three four " * 30, "ÀÉ \x85   weiß"]
    for text in texts:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0


def test_hash_is_that_of_the_sql_function(spark):
    text = "four words make one"
    assert simhash.fingerprint(text) == spark.range(1).select(F.xxhash64(F.lit(text))).head()[0] % 2**64


def test_near_counts_equal_trying_all():
    rng = np.random.default_rng(1)
    histogram = rng.integers(0, 9, 64)
    got = simhash.near_counts(histogram, 4)
    for v in range(64):
        for e in range(5):
            assert got[e, v] == sum(histogram[w] for w in range(64) if (v ^ w).bit_count() == e)


@pytest.mark.parametrize("choice", [(5,), (4,), (3,), (2,)])
def test_thresholds_are_cheapest_and_meet_every_neighbour(spark, choice):
    values = clustered(150)
    prints = spark.createDataFrame([(v,) for v in signed(values)], "print long")
    plan, = simhash.plans(prints, 4, choice)
    plan.total = 10**8  # candidates count as if there were so many like these
    bits = simhash.bits_of(np.array(values, np.uint64))
    pieces = plan.parts.values(bits)
    costs, (limits, cost) = plan.costs(pieces), plan.thresholds(pieces)
    assert ((limits + 1).sum(axis=0) == 5).all() and sorted(plan.parts.order) == list(range(64))

    def deals(parts, left):
        if parts == 1:
            yield (left,)
        else:
            for s in range(left + 1):
                for rest in deals(parts - 1, left - s):
                    yield (s, *rest)

    for j in range(0, len(values), 17):
        assert np.isclose(cost[j], min(sum(costs[i, s, j] for i, s in enumerate(deal)) for deal in deals(choice[0], 5)))
    assert len({tuple(x) for x in limits.T}) > 1
    held = plan.parts.part_values(pieces)
    for i in range(len(values)):
        for j in range(len(values)):
            if i != j and (values[i] ^ values[j]).bit_count() <= 4:
                assert any((int(v[i]) ^ int(v[j])).bit_count() <= t[i] for v, t in zip(held, limits))


@pytest.mark.parametrize("choices,block", [((5, 4, 3, 2), 512), ((5,), 4), ((4,), 7), ((3,), 512), ((2,), 2)])
def test_links_connect_what_all_pairs_connect(spark, choices, block):
    values = signed(clustered(200, seed=block))
    prints = spark.createDataFrame([(v,) for v in values], "print long").repartition(5)
    edges = [(r["a"], r["b"]) for r in simhash.links(prints, choices=choices, block=block).collect()]
    want = slow_components({v: v % 2**64 for v in values})
    label = {v: v for v in values}
    for _ in values:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert label == want and len(set(want.values())) < len(values)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long = [rng.choice(words) for _ in range(300)]
    texts = [" ".join(long)] + [" ".join([*long[:k], "other", *long[k + 1:]]) for k in range(0, 300, 20)] + [" ".join(rng.choices(words, k=50)) for _ in range(30)]
    rows = list(enumerate(texts, 1)) + [(100 + i, t) for i, t in enumerate([None, "", " ", "w1", texts[0].upper(), texts[3]])]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows).repartition(3)).collect()}
    prints = {k: slow_fingerprint(t) for k, t in rows}
    label = slow_components(prints)
    assert got == {k: (f"{prints[k]:016x}", label[k]) for k, _ in rows}
    assert label[104] == 1 and label[101] == 100 and len(set(label.values())) < 40


def test_awkward_rows_and_no_rows(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3, 9)} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 5)} == {1}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.near_duplicates(documents(spark, [(None, "a b")])).head()["component_id"] is None
