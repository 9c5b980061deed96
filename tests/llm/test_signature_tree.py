import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelscape.llm import signature_tree as tree
from labelscape.llm.components import components
from labelscape.llm.shingles import shingle_set, word_numbers
from tests.llm.awkward import TEXTS, documents


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(texts, percent=85, width=4):
    sets = [shingles(t, width) for _, t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i][0] is None or texts[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (key, _) in enumerate(texts):
        if key is not None:
            smallest[find(i)].append(key)
    return Counter((key, len(sets[i]), None if key is None else key if not sets[i] else min(smallest[find(i)]))
                   for i, (key, _) in enumerate(texts))


def near_copies(seed, groups=12, size=6, words=80):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pool = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(400)]
    passage = [rng.choice(pool) for _ in range(40)]
    texts = []
    for _ in range(groups):
        own = [rng.choice(pool) for _ in range(words)] + (passage if rng.random() < 0.6 else [])
        for _ in range(size):
            copy = list(own)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            texts.append((rng.randint(0, 10**6), " ".join(copy)))
    return texts


def result(df, **options):
    return Counter(tuple(r) for r in tree.jaccard_join(df, **options).collect())


def test_shingle_numbers_are_one_to_one():
    text = "A b  c\td e\x0bf a B c d e"
    assert len(shingle_set(text)) == len(shingles(text))
    assert shingle_set("x y").tolist() != shingle_set("x y z w").tolist() and len(shingle_set(" \n")) == 0


def test_long_words_do_not_collide():
    """Letters in Thue-Morse order and their complement are alike in sums modulo powers of two."""
    for size in (1024, 2048, 4096):
        one = "".join("ab"[i.bit_count() % 2] for i in range(size))
        other = one.translate(str.maketrans("ab", "ba"))
        assert word_numbers(one)[0] != word_numbers(other)[0]
        assert word_numbers(f"{one} x {other}").tolist() == [*word_numbers(one), *word_numbers("x"), *word_numbers(other)]


def test_awkward_table(spark):
    assert result(documents(spark)) == brute(TEXTS)


def test_near_copies(spark):
    texts = near_copies(1)
    assert result(documents(spark, texts).repartition(5)) == brute(texts)


@pytest.mark.parametrize("percent,width", [(80, 5), (60, 2)])
def test_other_thresholds(spark, percent, width):
    texts = near_copies(2, groups=8)
    assert result(documents(spark, texts).repartition(3), percent=percent, width=width) == brute(texts, percent, width)


def test_clusters_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK", 4)
    monkeypatch.setattr(tree, "FAN", 2)
    texts = near_copies(3, groups=4, size=25, words=60)
    assert result(documents(spark, texts).repartition(5)) == brute(texts)


def test_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(tree, "FLUSH", 64)
    texts = near_copies(4, groups=6)
    assert result(documents(spark, texts).repartition(3)) == brute(texts)


def test_tree_finds_what_pairs_find():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(5)]
    sets = []
    for _ in range(60):
        own = base[rng.integers(5)].copy()
        keep = rng.random(len(own)) > 0.08
        sets.append(np.unique(np.concatenate([own[keep], rng.integers(0, 1 << 63, rng.integers(0, 6)).astype(np.uint64)])))
    pairs = tree.linked_pairs(sets, [None] * 60, 85)

    def classes(links):
        parent = list(range(60))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in links:
            parent[find(i)] = find(j)
        return {frozenset(k for k in range(60) if find(k) == find(i)) for i in range(60)}

    every = [(i, j) for i in range(60) for j in range(i)
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert classes(pairs) == classes(every)
    assert len(pairs) < len(every)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (102, 101), (5, 5), (None, 3)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in rows} == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def test_one_of_each(spark):
    df = documents(spark)
    kept = tree.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:9]) for r in kept.collect()) == sorted(
        [("1", "the quick"), ("2", ""), ("3", ""), ("4", "alpha bet"), ("None", "a row wit"), ("None", ""), ("7", "one two t"),
         ("8", "Ünï cödé "), ("9", " \t\n\r\x0b\x0c "), (str(2**40), "the quick")])


def test_no_rows(spark):
    assert tree.jaccard_join(documents(spark, [])).count() == 0


def brute_links(texts, percent=85, width=4):
    """brute() with the number of links of each document."""
    sets = [shingles(t, width) if key is not None else set() for key, t in texts]
    sizes = [len(shingles(t, width)) for _, t in texts]
    n = [sum(1 for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= percent * len(a | b)) for i, a in enumerate(sets)]
    return Counter((key, size, m) for (key, _), size, m in zip(texts, sizes, n))


def counted(df, **options):
    rows = tree.jaccard_join(df, links=True, **options).collect()
    return Counter(tuple(r)[:3] for r in rows), Counter((r[0], r[1], r[3]) for r in rows)


def test_links_of_awkward_table(spark):
    assert counted(documents(spark)) == (brute(TEXTS), brute_links(TEXTS))


@pytest.mark.parametrize("block", [128, 4])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(tree, "BLOCK", block)
    texts = near_copies(3, groups=4, size=25, words=60)
    texts += texts[:7]
    assert counted(documents(spark, texts).repartition(5)) == (brute(texts), brute_links(texts))


def test_link_counts_equal_sql(spark):
    import duckdb

    from compare import difference
    from labelscape.llm import catalog
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for name, sql in catalog.FURTHER_ORACLES.items():
        assert difference(catalog.FURTHER[name](spark, folder).toPandas(), db.execute(sql).df()) is None
