import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscape.llm import manifest
from tests.llm.awkward import documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def slow_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def slow_path(levels, i, node):
    """Siblings, and what comes out at the top."""
    siblings = []
    for nodes in levels[:-1]:
        start = i - i % 3
        run = nodes[start:start + 3]
        siblings.append(run[:i - start] + run[i - start + 1:])
        node, i = h(*run[:i - start], node, *run[i - start + 1:]), i // 3
    return siblings, node


def slow_manifest(rows):
    rows = [(r, slow_leaf(r, r["text"]), slow_leaf(r, r["text"] and r["text"].replace("\n", "") if r["doc_id"] is not None and zlib.crc32(
        str(r["doc_id"]).encode()) % 2 == 0 else r["text"])) for r in rows]
    names = sorted({r["source"] for r, _, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = [], []
    for name in names:
        mine = sorted((x for x in rows if x[0]["source"] == name), key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        order.append(mine)
        trees.append(slow_levels([x[1] for x in mine]))
    top = slow_levels([levels[-1][0] for levels in trees])
    out = []
    for g, (mine, levels) in enumerate(zip(order, trees)):
        for i, (r, leaf, other) in enumerate(mine):
            inside, node = slow_path(levels, i, other)
            outside, root = slow_path(top, g, node)
            lists = inside + outside
            out.append((r["doc_id"], leaf, levels[-1][0], top[-1][0], h(*sum(lists, [])), root, root == top[-1][0], lists))
    return out


def made(spark, sizes, seed=1):
    """Rows of sources with the given sizes, a null one among them."""
    rng, rows, key = random.Random(seed), [], 0
    for i, size in enumerate(sizes):
        for _ in range(size):
            key += 1
            rows.append((key, rng.choice([None, "", "plain", "a\nb\n", "é\n中"]), None if i == 1 else f"s{i % 7}é{i}", rng.choice([None, "en"]), rng.choice([None, 5])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return df.withColumn("node", F.lit("x")).withColumn("part", F.lit(1)).withColumn("tree", F.lit(0.5)).repartition(5)


def got(df, **more):
    return sorted((tuple(r) for r in manifest.manifest(df, tampered=manifest.without_newlines(), **more).collect()), key=str)


def test_octopus_is_what_paths_need_and_cannot_derive():
    rng = np.random.default_rng(2)
    for n in [1, 2, 3, 4, 9, 10, 28, 100]:
        for many in {1, n // 2, n} - {0}:
            places = np.sort(rng.choice(n, many, replace=False))
            levels, size, have = [], n, set(places.tolist())
            while size > 1:
                need = {p for x in have for p in range(x - x % 3, min(size, x - x % 3 + 3))} - have
                levels.append(sorted(need))
                have, size = {x // 3 for x in have}, -(-size // 3)
            assert [x.tolist() for x in manifest.octopus(places, n)] == levels


@pytest.mark.parametrize("sizes", [[1], [2, 3], [40, 1, 2187, 2188, 5, 9, 10], [1] * 30 + [4] * 25])
def test_manifest_equals_brute_force(spark, sizes):
    df = made(spark, sizes)
    assert got(df, siblings=True) == sorted(slow_manifest(df.collect()), key=str)


def test_small_blocks_take_several_rounds(spark, monkeypatch):
    for name, value in (("LEVELS", 1), ("BLOCK", 3), ("PART", 9)):
        monkeypatch.setattr(manifest, name, value)
    df = made(spark, [100, 1, 29, *[2] * 12])
    assert got(df, siblings=True) == sorted(slow_manifest(df.collect()), key=str)


def test_sql_says_the_same(spark):
    df = made(spark, [100, 1, 29, *[2] * 12])
    con = duckdb.connect()
    con.register("documents", df.drop("node", "part", "tree").toArrow())
    assert got(df) == sorted(con.execute(manifest.sql(6)).fetchall(), key=str)


def test_awkward_rows_and_no_rows(spark):
    df = documents(spark)
    rows = got(df)
    assert len(rows) == df.count() and len({r[3] for r in rows}) == 1
    assert rows == sorted((x[:-1] for x in slow_manifest(df.collect())), key=str)
    assert got(documents(spark, [])) == []
