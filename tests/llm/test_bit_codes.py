import numpy as np
from pyspark.sql import functions as F

from labelscape.llm import bit_codes
from labelscape.llm.bit_codes import search

ODD = [(1000, None), (None, [1.0, 0.0]), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] + [1.0] * 15),
       (1004, [None] + [1.0] * 15), (1005, [])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, size int")


def exact(vectors, query, k):
    ids = np.array([i for i in vectors if i != query])
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    scores = np.array([unit[i] @ unit[query] for i in ids])
    order = np.lexsort((ids, -np.round(scores, 12)))[:k]
    return ids[order].tolist(), scores[order]


def clustered(n, size, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, size))
    return {int(i): (centres[i % 8] + 0.7 * rng.normal(size=size)).tolist() for i in range(n)}


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(bit_codes, "BLOCK", 128)
    monkeypatch.setattr(bit_codes, "QUERIES", 8)
    vectors = clustered(900, 32, 1)
    rows = search(frame(spark, list(vectors.items()) + ODD).repartition(4), F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == {i for i in vectors if i % 50 == 0}
    hits = 0
    for q, some in found.items():
        some.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in some] == [1, 2, 3, 4, 5]
        ids, _ = exact(vectors, q, 5)
        hits += len(set(ids) & {r["vec_id"] for r in some})
        for r in some:
            a, b = np.array(vectors[q]), np.array(vectors[r["vec_id"]])
            assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert hits >= 0.95 * 5 * len(found)


def test_bound_holds_mostly():
    rng = np.random.default_rng(3)
    vectors, queries = rng.normal(size=(500, 48)), rng.normal(size=(40, 48))
    bits, scalars = bit_codes.encode(vectors, 5)
    guess, error = bit_codes.estimate(bits, scalars, queries, 5, 2.2)
    truth = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (vectors / np.linalg.norm(vectors, axis=1)[:, None]).T
    assert bits.shape == (500, 6) and (np.abs(guess - truth) <= error).mean() > 0.95
    assert abs((guess - truth).mean()) < 0.01


def test_sums_from_packed_bits():
    rng = np.random.default_rng(4)
    for size in (1, 7, 8, 13, 64):
        signs, queries = rng.random((70, size)) < 0.5, rng.normal(size=(9, size)).astype(np.float32)
        got = bit_codes.signed_sums(np.packbits(signs, axis=1), queries)
        assert np.allclose(got, queries @ (2.0 * signs - 1).T, atol=1e-4)


def test_recall_on_the_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = {}
    for r in search(table, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = {r["vec_id"]: r["embedding"] for r in table.select("vec_id", "embedding").collect()}
    wanted = {q: set(exact(rows, q, 5)[0]) for q in rows if q % 50 == 0}
    assert set(found) == set(wanted) and sum(len(found[q] & wanted[q]) for q in wanted) >= 0.95 * 5 * len(wanted)


def test_ties_repeats_and_few_candidates(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 9)] + [(0, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0]), (100, [2.0, 4.0, 6.0]), (50, [1.0, 0.0])]
    got = search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by[0] == [1, 2, 3, 4, 5] and by[100] == [0, 1, 2, 3, 4] and 50 not in by
    pair = search(frame(spark, [(0, [1.0, 1.0]), (1, [1.0, 0.0])]), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in pair] == [(1, 0.707107)]


def test_tiny_and_huge(spark):
    got = search(frame(spark, [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [-1.0, 0.0])]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in got] == [(1, 0.707107), (2, -1.0)]


def test_no_rows(spark):
    assert search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert search(frame(spark, ODD), F.col("vec_id") % 50 == 0).count() == 0
