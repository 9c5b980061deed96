import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from labelscape.functions.ranks import dealt, numbered
from labelscape.operators import enrichment as en

LABELS = ["a", "a", "b", "b", "c", "a", None]
EDGES = [(0, 1), (1, 0), (1, 2), (2, 3), (3, 1), (4, 0), (4, 5), (5, 4), (5, 2), (0, 3), (2, 2), (0, 1), (6, 0), (1, 6), (2, 9)]


def frames(spark, labels=LABELS, edges=EDGES):
    return (spark.createDataFrame(list(enumerate(labels)), "cell_id long, celltype string"),
            spark.createDataFrame(edges, "cell_id long, neighbor long"))


def exact(labels, edges):
    """Counts, means and spreads over all ways of dealing."""
    keep = {i for i, label in enumerate(labels) if label}
    own = {(s, t) for s, t in edges if s != t and s in keep and t in keep}
    names = sorted({labels[i] for i in keep})
    order = sorted(keep)

    def count(held):
        return Counter((held[s], held[t]) for s, t in own)

    seen = [count(dict(zip(order, deal))) for deal in permutations([labels[i] for i in order])]
    now = count({i: labels[i] for i in keep})
    out = {}
    for a in names:
        for b in names:
            values = np.array([c[a, b] for c in seen], float)
            out[a, b] = (now[a, b], values.mean(), values.std())
    return out


def test_closed_form_equals_all_deals(spark):
    want = exact(LABELS, EDGES)
    rows = en.label_enrichment(*frames(spark)).collect()
    assert {(r["source"], r["target"]) for r in rows} == set(want)
    for r in rows:
        edges, mean, spread = want[r["source"], r["target"]]
        assert r["edges"] == edges and r["expected"] == pytest.approx(mean) and r["spread"] == pytest.approx(spread, abs=1e-9)
        assert r["z"] == (pytest.approx((edges - mean) / spread) if spread > 1e-9 else None)


@pytest.mark.parametrize("labels,edges", [(["a", "b"], [(0, 1)]), (["a", "b", "a"], [(0, 1), (1, 2), (2, 0)]), (["a", "a", "a", "a"], [(0, 1), (3, 2)]),
                                          (["a", "b", "b", "b"], [])])
def test_few_points(spark, labels, edges):
    want = exact(labels, edges)
    rows = en.label_enrichment(*frames(spark, labels, edges)).collect()
    assert {(r["source"], r["target"]): (r["edges"], round(r["expected"], 9), round(r["spread"], 9)) for r in rows} == {
        pair: (n, round(mean, 9), round(spread, 9)) for pair, (n, mean, spread) in want.items()}
    assert all(r["z"] is None for r in rows if r["spread"] == 0)


def test_deals_come_close_to_the_closed_form(spark):
    rng = random.Random(4)
    labels = rng.choices(["a", "b", "c", "d"], [6, 3, 2, 1], k=300)
    edges = [(i, (i + step) % 300) for i in range(300) for step in (1, 2, 7)]
    closed = {(r["source"], r["target"]): r for r in en.label_enrichment(*frames(spark, labels, edges)).collect()}
    rows = en.permuted_enrichment(*frames(spark, labels, edges), rounds=400, seed=2).collect()
    assert len(rows) == len(closed) == 16
    for r in rows:
        c = closed[r["source"], r["target"]]
        assert r["edges"] == c["edges"]
        assert abs(r["expected"] - c["expected"]) < 5 * c["spread"] / 20
        assert r["spread"] == pytest.approx(c["spread"], rel=0.2)
        assert abs(r["z"] - c["z"]) < 0.3 + 0.25 * abs(c["z"])


def test_a_deal_is_a_permutation():
    for total in (1, 2, 3, 17, 1000):
        seen = {tuple(dealt(np.arange(total), total, seed)) for seed in range(5)}
        assert all(sorted(x) == list(range(total)) for x in seen) and (len(seen) > 1 or total < 3)


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "k string, i long").repartition(7), "k", "i").collect()
    assert [(r["k"], r["i"]) for r in sorted(got, key=lambda r: r["number"])] == sorted(rows)
    assert sorted(r["number"] for r in got) == list(range(500))


def test_sweep_is_each_setting_alone(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(i, rng.random(), rng.random(), rng.choice("abc")) for i in range(80)], "cell_id long, x double, y double, celltype string")
    rows = {(r["setting"], r["source"], r["target"]): tuple(r)[3:] for r in en.enrichment_sweep(points, neighbors=(3, 5), radii=(0.1,)).collect()}
    from labelscape.operators.neighbors import neighbor_edges
    for setting, edges in (("k=3", neighbor_edges(points, k_neighbors=3)), ("k=5", neighbor_edges(points, k_neighbors=5)), ("r=0.1", neighbor_edges(points, radius=0.1))):
        for r in en.label_enrichment(points, edges).collect():
            assert rows[setting, r["source"], r["target"]] == pytest.approx(tuple(r)[2:])
    assert len(rows) == 27
    pair = {(r["label_a"], r["label_b"]): r for r in en.proximity(en.label_enrichment(points, neighbor_edges(points, k_neighbors=3))).collect()}
    assert len(pair) == 6 and pair["a", "b"]["edges"] == rows["k=3", "a", "b"][0] + rows["k=3", "b", "a"][0]
    with pytest.raises(ValueError):
        en.enrichment_sweep(points, neighbors=())


def test_radius_counts_equal_listed_edges(spark):
    from labelscape.operators.neighbors import radius_edges
    rng = random.Random(5)
    rows = [(i, rng.randrange(40) / 8, rng.randrange(6) / 2, rng.choice("abcd")) for i in range(700)]
    rows += [(800, None, 1.0, "a"), (801, 1.0, 1.0, None), (802, float("nan"), 1.0, "b"), (None, 1.0, 1.0, "c"), (803, 90.0, 1.0, "e")]
    points = spark.createDataFrame(rows, "cell_id long, x double, y double, celltype string").repartition(5)
    for radius in (0.125, 0.5, 30.0):
        want = {(r["source"], r["target"]): tuple(r)[2:] for r in en.label_enrichment(points, radius_edges(points, radius)).collect()}
        got = {(r["source"], r["target"]): tuple(r)[2:] for r in en.radius_enrichment(points, radius).collect()}
        assert set(got) == set(want) and len(got) == 25
        assert all(got[pair] == pytest.approx(want[pair]) for pair in want)


def test_crowded_places_are_counted_without_a_row_for_each_edge(spark):
    """200,000 points at four places: 10**10 edges within the radius, more than any disk here holds."""
    n = 200_000
    points = spark.range(n).selectExpr("id AS cell_id", "double(id % 4) AS x", "0D AS y", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS celltype")
    rows = {(r["setting"], r["source"], r["target"]): r["edges"] for r in en.enrichment_sweep(points, neighbors=(), radii=(0.5, 2.0)).collect()}
    spot = n // 4
    assert rows["r=0.5", "a", "a"] == 2 * spot * (spot - 1) and rows["r=0.5", "a", "b"] == 0
    assert rows["r=2.0", "a", "a"] == 2 * spot * (2 * spot - 1) and rows["r=2.0", "a", "b"] == 3 * spot * spot
