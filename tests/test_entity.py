import random
import time

import numpy as np
import pytest

from labelscape.functions import linkage as link
from labelscape.operators import entity


def slow_row(block, labels, name, out, back, method):
    """The whole matrix with the entity's row and column, clustered anew."""
    at = sum(label < name for label in labels)
    full = np.zeros((len(labels) + 1, len(labels) + 1))
    keep = [i for i in range(len(labels) + 1) if i != at]
    full[np.ix_(keep, keep)] = block
    full[at, keep], full[keep, at] = out, back
    return link.structure_map(full, method)[at][keep]


@pytest.mark.parametrize("method", link.METHODS)
def test_row_equals_clustering_the_whole_matrix(method):
    rng = np.random.default_rng(3)
    for k in (1, 2, 5, 30):
        block = rng.random((k, k))
        labels = [f"l{i:02d}" for i in range(k)]
        made = entity.LabelBlock(labels, block)
        for name in ("a", "l03x", "z"):
            out, back = rng.random(k), rng.random(k)
            assert made.entity_row(name, out, back, method) == pytest.approx(slow_row(block, labels, name, out, back, method))
    if k > 3:  # an entity named like a label takes that label's place
        full = block.copy()
        full[4, :], full[:, 4] = out, back
        full[4, 4] = 0
        assert made.entity_row("l04", out, back, method) == pytest.approx(link.structure_map(full, method)[4])


def test_constant_map_stays_zero():
    made = entity.LabelBlock(["a", "b"], np.zeros((2, 2)))
    assert made.entity_row("e", [0.0, 0.0], [0.0, 0.0], "average").tolist() == [0.0, 0.0]


def test_many_labels_are_faster():
    rng = np.random.default_rng(5)
    k = 500
    block, out, back = rng.random((k, k)), rng.random(k), rng.random(k)
    labels = [f"l{i:03d}" for i in range(k)]
    made = entity.LabelBlock(labels, block)

    def best(f):
        times = []
        for _ in range(3):
            start = time.process_time()
            f()
            times.append(time.process_time() - start)
        return min(times)

    assert best(lambda: slow_row(block, labels, "e", out, back, "average")) > 5 * best(lambda: made.entity_row("e", out, back, "average"))


def test_a_large_block_goes_by_a_shuffle(spark):
    rng = random.Random(6)
    cells = spark.createDataFrame([(i, rng.random(), rng.random(), rng.choice(["t1", "t2", "t3", "t4", "g2"])) for i in range(60)],
                                  "cell_id long, x double, y double, celltype string")
    points = spark.createDataFrame([(rng.random(), rng.random(), f"g{rng.randrange(9)}", rng.random()) for _ in range(90)] + [(0.1, 0.1, "none", 0.0)],
                                   "x double, y double, entity string, weight double")
    want = {(r["entity"], r["celltype"]): r["value"] for r in entity.entity_to_cell(cells, points).collect()}
    got = {(r["entity"], r["celltype"]): r["value"] for r in entity.entity_to_cell(cells, points, block_rows=10).collect()}
    assert len(got) == 50 and got.keys() == want.keys() and all(got[k] == (None if want[k] is None else pytest.approx(want[k])) for k in got)
    assert {got["none", "t1"]} == {None}
