import hashlib

import numpy as np

from labelscape.llm.order_minhash import MULTIPLIER, Sketch, fingerprints, likeness, mixed, neighbour_edits, shown
from tests.llm.awkward import TEXTS, documents


def test_picks_are_the_smallest_in_text_order():
    sketch = Sketch(size=8, picks=3)
    text = "abcabcabc the cat sat on the mat the cat sat"
    grams = sketch.occurrences(text)
    assert len(set(grams.tolist())) == len(grams)  # repeated k-mers are numbered apart
    want = []
    for m, a in zip(*sketch.factors()):
        order = sorted(range(len(grams)), key=lambda i: ((int(grams[i]) >> 32) * int(m) & 0xFFFFFFFF) ^ int(a))
        number = np.full(1, 3, np.uint64)
        for i in sorted(order[:3]):
            number = mixed(number * MULTIPLIER + grams[i])
        want.append(int(number[0]) >> 32)
    assert sketch.signature(text).tolist() == want


def test_order_counts():
    sketch = Sketch()
    a, b = "first part of it comes here and now ", "second piece follows after that one "
    same = likeness(sketch.signature(a + b), sketch.signature(a + b))
    swapped = likeness(sketch.signature(a + b), sketch.signature(b + a))
    edited = likeness(sketch.signature((a + b) * 5), sketch.signature((a + b) * 5 + "!"))
    assert same == 1.0 and swapped < 0.8 and edited > 0.8


def test_fingerprints_of_equal_texts(spark):
    rows = fingerprints(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 5)}) == 1


def test_neighbour_edits(spark):
    rows = {}
    for r in neighbour_edits(documents(spark).repartition(4)).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    order = sorted([t for t in TEXTS if t[0] is not None], key=lambda t: -t[0]) + sorted(
        [t for t in TEXTS if t[0] is None], key=lambda t: t[1] is None)
    sketch = Sketch()
    assert sum(map(len, rows.values())) == len(TEXTS)
    for i, (key, text) in enumerate(order):
        own, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(own) // 2
        edited = own[:len(own) - half] + after[:half]
        want = (len(own), hashlib.sha256(edited.encode()).hexdigest(), shown(sketch.signature(own)), shown(sketch.signature(edited)),
                likeness(sketch.signature(own), sketch.signature(edited)), likeness(sketch.signature(own), sketch.signature(after)))
        assert want in [tuple(r)[1:] for r in rows[key]]


def test_one_row_and_no_rows(spark):
    row = neighbour_edits(documents(spark, [(1, "alone in the world")])).head()
    assert row["near_next"] == 1.0
    assert neighbour_edits(documents(spark, [])).count() == 0
