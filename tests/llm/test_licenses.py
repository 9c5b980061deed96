import random

import pytest

from labelscape.llm import licenses as lic
from tests.llm.awkward import TEXTS, documents

MIT = " ".join(lic.TEMPLATES["MIT"].split())


@pytest.fixture(scope="module")
def index():
    return lic.Index(lic.TEMPLATES, lic.Scan())


def test_whole_template_and_span(index):
    text = f"é😀 before. {MIT} after"
    found = [m for m in index.matches(text) if m[0] == "MIT"]
    assert len(found) == 1 and found[0][3] == found[0][4]
    assert text[found[0][1]:found[0][2]] == MIT.rstrip(".")


def test_edited_template(index):
    rng = random.Random(1)
    words = MIT.split()
    for i in rng.sample(range(10, len(words) - 10), 12):
        words[i] = rng.choice(["", "changed", words[i] + " inserted"])
    found = [m for m in index.matches("x y z " + " ".join(words)) if m[0] == "MIT"]
    assert len(found) == 1 and 0.85 * found[0][4] <= found[0][3] < found[0][4]


def test_every_repeat_is_found(index):
    line = "Released under the MIT License."
    text = f"{line} and {line}\n{line}"
    assert [text[a:b] for name, a, b, *_ in index.matches(text)] == [line[:-1]] * 3


def test_parts_below_coverage_are_left_out(index):
    assert index.matches(" ".join(MIT.split()[:60])) == []
    assert index.matches("released under licence of nobody at all") == []


def brute(template, numbers):
    """Best score over all diagonals by the full table."""
    best = (0, 0)
    prev = [(0, 0)] * (len(numbers) + 1)
    for word in template:
        row = [(0, 0)]
        for j, other in enumerate(numbers, 1):
            options = [(0, 0), (prev[j][0] - 1, prev[j][1]), (row[j - 1][0] - 1, row[j - 1][1]), (prev[j - 1][0] - 1, prev[j - 1][1])]
            if word == other:
                options.append((prev[j - 1][0] + 2, prev[j - 1][1] + 1))
                best = max(best, options[-1])
            row.append(max(options))
        prev = row
    return best


def test_alignment_scores_as_the_full_table():
    import numpy as np
    rng = np.random.default_rng(2)
    for _ in range(30):
        template = rng.integers(0, 30, 25).astype(np.uint64)
        copy = [int(w) for w in template if rng.random() > 0.15]
        text = np.array([*rng.integers(0, 30, 5), *copy, *rng.integers(0, 30, 5)], np.uint64)
        matched, start, end = lic.align(template, text, -30, 40)
        assert abs(matched - brute(template.tolist(), text.tolist())[1]) <= 2 and 0 <= start <= end < len(text)


def test_awkward_table(spark):
    texts = TEXTS + [(30, "Licensed under CC BY-NC 4.0. " + "w " * 50_000 + "Licensed under CC BY-NC 4.0."), (31, "LICENSED  under cc-by-nc, 4.0")]
    rows = sorted(tuple(r)[:2] for r in lic.license_scan(documents(spark, texts)).collect())
    assert rows == [(30, "CC-BY-NC-4.0-notice")] * 2 + [(31, "CC-BY-NC-4.0-notice")]
    assert lic.license_scan(documents(spark, [])).count() == 0
    assert lic.license_scan(documents(spark), {}).count() == 0


def test_one_word_edits_of_every_notice(index):
    for name in (n for n in lic.TEMPLATES if n.endswith("notice")):
        template = lic.words(lic.TEMPLATES[name])[0]
        plain = lic.TEMPLATES[name].replace(".", " ").replace(",", " ").replace("-", " ").split()
        own = list(plain)
        for i in range(len(own)):
            for edit in ([], ["changed"], [own[i], "inserted"]):
                text = " ".join(["some", "words", "before", *own[:i], *edit, *own[i + 1:], "and", "some", "after"])
                numbers = lic.words(text)[0]
                matched = lic.align(template, numbers, -len(template), len(numbers))[0]  # without an index
                found = [m[3] for m in index.matches(text) if m[0] == name]
                assert found == ([matched] if matched >= 0.8 * len(template) else []), (name, text)
