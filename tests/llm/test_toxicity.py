import random
from itertools import combinations

import numpy as np
import pytest

from labelscape.llm import toxicity as tox
from tests.llm.awkward import TEXTS, documents

SETTINGS = tox.Settings(landmarks=24, sample=600)


def brute_kernel(s, t, order, decay):
    def features(word):
        out = {}
        for r in range(1, order + 1):
            for at in combinations(range(len(word)), r):
                u = "".join(word[i] for i in at)
                out[u] = out.get(u, 0) + decay ** (at[-1] - at[0] + 1)
        return out

    one, other = features(s), features(t)
    return sum(v * other.get(u, 0) for u, v in one.items())


def test_kernel_by_listing():
    words, marks = ["banana", "abba", "é", "idixot", "zzz"], ["idiot", "banana", "aé"]
    space = tox.Subsequences(3, 0.6, "".join(marks))
    got = space.products(words, *space.table(marks))
    want = [[brute_kernel(w, m, 3, 0.6) for m in marks] for w in words]
    assert np.allclose(got, want, rtol=1e-5)
    assert np.allclose(tox.self_kernel(words, 3, 0.6), [brute_kernel(w, w, 3, 0.6) for w in words], rtol=1e-5)


def test_folded_margins_equal_the_landmarks_sum():
    rng = np.random.default_rng(0)
    model = tox.Model(SETTINGS, ["idiot", "the", "mañana"], rng.normal(size=3), 0.3)
    words = ["idiot", "idi0t", "there", "x", "ñ"]
    assert np.allclose(model.margins(words), model.features(words) @ model.weights + 0.3, atol=1e-4)


def test_words():
    assert tox.words_of("You I.D.I.O.T, i d i o t! sc*um l0ser") >= {"you", "idiot", "scum", "loser"}
    assert tox.words_of(" ") == set() and max(map(len, tox.windows("a" * 95))) == tox.LONGEST
    assert "".join(sorted(set("".join(tox.windows("abcdefghijklmnopqrstuvwxyz" * 2))))) == "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def sentences():
    rng = random.Random(5)
    parts = ["on", "re", "tha", "ing", "er", "ed", "ti", "st", "nd", "ly", "wh", "ou"]
    bad = ["idiot", "moron", "pathetic", "worthless", "scum"]

    def text(toxic):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words) + "."

    return [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(800)]


def test_held_out_and_disguised(sentences):
    model = tox.train(sentences[:600], SETTINGS)
    scores = np.array(model.scores([t for t, _ in sentences[600:]]))
    marks = np.array([y for _, y in sentences[600:]])
    assert ((scores >= 0.3) == marks).mean() > 0.97
    disguised = ["onre tha i d i o t", "you idiiot ing", "m-o-r-o-n", "patheticc erst", "w0rthless", "scuum"]
    assert np.mean([s >= 0.3 for s in model.scores(disguised)]) >= 0.8
    assert max(model.scores(["thaing onre", "", "edst whou tily"])) < 0.3


def test_one_label_only():
    assert max(tox.train([("fine words", 0)] * 5, SETTINGS).scores(["fine words", ""])) < 0.3
    assert tox.train([], SETTINGS).scores(["x"])[0] < 0.3


def test_awkward_table(spark, sentences):
    docs = documents(spark, [(i, t) for i, (t, _) in enumerate(sentences[:200])])
    labels = spark.createDataFrame([(i, y, 1) for i, (_, y) in enumerate(sentences[:200])] + [(None, 1, 0), (3, None, 0), (10**9, 1, 0)],
                                   "doc_id long, toxic int, label int")
    model = tox.fit(docs, labels, SETTINGS)
    df = documents(spark, TEXTS + [(50, "an idiot")])
    out = tox.score(df.drop("toxicity"), model)
    assert out.columns == [*df.drop("toxicity").columns, "toxicity"]
    rows = {(r["doc_id"], r["text"]): r["toxicity"] for r in out.collect()}
    assert len(rows) == len(set(TEXTS)) + 1 and all(0 <= v <= 1 for v in rows.values())
    assert rows[50, "an idiot"] > 0.3 > max(v for k, v in rows.items() if not (k[1] or "").strip())
    assert tox.score(documents(spark, []).drop("toxicity"), model).count() == 0


def test_long_texts_are_learnt_from_as_a_whole(spark):
    rng = np.random.default_rng(8)
    plain = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)]

    def text(telling):
        sentences = [" ".join(rng.choice(plain, 8)) + "." for _ in range(200)]
        sentences[2 * int(rng.integers(1, 99)) + 1] += f" {telling}."
        return " ".join(sentences)

    rows = [(i, text("grubblewort" if i % 4 == 0 else "harmless"), int(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    learn = tox.learn
    try:
        tox.learn = lambda labelled, settings: seen.extend((set(w), y) for w, y in labelled) or learn(seen, settings)
        model = tox.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    finally:
        tox.learn = learn
    assert sorted((sorted(w), y) for w, y in seen) == sorted((sorted(tox.words_of(t)), y) for _, t, y in rows)
    assert min(model.scores([t for _, t, y in rows if y])) > max(model.scores([t for _, t, y in rows if not y]))
