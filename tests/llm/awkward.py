"""Awkward tables that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 3000

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away"),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "the quick brown fox jumps over the lazy dog and runs far away"),
    (5, "the quick brown fox jumps over the lazy dog and runs far away"),
    (None, "a row without a key"),
    (None, None),
    (7, "one two three"),
    (8, "Ünï cödé 中文 😀 password = abcdefghijkl1 é"),
    (9, " \t\n\r\x0b\x0c "),
    (2**40, "the quick brown fox jumps over the lazy dog and runs far away!"),
]
#: names that the operators use inside
CLASHES = ("start", "end", "kind", "key", "mark", "n", "part", "block", "length", "rank", "label", "toxicity", "row_key", "unit", "path")


def documents(spark, rows=None):
    rows = TEXTS if rows is None else rows
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame([(i, t, None, "s", None, *range(len(CLASHES))) for i, t in rows], kinds)
