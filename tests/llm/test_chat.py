import duckdb
import pytest

from labelscape.llm import chat

ROWS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", ""), (1, 3, "ann", ""),
        (1, 3, None, "tie"), (1, None, "bob", "last"), (2, 0, "system", "nobody here"), (None, 1, "ann b", "no number"), (3, 5, "ann", "é" * 40_000),
        (3, 6, "bob", "after a long turn")] + [(4, i, ("u", "v", "w")[i % 3], f"turn {i}") for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, at int, size int")


def brute(rows, segment=chat.SEGMENT):
    out = set()
    rows = {(c, t, "unknown" if r is None else r.replace(" ", "_"), (x or "").replace("<|im_", "<| im_")) for c, t, r, x in rows}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
        for who in {r[2] for r in own} - {"system"}:
            at, segments = 0, {}
            for _, _, speaker, text in own:
                head = chat.OPEN + ("system" if speaker == "system" else "assistant" if speaker == who else f"user name={speaker}") + "\n"
                done, mask, n = segments.setdefault(at // segment, ("", [], 0))
                if speaker == who:
                    start = len(done) + len(head)
                    mask.append(f"{start}:{start + len(text) + len(chat.CLOSE)}")
                segments[at // segment] = (done + head + text + chat.CLOSE + "\n", mask, n + 1)
                at += len(head) + len(text) + len(chat.CLOSE) + 1
            out |= {(conv, who, k, n, done, ",".join(mask)) for k, (done, mask, n) in segments.items()}
    return out


@pytest.mark.parametrize("segment", [chat.SEGMENT, 100])
def test_every_perspective(spark, segment):
    rows = [tuple(r) for r in chat.perspectives(frame(spark, ROWS).repartition(5), segment=segment).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(ROWS, segment)


def test_masks_cover_what_the_participant_says(spark):
    row = chat.perspectives(frame(spark, [(1, 0, "a", "one"), (1, 1, "b", "two")])).where("participant = 'b'").head()
    start, end = map(int, row["mask"].split(":"))
    assert row["text"][start:end] == "two" + chat.CLOSE and "name=a" in row["text"] and "name=b" not in row["text"]


def test_sql_says_the_same(spark):
    conversations = frame(spark, ROWS).toPandas().astype({"turn": "Int64", "conv_id": "Int64"})  # noqa: F841
    db = duckdb.connect()
    db.register("conversations", conversations)
    assert {tuple(r) for r in db.execute(chat.SQL).fetchall()} == brute(ROWS)


def test_no_rows(spark):
    assert chat.perspectives(frame(spark, [])).count() == 0
