import gzip
import hashlib
import uuid

import pytest

from labelscape.llm import warc

PAGES = [
    (5, "http://a/1", "x" * 150), (3, "http://a/2", "x" * 150), (9, "http://a/3", "x" * 150), (4, "http://a/4", "y" * 99),
    (6, "http://a/5", "y" * 99), (7, None, None), (8, "http://a/ b\r\nEvil: 1", ""), (None, "u", "z" * 200), (10, "u", "z" * 200),
    (11, "u", "é" * 50), (12, "u", "é" * 50), (13, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 40),
    (14, "u", "long page " * 200_000), (3, "http://a/2", "x" * 150),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "c") for i, u, h in rows], "page_id long, url string, html string, page int, chunk string")


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, other in rows if j is not None and (other or "") == (html or "")]
        first = min(same) if len(data) >= 100 and same else None
        again = first is not None and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


def test_pages_come_back(spark):
    assert sorted(str(tuple(r)) for r in warc.archived(frame(spark, PAGES).repartition(3)).collect()) == expected(PAGES)


def test_no_rows(spark):
    assert warc.archived(frame(spark, [])).count() == 0


def records(n):
    return [warc.record_of(i, f"http://a/{i}", b"p%d" % i * 50, 100, hashlib.sha256(b"p%d" % i * 50).hexdigest(), None, "2024-01-01T00:00:00Z")
            for i in range(n)]


def damaged(data: bytes, at: int) -> bytes:
    return data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1:]


@pytest.mark.parametrize("pack", [lambda r: r, gzip.compress])
def test_later_records_are_recovered_and_gaps_logged(pack):
    parts = [pack(r) for r in records(6)]
    whole = b"".join(parts)
    second = len(parts[0]) + len(parts[1]) // 2
    broken = damaged(whole, second)[:-7] + b""
    found = list(warc.salvage(broken))
    ids = [f[3]["warc-record-id"] for f in found if f[0] == "record"]
    assert ids == [f"<urn:page:{i}>" for i in (0, 2, 3, 4)]
    gaps = [(f[1], f[2]) for f in found if f[0] == "gap"]
    assert gaps == [(len(parts[0]), len(parts[0]) + len(parts[1])), (len(whole) - len(parts[5]), len(broken))]
    at = 0
    for _, start, end, *_ in found:
        assert start == at
        at = end
    assert at == len(broken)


def test_nothing_but_noise():
    noise = b"WARC/1. \x1f\x8b\x08 noise" * 5
    assert [f[:3] for f in warc.salvage(noise)] == [("gap", 0, len(noise))]
    assert list(warc.salvage(b"")) == []


def test_large_member_still_ends_in_zero():
    out = warc.member(b"a" * (1 << 24), 1)
    assert out[-1] == 0 and gzip.decompress(out) == b"a" * (1 << 24)


def test_read_archives_reports_gaps(spark):
    from labelscape.session import scratch_root
    path = f"{scratch_root(spark)}/noise-{uuid.uuid4().hex}"
    good = b"".join(records(2))
    spark.createDataFrame([(bytearray(b"junk " + good),)], "c binary").selectExpr("cast(c as string) c").coalesce(1).write.text(path)
    rows = warc.read_archives(spark, path).orderBy("start").collect()
    assert [(r["kind"], r["start"]) for r in rows][:2] == [("gap", 0), ("record", 5)]
    assert rows[1]["payload"] == b"p0" * 50 and rows[-1]["kind"] == "gap"  # the sink's own line end


def inside(found):
    return [(f[0], f[3]["warc-record-id"] if f[0] == "record" else f[3], f[5], f[6]) for f in found]


def test_damaged_record_inside_a_member():
    parts = records(5)
    sizes = [sum(map(len, parts[:i])) for i in range(6)]
    plain = b"".join(parts)
    for at in (sizes[2] + 3, sizes[2] + len(parts[2]) - 20):  # its version line, its payload
        data = gzip.compress(damaged(plain, at)) + gzip.compress(parts[0])
        found = list(warc.salvage(data))
        kinds = inside(found)
        assert [k for k in kinds if k[0] == "record"] == [
            ("record", f"<urn:page:{i}>", sizes[i], sizes[i + 1]) for i in (0, 1, 3, 4)] + [("record", "<urn:page:0>", 0, sizes[1])]
        assert [k[2:] for k in kinds if k[0] == "gap"] == [(sizes[2], sizes[3])]


def test_records_before_a_cut_or_damage_inside_a_member():
    import random
    rng = random.Random(5)
    texts = [bytes(rng.randrange(256) for _ in range(3000)) for _ in range(6)]
    parts = [warc.record_of(i, "u", t, 3000, hashlib.sha256(t).hexdigest(), None, "2024-01-01T00:00:00Z") for i, t in enumerate(texts)]
    sizes = [sum(map(len, parts[:i])) for i in range(7)]
    whole = gzip.compress(b"".join(parts))
    cut = whole[:len(whole) * 7 // 12]
    found = list(warc.salvage(cut))
    assert inside(found) == [("record", f"<urn:page:{i}>", sizes[i], sizes[i + 1]) for i in range(3)] + [("gap", "member cut off", sizes[3], None)]
    assert found[0][7] == "member cut off" and found[-1][1:3] == (0, len(cut))
    # a wrong sum at the end loses nothing, and what follows is found
    found = list(warc.salvage(damaged(whole, len(whole) - 6) + gzip.compress(parts[0])))
    assert [f[3]["warc-record-id"] for f in found if f[0] == "record"] == [f"<urn:page:{i}>" for i in (0, 1, 2, 3, 4, 5, 0)]
    assert [f[1:3] for f in found if f[0] == "gap"] == [(0, len(whole))]
    stored = gzip.compress(b"".join(parts), 0)  # its records stand in the archive as they are
    found = list(warc.salvage(stored[:sizes[2] + 99]))
    assert [f[3]["warc-record-id"] for f in found if f[0] == "record"] == ["<urn:page:0>", "<urn:page:1>"]
