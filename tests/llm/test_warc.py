"""WARC archives: what is written comes back, and damage costs no more than what it hits."""

import gzip
import hashlib
import uuid

import pytest

from docloom.llm import warc
from docloom.llm.common import shared_dir

HTML = [None, "", "short", "x" * 99, "y" * 100, "y" * 100, "WARC/1.0\r\nWARC-Type: response\r\n\r\n" + "z" * 200, "\r\n\r\n" * 50, "é" * 60, "é" * 60, "é" * 60, "<html>" + "long " * 200_000, "\x1f\x8b\x08 " * 40, "x" * 99]


def plain(pages):
    """The expected rows by plain Python."""
    by = {}
    for i, _, h in pages:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            by[raw] = min(i, by.get(raw, i))
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        first = by.get(raw)
        revisit = first is not None and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def rows_of(spark, pages, schema="page_id long, url string, html string"):
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    warc.write(spark.createDataFrame(pages, schema).repartition(3), path)
    return path, warc.read(spark, path)


def test_edges(spark):
    pages = [(i + 5, f"http://a.example/{i}", h) for i, h in enumerate(HTML)] + [(None, None, "q" * 150), (3, "http://x/ a\r\nb", "q" * 150), (1, None, "y" * 100), (1, "again", "y" * 100), (-4, "", "é" * 60), (2**60 + 1, "u", "é" * 60)]
    path, found = rows_of(spark, pages)
    rows = found.collect()
    assert all(r.kind == "record" for r in rows)
    number = lambda x: None if x is None or x.endswith("null") else int(x.rpartition(":")[2])
    assert sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to)) for r in rows), key=str) == plain(pages)
    held = {r.record_id: r for r in warc.resolved(found).collect()}
    for i, _, h in pages:
        if i is not None:
            assert held[f"{warc.SCHEME}{i}"].payload == (h or "").encode()
    assert held[f"{warc.SCHEME}3"].target_uri == "http://x/%20a%0D%0Ab"
    # the files are plain gzip, and hold the records one after the other
    text = b"".join(gzip.decompress(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    assert text.count(b"WARC/1.1\r\n") == len(pages)


def test_hot_group_and_empty(spark):
    pages = [(i, "u", "same " * 40 if i % 3 else f"{i} " * 60) for i in range(300)]
    assert sorted(((int(r.record_id.rpartition(":")[2]), r.type) for r in rows_of(spark, pages)[1].collect())) == sorted((i, t) for i, _, _, t, _ in plain(pages))
    assert rows_of(spark, [])[1].count() == 0
    extra = [(1, "u", "h", "t", "r")]
    assert rows_of(spark, extra, "page_id int, url string, html string, type string, reason string")[1].count() == 1


def archive(n=6, packed=True):
    parts = []
    for i in range(n):
        r = warc.page_record(i, f"http://a/{i}", (f"page {i} " * 50).encode(), None)
        parts.append(warc.member(r) if packed else r)
    return parts


def ids(rows):
    """Their numbers; -1 where the damage is in the id itself, which nothing checks in plain archives."""
    last = [r["record_id"].rpartition(":")[2] for r in rows if r["kind"] == "record"]
    return [int(x) if x.isdecimal() else -1 for x in last]


def covered(data, rows):
    """Records and gaps follow one another and leave nothing out."""
    at = 0
    for r in rows:
        assert r["at"] == at, (r, at)
        at += r["length"]
    return at == len(data)


@pytest.mark.parametrize("packed", [True, False])
def test_damage(packed):
    parts = archive(6, packed)
    whole = b"".join(parts)
    assert ids(warc.salvage(whole)) == [0, 1, 2, 3, 4, 5] and covered(whole, list(warc.salvage(whole)))
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    for place in range(0, len(whole), 7 if packed else 29):
        hit = bytearray(whole)
        hit[place] ^= 0x15
        rows = list(warc.salvage(bytes(hit)))
        own = next(i for i in range(6) if starts[i] <= place < starts[i + 1])
        assert set(range(6)) - {own} <= set(ids(rows)), place
        assert covered(hit, rows)
        if len(ids(rows)) < 6:
            gap = [r for r in rows if r["kind"] == "gap"]
            assert [(r["at"], r["length"]) for r in gap] == [(starts[own], starts[own + 1] - starts[own])] and gap[0]["reason"]


@pytest.mark.parametrize("packed", [True, False])
def test_cuts_and_insertions(packed):
    parts = archive(5, packed)
    whole = b"".join(parts)
    cut = whole[: len(whole) - 20]
    rows = list(warc.salvage(cut))
    assert ids(rows) == [0, 1, 2, 3] and rows[-1]["kind"] == "gap" and covered(cut, rows)
    for junk in (b"\0" * 5000, b"WARC/1.0\r\n", b"\x1f\x8b\x08\x00", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999999\r\n\r\n", bytes(range(256)) * 9):
        data = junk + parts[0] + parts[1] + junk + parts[2] + junk
        rows = list(warc.salvage(data))
        assert ids(rows) == [0, 1, 2] and sum(r["kind"] == "gap" for r in rows) == 3 and covered(data, rows)
    half = parts[0] + parts[1][: len(parts[1]) // 2] + parts[2]
    assert ids(warc.salvage(half)) == [0, 2]
    assert list(warc.salvage(b"")) == []
    assert [r["reason"] for r in warc.salvage(b"nothing here")] == ["no member or version line"]


def test_checks():
    """Each check by itself, in an uncompressed archive between sound records."""
    good = warc.page_record(1, "http://a/1", b"p" * 200, None)
    other = warc.page_record(2, "http://a/2", b"q" * 200, None)
    cases = {
        "no warc-type": good.replace(b"WARC-Type: response\r\n", b""),
        "content-length is no number": good.replace(b"\r\nContent-Length: 2", b"\r\nContent-Length: x2", 1),
        "block digest": good.replace(b"pppp", b"pppo", 1),
        "no end of the record": good[:-4] + b"....",
        "a line of the header has no name": good.replace(b"WARC-Date: ", b"WARC-Date ").replace(b"T00:00:00Z", b""),
    }
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    cases["payload digest"] = warc.record("response", "x", "u", block, "application/http", {"WARC-Payload-Digest": "sha1:" + "A" * 32})
    for reason, bad in cases.items():
        rows = list(warc.salvage(other + bad + other))
        assert [r.get("reason") for r in rows] == [None, reason, None], rows
    # base 32, unknown algorithms, folded lines
    sha1 = __import__("base64").b32encode(hashlib.sha1(b"abc").digest()).decode()
    ok = warc.record("response", "x", "u", block, "application/http", {"WARC-Payload-Digest": f"sha1:{sha1}", "Fold": "a\r\n b", "Other-Digest": "xxh:1"})
    assert [r["kind"] for r in warc.salvage(ok)] == ["record"]
    # several records in one member, one of them damaged
    held = warc.member(good + cases["block digest"] + other)
    rows = list(warc.salvage(held))
    assert [(r["kind"], r["at"]) for r in rows] == [("record", 0), ("gap", 0), ("record", 0)] and rows[1]["inside"] == len(good)


def test_damaged_files(spark):
    path = f"{shared_dir(spark)}/warc-damaged-{uuid.uuid4().hex}"
    folder = path.removeprefix("file:")
    folder = "/" + folder.lstrip("/")
    import pathlib

    pathlib.Path(folder).mkdir(parents=True)
    parts = archive(4)
    pathlib.Path(folder, "a.warc.gz").write_bytes(parts[0] + b"\0" * 10 + parts[1])
    pathlib.Path(folder, "b.warc").write_bytes(b"".join(archive(3, packed=False))[:-5])
    pathlib.Path(folder, "c.warc").write_bytes(b"")
    found = warc.read(spark, path)
    assert sorted(r.record_id[-1] for r in found.where("kind = 'record'").collect()) == ["0", "0", "1", "1"]
    assert [(r.path[-9:], r.at, r.length) for r in warc.gaps(found).orderBy("path").collect()][0] == ("a.warc.gz", len(parts[0]), 10)
