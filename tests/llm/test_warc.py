"""WARC archives: round trips, shared payloads, broken records."""

import gzip
import hashlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from saccadia.llm import warc

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "é long page " * 40


def read(data, keep=True):
    return list(warc.records(io.BytesIO(data), keep))


def one(page_id=1, payload=b"hello", url="http://a/ü\r\nX: y", **more):
    given = {"kind": "response", "refers_to": None, "size": len(payload), "digest": hashlib.sha256(payload).hexdigest()} | more
    return warc.record(page_id, url, given["kind"], given["refers_to"], given["size"], given["digest"], payload)


def test_records_round_trip(monkeypatch):
    payloads = [b"", b"\r\n\r\n", b"x" * 300_000, random.Random(1).randbytes(100_000), b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1"]
    data = b"".join(one(i, p) for i, p in enumerate(payloads)) + one(9, b"", kind="revisit", refers_to=3, size=100_000, digest="ab")
    for chunk in (1, 7, 1 << 16):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        if chunk == 1:
            small = read(b"".join(one(i, p) for i, p in enumerate(payloads) if len(p) < 99))
            assert [r[6] for r in small] == [p for p in payloads if len(p) < 99]
            continue
        got = read(data)
        assert [r[6] for r in got] == [*payloads, None] and [r[0] for r in got] == [0, 1, 2, 3, 4, 9]
        assert got[5][2:6] == ("revisit", 3, 100_000, "ab") and not any(r[8] for r in got)
        assert got[0][1] == "http://a/%C3%BC%0D%0AX: y"
        assert all(data[r[7] : r[7] + 2] == b"\x1f\x8b" for r in got)
    assert gzip.decompress(data).count(b"WARC-Type: ") == 6
    assert read(b"") == []


def test_broken_records():
    good = one(2)
    for bad, why in (
        (one(1, digest="00"), "digest"),
        (one(1, size=7), "its head says"),
        (gzip.compress(b"no record\r\n\r\n"), "no record starts"),
        (gzip.compress(re.sub(rb"(?<=response\r\nContent-Length: )\d+", lambda m: b"%d" % (int(m[0]) - 1), gzip.decompress(one(1)))), "longer"),
        (gzip.compress(gzip.decompress(one(1))[:-7]), "shorter"),
        (gzip.compress(gzip.decompress(one(1)) + b"more"), "longer"),
    ):
        got = read(bad + good)
        assert why in got[0][8] and got[1][0] == 2 and got[1][8] is None, why
    assert read(good + one(3)[:-9])[1][8] and "ends within" in read(good[:30])[0][8]


def test_archived(spark):
    rows = [(1, "u", "tiny"), (2, "u", "tiny"), (5, "u", LONG), (4, None, LONG), (None, "u", LONG), (6, "u", None), (7, "u", ""), (8, "w", LONG + "x"), (8, "v", LONG + "x"), (8, "v", LONG + "x"), (9, "u", LONG * 400)]
    rows += [(100 + i, "copy", "<html>" + "same " * 50) for i in range(400)]
    df = spark.createDataFrame(rows, PAGES).withColumns({"error": F.lit("x"), "at": F.lit(1), "payload": F.lit("y"), "record_type": F.lit(2)})

    def key(r):
        return r[0] is None, r[0] or 0, r[1] is None, r[1] or ""

    groups = {}
    for r in sorted(rows, key=key):
        groups.setdefault(r[2] or "", []).append(r[0])
    want = []
    for html, ids in groups.items():
        raw = html.encode()
        for n, i in enumerate(ids):
            again = n > 0 and len(raw) >= 100
            want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    got = [tuple(r) for r in warc.archived(df.repartition(5)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.archived(df.limit(0)).collect() == []


def test_payloads_come_back_and_broken_archives_fail(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    df = spark.createDataFrame([(1, "u", LONG), (2, "u", "é"), (3, "u", LONG)], PAGES)
    warc.write_archives(df, path)
    got = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path, payload=True).collect()}
    assert got == {1: LONG.encode(), 2: "é".encode(), 3: None}
    for f in (tmp_path / "pages").glob("*.gz"):
        f.write_bytes(f.read_bytes()[:-12])
    assert warc.read_archives(spark, path).filter("error is not null").count() > 0


def test_archives_of_lost_tasks_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    warc.write_archives(spark.createDataFrame([(1, "u", LONG)], PAGES), path)
    (tmp_path / "pages" / "pages-lost.warc.gz").write_bytes(one(77))
    assert [r["page_id"] for r in warc.read_archives(spark, path).collect()] == [1]


def test_uri_without_id():
    assert warc._page(warc._uri(None)) is None and warc._page(warc._uri(-4)) == -4
    with pytest.raises(ValueError):
        next(warc._Member(io.BytesIO(b""), b"").exactly(1))
