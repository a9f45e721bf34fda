import base64
import gzip
import hashlib
import os

import pytest

from askloom.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, payload int, refers_to string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], SCHEMA)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        size = len((h or "").encode())
        again = size >= min_bytes and i != first.get(h or "", i)
        out.append((i, size, digest(h), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/ x\ny", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, None), (8, "u", ""), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3"),
    (4, "u", "x" * 3_000_000), (6, "v", "x" * 3_000_000), (2, "w", "\r\n\r\n"), (-1, "neg", "one"), (1, "neg", "one"),
]


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_round_trip(spark, tmp_path, min_bytes):
    got = warc.round_trip(table(spark, ROWS).repartition(3), str(tmp_path / "w"), min_bytes=min_bytes)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, min_bytes)


def test_empty_table_and_repeated_rows(spark, tmp_path):
    assert warc.round_trip(table(spark, []), str(tmp_path / "none")).count() == 0
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (None, "u", "b")]
    got = sorted((str(r.page_id), r.record_type) for r in warc.round_trip(table(spark, rows), str(tmp_path / "w")).collect())
    assert got == [("1", "response"), ("1", "response"), ("2", "revisit"), ("None", "response")]


def archive(spark, path, **options):
    warc.write_archives(warc.page_records(table(spark, ROWS)).coalesce(1), path, **options)
    return path


def test_payloads_headers_and_files(spark, tmp_path):
    path = archive(spark, str(tmp_path / "w"), max_file_bytes="2000")
    got = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
    for i, url, html in ROWS:
        r = got[f"urn:askloom:page:{i}"]
        assert r.content_type == "application/http;msgtype=response" and r.http_status == 200
        assert r.target_uri == (warc.quoted(url) if url else None)
        assert r.payload_length == len((html or "").encode())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == (html or "").encode()
    files = [f for f in os.listdir(path) if f.endswith(".gz")]
    assert len(files) > 1
    # any gzip reader can read the members
    assert b"".join(gzip.open(f"{path}/{f}").read() for f in files).count(b"WARC/1.1\r\nWARC-Type") == len(ROWS)


def test_filters_are_pushed_and_skip_payloads(spark, tmp_path, monkeypatch):
    path = archive(spark, str(tmp_path / "w"))
    df = warc.read_archives(spark, path).where("record_type = 'revisit' AND record_id LIKE 'urn:askloom:page:%' AND content_length > 10")
    assert {r.record_id for r in df.select("record_id").collect()} == {f"urn:askloom:page:{i}" for i in (5, 6, 1, 9)}
    # the reader itself: a rejected record is neither inflated nor decoded
    sizes = []
    real = warc.Block.upto
    monkeypatch.setattr(warc.Block, "upto", lambda self, n: sizes.append(n) or real(self, n))
    [(name, _)] = warc.archives(path)
    few = list(warc.records(name, lambda row: row["record_type"] == "revisit", True, True, False))
    assert len(few) == 4 and not sizes
    full = list(warc.records(name, lambda row: True, False, False, False))
    assert len(full) == len(ROWS) and not sizes and "payload" not in full[0]


def test_foreign_archives(spark, tmp_path):
    """Plain files, and gzip members without the length field."""
    def record(kind, body):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\nContent-Type: text/plain\r\n"
                f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    parts = [record("warcinfo", b"made by hand"), record("resource", b"\r\n\r\nabc" * 9000), record("metadata", b"")]
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(parts))
    (folder / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = warc.read_archives(spark, str(folder)).collect()
    assert sorted((r.record_type, len(r.payload)) for r in got) == sorted([("warcinfo", 12), ("resource", 63000), ("metadata", 0)] * 2)
    only = warc.read_archives(spark, str(folder), ["record_type"]).where("record_type = 'metadata'")
    assert only.count() == 2


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    path = archive(spark, str(tmp_path / "w"))
    [(name, _)] = warc.archives(path)
    data = warc.record_bytes({"record_id": "a", "record_type": "response", "payload": b"good"}, "d")
    with open(name, "wb") as f:
        f.write(warc.member(data.replace(b"good", b"evil")))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(name, lambda row: True, True, True, True))


def crawled(head, payload, length=None):
    block = head + payload
    return (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Type: application/http; msgtype=response\r\n"
            b"Content-Length: %s\r\n\r\n" % (len(block), length or str(len(block)).encode())) + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_http_heads_of_any_line_ends(spark, tmp_path, packed):
    """Bare line feeds, payloads that hold the other empty line, and blocks without a head."""
    cases = [
        (b"HTTP/1.1 200 OK\nContent-Length: 3\n\n", b"abc", 200), (b"HTTP/1.1 404 No\n\n", b"a\r\n\r\nb", 404),
        (b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n", b"x\n\ny", 200), (b"", b"no head at all", None), (b"HTTP/1.0 200 OK\n\r\n\r\n", b"mixed", 200),
    ]
    folder = tmp_path / "f"
    folder.mkdir()
    parts = [crawled(head, payload) for head, payload, _ in cases]
    if packed:
        (folder / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    else:
        (folder / "a.warc").write_bytes(b"".join(parts))
    rows = warc.read_archives(spark, str(folder)).orderBy("offset").collect()
    assert [(bytes(r.payload), r.http_status) for r in rows] == [(p, s) for _, p, s in cases]
    assert [r.payload_length for r in rows] == [len(p) for _, p, _ in cases]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("length", [b"many", b"-5", b"1e3"])
def test_a_length_that_is_no_number(spark, tmp_path, packed, length):
    """The record has no payload and no length, the ones after it are read."""
    folder = tmp_path / "f"
    folder.mkdir()
    head = b"HTTP/1.1 200 OK\r\n\r\n"
    parts = [crawled(head, b"one"), crawled(head, b"damaged", length), crawled(head, b"three!")]
    if packed:
        (folder / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    else:
        (folder / "a.warc").write_bytes(b"".join(parts))
    rows = warc.read_archives(spark, str(folder)).orderBy("offset").collect()
    assert [r.payload and bytes(r.payload) for r in rows] == [b"one", None, b"three!"]
    assert [r.content_length is None for r in rows] == [False, True, False]
    assert warc.read_archives(spark, str(folder)).where("content_length > 0").count() == 2
