import base64
import gzip
import hashlib
import io

import pytest

from sensorspark.llm import warc


def record(kind, name, block, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Target-URI": "http://a.com/" + name, "WARC-Date": "2024-05-06T07:08:09Z", "Content-Length": len(block), **fields}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data):
    """A plain reader: header lines to an empty line, then as many bytes as Content-Length says."""
    out, f = [], io.BytesIO(data)
    while line := f.readline():
        if not line.strip():
            continue
        head = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        out.append((head["warc-type"], head["warc-record-id"], f.read(int(head["content-length"]))))
    return out


BLOCKS = [b"", b"plain", b"a\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\nb", b"ends in breaks\n\r\n\r\n\n", b"\xff\xfe\x00 bytes \r alone", b"x" * 300_000 + b"\n" + b"y" * 300_000, "é".encode() * 9]


@pytest.mark.parametrize("members", [True, False])
def test_records_by_content_length(spark, tmp_path, members):
    files = {f"{n}.warc.gz": [record("response" if i % 2 else "warcinfo", f"{n}-{i}", b) for i, b in enumerate(BLOCKS * 3)] for n in "abc"}
    for n, r in files.items():
        (tmp_path / n).write_bytes(b"".join(gzip.compress(x) for x in r) if members else gzip.compress(b"".join(r)))
    (tmp_path / "empty.warc.gz").write_bytes(gzip.compress(b""))
    got = warc.read_records(spark, f"file://{tmp_path}").collect()
    want = [x for r in files.values() for x in parsed(b"".join(r))]
    assert sorted((r.warc_type, r.record_id, bytes(r.raw)) for r in got) == sorted(want)
    assert all(r.headers["warc-date"] == r.date == "2024-05-06T07:08:09Z" and r.block == bytes(r.raw).decode(errors="replace") for r in got)


def test_responses_of_files_are_derived(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nServer: x\r\n\r\n"
    rows = [record("request", "q", b"GET / HTTP/1.1\r\n\r\n"), record("response", "<urn:1>", http + b"<title>T</title><p>one</p>\r\n\r\n<p>two</p>"), record("response", "<urn:2>", b"HTTP/1.1 404 Gone\r\n\r\n")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, rows)))
    got = warc.derive(warc.from_records(warc.read_records(spark, f"file://{tmp_path}"))).collect()
    assert sorted((r.refers_to, r.warc_type) for r in got) == [(f"<urn:{i}>", k) for i in (1, 2) for k in ("conversion", "metadata")]
    by = {(r.refers_to, r.warc_type): r for r in got}
    assert "one" in by["<urn:1>", "conversion"].block and "two" in by["<urn:1>", "conversion"].block and by["<urn:2>", "conversion"].block == ""
    assert "source-server: x\r\n" in by["<urn:1>", "metadata"].block and "title: T\r\n" in by["<urn:1>", "metadata"].block and "source-status: HTTP/1.1 404 Gone" in by["<urn:2>", "metadata"].block


@pytest.mark.parametrize("damage", [lambda x: x[:-20], lambda x: x.replace(b"Content-Length: 5", b"Content-Length: 3"), lambda x: b"noise\r\n" + x])
def test_damaged_files_are_errors(spark, tmp_path, damage):
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(damage(record("warcinfo", "a", b"plain" * 1) + record("warcinfo", "b", b"y" * 50))))
    with pytest.raises(Exception, match="cut off|Content-Length says|no record begins"):
        warc.read_records(spark, f"file://{tmp_path}").collect()


def test_payloads_are_bytes(spark, tmp_path):
    """Another charset, chunked and compressed bodies, a digest of the crawler's; texts and digests by hand."""
    latin = "<p>caf\u00e9</p>".encode("latin-1")
    body = gzip.compress("<p>Gr\u00fc\u00dfe</p>".encode())
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\n\r\n"
    cases = {
        "<urn:latin>": (b"Content-Type: text/html; charset=ISO-8859-1", latin, "caf\u00e9", {}),
        "<urn:meta>": (b"Content-Type: text/html", b"<meta charset='windows-1252'><p>\x93q\x94", "\u201cq\u201d", {}),
        "<urn:both>": (b"Content-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked, "Gr\u00fc\u00dfe", {}),
        "<urn:own>": (b"Server: s", b"<p>x", "x", {"WARC-Payload-Digest": "sha1:GIVEN"}),
        "<urn:odd>": (b"Content-Type: text/html; charset=no-such\r\nContent-Encoding: br", b"<p>\xc3\xa9", "\u00e9", {}),
        "<urn:cut>": (b"Content-Encoding: gzip", gzip.compress(b"<p>" + b"word " * 50_000)[:-40], None, {}),
    }
    data = b"".join(record("response", k, b"HTTP/1.1 200 OK\r\n" + h + b"\r\n\r\n" + p, **more) for k, (h, p, _, more) in cases.items())
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    source = warc.from_records(warc.read_records(spark, f"file://{tmp_path}"))
    assert sorted((r.record_id, bytes(r.payload)) for r in source.collect()) == sorted((k, p) for k, (_, p, *_) in cases.items() for _ in "ab")
    rows = warc.derive(source).collect()
    assert len(rows) == 4 * len(cases)
    for r in rows:
        _, payload, text, more = cases[r.refers_to]
        want = more.get("WARC-Payload-Digest") or "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.source_payload_digest == want and f"X-Source-Payload-Digest: {want}\r\n" in r.record
        ((kind, name, block),) = parsed(r.record.encode() + b"\r\n\r\n")  # a reader of its own
        assert (kind, name, block) == (r.warc_type, r.record_id, r.block.encode())
        if kind == "conversion":
            assert r.block == text or text is None and r.block.startswith("word word")
            assert r.refers_to != "<urn:own>" or "X-Source-Server: s\r\nX-Source-Payload-Digest" in r.record


def test_plain_files_are_read(spark, tmp_path):
    rows = [record("response", f"<urn:{i}>", b) for i, b in enumerate(BLOCKS)]
    (tmp_path / "x.warc").write_bytes(b"".join(rows))
    got = sorted((r.record_id, bytes(r.raw)) for r in warc.read_records(spark, f"file://{tmp_path}").collect())
    assert got == sorted((f"<urn:{i}>", b) for i, b in enumerate(BLOCKS))
