"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A response (record id, target URI, date, HTTP header, payload) gives two records: `metadata` (application/warc-fields, about the response) and
`conversion` (its text). Both name the response in WARC-Refers-To, keep its target URI, date and payload digest, and carry
their own block digest; the response's HTTP header fields are kept under `source-` names in the metadata block and as X-Source- fields of the conversion.
Record ids are made from the response's id, so a rerun after a lost executor writes the same records.

A payload is bytes, and so is what its digest is taken of: the response's own WARC-Payload-Digest where it has one, else the digest of the bytes as they
are stored. Only for the text are a chunked transfer and a gzip or deflate encoding undone and the charset applied that the header or else a meta element
declares, else UTF-8; what doesn't fit a charset is replaced, and an encoding that breaks off or isn't known leaves what could be decoded.

Records are rows until they are written; `write` makes one WARC file a partition, `read` splits files into records again, and `from_records`
takes the responses among them, so that crawled files can be the input.

Defined results: a response without a record id gives records without WARC-Refers-To, whose ids are made from its URI, date and payload; a null payload is empty and gives an empty conversion; null URIs are left out of headers; line breaks in header values become blanks. Repeated
responses give repeated records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_blocks import plain_text

DERIVED = "source_id string, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_payload_digest string, block string, content_length long, block_digest string, record string"
RESPONSES = ["record_id", "target_uri", "date", "http_header", "payload", "payload_digest"]
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "warc-derivatives")
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_META = re.compile(r"<meta\b[^>]*\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value) -> str:
    return " ".join(str(value).split())


def _anonymous(source: dict) -> str:
    """What stands for the id of a response that has none, so that its two records still differ from others'."""
    return "\n".join(["", *[str(source[k] or "") for k in ("target_uri", "date")], source["payload"].decode(errors="replace")])


def _record(kind: str, source: dict, content_type: str, block: bytes, extra: list[tuple[str, str]]) -> tuple:
    record_id = f"<urn:uuid:{uuid.uuid5(_NAMES, kind + (source['record_id'] or _anonymous(source)))}>"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id),
        ("WARC-Refers-To", source["record_id"]),
        ("WARC-Target-URI", source["target_uri"]),
        ("WARC-Date", source["date"]),
        ("WARC-Block-Digest", digest(block)),
        *extra,
        ("X-Source-Payload-Digest", source["payload_digest"]),
        ("Content-Type", content_type),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in fields if v is not None)
    return kind, record_id, source["record_id"], source["target_uri"], source["date"], content_type, source["payload_digest"], block.decode(), len(block), digest(block), head + "\r\n" + block.decode()


def _unchunked(data: bytes) -> bytes:
    """The chunks of a chunked transfer, as far as they go; data that isn't chunked after all stays."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(out) if out else data
        if not size:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out) if out or at == 0 and end >= 0 else data


def _inflated(data: bytes, encoding: str) -> bytes:
    """Data of an encoding undone as far as it goes."""
    if encoding not in ("gzip", "x-gzip", "deflate"):
        return data
    for bits in (47, -15):  # with a header of either kind, and without
        out, undo = [], zlib.decompressobj(bits)
        try:
            for lo in range(0, len(data), 1 << 16):
                out.append(undo.decompress(data[lo : lo + (1 << 16)]))
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return data


def _text(payload: bytes, headers: dict[str, str]) -> str:
    """The payload as text, by what its HTTP header or its meta element says."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    for encoding in reversed([e.strip().lower() for e in headers.get("content-encoding", "").split(",") if e.strip()]):
        payload = _inflated(payload, encoding)
    named = _CHARSET.search(headers.get("content-type", "")) or _META.search(payload[:2048].decode("latin-1"))
    for charset in ([named[1]] if named else []) + ["utf-8"]:
        try:
            return payload.decode(charset, errors="replace")
        except (LookupError, ValueError):  # no charset of Python's, or one that isn't text
            continue
    return ""


def derive_one(source: dict) -> list[tuple]:
    """The metadata and the conversion record of a response."""
    payload = source["payload"] or b""
    payload = payload.encode() if isinstance(payload, str) else bytes(payload)
    source = source | {"payload": payload, "payload_digest": source.get("payload_digest") or digest(payload)}
    status, *lines = (source["http_header"] or "").split("\r\n")
    headers = [(h.partition(":")[0].strip(), h.partition(":")[2].strip()) for h in lines if ":" in h]
    html = _text(payload, {k.lower(): v for k, v in headers})
    text = plain_text(html)
    title, lang = _TITLE.search(html), _LANG.search(html)
    facts = [("source-status", status), *[("source-" + k.lower(), v) for k, v in headers]]
    facts += [("source-payload-digest", source["payload_digest"]), ("title", title[1] if title else ""), ("languages-declared", lang[1].lower() if lang else ""), ("outlinks", len(_LINK.findall(html))), ("payload-length", len(payload)), ("text-length", len(text.encode(errors="replace")))]
    block = "".join(f"{k}: {_line(v)}\r\n" for k, v in facts)
    kept = [("X-Source-Status", status or None), *[("X-Source-" + _line(k).title(), v) for k, v in headers]]
    return [_record("metadata", source, "application/warc-fields", block.encode(errors="replace"), []), _record("conversion", source, "text/plain; charset=utf-8", text.encode(errors="replace"), kept)]


def _derive(batches):
    names = [c.split()[0] for c in DERIVED.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in DERIVED.split(", ")]
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            rows = [(s["source_id"], *r) for s in b.slice(lo, 256).to_pylist() for r in derive_one(s)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as responses, with a header like that of a server that sends them as UTF-8: source_id and the columns in RESPONSES."""
    h = F.md5(F.concat_ws("|", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length(html_col), F.lit(0)).cast("string"))
    return pages.select(F.col(id_col).cast("string").alias("source_id"), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), header.alias("http_header"), F.col(html_col).alias("payload"), F.lit(None).cast("string").alias("payload_digest"))


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response, whose payload is text or bytes."""
    return source.select("source_id", *[F.col(c) if c in source.columns else F.lit(None).cast("string").alias(c) for c in RESPONSES]).mapInArrow(_derive, DERIVED)


def write(records: DataFrame, path: str) -> None:
    """WARC files: the two line breaks between records are the text writer's separator."""
    records.select(F.col("record").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


RECORDS = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, headers map<string,string>, block string, raw binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """warc_type, record_id, refers_to, target_uri, block_digest and block of every record under path."""
    return read_records(spark, path).select("warc_type", "record_id", "refers_to", "target_uri", "block_digest", "block")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files under path, gzip (.gz, one member or many) or plain (.warc), told apart by Content-Length: its named fields, all of its fields
    (headers, names in lower case), its block as text (what isn't UTF-8 is replaced) and as bytes.

    Lines of a gzip file come in its order, for it is never split; a task holds the record at hand only. A plain file would be split, so
    it comes whole, and must be smaller than the 2 GB that Spark holds in a value. A record that is cut off or that doesn't end where its length
    says is an error.
    """
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).text(path)
    packed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")).mapInArrow(_parse, RECORDS)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").option("recursiveFileLookup", True).load(path)
    return packed.unionByName(whole.select(F.col("path").alias("file"), "content").mapInArrow(_plain, RECORDS))


def _plain(batches):
    """_parse for whole files."""

    def lines(file: str, content: bytes):
        at = 0
        while at < len(content):
            out, size = [], 0
            while at < len(content) and size < 1 << 20:
                end = content.find(b"\n", at)
                end = len(content) if end < 0 else end
                out.append(content[at:end])
                size, at = size + end - at, end + 1
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(out)), pa.array(out, pa.binary())], names=["file", "line"])

    for b in batches:
        for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield from _parse(lines(file, content))


def _parse(batches):
    named = [c.split()[0] for c in RECORDS.split(", ")][:7]
    kinds = [*[pa.string()] * 7, pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
    names = [*named, "headers", "block", "raw"]
    file, head, block, need, done, size = None, [], [], None, [], 0

    def full():
        h = dict(head)
        raw = b"".join(block)
        done.append((*[h.get(_FIELDS.get(k, f"warc-{k}".replace("_", "-"))) for k in named], list(h.items()), raw.decode(errors="replace"), raw))

    def table():
        out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        done.clear()
        return out

    def closed():
        if need is not None or head:
            raise ValueError(f"{file}: the last record is cut off")

    for b in batches:
        for at, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if at != file:
                closed()
                file = at
            if need is not None:  # within a block; its last line may run on into the break between records
                line += b"\n"
                block.append(line[:need])
                line, need = line[need:], need - len(block[-1])
                if need:
                    continue
                full()
                size += len(done[-1][-1])
                head, block, need = [], [], None
                if line.strip(b"\r\n"):
                    raise ValueError(f"{file}: a record doesn't end where its Content-Length says")
                if size > 1 << 24:
                    yield table()
                    size = 0
                continue
            line = line.rstrip(b"\r")
            if line and not head:
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{file}: no record begins with {line[:40]!r}")
                head.append(("", line.decode(errors="replace")))
            elif line:
                name, _, value = line.decode(errors="replace").partition(":")
                head.append((name.strip().lower(), value.strip()))
            elif head:
                head = head[1:]
                need = int(dict(head)["content-length"])
                if not need:
                    full()
                    head, need = [], None
    closed()
    if done:
        yield table()


#: Fields whose names aren't made from the columns'.
_FIELDS = {"warc_type": "warc-type", "content_type": "content-type"}


def _response(batches):
    """The HTTP header and the payload, parted at the first empty line of the bytes."""
    for b in batches:
        headers, payloads = [], []
        for raw in b.column("raw").to_pylist():
            head, _, payload = (raw or b"").partition(b"\r\n\r\n")
            headers.append(head.decode("latin-1"))
            payloads.append(payload)
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("source_id", "record_id", "target_uri", "date")], pa.array(headers, pa.string()), pa.array(payloads, pa.binary()), b.column("payload_digest")], names=["source_id", *RESPONSES])


def from_records(records: DataFrame) -> DataFrame:
    """The response records of `read_records` as what `derive` takes, with the digest that they carry."""
    r = records.where("warc_type = 'response'").select(F.col("record_id").alias("source_id"), "record_id", "target_uri", "date", "raw", F.element_at("headers", F.lit("warc-payload-digest")).alias("payload_digest"))
    return r.mapInArrow(_response, "source_id string, record_id string, target_uri string, date string, http_header string, payload binary, payload_digest string")
