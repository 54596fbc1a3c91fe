"""Operator 9: legacy ARC archives converted to WARC.

``read_arc`` parses ARC files: the version block says which version the file has, a record header is one line of that
version's fields, its last field the declared length of what follows.  ``convert`` synthesises an equivalent WARC record
for each: an identifier from the file and offset, an ISO timestamp, the type (``response`` for HTTP messages, ``warcinfo``
for version blocks, ``metadata`` for bytes that aren't a record, else ``resource``), and SHA-256 digests of block and payload.
Records whose payload equals that of an earlier one (by the page id that a header of the message names, else by date and
URI) become ``revisit`` records that refer to it; payloads under ``REVISIT_BYTES`` never do.

Archives are files of gzip members, one a record, written and read by Spark in the shared folder: a member of under
16 MiB ends with a zero byte, so the text writer gets the member without it and the line separator ``\\0`` puts it
back (a larger record is several members).  A file holds at most ``FILE_RECORDS`` records and begins with its version
block or warcinfo record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrail.llm.common import landed, map_arrow, shared_path

REVISIT_BYTES = 100
FILE_RECORDS = 2000
#: Revisits (some 300 bytes each) up to which their list is broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of a gzip member's content: its length then ends with a zero byte.
MEMBER_BYTES = (16 << 20) - 1
LEVEL = 4
#: Bytes of records in an Arrow batch.
BATCH_BYTES = 4 << 20
#: The fields of a record header by version.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_HEADER = {1: re.compile(rb"(\S.*) (\S+) (\d{4,17}) (\S.*) (\d+)"),
           2: re.compile(rb"(\S.*) (\S+) (\d{4,17}) (\S.*?) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)")}
_PAGE = re.compile(rb"(?im)^X-Page-Id:[ \t]*(-?\d+)[ \t]*\r?$")
_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)[ \t]*\r?$")


def members(record: bytes) -> bytes:
    """The record as gzip members, without the last one's last byte (which is zero)."""
    out = []
    for at in range(0, max(len(record), 1), MEMBER_BYTES):
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out.append(squeeze.compress(record[at:at + MEMBER_BYTES]) + squeeze.flush())
    return b"".join(out)[:-1]


def opened(content: bytes) -> io.BufferedReader:
    """An archive's bytes, gzipped or not, as a stream."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else io.BufferedReader(raw)


def write_archive(records: DataFrame, path: str) -> None:
    """``records`` (value binary: members without the last byte) as files of at most FILE_RECORDS records."""
    (records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


# --- ARC -------------------------------------------------------------------------------------------------------------

def arc_header(version: int, uri: str, date: str, kind: str, length: int) -> bytes:
    uri = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri) or "-"
    between = "" if version == 1 else "200 - - 0 pages.arc "
    return f"{uri} 0.0.0.0 {date} {kind} {between}{length}\n".encode()


def version_block(version: int) -> bytes:
    body = f"{version} 0 pages\n{ARC_FIELDS[version]}\n\n".encode()
    return arc_header(version, "filedesc://pages.arc", "20240101000000", "text/plain", len(body)) + body


def pages_to_arc(pages: DataFrame, version: int | None = None) -> DataFrame:
    """value: a member for each row of ``pages`` (page_id, url, html), and a version block in front of each file's.

    A message names its page in the header X-Page-Id (none for a null id).  ``version`` None: partitions take turns.
    """
    def run(batches):
        from pyspark import TaskContext
        own = version or 1 + TaskContext.get().partitionId() % 2

        def rows():
            n = 0
            for batch in batches:
                for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                    if n % FILE_RECORDS == 0:
                        yield members(version_block(own))
                        n += 1
                    page, payload = page.as_py(), (html.as_py() or "").encode()
                    named = "" if page is None else f"X-Page-Id: {page}\r\n"
                    message = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}"
                               f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload
                    yield members(arc_header(own, url.as_py() or "", "20240101000000", "text/html", len(message))
                                  + message + b"\n")
                    n += 1

        yield from _batches(({"value": v} for v in rows()), pa.schema([("value", pa.binary())]), "value")

    return pages.select("page_id", "url", "html").transform(map_arrow, run, "value binary")


def _batches(rows: Iterator[dict], schema: pa.Schema, sized: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized] or b"") + 200
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arc_records(stream: io.BufferedReader) -> Iterator[dict]:
    """Records of an ARC file: offset, uri, ip, date, kind, block.

    Bytes where a header should be but isn't one come as a record without a uri; a block that the file ends in is as
    long as what is there.
    """
    at, version, lost, lost_at = 0, 1, [], 0

    def damaged():
        return {"offset": lost_at, "uri": None, "ip": None, "date": None, "kind": None, "block": b"".join(lost)}

    while line := stream.readline():
        begin, at = at, at + len(line)
        if not lost and not line.strip():
            continue
        found = _HEADER[version].fullmatch(line.rstrip(b"\r\n"))
        if found is None and (found := _HEADER[3 - version].fullmatch(line.rstrip(b"\r\n"))) is not None:
            version = 3 - version
        if found is None:
            if not lost:
                lost_at = begin
            lost.append(line)
            continue
        if lost:
            yield damaged()
            lost = []
        fields = [g.decode("utf-8", "replace") for g in found.groups()]
        block = stream.read(int(fields[-1]))
        at += len(block)
        if fields[0].startswith("filedesc:") and block[:1] in (b"1", b"2"):
            version = int(block[:1])
        yield {"offset": begin, "uri": fields[0], "ip": fields[1], "date": fields[2], "kind": fields[3], "block": block}
    if lost:
        yield damaged()


# --- WARC ------------------------------------------------------------------------------------------------------------

def warc_date(date: str | None) -> str:
    """An ARC date (YYYY up to YYYYMMDDhhmmss) as ISO 8601; what is missing is the earliest, nonsense is 1970."""
    digits = (date or "")[:14]
    full = digits + "00000101000000"[len(digits):]
    ok = re.fullmatch(r"\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])([01]\d|2[0-3])([0-5]\d){2}", full)
    y = full if ok and len(digits) >= 4 else "19700101000000"
    return f"{y[:4]}-{y[4:6]}-{y[6:8]}T{y[8:10]}:{y[10:12]}:{y[12:14]}Z"


def identifier(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}')}>"


def warc_record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": len(block)}.items()
                   if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def warcinfo() -> bytes:
    body = b"software: codetrail\r\nformat: WARC File Format 1.1\r\n"
    return warc_record("warcinfo", {"WARC-Record-ID": identifier("warcinfo", 0), "WARC-Date": "1970-01-01T00:00:00Z",
                                    "Content-Type": "application/warc-fields"}, body)


def split_message(block: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP message (with its empty line) and the payload."""
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])


def _kind(record: dict) -> str:
    if record["uri"] is None:
        return "metadata"
    if record["block"].startswith(b"HTTP/"):  # whatever its address: a page may be called filedesc: too
        return "response"
    return "warcinfo" if record["uri"].startswith("filedesc:") else "resource"


def _described(file: str, record: dict) -> tuple[str, dict, bytes, bytes, int | None]:
    """Type, header fields, head and payload, and page id of the WARC record of an ARC record."""
    kind = _kind(record)
    head, payload = split_message(record["block"]) if kind == "response" else (b"", record["block"])
    page = _PAGE.search(head)
    fields = {
        "WARC-Record-ID": identifier(file, record["offset"]), "WARC-Date": warc_date(record["date"]),
        "WARC-Target-URI": record["uri"] if kind in ("response", "resource") and record["uri"] != "-" else None,
        "WARC-IP-Address": record["ip"] if kind == "response" else None,
        "Content-Type": {"response": "application/http; msgtype=response", "metadata": "application/octet-stream",
                         "warcinfo": "text/plain"}.get(kind, record["kind"]),
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(record['block']).hexdigest()}"}
    return kind, fields, head, payload, int(page[1]) if page else None


def arc_index(archives: DataFrame) -> DataFrame:
    """file, offset, page_id, uri, date, digest (bytes), payload_bytes of the response records of ARC files (path, content)."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("uri", pa.string()),
                        ("date", pa.string()), ("digest", pa.binary()), ("payload_bytes", pa.int64())])

    def run(batches):
        for file, content in _files(batches):
            def rows(file=file, content=content):
                for record in arc_records(opened(content)):
                    kind, fields, _, payload, page = _described(file, record)
                    if kind == "response":
                        yield {"file": file, "offset": record["offset"], "page_id": page, "uri": record["uri"],
                               "date": fields["WARC-Date"], "payload_bytes": len(payload),
                               "digest": bytes.fromhex(fields["WARC-Payload-Digest"].removeprefix("sha256:"))}
            yield from _batches(rows(), schema, "digest")

    return archives.transform(map_arrow, run, "file string, offset long, page_id long, uri string, date string, "
                                              "digest binary, payload_bytes long")


def _files(batches) -> Iterator[tuple[str, bytes]]:
    """Name (without the folder) and content of each file."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            yield path.as_py().rpartition("/")[2], content.as_py()


def revisits(index: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """file, offset and the original (file, offset, uri, date, page id) of the records whose payload an earlier record has."""
    who = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "date", "uri", "file", "offset")
    long = index.where(F.col("payload_bytes") >= least)
    firsts = long.groupBy("digest").agg(F.min(who).alias("original"), F.count("*").alias("n")).where("n > 1")
    again = (F.col("file") != F.col("original.file")) | (F.col("offset") != F.col("original.offset"))
    return long.select("file", "offset", "digest").join(firsts, "digest").where(again).select("file", "offset", "original")


def convert(archives: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """value: WARC records (members without the last byte) of ARC files (path, content), a warcinfo in front of each
    file's.  Digests decide about revisits; the list of those is sent to the records if it has at most BROADCAST_ROWS
    rows (counted first), else the records move once, compressed."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record", pa.binary())])

    def built(batches):
        for file, content in _files(batches):
            def rows(file=file, content=content):
                for record in arc_records(opened(content)):
                    kind, fields, _, _, _ = _described(file, record)
                    yield {"file": file, "offset": record["offset"],
                           "record": members(warc_record(kind, fields, record["block"]))}
            yield from _batches(rows(), schema, "record")

    def final(batches):
        def rows():
            n = 0
            for batch in batches:
                for r in batch.to_pylist():
                    if n % FILE_RECORDS == 0:
                        yield {"value": members(warcinfo())}
                        n += 1
                    n += 1
                    original = r["original"]
                    if original is None:
                        yield {"value": r["record"]}
                        continue
                    fields, block = next(warc_records(opened(r["record"] + b"\0")))
                    head = split_message(block)[0]
                    yield {"value": members(warc_record("revisit", {
                        "WARC-Record-ID": fields["warc-record-id"], "WARC-Date": fields["warc-date"],
                        "WARC-Target-URI": fields.get("warc-target-uri"),
                        "Content-Type": "application/http; msgtype=response",
                        "WARC-Payload-Digest": fields["warc-payload-digest"],
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        "WARC-Refers-To": identifier(original["file"], original["offset"]),
                        "WARC-Refers-To-Target-URI": None if original["uri"] == "-" else original["uri"],
                        "WARC-Refers-To-Date": original["date"],
                        "X-Refers-To-Page-Id": None if original["page_id"] is None else str(original["page_id"])}, head))}

        yield from _batches(rows(), pa.schema([("value", pa.binary())]), "value")

    records = archives.transform(map_arrow, built, "file string, offset long, record binary")
    again = landed(revisits(arc_index(archives), least), "revisits")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    return records.join(again, ["file", "offset"], "left").transform(map_arrow, final, "value binary")


def warc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC file."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def read_warc(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the response and revisit records of WARC files
    (path, content).  A response's are taken from its payload, a revisit's from its header and its message's head."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for _, content in _files(batches):
            def rows(content=content):
                for fields, block in warc_records(opened(content)):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_message(block)
                    page, length = _PAGE.search(head), _LENGTH.search(head)
                    refers = fields.get("x-refers-to-page-id")
                    yield {"page_id": int(page[1]) if page else None,
                           "payload_bytes": len(payload) if kind == "response" else int(length[1]) if length else None,
                           "payload_digest": hashlib.sha256(payload).hexdigest() if kind == "response"
                           else fields.get("warc-payload-digest", "").removeprefix("sha256:"),
                           "record_type": kind, "refers_to": int(refers) if refers else None}
            yield from _batches(rows(), schema, "payload_digest")

    return archives.transform(map_arrow, run, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                    "refers_to long")


def archived(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) written as ARC archives, converted to WARC archives and read back: one row per row.

    Null and empty html is an empty payload and always a response; of equal payloads of at least ``least`` bytes the
    smallest page_id (a null one last) is the response, the others, repeated rows too, are revisits.  An empty table gives
    no rows; other columns aren't read.
    """
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_archive(pages_to_arc(pages), arc)
    write_archive(convert(read_archives(spark, arc), least), warc)
    return read_warc(read_archives(spark, warc))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
