import hashlib
import io

import duckdb
import pytest

from codetrail.llm import warc as m


def _stream(b):
    return io.BufferedReader(io.BytesIO(b))


def test_headers_of_both_versions_and_declared_lengths():
    one = (m.version_block(1) + b"http://a/ 1.2.3.4 20010203040506 text/html; charset=x 5\nab\nc\n\n"
           b"dns:a 1.2.3.4 20010203 text/dns 3\nxyz\n")
    got = list(m.arc_records(_stream(one)))
    assert [(r["uri"], r["date"], r["kind"], r["block"]) for r in got[1:]] == [
        ("http://a/", "20010203040506", "text/html; charset=x", b"ab\nc\n"), ("dns:a", "20010203", "text/dns", b"xyz")]
    two = m.version_block(2) + b"http://a b/ 0.0.0.0 2001 text/html 200 chk - 7 f.arc 4\nHTTP\nhttp://c/ 0.0.0.0 2002 t 404 - / 9 f.arc 0\n"
    got = list(m.arc_records(_stream(two)))
    assert [(r["uri"], r["date"], r["kind"], r["block"]) for r in got[1:]] == [
        ("http://a b/", "2001", "text/html", b"HTTP"), ("http://c/", "2002", "t", b"")]


def test_damaged_and_truncated_files_lose_nothing():
    raw = m.version_block(1) + b"rubbish\nmore rubbish\nhttp://a/ 0.0.0.0 20010203040506 text/html 3\nabc\nhttp://b/ 0.0.0.0 2001 t 99\nshort"
    got = list(m.arc_records(_stream(raw)))
    assert [(r["uri"], r["block"]) for r in got[1:]] == [(None, b"rubbish\nmore rubbish\n"), ("http://a/", b"abc"), ("http://b/", b"short")]
    assert list(m.arc_records(_stream(b""))) == []
    assert [r["uri"] for r in m.arc_records(_stream(b"\n\nonly rubbish"))] == [None]


def test_dates():
    assert m.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert m.warc_date("200102") == "2001-02-01T00:00:00Z"
    assert m.warc_date("20019999") == m.warc_date(None) == "1970-01-01T00:00:00Z"


def test_members_end_with_the_byte_that_the_writer_adds(monkeypatch):
    for size in (0, 1, 5000):
        assert m.opened(m.members(b"x" * size) + b"\0").read() == b"x" * size
    monkeypatch.setattr(m, "MEMBER_BYTES", 1000)
    assert m.opened(m.members(bytes(range(256)) * 20) + b"\0").read() == bytes(range(256)) * 20


def test_records_of_other_kinds(spark):
    raw = (m.version_block(1) + b"ftp://f 0.0.0.0 2001 text/plain 4\nfile\njunk\nhttp://a/ 9.9.9.9 20010203040506 text/html 19\n"
           b"HTTP/1.0 200 OK\r\n\r\n")
    archive = spark.createDataFrame([("x/part-0", bytearray(raw))], "path string, content binary")
    out = b"".join(bytes(r["value"]) + b"\0" for r in m.convert(archive).collect())
    got = list(m.warc_records(m.opened(out)))
    assert sorted(f["warc-type"] for f, _ in got) == ["metadata", "resource", "response", "warcinfo", "warcinfo"]
    by = {f["warc-type"]: (f, b) for f, b in got}
    assert by["resource"][1] == b"file" and by["metadata"][1] == b"junk\n"
    assert by["response"][0]["warc-ip-address"] == "9.9.9.9" and by["response"][0]["warc-target-uri"] == "http://a/"
    assert by["response"][0]["warc-block-digest"] == "sha256:" + hashlib.sha256(by["response"][1]).hexdigest()
    assert len({f["warc-record-id"] for f, _ in got}) == 5


ODD = [(1, "http://a/", "x" * 100), (2, None, "x" * 100), (3, "u r l\n", "y" * 99), (4, "http://a/", "y" * 99), (5, "", None), (6, "z", ""),
       (7, "http://é/", "é" * 50), (8, "q", "é" * 50), (9, "r", "WARC/1.1\r\n\r\nHTTP/1.1\r\n\r\n" * 9), (10, "r", "z" * 300_000),
       (11, "s", "z" * 300_000), (0, "t", "x" * 100), (12, "filedesc://x", "k" * 150), (13, "http://a/", "k" * 150),
       (14, "filedesc://", "1 0 k"), (15, "filedesc:y", None)]


@pytest.mark.parametrize(("records", "rows"), [(3, 0), (3, 100), (2000, 100)])
def test_pages_round_trip_matches_sql(spark, records, rows, monkeypatch):
    monkeypatch.setattr(m, "FILE_RECORDS", records)
    monkeypatch.setattr(m, "BROADCAST_ROWS", rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", ODD)
    pages = spark.createDataFrame([(*r, "x", 1) for r in ODD], "page_id long, url string, html string, digest string, path int")
    got = sorted(tuple(r) for r in m.archived(pages).collect())
    assert got == sorted(con.execute(m.ORACLE_SQL).fetchall())


def test_repeated_rows_null_ids_and_empty_tables(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "u", "x" * 200), (1, "u", "x" * 200), (None, "u", "x" * 200), (None, "v", "y" * 200)]
    got = sorted((tuple(r)[0], tuple(r)[3], tuple(r)[4]) for r in m.archived(spark.createDataFrame(rows, schema)).collect()
                 if r["page_id"] is not None)
    assert got == [(1, "response", None), (1, "revisit", 1)]
    null = sorted((r["record_type"], r["refers_to"] or 0) for r in m.archived(spark.createDataFrame(rows, schema)).collect()
                  if r["page_id"] is None)
    assert null == [("response", 0), ("revisit", 1)]
    assert m.archived(spark.createDataFrame([], schema)).collect() == []


def test_given_pages_match_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    got = sorted(tuple(r) for r in m.archived(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect())
    assert got == sorted(con.execute(m.ORACLE_SQL).fetchall())


def test_columns_with_clashing_names_have_no_say(spark):
    rows = [(1, "http://a/", "x" * 120), (2, "http://b/", "x" * 120), (3, None, None), (4, "u", "é")]
    schema = "page_id long, url string, html string"
    more = "file string, offset long, value string, record string, content string, payload_digest string, record_type string"
    plain = spark.createDataFrame(rows, schema)
    clashing = spark.createDataFrame([(*r, "q", 7, "q", "q", "q", "q", "q") for r in rows], f"{schema}, {more}")
    a, b = (m.archived(df) for df in (plain, clashing))
    assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and b.count() == len(rows)
