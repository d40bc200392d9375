import base64
import gzip
import hashlib
import random

import duckdb
import pytest

from askloom.llm import queries
from askloom.llm.oracles import ORACLE_SQL
from askloom.llm.warc import Assembler, assemble, base32_sha1, read_archives, resolve, write_archives

SCHEMA = "page_id long, url string, html string"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def plain(rows, least=0):
    first, out = {}, []
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least:
            first[raw] = min(first.get(raw, page), page)
    for page, _, html in rows:
        raw = (html or "").encode()
        again = first.get(raw, page) != page
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def trip(spark, df, path, least=0):
    write_archives(df, str(path), least)
    return assemble(read_archives(spark, str(path)))


PAYLOADS = [
    None, "", "x", "x", "WARC/1.", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "a\r\n\r\nWARC/1.0\r\n\r\n", "WARWARC/1.WAR", "é漢\U0001f600\x00",
    "\r\n\r\n", "tail WARC/1.", "<p>" * 20_000, "WARC/1." * 300,
]


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip_of_odd_payloads(spark, tmp_path, least):
    rows = [(i, f"http://a/WARC/1.{i}" if i % 3 else None, x) for i, x in enumerate(PAYLOADS * 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n_request int").repartition(3)
    made = trip(spark, df, tmp_path / "w", least)
    assert rows_of(resolve(made)) == plain(rows, least)
    have = {r.metadata.fields["page_id"]: r for r in made.collect()}
    for page, url, html in rows:
        r = have[str(page)]
        assert r.n_request == r.n_metadata == 1 and not r.response.truncated
        assert r.request.http_head.startswith("GET ") and r.response.target_uri == url
        digest = base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
        assert r.response.declared_digest == f"sha1:{digest}"
        assert bytes(r.response.payload) == (b"" if r.response.type == "revisit" else (html or "").encode())


def test_ties_nulls_line_ends_and_empty_tables(spark, tmp_path):
    rows = [(None, None, "same"), (4, "u", "same"), (4, "u", "same"), (4, "v", "other"), (9, "http://b/\r\nX: y", "other"), (9, "w", None)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    made = trip(spark, df, tmp_path / "a")
    got = rows_of(resolve(made))
    assert len(got) == 6
    assert sorted((r[0], r[3], r[4]) for r in got if r[0] == 9) == [(9, "response", None), (9, "revisit", 4)]
    # nulls come first, so the row without an id is the response
    assert [(r[3], r[4]) for r in got if r[0] is None] == [("response", None)]
    assert sorted(r[3] for r in got if r[0] == 4) == ["response", "revisit", "revisit"]
    assert {r.response.target_uri for r in made.collect()} == {None, "u", "v", "w", "http://b/%0D%0AX: y"}
    assert trip(spark, spark.createDataFrame([], SCHEMA), tmp_path / "b").collect() == []


def record(kind, name, block, concurrent=(), more=""):
    to = "".join(f"warc-concurrent-to: <{x}>\r\n" for x in concurrent)
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{to}{more}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n".encode()


def test_archives_of_others(spark, tmp_path):
    http = "Content-Type: application/http;\r\n msgtype=response\r\n"
    records = [
        record("warcinfo", "i", "software: x"),
        record("response", "r1", "HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", ["q1"], http),  # the response names the request
        record("request", "q1", "GET /"),
        record("metadata", "m1", "k: v", ["q1"], "Content-Type: application/warc-fields\r\n"),  # by the request
        record("resource", "r2", "plain"),
        record("request", "q9", "GET /lost", ["nowhere"]),
        *[record("metadata", f"n{i}", f"k: {i}", ["r2"], "Content-Type: application/warc-fields\r\n") for i in range(50)],
    ]
    (tmp_path / "a").mkdir()
    # a member of gzip for each record, and two archives
    (tmp_path / "a" / "1.warc.gz").write_bytes(b"".join(map(gzip.compress, records[:4])))
    (tmp_path / "a" / "2.warc.gz").write_bytes(b"".join(map(gzip.compress, records[4:])) + gzip.compress(record("response", "cut", "x" * 50)[:-30]))
    got = assemble(read_archives(spark, str(tmp_path / "a"))).collect()
    by = {r.response.record_id: r for r in got if r.response}
    assert set(by) == {"<r1>", "<r2>", "<cut>"}
    assert bytes(by["<r1>"].response.payload) == b"body" and by["<r1>"].response.http_head == "HTTP/1.1 200 OK\r\nA: b"
    assert by["<r1>"].request.record_id == "<q1>" and by["<r1>"].metadata.fields == {"k": "v"}
    assert by["<r2>"].n_metadata == 50 and by["<r2>"].metadata.record_id == "<n0>" and by["<r2>"].request is None
    assert by["<cut>"].response.truncated and not by["<r1>"].response.truncated
    assert sorted((r.request or r.metadata).record_id for r in got if not r.response) == ["<i>", "<q9>"]


def test_cuts_at_every_place():
    payload = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nWARC/1."
    whole = b"".join(b"WARC/1.1\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(payload), payload) for i in range(5))
    at = Assembler()
    rows = [r for f in ("a", "b") for cut in whole.split(b"WARC/1.") for r in at.add(f, cut)] + list(at.close())
    assert [r[0] for r in rows] == [f"<{i}>" for i in range(5)] * 2 and all(r[-2] == payload and not r[-1] for r in rows)


def test_base32(spark):
    texts = ["", "a", "é" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(base32_sha1("t")).collect()
    assert [r[0] for r in got] == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]


def test_query_and_sql_agree(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.sql(ORACLE_SQL["op12_warc_captures"])
    got = queries.op12_warc_captures(spark, sf_dir)
    assert got.columns == want.columns == COLUMNS
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows_of(got) == sorted(want.fetchall(), key=str) == plain(pages)
