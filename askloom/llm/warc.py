"""WARC archives: written from pages, read as streams, assembled into captures.

*Writing.*  A page becomes three records: its request, its response, and a
metadata record with its id; request and metadata name the response in
``WARC-Concurrent-To``.  Of responses with the same payload of at least
``least`` bytes, that with the smallest page_id is written whole and the others
as revisits that name it in ``WARC-Refers-To`` and carry no payload.  Records go
out through Spark's text sink, whose line separator is the blank lines after a
record; each task writes one gzip archive.

*Reading.*  Gzip archives, as crawls have them, are streams: one task reads an
archive from its start.  Spark's text source cuts it at ``WARC/1.``, and a record
is as many of these cuts as its ``Content-Length`` says, so payloads may hold
anything, archives among it.  Memory is that of a record.  The payload's length
and SHA-1 are taken from what was read.

*Transaction assembly.*  A request or metadata record belongs to the response
(or revisit) that it is concurrent to, in either direction, or to that of a
record that it is concurrent to.  These links are slim joins on record ids; the
records of a capture meet as one nested row.  Requests and metadata are reduced to
the first of each capture, and counted, before they are joined, so that a capture
with very many costs a row.  Records that belong to no capture come as rows of
their own, without a response.

Tables of links and of records are written, so that skewed sides of joins can be
split at run time.

*Edge cases.*  Null html is an empty payload, a null url none; a null page_id
stays and counts as the smallest.  Line ends in a url are percent-encoded.  Of rows that repeat a page_id and
a payload the first read is the response; rows have to come in the same order
each time the table is read, as those of files do.  A record that its archive
ends within comes with ``truncated`` set.  Header names are in any case, and a
line that starts with a space goes on with the one before.  An empty table gives
an empty one.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_batches

DATE = "1970-01-01T00:00:00Z"
_MARK = b"WARC/1."
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in an Arrow batch of records, about.
BATCH_BYTES = 1 << 24


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of binary data in upper-case base32: each five hexadecimal digits are four characters."""
    digits, out = F.sha1(data), []
    for i in range(8):
        value = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substr(F.lit(_ALPHABET), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def _record_id(kind: str, page: Column, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string")).cast("binary"))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the blank lines after it; a header whose value is null is left out."""
    lines = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id), *headers]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in lines]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("", *lines), size, block)


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """Write a request, a response or revisit, and a metadata record of every page to gzip archives in ``path``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.translate("url", "\r\n", "\u0001\u0002").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("url", F.replace(F.replace("url", F.lit("\u0001"), F.lit("%0D")), F.lit("\u0002"), F.lit("%0A")))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    shared = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(
        F.min(F.struct("page_id", "row", "url")).alias("lead"), F.count(F.lit(1)).alias("times")
    )
    leads = materialize(shared.where("times > 1").select(F.col("digest").alias("of"), "lead"), "leads")
    # Catalyst broadcasts the leads where their table's size allows it; else they are merged
    joined = rows.join(leads, (F.col("digest") == F.col("of")) & (F.octet_length("html") >= least), "left")
    again = F.col("lead.row").isNotNull() & (F.col("row") != F.col("lead.row"))
    own = {k: _record_id(k, F.col("page_id"), F.col("row")) for k in ("request", "response", "metadata")}
    made = joined.withColumns({"again": again, **{f"{k}_id": v for k, v in own.items()}})
    url, response = ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", F.col("response_id"))
    when = ("WARC-Date", F.lit(date))
    kind = lambda x: ("Content-Type", F.lit(x))
    repeat = lambda x: F.when(F.col("again"), x)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    records = F.array(
        _record("request", F.col("request_id"), [when, url, response, kind("application/http; msgtype=request")],
                F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))),
        _record(
            F.when(F.col("again"), "revisit").otherwise("response"), F.col("response_id"),
            [when, url, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Profile", repeat(F.lit(_REVISIT))),
             ("WARC-Refers-To", repeat(_record_id("response", F.col("lead.page_id"), F.col("lead.row")))),
             ("WARC-Refers-To-Target-URI", repeat(F.col("lead.url"))), kind("application/http; msgtype=response")],
            F.concat(head, F.when(F.col("again"), "").otherwise(F.col("html"))),
        ),
        _record("metadata", F.col("metadata_id"), [when, url, response, kind("application/warc-fields")],
                F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))),
    )
    made.select(F.explode(records).alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


_RECORDS = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string,"
    " content_type string, http_head string, fields map<string,string>, declared_digest string,"
    " payload_bytes long, payload_digest string, payload binary, truncated boolean"
)
_TYPES = [
    pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 5, pa.map_(pa.string(), pa.string()), pa.string(),
    pa.int64(), pa.string(), pa.binary(), pa.bool_(),
]
_NAMES = [re.sub(r"[ ].*", "", c.strip()) for c in re.sub(r"<[^>]*>", "", _RECORDS).split(",")]
_FOLDED = re.compile(r"\r?\n[ \t]+")


def _fields(block: bytes) -> list[tuple[str, str]]:
    """The named fields of a header block, names in lower case."""
    text = _FOLDED.sub(" ", block.decode("utf-8", "replace"))
    pairs = (line.partition(":") for line in re.split(r"\r?\n", text))
    return [(name.strip().lower(), value.strip()) for name, colon, value in pairs if colon]


def _parsed(record: bytes, head: int, end: int) -> tuple:
    """A record as a row; its header ends at ``head``, its block at ``end``."""
    named = _fields(record[:head])
    one = dict(reversed(named))
    block = record[head + 4 : end]
    payload, http, fields = block, None, None
    if one.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        http = http.decode("utf-8", "replace")
    elif one.get("content-type", "").startswith("application/warc-fields"):
        fields = list(dict(reversed(_fields(block))).items())
    return (
        one.get("warc-record-id"), one.get("warc-type"), [v for k, v in named if k == "warc-concurrent-to"],
        one.get("warc-refers-to"), one.get("warc-target-uri"), one.get("warc-date"), one.get("content-type"), http, fields,
        one.get("warc-payload-digest"), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload,
        len(record) < end,
    )


class Assembler:
    """Records out of the cuts of one archive after another."""

    def __init__(self) -> None:
        self.cuts: list[bytes] = []
        self.size, self.need, self.head, self.file = 0, None, 0, None

    def add(self, file: str, cut: bytes) -> Iterator[tuple]:
        if file != self.file:
            yield from self.close()
            self.file = file
            if not cut.strip():
                return  # what lies before an archive's first record
        if self.cuts:
            self.cuts.append(_MARK)
            self.size += len(_MARK)
        self.cuts.append(cut)
        self.size += len(cut)
        if self.need is None and b"\r\n\r\n" in (whole := b"".join(self.cuts)):
            self.cuts, self.head = [whole], whole.index(b"\r\n\r\n")
            length = dict(_fields(whole[: self.head])).get("content-length", "")
            self.need = self.head + 4 + (int(length) if length.isdigit() else 0)
        if self.need is not None and self.size >= self.need:
            yield self._take()

    def close(self) -> Iterator[tuple]:
        if self.cuts and self.size:
            if self.need is None:
                self.head, self.need = self.size, self.size + 5
            yield self._take()

    def _take(self) -> tuple:
        row = _parsed(b"".join(self.cuts), self.head, self.need)
        self.cuts, self.size, self.need = [], 0, None
        return row


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, rows, size = Assembler(), [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    for batch in batches:
        for file, cut in zip(batch.column(0), batch.column(1)):
            for row in at.add(file.as_py(), cut.as_py()):
                rows.append(row)
                size += row[10] + 500
            if size >= BATCH_BYTES:
                yield out()
                rows, size = [], 0
    rows.extend(at.close())
    if rows:
        yield out()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the gzip archives in ``path``, written as a table."""
    text_batches(spark)
    cuts = spark.read.option("lineSep", _MARK.decode()).option("pathGlobFilter", "*.gz").text(path)
    cuts = cuts.select("_metadata.file_path", F.col("value").cast("binary").alias("value"))
    return materialize(cuts.mapInArrow(_read, _RECORDS), "records")


_CAPTURED = "coalesce(type, '') IN ('response', 'revisit', 'resource')"


def _links(records: DataFrame) -> DataFrame:
    """(record, capture) of the other records that belong to a capture, directly or through one record between."""
    pair = records.select(F.col("record_id").alias("x"), F.explode("concurrent_to").alias("y"))
    pair = materialize(pair.union(pair.select("y", "x")).distinct(), "concurrent")
    capture = records.where(_CAPTURED).select(F.col("record_id").alias("capture")).distinct()
    least = lambda df: df.groupBy("x").agg(F.min("capture").alias("capture"))
    direct = pair.join(capture, pair["y"] == capture["capture"]).select("x", "capture")
    direct = materialize(least(direct.join(capture.select(F.col("capture").alias("x")), "x", "left_anti")), "direct")
    through = pair.join(direct.select(F.col("x").alias("y"), "capture"), "y").select("x", "capture")
    through = through.join(direct.select("x"), "x", "left_anti").join(capture.select(F.col("capture").alias("x")), "x", "left_anti")
    return direct.union(least(through)).withColumnRenamed("x", "record")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``response``, ``request``, ``metadata``, and how many of the latter two it has."""
    links = _links(records)
    mine = [c for c in records.columns if c != "concurrent_to"]
    rest = records.where(f"NOT {_CAPTURED}")
    linked = rest.join(links, rest["record_id"] == links["record"], "left")
    nested = lambda c: F.struct(*mine).alias(c)

    def first(kind: str) -> DataFrame:
        of = linked.where((F.col("type") == kind) & F.col("capture").isNotNull())
        return of.groupBy(F.col("capture").alias(f"{kind}_of")).agg(
            F.min_by(F.struct(*mine), "record_id").alias(kind), F.count(F.lit(1)).alias(f"n_{kind}")
        )

    captures = records.where(_CAPTURED).select("record_id", nested("response"))
    for kind in ("request", "metadata"):
        captures = captures.join(first(kind), F.col("record_id") == F.col(f"{kind}_of"), "left")
    count = lambda k: F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}")
    captures = captures.select("response", "request", "metadata", count("request"), count("metadata"))
    alone = linked.where("capture is null").select(nested("r"))
    is_kind = lambda k: F.coalesce(F.col("r.type") == k, F.lit(False))
    alone = alone.select(
        F.when(~is_kind("request") & ~is_kind("metadata") & F.lit(False), F.col("r")).alias("response"),
        F.when(is_kind("request"), F.col("r")).alias("request"),
        F.when(~is_kind("request"), F.col("r")).alias("metadata"),
        is_kind("request").cast("long").alias("n_request"),
        (~is_kind("request")).cast("long").alias("n_metadata"),
    )
    return captures.union(alone)


def resolve(captures: DataFrame) -> DataFrame:
    """page_id, record_type, payload_bytes, payload_digest and refers_to of every page's capture.

    A revisit has the length and digest of the payload that it refers to, and
    that page's id; they are null if that isn't in the archives.
    """
    seen = captures.where("response is not null").select(
        F.col("metadata.fields")["page_id"].cast("long").alias("page_id"),
        F.col("response.record_id").alias("record_id"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("to"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
    )
    seen = materialize(seen, "captures")
    whole = seen.where("record_type <> 'revisit'")
    given = whole.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = seen.where("record_type = 'revisit'").select("page_id", "record_type", "to").join(given, "to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.withColumn("refers_to", F.lit(None).cast("long")).select(columns).union(revisits.select(columns))
