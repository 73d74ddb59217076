"""Legacy web archives (ARC) converted to WARC, written, and read back.

An ARC file opens with a `filedesc://` record whose body names the version; each
record is one header line, then as many bytes as the line declares:

    version 1   URL IP date type length
    version 2   URL IP date type status checksum location offset filename length

Fields are taken from the right, so a URL may hold spaces; record ends come from
the declared lengths alone, so a payload may hold anything. The converter makes
WARC identifiers (name-based UUIDs), timestamps, types and SHA-1 digests. Of
records with equal payloads the one with the largest page number is the response
and the others become revisits that refer to it.

Archives are text files of Spark's own writer, one file for each chunk of about
`CHUNK_BYTES`, so they lie wherever Spark can write, are committed by task, and
are read back whole but small. Payloads are UTF-8.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.llm.common import batch_texts, shuffle_width

CHUNK_BYTES = 8 << 20
REVISIT_BYTES = 1000
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:dockline:web-records")
FIELDS = {1: ("url", "ip", "date", "type", "length"),
          2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length")}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
EPOCH = "19700101000000"
PAGE_HEADER = "X-Page-Number"


def _clean(value: str | None) -> str:
    """A URL for a header line: no line breaks, `-` for none."""
    return " ".join((value or "").split("\n")).replace("\r", " ").strip() or "-"


def arc_record(url: str | None, page: int | None, payload: bytes, date: str, version: int) -> bytes:
    """One ARC record whose body is an HTTP response."""
    number = "" if page is None else f"{PAGE_HEADER}: {page}\r\n"
    body = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}\r\n".encode() + payload
    fields = {"url": _clean(url), "ip": "0.0.0.0", "date": date, "type": "text/html", "status": "200", "checksum": "-",
              "location": "-", "offset": "0", "filename": "legacy.arc", "length": str(len(body))}
    return " ".join(fields[name] for name in FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_opening(version: int) -> bytes:
    body = f"{version} 0 dockline\n{' '.join(FIELDS[version])}\n".encode()
    line = {1: f"filedesc://legacy.arc 0.0.0.0 {EPOCH} text/plain {len(body)}",
            2: f"filedesc://legacy.arc 0.0.0.0 {EPOCH} text/plain 200 - - 0 legacy.arc {len(body)}"}[version]
    return line.encode() + b"\n" + body + b"\n"


def parse_arc(content: bytes) -> Iterator[dict]:
    """The records of one ARC file: its header fields and `body`. Raises ValueError on a torn file."""
    at, version = 0, None
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = content.index(b"\n", at)
        line = content[at:stop].decode("utf-8", "replace").rstrip("\r")
        if version is None:
            # the opening record names its version in the first byte of its body
            if not line.startswith("filedesc://"):
                raise ValueError("no filedesc record at the start")
            version = int(content[stop + 1 : content.index(b" ", stop)])
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
        names = FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError(f"header line of {len(parts)} fields")
        record = dict(zip(names, parts, strict=True))
        size = int(record["length"])
        body = content[stop + 1 : stop + 1 + size]
        if len(body) < size:
            raise ValueError("declared length passes the end")
        at = stop + 1 + size
        if not record["url"].startswith("filedesc://"):
            yield record | {"body": body, "version": version}


def warc_date(digits: str) -> str:
    """14 digits as an ISO timestamp; shorter ones are filled up, none is the epoch."""
    digits = "".join(c for c in digits if c.isdigit())[:14]
    digits += EPOCH[len(digits) :]
    try:
        moment = datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    except ValueError:
        moment = datetime.strptime(EPOCH, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    return moment.strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, page: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, chr(10).join((url, page, date, digest)))}>"


def pages_to_arc(pages: DataFrame, *, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """Legacy archives of a page table, as (content) rows; versions alternate between files."""
    batch_texts(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, held, size = 1, [], 0
        for batch in batches:
            for page, link, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                date = f"2011{1 + (page or 0) % 12:02d}{1 + (page or 0) % 28:02d}{(page or 0) % 24:02d}0000"
                record = arc_record(link, page, (text or "").encode(), date, version)
                held.append(record)
                size += len(record)
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pydict({"content": pa.array([arc_opening(version) + b"".join(held)], pa.binary())})
                    version, held, size = 3 - version, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"content": pa.array([arc_opening(version) + b"".join(held)], pa.binary())})

    chosen = pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    return chosen.mapInArrow(work, "content binary")


def arc_records(archives: DataFrame) -> DataFrame:
    """Converted records of ARC files: archives has a binary column `content`, one row for each file.

    (page_id, url, date, record_id, head, payload, payload_bytes, payload_digest); head
    is the HTTP response's head, page_id null where it names none.
    """
    names = ["page_id", "url", "date", "record_id", "head", "payload", "payload_bytes", "payload_digest"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for record in parse_arc(content.as_py()):
                    head, mark, payload = record["body"].partition(b"\r\n\r\n")
                    if not mark:  # no HTTP head: all of it is payload
                        head, payload = b"", record["body"]
                    page = ""
                    for line in head.decode("utf-8", "replace").split("\r\n"):
                        if line.startswith(PAGE_HEADER + ":"):
                            page = line.partition(":")[2].strip()
                    date, digest = warc_date(record["date"]), hashlib.sha1(payload).hexdigest()
                    rows.append((int(page) if page else None, record["url"], date, record_id(record["url"], page, date, digest),
                                 head.decode("utf-8", "replace"), payload.decode("utf-8", "replace"), len(payload), digest))
                    size += len(payload)
                    if size >= CHUNK_BYTES // 4:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    schema = ("page_id long, url string, date string, record_id string, head string, payload string, "
              "payload_bytes long, payload_digest string")
    return archives.select("content").mapInArrow(work, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_page": pa.int64()}
    columns = [pa.array(column, kinds.get(n, pa.string())) for n, column in zip(names, zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def with_types(records: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Add refers_id and refers_date: the response that a revisit stands for, null for a response.

    Payloads below `least_bytes` and records without a page number are responses;
    so are all records that share the largest page number of their payload.
    """
    long = F.col("payload_bytes") >= least_bytes
    # only groups of two or more come to the join
    first = (
        records.filter(long & F.col("page_id").isNotNull())
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "record_id", "date")).alias("r"), F.min("page_id").alias("least"))
        .filter("least < r.page_id")
        .select("payload_digest", "payload_bytes", "r")
    )
    revisit = F.col("page_id") < F.col("r.page_id")
    joined = records.join(first, ["payload_digest", "payload_bytes"], "left")
    return joined.select(
        *records.columns,
        F.when(revisit, F.col("r.record_id")).alias("refers_id"),
        F.when(revisit, F.col("r.date")).alias("refers_date"),
    )


def warc_record(record: dict) -> str:
    """The text of one response or revisit record, without the blank lines that end it."""
    head = record["head"]
    lines = ["WARC/1.0"]
    revisit = record["refers_id"] is not None
    body = head + "\r\n\r\n" + ("" if revisit else record["payload"])
    lines.append(f"WARC-Type: {'revisit' if revisit else 'response'}")
    lines.append(f"WARC-Record-ID: {record['record_id']}")
    lines.append(f"WARC-Date: {record['date']}")
    lines.append(f"WARC-Target-URI: {record['url']}")
    lines.append(f"WARC-Payload-Digest: sha1:{record['payload_digest']}")
    if revisit:
        lines += [f"WARC-Refers-To: {record['refers_id']}", f"WARC-Refers-To-Date: {record['refers_date']}", f"WARC-Profile: {PROFILE}"]
    coded = body.encode()
    lines.append(f"WARC-Block-Digest: sha1:{hashlib.sha1(coded).hexdigest()}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(coded)}")
    return "\r\n".join(lines) + "\r\n\r\n" + body


def write_warc(records: DataFrame, folder: str) -> None:
    """Write records (see `with_types`) as WARC files of about CHUNK_BYTES each."""
    names = ["record_id", "date", "url", "head", "payload", "payload_digest", "refers_id", "refers_date"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                text = warc_record(dict(zip(names, row, strict=True)))
                held.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pydict({"value": ["\r\n\r\n".join(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": ["\r\n\r\n".join(held)]})

    files = records.select(*names).mapInArrow(work, "value string")
    # a row is a file: the writer opens a new one after each record and ends it with two line ends
    files.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(folder)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of one WARC file, by declared lengths; ValueError on a torn file."""
    at = 0
    while at < len(content):
        if content[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin where the one before it ends")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"])
        body = content[stop + 4 : stop + 4 + size]
        if len(body) < size:
            raise ValueError("declared length passes the end")
        at = stop + 4 + size
        yield headers, body


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_id, url, date, record_type, refers_id, block, payload_bytes, payload_digest) of all records.

    Digest and length of a response are taken from its bytes and must match its
    header; a revisit has its header's digest and a null length.
    """
    import zlib

    names = ["page_id", "record_id", "url", "date", "record_type", "refers_id", "payload_bytes", "payload_digest"]
    files = spark.read.format("binaryFile").load(folder).select("content", "path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, path in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                if path.as_py().endswith(".gz"):
                    data = zlib.decompress(data, 31)
                rows = []
                for headers, body in parse_warc(data):
                    head, _, payload = body.partition(b"\r\n\r\n")
                    page = None
                    for line in head.decode("utf-8", "replace").split("\r\n"):
                        if line.startswith(PAGE_HEADER + ":"):
                            page = int(line.partition(":")[2])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    whole = headers["warc-type"] == "response"
                    if whole and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"digest of {headers['warc-record-id']} does not match its payload")
                    rows.append((page, headers["warc-record-id"], headers["warc-target-uri"], headers["warc-date"], headers["warc-type"],
                                 headers.get("warc-refers-to"), len(payload) if whole else None, digest))
                if rows:
                    yield _batch(rows, names)

    schema = ("page_id long, record_id string, url string, date string, record_type string, refers_id string, "
              "payload_bytes long, payload_digest string")
    return files.mapInArrow(work, schema)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take length and page of their response."""
    targets = records.filter("refers_id IS NULL").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("to"), F.col("payload_bytes").alias("to_bytes")
    ).dropDuplicates(["refers_id"])
    needed = records.filter("refers_id IS NOT NULL").join(targets, "refers_id", "left")
    return (
        records.filter("refers_id IS NULL")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
        .unionAll(needed.select("page_id", F.col("to_bytes"), "payload_digest", "record_type", F.col("to")))
    )


def converted(pages: DataFrame, folder: str, *, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """A page table through legacy archives into WARC files in `folder`, and what reading them gives.

    Null html is an empty payload, a null url is `-`, a null page number takes no
    part in revisits; repeated rows give repeated records; an empty table gives an
    empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    records = with_types(arc_records(pages_to_arc(pages, url=url, html=html, page_id=page_id)))
    write_warc(records, folder)
    if not _any_file(spark, folder):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return resolved(read_warc(spark, folder))


def _any_file(spark: SparkSession, folder: str) -> bool:
    return bool(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(folder).select("path").head(1))
