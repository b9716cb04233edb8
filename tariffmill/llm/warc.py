"""Legacy archive converter: ARC 1 and ARC 2 files to WARC, and readers for both.

An ARC file starts with a version block whose first line names the fields of the record headers that follow; each record
is one header line, then as many bytes as the line's last field declares. The converter parses the lines by the version
of their file and synthesises what WARC asks for: a record id made from address, date and digest, an ISO time from the
14-digit date, the record type, and SHA-1 digests of payload and block in base32. Of records with equal payloads of at
least ``min_revisit`` bytes, the one with the smallest page id is the response; the others become revisits that refer to
it and keep their HTTP header but no payload.

Files are written by Spark's own committed text writer: a record's bytes are one string and the record's end mark is the
line separator, so no task opens a file of its own, and a lost task's output is never seen. Readers take whole files,
whose number follows the corpus' bytes, so one file stays near ``FILE_BYTES``.

Defined cases: a null html is an empty payload; a null address becomes ``unknown:``, and blanks inside one ``%20``; rows
with a null page id have no id in the archive and are responses unless their payload has a row with an id; repeated ids
with equal payloads are all responses; a payload longer than a file's share is one record in one file, whole, and its batch
exceeds ``BATCH_BYTES`` by it alone; an empty table gives one file without pages. Other columns are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffmill.llm.common import CLEAN_SHUFFLES, Workspace, settings

FILE_BYTES = 32 * 2**20
BATCH_BYTES = 8 * 2**20
CRAWL_DATE = "20260101000000"
# Field names of the two ARC versions, as the format fixes them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"
RECORD_SCHEMA = (
    "part int, page_id {id}, url string, ip string, date string, mime string, record_id string, http binary, payload binary, "
    "payload_bytes long, payload_digest string, block_digest string, payload_key binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> int:
    """ARC files of ``pages`` (page_id, url, html) under ``path``; even files are version 1, odd ones version 2."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    total = pages.agg(F.coalesce(F.sum(F.octet_length(html) + 256), F.lit(0)).alias("n")).first()["n"]
    files = max(1, -(-total // file_bytes))
    part = F.pmod(F.xxhash64("page_id", "url", html), F.lit(files)).cast("int")
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("unknown:")), r"[\x00-\x20]+", "%20")
    page = F.coalesce(F.concat(F.lit(f"{PAGE_HEADER}: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), page, F.lit("Content-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    block = F.concat("http", "html")
    fields = pages.select(part.alias("part"), url.alias("url"), http.alias("http"), html.alias("html"))
    sized = fields.withColumn("length", F.octet_length("http") + F.octet_length("html"))
    start = F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(CRAWL_DATE), F.lit("text/html"))
    second = F.concat_ws(" ", F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.format_string("part-%05d.arc", "part"), F.col("length").cast("string"))
    line = F.concat_ws(" ", start, F.when(F.col("part") % 2 == 0, F.col("length").cast("string")).otherwise(second))
    records = sized.select("part", F.lit(1).alias("seq"), F.concat(line, F.lit("\n"), block).alias("value"))

    def opening(version: int) -> Column:
        body = f"{version} 0 converter\n{ARC_FIELDS[version]}\n"
        name = F.format_string("part-%05d.arc", "part")
        tail = F.lit(f"text/plain {len(body)}") if version == 1 else F.concat(F.lit("text/plain 200 - - 0 "), name, F.lit(f" {len(body)}"))
        return F.concat(F.lit("filedesc://"), name, F.lit(f" 0.0.0.0 {CRAWL_DATE} "), tail, F.lit(f"\n{body}"))

    heads = pages.sparkSession.range(files).select(F.col("id").cast("int").alias("part")).select(
        "part", F.lit(0).alias("seq"), F.when(F.col("part") % 2 == 0, opening(1)).otherwise(opening(2)).alias("value")
    )
    _write(records.union(heads), files, path, "\n")
    return files


def _write(records: DataFrame, files: int | None, path: str, separator: str) -> None:
    dealt = records.repartition(files, "part") if files else records
    with settings(records.sparkSession, {CLEAN_SHUFFLES: "true"}):
        dealt.sortWithinPartitions("part", "seq").select("part", "value").write.partitionBy("part").option(
            "lineSep", separator
        ).option("compression", "gzip").text(path)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _content(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, the version block first. The version of a file is that of its block."""
    at, names = 0, ARC_FIELDS[1].split(" ")
    while at < len(data):
        if data[at:at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.index(b"\n", at)
        values = data[at:stop].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"no record header at byte {at}: {values}")
        size = int(values[-1])
        block = data[stop + 1:stop + 1 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} declares {size} bytes, {len(block)} are left")
        if values[0].startswith("filedesc:"):
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            yield dict(zip(ARC_FIELDS[version].split(" "), values)), block
            names = ARC_FIELDS[version].split(" ")
        else:
            if len(values) != len(names):
                raise ValueError(f"{len(values)} fields at byte {at}, the version has {len(names)}")
            yield dict(zip(names, values)), block
        at = stop + 1 + size


def split_http(block: bytes) -> tuple[bytes, bytes]:
    if not block.startswith(b"HTTP/"):
        return b"", block
    stop = block.find(b"\r\n\r\n")
    return (block, b"") if stop < 0 else (block[:stop + 4], block[stop + 4:])


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode() if found else None


def iso_time(date: str) -> str:
    return datetime.strptime(date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def _converted(payloads: bool, to_id):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                for head, block in arc_records(_content(raw.as_py())):
                    if head["URL"].startswith("filedesc:"):
                        continue
                    http, payload = split_http(block)
                    digest, page = base32_sha1(payload), header_value(http, PAGE_HEADER)
                    kind = "application/http; msgtype=response" if http else head["Content-type"]
                    rows.append({
                        "part": int(re.search(r"part=(\d+)", path)[1]), "page_id": to_id(page) if page is not None else None,
                        "url": head["URL"], "ip": head["IP-address"], "date": iso_time(head["Archive-date"]), "mime": kind,
                        "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((head['URL'], head['Archive-date'], digest, page or '')))}",
                        "http": http if payloads else None, "payload": payload if payloads else None, "payload_bytes": len(payload),
                        "payload_digest": digest, "block_digest": base32_sha1(block), "payload_key": hashlib.sha256(payload).digest(),
                    })
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMAS[to_id])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMAS[to_id])

    return run


def _arrow_schema(kind: pa.DataType) -> pa.Schema:
    text = dict.fromkeys(("url", "ip", "date", "mime", "record_id", "payload_digest", "block_digest"), pa.string())
    kinds = {"part": pa.int32(), "page_id": kind, "payload_bytes": pa.int64(), **text}
    names = [f.split(" ")[0] for f in RECORD_SCHEMA.split(", ")]
    return pa.schema([(n, kinds.get(n, pa.binary())) for n in names])


SCHEMAS = {int: _arrow_schema(pa.int64()), str: _arrow_schema(pa.string())}


def convert(spark: SparkSession, arc_path: str, warc_path: str, work: Workspace, id_type: str = "bigint", min_revisit: int = 0) -> None:
    """WARC files for the ARC files under ``arc_path``, one for one.

    A first reading keeps ids and digests only and finds the response of each payload that recurs: an aggregate with a
    partial step. The second reading meets that table in a join on the digest, broadcast if its written size is small.
    """
    to_id, schema = (str if id_type == "string" else int), RECORD_SCHEMA.format(id=id_type)
    small = files_of(spark, arc_path).mapInArrow(_converted(False, to_id), schema).select(
        "payload_key", "payload_bytes", "page_id", "record_id", "url", "date"
    )
    firsts = work.save(small.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_key").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "url", "date"))).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1 AND first IS NOT NULL").select(
        "payload_key", F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("first_record"),
        F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date"),
    ), "firsts")
    records = files_of(spark, arc_path).mapInArrow(_converted(True, to_id), schema).join(firsts, "payload_key", "left")
    revisit = F.col("first_page").isNotNull() & ~F.col("first_page").eqNullSafe(F.col("page_id"))
    kind = F.when(revisit, "revisit").when(F.octet_length("http") > 0, "response").otherwise("resource")
    http, payload = F.col("http").cast("string"), F.col("payload").cast("string")
    def line(name: str, value) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    length = F.octet_length("http") + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), "first_record", F.lit(">"))),
            line("WARC-Refers-To-Target-URI", F.col("first_url")), line("WARC-Refers-To-Date", F.col("first_date")),
            line("X-Refers-To-Page-Id", F.col("first_page").cast("string")),
        )).otherwise(line("WARC-Block-Digest", F.concat(F.lit("sha1:"), "block_digest"))),
        line("Content-Type", F.col("mime")), line("Content-Length", length.cast("string")), F.lit("\r\n"),
    )
    value = F.concat(head, http, F.when(revisit, F.lit("")).otherwise(payload))
    rows = records.select("part", F.lit(1).alias("seq"), value.alias("value"))
    parts = files_of(spark, arc_path).select(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part")).distinct()
    body = "software: tariffmill\r\nformat: WARC File Format 1.1\r\n"
    info = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-5000-8000-"), F.lpad(F.col("part").cast("string"), 12, "0"),
        F.lit(f">\r\nWARC-Date: {iso_time(CRAWL_DATE)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n{body}"),
    )
    # A task of the join holds whole files; one small record a file opens it.
    _write(rows.union(parts.select("part", F.lit(0).alias("seq"), info.alias("value"))), max(1, parts.count()), warc_path, "\r\n\r\n")


def warc_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record, by the declared length."""
    at = 0
    while at < len(data):
        if data[at:at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.index(b"\r\n\r\n", at) + 4
        head = data[at:stop]
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        size = int(header_value(head, "Content-Length"))
        block = data[stop:stop + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} declares {size} bytes, {len(block)} are left")
        yield head, block
        at = stop + size


def _read_back(to_id, kind: pa.DataType):
    schema = pa.schema([
        ("page_id", kind), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", kind), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows, size = [], 0
                for head, block in warc_records(_content(raw.as_py())):
                    record_type = header_value(head, "WARC-Type")
                    if record_type == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    digest, page, target = header_value(head, "WARC-Payload-Digest")[5:], header_value(http, PAGE_HEADER), header_value(head, "X-Refers-To-Page-Id")
                    if record_type != "revisit" and base32_sha1(payload) != digest:
                        raise ValueError(f"payload of {header_value(head, 'WARC-Record-ID')} differs from its digest")
                    rows.append({
                        "page_id": to_id(page) if page is not None else None, "url": header_value(head, "WARC-Target-URI"), "record_type": record_type,
                        "record_id": header_value(head, "WARC-Record-ID"),
                        "payload_bytes": int(header_value(http, "Content-Length")) if record_type == "revisit" else len(payload),
                        "payload_digest": digest, "refers_to": to_id(target) if target is not None else None,
                        "payload": None if record_type == "revisit" else payload,
                    })
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """page_id, url, record_type, record_id, payload_bytes, payload_digest, refers_to (page id), payload (revisits: null)."""
    to_id, kind = (str, pa.string()) if id_type == "string" else (int, pa.int64())
    return files_of(spark, path).mapInArrow(
        _read_back(to_id, kind), f"page_id {id_type}, url string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to {id_type}, payload binary"
    )


def archive(pages: DataFrame, min_revisit: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the records read back from the WARC files."""
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    id_type = pages.select(F.col("page_id")).schema[0].dataType.simpleString()
    if id_type not in ("string", "bigint"):
        pages, id_type = pages.withColumn("page_id", F.col("page_id").cast("bigint")), "bigint"
    write_arc(pages, work.path("arc"), file_bytes)
    work.release()
    convert(spark, work.path("arc"), work.path("warc"), work, id_type, min_revisit)
    work.drop("arc", "firsts")
    return read_warc(spark, work.path("warc"), id_type)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_page FROM p),
h AS (
    SELECT page_id, first_page, octet_length(encode(payload))::BIGINT AS payload_bytes,
        array_to_string(list_transform(string_split(sha1(payload), ''), lambda x: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
            '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', x)]), '') AS bits FROM g
)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
        + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
        + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM h
"""
