"""Web archives: pages to ARC records, ARC records to WARC archives, and WARC archives read back.

The converter parses the version-specific ARC record line (1: url, address, date, type, length; 2: also result code,
checksum, location, offset and file name) and takes the record's declared length of bytes. It synthesises what WARC
asks for: record ids from what the record is, ISO time stamps, types, and SHA-1 digests of block and payload. A payload
that an earlier page holds too becomes a revisit record, without the payload but with its HTTP header.
Archives are written by Spark's own text writer (a record ends with an empty line), so any shared store serves.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import hot_keys, keyed, prepare, shared_folder, written

CAPTURED, ADDRESS = "20240101000000", "0.0.0.0"
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: Bytes of payload that an archive is to hold about, and at most.
ARCHIVE_BYTES, MOST_BYTES = 128 << 20, 1 << 30
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_file(records: list[tuple[str, str, bytes]], version: int, name: str = "pages") -> bytes:
    """An ARC file of (url, date, content) records under the given version's record lines."""
    about = f"{version} 0 timedtext\n{V1 if version == 1 else V2}\n".encode()
    head = f"filedesc://{name}.arc {ADDRESS} {CAPTURED} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ")
    parts, at = [f"{head}{len(about)}\n".encode() + about], 0
    for url, date, content in records:
        at += len(parts[-1]) + 1
        extra = "" if version == 1 else f"200 {digest(content)} - {at} {name} "
        parts.append(f"{url} {ADDRESS} {date} text/html {extra}{len(content)}\n".encode() + content)
    return b"\n".join(parts) + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of each record after the version block, by declared lengths."""
    at, names = 0, V1.split()
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode()
        length, at = int(line.rsplit(" ", 1)[1]), end + 1
        content = data[at : at + length]
        at += length
        if line.startswith("filedesc:"):
            names = content.split(b"\n")[1].decode().split()
        else:
            yield dict(zip(names, line.split(" "), strict=True)), content


def page_record(page_id: int | None, url: str | None, payload: bytes, date: str | None = None) -> tuple[str, str, bytes]:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    escaped = re.sub(r"\s", lambda m: quote(m[0]), url or "")  # white space would end the record line's field
    return escaped or "about:blank", date or CAPTURED, "\r\n".join(lines).encode() + b"\r\n\r\n" + payload


def _record_id(page_id: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def warc_record(fields: dict[str, str], content: bytes, refers_to: int | None) -> bytes:
    """The WARC record of an ARC record, without the two line ends that close it."""
    head, _, payload = content.partition(b"\r\n\r\n")
    d, page = fields["Archive-date"], re.search(rb"X-Page-Id: (-?\d*)", head)[1].decode()
    of_payload = digest(payload)
    block = content if refers_to is None else head + b"\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page, of_payload)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{of_payload}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(str(refers_to), of_payload)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(data: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a stream, by declared lengths; one record is held at a time."""
    while first := data.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {first[:40]!r}")
        fields = {}
        while (line := data.readline().rstrip(b"\r\n")) != b"":
            name, value = line.decode().split(": ", 1)
            fields[name] = value
        length = int(fields["Content-Length"])
        block = data.read(length)
        if len(block) < length or data.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields['WARC-Record-ID']} is not of its declared length")
        yield fields, block


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, batch in enumerate(batches):
        ids, urls, html, dates, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "date", "refers_to"))
        arc = arc_file([page_record(i, u, (h or "").encode(), d) for i, u, h, d in zip(ids, urls, html, dates, strict=True)], 1 + k % 2)
        out = [warc_record(f, c, r).decode() for (f, c), r in zip(read_arc(arc), refers, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def _rows_of(archive: bytes) -> Iterator[tuple]:
    for fields, block in read_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)))):
        head, _, payload = block.partition(b"\r\n\r\n")
        page, length = (re.search(p, head)[1] for p in (rb"X-Page-Id: (-?\d*)", rb"Content-Length: (\d+)"))
        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and (digest(payload) != said or len(payload) != int(length)):
            raise ValueError(f"payload of page {page!r} is damaged")
        refers = fields.get("X-Refers-To-Page")
        yield int(page) if page else None, int(length), said, fields["WARC-Type"], refers and int(refers)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds, names = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], [x.split()[0] for x in RECORDS.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            found = _rows_of(content.as_py())
            while rows := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write_archives(pages: DataFrame, path: str, captured: str | None = None) -> None:
    """Gzipped WARC files, some per task. Of equal payloads the one with the smallest page_id is the response.

    Files hold ARCHIVE_BYTES of payload on average and MOST_BYTES at most (or one record), so each can be read back as
    a whole. captured names a timestamp column; without it, or where it is null, the date is CAPTURED.
    """
    prepare(pages.sparkSession)
    date = F.date_format(F.col(captured), "yyyyMMddHHmmss") if captured else F.lit(None).cast("string")
    rows = pages.select("page_id", "url", date.alias("date"), F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.sha1("html"))
    size = F.octet_length("html") + 1
    copied = rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("most"))
    copied = written(copied)
    total = copied.agg(F.sum("bytes"), F.sum("n"), F.max("most")).first()
    mean, most = (total[0] / total[1], total[2]) if total[1] else (1, 1)
    per_file = max(1, int(min(ARCHIVE_BYTES / mean, MOST_BYTES / most)))
    copied = copied.filter("n > 1")
    rows = keyed(rows, copied.select("key", "first"), "key", hot_keys(copied, "key"))
    rows = rows.select("page_id", "url", "html", "date", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    out = rows.mapInArrow(_converted, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    out.option("maxRecordsPerFile", per_file).text(path)


def read_archives(spark, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read_back, RECORDS)


def op6(pages: DataFrame) -> DataFrame:
    """Null html is an empty payload; null urls become about:blank; rows with a null page_id revisit an equal payload
    that has an id, else are responses; repeated rows of the response's page_id are responses too."""
    path = shared_folder(prepare(pages.sparkSession))
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
