"""WARC archives: writing records as text rows, and a reader that salvages damaged archives.

Writing: a row of Spark's text sink ended by two line ends is a WARC record, so any file system
that Spark writes to takes the archives, with its commit and retry rules. Records with equal
payloads are written once as ``response``; the others are ``revisit`` records that refer to it.

Reading: records are taken one after another, plain or as gzip members. A record whose version
line, headers, length, end mark or payload digest fails is left, the next valid member or
version line is searched for, reading goes on there, and the bytes between are logged as a gap. The same holds inside of a gzip
member: what can be inflated of it, up to the damage, is searched like a file of its own.

Archives are cut so that none exceeds ``ARCHIVE_BYTES`` even if all its pages are as long as the longest.

Defined cases: a null html is the empty payload, a null url an empty target; a null ``page_id`` is its
own record without an id; repeated rows with the largest id of a payload are all responses; other
columns are ignored; an empty table gives empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docfacts.llm.common import written
from docfacts.session import work_folder

#: Records in one archive.
RECORDS = 2_000
ARCHIVE_BYTES = 1 << 30
#: Room for the headers of a record.
_HEAD_BYTES = 4_096
_END = "\r\n\r\n"
_ID = "urn:page:"
# Fixed values of the format.
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

RECORD = "archive string, start long, stop long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, gap string"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32: four times 40 bits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, records: int = RECORDS) -> None:
    """Write one record for each page to archives in ``folder``."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    hashed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.length(body).cast("long").alias("bytes"), base32_sha1(body).alias("digest"))
    keys = written(hashed.select("page_id", "digest", "bytes"), "digests").where(F.col("bytes") >= min_bytes)
    largest = keys.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.min("page_id").alias("least"))
    # Only payloads that occur again matter here; the table is small where copies are few, and its size is known to the planner.
    again = keys.join(largest.where("least < first"), ["digest", "bytes"]).where("page_id < first")
    revisits = written(again.groupBy("page_id", "digest").agg(F.max("first").alias("refers_to")), "revisits")
    revisits = revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    typed = hashed.join(revisits, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    longest = hashed.agg(F.max(F.col("bytes") + F.octet_length(F.coalesce("url", F.lit(""))) * 3)).first()[0] or 0
    records = max(1, min(records, ARCHIVE_BYTES // (longest + _HEAD_BYTES)))
    typed.select(_record().alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", records).text(folder)


def _record() -> Column:
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("html")))
    size = F.lit(len(_HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{_ID}"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)


class Damaged(Exception):
    """A record that fails a check; the text says which."""


def _headers(data: memoryview | bytes, start: int, stop: int) -> dict[str, str]:
    out = {}
    for line in bytes(data[start:stop]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(rf"<{_ID}(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The plain record that starts at ``at`` and where it ends; ``Damaged`` where a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("version line")
    head_end = data.find(b"\r\n\r\n", version.end())
    if head_end < 0:
        raise Damaged("headers")
    headers = _headers(data, version.end(), head_end)
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        raise Damaged("headers")
    body = head_end + 4
    stop = body + int(headers["content-length"])
    if stop + 4 > len(data) or data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("length")
    block = data[body:stop]
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        http_end = block.find(b"\r\n\r\n")
        payload = block[http_end + 4 :] if http_end >= 0 else b""
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] != "revisit" and digest and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise Damaged("digest")
    length = headers.get("x-payload-length", "")
    return {
        "page_id": _page(headers.get("warc-record-id")),
        "url": headers.get("warc-target-uri"),
        "record_type": headers["warc-type"],
        "refers_to": _page(headers.get("warc-refers-to")),
        "payload_bytes": int(length) if length.isdigit() else len(payload),
        "payload_digest": digest or base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "payload": payload,
    }, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int | None]:
    """The content of the gzip member at ``at`` and where it ends; None for the end if only a beginning could be inflated."""
    inflate = zlib.decompressobj(wbits=31)
    try:
        content = inflate.decompress(data[at:])
        return content, len(data) - len(inflate.unused_data) if inflate.eof else None
    except zlib.error:
        pass
    # Byte by byte, so that all that comes out before the damage is kept.
    inflate, out = zlib.decompressobj(wbits=31), []
    try:
        for k in range(at, len(data)):
            out.append(inflate.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out), None


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """Start, end and record of every valid record, and start, end and reason of every gap between them.

    What stands in a member has the member's range; gaps inside of one say where in its content they are.
    """
    at, bad, reason = 0, None, ""
    while at < len(data):
        found: list[dict | str] = []
        stop: int | None = None
        try:
            if data.startswith(_GZIP, at):
                content, stop = _member(data, at)
                # The damaged end of a cut member is part of the gap in the file.
                inner = [(a, b, f) for a, b, f in _plain(content) if stop is not None or not (isinstance(f, str) and b == len(content))]
                found = [f"{f} in member, {a} to {b}" if isinstance(f, str) else f for a, b, f in inner]
                if stop is None:
                    raise Damaged("gzip member")
            else:
                record, stop = parse_record(data, at)
                found = [record]
        except Damaged as error:
            for record in found:
                yield at, len(data), record
            if bad is None:
                bad, reason = at, str(error)
            at = _next(data, at + 1)
            continue
        if bad is not None:
            yield bad, at, reason
            bad = None
        for record in found:
            yield at, stop, record
        at = stop
    if bad is not None:
        yield bad, len(data), reason


def _plain(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """Records and gaps of bytes that hold plain records only."""
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            record, stop = parse_record(data, at)
        except Damaged as error:
            if bad is None:
                bad, reason = at, str(error)
            version = _VERSION.search(data, at + 1)
            at = version.start() if version else len(data)
            continue
        if bad is not None:
            yield bad, at, reason
            bad = None
        yield at, stop, record
        at = stop
    if bad is not None:
        yield bad, len(data), reason


def _next(data: bytes, at: int) -> int:
    """The next place where a record may start."""
    version = _VERSION.search(data, at)
    member = data.find(_GZIP, at)
    places = [p for p in (version.start() if version else -1, member) if p >= 0]
    return min(places, default=len(data))


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives in ``folder``. Gaps have a reason in ``gap`` and no other value than their range."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, RECORD.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for start, stop, found in salvage(content.as_py()):
                    row = dict.fromkeys(names) | {"archive": path.as_py(), "start": start, "stop": stop}
                    row |= {"gap": found} if isinstance(found, str) else found
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back, and give what was read. A gap in what was just written is an error."""
    spark = pages.sparkSession
    folder = work_folder(spark, "warc")
    write_archives(pages, folder, min_bytes)
    records = read_archives(spark, folder, payloads=False)
    broken = F.raise_error(F.concat(F.lit("gap in "), "archive", F.lit(": "), "gap")).cast("long")
    return records.select(F.when(F.col("gap").isNull(), F.col("page_id")).otherwise(broken).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
