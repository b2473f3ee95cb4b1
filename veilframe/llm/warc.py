"""WARC archives: written through Spark's own writer, read by byte ranges.

**Written** records are gzip members, one each, built in Arrow batches and written
by the text writer: a string column holds the member's bytes, and the line separator
is an empty gzip member (20 bytes that decompress to nothing).  So the files are plain
concatenations of gzip members, with Spark's commit protocol behind them.

**Read** archives are cut into byte ranges.  A task scans its range for the gzip
magic, takes a candidate as a member only if it decompresses to a record header, and
owns the records that start inside the range; the last may end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
GZIP = 31
DATE = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
    "date string, payload binary, payload_bytes long, payload_digest string"
)


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress(data) + packer.flush()


EMPTY_MEMBER = gzip_member(b"")


# ---------------------------------------------------------------- writing


def dedupe_payloads(pages: DataFrame, page_id: str, payload: Column, min_bytes: int = 1000) -> DataFrame:
    """``row`` (all columns), ``digest``, ``record_type`` and ``refers_to`` (an id).

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the
    largest id are responses and the others revisit it; null ids are smaller than
    all others.  Only digests that occur twice are joined, and small payloads keep
    keys of their own, so a payload that a third of the rows share is the only hot
    key; the join reads it in slices (AQE)."""
    keyed = pages.select(F.struct("*").alias("row"), F.coalesce(payload, F.lit("")).alias("payload")).select(
        "row",
        F.sha1("payload").alias("digest"),
        F.octet_length("payload").alias("n_bytes"),
        F.col("row")[page_id].alias("id"),
    )
    hubs = keyed.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.max("id").alias("hub"), F.count("*").alias("n"))
    hubs = hubs.where("n > 1 AND hub IS NOT NULL").select(F.col("digest").alias("key"), "hub")
    small = F.concat(F.lit("small "), F.xxhash64("id", "digest").cast("string"))
    joined = keyed.withColumn("key", F.when(F.col("n_bytes") >= min_bytes, F.col("digest")).otherwise(small)).join(hubs, "key", "left")
    revisits = F.col("hub").isNotNull() & ~F.col("id").eqNullSafe(F.col("hub"))
    return joined.select(
        "row",
        "digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("hub")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 1000) -> None:
    """Write one record per row to the folder ``path`` (any file system of Spark's).

    Record ids are ``<urn:x-page:ID>``.  Payloads are UTF-8, null ones empty.  A
    revisit has the HTTP headers of the whole payload and no body.  A null URL gives
    the record's id as target; white space and control characters in URLs are
    percent-encoded.  An empty table gives a folder without records."""
    rows = dedupe_payloads(pages, page_id, F.col(payload), min_bytes).select(
        F.col("row")[page_id].cast("string").alias("id"),
        F.col("row")[url].cast("string").alias("url"),
        F.encode(F.coalesce(F.col("row")[payload], F.lit("")), "utf-8").alias("payload"),
        "digest",
        "record_type",
        F.col("refers_to").cast("string").alias("refers_to"),
    )
    members = rows.mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")
    ).text(path)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(name) for name in ("id", "url", "payload", "digest", "record_type", "refers_to")]
        made, size = [], 0
        for row in zip(*columns):
            made.append(gzip_member(record(*(x.as_py() for x in row))))
            size += len(made[-1])
            if size > 16 * BLOCK:
                yield pa.record_batch([pa.array(made, pa.binary())], ["member"])
                made, size = [], 0
        if made:
            yield pa.record_batch([pa.array(made, pa.binary())], ["member"])


def record(page: str | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record: headers, an HTTP response block, two line ends."""
    body = b"" if kind == "revisit" else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    own = f"<urn:x-page:{'' if page is None else page}>"
    target = own[1:-1] if url is None else re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + body + b"\r\n\r\n"


# ---------------------------------------------------------------- reading


def read_warc(spark: SparkSession, path: str, split_bytes: int = 32 << 20, with_payload: bool = True) -> DataFrame:
    """All records of the gzip archives below ``path`` (columns: ``RECORD_SCHEMA``).

    ``payload`` is the body after the HTTP headers of an ``application/http`` block,
    else the block (null unless ``with_payload``).  ``payload_bytes`` and
    ``payload_digest`` (bare hex SHA-1) come from the payload itself; those of a
    revisit, which has none, from its headers.  Members that hold several records
    give them all, empty members none.  A record cut off by the end of its file, and
    bytes that are no gzip member, are skipped.  Files are opened with pyarrow's
    file systems (local, HDFS, S3, GCS)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ranges = files.where("length > 0").select(
        "path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))).alias("start")
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _batched(records_of_range(path, start, start + split_bytes), with_payload)

    # ranges are small rows: a fixed number of tasks, which AQE doesn't merge
    return ranges.repartition(tasks).mapInArrow(read, RECORD_SCHEMA)


def _batched(records: Iterator[dict], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))]
    )
    rows, size = [], 0
    for row in records:
        size += len(row["payload"] or b"") if with_payload else 0
        rows.append(row if with_payload else row | {"payload": None})
        if size > 16 * BLOCK or len(rows) == 4096:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


class _Window:
    """Bytes of a file from ``at`` on, read in blocks."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        block = self.file.read(BLOCK)
        self.data += block
        return bool(block)

    def forget(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n


def records_of_range(path: str, start: int, end: int) -> Iterator[dict]:
    """Records whose members start in ``[start, end)``, in order."""
    import pyarrow.fs

    system, name = pyarrow.fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        window = _Window(file, start)
        while window.at < end:
            found = window.data.find(MAGIC)
            if found < 0:
                window.forget(max(0, len(window.data) - len(MAGIC) + 1))
                if not window.more():
                    return
                continue
            window.forget(found)
            if window.at >= end:
                return
            offset = window.at
            content = _member(window)
            if content is None:
                window.forget(1)
                continue
            for row in parse_records(content):
                yield {"path": path, "offset": offset} | row


def _member(window: _Window) -> bytes | None:
    """The content of the member that starts at the window, which moves behind it;
    None, and the window stays, if the bytes are no member with records."""
    unpacker, parts, fed, checked = zlib.decompressobj(GZIP), [], 0, False
    pending = window.data
    while True:
        try:
            parts.append(unpacker.decompress(pending))
        except zlib.error:
            return None
        fed += len(pending)
        if not checked and (sum(map(len, parts)) >= 5 or unpacker.eof):
            checked, head = True, b"".join(parts)[:5]
            if head and head != b"WARC/":
                return None
        if unpacker.eof:
            window.forget(fed - len(unpacker.unused_data))
            return b"".join(parts)
        if fed == len(window.data) and not window.more():
            return None  # cut off
        pending = window.data[fed:]


def parse_records(content: bytes) -> Iterator[dict]:
    at = 0
    while content[at : at + 5] == b"WARC/":
        head_end = content.find(b"\r\n\r\n", at)
        if head_end < 0:
            return
        headers = _headers(content[at:head_end])
        if not headers.get("content-length", "").isdecimal():
            return
        at = head_end + 4 + int(headers["content-length"])
        block = content[head_end + 4 : at]
        while content[at : at + 2] == b"\r\n":
            at += 2
        payload, declared = block, None
        if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            declared = _headers(http).get("content-length")
        revisit = headers.get("warc-type") == "revisit"
        yield {
            "record_type": headers.get("warc-type"),
            "record_id": headers.get("warc-record-id"),
            "target_uri": headers.get("warc-target-uri"),
            "refers_to": headers.get("warc-refers-to"),
            "date": headers.get("warc-date"),
            "payload": None if revisit else payload,
            "payload_bytes": (int(declared) if declared and declared.isdecimal() else None) if revisit else len(payload),
            "payload_digest": _hex(headers.get("warc-payload-digest")) if revisit else hashlib.sha1(payload).hexdigest(),
        }


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, mark, value in (line.partition(":") for line in lines) if mark}


def _hex(digest: str | None) -> str | None:
    """Bare lower-case hex of ``sha1:BASE32`` or ``sha1:hex``."""
    value = (digest or "").rpartition(":")[2]
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex() or None
    except ValueError:
        return None
