"""WARC archives: writer with revisit records, and a salvage reader.

Archives are real files of one gzip member a record (any WARC reader takes
them), written by Spark's own file writer, so any file system of the cluster
will do.  The bytes go through the text writer, which writes a string's bytes
as they are; what it puts after each row is an empty gzip member.  A file has
one row of about ``chunk_bytes``.

The salvage reader parses member after member (or plain records from version
line to version line); a member may hold several records.  A record counts if its
version line, its header, its length and its block digest hold.  After a failed
check the reader logs a gap and searches for the next place where a whole record
holds, so later records of a damaged archive come back and every byte is in a
record or in a logged gap.  A member that is cut short or damaged is inflated as
far as it goes, and the records that hold in what comes out are saved.

Defined cases: null payload is empty; payloads under ``least`` bytes are never
revisits; of equal payloads the smallest page_id is the response (rows without
page_id revisit it; if no row has one, or several rows share the smallest, the
first written row of them is the response); a null url has no target header;
line ends in a url are escaped; an archive of no records is empty; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, shared_dir, stage, table

VERSION = b"WARC/1.1\r\n"
#: A fixed date, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Bytes of records in a file, about.
CHUNK_BYTES = 4 << 20
#: Compressed bytes inflated at once.
STEP = 1 << 14


def _member(data: bytes) -> bytes:
    code = zlib.compressobj(6, zlib.DEFLATED, 31)
    return code.compress(data) + code.flush()


EMPTY_MEMBER = _member(b"")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, first: bool) -> bytes:
    """One WARC record; ``first`` tells a response from a revisit."""
    http = f"{_HTTP}Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first else http
    head = {
        "WARC-Type": "response" if first else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=~|^`{}<>\" "),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Page-Id": None if page_id is None else str(page_id),
        "WARC-Refers-To": None if refers_to is None or first else f"<urn:page:{refers_to}>",
        "WARC-Profile": None if first else _PROFILE,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _write(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(len(batch)):
                page_id, url, html, digest, refers_to, first = (c[i].as_py() for c in batch.columns)
                held.append(_member(record(page_id, url, html, digest, refers_to, first)))
                size += len(held[-1])
                if size >= chunk_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, *, least: int = 100, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``path``."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    known = stage(rows.select("page_id", "digest", F.octet_length("html").alias("size")), "digests")
    several = known.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"), F.count(F.when(F.col("page_id").isNull(), 1)).alias("unknown"))
    several = stage(several.where("copies > 1").select("digest", "refers_to"), "several")
    # rows that share the smallest page_id, or have none, need one of them chosen: their count tells if that is so
    ties = known.join(bounded(several), "digest").where(F.col("page_id").eqNullSafe(F.col("refers_to"))).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = stage(ties.select("digest", F.lit(True).alias("tied")), "ties")
    rows = rows.join(bounded(several.withColumn("seen", F.lit(True))), "digest", "left")
    first = F.col("seen").isNull() | F.col("page_id").eqNullSafe(F.col("refers_to"))
    if not ties.isEmpty():
        marked = stage(rows.join(bounded(ties), "digest", "left").withColumn("row", F.monotonically_increasing_id()), "tied")
        chosen = marked.where(F.col("tied") & first).groupBy("digest").agg(F.min("row").alias("chosen"))
        rows = marked.join(bounded(stage(chosen, "chosen")), "digest", "left")
        first = first & (F.col("tied").isNull() | (F.col("row") == F.col("chosen")))
    sent = rows.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to", first.alias("first"))
    chunks = sent.mapInArrow(_write(chunk_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    writer = chunks.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1)
    writer.text(path)


# The digests of fixed length that a record may be checked by.
DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
#: A length that fits a long.
_COUNT = re.compile("[0-9]{1,18}")
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_HEAD_END = re.compile(rb"\r\n\r\n|\r\nWARC/1\.[01]\r\n")


def _head(data: memoryview, at: int) -> tuple[dict[str, str], int] | None:
    """Header fields of a record at ``at``, of any length, and where its block begins."""
    if not _LINE.match(data, at):
        return None
    found = _HEAD_END.search(data, at)
    if not found or found.group() != b"\r\n\r\n":  # another record begins before the header ends
        return None
    end = found.start()
    fields = {}
    for line in bytes(data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields, end + 4


def _plain(data: memoryview, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record that holds at ``at``: header, block, end."""
    found = _head(data, at)
    if not found or not _COUNT.fullmatch(found[0].get("content-length", "")):
        return None
    begin = found[1]
    end = begin + int(found[0]["content-length"])
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        return None
    block = bytes(data[begin:end])
    kind, _, value = found[0].get("warc-block-digest", "").partition(":")
    if kind and not _holds(kind.lower(), value, block):
        return None
    return found[0], block, end + 4


def _holds(kind: str, value: str, block: bytes) -> bool:
    """Does the digest, in hex or base 32, hold for the block?  One of an unknown kind doesn't."""
    if kind not in DIGESTS:
        return False
    made = hashlib.new(kind, block).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, bool]:
    """What the member at ``at`` holds as far as it inflates, its end, and whether it is whole."""
    code, made, pos = zlib.decompressobj(31), [], at
    try:
        while not code.eof and pos < len(data):
            made.append(code.decompress(data[pos : pos + STEP]))
            pos += STEP
    except zlib.error:
        # what inflates before the fault: byte by byte through the step that fails
        code = zlib.decompressobj(31)
        made = [code.decompress(data[at:pos])]
        for i in range(pos, min(pos + STEP, len(data))):
            try:
                made.append(code.decompress(data[i : i + 1]))
            except zlib.error:
                break
        return b"".join(made), at, False
    return b"".join(made), min(pos, len(data)) - len(code.unused_data), code.eof


def _inner(whole: bytes) -> tuple[list[tuple[dict[str, str], bytes]], bool]:
    """The records that hold inside a member, and whether they are all of it."""
    found = [(kind, head, block) for kind, _, _, head, block in _walk(whole, zipped=False)]
    return [(head, block) for kind, head, block in found if kind == "record"], all(kind == "record" for kind, _, _ in found)


def _walk(content: bytes, zipped: bool = True) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    data, at, gap = memoryview(content), 0, None
    marks = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n" if zipped else rb"WARC/1\.[01]\r\n")
    while at < len(data):
        records, end = [], 0
        if zipped and data[at : at + 3] == _MAGIC:
            whole, end, sound = _inflate(data, at)
            records, all_held = _inner(whole)
            if not sound or not all_held:
                end = 0
        elif found := _plain(data, at):
            records, end = [found[:2]], found[2]
        if end:
            if gap is not None:
                yield "gap", gap, at, {}, b""
                gap = None
            for i, (head, block) in enumerate(records):  # the member's bytes count for its first record
                yield "record", end if i else at, end, head, block
            at = end
        else:
            for head, block in records:  # they hold in a member that doesn't: its bytes are a gap all the same
                yield "record", at, at, head, block
            gap = at if gap is None else gap
            later = marks.search(content, at + 1)
            at = later.start() if later else len(data)
    if gap is not None:
        yield "gap", gap, len(data), {}, b""


def salvage(content: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """("record" or "gap", begin, end, header, block) over all bytes of an archive, in order.

    Records saved from inside a damaged member have no bytes of their own: the
    member's bytes are in a gap.
    """
    return _walk(content)


def _number(x: str | None) -> int | None:
    """A whole number that fits a long; null for anything else."""
    found = re.fullmatch("-?[0-9]{1,19}", x or "")
    return int(x) if found and -(1 << 63) <= int(x) < 1 << 63 else None


_READ = "archive string, kind string, begin long, end long, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.binary() if x.endswith("binary") else pa.string() for x in _READ.split(", ")]

    def rows_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows, size = [], 0
            for kind, begin, end, head, block in salvage(content.as_py()):
                payload = block.partition(b"\r\n\r\n")[2] if head.get("warc-type") == "response" else None
                digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
                length = _number(head.get("warc-payload-length"))
                if payload is not None:  # what stands in the archive decides, not what its header claims
                    digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
                target = head.get("warc-target-uri")
                refers = _number(head.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">"))
                rows.append((path.as_py(), kind, begin, end, _number(head.get("warc-page-id")), target and unquote(target), head.get("warc-type"), digest, length, refers, payload))
                size += len(payload or b"")
                if size >= 4 << 20 or len(rows) >= 4096:
                    yield rows_of(rows)
                    rows, size = [], 0
            if rows:
                yield rows_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps (kind) of all archives below ``path``."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_read, _READ)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path).where("kind = 'record'")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""
