"""WARC archives: a writer, and a reader whose tasks scan byte ranges (operator 8)."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.storage import fresh_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.0\r\n"
SPLIT_BYTES = 8 << 20  # a task owns the records that start in its range of this length
MOST_TASKS = 50_000  # beyond so many ranges a task gets several
STEP = 1 << 20  # bytes read at a time
HEAD_BYTES = 1 << 16  # decoded bytes that show if a member is a record; most headers end in them
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

HEAD = "warc_type string, record_id string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def one_line(value: str | None) -> str:
    """A header value without line ends: they and percent signs are percent-encoded."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def from_line(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own.

    A revisit carries the payload's digest and length and no content.
    """
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    content = payload
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
        content = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(content)}"]
    body = VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


#: A gzip member with nothing in it, but for its last byte: the text writer's line
#: separator supplies that zero, so files hold gzip members and nothing else.
EMPTY = (lambda c: c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
assert EMPTY[-1:] == b"\0"


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record a row of ``pages`` (``page_id``, ``url``, ``html``; null html is empty).

    Among rows with equal payloads of at least ``min_bytes`` the smallest page_id
    is the response and rows of other pages are revisits of it; null ids count as
    largest. Repeated rows of the response's id are responses too. The files go
    through Spark's own commit protocol, so a lost or repeated task leaves no
    half-written archive, and any file system that Spark knows will do.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
            packed = [member(p, u, (h or "").encode("utf-8", "surrogatepass"), r) + EMPTY[:-1] for p, u, h, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["value"])

    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    keyed = source.withColumn("digest", F.sha1("html")).withColumn("long_enough", F.octet_length("html") >= min_bytes)
    groups = keyed.where("long_enough").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    groups = groups.where("copies > 1 and first_id is not null").select("digest", "first_id")
    joined = keyed.join(groups, "digest", "left")
    revisit = F.when(F.col("long_enough") & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    packed = joined.select("page_id", "url", "html", revisit.alias("refers_to")).mapInArrow(pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


def open_file(path: str):
    """Random access to a file named by a URI: local paths, or any store that pyarrow reaches."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def parse_head(block: bytes) -> dict[str, str] | None:
    """Header fields if ``block`` starts with a whole WARC header, else None."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(VERSION) or end < 0:
        return None
    fields = {}
    for line in block[len(VERSION) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


class Ranges:
    """Bytes of an open file from a moving window, for scanning forward."""

    def __init__(self, source, at: int) -> None:
        self.source, self.at, self.held = source, at, b""
        self.size = source.size()

    def fill(self, upto: int) -> None:
        while self.at + len(self.held) < min(upto, self.size):
            more = self.source.read_at(min(STEP, self.size - self.at - len(self.held)), self.at + len(self.held))
            if not more:
                break
            self.held += more

    def drop(self, upto: int) -> None:
        self.held = self.held[max(0, upto - self.at) :]
        self.at = max(self.at, upto)

    def find_magic(self, start: int, end: int) -> int:
        """Offset of the next gzip magic that starts in [start, end), or -1."""
        while start < end:
            self.drop(start)
            self.fill(min(end + len(MAGIC) - 1, start + STEP))
            stop = min(end + len(MAGIC) - 1, self.at + len(self.held))
            place = self.held.find(MAGIC, 0, stop - self.at)
            if place >= 0:
                return self.at + place
            start = stop - len(MAGIC) + 1
            if stop >= self.size:
                return -1
        return -1

    def inflate(self, start: int, most: int | None = None) -> tuple[bytes, int] | None:
        """Decoded member at ``start`` and the offset past it; with ``most``, only that many bytes at least."""
        unpacker, out, at = zlib.decompressobj(31), [], start
        got = 0
        while not unpacker.eof:
            piece = self.held[at - self.at : at - self.at + 65536] if at < self.at + len(self.held) else self.source.read_at(min(65536, self.size - at), at)
            if not piece:
                return None
            try:
                out.append(unpacker.decompress(piece))
            except zlib.error:
                return None
            got += len(out[-1])
            at += len(piece)
            if most is not None and got >= most:
                break
        return b"".join(out), at - len(unpacker.unused_data)


def records(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of the file whose gzip member starts in [start, end).

    Every place with the gzip magic is a candidate; it counts if it decodes to a
    WARC header. A member that starts here is read to its end past the range; one
    that started before belongs to the range before.
    """
    with open_file(path) as source:
        ranges = Ranges(source, start)
        at = start
        while (at := ranges.find_magic(at, end)) >= 0:
            probe = ranges.inflate(at, HEAD_BYTES)
            whole = fields = None
            if probe and probe[0].startswith(VERSION) and b"\r\n\r\n" not in probe[0]:  # a longer header
                whole = ranges.inflate(at)
                fields = parse_head(whole[0]) if whole else None
                whole = whole if fields else None
            elif probe and (fields := parse_head(probe[0])):
                whole = ranges.inflate(at)
            if whole is None:
                at += 1
                continue
            body = whole[0][whole[0].find(b"\r\n\r\n") + 4 :]
            size = int(fields["content-length"])
            if len(body) < size:
                at += 1
                continue
            yield fields, body[:size]
            at = whole[1]


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of all archives under ``path``, one row each, payloads in full.

    Files are listed by Spark and cut in ranges of ``split_bytes``; each range is
    read by itself, so a large archive is shared by many tasks. Text in the
    archives that is no record is passed over. A revisit's payload is null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["warc_type", "record_id", "page_id", "url", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def number(text: str | None) -> int | None:
            return int(text) if text else None

        for batch in batches:
            for file, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows, size = [], 0
                for fields, content in records(file, start, end):
                    revisit = fields["warc-type"] == "revisit"
                    length = int(fields.get("x-payload-length", len(content)))
                    sha = fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest32(content)
                    url = fields.get("warc-target-uri")
                    rows.append((fields["warc-type"], fields.get("warc-record-id"), number(fields.get("x-page-id")), None if url is None else from_line(url), number(fields.get("x-refers-to-page-id")), sha, length if revisit else len(content), None if revisit else content))
                    size += len(content)
                    if size >= 4 * STEP or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"), "length")
    ranges = starts.select("path", "start", F.least(F.col("start") + split_bytes, F.col("length")).alias("end"))
    tasks = max(1, min(ranges.count(), MOST_TASKS))  # given by number: adaptive execution would merge so few bytes into one task
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, HEAD)


def op8(pages: DataFrame) -> DataFrame:
    """Digest of ``pages`` written as archives and read back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    found = read_archives(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")
