"""WARC archives: writing, normalising monolithic gzip, and reading by offset.

``write_archives`` writes each task's records as archives that are one gzip stream over the whole
file.  ``normalise`` inflates each such stream once, in pieces, and rewrites every record as a
gzip member of its own next to a sidecar index of offsets.  ``read_archives`` seeks each record by
the index, inflates its member alone and parses it.

Files go to a folder that all executors share.  A task names its files by its attempt, and only
what committed tasks report is read on, so a task that is run again, or twice, leaves no double.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest id is
the response, the others revisit it.  Defined results: a null html is an empty payload; a null url
is left out; control characters and spaces of a url are percent-encoded; a null id is written as
none and is never a revisit's target, nor a revisit.  Of rows that repeat both id and payload all
are responses, as a record does not revisit itself.  An empty table gives no archives.  Extra
columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexorder.staging import Stages, qualified, shared_dir

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20      # of records, before compression, after which a file is closed
PIECE = 1 << 20                # bytes read or inflated at once
VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"  # records carry no clock time, so that reruns agree


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else
                                        "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


# --- records ----------------------------------------------------------------------------------

def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in headers]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str,
                refers_to: int | None) -> bytes:
    """The record of a page; a revisit has the digest and length but no payload."""
    kind = "response" if refers_to is None else "revisit"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    headers = [("WARC-Type", kind), ("WARC-Date", DATE),
               ("WARC-Record-ID", f"<urn:uuid:{name}>"),
               ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)
        headers.insert(1, ("WARC-Target-URI", safe))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    headers.append(("X-Payload-Length", str(len(payload))))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        return record(headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/"
                                 "identical-payload-digest"),
                ("X-Refers-To-Page-ID", str(refers_to))]
    return record(headers, http)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
    return {k.decode().lower(): v.decode().strip()
            for k, _, v in (line.partition(b":") for line in lines[1:])}


def parse_record(raw: bytes) -> dict:
    """A page's record back as a row; the digest of a payload that is there is made anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = parse_headers(head)
    block = rest[:int(headers["content-length"])]
    _, _, payload = block.partition(b"\r\n\r\n")
    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    named = headers["warc-payload-digest"].removeprefix("sha1:")
    row = {"page_id": int(page) if page else None, "record_type": headers["warc-type"],
           "refers_to": int(refers) if refers else None, "payload_digest": named,
           "payload_bytes": int(headers["x-payload-length"])}
    if row["record_type"] == "response":
        row |= {"payload_bytes": len(payload),
                "payload_digest": hashlib.sha1(payload).hexdigest()}
        if row["payload_digest"] != named:
            raise ValueError(f"page {page}: the payload does not have its digest")
    return row


# --- writing ----------------------------------------------------------------------------------

class GzipFile:
    """A file written as one gzip stream, or as a member for each record."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.out, self.path, self.at = fs.open_output_stream(path, compression=None), path, 0
        self.stream = None

    def add(self, data: bytes) -> None:
        """Go on with the current member."""
        if self.stream is None:
            self.stream = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(self.stream.compress(data))

    def end(self) -> None:
        if self.stream is not None:
            self._put(self.stream.flush())
            self.stream = None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.end()
        self.out.close()


def record_kinds(pages: DataFrame, stages: Stages, page_id: str = "page_id", url: str = "url",
                 html: str = "html") -> DataFrame:
    """Pages with payload, digest, and the page that each revisits."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"),
                        F.col(url).alias("url"), payload.alias("payload"),
                        F.sha1(payload).alias("digest"))
    # Digests that occur once need no join; a third of all pages may share one that does.
    large = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).filter("page_id IS NOT NULL")
    shared = stages.save(large.groupBy("digest").agg(
        F.max("page_id").alias("target"), F.min("page_id").alias("least"))
        .filter("target <> least").select("digest", "target"), "shared")
    return rows.join(shared, "digest", "left").withColumn(
        "refers_to", F.when(F.col("page_id") < F.col("target"), F.col("target"))).drop("target")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of ``record_kinds``; returns (path, records) of the archives, unread as yet."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        file, size, records, done = None, 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if file is None:
                    name = f"pages-{attempt:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                    file, size, records = GzipFile(fs, f"{root}/{name}"), 0, 0
                raw = page_record(row["page_id"], row["url"], row["payload"], row["digest"],
                                  row["refers_to"])
                file.add(raw)
                size += len(raw)
                records += 1
                if size >= archive_bytes:
                    file.close()
                    done.append((file.path, records))
                    file = None
        if file is not None:
            file.close()
            done.append((file.path, records))
        yield pa.RecordBatch.from_pylist(
            [{"path": p, "records": n} for p, n in done],
            pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return (pages.select("page_id", "url", "payload", "digest", "refers_to")
            .mapInArrow(write, "path string, records long"))


# --- normalising ------------------------------------------------------------------------------

class Inflated:
    """The bytes of a gzip file of any number of members, inflated in pieces."""

    def __init__(self, raw):
        self.raw, self.held, self.rest = raw, bytearray(), b""
        self.stream, self.begun, self.ended = zlib.decompressobj(31), False, False

    def more(self) -> bool:
        """Inflate another piece; False at the end of the file."""
        while not self.ended:
            data = self.rest or self.raw.read(PIECE)
            if not data:
                if self.begun:
                    raise ValueError("the gzip stream is cut off")
                self.ended = True
                return False
            if self.stream is None:
                self.stream = zlib.decompressobj(31)
            self.begun = True
            out = self.stream.decompress(data, PIECE)
            self.rest = self.stream.unconsumed_tail or self.stream.unused_data
            if self.stream.eof:
                self.stream, self.begun = None, False
            if out:
                self.held += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Take what lies before ``mark``, and the mark; None at the end of the file."""
        searched = 0
        while (at := self.held.find(mark, searched)) < 0:
            searched = max(0, len(self.held) - len(mark))
            if not self.more():
                if bytes(self.held).strip():
                    raise ValueError("the archive ends within a record's headers")
                return None
        out = bytes(self.held[:at])
        del self.held[:at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            part = bytes(self.held[:n])
            del self.held[:n]
            n -= len(part)
            yield part


def normalise_file(fs: pafs.FileSystem, path: str, to: str) -> list[dict]:
    """Rewrite one archive with a member per record; the index, also written as ``to``.idx.

    No more than a piece of a record is held at once, however long the record or the file.
    """
    index = []
    with fs.open_input_stream(path, compression=None) as raw:
        stream, out = Inflated(raw), GzipFile(fs, to)
        while (head := stream.until(b"\r\n\r\n")) is not None:
            headers = parse_headers(head.lstrip(b"\r\n"))
            begin = out.at
            out.add(head.lstrip(b"\r\n") + b"\r\n\r\n")
            for part in stream.take(int(headers["content-length"])):
                out.add(part)
            out.add(b"".join(stream.take(4)))        # the two line ends after a record
            out.end()
            index.append({"path": to, "offset": begin, "length": out.at - begin,
                          "record_id": headers.get("warc-record-id"),
                          "record_type": headers.get("warc-type")})
        out.close()
    with fs.open_output_stream(f"{to}.idx", compression=None) as side:
        for entry in index:
            side.write((json.dumps({k: v for k, v in entry.items() if k != "path"},
                                   sort_keys=True) + "\n").encode())
    return index


INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                   ("record_id", pa.string()), ("record_type", pa.string())])


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rows with the ``path`` of archives to the index of all records of their normal forms."""
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = path.rsplit("/", 1)[1].removesuffix(".warc.gz")
                index = normalise_file(fs, path, f"{root}/{name}-{attempt:06d}.warc.gz")
                for at in range(0, len(index), 10_000):
                    yield pa.RecordBatch.from_pylist(index[at:at + 10_000], INDEX)

    spark = archives.sparkSession
    spread = archives.select("path").repartition(
        max(1, 2 * spark.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(rewrite, "path string, offset long, length long, "
                                      "record_id string, record_type string")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The pages' rows, read record by record at the offsets of the index."""
    fields = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        path, file = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if file is not None:
                        file.close()
                    path, file = row["path"], fs.open_input_file(row["path"])
                raw = zlib.decompress(file.read_at(row["length"], row["offset"]), 31)
                rows.append(parse_record(raw))
            yield pa.RecordBatch.from_pylist(rows, fields)
        if file is not None:
            file.close()

    return index.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, "
                                  "record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url",
               html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives, normalise them, and read the records back."""
    stages = Stages(spark)
    folder = qualified(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    kinds = record_kinds(pages, stages, page_id, url, html)
    written = stages.save(write_archives(kinds, f"{folder}/whole", archive_bytes), "archives")
    index = stages.save(normalise(written, f"{folder}/normal"), "index")
    return read_archives(index, f"{folder}/normal")
