"""WARC records in ZIP-packaged archives: writing them, and reading them back by ranges.

An archive is a ZIP file with stored (not deflated) members: archive/data.warc.gz, where each record
is a gzip member of its own, and indexes/index.cdxj, one line a record with its offset and length. The
reader fetches the end of the file, follows the central directory (ZIP64 where it is used), finds where
members begin, reads the index, and then fetches records by byte ranges. Nothing is unpacked to disk.

Files go to the shared folder through pyarrow's file systems, under a name of the task's own; the
manifest lists the archives of the tasks that ended well, and only these are read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import OWN, table, without
from weft.runtime import bound_batches, materialize, shared_path, sized_broadcast

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Bytes that a reader fetches at once at most, unless a record is longer; and of the file's end, where directories are looked for.
FETCH, TAIL = 4 << 20, (1 << 16) + 22 + 20 + 56
#: Payload bytes after which a task closes an archive and opens another.
ARCHIVE_BYTES = 1 << 30
#: Signatures of the ZIP format: fixed values.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"

ReadRange = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


class ArchiveReader:
    """A ZIP file of `length` bytes behind read_range(offset, count)."""

    def __init__(self, read_range: ReadRange, length: int):
        self.read_range = read_range
        tail_at = max(0, length - TAIL)
        tail = read_range(tail_at, length - tail_at)
        end = tail.rfind(END)
        while end >= 0 and len(tail) - end - 22 < struct.unpack_from("<H", tail, end + 20)[0]:
            end = tail.rfind(END, 0, end)
        if end < 0:
            raise ValueError("no end of a central directory")
        count, size, at = struct.unpack_from("<HII", tail, end + 10)
        self.zip64 = end >= 20 and tail[end - 20 : end - 16] == LOCATOR64
        if not self.zip64 and (count == 0xFFFF or 0xFFFFFFFF in (size, at)):
            raise ValueError("no ZIP64 locator")
        if self.zip64:
            end64 = struct.unpack_from("<Q", tail, end - 12)[0]
            record = read_range(end64, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of a central directory")
            count, size, at = struct.unpack_from("<QQQ", record, 32)
        self.members = self._directory(read_range(at, size), count)

    @staticmethod
    def _directory(data: bytes, count: int) -> dict[str, Member]:
        members, at = {}, 0
        for _ in range(count):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("a broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            crc, packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", data, at + 16)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, p = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while p + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, p)
                if kind == 1:  # only the fields that don't fit are here, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                p += 4 + n
            members[name] = Member(name, method, crc, packed, size, header)
            at += 46 + n_name + n_extra + n_comment
        return members

    def begin(self, name: str) -> int:
        """Where a stored member's bytes begin in the file."""
        member = self.members[name]
        if member.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} isn't stored")
        local = self.read_range(member.header, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"{name} has no local header")
        return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))

    def member(self, name: str) -> bytes:
        return self.read_range(self.begin(name), self.members[name].size)

    def lines(self, name: str) -> Iterator[str]:
        """The lines of a stored member, fetched piece by piece."""
        begin, left, rest = self.begin(name), self.members[name].size, b""
        while left:
            piece = self.read_range(begin, min(FETCH, left))
            begin, left = begin + len(piece), left - len(piece)
            *whole, rest = (rest + piece).split(b"\n")
            for line in whole:
                yield line.decode()
        if rest:
            yield rest.decode()

    def records(self) -> Iterator[tuple[dict, bytes]]:
        """Index entry and raw record (unzipped) of each line of the index, neighbours fetched together."""
        base, held, held_at = self.begin(DATA), b"", 0
        size = self.members[DATA].size
        for line in self.lines(INDEX):
            entry = json.loads(line.split(" ", 2)[2])
            offset, length = entry["offset"], entry["length"]
            if not held_at <= offset or offset + length > held_at + len(held):
                held_at = offset
                held = self.read_range(base + offset, min(max(FETCH, length), size - offset))
            yield entry, zlib.decompress(held[offset - held_at : offset - held_at + length], 31)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def payload(headers: dict[str, str], block: bytes) -> bytes:
    """The body of the HTTP response in a record's block."""
    return block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else b""


def _uid(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC 1.1 record; a revisit has the headers of the response but not its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if revisit else http + body
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _uid(page_id),
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": "".join((url or "").split()),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(body)),
        "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _uid(refers_to), "X-Refers-To-Page": str(refers_to)}
    headers["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archive(out, records: Iterator[tuple[str, bytes]]) -> int:
    """Write an archive of (key, record) pairs to the binary stream out; the number of records."""
    n, offset, lines = 0, 0, []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
            for key, raw in records:
                packed = gzip.compress(raw, 1, mtime=0)
                data.write(packed)
                lines.append(f"{key} 20240101000000 {json.dumps({'offset': offset, 'length': len(packed)})}")
                offset += len(packed)
                n += 1
        with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in lines:
                index.write(line.encode() + b"\n")
    return n


def classify(pages: DataFrame) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads (by SHA-1 and length) of at least LEAST_BYTES bytes, the one with the largest page_id
    is the response; the others revisit it. A null html counts as empty. Repeated rows with the largest
    page_id are responses all. Rows with a null page_id are responses, as none can refer to or from them.
    """
    pages = without(pages, ["payload_bytes", "payload_digest", "record_type", "refers_to"])
    body = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("payload_digest", F.sha1(body))
    key = ["payload_digest", "payload_bytes"]
    groups = pages.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy(*key).agg(F.max("page_id").alias(f"{OWN}last"), F.count(F.lit(1)).alias(f"{OWN}n"))
    groups = materialize(groups.where(f"{OWN}n > 1 AND {OWN}last IS NOT NULL").drop(f"{OWN}n"), "payloads")
    revisit = F.col("page_id") != F.col(f"{OWN}last")
    return (
        pages.join(sized_broadcast(groups), key, "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col(f"{OWN}last")))
        .drop(f"{OWN}last")
    )


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Write the records of pages (as classify gives them) to archives under uri; a row (path, n) an archive.

    The rows are written down before they are returned, so later steps don't write again.
    """
    bound_batches(pages.sparkSession, 256)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        rows = (r for b in batches for r in b.to_pylist())
        first = next(rows, None)
        while first is not None:
            name = f"{root}/{uuid.uuid4().hex}.zip"
            fs.create_dir(root, recursive=True)
            held = [first]

            def some(held=held) -> Iterator[tuple[str, bytes]]:
                row, size = held.pop(), 0
                while row is not None and size < ARCHIVE_BYTES:
                    body = (row["html"] or "").encode()
                    raw = record(row["page_id"], row["url"], body, row["payload_digest"], row["refers_to"], row["record_type"] == "revisit")
                    size += len(raw)  # a record is never empty, so the index, too, is bounded
                    yield _key(row["url"]), raw
                    row = next(rows, None)
                held.append(row)

            with fs.open_output_stream(f"{name}.part") as out:
                n = write_archive(_Stream(out), some())
            fs.move(f"{name}.part", name)
            yield pa.RecordBatch.from_pydict({"path": [name], "n": [n]})
            first = held.pop()

    rows = pages.select("page_id", "url", "html", "payload_digest", "record_type", "refers_to")
    return materialize(rows.mapInArrow(write, "path string, n long"), "archives")


def _key(url: str | None) -> str:
    return "".join((url or "-").split()) or "-"


class _Stream:
    """A stream that zipfile may write to but not seek in."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string, intact boolean"


def read_archives(archives: DataFrame, uri: str, html: bool = True) -> DataFrame:
    """The records of the archives (column path) by ranged reads, one row a record.

    intact: a response's payload has the length and digest that its headers say. html is null for revisits,
    and for all with html=False.
    """
    bound_batches(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("intact", pa.bool_())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(path) as f:
                    reader = ArchiveReader(lambda at, n, f=f: f.read_at(n, at), f.size())
                    rows, size = [], 0
                    for _, raw in reader.records():
                        h, block = parse(raw)
                        body = payload(h, block)
                        n, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                        response = h["warc-type"] == "response"
                        if response:  # a revisit's payload is in the record that it refers to
                            whole = (len(body), hashlib.sha1(body).hexdigest())
                            intact, (n, digest) = whole == (n, digest), whole
                        else:
                            intact = not body
                        rows.append({"page_id": int(h["x-page-id"]) if h["x-page-id"] else None, "payload_bytes": n, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": int(h["x-refers-to-page"]) if not response else None, "url": h["warc-target-uri"], "html": body.decode() if html and response else None, "intact": intact})
                        size += len(body) if html else 200
                        if size >= FETCH:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path").mapInArrow(read, READ)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = classify(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    uri = shared_path(spark, "warc")
    archives = write_archives(pages, uri)
    parts = max(1, min(archives.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    read = read_archives(archives.repartition(parts), uri, html=False)
    intact = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record differs from what was written")))
    return read.select("page_id", "payload_bytes", intact.alias("payload_digest"), "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::bigint AS payload_bytes, sha1(b) AS payload_digest,
             max(page_id) OVER (PARTITION BY sha1(b), octet_length(b)) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM d"""
