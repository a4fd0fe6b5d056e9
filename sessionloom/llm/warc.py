"""Web archives: WARC records written into ZIP packages, and a reader that takes
records out of a package by byte ranges.

A package is a ZIP file (with ZIP64 records where sizes or counts need them)
that holds two stored, that is uncompressed, members: ``archive/data.warc.gz``,
one gzip member for each record, and ``indexes/index.cdxj``, one line for each
record with its offset and length. The reader parses the end record, the ZIP64
records and the central directory, finds both members, and reads the records it
wants at their offsets; nothing is extracted.

Records with equal payloads of at least ``least_bytes`` are written once: the
one with the largest page_id is a response, the others revisit it.

Packages are written with pyarrow's file systems below the shared folder; each
task attempt takes names of its own, and only what the manifest lists counts, so
a lost executor leaves orphans but no wrong package.

Defined cases: a null html is an empty payload, a null url an empty target. Rows
that share the largest page_id of a payload are all responses. Null page_ids
never win over others; where a payload has no other, its rows are responses.
Further columns do not matter. No rows give no packages and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.runtime import materialize, scratch_dir

from . import common

PACKAGE_BYTES = 64 << 20
READ_BYTES = 4 << 20
INDEX_LINES = 2000
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_BIG = 0xFFFFFFFF
DATE = "2024-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Of a path with its scheme, as ``scratch_dir`` gives it."""
    if "://" not in uri:
        raise ValueError(f"{uri} has no scheme: which machine's folder it is would be open")
    return pafs.FileSystem.from_uri(uri)


# writing


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers: tuple[int, str] | None) -> bytes:
    """One WARC record; ``refers`` (page_id, url) makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers[0])}", f"WARC-Refers-To-Target-URI: {clean(refers[1])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(name: str) -> int | None:
    tail = name.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def clean(url: str) -> str:
    return "".join(" " if c in "\r\n" else c for c in url)


class PackageWriter:
    """Stored members one after the other, streamed, then the directories.
    ``big`` and above goes to ZIP64 fields."""

    def __init__(self, out, big: int = _BIG):
        self.out, self.at, self.big = out, 0, big
        self.members: list[tuple[bytes, int, int, int]] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """The local header tells no sizes (flag 3); a data descriptor with
        8-byte sizes follows the data."""
        self.name, self.crc, self.offset = name.encode(), 0, self.at
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 0x21, 0, _BIG, _BIG, len(self.name), len(extra)) + self.name + extra)
        self.data_at = self.at

    def data(self, chunk: bytes) -> None:
        self.crc = zlib.crc32(chunk, self.crc)
        self._put(chunk)

    def end(self) -> None:
        size = self.at - self.data_at
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, size, size))
        self.members.append((self.name, self.crc, size, self.offset))

    def close(self) -> None:
        start = self.at
        for name, crc, size, offset in self.members:
            wide = [v for v in (size, size, offset) if v >= self.big]
            size32, offset32 = (_BIG if v >= self.big else v for v in (size, offset))
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            self._put(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 0x21, crc, size32, size32, len(name), len(extra), 0, 0, 0, 0, offset32) + name + extra)
        length, n, end64 = self.at - start, len(self.members), self.at
        if max(start, length) >= self.big or n >= 0xFFFF:
            self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(_LOCATOR + struct.pack("<IQI", 0, end64, 1))
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), _BIG if length >= self.big else length, _BIG if start >= self.big else start, 0))


class Package:
    """One package in the making: an archive member, then its index."""

    def __init__(self, where: pafs.FileSystem, path: str):
        self.path, self.lines = path, []
        self.stream = where.open_output_stream(path, buffer_size=1 << 20)
        self.zip = PackageWriter(self.stream)
        self.zip.begin(ARCHIVE)

    def add(self, page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers: tuple[int | None, str] | None) -> None:
        at, member = self.zip.at - self.zip.data_at, gzip.compress(record(page_id, url, payload, digest, size, refers), 6, mtime=0)
        self.zip.data(member)
        self.lines.append(f"{clean(url) or '-'} {json.dumps({'offset': at, 'length': len(member), 'digest': digest})}\n")

    def close(self) -> tuple[str, int]:
        self.zip.end()
        self.zip.begin(INDEX)
        for k in range(0, len(self.lines), 1000):
            self.zip.data("".join(self.lines[k : k + 1000]).encode("utf-8", "surrogatepass"))
        self.zip.end()
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines)


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes all rows (page_id, url, html); returns the manifest (path, records)
    of complete packages."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    keys = rows.select("digest", "page_id", "url").where(F.col("size") >= least_bytes)
    best = keys.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("n")).where("n > 1")
    # written, so that both sides of the join are plain exchanges, which AQE splits where one payload is frequent
    best = materialize(best.select("digest", F.col("best.page_id").alias("best_id"), F.col("best.url").alias("best_url")), "repeated")
    joined = rows.join(best.hint("shuffle_hash"), "digest", "left").select("page_id", "url", "payload", "digest", "size", "best_id", "best_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = file_system(folder)
        done: list[tuple[str, int]] = []
        package = None
        for b in common.batches_of(batches):
            for page_id, url, data, digest, size, best_id, best_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if package is None:
                    where.create_dir(root, recursive=True)
                    package = Package(where, f"{root}/{uuid.uuid4().hex}.zip")
                refers = (best_id, best_url) if best_id is not None and best_id != page_id else None
                package.add(page_id, url, data, base64.b32encode(bytes.fromhex(digest)).decode(), size, refers)
                if package.zip.at >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return materialize(joined.mapInArrow(run, "path string, records long"), "manifest")


# reading


def members(source) -> dict[str, tuple[int, int, int]]:
    """name -> (method, size of the data, offset of the local header), from the
    central directory of an open random-access file."""
    size = source.size()
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = source.read_at(size - tail_at, tail_at)
    k = tail.rfind(_END)
    if k < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, k + 10)
    if (n == 0xFFFF or _BIG in (length, start)) and k >= 20 and tail[k - 20 : k - 16] == _LOCATOR:
        at = struct.unpack_from("<Q", tail, k - 12)[0]
        end64 = source.read_at(56, at)
        if end64[:4] != _END64:
            raise ValueError("broken ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, found, at = source.read_at(length, start), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, _, _, _, packed, plain, name_n, extra_n, note_n = struct.unpack_from("<HHHIIIHHH", directory, at + 10)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_n].decode("utf-8", "replace")
        extra, e = directory[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while e + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: only the fields that are all ones, in this order
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, e + 4))
                plain, packed, offset = (next(wide) if v == _BIG else v for v in (plain, packed, offset))
            e += 4 + width
        found[name] = (method, packed, offset)
        at += 46 + name_n + extra_n + note_n
    return found


def data_start(source, header_at: int) -> int:
    head = source.read_at(30, header_at)
    if head[:4] != _LOCAL:
        raise ValueError("broken local header")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return header_at + 30 + name_n + extra_n


def stored(source, found: dict, suffixes: tuple[str, ...]) -> Iterator[tuple[str, int, int]]:
    """(name, start, size) of the stored members with one of the suffixes."""
    for name, (method, size, at) in sorted(found.items()):
        if name.endswith(suffixes):
            if method:
                raise ValueError(f"{name} is compressed: its records have no offsets to read at")
            yield name, data_start(source, at), size


def locate(manifest: DataFrame, lines: int = INDEX_LINES) -> DataFrame:
    """(path, archive_at, index_at, index_bytes): for each package the start of
    its archive and stretches of whole lines of its index."""
    scheme = _scheme(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = file_system(scheme + path)
                with where.open_input_file(name) as source:
                    found = members(source)
                    archive = next(iter(stored(source, found, (".warc.gz", ".warc"))))
                    _, start, size = next(iter(stored(source, found, (".cdxj", ".cdx"))))
                    cuts, seen = [0], 0
                    for lo in range(0, size, READ_BYTES):
                        chunk, at = source.read_at(min(READ_BYTES, size - lo), start + lo), -1
                        while (at := chunk.find(b"\n", at + 1)) >= 0:
                            seen += 1
                            if seen % lines == 0:
                                cuts.append(lo + at + 1)
                    if cuts[-1] < size:
                        cuts.append(size)
                    parts = [(start + x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(parts)), pa.array([archive[1]] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int64())], names=["path", "archive_at", "index_at", "index_bytes"])

    return manifest.select("path").mapInArrow(run, "path string, archive_at long, index_at long, index_bytes long")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_records(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of all packages: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to (and payload). A response whose
    payload does not have the digest it names is an error."""
    spark = manifest.sparkSession
    scheme = _scheme(spark)
    stretches = materialize(locate(manifest), "stretches")
    tasks = max(1, min(stretches.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, archive_at, index_at, index_bytes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                where, name = file_system(scheme + path)
                with where.open_input_file(name) as source:
                    spots = [json.loads(line[line.index(b" {") + 1 :]) for line in source.read_at(index_bytes, index_at).splitlines()]
                    spots = [(s["offset"], s["length"]) for s in spots]
                    lo = 0
                    while lo < len(spots):
                        hi = lo + 1  # neighbours come in one read
                        while hi < len(spots) and spots[hi][0] == sum(spots[hi - 1]) and sum(spots[hi]) - spots[lo][0] <= READ_BYTES:
                            hi += 1
                        chunk = source.read_at(sum(spots[hi - 1]) - spots[lo][0], archive_at + spots[lo][0])
                        rows = [row(chunk[o - spots[lo][0] : o - spots[lo][0] + n], with_payload) for o, n in spots[lo:hi]]
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        lo = hi

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema([*fields, *([("payload", pa.binary())] if with_payload else [])])
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return stretches.repartition(tasks, "path", "index_at").mapInArrow(run, ddl)


def row(member: bytes, with_payload: bool) -> dict:
    fields, block = parse(gzip.decompress(member))
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    out = {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None}
    return out | ({"payload": payload if kind == "response" else None} if with_payload else {})


def _scheme(spark) -> str:
    """What stands before the paths that pyarrow's file systems return."""
    root = scratch_dir(spark)
    return root[: len(root) - len(file_system(root)[1])]


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to packages and read back. The cases are those of the
    module."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_packages(pages, f"{scratch_dir(spark)}/packages")
    return read_records(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p
), best AS (SELECT h, max(page_id) AS best_id, count(*) AS k FROM d GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN k > 1 AND best_id IS NOT NULL AND page_id IS DISTINCT FROM best_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND page_id IS DISTINCT FROM best_id THEN best_id END AS refers_to
FROM d JOIN best USING (h)
"""
