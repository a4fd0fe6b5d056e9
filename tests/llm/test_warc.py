import base64
import gzip
import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from sessionloom.llm import warc
from sessionloom.runtime import scratch_dir

PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", None), (3, "http://a/3", ""), (4, None, "<p>same</p>"), (5, "http://a/\r\nX: y", "ünïcode ☃" * 500), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "u", "<p>same</p>"), (7, "v", "<p>same</p>"), (None, "n", "<p>same</p>"), (None, "n", "alone"), (9, "u", "x" * 300000)]


def pages(spark, rows=None):
    rows = PAGES if rows is None else rows
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, size int")


def plain(rows, least=0):
    out = []
    for k, _, h in rows:
        b = (h or "").encode()
        same = [p for p, _, o in rows if (o or "") == (h or "") and p is not None]
        revisit = len(b) >= least and same and k != max(same)
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def back(manifest):
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[c] for c in cols) for r in warc.read_records(manifest).collect()), key=str)


@pytest.mark.parametrize("least", [0, 5, 10**6])
def test_round_trip(spark, least):
    manifest = warc.write_packages(pages(spark), f"{scratch_dir(spark)}/p", least_bytes=least, package_bytes=2000)
    assert manifest.count() >= 1
    assert back(manifest) == plain(PAGES, least)
    payloads = {(r.page_id, r.payload) for r in warc.read_records(manifest, with_payload=True).collect() if r.record_type == "response"}
    assert (5, ("ünïcode ☃" * 500).encode()) in payloads


def test_zip_tools_read_the_packages(spark):
    manifest = warc.write_packages(pages(spark), f"{scratch_dir(spark)}/p")
    n = 0
    for row in manifest.collect():
        with zipfile.ZipFile(row.path) as z:
            assert z.testzip() is None
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            n += gzip.decompress(z.read(warc.ARCHIVE)).count(b"WARC-Record-ID")
    assert n == len(PAGES)


def test_no_pages(spark):
    assert back(warc.write_packages(pages(spark, []), f"{scratch_dir(spark)}/p")) == []


def test_directory_of_foreign_packages():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("archive/x.warc.gz", b"abc" * 100)
        z.writestr("notes.txt", "t" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05 not the end"
    source = pa.BufferReader(raw.getvalue())
    found = warc.members(source)
    assert found["archive/x.warc.gz"][:2] == (0, 300) and found["notes.txt"][0] == 8
    ((_, start, size),) = warc.stored(source, found, (".warc.gz",))
    assert source.read_at(size, start) == b"abc" * 100
    with pytest.raises(ValueError):
        list(warc.stored(source, found, (".txt",)))


def test_zip64_fields():
    """A writer that calls 100 bytes big has to use every ZIP64 field."""
    raw = io.BytesIO()
    w = warc.PackageWriter(raw, big=100)
    for name, data in (("a", b"x" * 150), ("b", b"y" * 20), ("archive/c.warc", b"z" * 101)):
        w.begin(name)
        w.data(data)
        w.end()
    w.close()
    source = pa.BufferReader(raw.getvalue())
    found = warc.members(source)
    assert {k: v[1] for k, v in found.items()} == {"a": 150, "b": 20, "archive/c.warc": 101}
    for name, data in (("a", b"x" * 150), ("b", b"y" * 20)):
        assert source.read_at(len(data), warc.data_start(source, found[name][2])) == data


def test_not_a_package():
    with pytest.raises(ValueError):
        warc.members(pa.BufferReader(b"nothing here"))
