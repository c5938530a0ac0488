import gzip
import hashlib
import io
import json
import random
import zlib

import pyarrow.fs as pafs
import pytest

from lexorder.llm import warc as W
from lexorder.staging import Stages

PAGES = "page_id long, url string, html string"


def some_pages():
    rng = random.Random(3)
    long = "<p>" + "é long text " * 120 + "</p>"
    rows = [(i, f"http://x.example/{i}", "".join(rng.choices("ab <>\r\n\0", k=rng.randint(0, 3000))))
            for i in range(60)]
    rows += [(100 + i, "http://x.example/same", long) for i in range(30)]
    rows += [(200 + i, "http://x.example/small", "x" * 999) for i in range(4)]
    rows += [(300, None, None), (301, "a b\r\nWARC-Type: evil", ""), (302, "u", "y" * 1000),
             (303, "u", "y" * 1000), (303, "u", "y" * 1000), (None, "u", "y" * 1000),
             (400, "big", "z" * 3_000_000), (401, "u", "WARC/1.1\r\n\r\n" * 100)]
    return rows


def brute(rows):
    largest = {}
    for page_id, _, html in rows:
        if html and len(html.encode()) >= 1000 and page_id is not None:
            largest[html] = max(page_id, largest.get(html, page_id))
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        target = largest.get(html)
        revisit = target is not None and page_id is not None and page_id < target
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(),
                    "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = some_pages()
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS path", "2 AS digest")
    for size in (W.ARCHIVE_BYTES, 5000):
        got = W.round_trip(spark, pages.repartition(3), archive_bytes=size)
        assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type",
                               "refers_to"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert W.round_trip(spark, spark.createDataFrame([], PAGES)).collect() == []


def test_files(spark, tmp_path):
    pages = spark.createDataFrame(some_pages(), PAGES).coalesce(2)
    written = W.write_archives(W.record_kinds(pages, Stages(spark)), f"{tmp_path}/a").collect()
    assert sum(r["records"] for r in written) == len(some_pages())
    for r in written:
        raw = open(r["path"], "rb").read()
        stream = zlib.decompressobj(31)
        whole = stream.decompress(raw)
        assert not stream.unused_data                       # one stream for the file
        fs = pafs.LocalFileSystem()
        index = W.normalise_file(fs, r["path"], f"{r['path']}.normal")
        assert len(index) == r["records"]
        normal = open(f"{r['path']}.normal", "rb").read()
        assert gzip.decompress(normal) == whole             # the same records, byte for byte
        side = [json.loads(x) for x in open(f"{r['path']}.normal.idx")]
        at = 0
        for entry in side:
            assert entry["offset"] == at
            member = zlib.decompressobj(31)
            part = member.decompress(normal[at:at + entry["length"]])
            assert member.eof and not member.unused_data and part.startswith(b"WARC/1.1\r\n")
            at += entry["length"]
        assert at == len(normal)


def test_streams_in_small_pieces(monkeypatch):
    monkeypatch.setattr(W, "PIECE", 7)
    data = bytes(range(256)) * 20
    packed = gzip.compress(data[:1000]) + gzip.compress(b"") + gzip.compress(data[1000:])
    stream = W.Inflated(io.BytesIO(packed))
    assert b"".join(stream.take(len(data))) == data and not stream.more()


def test_cut_archives_are_errors(tmp_path):
    fs = pafs.LocalFileSystem()
    raw = gzip.compress(W.page_record(1, "u", b"x" * 5000, "d", None))
    for name, data in (("cut", raw[:-20]), ("short", gzip.compress(gzip.decompress(raw)[:-300]))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises((ValueError, zlib.error)):
            W.normalise_file(fs, f"{tmp_path}/{name}", f"{tmp_path}/{name}.out")


def test_wrong_payload_is_an_error():
    raw = W.page_record(1, "u", b"payload", hashlib.sha1(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        W.parse_record(raw)
