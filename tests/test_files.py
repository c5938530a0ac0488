import json
import os
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexorder.functions.ints import (pack_big_endian, pack_little_endian, unpack_big_endian,
                                     unpack_little_endian)
from lexorder.plans.suffix_array import sort_texts, suffix_array
from lexorder.sources import files
from lexorder.sources.files import (export_packed, import_packed, read_text_chunks, read_texts,
                                    write_suffix_array, write_texts)
from lexorder.sources.texts import explode_symbols
from lexorder.staging import qualified, shared_dir
from tests import model

TEXT = b"mississippi" * 60


@pytest.fixture
def sa(spark):
    rows = [(1, TEXT), (2, b"banana"), (7, b"a")]
    return suffix_array(spark.createDataFrame(rows, "id long, t binary"), "id", "t")


@pytest.mark.parametrize("width", [2, 3, 5, 8])
def test_packed_round_trip(spark, sa, tmp_path, width):
    folder = str(tmp_path / "out")
    export_packed(sa, folder, width=width, max_records=100)
    parts = json.load(open(f"{folder}/_parts.json"))
    assert max(os.path.getsize(f"{folder}/{n}") for n in parts) <= 100 * width
    raw = b"".join(open(f"{folder}/{n}", "rb").read() for n in parts)
    values = [int.from_bytes(raw[i:i + width], "little") for i in range(0, len(raw), width)]
    assert values == [p for t in (TEXT, b"banana", b"a") for p in model.suffix_array(t)]
    back = import_packed(spark, folder, width)
    assert back.exceptAll(sa).count() == 0 and sa.exceptAll(back).count() == 0


def test_ranks_and_texts_are_read_from_their_bytes(spark, sa, tmp_path):
    folder = str(tmp_path / "out")
    export_packed(sa, folder, max_records=100)

    def read(**wanted):
        """The rows, and the bytes of the partitions that the reader chose."""
        beg, stop = wanted.get("ranks", (0, files.WHOLE))
        parts = files.PackedReader({
            "path": f"file:{folder}", "width": "5", "beg": str(beg), "stop": str(stop),
            "texts": json.dumps(wanted.get("texts"))}).partitions()
        rows = import_packed(spark, folder, **wanted)
        assert rows.exceptAll(sa).count() == 0
        return rows.count(), 5 * sum(part.stop - part.beg for part in parts)

    size = len(TEXT) + 7
    assert read() == (size, 5 * size)
    assert read(ranks=(90, 210)) == (120, 600)
    assert read(texts=[2]) == (6, 30)
    assert read(texts=[1, 7], ranks=(0, 3)) == (4, 20)
    assert read(texts=[5]) == (0, 0)


def test_many_texts_are_few_partitions(spark, tmp_path, monkeypatch):
    """Ranges of ranks lie apart in a part, one stretch a text; a partition has many of them."""
    rows = spark.range(300).selectExpr("id", "concat('banana', id) AS t")
    sa, folder = suffix_array(rows, "id", "t").coalesce(1), str(tmp_path / "out")
    export_packed(sa, folder, rows=1)
    options = {"path": f"file:{folder}", "width": "5", "beg": "2", "stop": "5", "texts": "null"}
    held = len(json.load(open(f"{folder}/_parts.json")))
    assert len(files.PackedReader(options).partitions()) <= held
    got = import_packed(spark, folder, ranks=(2, 5))
    wanted = sa.filter("rank BETWEEN 2 AND 4")
    assert got.count() == 900
    assert got.exceptAll(wanted).count() == 0
    # A stretch may go on in the next batch and in the next partition.
    monkeypatch.setattr(files, "BATCH", 7)
    monkeypatch.setattr(files, "SPLIT", 5 * 100)
    reader, read = files.PackedReader(options), []
    for part in reader.partitions():
        assert part.stop - part.beg <= 100
        read += [row for batch in reader.read(part) for row in batch.to_pylist()]
    assert sorted(tuple(r.values()) for r in read) == sorted(map(tuple, wanted.collect()))


def test_chunks_are_read_from_their_bytes(spark, tmp_path):
    (tmp_path / "t").write_bytes(TEXT)
    options = {"path": f"file:{tmp_path}/t", "width": "1", "chunk": "64", "halo": "8"}
    parts = files.TextFileReader(options | {"beg": "130", "stop": "200"}).partitions()
    assert [(p.beg, p.stop) for p in parts] == [(128, 200)]
    some = read_text_chunks(spark, str(tmp_path / "t"), chunk=64, halo=8, positions=(130, 200))
    whole = read_text_chunks(spark, str(tmp_path / "t"), chunk=64, halo=8)
    rows = some.chunks.orderBy("chunk_id").collect()
    assert rows == whole.chunks.filter("chunk_id IN (2, 3)").orderBy("chunk_id").collect()


def test_paths_without_a_scheme_are_in_the_default_file_system(spark, tmp_path):
    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./data", f"file://{tmp_path}")
    try:
        assert qualified(spark, "/data/x") == "viewfs://store/data/x"
        assert qualified(spark, f"file:{tmp_path}") == f"file:{tmp_path}"
    finally:
        conf.set("fs.defaultFS", before or "file:///")


def test_existing_output_is_kept_unless_overwritten(spark, sa, tmp_path):
    folder = str(tmp_path / "out")
    export_packed(sa, folder)
    with pytest.raises(FileExistsError):
        export_packed(sa, folder)
    export_packed(sa.filter("text_id = 2"), folder, mode="overwrite")
    assert import_packed(spark, folder).count() == 6
    assert len(os.listdir(folder)) == 2         # one folder of parts, and the list


def test_failed_overwrite_keeps_what_was_there(spark, sa, tmp_path):
    folder = str(tmp_path / "out")
    export_packed(sa, folder, width=2)
    with pytest.raises(Exception, match="does not fit"):
        export_packed(sa, folder, width=1, mode="overwrite")
    assert import_packed(spark, folder, width=2).exceptAll(sa).count() == 0


def test_an_export_may_overwrite_what_it_reads(spark, sa, tmp_path):
    folder = str(tmp_path / "out")
    export_packed(sa, folder)
    export_packed(import_packed(spark, folder).filter("text_id <> 1"), folder, mode="overwrite")
    assert import_packed(spark, folder).count() == 7


def test_only_finished_exports_are_read_or_replaced(spark, sa, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "mine.txt").write_text("x")
    with pytest.raises(FileNotFoundError, match="finished"):
        import_packed(spark, str(tmp_path / "other"))
    with pytest.raises(FileExistsError, match="something else"):
        export_packed(sa, str(tmp_path / "other"), mode="overwrite")


def test_texts_to_files_and_back(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "é x"), ("c", ""), ("d", None)], "id string, t string")
    write_texts(df, "id", "t", str(tmp_path / "t"))
    got = {unquote(r.text_id.rsplit("/", 1)[1]): bytes(r.text)
           for r in read_texts(spark, str(tmp_path / "t")).collect()}
    assert got == {"a/b.txt": "é x".encode()}         # an empty file is no row
    assert (tmp_path / "t" / "c.txt").read_bytes() == b""


def test_position_that_does_not_fit_is_an_error(sa, tmp_path):
    with pytest.raises(Exception, match="does not fit"):
        export_packed(sa, str(tmp_path / "out"), width=1)


def test_string_ids(spark, tmp_path):
    df = spark.createDataFrame([("x", "banana"), ("y", "abc")], "id string, t string")
    export_packed(suffix_array(df, "id", "t"), str(tmp_path / "out"))
    got = import_packed(spark, str(tmp_path / "out")).orderBy("text_id", "rank").collect()
    assert model.grouped(got, lambda r: r.pos) == {"x": [5, 3, 1, 0, 4, 2], "y": [0, 1, 2]}


def test_parquet_sink(spark, sa, tmp_path):
    folder = str(tmp_path / "out")
    write_suffix_array(sa, folder, max_records=200)
    assert spark.read.parquet(folder).exceptAll(sa).count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        write_suffix_array(sa, folder)


@pytest.mark.parametrize("shape", [{}, {"chunk": 50, "halo": 9}])
def test_text_files(spark, tmp_path, shape):
    (tmp_path / "a.txt").write_bytes(TEXT)
    (tmp_path / "b.txt").write_bytes(b"banana")
    got = model.grouped(sort_texts(read_text_chunks(spark, str(tmp_path), **shape))
                        .orderBy("text_id", "rank").collect(), lambda r: r.pos)
    assert got == {str(tmp_path / "a.txt"): model.suffix_array(TEXT),
                   str(tmp_path / "b.txt"): model.suffix_array(b"banana")}
    whole = suffix_array(read_texts(spark, str(tmp_path)), "text_id", "text")
    assert whole.count() == len(TEXT) + 6


@pytest.mark.parametrize("width", [2, 3, 4, 5, 6, 8])
def test_wide_symbol_files(spark, tmp_path, width):
    symbols = np.random.default_rng(width).integers(0, 1 << (8 * width - 1), 60).tolist() * 2
    path = tmp_path / "wide.bin"
    path.write_bytes(b"".join(s.to_bytes(width, "little") for s in symbols))
    texts = read_text_chunks(spark, str(path), symbol_bytes=width, chunk=32, halo=8)
    assert [r.sym for r in explode_symbols(texts).orderBy("pos").collect()] == symbols
    got = [r.pos for r in sort_texts(texts).orderBy("rank").collect()]
    assert got == model.suffix_array(symbols)


def test_partial_symbol_is_an_error(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole symbols"):
        read_text_chunks(spark, str(tmp_path / "t.bin"), symbol_bytes=2).chunks.collect()


@pytest.mark.parametrize("width", [3, 5, 6, 8])
def test_integers_as_bytes(spark, width):
    values = [0, 1, 255, 256, (1 << (8 * min(width, 7))) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    value = F.col("v")
    for row in df.select("v", pack_big_endian(value, width).alias("b"),
                         pack_little_endian(value, width).alias("l"),
                         unpack_big_endian(pack_big_endian(value, width)).alias("vb"),
                         unpack_little_endian(pack_little_endian(value, width), width)
                         .alias("vl")).collect():
        assert bytes(row.b) == row.v.to_bytes(width, "big")
        assert bytes(row.l) == row.v.to_bytes(width, "little")
        assert row.vb == row.vl == row.v


def test_stage_tables_go_to_the_named_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
