"""Texts in flat files, and suffix arrays in Parquet or in packed files.

A text file is fixed-width unsigned symbols, low byte first, with no header; its length is its
size over the symbol width.  A packed suffix array is a folder of part files of ``width``-byte
positions, low byte first, whose name order is ``(text_id, rank)`` order, so that the parts of one
text, joined, are its suffix array.  A small Parquet file next to each part tells which ranks of
which texts it holds.  A list of the parts, written last and in one step, makes an export valid:
until then the export before it is what is read, and a folder without a list is no export.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader,
                                    InputPartition, WriterCommitMessage)

from lexorder.sources.texts import CHUNK, HALO, Texts, check_shape
from lexorder.staging import qualified, tasks_for

SPLIT = 64 << 20        # bytes of a file that one task reads
BATCH = 1 << 17         # positions handled at once inside a task
PIECES = 256            # small index tables of a part that are put together
WHOLE = 1 << 62         # beyond every position and rank


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that has its scheme, and the path in it."""
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _index_of(part: str) -> str:
    """The hidden file that tells what a part file holds."""
    folder, _, name = part.rpartition("/")
    return f"{folder}/_{name}.index"


PARTS = "_parts.json"


def _parts(fs: pafs.FileSystem, root: str) -> list[str] | None:
    """The parts that a folder's list names, in order; None without a list."""
    if fs.get_file_info(f"{root}/{PARTS}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/{PARTS}") as file:
        return [f"{root}/{name}" for name in json.loads(file.read())]


def _files(path: str) -> list[pafs.FileInfo]:
    """The data files of a folder, or the one file named, in name order."""
    fs, inner = _open(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [info]
    parts = _parts(fs, inner)
    if parts is not None:
        return fs.get_file_info(parts)
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=False))
    return sorted((f for f in found if f.type == pafs.FileType.File
                   and f.base_name[0] not in "._"),
                  key=lambda f: f.base_name)


@dataclass
class FileRange(InputPartition):
    path: str
    beg: int        # first symbol or element
    stop: int
    size: int       # symbols or elements in the whole file

    def __post_init__(self):
        super().__init__((self.path, self.beg))


class TextFiles(DataSource):
    """Packed chunks of flat files; the text id is the file's path."""

    @classmethod
    def name(cls) -> str:
        return "lexorder_text_files"

    def schema(self) -> str:
        return ("text_id string, chunk_id long, beg long, len int, last boolean, prev binary, "
                "data binary")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TextFileReader(self.options)


class TextFileReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.width = int(options["width"])
        self.chunk = int(options["chunk"])
        self.halo = int(options["halo"])
        self.beg, self.stop = int(options["beg"]), int(options["stop"])

    def partitions(self) -> list[FileRange]:
        step = max(1, SPLIT // (self.chunk * self.width)) * self.chunk
        first = self.beg // self.chunk * self.chunk
        ranges = []
        for file in _files(self.path):
            if file.size % self.width:
                raise ValueError(f"{file.path}: {file.size} bytes are not whole symbols of "
                                 f"{self.width} bytes")
            size = file.size // self.width
            stop = min(size, self.stop)
            ranges += [FileRange(file.path, beg, min(beg + step, stop), size)
                       for beg in range(first, stop, step)]
        return ranges or [FileRange("", 0, 0, 0)]

    def read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        if part.stop == 0:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(part.path) as file:
            for beg in range(part.beg, part.stop, self.chunk):
                own = min(self.chunk, part.size - beg)
                first = max(beg - 1, 0)
                stop = min(beg + own + self.halo, part.size)
                raw = np.frombuffer(file.read_at((stop - first) * self.width,
                                                 first * self.width), np.uint8)
                raw = raw.reshape(-1, self.width)[:, ::-1]      # high byte first
                data = raw[beg - first:].tobytes()
                prev = raw[0].tobytes() if first < beg else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path]), pa.array([beg // self.chunk], pa.int64()),
                     pa.array([beg], pa.int64()), pa.array([own], pa.int32()),
                     pa.array([beg + own == part.size]), pa.array([prev], pa.binary()),
                     pa.array([data], pa.binary())],
                    names=["text_id", "chunk_id", "beg", "len", "last", "prev", "data"])


def read_text_chunks(spark: SparkSession, path: str, symbol_bytes: int = 1, chunk: int = CHUNK,
                     halo: int = HALO, positions: tuple[int, int] | None = None) -> Texts:
    """Files of any length (a file or a folder on a shared file system) as packed chunks.

    Each task reads its own byte range with the look-ahead it needs.  With ``positions`` (from,
    to) only the chunks that hold any of them are read, and the others are left out.
    """
    check_shape(chunk, halo)
    spark.dataSource.register(TextFiles)
    beg, stop = positions or (0, WHOLE)
    chunks = (spark.read.format(TextFiles.name()).option("width", symbol_bytes)
              .option("chunk", chunk).option("halo", halo).option("beg", max(beg, 0))
              .option("stop", stop).load(qualified(spark, path)))
    return Texts(chunks, symbol_bytes, chunk, halo)


def write_texts(df: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Write every text (string or binary) that is not null to a file ``<id>.txt`` in a folder.

    A task that runs again writes the same files.
    """
    path = qualified(df.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        for batch in batches:
            for name, text in zip(*(column.to_pylist() for column in batch.columns)):
                with fs.open_output_stream(f"{root}/{quote(name, safe='')}.txt",
                                           compression=None) as file:
                    file.write(text)
            yield batch.slice(0, 0)

    fs, root = _open(path)
    fs.create_dir(root, recursive=True)
    named = df.select(F.col(id_col).cast("string").alias("id"),
                      F.col(text_col).cast("binary").alias("text")).filter("text IS NOT NULL")
    named.mapInArrow(write, named.schema).write.format("noop").mode("overwrite").save()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Byte files of less than 2 GB as one row each: ``texts(text_id, text)``."""
    return spark.read.format("binaryFile").load(path).selectExpr("path AS text_id",
                                                                 "content AS text")


def write_suffix_array(sa: DataFrame, path: str, mode: str = "errorifexists",
                       rows: int | None = None, max_records: int = 0) -> None:
    """Write ``(text_id, rank, pos)`` as Parquet in ``(text_id, rank)`` order.

    ``rows`` (if known) sets the number of tasks, ``max_records`` bounds a file (0: no bound).
    """
    order = ["text_id", "rank"]
    ranged = (sa.repartitionByRange(tasks_for(sa.sparkSession, rows), *order) if rows
              else sa.repartitionByRange(*order))
    (ranged.sortWithinPartitions(*order).write.mode(mode)
     .option("maxRecordsPerFile", max_records).parquet(path))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class PackedPositions(DataSource):
    """Packed suffix arrays; the schema of a read is that of the index next to the parts."""

    @classmethod
    def name(cls) -> str:
        return "lexorder_packed"

    def schema(self) -> T.StructType:
        parts = _files(self.options["path"])
        kind = T.LongType()
        if parts:
            index = pq.read_schema(_index_of(parts[0].path),
                                   filesystem=_open(self.options["path"])[0])
            if pa.types.is_string(index.field("text_id").type):
                kind = T.StringType()
        return T.StructType([T.StructField("text_id", kind),
                             T.StructField("rank", T.LongType()),
                             T.StructField("pos", T.LongType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PackedReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PackedWriter(self.options)


class PackedWriter(DataSourceArrowWriter):
    """Each task writes files of its own in the job's folder; the commit lists what it reports."""

    def __init__(self, options):
        self.path = options["path"]
        self.width = int(options["width"])
        self.limit = int(options["max_records"]) or 1 << 62
        self.job = f"parts-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        fs, root = _open(self.path)
        folder = f"{root}/{self.job}"
        fs.create_dir(folder, recursive=True)
        written, out, room, index = [], None, 0, []

        def close():
            out.close()
            table = pa.concat_tables(index)
            pq.write_table(table, _index_of(written[-1]), filesystem=fs)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if room == 0:
                    if out is not None:
                        close()
                    written.append(f"{folder}/part-{context.partitionId():06d}-"
                                   f"{len(written):06d}-{context.taskAttemptId()}"
                                   f".sa{self.width}")
                    out, room, index = fs.open_output_stream(written[-1]), self.limit, []
                piece = batch.slice(at, min(room, BATCH))
                out.write(self.pack(piece.column("pos").to_numpy()).tobytes())
                index.append(self.runs(piece))
                if len(index) > PIECES:
                    index = [pa.concat_tables(index).combine_chunks()]
                at += piece.num_rows
                room -= piece.num_rows
        if out is not None:
            close()
        return Written(written)

    def pack(self, pos: np.ndarray) -> np.ndarray:
        if len(pos) and (pos.min() < 0 or (self.width < 8 and pos.max() >> (8 * self.width))):
            raise ValueError(f"a position does not fit {self.width} bytes")
        return np.ascontiguousarray(
            pos.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.width])

    @staticmethod
    def runs(piece: pa.RecordBatch) -> pa.Table:
        """The texts of a piece, in order, with their first rank and row count."""
        text = piece.column("text_id")
        change = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1))
        starts = np.concatenate([[0], np.flatnonzero(change.to_numpy(False)) + 1])
        stops = np.append(starts[1:], piece.num_rows)
        return pa.table({"text_id": text.take(pa.array(starts)),
                         "rank": piece.column("rank").take(pa.array(starts)),
                         "count": stops - starts})

    def commit(self, messages: list) -> None:
        fs, root = _open(self.path)
        names = sorted(path.removeprefix(f"{root}/") for message in messages
                       if message is not None for path in message.files)
        with fs.open_output_stream(f"{root}/{PARTS}.{self.job}") as file:
            file.write(json.dumps(names).encode())
        fs.move(f"{root}/{PARTS}.{self.job}", f"{root}/{PARTS}")
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=False)):
            if info.base_name.startswith("parts-") and info.base_name != self.job:
                fs.delete_dir(info.path)        # what the export before this one wrote

    def abort(self, messages: list) -> None:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class PackedReader(DataSourceReader):
    """Reads parts, or of the texts and ranks that are wanted the bytes that hold them.

    A range of a partition counts wanted elements; the task finds in the part's index where they
    lie.  So the driver sees one part's index at a time, and keeps nothing of a text.
    """

    def __init__(self, options):
        self.path = options["path"]
        self.width = int(options["width"])
        wanted = json.loads(options["texts"])
        self.wanted = None if wanted is None else set(wanted)
        self.beg, self.stop = int(options["beg"]), int(options["stop"])

    def partitions(self) -> list[FileRange]:
        """Ranges of the wanted elements of each part: as many as these fill, however they lie."""
        step = SPLIT // self.width
        fs, _ = _open(self.path)
        everything = self.wanted is None and self.beg <= 0 and self.stop >= WHOLE
        ranges = []
        for file in _files(self.path):
            if file.size % self.width:
                raise ValueError(f"{file.path} is not whole elements of {self.width} bytes")
            size = file.size // self.width
            if not everything:
                size = int(self.wanted_of(self.index(fs, file.path))[1].sum())
            ranges += [FileRange(file.path, beg, min(beg + step, size), size)
                       for beg in range(0, size, step)]
        return ranges or [FileRange("", 0, 0, 0)]

    def index(self, fs: pafs.FileSystem, part: str) -> pa.Table:
        """What a part holds; the texts only if some are chosen by name."""
        columns = ["rank", "count"] if self.wanted is None else ["text_id", "rank", "count"]
        return pq.read_table(_index_of(part), filesystem=fs, columns=columns)

    def wanted_of(self, index: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of each run of a part: its first element that is wanted, and how many are."""
        rank, count = (index.column(c).to_numpy() for c in ("rank", "count"))
        first = np.maximum(self.beg - rank, 0)
        size = np.maximum(np.minimum(self.stop - rank, count) - first, 0)
        if self.wanted is not None:
            text = index.column("text_id")
            chosen = pc.is_in(text, pa.array(list(self.wanted), text.type))
            size = np.where(chosen.to_numpy(), size, 0)
        return first, size

    def read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        if part.stop == 0:
            return
        fs, _ = _open(self.path)
        index = pq.read_table(_index_of(part.path), filesystem=fs)
        first, size = self.wanted_of(index)
        runs = np.flatnonzero(size)
        first, upto = first[runs], np.cumsum(size[runs])
        # Of the first wanted element of a run: its rank, and where it is in the part.
        ranks = index.column("rank").to_numpy()[runs] + first
        count = index.column("count").to_numpy()
        begs = (np.cumsum(count) - count)[runs] + first
        before = upto - size[runs]
        texts = index.column("text_id").combine_chunks().take(pa.array(runs))
        with fs.open_input_file(part.path) as file:
            for beg in range(part.beg, part.stop, BATCH):
                nth = np.arange(beg, min(beg + BATCH, part.stop))
                run = np.searchsorted(upto, nth, "right")
                inside = nth - before[run]
                at = begs[run] + inside
                # What touches is read at once.
                cuts = np.flatnonzero(np.diff(at) != 1) + 1
                raw = b"".join(file.read_at((stop - start) * self.width, int(at[start]) * self.width)
                               for start, stop in zip([0, *cuts.tolist()],
                                                      [*cuts.tolist(), len(at)]))
                wide = np.zeros((len(at), 8), dtype=np.uint8)
                wide[:, :self.width] = np.frombuffer(raw, np.uint8).reshape(-1, self.width)
                yield pa.RecordBatch.from_arrays(
                    [texts.take(pa.array(run)), pa.array(ranks[run] + inside),
                     pa.array(wide.view("<u8").ravel().astype(np.int64))],
                    names=["text_id", "rank", "pos"])


def export_packed(sa: DataFrame, path: str, width: int = 5, mode: str = "errorifexists",
                  rows: int | None = None, max_records: int = 0) -> None:
    """Write a suffix array (long or string ids) as packed positions of ``width`` bytes.

    ``mode`` is ``'errorifexists'`` or ``'overwrite'``, which leaves an export that is there in
    force until the new one is whole; ``max_records`` bounds a part (0: none).
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode must be 'errorifexists' or 'overwrite'")
    if not isinstance(sa.schema["text_id"].dataType, (T.LongType, T.StringType)):
        raise ValueError("packed suffix arrays take long or string text ids")
    if not 1 <= width <= 8:
        raise ValueError("width must be between 1 and 8 bytes")
    path = qualified(sa.sparkSession, path)
    fs, root = _open(path)
    there = fs.get_file_info(root).type != pafs.FileType.NotFound
    if there and mode == "errorifexists":
        raise FileExistsError(path)
    if there and _parts(fs, root) is None and fs.get_file_info(pafs.FileSelector(root)):
        raise FileExistsError(f"{path} holds something else than an export")
    fs.create_dir(root, recursive=True)
    spark = sa.sparkSession
    spark.dataSource.register(PackedPositions)
    order = ["text_id", "rank"]
    ranged = (sa.repartitionByRange(tasks_for(spark, rows), *order) if rows
              else sa.repartitionByRange(*order))
    (ranged.sortWithinPartitions(*order).select("text_id", "rank", "pos")
     .write.format(PackedPositions.name()).mode("append").option("width", width)
     .option("max_records", max_records).save(path))


def import_packed(spark: SparkSession, path: str, width: int = 5, texts: list | None = None,
                  ranks: tuple[int, int] | None = None) -> DataFrame:
    """Read what ``export_packed`` wrote: ``(text_id, rank, pos)``.

    With ``texts`` only those, and with ``ranks`` (from, to) only these of each text: the parts'
    indexes tell which bytes hold them, and no others are read.
    """
    path = qualified(spark, path)
    if _parts(*_open(path)) is None:
        raise FileNotFoundError(f"{path} holds no finished export")
    spark.dataSource.register(PackedPositions)
    beg, stop = ranks or (0, WHOLE)
    return (spark.read.format(PackedPositions.name()).option("width", width)
            .option("texts", json.dumps(texts)).option("beg", beg).option("stop", stop).load(path))
