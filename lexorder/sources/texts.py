"""Texts as packed chunks and as one row per symbol.

A symbol of any alphabet is held as ``width`` big-endian bytes, so a slice of a packed text
compares as ``BINARY`` exactly as its symbols compare as unsigned integers, a proper prefix
first.  Texts stay packed in chunks until a row per position is really needed: a packed chunk is
some forty times smaller than its rows, and one huge text is spread over many chunks.

Chunk columns: ``text_id``, ``chunk_id``, ``beg`` (position of the first own symbol), ``len``
(own symbols), ``last`` (whether the text ends with this chunk), ``prev`` (the symbol before
``beg``, null at the start of the text) and ``data`` (the own symbols, then up to ``halo``
symbols that follow; fewer only where the text ends).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexorder.functions.ints import pack_big_endian, unpack_big_endian

CHUNK = 1 << 16     # own symbols of a chunk
HALO = 1 << 12      # look-ahead symbols kept with it
PIECE = 1 << 8      # symbols of a chunk from which rows are made at once

WIDTH_OF_UNIT = {"byte": 1, "char": 4, "token": 8}


@dataclass(frozen=True)
class Texts:
    """A table of chunks and how it is packed."""

    chunks: DataFrame
    width: int = 1      # bytes of a symbol
    chunk: int = CHUNK  # symbols a chunk may own
    halo: int = HALO    # look-ahead symbols
    single: bool = False    # known: every text is one chunk, so a text is a bounded group


def symbol_width(unit: str, symbol_bytes: int | None = None) -> int:
    """Bytes of one packed symbol for ``unit``."""
    if unit not in WIDTH_OF_UNIT:
        raise ValueError(f"unit must be one of {sorted(WIDTH_OF_UNIT)}, not {unit!r}")
    if symbol_bytes is not None and unit == "char":
        raise ValueError("symbol_bytes does not apply to characters")
    width = symbol_bytes or WIDTH_OF_UNIT[unit]
    if not 1 <= width <= 8:
        raise ValueError("symbol_bytes must be between 1 and 8")
    return width


def packed_text(text: Column, unit: str, width: int) -> Column:
    """A text column (string, binary or integer array) as packed symbols."""
    if unit == "byte":
        return text.cast("binary")
    if unit == "char":
        return F.encode(text.cast("string"), "UTF-32")
    too_large = f"symbol does not fit {width} bytes"

    def digits(token: Column) -> Column:
        bad = token.isNull() | (token < 0)
        if width < 8:
            bad = bad | (token >= F.lit(1 << (8 * width)))
        return F.when(bad, F.raise_error(F.lit(too_large))).otherwise(
            F.lpad(F.hex(token.cast("long")), 2 * width, "0"))

    return F.unhex(F.array_join(F.transform(text, digits), ""))


def check_shape(chunk: int, halo: int) -> None:
    if not 1 <= halo <= chunk:
        raise ValueError("the halo must have between one symbol and a chunk")


def named(id_col: str) -> Column:
    """The ids of a column, for which a null is an error."""
    return F.when(F.col(id_col).isNotNull(), F.col(id_col)).otherwise(
        F.raise_error(F.lit("a text has a null id")))


def chunk_texts(df: DataFrame, id_col: str, text_col: str, unit: str = "byte",
                symbol_bytes: int | None = None, chunk: int = CHUNK, halo: int = HALO,
                tasks: int | None = None) -> Texts:
    """Cut every text of a column into packed chunks.

    ``id_col`` names a unique id of any atomic type; a null id is an error.  A null or empty text
    gives no rows.  A byte text must be whole symbols long when ``symbol_bytes`` is above one
    (otherwise an error).
    ``tasks`` spreads the chunks over that many partitions, which moves packed bytes only.
    """
    check_shape(chunk, halo)
    width = symbol_width(unit, symbol_bytes)
    packed = packed_text(F.col(text_col), unit, width)
    texts = df.select(named(id_col).alias("text_id"), packed.alias("packed"))
    size = F.octet_length("packed")
    if unit == "byte" and width > 1:
        size = F.when(size % width == 0, size).otherwise(
            F.raise_error(F.lit(f"text length is not a multiple of {width} bytes")))
    beg = F.col("chunk_id") * chunk
    at = (beg * width + 1).cast("int")
    chunks = (
        texts.filter(F.octet_length("packed") > 0)
        .withColumn("n", (size / width).cast("long"))
        .withColumn("chunk_id", F.explode(F.sequence(
            F.lit(0).cast("long"), F.expr(f"(n - 1) div {chunk}"))))
        .select("text_id", "chunk_id", beg.alias("beg"),
                F.least(F.lit(chunk), F.col("n") - beg).cast("int").alias("len"),
                (beg + chunk >= F.col("n")).alias("last"),
                F.when(F.col("chunk_id") > 0,
                       F.substring(F.col("packed"), at - width, F.lit(width))).alias("prev"),
                F.substring(F.col("packed"), at, F.lit((chunk + halo) * width)).alias("data")))
    if tasks:
        chunks = chunks.repartition(tasks, "text_id", "chunk_id")
    return Texts(chunks, width, chunk, halo)


def add_halo(texts: Texts) -> Texts:
    """Complete chunks that hold only ``text_id, chunk_id, beg, len, data`` (own symbols).

    Every chunk hands its first ``halo`` symbols to the chunk before it and its last symbol to
    the chunk after it; a chunk that is handed nothing is the last of its text.
    """
    own, width, chunk, halo = texts.chunks, texts.width, texts.chunk, texts.halo
    check_shape(chunk, halo)
    key = ["text_id", "chunk_id"]
    ahead = own.filter("chunk_id > 0").select(
        "text_id", (F.col("chunk_id") - 1).alias("chunk_id"),
        F.substring("data", 1, halo * width).alias("ahead"))
    behind = own.filter(F.col("len") == chunk).select(
        "text_id", (F.col("chunk_id") + 1).alias("chunk_id"),
        F.substring(F.col("data"), F.lit((chunk - 1) * width + 1), F.lit(width)).alias("prev"))
    whole = own.join(ahead, key, "left").join(behind, key, "left").select(
        *key, "beg", "len", F.col("ahead").isNull().alias("last"), "prev",
        F.concat("data", F.coalesce("ahead", F.lit(b""))).alias("data"))
    return Texts(whole, width, chunk, halo)


def symbol_value(symbol: Column, width: int) -> Column:
    """A packed symbol as an integer, null for null."""
    if width == 1:      # ascii() of a one-byte Latin-1 string is the byte's value
        return F.ascii(F.decode(symbol, "ISO-8859-1")).cast("long")
    return unpack_big_endian(symbol)


def explode_symbols(texts: Texts) -> DataFrame:
    """One row per symbol: ``symbols(text_id, pos, sym)``."""
    symbol = F.substring(F.col("data"), F.col("i") * texts.width + 1, F.lit(texts.width))
    value = symbol_value(symbol, texts.width)
    # A row copies what it is made of, so a chunk is cut into short pieces first.
    first = F.col("first")
    pieces = texts.chunks.withColumn("first", F.explode(F.sequence(
        F.lit(0), F.col("len") - 1, F.lit(PIECE)))).select(
        "text_id", (F.col("beg") + first).alias("beg"),
        F.least(F.lit(PIECE), F.col("len") - first).alias("len"),
        F.substring(F.col("data"), first * texts.width + 1, F.lit(PIECE * texts.width))
        .alias("data"))
    return (pieces.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
            .select("text_id", (F.col("beg") + F.col("i")).alias("pos"), value.alias("sym")))


def random_text(spark: SparkSession, n: int, sigma: int, seed: int, first: int = 0) -> DataFrame:
    """A random text of ``n`` symbols as ``(text_id, pos, sym)``.

    The symbols are ``first .. first + sigma - 1``; ``first=ord('a')`` gives random letters.
    """
    return spark.range(n).select(
        F.lit(0).cast("long").alias("text_id"), F.col("id").alias("pos"),
        (F.floor(F.rand(seed) * sigma) + first).cast("long").alias("sym"))


def pack_symbols(symbols: DataFrame, width: int, chunk: int = CHUNK, halo: int = HALO,
                 single: bool = False) -> Texts:
    """Pack ``(text_id, pos, sym)`` rows with positions ``0..n-1`` back into chunks.

    A group holds at most ``chunk`` symbols, whatever the length of its text.  ``single`` says
    that no text is longer than a chunk, so that no chunk has a neighbour to exchange with.
    """
    own = (symbols.withColumn("chunk_id", F.expr(f"pos div {chunk}"))
           .withColumn("bytes", pack_big_endian(F.col("sym"), width))
           .groupBy("text_id", "chunk_id")
           .agg(F.count("*").cast("int").alias("len"),
                F.expr("listagg(bytes) within group (order by pos)").alias("data"))
           .withColumn("beg", F.col("chunk_id") * chunk))
    if single:
        return Texts(own.select("text_id", "chunk_id", "beg", "len", F.lit(True).alias("last"),
                                F.lit(None).cast("binary").alias("prev"), "data"),
                     width, chunk, halo, single=True)
    return add_halo(Texts(own, width, chunk, min(halo, chunk)))
