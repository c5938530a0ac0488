"""Suffix order induced from the order of the minus-star suffixes.

Star substrings get names, the names spell a text of at most half the length, and the suffix
order of that text is the order of the star suffixes.  Every other suffix is then ordered by its
symbols up to the next star and that star's rank, in one sort.  The number of rows falls by half
or more with each level, whatever repeats the texts hold, so this is the method for long repeats.
Texts of names that fit one chunk are sorted in the task that holds the chunk.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexorder.operators.names import reduced_text, sequence_ranks, table_names
from lexorder.operators.types import (Block, following_star, long_runs, map_blocks, star_heads,
                                      with_directory)
from lexorder.plans.doubling import (Packed, chunk_orders, prefix_of_piece, rank, read_ahead, read_size, refine,
                                     union)
from lexorder.sources.texts import Texts, pack_symbols
from lexorder.staging import Stages, tasks_for

KEY_BYTES = 16          # symbols before the next star that go into the key, in bytes
ENDS, FAR = -1, 1 << 62     # in place of a star's rank: the text ends; no star within the key


def width_of(names: int) -> int:
    """The fewest bytes that hold the names ``0 .. names - 1``."""
    return max(1, -(-max(names - 1, 0).bit_length() // 8))


def pieces(directory: DataFrame, texts: Packed, symbols: int, kind: str = "minus") -> DataFrame:
    """Own positions of the chunks, cut at stars of either kind and at long runs.

    The columns of ``run_pieces`` with ``star_pos``, the next star of the ``kind`` after the
    positions (null if there is none).  ``data`` ends with that star where it reaches it.  All
    positions of a piece are of one type, ``run_is_plus``.
    """
    ahead_of = "next_star" if kind == "minus" else "next_plus_star"

    def rows(block: Block) -> list:
        count = len(block.sym)
        following, found = following_star(block, kind)
        left, long, new = long_runs(block, symbols)
        starts = np.flatnonzero(block.own & ((block.off == 0) | block.minus_star
                                             | block.plus_star | new))
        row = block.row[starts]
        own_end = block.start[row] + block.length[row]
        size = np.minimum(np.append(starts[1:], count), own_end) - starts
        data_end = np.append(block.start[1:], count)[row]
        beyond = block.take(ahead_of, row)
        outside = np.asarray(beyond.fill_null(0)) - block.beg[row] + block.start[row]
        none = ~found[starts] & np.asarray(beyond.is_null())
        target = np.where(found[starts], following[starts], outside)
        reach = np.where(long[starts], starts, starts + size - 1) + symbols
        stop = np.minimum(reach, data_end)
        stop = np.where(none, stop, np.minimum(stop, target + 1))
        pos = block.beg[row] + block.off[starts]
        return [block.take("text_id", row), pos, size, block.slices(starts, stop),
                pa.array(left[starts], mask=~long[starts]), block.minus[starts] == 0,
                pa.array(pos + target - starts, mask=none)]

    return map_blocks(directory, texts, {
        "pos": T.LongType(), "size": T.LongType(), "data": T.BinaryType(),
        "run_left": T.LongType(), "run_is_plus": T.BooleanType(), "star_pos": T.LongType()}, rows)


def ahead(read: Column, left: Column, symbols: int, width: int) -> Column:
    """What stands for the text after the ``symbols`` symbols that were to be read.

    The rank of the next star if that is one of them (it lies ``left`` from the first); else
    whether the text ends among them.  A suffix that ends inside sorts first among equal
    prefixes, one whose star is farther sorts last.
    """
    return (F.when(left < symbols, F.col("star_rank"))
            .when(F.octet_length(read) < symbols * width, F.lit(ENDS))
            .otherwise(F.lit(FAR)).cast("long"))


def sort_keys(cut: DataFrame, star_ranks: DataFrame, width: int, symbols: int,
              texts: Packed | None = None) -> DataFrame:
    """``(text_id, pos, prefix, ahead)`` and the star of every suffix of some pieces.

    With ``texts``, if these have one chunk each, the rows are made where they are to be ranked,
    partitioned by text.

    ``prefix`` runs to the next star if that lies within ``symbols``, and ``ahead`` is its rank;
    else ``prefix`` is as long as it may be.  ``star_ranks`` are ``(text_id, star_pos,
    star_rank)``.
    """
    i = F.col("i")
    met = cut.join(star_ranks, ["text_id", "star_pos"], "left")
    if texts and texts.single:
        met = met.repartition(tasks_for(cut.sparkSession, texts.total), "text_id")
    return (met.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
            .select("text_id", (F.col("pos") + i).alias("pos"),
                    prefix_of_piece(width, symbols).alias("prefix"), "star_pos", "star_rank")
            .withColumn("ahead", ahead(F.col("prefix"), F.col("star_pos") - F.col("pos"), symbols,
                                       width)))


def _key_symbols(texts: Texts) -> int:
    return min(max(2, KEY_BYTES // texts.width), texts.halo)


def long_tails(stars: DataFrame, texts: Packed, stages: Stages, name: str) -> DataFrame:
    """``(text_id, star_idx, tail)``: the order of what follows the heads of long substrings.

    A substring is read in pieces of ``halo`` symbols, each from the one chunk that holds it, and
    the lists of the pieces' names are ranked, from 1.
    """
    halo, width = texts.halo, texts.width
    ends = texts.chunks.filter("last").select(
        "text_id", (F.col("beg") + F.col("len") - 1).alias("text_end"))
    at = F.col("pos") + (F.col("k") + 1) * halo
    read = F.substring(F.col("data"), ((F.col("at") - F.col("beg")) * width + 1).cast("int"),
                       (F.least(F.lit(halo), F.col("end_pos") + 1 - F.col("at")) * width)
                       .cast("int"))
    parts = (stars.filter("more").join(ends, "text_id")
             .withColumn("end_pos", F.coalesce("end_pos", "text_end"))
             .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(
                 f"(end_pos - pos) div {halo} - 1"))))
             .withColumn("at", at).withColumn("chunk_id", F.expr(f"at div {texts.chunk}"))
             .join(texts.chunks.select("text_id", "chunk_id", "beg", "data"),
                   ["text_id", "chunk_id"])
             .select("text_id", "star_idx", "k", read.alias("value")))
    ranked = sequence_ranks(parts, ["text_id", "star_idx"], stages, name)
    return ranked.select("text_id", "star_idx", (F.col("rank") + 1).alias("tail"))


def staged(texts: Texts, stages: Stages, name: str) -> Packed:
    """The texts with their chunks written, and their symbols counted.

    Where no text has a second chunk, they are known to be bounded groups.
    """
    chunks = stages.save(texts.chunks, name)
    total, last = chunks.agg(F.sum("len"), F.max("chunk_id")).first()
    return Packed(chunks, texts.width, texts.chunk, texts.halo, texts.single or not last,
                  total or 0)


def by_size(texts: Packed) -> list[tuple[str, Packed]]:
    """The staged texts of one chunk, which are bounded groups, and the others, with a name each."""
    if texts.single:
        return [("single", texts)]
    several = texts.chunks.filter((F.col("chunk_id") > 0) | ~F.col("last"))
    one = texts.chunks.filter((F.col("chunk_id") == 0) & F.col("last"))
    total = one.agg(F.sum("len")).first()[0]
    if not total:
        return [("long", texts)]
    return [("single", replace(texts, chunks=one, single=True, total=total)),
            ("long", replace(texts, chunks=several, total=texts.total - total))]


# How a substring stands to what was read of it, in the order of equal readings.
TEXT_ENDS, STAR_ENDS, GOES_ON = 0, 1, 2


def star_substring_order(texts: Texts, stages: Stages | None = None) -> DataFrame:
    """``(text_id, star_idx, rank, pos, tied)``: each text's star substrings in their order.

    ``rank`` is the number of smaller substrings; equal ones are ``tied``.  The one that ends the
    text is before one that is equal but for that.  Sorted most significant piece first: all
    substrings meet with their first symbols, and only those that tie read on, each time as much
    again, so nobody ever holds a whole substring.
    """
    stages = stages or Stages(texts.chunks.sparkSession)
    packed = staged(texts, stages, "order-chunks")
    depth = _key_symbols(packed)
    heads = stages.save(star_heads(with_directory(packed, stages), packed, depth), "order-heads")
    ends = packed.chunks.filter("last").select(
        "text_id", (F.col("beg") + F.col("len") - 1).alias("end_pos"))
    # A text's last substring may not have seen its end.
    heads = heads.filter("end_pos is not null").unionByName(
        heads.filter("end_pos is null").drop("end_pos").join(ends, "text_id"))

    def state(more: Column) -> Column:
        return F.when(more, GOES_ON).when(F.col("terminal"), TEXT_ENDS).otherwise(STAR_ENDS)

    also = ["star_idx", "end_pos", "terminal", "state"]
    rows = heads.withColumn("state", state(F.col("more")))
    ranked = rank(rows, ["text_id"], ["head", "state"], heads.count(), packed, stages, "order-0",
                  also=also)
    final, turn = [], 0
    while True:
        again = F.col("tied") & (F.col("state") == GOES_ON)
        final.append(ranked.filter(~again).select("text_id", "star_idx", "rank", "pos", "tied"))
        still = ranked.filter(again).select("text_id", "pos", F.col("rank").alias("base"),
                                            "star_idx", "end_pos", "terminal")
        count = still.count()
        if count == 0:
            return union(final)
        turn += 1
        more = min(depth, packed.halo)
        left = F.col("end_pos") + 1 - F.col("pos") - depth
        read = read_ahead(still, packed, depth, more, count).withColumn(
            "next", F.substring(F.col("next"), F.lit(1),
                                (F.least(left, F.lit(more)) * packed.width).cast("int"))
        ).withColumn("state", state(left > more))
        ranked = rank(read, ["text_id", "base"], ["next", "state"], count, packed, stages,
                      f"order-{turn}", read_size(packed, more, count), also).select(
            "text_id", "pos", (F.col("base") + F.col("rank")).alias("rank"), "tied", *also)
        depth += more


def star_order(texts: Packed, stages: Stages, name: str, directory: DataFrame) -> DataFrame:
    """``(text_id, star_pos, star_rank)`` of the minus-stars, by names and the text they spell.

    A text whose stars all have names of their own is in order by them; the others' texts of
    names, which have at most half the symbols, are sorted the same way.
    """
    stars = stages.save(star_heads(directory, texts), f"{name}-stars")
    total, long = stars.agg(F.count("*"), F.count_if("more")).first()
    if total == 0:
        return stars.select("text_id", F.col("pos").alias("star_pos"),
                            F.col("star_idx").alias("star_rank"))
    tails = F.lit(0).cast("long").alias("tail")
    if long:
        tailed = long_tails(stars, texts, stages, f"{name}-tails")
        stars = stages.save(stars.join(tailed, ["text_id", "star_idx"], "left").withColumn(
            "tail", F.coalesce("tail", F.lit(0))), f"{name}-tailed")
        tails = F.col("tail")
    named, n_names = table_names(
        stars.select("text_id", "star_idx", "pos", "head", tails,
                     (~F.col("terminal")).alias("goes_on")),
        ["head", "tail", "goes_on"], total, stages, name)
    named = stages.save(named.select("text_id", "star_idx", "pos", "name"), f"{name}-named")
    by_name = named.select("text_id", F.col("pos").alias("star_pos"),
                           F.col("name").alias("star_rank"))
    if n_names == total:
        return by_name
    again = stages.save(named.groupBy("text_id", "name").count().filter("count > 1")
                        .select("text_id").distinct(), f"{name}-again")
    rest = stages.save(named.join(again, "text_id", "left_semi"), f"{name}-rest")
    left, longest = rest.agg(F.count("*"), F.max("star_idx")).first()
    if left == 0:
        return by_name
    single = longest < texts.chunk
    packed = pack_symbols(reduced_text(rest), width_of(n_names), texts.chunk, texts.halo, single)
    reduced = Packed(stages.save(packed.chunks, f"{name}-reduced"), packed.width, packed.chunk,
                     packed.halo, single, left)
    # Names that fit a chunk are few enough for a task; the others go down a level.
    order = (chunk_orders(reduced) if single else induced(
        reduced, stages, f"{name}-names")).select(
        "text_id", F.col("pos").alias("star_idx"), F.col("rank").alias("star_rank"))
    ranked = rest.join(order, ["text_id", "star_idx"]).select(
        "text_id", F.col("pos").alias("star_pos"), "star_rank")
    if left == total:
        return ranked
    return by_name.join(again, "text_id", "left_anti").unionByName(ranked)


def induced(texts: Packed, stages: Stages, name: str = "induced") -> DataFrame:
    """Suffix array ``(text_id, rank, pos)`` of packed texts.

    The texts of names are sorted the same way, level by level, until the names tell the stars of
    a text apart.
    """
    symbols = _key_symbols(texts)
    inner = stages.inner(f"{name}-stars")
    directory = with_directory(texts, inner)
    stars = star_order(texts, inner, name, directory)
    keys = sort_keys(pieces(directory, texts, symbols), stars, texts.width, symbols, texts)
    first = rank(keys, ["text_id"], ["prefix", "ahead"], texts.total, texts, stages,
                 f"{name}-first", placed=True)
    inner.remove()
    return refine(first, symbols, texts, stages, name)


def induce(texts: Texts, star_sa: DataFrame, kind: str, stages: Stages | None = None,
           stars: str = "minus") -> DataFrame:
    """``(text_id, rank, pos)`` of the plus or minus suffixes, from the order of the stars.

    ``star_sa`` are the minus-star suffixes (or, with ``stars='plus'``, the plus-star suffixes) as
    ``(text_id, rank, pos)``.  A suffix is ordered by its symbols up to the next star, and then by
    that star; what lies far before its star is read on until all differ.  Suffixes of the other
    kind are not sorted.
    """
    if kind not in ("minus", "plus") or stars not in ("minus", "plus"):
        raise ValueError("kind and stars must be 'minus' or 'plus'")
    stages = stages or Stages(texts.chunks.sparkSession)
    order = star_sa.select("text_id", F.col("pos").alias("star_pos"),
                           F.col("rank").alias("star_rank"))
    return union([_induce(part, order, kind, stages.inner(name), stars)
                  for name, part in by_size(staged(texts, stages, f"{kind}-chunks"))])


def _induce(packed: Packed, order: DataFrame, kind: str, stages: Stages,
            stars: str) -> DataFrame:
    """``induce`` of texts that are staged, and all of one size."""
    symbols = _key_symbols(packed)
    cut = pieces(with_directory(packed, stages), packed, symbols, stars).filter(
        F.col("run_is_plus") == (kind == "plus"))

    def closed(read: Column, left: Column, within: int) -> Column:
        """A suffix that goes on where another one's star is has the type that the star has not.

        Among equal symbols minus comes first: before a plus-star, behind a minus-star.  As no
        plus-star has the largest symbol, that symbol after it puts it behind.
        """
        if stars == "minus":
            return read
        return F.when(left < within, F.concat(read, F.lit(b"\xff" * packed.width))).otherwise(read)

    keys = sort_keys(cut, order, packed.width, symbols, packed).withColumn("prefix", closed(
        F.col("prefix"), F.col("star_pos") - F.col("pos"), symbols))
    if not packed.single:       # a range exchange reads its rows twice
        keys = stages.save(keys, f"{kind}-keys")
    # The star of a suffix stays with it.
    also = ["star_pos", "star_rank"]
    ranked = rank(keys, ["text_id"], ["prefix", "ahead"], packed.total, packed, stages,
                  f"{kind}-0", also=also, placed=True)
    final, depth, turn = [], symbols, 0
    while True:
        final.append(ranked.filter(~F.col("tied")).select("text_id", "rank", "pos"))
        still = ranked.filter("tied").select("text_id", "pos", F.col("rank").alias("base"), *also)
        count = still.count()
        if count == 0:
            return union(final)
        turn += 1
        more = min(depth, packed.halo)
        read = read_ahead(still, packed, depth, more, count)
        left = F.col("star_pos") - F.col("pos") - depth
        shown = F.when(left < more, F.substring(
            F.col("next"), F.lit(1), ((left + 1) * packed.width).cast("int"))).otherwise(
                F.col("next"))
        rows = read.withColumn("ahead", ahead(F.col("next"), left, more, packed.width)).withColumn(
            "next", closed(shown, left, more))
        ranked = rank(rows, ["text_id", "base"], ["next", "ahead"], count, packed, stages,
                      f"{kind}-{turn}", read_size(packed, more, count), also).select(
            "text_id", "pos", (F.col("base") + F.col("rank")).alias("rank"), "tied", *also)
        depth += more
