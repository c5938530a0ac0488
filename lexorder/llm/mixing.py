"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of the mix are dealt out as equal blocks.  Sainte-Laguë (highest quotients of 1, 3, 5,
...) gives each source a whole number of blocks for its target, and then each shard of a source a
whole number of its source's.  A shard lays its documents out in a seeded order, cuts them into
blocks, and a seeded permutation says which blocks are taken; a shard asked for more blocks than
it has takes every block that many times over first.

A source has about as many shards as the square root of its rows, so neither the shards of a
source nor the rows of a shard are ever many.  Rows alike in source, id, text hash and size are
one entry that is counted, so a repeated row makes no large group either.

Defined results: a null or empty text has size 0 and takes 0.  A null source is a source, and
comes last.  Repeated rows share out what their entry takes, as evenly as whole words go.  An
empty table gives no rows.  Extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexorder.staging import Stages

from .common import WORD, keep_rows

BLOCK = 32                  # words in a block
MOST = 3                    # times a source, a shard or a document may be taken
PRIME = 2_147_483_647       # larger than the blocks of any shard, so it permutes them


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, ...) with weights 1, 2, 3, repeating, and each source's target.

    The whole is shared by weight; what a source gets beyond ``most`` times its size is shared
    again among the others.  Each round is one sum over the sources.  The windows see one narrow
    row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", 1 + (F.row_number().over(order) - 1) % 3).withColumn(
        "cap", most * F.col("source_size"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, last = None, None
    while level is None or level != last:
        last = level
        # Compared by the same product that sets the target, so a source once full stays full.
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("cap")
        taken, open_weight = weighed.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)),
                                         F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        level = (total - (taken or 0)) / open_weight if open_weight else last
        if last is not None and level is not None:
            level = max(level, last)
        if not open_weight:
            break
    share = F.lit(0.0 if level is None else float(level)) * F.col("weight")
    return weighed.withColumn("target", F.least(share, F.col("cap").cast("double")))


def sainte_lague(parties: DataFrame, group: list[str], votes: Column, seats: Column,
                 order: list[Column]) -> DataFrame:
    """``parties`` with a column ``quota``: its group's ``seats`` by the highest quotients.

    A party starts with its rounded share, which is off by at most half a seat each; the seats
    still missing go to, or come from, the parties whose next quotient is highest, or whose last
    one is lowest.  A party is listed once for each seat that it could gain or lose: no more
    than its share of the seats that are missing, and two.  Ties go by ``order``.
    """
    of_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    started = (parties.withColumn("_votes", votes.cast("double")).withColumn("_seats", seats)
               .withColumn("_place", F.row_number().over(of_group.orderBy(*order)))
               .withColumn("_all", F.sum("_votes").over(of_group))
               .withColumn("_quota", F.when(F.col("_all") > 0, F.floor(
                   F.col("_seats") * F.col("_votes") / F.col("_all") + 0.5)).otherwise(0))
               .withColumn("_off", F.when(F.col("_all") > 0, F.col("_seats") - F.sum("_quota")
                                          .over(of_group)).otherwise(0)))
    reach = F.ceil(F.abs("_off") * F.col("_votes") / F.greatest("_all", F.lit(1e-9))) + 2
    more = F.col("_off") > 0
    steps = F.when(F.col("_off") == 0, F.array(F.lit(0))).when(
        more, F.sequence(F.lit(0), reach)).otherwise(
            F.sequence(F.lit(0), F.least(reach, F.col("_quota"))))
    listed = started.withColumn("_step", F.explode(steps.cast("array<long>"))).withColumn(
        "_quotient", F.when(F.col("_step") == 0, None)
        .when(more, F.col("_votes") / (2 * (F.col("_quota") + F.col("_step")) - 1))
        .otherwise(-F.col("_votes") / (2 * (F.col("_quota") - F.col("_step")) + 1)))
    # Step 0 keeps a party in the list; it stands last and wins nothing.
    # Among equals the first wins a seat, and the last loses one.
    ranked = of_group.orderBy(F.col("_quotient").desc_nulls_last(),
                              F.signum("_off") * F.col("_place"), "_step")
    won = (F.row_number().over(ranked) <= F.abs("_off")) & (F.col("_step") > 0)
    changed = listed.withColumn("_won", F.when(won, F.signum("_off")).otherwise(0).cast("long"))
    return (changed.groupBy(*parties.columns).agg(
        (F.first("_quota") + F.sum("_won")).cast("long").alias("quota")))


def entries(rows: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, hash, size) to entries with ``copies``, in a shard of their source."""
    alike = rows.groupBy("source", "doc_id", "hash", "size").agg(F.count("*").alias("copies"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"),
                                       F.count("*").alias("rows"))
    place = F.xxhash64(F.lit(seed), "doc_id", "hash")
    return (alike.join(targets(sizes), alike["source"].eqNullSafe(sizes["source"]))
            .drop(sizes["source"])
            .withColumn("place", place)
            .withColumn("shard", F.pmod(place, F.ceil(F.sqrt("rows")))))


def plan(rows: DataFrame, stages: Stages, block: int = BLOCK, seed: int = 13) -> DataFrame:
    """Entries with what they take: ``start`` in their shard, its ``blocks``, ``quota`` ...

    ``blocks`` equal pieces of a shard are ``size / blocks`` words long, within a word.
    """
    listed = stages.save(entries(rows, seed), "entries")
    words = F.col("size") * F.col("copies")
    shards = stages.save(
        listed.groupBy("source", "source_size", "target", "shard")
        .agg(F.sum(words).alias("shard_size")), "shards")
    # Blocks of the whole mix to sources, by target; then a source's blocks to its shards.
    sources = shards.groupBy("source", "source_size", "target").agg(
        F.count("*").alias("shards"))
    mix = sources.agg(F.sum("target")).first()[0] or 0.0
    quotas = sainte_lague(sources, [], F.col("target"), F.lit(int(mix / block + 0.5)),
                          [F.col("source").asc_nulls_last()])
    quotas = quotas.select(F.col("source").alias("of"), F.col("quota").alias("seats"))
    asked = shards.join(quotas, shards["source"].eqNullSafe(quotas["of"])).drop("of")
    dealt = (sainte_lague(asked, ["source"], F.col("shard_size"), F.col("seats"),
                          [F.col("shard")])
             .withColumn("blocks", F.greatest(F.lit(1), F.round(
                 F.col("shard_size") / block).cast("long")))
             .withColumn("quota", F.least("quota", MOST * F.col("blocks")))
             .withColumn("turn", F.pmod(F.xxhash64(F.lit(seed), "source", "shard"),
                                        F.col("blocks")))
             .select(F.col("source").alias("of"), F.col("shard").alias("in"), "shard_size",
                     "quota", "blocks", "turn"))
    laid = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "hash", "size")
    placed = listed.withColumn("stop", F.sum(words).over(laid)).withColumn(
        "start", F.col("stop") - words)
    return (placed.join(dealt, placed["source"].eqNullSafe(dealt["of"])
                        & (placed["shard"] == dealt["in"])).drop("of", "in")
            .withColumn("whole", F.floor(F.col("quota") / F.col("blocks")))
            .withColumn("rest", F.col("quota") % F.col("blocks")))


def _edge(number: Column) -> Column:
    """Where block ``number`` of a shard begins."""
    return F.floor(number * F.col("shard_size") / F.col("blocks"))


def _chosen(number: Column) -> Column:
    return F.pmod(number * F.lit(PRIME) + F.col("turn"), F.col("blocks")) < F.col("rest")


def _blocks_of(start: Column, stop: Column) -> Column:
    """Numbers of the blocks that words ``start`` to ``stop`` of a shard may touch."""
    # A product of a long and a double loses words beyond 2^53; shards are far smaller.
    per = F.col("blocks") / F.col("shard_size")
    return F.sequence(F.greatest(F.lit(0), F.floor(start * per) - 1),
                      F.least(F.col("blocks") - 1, F.floor(stop * per) + 1))


def taken_words(start: Column, stop: Column) -> Column:
    """Words between two places of a shard that the mix takes, repeats counted."""
    part = F.aggregate(_blocks_of(start, stop), F.lit(0).cast("long"), lambda total, b: total
                       + F.when(_chosen(b), F.greatest(F.lit(0).cast("long"), F.least(
                           stop, _edge(b + 1)) - F.greatest(start, _edge(b)))).otherwise(0))
    return F.when(stop > start, F.col("whole") * (stop - start)
                  + F.when(F.col("rest") > 0, part).otherwise(0)).otherwise(F.lit(0).cast("long"))


def _narrow(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"),
                       F.xxhash64(text).alias("hash"), words_in(text).alias("size"))


def _copies(planned: DataFrame) -> DataFrame:
    """Each entry once per copy, with the copy's own stretch of words."""
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return (planned.withColumn("copy", copy)
            .withColumn("from", F.col("start") + F.col("copy") * F.col("size"))
            .withColumn("to", F.col("from") + F.col("size")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        block: int = BLOCK, seed: int = 13) -> DataFrame:
    """Every row with its size, its source's size and target, and the words taken of it."""
    stages = Stages(docs.sparkSession)
    rows = stages.save(_narrow(docs, doc_id, text, source), "sizes")
    return _copies(plan(rows, stages, block, seed)).select(
        "doc_id", "size", "source_size", "target",
        taken_words(F.col("from"), F.col("to")).cast("long").alias("taken"), "source")


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               source: str = "source", block: int = BLOCK, seed: int = 13) -> DataFrame:
    """The mix itself: a whole row for each time it is taken whole, and one for a part.

    A part has the words of the chosen blocks, in order, with single spaces.  The rows have the
    columns of ``docs``, whose other columns come as they are.
    """
    stages = Stages(docs.sparkSession)
    rows, row = keep_rows(docs, stages)
    # The row id stands in for the document's, so no two rows are one entry.
    narrow = rows.select(F.col(source).cast("string").alias("source"),
                         F.col(row).alias("doc_id"), F.xxhash64(doc_id, text).alias("hash"),
                         words_in(text).alias("size"))
    planned = plan(stages.save(narrow, "sizes"), stages, block, seed)
    own = planned.select(
        F.col("doc_id").alias(row), "whole", "rest", "start", "shard_size", "blocks", "turn",
        "size", taken_words(F.col("start"), F.col("stop")).alias("taken")).filter("taken > 0")
    # The row travels as one struct, so its columns cannot clash with the plan's.
    joined = rows.select(row, F.col(text).alias("text"),
                         F.struct(*[F.col(c) for c in docs.columns]).alias("doc")).join(own, row)
    spare = F.col("taken") - F.col("whole") * F.col("size")
    pick = F.filter(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
                    lambda _, i: _chosen(_block_at(F.col("start") + i)))
    part = F.when(spare == F.col("size"), F.col("text")).otherwise(F.array_join(pick, " "))
    none = F.array().cast("array<string>")
    texts = F.concat(F.array_repeat("text", F.col("whole").cast("int")),
                     F.when(spare > 0, F.array(part)).otherwise(none))
    return (joined.withColumn("text", F.explode(texts))
            .select(F.col("doc").withField(text, F.col("text")).alias("doc")).select("doc.*"))


def _block_at(word: Column) -> Column:
    """Number of the block that holds a word: the guess by proportion, put right by one."""
    guess = F.least(F.col("blocks") - 1, F.floor(word * F.col("blocks") / F.col("shard_size")))
    return (F.when(word < _edge(guess), guess - 1)
            .when(word >= _edge(guess + 1), guess + 1).otherwise(guess))
