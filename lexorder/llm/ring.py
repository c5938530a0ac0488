"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``nodes`` virtual nodes on a ring of hash values.  A row belongs to the first node
clockwise from its key's hash.  A shard holds no more rows than its share; what a full shard
cannot take continues clockwise to the next node.  Shares differ by one row at most, so counts do.

Rows are put in ring order by one range exchange of the rows; how many lie on each arc between two
nodes is all that the driver sees (shards times nodes numbers), and from that it settles the
overflow.  A row's place then follows from its rank on the ring.  Everything on the way is
DataFrame functions.

Defined results: null ids and texts hash like values; a null text has size 1.  Rows of one key lie
together on the ring, ordered by the text's hash and then as they were read, and are split between
tasks and, where a shard is full, between shards.  An empty table gives no rows.  Columns of the
table other than the result's are kept by ``shard_rows``.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexorder.staging import Stages, default_tasks

from .common import free_name, utf8

NODES = 64           # virtual nodes of a shard
RING = 1 << 62       # hash values on the ring
LOW = 33             # bits of Spark's row ids that count within a partition


def ring_nodes(shards: int, nodes: int, seed: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise."""
    places = [(xxhash.xxh64_intdigest(f"{shard}-{node}".encode(), seed) >> 2, shard)
              for shard in range(shards) for node in range(nodes)]
    return sorted(places)


def settle(loads: list[int], owners: list[int], shards: int) -> list[tuple[int, int]]:
    """Stretches (shard, rows) of the ring, clockwise, once nothing overflows.

    ``loads`` are the rows on each arc and ``owners`` the shard of the node that ends it.  Nodes
    are visited clockwise, again and again; each takes what waits at it as far as its shard has
    room, first what lay nearest, and passes the rest on.
    """
    total = sum(loads)
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    # What each arc's rows came to: lists of (first rank, last rank + 1, shard).
    first, at = [], 0
    for load in loads:
        first.append(at)
        at += load
    taken: list[tuple[int, int, int]] = []
    waiting: list[list[tuple[int, int]]] = [[(f, f + n)] if n else []
                                            for f, n in zip(first, loads)]
    while any(waiting):
        passed: list[list[tuple[int, int]]] = [[] for _ in loads]
        for node, queue in enumerate(waiting):
            shard = owners[node]
            for begin, end in queue:
                here = min(room[shard], end - begin)
                if here:
                    taken.append((begin, begin + here, shard))
                    room[shard] -= here
                if begin + here < end:
                    passed[(node + 1) % len(loads)].append((begin + here, end))
        waiting = passed
    taken.sort()
    return [(shard, end - begin) for begin, end, shard in taken]


def _search(bounds: list[int], value: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by halving."""
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda found, s: F.when((found + s <= len(bounds)) & (F.element_at(
            array, F.least(found + s, F.lit(len(bounds)))) <= value), found + s).otherwise(found))


def shard_rows(df: DataFrame, key: str, tie: Column, shards: int = 8, nodes: int = NODES,
               seed: int = 17) -> DataFrame:
    """``df`` with ``shard`` and ``slot``, the row's number in its shard."""
    spark = df.sparkSession
    stages = Stages(spark)
    place, rank, extra = (free_name(df, n) for n in ("ring_place", "ring_rank", "ring_tie"))
    tasks = default_tasks(spark)
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 2)
    # The last sort column tells equal rows apart, so that a hot key can be split.
    ranged = (df.withColumn(place, hashed).withColumn(extra, tie)
              .withColumn(rank, F.monotonically_increasing_id())
              .repartitionByRange(tasks, place, extra, rank)
              .sortWithinPartitions(place, extra, rank).drop(extra)
              .withColumn(rank, F.monotonically_increasing_id()))
    rows = stages.save(ranged, "ring")
    ring = ring_nodes(shards, nodes, seed)
    # Arc i ends at node i and holds the rows after node i - 1; what lies after the last node
    # goes on to the first, as arc 0 of the next turn.
    arc = _search([p for p, _ in ring], F.col(place) - 1)
    counted = dict(rows.groupBy(arc.alias("arc")).count().collect())
    loads = [counted.get(i, 0) for i in range(len(ring) + 1)]
    owners = [shard for _, shard in ring] + [ring[0][1]]
    stretches = settle(loads, owners, shards)
    starts, at, filled, bases = [], 0, [0] * shards, []
    for shard, size in stretches:
        starts.append(at)
        bases.append(filled[shard] - at)
        at, filled[shard] = at + size, filled[shard] + size
    if not starts:
        starts, bases, stretches = [0], [0], [(0, 0)]
    # Ranks: rows of earlier partitions, then the number in the own one.
    sizes = rows.groupBy(F.shiftright(F.col(rank), LOW).alias("task")).count().collect()
    before, at = {}, 0
    for task, size in sorted(sizes):
        before[task] = at
        at += size
    offsets = F.array(*[F.lit(before.get(t, 0)).cast("long")
                        for t in range(max(before, default=0) + 1)])
    ranked = rows.withColumn(rank, F.element_at(offsets, (F.shiftright(
        F.col(rank), LOW) + 1).cast("int")) + F.col(rank).bitwiseAND((1 << LOW) - 1))
    number = _search(starts, F.col(rank))
    found = free_name(ranked, "stretch")
    return (ranked.withColumn(found, number)
            .withColumn("shard", F.element_at(F.array(*[F.lit(s) for s, _ in stretches]),
                                              F.col(found)))
            .withColumn("slot", F.col(rank) + F.element_at(
                F.array(*[F.lit(b).cast("long") for b in bases]), F.col(found)))
            .drop(found, rank, place))


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8,
           nodes: int = NODES) -> DataFrame:
    """Every row's shard and slot, with counts at most one apart (law ``rows``)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"),
                       (F.octet_length(utf8(text)) + 1).cast("long").alias("size"),
                       F.crc32(utf8(text)).alias("text_crc32"))
    placed = shard_rows(rows, "doc_id", F.col("text_crc32"), shards, nodes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))
