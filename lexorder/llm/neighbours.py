"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are made to fit distances (one more coordinate fills them up to the largest norm, so the
nearest by distance is the largest by inner product) and hashed in several tables by
floor((a.x + b) / w) for a few Gaussian directions a.  A query visits in each table the buckets
that a perturbation of its own leads to, in order of the estimated chance to hold a neighbour,
which is told by its distances to the buckets' walls.  What the tables give is merged, and ranked
by the exact inner product of the original vectors in double precision.

Equal vectors are one point that carries its least ids: as ties go to smaller ids, no id beyond
the first ``top`` + 1 of a vector can be among ``top`` neighbours.  Points of a bucket are
cut into blocks of bounded size, so a bucket with a third of all points is many blocks.  Blocks are
dealt to shards, and a query travels once to each shard in which it visits any block, not once to
each bucket; a shard's queries are cut into parts too.  Of a shard only a query's best ``top`` + 1
go on.  The tables are gone through one after the other, so that the vectors are exchanged for one
at a time.  The first few visits of all queries are made first; what a query has found by then is a
bound below which later visits hand nothing on.

The number of directions grows with the logarithm of the points, so that buckets keep their size.
The number of visited buckets is fitted on a sample (``FIT_POINTS``, ``FIT_QUERIES``) until the
sample's recall reaches ``RECALL``; every vector is indexed.  Queries that have met too few points
for ``top`` neighbours by then visit twice as many buckets, and so on; those that still have too few
after ``MORE_ROUNDS`` rounds are compared with all points, in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
nor do those whose length differs from the most common one (the larger on a tie), nor rows with a
null id.  Rows that repeat an id with different vectors are separate candidates.  Fewer candidates
than asked for give fewer rows, none give none.  Extra columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexorder.staging import Stages

TABLES = 4
FIRST = 3                  # visits, times the tables, before the bound is taken
BUCKET_POINTS = 800        # points of a bucket that the number of directions aims at
WIDTH = 1.5                # of a bucket, in standard deviations of a projection
BITS = 1.46                # entropy of the bucket number along one direction at that width
MOST_DIRECTIONS = 16
FIT_POINTS = 10_000
FIT_QUERIES = 100
RECALL = 0.96
MORE_ROUNDS = 2            # of twice the visits, for queries that have met too few points
BLOCK = 2048               # points of a bucket that travel together
SHARD_BLOCKS = 8           # blocks' worth of points that a task should hold
ASKED_BLOCKS = 16          # blocks' worth of queries that a task should hold
SUMMED = 1 << 14           # pairs whose products are summed at once


@dataclass
class Hashing:
    """Directions, offsets and width of all tables."""

    directions: np.ndarray    # tables x directions x dimensions
    offsets: np.ndarray       # tables x directions
    width: float
    norm: float               # the largest norm, up to which vectors are filled

    @classmethod
    def drawn(cls, dims: int, points: int, norm: float, tables: int = TABLES, seed: int = 23):
        wanted = np.log2(max(points, 2) / BUCKET_POINTS) / BITS
        count = int(np.clip(round(wanted), 1, MOST_DIRECTIONS))
        rng = np.random.default_rng(seed)
        width = WIDTH * norm
        return cls(rng.standard_normal((tables, count, dims + 1)),
                   rng.uniform(0, width, (tables, count)), width, norm)

    def filled(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (vectors ** 2).sum(1), 0))
        return np.hstack([vectors, rest[:, None]])

    def places(self, filled: np.ndarray) -> np.ndarray:
        """Place of each vector along each direction, in widths: rows x tables x directions."""
        return (np.einsum("nd,tkd->ntk", filled, self.directions) + self.offsets) / self.width

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        return np.floor(self.places(self.filled(vectors))).astype(np.int32)

    def probes(self, vectors: np.ndarray, most: int,
               tables: list[int] | None = None) -> list[list[list[tuple[int, ...]]]]:
        """For each query and table (of ``tables``) the buckets to visit, the likeliest first.

        Queries only turn neighbours about, so they are scaled to the norm and not filled.
        """
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        scaled = np.hstack([vectors / norms * self.norm, np.zeros((len(vectors), 1))])
        places = self.places(scaled)
        if tables is not None:
            places = places[:, tables]
        return [[_sequence(table, most) for table in query] for query in places]


def _sequence(place: np.ndarray, most: int) -> list[tuple[int, ...]]:
    """Buckets around a place by the sum of squared distances to the walls between.

    Each direction may move by any number of buckets; the moves of one direction are ordered by
    distance, and a heap walks their combinations from the cheapest on, each of them once.
    """
    own = np.floor(place).astype(int)
    inside = place - own
    moves = []
    for x in inside:
        steps = [(0.0, 0)]
        for n in range(1, 4):
            steps += [((x + n - 1) ** 2, -n), ((n - x) ** 2, n)]
        moves.append(sorted(steps))
    start = (0,) * len(moves)
    heap, found = [(0.0, start, 0)], []
    while heap and len(found) < most:
        cost, state, last = heapq.heappop(heap)
        found.append(tuple(int(x) + moves[i][n][1] for i, (x, n) in enumerate(zip(own, state))))
        # Each state but the first comes from one parent only: lower its last raised direction.
        for i in range(last, len(moves)):
            n = state[i] + 1
            if n < len(moves[i]):
                child = state[:i] + (n,) + state[i + 1:]
                heapq.heappush(heap, (cost + moves[i][n][0] - moves[i][n - 1][0], child, i))
    return found


def _key(bucket) -> str:
    return ",".join(map(str, bucket))


def best_of(queries: np.ndarray, points: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """(query, point, inner product) of the ``top`` points of each query.

    Equal inner products go to the point that comes first.  The matrix product finds what may be
    among the best, with room for its rounding; the products that decide are summed in one fixed
    order, so that a pair's score is the same wherever it is met.
    """
    rough = queries @ points.T
    if rough.shape[1] > top:
        least = np.partition(rough, -top, axis=1)[:, -top]
        room = 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(points, axis=1).max()
        query, point = np.nonzero(rough >= (least - room)[:, None])
    else:
        query, point = (axis.ravel() for axis in np.indices(rough.shape))
    score = np.empty(len(query))
    for at in range(0, len(query), SUMMED):
        some = slice(at, at + SUMMED)
        score[some] = (queries[query[some]] * points[point[some]]).sum(-1)
    order = np.lexsort((point, -score, query))
    query, point, score = query[order], point[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = place < top
    return query[kept], point[kept], score[kept]


# --- points -----------------------------------------------------------------------------------

def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col("vector")
    kind = df.schema[vector].dataType.simpleString()
    exact = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).cast(exact).alias("vector")).filter(
        F.col("id").isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size(v) == (size["n"] if size else 0))


def distinct_points(rows: DataFrame, stages: Stages, top: int) -> DataFrame:
    """(point, vector, ids): each distinct vector with its least ids, up to ``top`` + 1.

    ``point`` is the least id with a hash of the vector, as one id may have several vectors.
    """
    # First within the partitions as they lie, so a vector that many rows share is small before
    # it is gathered.
    task = F.spark_partition_id()
    hashed = stages.save(rows.withColumn("hash", F.xxhash64("vector")).withColumn("task", task),
                         "vectors")

    def least(df, *also):
        order = Window.partitionBy("hash", "vector", *also).orderBy("id")
        return df.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top + 1)

    kept = least(least(hashed, "task"))
    points = stages.save(
        kept.groupBy("hash", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .select(F.struct(F.get("ids", F.lit(0)).alias("id"), "hash").alias("point"), "vector",
                "ids"), "points")
    stages.remove("vectors")
    return points


def fit_probes(sample: np.ndarray, hashing: Hashing, top: int, queries: int = FIT_QUERIES,
               recall: float = RECALL) -> int:
    """Least number of visited buckets at which the sample's neighbours are found."""
    top = min(top, len(sample) - 1)
    if top < 1:
        return 1
    asked = sample[:queries]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argpartition(-scores, top - 1, axis=1)[:, :top]
    buckets = hashing.buckets(sample)
    most = 64
    while True:
        visits = hashing.probes(asked, most)
        # The visit at which each true neighbour turns up first, over all tables.
        first = np.full(near.shape, most)
        for q, tables in enumerate(visits):
            for t, sequence in enumerate(tables):
                order = {b: n for n, b in enumerate(sequence)}
                for j, p in enumerate(near[q]):
                    n = order.get(tuple(buckets[p, t].tolist()), most)
                    first[q, j] = min(first[q, j], n)
        needed = int(np.sort(first.ravel())[int(np.ceil(recall * first.size)) - 1])
        all_met = max(len(s) for tables in visits for s in tables) < most
        if needed < most or all_met:
            return min(needed + 1, most)
        most *= 4


def neighbours(df: DataFrame, is_query: Column, vec_id: str = "vec_id",
               vector: str = "embedding", top: int = 20, tables: int = TABLES,
               block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` found for each row that ``is_query`` is of.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = df.sparkSession
    stages = Stages(spark)
    rows = usable(df, vec_id, vector)
    points = distinct_points(rows, stages, top)
    asking = stages.save(
        rows.filter(is_query).select("id", F.xxhash64("vector").alias("hash"), "vector")
        .join(points.select("point", F.col("point.hash").alias("hash"), "vector"),
              ["hash", "vector"]).select("id", "point"), "asking")
    found = points.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).alias("norm"),
        F.max(F.size("vector")).alias("dims")).first()
    schema = f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, " \
             f"vec_id {rows.schema['id'].dataType.simpleString()}, score double"
    if not found["n"]:
        return spark.createDataFrame([], schema)
    hashing = Hashing.drawn(found["dims"], found["n"], found["norm"], tables)
    part = max(1, -(-found["n"] // FIT_POINTS))
    sample = points.filter(F.pmod(F.xxhash64("point", F.lit("fit")), F.lit(part)) == 0)
    sample = np.array([r[0] for r in sample.orderBy(
        F.xxhash64("point", F.lit("asked")), "point").select("vector").collect()])
    most = fit_probes(sample.reshape(len(sample), -1), hashing, top) if len(sample) else 1
    shared = spark.sparkContext.broadcast(hashing)
    point_type = points.schema["point"].dataType.simpleString()
    vector_type = points.schema["vector"].dataType.simpleString()
    id_type = rows.schema["id"].dataType.simpleString()

    def index_of(places: list[int]):
        def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                vectors = np.stack(frame["vector"].to_numpy()).astype(np.float64)
                buckets = shared.value.buckets(vectors)
                for t in places:
                    yield frame.assign(place=t, bucket=[_key(b) for b in buckets[:, t]])

        return index

    def members_of(places: list[int]) -> DataFrame:
        return points.select("point", "vector").mapInPandas(
            index_of(places), f"point {point_type}, vector {vector_type}, place int, bucket string")

    def visits_of(place: int, begin: int, end: int):
        def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), 64):
                    some = frame.iloc[at:at + 64]
                    visits = shared.value.probes(np.stack(some["vector"].to_numpy()).astype(
                        np.float64), end, [place])
                    yield pd.DataFrame(
                        [(p, place, _key(b)) for p, (sequence,) in zip(some["point"], visits)
                         for b in sequence[begin:]], columns=["point", "place", "bucket"])

        return visit

    # How many blocks a bucket's points are.
    parts = stages.save(members_of(list(range(tables))).groupBy("place", "bucket").agg(
        F.ceil(F.count("*") / block).cast("int").alias("parts")), "buckets")
    queries = stages.save(points.join(asking.select("point").distinct(), "point")
                          .select("point", "vector"), "queries")
    shards = max(1, -(-found["n"] // (SHARD_BLOCKS * block)))
    asked_parts = max(1, -(-queries.count() // (ASKED_BLOCKS * block)))

    def visited(asked: DataFrame, place: int, begin: int, end: int) -> DataFrame:
        """(point, place, bucket, parts); buckets that hold nothing are not visited."""
        return asked.select("point", "vector").mapInPandas(
            visits_of(place, begin, end), f"point {point_type}, place int, bucket string").join(
            parts, ["place", "bucket"])

    def compare(key: tuple, members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({name: pd.Series([], dtype=object)
                                for name in ("query", "score", "id", "hash")})
        if not len(members) or not len(asked):
            return nothing
        # In the order in which equal scores are to be.
        members = members.iloc[sorted(range(len(members)), key=lambda i: (
            members["point"].iloc[i]["id"], members["point"].iloc[i]["hash"]))]
        vectors = np.stack(members["vector"].to_numpy()).astype(np.float64)
        wanted = np.stack(asked["vector"].to_numpy()).astype(np.float64)
        bound = asked["bound"].to_numpy()
        units, held = np.unique(members["unit"].to_numpy(), return_inverse=True)
        order = np.argsort(held, kind="stable")
        held_at = np.searchsorted(held[order], np.arange(len(units) + 1))
        visit = np.concatenate([np.asarray(u, dtype=np.int64) for u in asked["units"]])
        visitor = np.repeat(np.arange(len(asked)), [len(u) for u in asked["units"]])
        by_unit = np.argsort(visit, kind="stable")
        visit, visitor = visit[by_unit], visitor[by_unit]
        out = []
        for n, unit in enumerate(units):
            some = order[held_at[n]:held_at[n + 1]]
            here = visitor[np.searchsorted(visit, unit):np.searchsorted(visit, unit, "right")]
            for at in range(0, len(here), 256):
                ask = here[at:at + 256]
                row, member, scores = best_of(wanted[ask], vectors[some], top + 1)
                good = scores >= bound[ask[row]]
                out.append((ask[row[good]], some[member[good]], scores[good]))
        if not out:
            return nothing
        query, member, score = map(np.concatenate, zip(*out))
        order = np.lexsort((member, -score, query))
        query, member, score = query[order], member[order], score[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) <= top
        query, member, score = query[kept], member[kept], score[kept]
        if not len(query):
            return nothing
        point = members["point"].to_numpy()
        return pd.DataFrame({"query": asked["point"].to_numpy()[query], "score": score,
                             "id": [point[m]["id"] for m in member],
                             "hash": [point[m]["hash"] for m in member]})

    keys = ["shard", "asked_part"]
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "id", "hash")
    least = float("-inf")

    def met(visits: DataFrame, held: DataFrame, so_far: DataFrame | None = None) -> DataFrame:
        """The best points that queries meet in the buckets they visit.

        A block of a bucket is a unit, and units are dealt to shards.  A query is sent once to each
        shard in which it visits any, with their numbers; should two units have one number, it
        would meet more points, never fewer.
        """
        unit = F.xxhash64("place", "bucket", "part")
        split = parts.filter("parts > 1")
        members = (held.join(split, ["place", "bucket"], "left")
                   .withColumn("part", F.pmod(F.xxhash64("point"), F.coalesce("parts", F.lit(1)))
                               .cast("int"))
                   .select("point", "vector", unit.alias("unit"))
                   .withColumn("shard", F.pmod(F.col("unit"), F.lit(shards)))
                   .withColumn("asked_part", F.explode(F.sequence(F.lit(0), F.lit(
                       asked_parts - 1)))))
        asked = (visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .select("point", unit.alias("unit"))
                 .groupBy("point", F.pmod(F.col("unit"), F.lit(shards)).alias("shard"))
                 .agg(F.collect_list("unit").alias("units"))
                 .join(queries, "point")
                 .withColumn("asked_part", F.pmod(F.xxhash64("point"), F.lit(asked_parts))
                             .cast("int")))
        if so_far is not None:
            bounds = so_far.filter(F.col("n") == top + 1).select(F.col("query").alias("point"),
                                                                 F.col("score").alias("bound"))
            asked = asked.join(bounds, "point", "left").withColumn(
                "bound", F.coalesce("bound", F.lit(least)))
        else:
            asked = asked.withColumn("bound", F.lit(least))
        return (members.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
            compare, f"query {point_type}, score double, id {id_type}, hash long"))

    def best(df: DataFrame) -> DataFrame:
        # The same point found in several tables counts once.
        return (df.distinct().withColumn("n", F.row_number().over(ranked))
                .filter(F.col("n") <= top + 1))

    def table_by_table(asked: DataFrame, begin: int, end: int, merged: DataFrame,
                       name: str) -> DataFrame:
        """``merged`` with what more visits find, a table at a time, so that one table's
        vectors are exchanged at once."""
        for t in range(tables):
            first = FIRST * tables if not t and not begin else begin
            merged = stages.save(best(merged.drop("n").union(met(
                visited(asked, t, first, end), members_of([t]), merged))), f"{name}-table-{t}")
        return merged

    merged = stages.save(best(met(visited(queries, 0, 0, min(FIRST * tables, most)),
                                  members_of([0]))), "early")
    merged = table_by_table(queries, 0, most, merged, "merged")
    counts = points.select(F.col("point.id").alias("id"), F.col("point.hash").alias("hash"),
                           F.size("ids").alias("copies"))
    for step in range(MORE_ROUNDS + 1):
        # All that a query has met is in ``merged`` while that is fewer than top + 1.
        enough = (merged.join(counts, ["id", "hash"]).groupBy("query")
                  .agg(F.sum("copies").alias("rows")).filter(F.col("rows") > top)
                  .select(F.col("query").alias("point")))
        short = stages.save(queries.join(enough, "point", "left_anti"), f"short-{step}")
        if short.isEmpty() or found["n"] == 1:
            break
        if step < MORE_ROUNDS:
            merged = table_by_table(short, most, 2 * most, merged, f"merged-{step}")
            most *= 2
        else:
            whole = [F.lit(-1).alias("place"), F.lit("").alias("bucket")]
            blocks = max(1, -(-found["n"] // block))
            parts = spark.createDataFrame([(-1, "", blocks)], "place int, bucket string, parts int")
            merged = stages.save(best(merged.drop("n").union(met(
                short.select("point", *whole, F.lit(blocks).alias("parts")),
                points.select("point", "vector", *whole)))), f"merged-{step}")
    named = merged.join(points.select(F.col("point.id").alias("id"),
                                      F.col("point.hash").alias("hash"), "ids"), ["id", "hash"])
    each = (named.join(asking.select(F.col("id").alias("query_id"),
                                     F.col("point").alias("query")), "query")
            .select("query_id", "score", F.explode("ids").alias("vec_id"))
            .filter("vec_id <> query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))
