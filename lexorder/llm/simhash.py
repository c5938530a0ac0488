"""Near-duplicates by SimHash fingerprints and vantage-point trees.

A fingerprint has a bit set where more than half of the text's word shingles have it set.  Equal
fingerprints are one point.  A vantage-point tree built on the driver from a small sample splits
the points into shards: those within ``radius`` of a vantage point go inside, the rest outside,
and points of the outside that lie less than the link distance beyond the boundary go to both.  By
the triangle inequality every linked pair then meets in a shard, and with points on one side only
copied.  Each shard grows the tree further down in memory, compares the points of small leaves
exactly, and hands on a spanning forest of its links instead of all pairs, which loses no link
between groups.  A shard of many points that nothing splits is cut into parts, and each pair of parts
meets in a task of its own.  The forests are joined by distributed connected components.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and links
like any other.  Rows with a null id take part; a component's id is its least non-null id, null if
it has none.  Repeated rows share a fingerprint.  Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexorder.staging import Stages

from .common import keep_rows
from .components import components

SHARD_POINTS = 50_000     # points a shard should have, at least
MOST_SHARDS = 20_000      # beyond this many shards they grow instead
SAMPLE_PER_SHARD = 32     # sampled points per shard that shape the tree on the driver
SHARD_FACTOR = 2          # times that size, beyond which a shard is cut into parts
LEAF = 512                # points that are compared all with all
VANTAGES = 4              # vantage points tried for a split


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """SimHash of the shingles of ``words`` words, repeats included."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        found = [b" ".join(found)]
    else:
        found = [b" ".join(s) for s in zip(*(found[i:] for i in range(words)))]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in found), np.uint64, len(found))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(),
                          "little", signed=True)


def fingerprints(text: str, words: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer."""
    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t or b"", words, seed) for t in texts], dtype="int64")

    return made(F.col(text).cast("binary"))


# --- the tree ---------------------------------------------------------------------------------

def _split(points: np.ndarray, reach: int, rng) -> tuple[np.uint64, int, np.ndarray] | None:
    """The vantage point and radius with fewest copies, and the distances; None if none helps."""
    best, found = len(points) * 1.8, None
    for vantage in rng.choice(points, min(VANTAGES, len(points)), replace=False):
        distance = np.bitwise_count(points ^ vantage)
        upto = np.cumsum(np.bincount(distance, minlength=65 + reach))
        for radius in range(65):
            inside, outside = upto[radius + reach], len(points) - upto[radius]
            # Copies cost, and so does a lopsided split.
            cost = inside + outside + abs(int(inside) - int(outside)) * 0.25
            if 0 < outside and inside < len(points) and cost < best:
                best, found = cost, (vantage, radius, distance)
    return found


def grow(sample: np.ndarray, reach: int, smallest: int, seed: int = 11) -> list[tuple]:
    """A tree as rows (vantage, radius, inside, outside); a negative child is shard -child - 1."""
    rng = np.random.default_rng(seed)
    nodes, shards = [], 0
    waiting = [(sample, None, 0)]
    while waiting:
        points, parent, side = waiting.pop()
        split = _split(points, reach, rng) if len(points) > smallest else None
        if split is None:
            place, shards = -shards - 1, shards + 1
        else:
            place = len(nodes)
            vantage, radius, distance = split
            nodes.append([vantage, radius, None, None])
            waiting.append((points[distance <= radius + reach], place, 2))
            waiting.append((points[distance > radius], place, 3))
        if parent is not None:
            nodes[parent][side] = place
    return [tuple(n) for n in nodes]


def route(points: np.ndarray, nodes: list[tuple], reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """The shards of points, with the points each of them gets."""
    waiting = [(0 if nodes else -1, points)]
    while waiting:
        place, here = waiting.pop()
        if not len(here):
            continue
        if place < 0:
            yield -place - 1, here
            continue
        vantage, radius, inside, outside = nodes[place]
        distance = np.bitwise_count(here ^ vantage)
        waiting.append((inside, here[distance <= radius + reach]))
        waiting.append((outside, here[distance > radius]))


class Forest:
    """Groups of numbered points, joined pair by pair."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def link_groups(points: np.ndarray, reach: int, seed: int = 5) -> np.ndarray:
    """For distinct points, the number of the least point of each one's group of links."""
    rng = np.random.default_rng(seed)
    forest = Forest(len(points))
    waiting = [np.arange(len(points))]
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def flush():
        nonlocal pending, held
        if pending:
            forest.join(np.concatenate([p[0] for p in pending]),
                        np.concatenate([p[1] for p in pending]))
        pending, held = [], 0

    while waiting:
        here = waiting.pop()
        split = _split(points[here], reach, rng) if len(here) > LEAF else None
        if split is not None:
            _, radius, distance = split
            waiting.append(here[distance <= radius + reach])
            waiting.append(here[distance > radius])
            continue
        for i in range(0, len(here), LEAF):           # one block, unless nothing split the points
            for j in range(i, len(here), LEAF):
                a, b = here[i:i + LEAF], here[j:j + LEAF]
                x, y = np.nonzero(np.bitwise_count(points[a][:, None] ^ points[b][None, :])
                                  <= reach)
                apart = a[x] != b[y]
                pending.append((a[x[apart]], b[y[apart]]))
                held += int(apart.sum())
                if held > 1_000_000:
                    flush()
    flush()
    return forest.root


def linked_points(points: DataFrame, reach: int, stages: Stages,
                  shard_points: int = SHARD_POINTS) -> DataFrame:
    """Distinct fingerprints (fp) to links (u, v) that connect what is within ``reach`` bits."""
    total = points.count()
    size = max(shard_points, total // MOST_SHARDS)
    part = max(1, total * SAMPLE_PER_SHARD and size // SAMPLE_PER_SHARD)
    sample = points.filter(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(part)) == 0)
    chosen = np.sort(np.array([r[0] for r in sample.collect()], dtype=np.int64)).view(np.uint64)
    nodes = grow(chosen, reach, SAMPLE_PER_SHARD) if total > size else []
    tree = points.sparkSession.sparkContext.broadcast(nodes)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            here = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for shard, members in route(here, tree.value, reach):
                yield pd.DataFrame({"shard": shard, "fp": members.view(np.int64)})

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        here = np.unique(frame["fp"].to_numpy(np.int64)).view(np.uint64)
        root = link_groups(here, reach)
        other = np.flatnonzero(root != np.arange(len(here)))
        return pd.DataFrame({"u": here[other].view(np.int64),
                             "v": here[root[other]].view(np.int64)})

    placed = stages.save(points.mapInPandas(place, "shard int, fp long"), "placed")
    # A shard that no vantage point splits is cut: each pair of its parts is a task of its own.
    limit = SHARD_FACTOR * size
    parts = placed.groupBy("shard").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts"))
    large = {row["shard"]: row["parts"] for row in parts.filter("parts > 1").collect()}
    if not large:
        met = placed.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:                               # as many shards at most as the tree has
        count = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for entry in large.items()
                                                       for x in entry]), F.col("shard")), F.lit(1))
        part = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int")
        met = (placed.withColumn("parts", count).withColumn("part", part)
               .select("shard", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
                       .alias("other"))
               .select("shard", "fp", F.least("part", "other").alias("i"),
                       F.greatest("part", "other").alias("j")))
    return stages.save(met.groupBy("shard", "i", "j").applyInPandas(pairs, "u long, v long"),
                       "forest")


def component_table(prints: DataFrame, stages: Stages, reach: int = 2) -> DataFrame:
    """Rows (id, fp) to one row per fingerprint: (fp, root, component_id)."""
    points = stages.save(prints.groupBy("fp").agg(F.min("id").alias("id")), "points")
    roots = components(linked_points(points.select("fp"), reach, stages), stages)
    rooted = points.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return stages.save(rooted.select("fp", "root").join(least, "root"), "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    words: int = 3, reach: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    stages = Stages(docs.sparkSession)
    prints = stages.save(docs.select(F.col(doc_id).alias("id"),
                                     fingerprints(text, words).alias("fp")), "prints")
    found = component_table(prints, stages, reach)
    return prints.join(found, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             words: int = 3, reach: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with the least id.

    Null ids come last; of rows with the same id the one that was read first stays.
    """
    stages = Stages(docs.sparkSession)
    rows, row = keep_rows(docs, stages)
    prints = stages.save(rows.select(F.col(doc_id).alias("id"), F.col(row).alias("row"),
                                     fingerprints(text, words).alias("fp")), "prints")
    found = component_table(prints, stages, reach)
    first = (prints.join(found, "fp").groupBy("root")
             .agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "row")).alias("first"))
             .select(F.col("first.row").alias(row)))
    return rows.join(first, row, "left_semi").select(*docs.columns)
