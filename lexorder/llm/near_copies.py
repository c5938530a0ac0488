"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints and min-hashes propose pairs and the exact similarity decides.  The vantage-point trees of
``simhash`` link texts whose fingerprints, of the same five-word shingles, differ by ``REACH`` bits or
less; a component of these links is a key of its texts.  A text has ``BANDS`` keys more, each made of
``ROWS`` min-hashes of its shingle set.  A pair of similarity s shares no key with a chance of
(1 - s ** ROWS) ** BANDS, 7.4e-7 at 0.8 and less above; at 0.2 a pair shares one with 0.08 %.

Texts that keys connect, directly or over others, are a group of candidates; every similar pair that
shares a key lies inside one.  A group is cut into parts of bounded size.  A task holds one part, or
two, and goes through its pairs that share a key and are not yet connected; it hands on the links
that connect something new, never pairs.  First every part is compared within itself; then, as long
as that halves them, one text for each component; and at last pairs of parts, but only of those texts
that share a key with a text of another component.  So a large group of copies is done by its first
links, and no link between components is left out.

Defined results: words are lower case, split at white space; a text of fewer than five words is one
shingle.  A null or empty text, or one of white space only, has the shingle of no words and is a
copy of others like it.  Null ids come last, and repeated rows are copies of each other.  Extra
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexorder.staging import Stages

from .common import keep_rows
from .components import components
from .simhash import component_table, fingerprints

WORDS = 5
REACH = 2                 # bits within which fingerprints are linked
SIMILAR = (4, 5)          # least similarity, as a fraction
BANDS, ROWS = 60, 7
PART = 512                # texts of a part
PART_SHINGLES = 1 << 21   # shingles of a part

_FACTORS = np.random.default_rng(31).integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | 1


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of ``words`` words, in order."""
    found = text.lower().split()
    if len(found) < words:
        found = [b" ".join(found)]
    else:
        found = [b" ".join(s) for s in zip(*(found[i:] for i in range(words)))]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s) for s in found), np.uint64, len(found)))


def band_keys(shingles: np.ndarray) -> list[int]:
    """The keys of a shingle set, one per band."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 512):
        np.minimum(least, (_FACTORS * shingles[at:at + 512]).min(1), out=least)
    keys = [xxhash.xxh64_intdigest(rows.tobytes(), seed=band)
            for band, rows in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def prints_of(text: str) -> Column:
    """The digest of a text's shingle set, its size and its keys."""
    @F.pandas_udf("same binary, size int, keys array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t or b"") for t in texts]
            yield pd.DataFrame({"same": [xxhash.xxh128_digest(s.tobytes()) for s in sets],
                                "size": [len(s) for s in sets],
                                "keys": [band_keys(s) for s in sets]})

    return made(F.col(text).cast("binary"))


def _sizes(members: DataFrame) -> DataFrame:
    """(cand, parts): in how many parts a group of candidates goes."""
    return members.groupBy("cand").agg(F.ceil(F.greatest(
        F.count("*") / PART, F.sum("size") / PART_SHINGLES)).cast("int").alias("parts"))


def _parted(members: DataFrame) -> DataFrame:
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return members.join(_sizes(members), "cand").withColumn("part", part)


def _similar_to(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the shingle sets are similar enough to the first; all are sorted and not empty."""
    least, whole = SIMILAR
    sizes = np.array([len(o) for o in others])
    end = np.cumsum(sizes)
    together = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, together), len(one) - 1)
    common = np.add.reduceat((one[at] == together).astype(np.int64), end - sizes)
    return (least + whole) * common >= least * (len(one) + sizes)


def _links(table: pa.Table) -> pa.Table:
    """Links (u, v) that connect what is similar among the texts of one part or of two.

    Texts of one ``root`` are connected already.  Of two parts only pairs across are compared.
    """
    least, whole = SIMILAR
    table = table.sort_by("node")
    node, side = table.column("node").to_numpy(), table.column("part").to_numpy()
    size, count = table.column("size").to_numpy(), table.num_rows
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(count, -1)
    texts, sets = table.column("text"), {}
    root = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
    across, found = side.min() != side.max(), []

    def shingles(i):
        if i not in sets:
            sets[i] = shingle_set(texts[int(i)].as_py() or b"")
        return sets[i]

    for i in range(count):
        later = np.arange(i + 1, count)
        fits = root[later] != root[i]
        if across:
            fits &= side[later] != side[i]
        fits &= whole * np.minimum(size[later], size[i]) >= least * np.maximum(size[later], size[i])
        later = later[fits]
        later = later[(keys[later] == keys[i]).any(axis=1)]
        if not len(later):
            continue
        for j in later[_similar_to(shingles(i), [shingles(k) for k in later])]:
            if root[j] != root[i]:
                found.append((node[j], node[i]))
                root[root == root[j]] = root[i]
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})


def _linked(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).applyInArrow(_links, "u long, v long")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members with the root of their component as it is known."""
    return members.join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))


def roots_of(members: DataFrame, texts: DataFrame, stages: Stages) -> DataFrame:
    """Members of groups of candidates to (u, root): the least node of a node's component.

    ``members`` are (node, cand, size), ``texts`` are (node, keys, text) of the same nodes.
    """
    placed = stages.save(_parted(members), "placed")
    links = stages.save(_linked(placed.withColumn("root", F.col("node")).join(texts, "node"),
                                ["cand", "part"]), "links-within")
    several = placed.filter("parts > 1").drop("parts")
    if several.isEmpty():
        return components(links, stages)
    before, step = None, 0
    while True:
        work = stages.inner(f"round-{step}")
        roots = components(links, work)
        rooted = work.save(_rooted(several, roots), "rooted")
        # Only texts that share a key with one of another component have pairs left.
        keyed = rooted.join(texts.select("node", "keys"), "node").select(
            "node", "cand", "size", "part", "root", F.explode("keys").alias("key"))
        mixed = (keyed.groupBy("cand", "key").agg(F.min("root").alias("low"),
                                                  F.max("root").alias("high"))
                 .filter("low < high").select("cand", "key"))
        left = work.save(keyed.join(mixed, ["cand", "key"])
                         .select("node", "cand", "size", "part", "root").distinct(), "left")
        heads = work.save(_parted(left.filter("node = root").select("node", "cand", "size")),
                          "heads")
        now = heads.count()
        if not now:
            return roots
        if 2 * now > (before or left.count()):
            break
        links = stages.save(links.union(_linked(
            heads.withColumn("root", F.col("node")).join(texts, "node"), ["cand", "part"])),
            f"more-{step}")
        before, step = now, step + 1
    other = left.select("cand", F.col("part").alias("other")).distinct()
    crossed = left.join(other, "cand").filter("part <> other").select(
        "*", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return components(stages.save(links.union(_linked(crossed.join(texts, "node"),
                                                      ["cand", "i", "j"])), "links-across"), stages)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the one with the least id.

    Null ids come last; of rows with the same id the one that was read first stays.
    """
    stages = Stages(docs.sparkSession)
    rows, row = keep_rows(docs, stages)
    prints = stages.save(rows.select(F.col(doc_id).alias("id"), F.col(row).alias("row"),
                                     fingerprints(text, WORDS).alias("fp"),
                                     prints_of(text).alias("print"))
                         .select("id", "row", "fp", "print.*"), "prints")
    # Texts with the same set are one node, the least of their rows.
    nodes = stages.save(prints.groupBy("same").agg(
        F.min("row").alias("node"),
        F.min(F.struct(F.isnull("id").alias("none"), "id", "row")).alias("first"))
        .select("node", "first"), "nodes")
    own = prints.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(
        F.col("row").alias("node"), "fp", "size", "keys")
    linked = component_table(own.select(F.col("node").alias("id"), "fp"), stages.inner("trees"),
                             REACH).select("fp", "root")
    own = stages.save(own.join(linked, "fp").select("node", "size", F.array_append(
        "keys", F.xxhash64(F.lit("fingerprint"), "root")).alias("keys")), "own")
    keyed = stages.save(own.select(F.explode("keys").alias("key"), "node"), "keyed")
    lowest = keyed.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter(
        "n > 1").select("key", "v")
    met = keyed.join(lowest, "key").filter("node > v").select(F.col("node").alias("u"), "v")
    groups = components(met.distinct(), stages.inner("groups"))
    stages.remove("keyed")
    heads = groups.select(F.col("root").alias("node"), F.col("root").alias("cand")).distinct()
    members = stages.save(groups.select(F.col("u").alias("node"), F.col("root").alias("cand"))
                          .union(heads).join(own.select("node", "size"), "node"), "members")
    texts = stages.save(
        rows.select(F.col(row).alias("node"), F.col(text).cast("binary").alias("text"))
        .join(members.select("node"), "node").join(own.select("node", "keys"), "node"), "texts")
    roots = roots_of(members, texts, stages)
    first = (nodes.join(roots.withColumnRenamed("u", "node"), "node", "left")
             .groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
             .select(F.col("first.row").alias(row)))
    return rows.join(first, row, "left_semi").select(*docs.columns)
