"""Induced sorting as tables of levels, from which a lost driver goes on.

Level 0 is the texts, level k + 1 the names of level k's star substrings in text order, for those
texts that have a name twice.  On the way down every level orders and names its star substrings;
on the way up each level's suffixes are ordered by the stars' order that the level above gives.

All tables of a run lie in one folder.  A step's tables count only when its ``done`` table is
there, a single row that is written last.  A run in a folder that has such steps reads them and
begins with the first step that is not done, whose half-written tables it removes.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexorder.operators.counts import symbol_histogram
from lexorder.operators.names import name_order, reduced_text
from lexorder.operators.types import with_directory
from lexorder.plans.doubling import Packed, rank, refine
from lexorder.plans.induced import (_key_symbols, pieces, sort_keys, staged, star_substring_order,
                                    width_of)
from lexorder.sources.texts import Texts, pack_symbols
from lexorder.staging import Stages, shared_dir, tasks_for

DONE = ("step string, width int, chunk int, halo int, single boolean, total long, names long, "
        "longest long, seconds double, bytes long")


@dataclass
class Level:
    """A level's tables: its texts, and the names of its stars."""

    number: int
    texts: Packed
    stages: Stages
    named: DataFrame        # text_id, star_idx, pos, name
    again: DataFrame        # text_id of the texts that the next level sorts, if it goes on
    goes_on: bool


class Run:
    """The steps of a run in its folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.stages = spark, Stages(spark, folder)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.stages.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def done(self, step: str):
        """The row that a finished step has left, or None."""
        path, system = self._path(f"{step}/done/_SUCCESS")
        if not system.exists(path):
            return None
        return self.table(f"{step}/done").first()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.stages.folder}/{name}")

    def begin(self, step: str) -> Stages:
        """An empty folder for a step's tables."""
        self.stages.remove(step)
        return self.stages.inner(step)

    def finish(self, step: str, began: float, **found) -> None:
        path, system = self._path(step)
        size = system.getContentSummary(path).getLength()
        row = {"step": step, "seconds": time.time() - began, "bytes": size} | found
        self.stages.save(self.spark.createDataFrame([row], DONE).coalesce(1), f"{step}/done")


def _below(run: Run, number: int, texts: Texts) -> Texts:
    """The texts of a level, as they are to be written."""
    if number == 0:
        return texts
    under = f"names-{number - 1}"
    row = run.done(under)
    named = run.table(f"{under}/named").join(run.table(f"{under}/again"), "text_id", "left_semi")
    return pack_symbols(reduced_text(named), width_of(row["names"]), row["chunk"], row["halo"],
                        row["longest"] <= row["chunk"])


def _descend(run: Run, number: int, texts: Texts) -> Level:
    """The names of a level's star substrings."""
    step = f"names-{number}"
    if run.done(step) is None:
        began, stages = time.time(), run.begin(step)
        packed = staged(_below(run, number, texts), stages, "chunks")
        single = not packed.chunks.agg(F.max("chunk_id")).first()[0]
        packed = replace(packed, single=single)
        work = stages.inner("work")
        # Stars are half the symbols at most.
        named = stages.save(name_order(star_substring_order(packed, work), work,
                                       tasks_for(run.spark, packed.total // 2), single), "named")
        # Both counts of a text come from one pass; names combine before they are exchanged.
        per_name = named.groupBy("text_id", "name").agg(F.count("*").alias("n"))
        sizes = stages.save(per_name.groupBy("text_id").agg(
            F.sum("n").alias("n_stars"), F.count("*").alias("n_names")), "sizes")
        stages.save(sizes.filter("n_stars > n_names").select("text_id"), "again")
        stages.save(_alphabet(packed), "alphabet")
        names, longest = sizes.agg(F.max("n_names"), F.max(F.when(
            F.col("n_stars") > F.col("n_names"), F.col("n_stars")))).first()
        work.remove()
        run.finish(step, began, width=packed.width, chunk=packed.chunk, halo=packed.halo,
                   single=single, total=packed.total, names=names or 0, longest=longest or 0)
    row = run.done(step)
    packed = Packed(run.table(f"{step}/chunks"), row["width"], row["chunk"], row["halo"],
                    row["single"], row["total"])
    return Level(number, packed, run.stages.inner(step), run.table(f"{step}/named"),
                 run.table(f"{step}/again"), row["longest"] > 0)


def _alphabet(texts: Packed) -> DataFrame:
    """``(text_id, n, n_symbols)``: the length and the distinct symbols of every text."""
    return symbol_histogram(texts).groupBy("text_id").agg(
        F.sum("count").alias("n"), F.count("*").alias("n_symbols"))


def _ascend(run: Run, level: Level) -> DataFrame:
    """The suffix array of a level, with that of the level above it done."""
    step = f"order-{level.number}"
    if run.done(step) is None:
        began, stages = time.time(), run.begin(step)
        texts = level.texts
        stars = level.named.join(level.again, "text_id", "left_anti").select(
            "text_id", F.col("pos").alias("star_pos"), F.col("name").alias("star_rank"))
        if level.goes_on:
            above = run.table(f"order-{level.number + 1}/sa").select(
                "text_id", F.col("pos").alias("star_idx"), F.col("rank").alias("star_rank"))
            stars = stars.unionByName(level.named.join(above, ["text_id", "star_idx"]).select(
                "text_id", F.col("pos").alias("star_pos"), "star_rank"))
        work = stages.inner("work")
        symbols = _key_symbols(texts)
        keys = sort_keys(pieces(with_directory(texts, work), texts, symbols), stars, texts.width,
                         symbols)
        first = rank(keys, ["text_id"], ["prefix", "ahead"], texts.total, texts, work, "first")
        stages.save(refine(first, symbols, texts, work, "refined"), "sa")
        work.remove()
        run.finish(step, began, total=texts.total)
    return run.table(f"{step}/sa")


def _levels(run: Run, texts: Texts, most: int | None) -> list[Level]:
    found = [_descend(run, 0, texts)]
    while found[-1].goes_on and (most is None or len(found) < most):
        found.append(_descend(run, len(found), texts))
    return found


def new_folder(spark: SparkSession) -> str:
    """A folder for a run, in the one that all executors share."""
    return Stages(spark).folder.replace(f"{shared_dir(spark)}/stages-", f"{shared_dir(spark)}/run-")


def sort_by_levels(texts: Texts, folder: str | None = None) -> DataFrame:
    """The suffix array ``(text_id, rank, pos)``; with a ``folder`` of an earlier run it goes on.

    The texts must be the same ones then.
    """
    spark = texts.chunks.sparkSession
    run = Run(spark, folder or new_folder(spark))
    order = None
    for level in _levels(run, texts, None)[::-1]:
        order = _ascend(run, level)
    return order


def levels(texts: Texts, folder: str | None = None, most: int | None = None) -> DataFrame:
    """``(level, text_id, n, n_symbols, n_stars, n_names)`` of every text at each of its levels.

    ``n`` is the length there.  ``most`` is the number of levels that are made.
    """
    spark = texts.chunks.sparkSession
    run = Run(spark, folder or new_folder(spark))
    parts = []
    for level in _levels(run, texts, most):
        step = f"names-{level.number}"
        parts.append(run.table(f"{step}/alphabet").join(run.table(f"{step}/sizes"), "text_id",
                                                        "left").select(
            F.lit(level.number).alias("level"), "text_id", "n", "n_symbols",
            F.coalesce("n_stars", F.lit(0)).alias("n_stars"),
            F.coalesce("n_names", F.lit(0)).alias("n_names")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """``(step, symbols, seconds, us_per_symbol, bytes)`` of the steps done in a run's folder.

    Steps are ``names-k`` on the way down and ``order-k`` on the way up; ``bytes`` is what the
    step's tables take.
    """
    run, rows, number = Run(spark, folder), [], 0
    while run.done(f"names-{number}") is not None:
        for row in (run.done(f"names-{number}"), run.done(f"order-{number}")):
            if row is not None:
                rows.append((row["step"], row["total"], row["seconds"],
                             1e6 * row["seconds"] / max(row["total"], 1), row["bytes"]))
        number += 1
    return spark.createDataFrame(
        rows, "step string, symbols long, seconds double, us_per_symbol double, bytes long")
