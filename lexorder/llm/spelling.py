"""Grouping spelling variants: words one edit apart, and the frequent form each belongs to.

Words are counted over all texts.  Two words one edit apart have letter counts whose squared
distance is 1 (a code point inserted or deleted) or 2 (replaced), so NumPy products of blocks of
letter counts (Gram matrices) give all candidates: pairs at a squared distance of at most two in
blocks of the same or the next length.  Every candidate's edit is then verified on its letters.

A block is known by its length and by the number of letters it has of each of a few classes of
letters.  An edit changes one class's number by one, or moves one letter from a class to another,
so a word meets its own block and the few adjacent ones, and no pair within an edit is lost.  The
number of classes grows with the logarithm of the vocabulary; letters are dealt to classes by how
often they occur.  A block of many rows is cut, and each pair of its parts is a group of its own,
so no group has more than ``2 * GROUP_ROWS`` rows.  Groups hand on one row per word (its near
words counted, the most frequent one), never pairs.

Defined results: a null text has no words; a null id counts as no characters before the colon of
the hashed text.  Repeated rows count each.  Ties of forms go to the smallest word in code-point
order.  An empty table gives no rows.  Very long runs are words like any other.  Extra columns do
not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexorder.staging import Stages

from .common import utf8

SHORTEST = 7            # code points of a word
LEAST = 2               # occurrences of a word
FACTOR = 10             # a form has so many times the occurrences
EDITED = 31             # runs whose hash this divides lose a code point
GROUP_ROWS = 1 << 16    # rows of a block's part
HELD = 1 << 18          # words that a task counts before it hands them on
PRODUCT = 1 << 23       # entries of a Gram matrix at once
CHECKED = 1 << 22       # letters compared at once

RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: bytes, doc_id: str) -> Iterator[tuple[str, int]]:
    """The words of a text as they are after the deletions, with their numbers."""
    begin = crc32(f"{doc_id}:".encode())
    for run, times in Counter(RUN.findall(text.translate(LOWER).decode())).items():
        code = crc32(run.encode(), begin)
        if code % EDITED == 0:
            at = code % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < SHORTEST:
                continue
        yield run, times


def count_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(word, n) of all words that occur often enough."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch():
            made = pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
            held.clear()
            return made

        for part in batches:
            for name, body in zip(part.column(0), part.column(1)):
                for word, times in words_of(body.as_py(), name.as_py()):
                    held[word] += times
                if len(held) > HELD:
                    yield batch()
        if held:
            yield batch()

    return (docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
                        utf8(text).alias("text"))
            .mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST))


def letter_classes(words: DataFrame, size: int) -> list[str]:
    """The letters in use, dealt to ``size`` classes of nearly equal weight."""
    def count(batches):
        for part in batches:
            letters = np.frombuffer("".join(part.column(0).to_pylist()).encode("latin-1"),
                                    np.uint8)
            total = np.bincount(letters, minlength=256)
            yield pa.RecordBatch.from_pydict({"letter": np.flatnonzero(total),
                                              "n": total[total > 0]})

    rows = (words.select("word").mapInArrow(count, "letter long, n long")
            .groupBy("letter").agg(F.sum("n").alias("n")).collect())     # 256 at most
    classes, load = [""] * size, [0] * size
    for row in sorted(rows, key=lambda r: (-r["n"], r["letter"])):
        lightest = load.index(min(load))
        classes[lightest] += chr(row["letter"])
        load[lightest] += row["n"]
    return classes


def _moves(size: int) -> list[list[int]]:
    """Changes of the class numbers that lead a word to the blocks that it visits.

    Of two adjacent blocks one is visited by the other's words: the longer one, or the one with
    more letters of a later class.
    """
    def change(**by):
        return [by.get(f"c{i}", 0) for i in range(size)]

    return ([change(**{f"c{i}": 1}) for i in range(size)]
            + [change(**{f"c{i}": -1, f"c{j}": 1}) for i in range(size) for j in range(i + 1, size)])


def _visits(numbers: list[Column]) -> Column:
    """Array of the blocks that a word is in (first, ``home``) or visits; null where there is none."""
    def block(change, home):
        key = F.concat_ws(",", *[(n + c).cast("string") for n, c in zip(numbers, change)])
        made = F.struct(key.alias("block"), F.lit(home).alias("home"))
        for n, c in zip(numbers, change):
            if c < 0:
                made = F.when(n + c >= 0, made)
        return made

    return F.array(block([0] * len(numbers), True),
                   *[block(change, False) for change in _moves(len(numbers))])


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def _replaced(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether words of one length differ in exactly one code point."""
    return np.count_nonzero(left != right, axis=1) == 1


def _inserted(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether a word is the other one with one more code point."""
    size = shorter.shape[1]
    same = np.ones((len(longer), size + 1), dtype=bool)
    np.logical_and.accumulate(longer[:, :-1] == shorter, axis=1, out=same[:, 1:])
    ahead = same.sum(axis=1) - 1
    same[:, 0] = True
    np.logical_and.accumulate((longer[:, 1:] == shorter)[:, ::-1], axis=1, out=same[:, 1:])
    return ahead + same.sum(axis=1) - 1 >= size


def near_pairs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words one edit apart; ``right`` has the length of ``left`` or one less.

    Both are matrices of Latin-1 letters.  The Gram matrix is made block by block.
    """
    if not len(left) or not len(right):
        return
    longest = left.shape[1]
    used = np.unique(np.concatenate([np.unique(left), np.unique(right)]))
    place = np.zeros(256, dtype=np.int64)
    place[used] = np.arange(len(used))
    kind = np.float32 if longest < 2000 else np.float64     # squares that it holds exactly

    def counts(part):
        at = place[part] + (np.arange(len(part)) * len(used))[:, None]
        return np.bincount(at.ravel(), minlength=len(part) * len(used)).reshape(
            len(part), len(used)).astype(kind)

    rest = counts(right)
    rest_norm = np.einsum("ij,ij->i", rest, rest)
    verify = _replaced if right.shape[1] == longest else _inserted
    rows = max(1, PRODUCT // len(right))
    step = max(1, CHECKED // longest)
    for begin in range(0, len(left), rows):
        block = counts(left[begin:begin + rows])
        norm = np.einsum("ij,ij->i", block, block)
        distance = block @ rest.T
        distance *= -2
        distance += norm[:, None]
        distance += rest_norm
        close = np.flatnonzero(distance.ravel() <= 2)
        for cut in range(0, len(close), step):
            i, j = np.divmod(close[cut:cut + step], len(right))
            i += begin
            good = verify(left[i], right[j])
            if good.any():
                yield i[good], j[good]


def _group(table: pa.Table) -> pa.Table:
    """One pair of parts of a block: (word, n_near, near_n, near) of words with near ones."""
    words, side = table.column("word").to_pylist(), table.column("side").to_numpy()
    n = table.column("n").to_numpy()
    near = np.zeros(len(words), dtype=np.int64)
    best = np.full(len(words), len(words))
    left = np.flatnonzero(side & 1)
    if len(left):
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        sizes = np.array([len(word) for word in words])
        length, home = sizes[left[0]], table.column("home").to_numpy(False)
        spelt = _letters([words[i] for i in left], length)
        # Two words at home meet in both orders; a visitor meets words at home once.
        place = np.empty(len(words), dtype=np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        for size in (length, length - 1):
            right = np.flatnonzero((side & 2 > 0) & (sizes == size))
            for i, j in near_pairs(spelt, _letters([words[k] for k in right], size)):
                i, j = left[i], right[j]
                once = ~home[j] | (place[i] < place[j])
                i, j = i[once], j[once]
                for one, other in ((i, j), (j, i)):
                    near += np.bincount(one, minlength=len(words))
                    np.minimum.at(best, one, rank[other])
    has = np.flatnonzero(near)
    found = np.asarray(order if len(left) else [], dtype=np.int64)[best[has]] if len(has) else has
    return pa.table({"word": pa.array([words[i] for i in has], pa.string()), "n_near": near[has],
                     "near_n": n[found], "near": pa.array([words[i] for i in found], pa.string())})


def near_words(words: DataFrame, size: int, stages: Stages) -> DataFrame:
    """(word, n_near, near_n, near): the number of near words and the most frequent one."""
    classes = letter_classes(words, size)
    numbers = [F.length("word") - F.length(F.translate("word", letters, "")) if letters
               else F.lit(0) for letters in classes]
    numbered = words.select("word", "n", *[n.alias(f"c{i}") for i, n in enumerate(numbers)])
    columns = [f"c{i}" for i in range(size)]
    visit = F.explode(_visits([F.col(c) for c in columns])).alias("v")
    visits = (numbered.select("word", "n", visit).filter("v is not null")
              .select("word", "n", "v.block", "v.home"))
    # How many rows a block has is known from the numbers of its words and of its neighbours'.
    crowded = stages.save(
        numbered.groupBy(columns).agg(F.count("*").alias("rows")).select("rows", visit)
        .filter("v is not null").groupBy("v.block").agg(F.sum("rows").alias("rows"))
        .filter(F.col("rows") > GROUP_ROWS)
        .select("block", F.ceil(F.col("rows") / GROUP_ROWS).cast("int").alias("parts")), "crowded")
    if crowded.isEmpty():
        grouped = visits.withColumns({"i": F.lit(0), "j": F.lit(0),
                                      "side": F.when(F.col("home"), 3).otherwise(2)})
    else:
        part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
        others = F.sequence(F.lit(0), F.col("parts") - 1)
        as_right = F.transform(others, lambda k: F.struct(
            k.alias("i"), part.alias("j"),
            F.when(F.col("home") & (k == part), 3).otherwise(2).alias("side")))
        as_left = F.transform(F.filter(others, lambda k: F.col("home") & (k != part)),
                              lambda k: F.struct(part.alias("i"), k.alias("j"),
                                                 F.lit(1).alias("side")))
        grouped = (visits.join(crowded, "block", "left").fillna({"parts": 1})
                   .select("*", F.explode(F.concat(as_right, as_left)).alias("g"))
                   .select("word", "n", "block", "home", "g.*"))
    found = grouped.groupBy("block", "i", "j").applyInArrow(
        _group, "word string, n_near long, near_n long, near string")
    return (found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        .select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near"))


def roots(forms: DataFrame, most: int, stages: Stages) -> DataFrame:
    """(word, form) to (word, root): the last of the forms, by pointer jumping.

    A form has ``FACTOR`` times the occurrences, so ``most`` bounds the number of steps.
    """
    steps = 0
    while LEAST * FACTOR ** (steps + 1) <= most:
        steps += 1
    at = forms.select("word", F.col("form").alias("root"))
    for turn in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        then = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        at = stages.save(at.join(then, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root")), f"roots-{turn}")
    return at


def spelling_forms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   classes: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the table.

    ``classes`` is the number of letter classes; by default it follows the vocabulary's size.
    """
    stages = Stages(docs.sparkSession)
    words = stages.save(count_words(docs, doc_id, text), "words")
    size, most = words.agg(F.count("*"), F.max("n")).first()
    near = near_words(words, classes or max(3, size.bit_length() // 3 - 1), stages)
    fits = F.col("near_n") >= FACTOR * F.col("n")
    found = stages.save(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("near")).alias("form"),
        F.when(fits, F.col("near_n")).alias("form_n")), "near")
    ends = roots(found.filter("form is not null").select("word", "form"), most or 0, stages)
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
