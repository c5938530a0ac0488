"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by k = m * rate edits.  It is split into
k + 1 pieces; by the pigeonhole principle a passage within k edits holds one piece unchanged.
An Aho-Corasick automaton finds the exact pieces in every whole text, each hit says where its item
would lie, and Myers' bit-parallel algorithm gives the least edit distance of the item to any
passage there.

Items are read in blocks of at most ``BLOCK_BYTES`` characters' bytes, and each block is sent to
all tasks; a benchmark of any size is so many passes over the texts.

Both sides are compared in lower case with every run of other than letters and digits as one
space.  Defined results: null texts, and null or empty items, match nothing.  An item below
``SHORTEST`` normalised characters allows no edit and must stand between word ends, as it would
otherwise be found everywhere.  Rows that repeat an item id are separate items.  Repeated
documents and null ids are matched like any other.  Extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.07               # edits allowed per character of an item
SHORTEST = 20             # normalised characters below which an item must match exactly
BLOCK_BYTES = 4 << 20     # of items held by a task at once
_OTHER = re.compile(r"[\W_]+")
HITS = "array<struct<item_id: {id}, distance: int, begin: int, end: int>>"


def normalise(text: str) -> str:
    return " " + _OTHER.sub(" ", text.lower()).strip() + " "


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``item`` cut into edits + 1 pieces of nearly equal length, with their offsets."""
    n, parts = len(item), edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def peq(item: str) -> dict[str, int]:
    """For each character, the bits of the places in ``item`` that have it."""
    bits: dict[str, int] = {}
    for i, c in enumerate(item):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def best_match(bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of an item of ``m`` characters to any substring, and where one ends.

    Myers' bit-parallel recursion, the item's columns in one integer.
    """
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best, where = m, 0
    for at, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & mask
        h_plus = minus | (mask & ~(zero | plus))
        h_minus = zero & plus
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & mask       # a match may start anywhere: no cost at the top
        h_minus = (h_minus << 1) & mask
        plus = h_minus | (mask & ~(zero | h_plus))
        minus = zero & h_plus
        if score < best:
            best, where = score, at
    return best, where


@dataclass
class Item:
    item_id: object
    text: str
    edits: int
    bits: dict[str, int]


class Matcher:
    """The automaton of all pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE):
        self.items: list[Item] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normalise(raw or "")
            if not text.strip():
                continue
            # A short item keeps the spaces around it, and so its word ends.
            short = len(text) - 2 < SHORTEST
            text = text if short else text.strip()
            edits = 0 if short else int(len(text) * rate)
            for offset, piece in pieces(text, edits):
                places.setdefault(piece, []).append((len(self.items), offset))
            self.items.append(Item(item_id, text, edits, peq(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> list[tuple]:
        """(item_id, distance, begin, end) of the best passage of each item that a text has.

        ``begin`` and ``end`` bound the place searched in the normalised text.
        """
        if not raw or not self.items:
            return []
        text = normalise(raw)
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                starts.setdefault(number, set()).add(end + 1 - length - offset)
        found = []
        for number, places in sorted(starts.items()):
            item = self.items[number]
            m, k = len(item.text), item.edits
            best = None
            for low, high in _merged(sorted(places), 2 * k):
                begin, end = max(0, low - k), high + m + k
                distance, at = best_match(item.bits, m, text[begin:end])
                if distance <= k and (best is None or distance < best[1]):
                    best = (item.item_id, distance, begin, begin + at)
            if best:
                found.append(best)
        return found


def _merged(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """Starts closer than ``gap`` to each other, as ranges."""
    low = high = None
    for start in starts:
        if high is not None and start - high <= gap:
            high = start
            continue
        if high is not None:
            yield low, high
        low = high = start
    if high is not None:
        yield low, high


def item_blocks(items: DataFrame, item_id: str, text: str,
                block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes`` each, however many there are."""
    chosen = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).filter(
        "length(text) > 0")
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for number in range(blocks):
        rows = chosen.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == number)
        yield [(r["id"], r["text"]) for r in rows.orderBy("id", "text").collect()]


def matches(df: DataFrame, block: list[tuple], id_type: str, text: str = "text",
            rate: float = RATE) -> Column:
    """Array of the hits of each whole text with the items of one block."""
    shared = df.sparkSession.sparkContext.broadcast((block, rate))

    @F.pandas_udf(HITS.format(id=id_type))
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(*shared.value)
        names = ("item_id", "distance", "begin", "end")
        for texts in batches:
            yield pd.Series([[dict(zip(names, hit)) for hit in matcher.find(t)] for t in texts],
                            dtype=object)

    return hits(F.col(text))


def find_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id",
                      text: str = "text", item_id: str = "item_id", item_text: str = "text",
                      rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, begin, end): a row for each item that a document holds."""
    id_type = items.schema[item_id].dataType.simpleString()
    found = None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        hits = docs.select(F.col(doc_id).alias("doc_id"),
                           F.inline(matches(docs, block, id_type, text, rate)))
        found = hits if found is None else found.union(hits)
    if found is None:
        none = F.array().cast(HITS.format(id=id_type))
        found = docs.select(F.col(doc_id).alias("doc_id"), F.inline(none))
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text",
                         item_id: str = "item_id", item_text: str = "text", rate: float = RATE,
                         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    id_type = items.schema[item_id].dataType.simpleString()
    for block in item_blocks(items, item_id, item_text, block_bytes):
        docs = docs.filter(F.size(matches(docs, block, id_type, text, rate)) == 0)
    return docs
