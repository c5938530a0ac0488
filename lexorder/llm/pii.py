"""Personal data: candidate spans chosen by gradient-boosted trees.

Four kinds of base spans (email, ip, card, phone) come from fixed patterns and checks.  Looser
generators propose more spans, which may overlap: whatever stands around an at sign, however it is
spelled, and whatever has enough digits, with any separators.  Spark's gradient-boosted trees,
one model per kind, learn from candidates how base spans look and what stands around them.  What
only the patterns ask for (the plus and country code of a phone, how an at sign is spelled, the
separators of a card) is masked from the features.  A candidate that is a base span is labelled; one
that touches none is unlabelled and may be one the patterns miss, unless it fails the check digit of
a card or the bounds of an address, which makes it no candidate.  The mean score of held-out base
spans tells how many of the true spans are labelled, and with it a candidate's score gives its
chance to be one (Elkan and Noto).  For each kind the least score from which on the mean chance
reaches the wanted precision, and at which most candidates are labelled, is the threshold; what
scores above it, and touches no base span, is added.  Base spans always stay.

The trees are fitted on all candidates of a kind but the quarter held out by hash, and chances and
threshold come from all of them.  (Spark's trees take the values at which they may split from some
10,000 rows.)  A kind without base spans, or that reaches the precision nowhere, adds nothing.

Defined results: a null or empty text has no spans.  Offsets are code points, ends exclusive.  Of
added spans that overlap the better one stays, then the earlier.  Null ids and repeated rows are
treated like any other.  Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexorder.staging import Stages, tasks_for

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99          # wanted of added spans
STEPS = 1024              # ranges of scores that a step towards the threshold looks at
TREES, DEPTH = 8, 3
REACH = 254               # characters of an address, by the rules of mail, so of a side of it
CONTEXT = 16              # characters before a candidate that features see

# Fixed patterns and bounds of the base spans.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match begins with a whole run of digits or none does in it, so no run is tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators of candidates.
NUMBER = re.compile(r"[0-9][0-9 ().\-/]{5,40}[0-9]")
LEFT, RIGHT = re.compile(r"[^\s@]+\Z"), re.compile(r"[^\s@]+")
AT = re.compile(r"\s?[\[(]\s?at\s?[\])]\s?", re.I)
COUNTRY = re.compile(r"\+?[0-9]{1,3}[ .-]*(?=\()|\+[0-9]{1,3}[ .-]+|\+")
CUES = ("mail", "contact", "call", "tel", "phone", "fax", "mobile", "card", "visa", "pay", "ip",
        "host", "addr", "server", "token", "version", "license", "isbn", "id")
WORDS_BEFORE = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from the at signs."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and _is_local(text[begin - 1]):
            begin -= 1
        match = EMAIL_DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            found.append((begin, match.end()))
        # A failed at sign is no local part, so what follows starts behind it.
        free = match.end() if match else at + 1
        at = text.find("@", free)
    return found


def _is_local(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) by kind, then begin."""
    found = [(0, a, b) for a, b in emails(text)]
    found += [(1, *m.span()) for m in IP.finditer(text)
              if all(_at_most_255(part) for part in m.group().split("."))]
    for match in CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *match.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text)
                  if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) of everything that might be of a kind; spans may overlap."""
    found = []
    at = text.find("@")
    while at >= 0:
        left, right = text[max(0, at - REACH):at], text[at + 1:at + REACH]
        begin = at - len(left.split()[-1]) if left and not left[-1].isspace() else at
        end = at + 1 + (len(right.split(None, 1)[0]) if right and not right[0].isspace() else 0)
        while end > at + 1 and not text[end - 1].isalnum():
            end -= 1
        while begin < at and not text[begin].isalnum():
            begin += 1
        if begin < at and end > at + 1:
            found.append((0, begin, end))
        at = text.find("@", at + 1)
    found += [(0, *span) for span in spelled(text)]
    for match in NUMBER.finditer(text):
        begin, end = match.span()
        digits = sum("0" <= c <= "9" for c in match.group())
        if begin and text[begin - 1] == "(":
            begin -= 1
        if begin and text[begin - 1] == "+":
            begin -= 1
        if 12 <= digits <= 19:
            found.append((2, *match.span()))
        if 7 <= digits <= 15:
            found.append((3, begin, end))
        if match.group().count(".") == 3 and digits <= 12:
            found.append((1, *match.span()))
    return found


def spelled(text: str) -> list[tuple[int, int]]:
    """What stands around at signs that are spelled in brackets, from the end of the one before."""
    found, free = [], 0
    for sign in AT.finditer(text):
        left = LEFT.search(text, max(free, sign.start() - REACH), sign.start())
        right = RIGHT.match(text, sign.end(), sign.end() + REACH)
        if left and right:
            found.append((left.start(), right.end()))
            free = right.end()
    return found


def masked(kind: int, span: str) -> str:
    """A span without the marks that only the patterns of its kind ask for."""
    if kind == 0:
        return AT.sub("@", span, count=1)
    if kind == 2:
        return re.sub(r"[ ().\-/]+", " ", span)
    return COUNTRY.sub("", span, count=1) if kind == 3 and COUNTRY.match(span) else span


def possible(kind: int, span: str) -> bool:
    """Whether a span passes the checks that every true one does, however it is written."""
    if kind == 1:
        return all(_at_most_255(part) for part in re.findall(r"[0-9]+", span))
    return kind != 2 or luhn("".join(c for c in span if "0" <= c <= "9"))


def features(text: str, kind: int, begin: int, end: int) -> list[float]:
    """Format and context of a span."""
    span = masked(kind, text[begin:end])
    digits = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    total = sum(digits)
    before = text[max(0, begin - CONTEXT):begin].lower()
    words = WORDS_BEFORE.findall(before)
    near = text[begin - 1] if begin else " "
    after = text[end] if end < len(text) else " "
    left, _, right = span.partition("@")
    labels = right.split(".")
    numbers = [int(g) for g in re.findall(r"[0-9]+", span)[:6] if len(g) < 6]
    return [float(x) for x in (
        len(span), total, len(digits), max(digits), min(digits), digits[0], digits[-1],
        sum(c.isalpha() for c in span), sum(not c.isascii() for c in span),
        span.count(" "), span.count("-"), span.count("."), span.count("("), span.count("/"),
        len(left), len(labels),
        len(labels[-1]) if labels[-1].isalpha() else 0,
        max(numbers, default=0) <= 255,
        near.isspace(), near.isalpha(), near.isdigit(), near in "\"'=:#",
        after.isspace(), after.isalpha(), after.isdigit(), after in "\"'",
        sum(cue in words for cue in CUES[:2]), sum(cue in words for cue in CUES[2:7]),
        sum(cue in words for cue in CUES[7:10]), sum(cue in words for cue in CUES[10:14]),
        sum(cue in words for cue in CUES[14:]), "=" in before[-3:], ":" in before[-3:])]


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{begin}:{end}" for kind, begin, end in spans)


FOUND = ("base array<struct<kind: int, begin: int, end: int>>, sha256 string, "
         "more array<struct<kind: int, begin: int, end: int, label: int, "
         "features: array<double>>>")


def read_text(text: str) -> dict:
    base = sorted(base_spans(text))
    taken = {(k, a, b) for k, a, b in base}
    # Of the base spans that begin before an offset, the farthest end.
    starts = sorted((a, b) for _, a, b in base)
    reached = list(accumulate((b for _, b in starts), max))
    more = []
    for kind, begin, end in sorted(set(candidates(text)) | taken):
        if (kind, begin, end) in taken:
            label = 1
        elif (n := bisect_left(starts, (end,))) and reached[n - 1] > begin:
            continue                     # part of a base span, or around one: neither
        elif not possible(kind, text[begin:end]):
            continue
        else:
            label = 0
        more.append({"kind": kind, "begin": begin, "end": end, "label": label,
                     "features": features(text, kind, begin, end)})
    return {"base": [{"kind": k, "begin": a, "end": b} for k, a, b in base],
            "sha256": hashlib.sha256(span_text(base).encode()).hexdigest(), "more": more}


def found_spans(text: str) -> Column:
    @F.pandas_udf(FOUND)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([read_text(t or "") for t in texts],
                               columns=["base", "sha256", "more"])

    return read(F.col(text))


def least_score(scores: DataFrame, precision: float) -> float | None:
    """The least score down to which the mean chance reaches the precision, None without any.

    ``scores`` are (score, chance), a row each, whose chance never falls with the score, so that the
    mean from the best row down never rises.  Scores are counted in ranges, then in ranges of the one
    range in which the mean falls below, until that is a single score.
    """
    found, n, total = None, 0, 0.0
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low is not None:
        within = scores.filter((F.col("score") >= low) & (F.col("score") <= high))
        part = F.least(F.floor((F.col("score") - low) / max((high - low) / STEPS, 1e-300)),
                       F.lit(STEPS - 1))
        ranges = within.groupBy(part.alias("part")).agg(
            F.count("*").alias("n"), F.sum("chance").alias("chance"),
            F.min("score").alias("low"), F.max("score").alias("high")).collect()
        low = None
        for rows in sorted(ranges, key=lambda rows: -rows["part"]):
            if total + rows["chance"] < precision * (n + rows["n"]):
                if rows["low"] < rows["high"]:
                    low, high = rows["low"], rows["high"]
                elif total + rows["chance"] / rows["n"] >= precision * (n + 1):
                    found = rows["low"]         # all of a score, if its first does
                break
            found, n, total = rows["low"], n + rows["n"], total + rows["chance"]
    return found


def choose(pool: DataFrame, kind: int, stages: Stages,
           precision: float = PRECISION) -> DataFrame | None:
    """Candidates of a kind that are no base spans, with a score at or above the threshold."""
    own = pool.filter(F.col("kind") == kind)
    counts = dict(own.groupBy("label").count().collect())
    if not counts.get(0) or not counts.get(1):
        return None
    rows = stages.save(
        own.select("row", "kind", "begin", "end", "draw", F.col("label").cast("double")
                   .alias("label"), array_to_vector("features").alias("features"))
        .repartition(tasks_for(pool.sparkSession, sum(counts.values())), "draw")
        .sortWithinPartitions("draw"), f"rows-{kind}")
    apart = F.pmod(F.shiftright("draw", 20), F.lit(4)) == 3      # what the trees do not see
    fit = rows.filter(~apart)
    if fit.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=3, stepSize=0.3)
    scored = stages.save(trees.fit(fit).transform(rows).select(
        "row", "kind", "begin", "end", "label", apart.alias("apart"),
        vector_to_array("probability")[1].alias("score")), f"scored-{kind}")
    held, seen = scored.filter("label = 1").agg(
        F.avg(F.when(F.col("apart"), F.col("score"))), F.avg("score")).first()
    labelled = seen if held is None else held
    if not 0 < labelled < 1:
        return None
    # The chance of an unlabelled candidate to be a true one.
    score = F.col("score")
    chance = F.least((1 - labelled) / labelled * score / F.greatest(1 - score, F.lit(1e-12)),
                     F.lit(1.0))
    new = scored.filter("label = 0")
    threshold = least_score(new.filter("score >= 0.5").select("score", chance.alias("chance")),
                            precision)
    if threshold is None:
        return None
    return new.filter(score >= threshold).select("row", "kind", "begin", "end", "score")


def _without_overlaps(spans: Column) -> Column:
    """Of structs sorted best first, those that overlap none before them."""
    none = F.filter(spans, lambda _: F.lit(False))
    return F.aggregate(spans, none, lambda kept, s: F.when(
        F.exists(kept, lambda k: (k["begin"] < s["end"]) & (s["begin"] < k["end"])), kept)
        .otherwise(F.concat(kept, F.array(s))))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the counts and digest of its base spans, and all its spans."""
    stages = Stages(docs.sparkSession)
    rows = stages.save(
        docs.select(F.col(doc_id).alias("doc_id"), found_spans(text).alias("found"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "found.*"), "found")
    pool = stages.save(
        rows.select("row", F.inline("more"))
        .withColumn("draw", F.xxhash64("row", "kind", "begin", "end")), "candidates")
    chosen = [c for kind in range(len(KINDS))
              if (c := choose(pool, kind, stages)) is not None]
    spans = F.col("base")
    if chosen:
        added = chosen[0]
        for more in chosen[1:]:
            added = added.union(more)
        best = F.array_sort(F.collect_list(F.struct(
            (-F.col("score")).alias("rank"), "begin", "end", "kind")))
        added = added.groupBy("row").agg(_without_overlaps(best).alias("added"))
        rows = rows.join(added, "row", "left")
        spans = F.concat("base", F.coalesce(F.transform("added", lambda s: F.struct(
            s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"))),
            F.expr("filter(base, x -> false)")))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", *[_number(kind).alias(f"n_{name}")
                                   for kind, name in enumerate(KINDS)],
                       F.col("sha256").alias("base_sha256"), listed.alias("spans"))


def _number(kind: int) -> Column:
    """How many base spans are of a kind."""
    return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long")
