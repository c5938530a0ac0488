"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary n-gram classifier (log-odds of
hashed byte n-grams, learned from the counts of all training rows) predicts a margin; decoding
sums a loss of each margin against each codeword, weighted by how reliable that bit was on that
language, and takes the nearest codeword.  A small lead over the second codeword is flagged.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not ambiguous;
without any labelled row everything is ``und``.  Training ignores null languages, the label
``und``, null ids (they have no fold; ``held_out`` is false) and texts without letters.  Repeated
rows count as often as they come.  Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder

BUCKETS = 1 << 15          # hashed n-grams; bucket 0 is kept free and weighs nothing
ORDERS = (2, 3)
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)   # odd 32-bit constants, one per byte
SMOOTHING = 0.5
PIECE = 1 << 20            # bytes handled at once
LANGUAGES_AT_ONCE = 64     # count arrays a task holds before it hands them on
MARGIN = 4.0               # what the mean margin of a bit is scaled to
AMBIGUOUS = 2.0            # lead in summed loss below which a decision is flagged
CALIBRATION_ROWS = 20_000  # labelled training rows that measure the bits' reliability

# Everything but letters becomes a space: ASCII letters and bytes of wider characters stay.
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _letters(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" "


def _grams(data: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram at each byte; 0 where it would run over the end of its text."""
    wide = data.astype(np.uint32)
    code = np.zeros(len(wide), dtype=np.uint32)
    for i in range(order):
        code[:len(wide) - i] += (wide[i:] + np.uint32(1 + 256 * order)) * np.uint32(
            MULTIPLIERS[i])
    code = (code ^ (code >> np.uint32(15))) * np.uint32(MULTIPLIERS[0])
    bucket = (code >> np.uint32(17)).astype(np.int64) % (BUCKETS - 1) + 1
    for i in range(1, order):
        over = ends - i
        bucket[over[over >= 0]] = 0
    return bucket


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined up to ``PIECE`` bytes; longer ones in overlapping cuts.

    Yields the bytes, where each part ends, and the text each part is of.
    """
    overlap = max(ORDERS) - 1
    held, owners, size = [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - overlap, 1), PIECE):
            part = text[at:at + PIECE + overlap]
            held.append(part)
            owners.append(number)
            size += len(part)
            if size >= PIECE:
                yield _joined(held, owners)
                held, owners, size = [], [], 0
    if held:
        yield _joined(held, owners)


def _joined(parts, owners):
    ends = np.cumsum([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), ends, np.array(owners)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, bucket, n), summed over as many rows as fit in memory."""
    counts: dict[str, np.ndarray] = {}

    def rows():
        for lang, array in counts.items():
            at = np.flatnonzero(array)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(array[at])], names=["lang", "bucket", "n"])
        counts.clear()

    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(_letters(text))
        for lang, texts in by_lang.items():
            if lang not in counts:
                if len(counts) >= LANGUAGES_AT_ONCE:
                    yield from rows()
                counts[lang] = np.zeros(BUCKETS, dtype=np.int64)
            for data, ends, _ in _pieces(texts):
                for order in ORDERS:
                    counts[lang] += np.bincount(_grams(data, ends, order), minlength=BUCKETS)
    yield from rows()


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Rows of +1/-1, one per language: every split of up to 7 languages, else a random code.

    Of 64 seeded random codes of 10 log2(n) bits the one whose closest codewords differ most.
    """
    if n <= 1:
        return np.ones((n, 1), dtype=np.float32)
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))       # the last language is always on the same side
        code = np.stack([(bits >> i) & 1 for i in range(n)])
    else:
        rng = np.random.default_rng(seed)
        length = int(np.ceil(10 * np.log2(n)))
        best, code = -1, None
        for _ in range(64):
            drawn = rng.integers(0, 2, (n, length))
            drawn = drawn[:, (drawn.min(0) == 0) & (drawn.max(0) == 1)]
            apart = (drawn[:, None, :] != drawn[None, :, :]).sum(-1) + length * np.eye(n, dtype=int)
            if apart.min() > best:
                best, code = apart.min(), drawn
    return np.where(code, 1, -1).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray        # languages x bits, +1 or -1
    weights: np.ndarray     # buckets x bits, scaled so that a clear text has margins near MARGIN
    trust: np.ndarray       # languages x bits, rows sum to the number of bits

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log-odds per n-gram of each text, one column per bit."""
        total = np.zeros((len(texts), self.weights.shape[1]))
        grams = np.zeros(len(texts))
        for data, ends, owners in _pieces([_letters(t) for t in texts]):
            starts = np.concatenate([[0], ends[:-1]])
            for order in ORDERS:
                bucket = _grams(data, ends, order)
                np.add.at(total, owners, np.add.reduceat(self.weights[bucket], starts, axis=0,
                                                         dtype=np.float64))
                np.add.at(grams, owners, np.add.reduceat((bucket > 0).astype(np.int64), starts))
        return total / np.maximum(grams, 1)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each text (row) against each codeword: logistic loss weighted by trust."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :])
        return (loss * self.trust[None, :, :]).sum(-1)

    def decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score in 0..1, and whether the lead is small."""
        losses = self.losses(self.margins(texts))
        best = losses.argmin(1)
        least = losses.min(1, keepdims=True)
        score = 1 / np.exp(least - losses).sum(1)
        if losses.shape[1] > 1:
            lead = np.partition(losses, 1, axis=1)[:, 1] - least[:, 0]
        else:
            lead = np.full(len(texts), np.inf)
        return best, score, lead < AMBIGUOUS


def _weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log-odds of the languages on either side of each bit; all languages weigh the same."""
    share = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * counts.shape[1])
    columns = []
    for bit in range(code.shape[1]):
        plus, minus = code[:, bit] > 0, code[:, bit] < 0
        if not plus.any() or not minus.any():
            columns.append(np.zeros(counts.shape[1]))
            continue
        odds = np.log(share[plus].mean(0)) - np.log(share[minus].mean(0))
        odds[0] = 0
        usual = np.abs(share @ odds).mean()
        columns.append(odds * (MARGIN / max(usual, 1e-9)))
    return np.stack(columns, 1).astype(np.float32)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang",
        calibration_rows: int = CALIBRATION_ROWS) -> LanguageModel | None:
    """Learn from all labelled rows; None if there is none.

    The counts cover every row.  The driver gets one number per language and bucket.  Only the
    bits' reliability is measured on a sample, at most about ``calibration_rows`` distinct texts.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
                           ).filter("lang IS NOT NULL AND lang <> 'und'").filter(
                               has_letter(F.col("text")))
    table = (rows.mapInArrow(count_grams, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    if table.empty:
        return None
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[table["lang"].map({x: i for i, x in enumerate(languages)}), table["bucket"]] = table["n"]
    counts[:, 0] = 0
    code = codewords(len(languages))
    model = LanguageModel(languages, code, _weights(counts, code), np.ones_like(code))
    model.trust = _trust(spark, rows, model, calibration_rows)
    return model


def _trust(spark: SparkSession, rows: DataFrame, model: LanguageModel, bound: int) -> np.ndarray:
    """Share of sampled training rows of each language for which each bit has the right sign."""
    # Distinct texts are drawn, an equal number of each language, so that neither a text with many
    # copies nor a frequent language leaves nothing to the others.
    draw = F.xxhash64("text", F.lit("calibration"))
    kinds = rows.select("lang", draw.alias("draw")).distinct().groupBy("lang").count().collect()
    each = max(1, bound // max(len(kinds), 1))
    parts = F.create_map(*[F.lit(x) for row in kinds for x in
                           (row["lang"], max(1, -(-row["count"] // each)))])
    sample = (rows.withColumn("draw", draw)
              .filter(F.pmod("draw", F.element_at(parts, F.col("lang"))) == 0)
              .dropDuplicates(["lang", "draw"]))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<int>")
    def right(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = shared.value
        place = {x: i for i, x in enumerate(known.languages)}
        for text, lang in batches:
            good = known.margins(list(text)) * known.code[[place[x] for x in lang]] > 0
            yield pd.Series(list(good.astype(np.int32)))

    bits = range(model.code.shape[1])
    found = (sample.select("lang", right("text", "lang").alias("good")).groupBy("lang")
             .agg(*[F.avg(F.col("good")[b]).alias(f"b{b}") for b in bits]).collect())
    trust = np.ones_like(model.code)
    for row in found:
        trust[model.languages.index(row["lang"])] = [row[f"b{b}"] for b in bits]
    trust = np.maximum(trust, 1e-3)
    return trust / trust.sum(1, keepdims=True) * trust.shape[1]


def predict(df: DataFrame, model: LanguageModel | None, text: str = "text") -> Column:
    """A column struct<lang, score, ambiguous> for the whole text of each row of ``df``."""
    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"),
                   F.lit(False).alias("ambiguous"))
    if model is None:
        return und
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            best, score, close = known.decode(["" if t is None else t for t in texts])
            yield pd.DataFrame({"lang": np.array(known.languages, dtype=object)[best],
                                "score": score, "ambiguous": close})

    return F.when(has_letter(F.col(text)), decoded(F.col(text))).otherwise(und)


def train_fold(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.filter(remainder(doc_id, 4) != 2)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """Predict the language of every row, learning from the rows of the training fold only."""
    model = fit(train_fold(docs, doc_id), text, lang)
    found = docs.select(F.col(doc_id).alias("doc_id"),
                        F.coalesce(remainder(doc_id, 4) == 2, F.lit(False)).alias("held_out"),
                        predict(docs, model, text).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"),
                        F.col("found.score").alias("score"),
                        F.col("found.ambiguous").alias("ambiguous"))
