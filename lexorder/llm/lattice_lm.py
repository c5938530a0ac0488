"""Language-model scores by subword lattices.

The vocabulary is that of an existing tokenizer: its pieces, and every single byte.  All
segmentations of a token into pieces form a lattice, and a forward recursion in log space sums their
probabilities, so ``score`` is the text's marginal probability over all segmentations.

Every word goes through its lattice, however often it was seen.  A token is the end of the text with
q = (training texts + 1) / (training tokens + 2), or a word with (1 - q) times its lattice: the
probabilities of its pieces, the first one a word start, and the probability that the next piece
starts a word.  Piece probabilities are the vocabulary's own scores (of a merge list, whose scores
are ranks, 1 / (rank + 1)), rescaled by rounds of forward-backward over all training words: a
piece's expected count is added to its share of ``STRENGTH`` times all expected counts by the
vocabulary's scores.  The tokenizer itself is not trained.

``word_score`` is another model beside it, of words: with N training tokens of which n1 words
occurred once, a token has (1 - e) c / N + e times its probability above, e = (n1 + 1) / (N + 1).

Pieces do not cross words, so a distinct word is recursed through once, and not once per
occurrence.  Words are counted over the whole table.  At most ``HEAD`` words can each hold
1 / ``HEAD`` of all tokens; those are sent to all tasks, and the others' scores are joined by word
and summed by row, so no word is hot in the join.

Defined results: a null or empty text has one token, its end.  A null id is in no fold: it does
not train and is not held out.  Without training rows all counts are 0 and everything is spelled.
Repeated rows count as often as they come; texts and single words may be of any length.  Extra
columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexorder.staging import Stages

from .common import remainder, utf8

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"           # how the tokenizer's files mark the start of a word
SPACE = b" "               # how it is marked here; no word has it
END = b""                  # the end of a text among the words
ROUNDS = 2                 # of forward-backward over the training words
HEAD = 1 << 17             # words sent to all tasks, at most
HEAD_BYTES = 64            # a longer word is never sent
COUNTED = 300_000          # distinct words a task counts before it hands them on
CELLS = 1 << 19            # characters recursed through at once
PART = 1024                # bytes of a word whose table both recursions hold when fitting
STRENGTH = 0.1             # of the vocabulary's scores, in expected counts of all pieces
BASE = np.uint64(0x100000001B3)   # of the rolling hash


def load_pieces(path: str = PIECES) -> tuple[list[bytes], np.ndarray]:
    """The tokenizer's pieces, and every single byte, with log probabilities from its scores.

    Scores of a merge list are the negative ranks, which stand for probabilities falling as
    1 / (rank + 1); scores of a unigram vocabulary are log probabilities as they are.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {}
    for i in range(model.vocab_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            score.setdefault(bytes([int(text[3:5], 16)]), -1e9)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            if START not in text[1:] and text != START * len(text) or text == START:
                score[text.replace(START, " ").encode()] = model.get_score(i)
    for byte in range(256):
        score.setdefault(bytes([byte]), -1e9)
    names = sorted(score)
    own = np.array([score[n] for n in names])
    order = np.argsort(-own, kind="stable")
    share = np.empty(len(names))
    if len(own) and own[own > -1e8].min(initial=0) < -1000:        # ranks
        share[order] = 1 / (np.arange(len(names)) + 1.0)
    else:
        share = np.exp(np.maximum(own, own[own > -1e8].min(initial=0) - 1))
    return names, np.log(share / share.sum())


@dataclass
class Arcs:
    """The pieces that some words hold, by length: (length, word, piece, first arc of each end)."""

    length: np.ndarray
    widest: int
    found: list[tuple]

    def into(self, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(begin, words, pieces) of the arcs that end at a place, for each length."""
        for n, row, piece, first in self.found:
            if n > end:
                return
            some = slice(first[end], first[end + 1])
            if some.start < some.stop:
                yield end - n, row[some], piece[some]


@dataclass
class Lattice:
    """Pieces in a hash table, and the recursions over many words at once."""

    names: list[bytes]
    log_p: np.ndarray

    def __post_init__(self):
        self.lengths = sorted({len(n) for n in self.names})
        codes = np.array([_code(n) for n in self.names], dtype=np.uint64)
        self.bits = 18
        while True:      # a table without collisions needs no second probe
            slot = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
            if self.bits >= 22 or len(np.unique(slot)) == len(slot):
                break
            self.bits += 1
        self.table: np.ndarray = np.full(1 << self.bits, -1, dtype=np.int32)
        self.next = np.full(len(codes), -1, dtype=np.int32)
        for i, s in enumerate(slot.tolist()):    # what collides hangs on in a chain
            self.next[i] = self.table[s]
            self.table[s] = i
        self.chained = bool((self.next >= 0).any())
        self.codes = codes

    def _pieces(self, code: np.ndarray) -> np.ndarray:
        """Number of the piece with each code, -1 for none."""
        found = self.table[(code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)]
        while self.chained and (wrong := (found >= 0) & (self.codes[found] != code)).any():
            found[wrong] = self.next[found[wrong]]
        found[(found >= 0) & (self.codes[found] != code)] = -1
        return found

    def arcs(self, words: list[bytes]) -> Arcs:
        """All arcs of some words, which should be of similar length."""
        length = np.array([len(w) for w in words])
        widest = int(length.max())
        flat = np.zeros((widest, len(words)), dtype=np.uint64)
        joined = np.frombuffer(b"".join(words), dtype=np.uint8)
        row = np.repeat(np.arange(len(words)), length)
        at = np.arange(len(joined)) - np.repeat(np.cumsum(length) - length, length)
        flat[at, row] = joined.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((widest + 1, len(words)), dtype=np.uint64)
        for i in range(widest):
            prefix[i + 1] = prefix[i] * BASE + flat[i]
        ends = np.arange(widest + 1)
        found = []
        for n in self.lengths:
            if n > widest:
                break
            power = np.uint64(pow(int(BASE), n, 1 << 64))
            piece = self._pieces(prefix[n:] - prefix[:-n] * power)
            piece[ends[n:, None] > length[None, :]] = -1
            end, row = np.nonzero(piece >= 0)
            if len(end):
                found.append((n, row, piece[end, row], np.searchsorted(end + n, ends).tolist()
                              + [len(end)]))
        return Arcs(length, widest, found)

    def forward(self, arcs: Arcs) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of all segmentations of each word, and the table on the way."""
        words = np.arange(len(arcs.length))
        alpha = np.full((arcs.widest + 1, len(words)), -np.inf)
        alpha[0] = 0
        for end in range(1, arcs.widest + 1):
            for begin, row, piece in arcs.into(end):
                alpha[end, row] = np.logaddexp(alpha[end, row],
                                               alpha[begin, row] + self.log_p[piece])
        return alpha[arcs.length, words], alpha

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each as many times as it occurred."""
        arcs = self.arcs(words)
        total, alpha = self.forward(arcs)
        beta = np.full(alpha.shape, -np.inf)
        beta[arcs.length, np.arange(len(words))] = 0
        counts = np.zeros(len(self.names))
        for end in range(arcs.widest, 0, -1):
            for begin, row, piece in arcs.into(end):
                after = beta[end, row] + self.log_p[piece]
                beta[begin, row] = np.logaddexp(beta[begin, row], after)
                share = np.exp(alpha[begin, row] + after - total[row]) * times[row]
                np.add.at(counts, piece, share)
        return counts


def _code(piece: bytes) -> int:
    code = 0
    for byte in piece:
        code = (code * int(BASE) + byte + 1) % (1 << 64)
    return code


def _groups(words: list[bytes]) -> Iterator[np.ndarray]:
    """Numbers of words in groups of similar length and bounded size."""
    length = np.array([len(w) for w in words])
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        # The longest word of a group sets its width.
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * length[order[stop]] <= CELLS and length[
                order[stop]] <= 2 * length[order[at]]:
            stop = min(len(order), stop + max(1, (stop - at) // 8))
        yield order[at:stop]
        at = stop


# --- counting ---------------------------------------------------------------------------------

def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (trains, text) to (word, c, everywhere), summed within a task."""
    trained, rest = Counter(), Counter()

    def rows():
        words = list(trained.keys() | rest.keys())
        c = np.array([trained[w] for w in words], dtype=np.int64)
        both = c + np.array([rest[w] for w in words], dtype=np.int64)
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[at:at + 50_000], pa.binary()), pa.array(c[at:at + 50_000]),
                 pa.array(both[at:at + 50_000])], names=["word", "c", "everywhere"])
        trained.clear()
        rest.clear()

    for batch in batches:
        for trains, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            into = trained if trains else rest
            into.update(text.lower().split())
            into[END] += 1
            if len(into) > COUNTED:
                yield from rows()
    yield from rows()


@dataclass
class Counts:
    """Of the training tokens: all, distinct, words that occurred once, and texts."""

    tokens: int
    distinct: int
    once: int
    ends: int
    everywhere: int

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    @property
    def spelled(self) -> float:
        return (self.once + 1) / (self.tokens + 1)

    @property
    def ends_spelled(self) -> float:
        return (self.ends + 1) / (self.tokens + 2)


def _in_parts(words: list[bytes], times: list[int]) -> tuple[list[bytes], np.ndarray]:
    """Words to be fitted; what is longer than ``PART`` bytes is fitted in parts."""
    here, counts = [], []
    for word, n in zip(words, times):
        word = SPACE + word
        parts = [word[at:at + PART] for at in range(0, len(word), PART)]
        here += parts
        counts += [n] * len(parts)
    return here, np.array(counts, dtype=float)


def fit_pieces(words: DataFrame, names: list[bytes], log_p: np.ndarray,
               rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces after rounds of forward-backward over training words."""
    spark = words.sparkSession
    training = words.filter("c > 0 AND length(word) > 0").select("word", "c")
    own = np.exp(log_p)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Lattice(names, log_p))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = shared.value
            counts = np.zeros(len(lattice.names))
            for batch in batches:
                here, times = _in_parts(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for group in _groups(here):
                    counts += lattice.expected([here[i] for i in group], times[group])
            at = np.flatnonzero(counts > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)),
                                              pa.array(counts[at])], names=["piece", "n"])

        summed = training.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(
            F.sum("n").alias("n")).collect()
        if not summed:
            break
        counts = np.zeros(len(names))
        for piece, n in summed:
            counts[piece] = n
        counts += STRENGTH * counts.sum() * own
        log_p = np.log(counts / counts.sum())
    return log_p


def score_words(words: DataFrame, names: list[bytes], log_p: np.ndarray,
                counts: Counts) -> DataFrame:
    """(word, known, everywhere, base, score, mixed) of every distinct word, and of the end."""
    shared = words.sparkSession.sparkContext.broadcast((Lattice(names, log_p), counts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, of = shared.value
        spelled = of.spelled
        for batch in batches:
            raw = batch.column(0).to_pylist()
            c = batch.column(1).to_numpy().astype(float)
            log_word = np.full(len(raw), math.log(of.ends_spelled))
            number = np.array([i for i, w in enumerate(raw) if w != END], dtype=np.int64)
            here = [SPACE + raw[i] for i in number]
            for group in _groups(here) if here else ():
                total, _ = lattice.forward(lattice.arcs([here[i] for i in group]))
                # That the first piece is a start is given, that one follows is not: they cancel.
                log_word[number[group]] = total + math.log1p(-of.ends_spelled)
            seen = (1 - spelled) * c / max(of.tokens, 1)
            with np.errstate(divide="ignore"):
                mixed = np.logaddexp(np.log(seen), math.log(spelled) + log_word)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(c > 0), batch.column(2), pa.array(of.base(c)),
                 pa.array(log_word / math.log(10)), pa.array(mixed / math.log(10))],
                names=["word", "known", "everywhere", "base", "score", "mixed"])

    return words.select("word", "c", "everywhere").mapInArrow(
        score, "word binary, known boolean, everywhere long, base double, score double, "
               "mixed double")


# --- scoring ----------------------------------------------------------------------------------

ROWS = ("row long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base double, "
        "score double, mixed double, word binary, n long")


def score_rows(docs: DataFrame, head: dict, id_type) -> DataFrame:
    """A row per document with the sums over words of ``head``, and a row per other word."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, n_tokens, n_known, base, total, mixed = [], [], [], [], [], []
            tail_row, tail_word, tail_n = [], [], []
            for text in batch.column(2).to_pylist():
                found = Counter(text.lower().split())
                found[END] += 1
                sums, tokens, seen, other = [0.0, 0.0, 0.0], 0, 0, []
                for word, n in found.items():
                    tokens += n
                    entry = known.get(word)
                    if entry is None:
                        other.append(word)
                        tail_n.append(n)
                        continue
                    seen += n * entry[0]
                    sums[0] += n * entry[1]
                    sums[1] += n * entry[2]
                    sums[2] += n * entry[3]
                tail_word += other
                tail_row += [number] * len(other)
                rows.append(number)
                number += 1
                n_tokens.append(tokens)
                n_known.append(seen)
                base.append(sums[0])
                total.append(sums[1])
                mixed.append(sums[2])
            m = len(tail_row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0), batch.column(1),
                 pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(total, pa.float64()),
                 pa.array(mixed, pa.float64()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())], names=NAMES)
            for at in range(0, m, 100_000):
                some = slice(at, at + 100_000)
                k = len(tail_row[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tail_row[some], pa.int64()), pa.nulls(k, batch.column(0).type),
                     pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                     pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()),
                     pa.nulls(k, pa.float64()), pa.array(tail_word[some], pa.binary()),
                     pa.array(tail_n[some], pa.int64())], names=NAMES)

    return docs.mapInArrow(score, ROWS.format(id=id_type.simpleString()))


NAMES = [f.split()[0] for f in ROWS.split(", ")]


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                pieces: str = PIECES, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """Scores of every whole text, learned from the rows of the training fold."""
    stages = Stages(docs.sparkSession)
    fold = remainder(doc_id, 10)
    counted = docs.select(F.coalesce(fold != 0, F.lit(False)).alias("trains"),
                          utf8(text).alias("text")).mapInArrow(
        count_words, "word binary, c long, everywhere long")
    words = stages.save(counted.groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("everywhere").alias("everywhere")), "words")
    sums = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)),
                     F.count(F.when((F.col("c") == 1) & (F.length("word") > 0), 1)),
                     F.max(F.when(F.length("word") == 0, F.col("c"))), F.sum("everywhere")).first()
    counts = Counts(*[n or 0 for n in sums])
    names, log_p = load_pieces(pieces)
    log_p = fit_pieces(words, names, log_p, rounds)
    scored = stages.save(score_words(words, names, log_p, counts), "scored")
    stages.remove("words")
    frequent = (F.length("word") <= HEAD_BYTES) & (F.col("everywhere") * head >= counts.everywhere)
    sent = {bytes(r["word"]): (int(r["known"]), r["base"], r["score"], r["mixed"]) for r in
            scored.filter(frequent).drop("everywhere").toLocalIterator()}
    rows = stages.save(score_rows(docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        utf8(text).alias("text")), sent, docs.schema[doc_id].dataType), "rows")
    tail = (rows.filter("word IS NOT NULL").select("row", "word", "n")
            .join(scored.filter(~frequent), "word").groupBy("row")
            .agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("more_known"),
                 F.sum(F.col("n") * F.col("base")).alias("more_base"),
                 F.sum(F.col("n") * F.col("score")).alias("more_score"),
                 F.sum(F.col("n") * F.col("mixed")).alias("more_mixed")))
    zero = F.lit(0)
    return (rows.filter("word IS NULL").join(tail, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
                    F.lit(counts.tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
                    (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
                    (F.col("mixed") + F.coalesce("more_mixed", zero)).alias("word_score")))
