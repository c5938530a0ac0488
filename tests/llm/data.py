"""Small tables with every awkward case, and brute-force versions that tests share."""

import random

SYLLABLES = {"en": ["the", "ing", "and", "on", "er", "th"], "fr": ["é", "eau", "que", "oi", "ç"],
             "de": ["ung", "sch", "ü", "heit", "der"], "es": ["ción", "ñ", "ado", "osa", "ll"]}

# Names that the operators use themselves, as extra columns of the input.
CLASHES = ["row_id", "row", "id", "fp", "found", "hash", "start", "whole", "size", "base", "word",
           "spans", "text_", "ring_rank", "doc", "at", "kind"]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3)))
                    for _ in range(words))


def some_documents(seed=1, n=120):
    """Rows of documents: prose, copies, nulls, empties, a very long text, repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.randint(1, 60)), lang, f"src{rng.randint(0, 4)}", 1))
    rows += [(9200, None, "en", "src0", None), (9201, "", "en", None, 0), (9202, " \t\n", None, "src1", 3),
             (9203, "12 34 !!", "en", "src1", 8), (None, prose(rng, "fr", 20), "fr", "src2", 1),
             (None, None, None, None, None),
             (9204, prose(rng, "de", 12_000), "de", "src3", 1), (9205, "x" * 30_000, "en", "src9", 1),
             rows[3], rows[3], rows[7],                          # repeated rows
             (3, "another text under an id that is taken", "en", "src0", 1)]
    rows += [(9300 + i, rows[11][1], "en", "hot", 1) for i in range(40)]      # a group of copies
    rows += [(9400 + i, rows[11][1] + "\n", "en", "hot", 1) for i in range(5)]
    return rows


def frame(spark, rows, extra=()):
    """A DataFrame of ``rows`` in several partitions, with further columns of any names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(f"extra {name}").alias(name) for name in extra])


def rows_of(df):
    """The rows of a result as comparable values, in any order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
