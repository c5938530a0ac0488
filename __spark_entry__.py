"""

Every query runs over whole tables and whole texts.  ``conversations`` rows are texts of their
own with the id ``conv_id-turn``.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexorder.functions.ints import pack_little_endian, unpack_little_endian  # noqa: E402
from lexorder.operators import compare, counts, names, positions, types  # noqa: E402
from lexorder.operators.ranking import rank_rows  # noqa: E402
from lexorder.plans.induced import induce, star_substring_order as order_stars  # noqa: E402
from lexorder.plans.levels import levels, sort_by_levels  # noqa: E402
from lexorder.plans.suffix_array import sort_texts, suffix_array  # noqa: E402
from lexorder.sources import files  # noqa: E402
from lexorder.sources.texts import (Texts, chunk_texts, explode_symbols,  # noqa: E402
                                    pack_symbols)
from lexorder.staging import Stages, default_tasks, shared_dir  # noqa: E402

try:
    import corpus_pipeline
    from lexorder.llm import queries as llm
except ModuleNotFoundError as missing:      # both are there, or neither is
    if missing.name not in ("lexorder.llm", "corpus_pipeline"):
        raise
    llm = corpus_pipeline = None


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "text")


def _turn_texts(spark: SparkSession, sf: str, unit: str = "byte") -> Texts:
    """Chunks of the conversations, spread over the session's tasks."""
    return chunk_texts(_turns(spark, sf), "id", "text", unit, tasks=default_tasks(spark))


def _document_texts(spark: SparkSession, sf: str) -> Texts:
    return chunk_texts(_table(spark, sf, "documents"), "doc_id", "text",
                       tasks=default_tasks(spark))


def _part_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """For each supplier, the parts it shipped, in order, as a text over part keys."""
    lines = _table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("text_id"), "l_orderkey", "l_linenumber",
        F.col("l_partkey").alias("sym"))
    return rank_rows(lines, ["text_id"], ["l_orderkey", "l_linenumber", "sym"], [],
                     default_tasks(spark), Stages(spark), "lines",
                     keep=["text_id", "sym"], what="row").select(
                         "text_id", F.col("rank").alias("pos"), "sym")


# --- suffix arrays ----------------------------------------------------------------------------

def sa_direct(spark, sf):
    return suffix_array(_table(spark, sf, "benchmark"), "item_id", "text", method="direct")


def sa_documents(spark, sf):
    return suffix_array(_table(spark, sf, "documents"), "doc_id", "text")


def sa_doubling(spark, sf):
    return suffix_array(_turns(spark, sf), "id", "text", method="doubling")


def sa_induced(spark, sf):
    return suffix_array(_turns(spark, sf), "id", "text", method="induced")


def sa_induced_levels(spark, sf):
    """Names of names, level by level, over texts cut into small chunks."""
    return suffix_array(_table(spark, sf, "benchmark"), "item_id", "text", method="induced",
                        chunk=64, halo=16)


def sa_long_text(spark, sf):
    """Texts cut into many small chunks, so that all take the path of texts of many chunks."""
    return suffix_array(_table(spark, sf, "documents"), "doc_id", "text", chunk=256, halo=64)


def sa_part_names(spark, sf):
    return suffix_array(_table(spark, sf, "part"), "p_partkey", "p_name")


def sa_chars(spark, sf):
    return suffix_array(_turns(spark, sf), "id", "text", unit="char")


def sa_tokens(spark, sf):
    """Texts over an alphabet of integers: the byte length of every word."""
    words = _turns(spark, sf).select("id", F.transform(
        F.split("text", " "), lambda word: F.octet_length(word).cast("long")).alias("words"))
    return suffix_array(words, "id", "words", unit="token", symbol_bytes=3)


def sa_symbol_rows(spark, sf):
    return sort_texts(pack_symbols(_part_sequences(spark, sf), 5), "doubling")


# --- types and stars --------------------------------------------------------------------------

def symbols(spark, sf):
    return explode_symbols(_turn_texts(spark, sf))


def code_points(spark, sf):
    return explode_symbols(_turn_texts(spark, sf, "char"))


def suffix_types(spark, sf):
    return types.classify_suffixes(_turn_texts(spark, sf))


def minus_star(spark, sf):
    return types.star_positions(_turn_texts(spark, sf), "minus")


def plus_star(spark, sf):
    return types.star_positions(_turn_texts(spark, sf), "plus")


def next_star(spark, sf):
    return types.next_star(_turn_texts(spark, sf))


def _stars(spark, sf):
    return types.star_substrings(_turn_texts(spark, sf))


def star_substrings(spark, sf):
    return _stars(spark, sf).select("text_id", "star_idx", "pos", "end_pos", "terminal",
                                    F.hex("sub").alias("sub"))


def star_index(spark, sf):
    return _stars(spark, sf).select("text_id", "star_idx", "pos")


def star_substring_order(spark, sf):
    """Star substrings in order, sorted piece by piece."""
    return order_stars(_turn_texts(spark, sf)).select("text_id", "rank", "pos", "tied")


def star_order_in_pieces(spark, sf):
    """The same where a chunk shows 4 symbols more at most, so longer substrings are read on."""
    texts = chunk_texts(_turns(spark, sf), "id", "text", chunk=64, halo=4,
                        tasks=default_tasks(spark))
    return order_stars(texts).select("text_id", "rank", "pos", "tied")


def star_names(spark, sf):
    return names.name_order(order_stars(_turn_texts(spark, sf))).select("text_id", "pos", "name")


def star_names_by_pairs(spark, sf):
    """Names of ever longer stretches, until whole star substrings have one."""
    return names.names_by_pairs(types.star_symbols(_turn_texts(spark, sf))).select(
        "text_id", "pos", "name")


def n_names(spark, sf):
    return names.count_ranks(order_stars(_turn_texts(spark, sf)))


def suffix_agreement(spark, sf):
    """How far each suffix agrees with the one before it in rank, over small chunks."""
    texts = chunk_texts(_table(spark, sf, "benchmark"), "item_id", "text", chunk=64, halo=16)
    return compare.neighbour_agreement(sort_texts(texts), texts, look=8)


def pair_names(spark, sf):
    """Pairs of a symbol and the one after it; the pair at the end has the tail name -1."""
    return names.pair_names(types.symbol_pairs(_turn_texts(spark, sf)))


def reduced_text(spark, sf):
    return names.reduced_text(names.name_substrings(_stars(spark, sf)))


def star_suffix_order(spark, sf):
    named = names.name_substrings(_stars(spark, sf))
    reduced = pack_symbols(names.reduced_text(named), 4)
    return positions.star_suffix_order(named, sort_texts(reduced))


def plus_suffix_order(spark, sf):
    return induce(_turn_texts(spark, sf), star_suffix_order(spark, sf), "plus")


def minus_suffix_order(spark, sf):
    return induce(_turn_texts(spark, sf), star_suffix_order(spark, sf), "minus")


def sa_merged(spark, sf):
    """Plus suffixes from the minus-stars, minus suffixes from the plus-stars, and both merged."""
    texts = _turn_texts(spark, sf)
    typed = types.classify_suffixes(texts)
    plus = induce(texts, star_suffix_order(spark, sf), "plus")
    plus_stars = positions.order_within(plus, typed.filter("is_plus_star"))
    minus = induce(texts, plus_stars, "minus", stars="plus")
    return positions.merge_orders(minus, plus, counts.type_counts(typed), texts)


def sa_levels(spark, sf):
    """Suffix arrays from levels that a lost driver goes on from."""
    return sort_by_levels(chunk_texts(_table(spark, sf, "benchmark"), "item_id", "text"))


def level_sizes(spark, sf):
    """What the first two levels of induced sorting have of every text."""
    return levels(_turn_texts(spark, sf), most=2)


def type_counts(spark, sf):
    return counts.type_counts(suffix_types(spark, sf))


# --- counts -----------------------------------------------------------------------------------

def symbol_histogram(spark, sf):
    return counts.symbol_histogram(chunk_texts(_table(spark, sf, "documents"), "doc_id", "text"))


def bucket_starts(spark, sf):
    return counts.bucket_starts(symbol_histogram(spark, sf))


def minus_star_counts(spark, sf):
    return counts.star_counts(suffix_types(spark, sf), "minus")


def plus_star_counts(spark, sf):
    return counts.star_counts(suffix_types(spark, sf), "plus")


def plus_counts(spark, sf):
    return counts.plus_counts(suffix_types(spark, sf))


def sa_summary(spark, sf):
    texts = _turn_texts(spark, sf)
    return counts.text_summary(types.classify_suffixes(texts),
                               names.count_names(types.star_substrings(texts)))


# --- look-ups, sources and sinks --------------------------------------------------------------

def preceding_symbol(spark, sf):
    texts = _turn_texts(spark, sf)
    return positions.preceding_symbol(sort_texts(texts), texts)


def suffix_order_errors(spark, sf):
    texts = _document_texts(spark, sf)
    errors = positions.suffix_order_errors(sort_texts(texts), explode_symbols(texts))
    return errors.agg(F.count("*").alias("errors"))


def packed_positions(spark, sf):
    """Positions as 40-bit integers, low byte first, and back."""
    sa = suffix_array(_table(spark, sf, "part"), "p_partkey", "p_name")
    packed = pack_little_endian(F.col("pos"), 5)
    return sa.select("text_id", "rank", F.hex(packed).alias("packed"),
                     unpack_little_endian(packed, 5).alias("pos"))


def _fresh_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"


def packed_roundtrip(spark, sf):
    folder = _fresh_folder(spark)
    files.export_packed(suffix_array(_turns(spark, sf), "id", "text"), folder)
    return files.import_packed(spark, folder)


def packed_rank_range(spark, sf):
    """The ranks 10 to 99 of every text, from the bytes that hold them."""
    folder = _fresh_folder(spark)
    files.export_packed(suffix_array(_turns(spark, sf), "id", "text"), folder)
    return files.import_packed(spark, folder, ranks=(10, 100))


def file_chunk_range(spark, sf):
    """The symbols 100 to 199 of every file, from the chunks that hold them."""
    chunks = files.read_text_chunks(spark, _item_files(spark, sf), chunk=64, halo=16,
                                    positions=(100, 200))
    return _by_item(explode_symbols(chunks).filter("pos BETWEEN 100 AND 199"))


def packed_as_text(spark, sf):
    """The files of a packed suffix array read as texts over 40-bit symbols."""
    folder = _fresh_folder(spark)
    files.export_packed(suffix_array(_table(spark, sf, "part"), "p_partkey", "p_name"), folder)
    read = explode_symbols(files.read_text_chunks(spark, folder, symbol_bytes=5))
    return read.groupBy("sym").agg(F.count("*").alias("count"))


def packed_overwrite(spark, sf):
    """A second export takes the place of the first, in parts of bounded size."""
    folder = _fresh_folder(spark)
    files.export_packed(suffix_array(_table(spark, sf, "benchmark"), "item_id", "text"), folder)
    files.export_packed(suffix_array(_table(spark, sf, "part"), "p_partkey", "p_name"), folder,
                        mode="overwrite", max_records=5_000)
    return files.import_packed(spark, folder)


def _item_files(spark: SparkSession, sf: str) -> str:
    """The benchmark's texts as files, named by item."""
    folder = _fresh_folder(spark)
    files.write_texts(_table(spark, sf, "benchmark"), "item_id", "text", folder)
    return folder


def _by_item(df: DataFrame) -> DataFrame:
    item = F.regexp_extract("text_id", r"([0-9]+)\.txt$", 1).cast("long")
    return df.withColumn("text_id", item)


def sa_files(spark, sf):
    """Whole files as rows."""
    return _by_item(suffix_array(files.read_texts(spark, _item_files(spark, sf)), "text_id",
                                 "text"))


def sa_file_chunks(spark, sf):
    """Files read by byte ranges, most of them in many chunks."""
    return _by_item(sort_texts(files.read_text_chunks(spark, _item_files(spark, sf), chunk=64,
                                                      halo=16)))


def file_types(spark, sf):
    return _by_item(types.classify_suffixes(files.read_text_chunks(
        spark, _item_files(spark, sf), chunk=64, halo=16)))


def damaged_order_errors(spark, sf):
    """Errors found in arrays of which two ranks are exchanged, one is missing, one is doubled."""
    texts = chunk_texts(_table(spark, sf, "benchmark"), "item_id", "text")
    sa, rank = sort_texts(texts), F.col("rank")
    damaged = {
        "swapped": sa.withColumn("rank", F.when(rank == 2, 5).when(rank == 5, 2).otherwise(rank)),
        "missing": sa.filter(rank != 4),
        "doubled": sa.withColumn("rank", F.when(rank == 3, 4).otherwise(rank))}
    found = [positions.suffix_order_errors(rows, explode_symbols(texts))
             .groupBy(F.lit(name).alias("damage"), "text_id", "error")
             .agg(F.count("*").alias("n")) for name, rows in damaged.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def stored_suffix_array(spark, sf):
    folder = _fresh_folder(spark)
    files.write_suffix_array(suffix_array(_table(spark, sf, "benchmark"), "item_id", "text"),
                             folder, max_records=1_000)
    return spark.read.parquet(folder)


QUERIES = [
    sa_direct, sa_documents, sa_doubling, sa_induced, sa_induced_levels, sa_long_text,
    sa_part_names, sa_chars, sa_tokens, sa_symbol_rows, symbols, code_points, suffix_types,
    minus_star, plus_star, next_star, star_substrings, star_index, star_substring_order,
    star_order_in_pieces, star_names, star_names_by_pairs, n_names, suffix_agreement,
    pair_names, reduced_text, star_suffix_order, plus_suffix_order, minus_suffix_order,
    symbol_histogram, bucket_starts, minus_star_counts, plus_star_counts, plus_counts,
    sa_summary, sa_merged, sa_levels, level_sizes, type_counts, preceding_symbol,
    suffix_order_errors, packed_positions, packed_roundtrip, packed_rank_range, file_chunk_range,
    packed_as_text, stored_suffix_array, packed_overwrite, sa_files, sa_file_chunks, file_types,
    damaged_order_errors,
]


def entry(spark: SparkSession) -> DataFrame:
    """Suffix arrays of all documents at the smallest scale."""
    return sa_documents(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {query.__name__: query for query in QUERIES}
    if llm:
        found |= {query.__name__: query for query in llm.QUERIES}
        found["pipeline"] = corpus_pipeline.run
    return found


# --- SQL --------------------------------------------------------------------------------------

TURNS = "SELECT conv_id || '-' || turn AS id, text FROM conversations"
BENCHMARK = "SELECT item_id AS id, text FROM benchmark"
PARTS = "SELECT p_partkey AS id, p_name AS text FROM part"
DOCUMENTS = "SELECT doc_id AS id, text FROM documents"


def _sa_sql(source: str) -> str:
    """Whole suffixes as hex digits in order."""
    return f"""
SELECT id AS text_id, p AS pos,
       row_number() OVER (PARTITION BY id ORDER BY substr(h, 2 * p + 1)) - 1 AS rank
FROM (SELECT id, h, unnest(range(0, length(h) // 2)) AS p
      FROM (SELECT id, hex(encode(text)) AS h FROM ({source})))"""


# Long texts: order by 32 symbols, then whole suffixes only where those tie.
SA_DOCUMENTS = f"""
WITH d AS ({DOCUMENTS}),
k AS (SELECT id, p, substr(h, 2 * p + 1, 64) AS k
      FROM (SELECT id, h, unnest(range(0, length(h) // 2)) AS p
            FROM (SELECT id, hex(encode(text)) AS h FROM d))),
g AS (SELECT id, p, rank() OVER (PARTITION BY id ORDER BY k) - 1 AS base,
             count(*) OVER (PARTITION BY id, k) AS ties FROM k),
t AS (SELECT g.id, p, base + row_number() OVER (
             PARTITION BY g.id, base ORDER BY substr(h, 2 * p + 1)) - 1 AS rank
      FROM g JOIN (SELECT id, hex(encode(text)) AS h FROM d) AS x ON x.id = g.id
      WHERE ties > 1)
SELECT id AS text_id, p AS pos, base AS rank FROM g WHERE ties = 1
UNION ALL SELECT id, p, rank FROM t"""

SYMBOLS = f"""
hx AS (SELECT id AS text_id, hex(encode(text)) AS h FROM ({TURNS})),
sy AS (SELECT text_id, p AS pos, ('0x' || substr(h, 2 * p + 1, 2))::BIGINT AS sym
       FROM (SELECT text_id, h, unnest(range(0, length(h) // 2)) AS p FROM hx))"""

TYPES = f"""{SYMBOLS},
st AS (SELECT *, CASE WHEN lead(sym) OVER w IS NULL THEN true
                      WHEN lead(sym) OVER w <> sym THEN sym > lead(sym) OVER w END AS strict
       FROM sy WINDOW w AS (PARTITION BY text_id ORDER BY pos)),
ty AS (SELECT text_id, pos, sym,
              first_value(strict IGNORE NULLS) OVER (PARTITION BY text_id ORDER BY pos
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_minus FROM st),
sr AS (SELECT *, pos > 0 AND is_minus AND NOT lag(is_minus) OVER v AS is_minus_star,
              pos > 0 AND NOT is_minus AND lag(is_minus) OVER v AS is_plus_star
       FROM ty WINDOW v AS (PARTITION BY text_id ORDER BY pos))"""

STARS = f"""{TYPES},
ss AS (SELECT text_id, pos, row_number() OVER u - 1 AS star_idx, lead(pos) OVER u AS next_pos
       FROM sr WHERE is_minus_star WINDOW u AS (PARTITION BY text_id ORDER BY pos)),
sb AS (SELECT ss.text_id, star_idx, pos, next_pos IS NULL AS terminal,
              coalesce(next_pos, length(h) // 2 - 1) AS end_pos,
              substr(h, 2 * pos + 1,
                     2 * (coalesce(next_pos, length(h) // 2 - 1) - pos + 1)) AS sub
       FROM ss JOIN hx USING (text_id)),
nm AS (SELECT text_id, star_idx, pos, dense_rank() OVER (
              PARTITION BY text_id ORDER BY sub, NOT terminal) - 1 AS name FROM sb)"""

TURN_SA = f"sa AS ({_sa_sql(TURNS)})"


def _counts_sql(flag: str) -> str:
    return f"""WITH {TYPES},
c AS (SELECT text_id, sym, count(*) AS n FROM sr WHERE {flag} GROUP BY ALL),
r AS (SELECT text_id, unnest(range(0, max(sym) + 1)) AS sym FROM c GROUP BY text_id)
SELECT text_id, sym, coalesce(n, 0) AS count FROM r LEFT JOIN c USING (text_id, sym)"""


def _order_sql(flag: str) -> str:
    return f"""WITH {TYPES}, {TURN_SA}
SELECT text_id, pos, row_number() OVER (PARTITION BY text_id ORDER BY rank) - 1 AS rank
FROM sa JOIN sr USING (text_id, pos) WHERE {flag}"""


# Names of level 0 are the symbols of level 1, eight digits each, for texts with a name twice.
LEVELS = f"""{STARS},
nn AS (SELECT text_id, count(*) AS n_stars, count(DISTINCT name) AS n_names FROM nm
       GROUP BY text_id),
sy1 AS (SELECT text_id, star_idx AS pos, name AS sym FROM nm JOIN nn USING (text_id)
        WHERE n_stars > n_names),
hx1 AS (SELECT text_id, string_agg(printf('%08x', sym), '' ORDER BY pos) AS h FROM sy1
        GROUP BY text_id),
st1 AS (SELECT *, CASE WHEN lead(sym) OVER w IS NULL THEN true
                       WHEN lead(sym) OVER w <> sym THEN sym > lead(sym) OVER w END AS strict
        FROM sy1 WINDOW w AS (PARTITION BY text_id ORDER BY pos)),
ty1 AS (SELECT text_id, pos, first_value(strict IGNORE NULLS) OVER (PARTITION BY text_id
               ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_minus
        FROM st1),
sr1 AS (SELECT *, pos > 0 AND is_minus AND NOT lag(is_minus) OVER v AS star
        FROM ty1 WINDOW v AS (PARTITION BY text_id ORDER BY pos)),
sb1 AS (SELECT text_id, lead(pos) OVER u IS NULL AS terminal,
               substr(h, 8 * pos + 1, 8 * (coalesce(lead(pos) OVER u, length(h) // 8 - 1)
                                           - pos + 1)) AS sub
        FROM sr1 JOIN hx1 USING (text_id) WHERE star
        WINDOW u AS (PARTITION BY text_id ORDER BY pos)),
nn1 AS (SELECT text_id, count(*) AS n_stars, count(DISTINCT sub || terminal::VARCHAR) AS n_names
        FROM sb1 GROUP BY text_id)
SELECT 0 AS level, text_id, count(*) AS n, count(DISTINCT sym) AS n_symbols,
       coalesce(any_value(n_stars), 0) AS n_stars, coalesce(any_value(n_names), 0) AS n_names
FROM sy LEFT JOIN nn USING (text_id) GROUP BY text_id
UNION ALL
SELECT 1, text_id, count(*), count(DISTINCT sym), coalesce(any_value(n_stars), 0),
       coalesce(any_value(n_names), 0)
FROM sy1 LEFT JOIN nn1 USING (text_id) GROUP BY text_id"""


def _star_order_sql(stars: str) -> str:
    return f"""WITH {stars}
SELECT text_id, pos,
       rank() OVER (PARTITION BY text_id ORDER BY sub, NOT terminal) - 1 AS rank,
       count(*) OVER (PARTITION BY text_id, sub, terminal) > 1 AS tied FROM sb"""


HISTOGRAM = f"""
SELECT text_id, ('0x' || b)::BIGINT AS sym, count(*) AS count
FROM (SELECT id AS text_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b
      FROM ({DOCUMENTS})) GROUP BY ALL"""

SQL = {
    "sa_direct": _sa_sql(BENCHMARK),
    "sa_documents": SA_DOCUMENTS,
    "sa_doubling": _sa_sql(TURNS),
    "sa_induced": _sa_sql(TURNS),
    "sa_induced_levels": _sa_sql(BENCHMARK),
    "sa_long_text": SA_DOCUMENTS,
    "sa_part_names": _sa_sql(PARTS),
    # UTF-8 text compares by code point.
    "sa_chars": f"""
SELECT id AS text_id, p AS pos,
       row_number() OVER (PARTITION BY id ORDER BY substr(text, (p + 1)::BIGINT)) - 1 AS rank
FROM (SELECT id, text, unnest(range(0, length(text))) AS p FROM ({TURNS}))""",
    "sa_tokens": f"""
SELECT id AS text_id, p AS pos,
       row_number() OVER (PARTITION BY id ORDER BY substr(h, 6 * p + 1)) - 1 AS rank
FROM (SELECT id, h, unnest(range(0, length(h) // 6)) AS p
      FROM (SELECT id, array_to_string(list_transform(string_split(text, ' '),
                   lambda w: printf('%06x', octet_length(encode(w)))), '') AS h
            FROM ({TURNS})))""",
    "sa_symbol_rows": """
SELECT l_suppkey AS text_id, p AS pos,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY substr(h, 10 * p + 1)) - 1 AS rank
FROM (SELECT l_suppkey, h, unnest(range(0, length(h) // 10)) AS p
      FROM (SELECT l_suppkey, string_agg(printf('%010x', l_partkey), ''
                                         ORDER BY l_orderkey, l_linenumber, l_partkey) AS h
            FROM lineitem GROUP BY l_suppkey))""",
    "symbols": f"WITH {SYMBOLS} SELECT text_id, pos, sym FROM sy",
    "code_points": f"""
SELECT id AS text_id, p - 1 AS pos, unicode(c)::BIGINT AS sym
FROM (SELECT id, unnest(string_split(text, '')) AS c,
             unnest(range(1, length(text) + 1)) AS p FROM ({TURNS}) WHERE text <> '')""",
    "suffix_types": f"""WITH {TYPES}
SELECT text_id, pos, sym, is_minus, coalesce(is_minus_star, false) AS is_minus_star,
       coalesce(is_plus_star, false) AS is_plus_star FROM sr""",
    "minus_star": f"WITH {TYPES} SELECT text_id, pos FROM sr WHERE is_minus_star",
    "plus_star": f"WITH {TYPES} SELECT text_id, pos FROM sr WHERE is_plus_star",
    "next_star": f"""WITH {TYPES}
SELECT text_id, pos, min(CASE WHEN is_minus_star THEN pos END) OVER (
       PARTITION BY text_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
       AS next_star FROM sr""",
    "star_substrings": f"""WITH {STARS}
SELECT text_id, star_idx, pos, end_pos, terminal, sub FROM sb""",
    "star_index": f"WITH {STARS} SELECT text_id, star_idx, pos FROM sb",
    "star_substring_order": _star_order_sql(STARS),
    "star_order_in_pieces": _star_order_sql(STARS),
    "star_names": f"WITH {STARS} SELECT text_id, pos, name FROM nm",
    "star_names_by_pairs": f"WITH {STARS} SELECT text_id, pos, name FROM nm",
    # Of two hexadecimal texts, the prefixes that agree.
    "suffix_agreement": f"""
WITH sa AS ({_sa_sql(BENCHMARK)}),
h AS (SELECT sa.*, substr(hex(encode(text)), 2 * pos + 1) AS s FROM sa
      JOIN ({BENCHMARK}) AS b ON b.id = sa.text_id),
n AS (SELECT *, lag(s) OVER (PARTITION BY text_id ORDER BY rank) AS t FROM h)
SELECT text_id, rank, pos, coalesce(len(list_filter(
           range(1, least(length(s), length(t)) // 2 + 1),
           lambda k: substr(s, 1, 2 * k) = substr(t, 1, 2 * k))), 0)::BIGINT AS agree,
       1 AS sign FROM n""",
    "n_names": f"""WITH {STARS}
SELECT text_id, count(DISTINCT sub || terminal::VARCHAR) AS n_names FROM sb GROUP BY text_id""",
    "pair_names": f"""WITH {TYPES},
pr AS (SELECT text_id, pos, sym,
              coalesce(NOT lead(is_minus) OVER w, false) AS tail_is_plus,
              coalesce(lead(sym) OVER w, -1) AS tail_name
       FROM sr WINDOW w AS (PARTITION BY text_id ORDER BY pos))
SELECT text_id, pos, dense_rank() OVER (
       PARTITION BY text_id ORDER BY sym, tail_is_plus, tail_name) - 1 AS name FROM pr""",
    "reduced_text": f"WITH {STARS} SELECT text_id, star_idx AS pos, name AS sym FROM nm",
    "star_suffix_order": _order_sql("is_minus_star"),
    "plus_suffix_order": _order_sql("NOT is_minus"),
    "minus_suffix_order": _order_sql("is_minus"),
    "sa_merged": _sa_sql(TURNS),
    "sa_levels": _sa_sql(BENCHMARK),
    "level_sizes": f"WITH {LEVELS}",
    "type_counts": f"""WITH {TYPES}
SELECT text_id, sym, count(*) FILTER (is_minus) AS n_minus,
       count(*) FILTER (NOT is_minus) AS n_plus FROM sr GROUP BY text_id, sym""",
    "symbol_histogram": HISTOGRAM,
    "bucket_starts": f"""
SELECT text_id, sym, count, (coalesce(sum(count) OVER (PARTITION BY text_id ORDER BY sym
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
FROM ({HISTOGRAM})""",
    "minus_star_counts": _counts_sql("is_minus_star"),
    "plus_star_counts": _counts_sql("is_plus_star"),
    "plus_counts": _counts_sql("NOT is_minus"),
    "sa_summary": f"""WITH {STARS},
nn AS (SELECT text_id, max(name) + 1 AS n_names FROM nm GROUP BY text_id)
SELECT text_id, count(*) AS n, count(DISTINCT sym) AS n_symbols, max(sym) AS max_sym,
       count(*) FILTER (is_minus) AS n_minus,
       count(*) FILTER (is_minus_star) AS n_minus_stars,
       count(*) FILTER (is_plus_star) AS n_plus_stars,
       coalesce(any_value(n_names), 0) AS n_names
FROM sr LEFT JOIN nn USING (text_id) GROUP BY text_id""",
    "preceding_symbol": f"""WITH {SYMBOLS}, {TURN_SA}
SELECT sa.text_id, rank, sa.pos, sym AS prev_sym
FROM sa LEFT JOIN sy ON sy.text_id = sa.text_id AND sy.pos = sa.pos - 1""",
    "suffix_order_errors": "SELECT 0::BIGINT AS errors",
    "packed_positions": f"""
SELECT text_id, rank, pos,
       printf('%02X', pos % 256) || printf('%02X', pos // 256 % 256) || '000000' AS packed
FROM ({_sa_sql(PARTS)})""",
    "packed_roundtrip": _sa_sql(TURNS),
    "packed_rank_range": f"SELECT * FROM ({_sa_sql(TURNS)}) WHERE rank BETWEEN 10 AND 99",
    "file_chunk_range": f"""WITH {SYMBOLS.replace(TURNS, BENCHMARK)}
SELECT text_id, pos, sym FROM sy WHERE pos BETWEEN 100 AND 199""",
    "packed_as_text": """
SELECT p AS sym, count(*) AS count
FROM (SELECT unnest(range(0, octet_length(encode(p_name)))) AS p FROM part) GROUP BY p""",
    "stored_suffix_array": _sa_sql(BENCHMARK),
    "packed_overwrite": _sa_sql(PARTS),
    "sa_files": _sa_sql(BENCHMARK),
    "sa_file_chunks": _sa_sql(BENCHMARK),
    "file_types": f"""WITH {TYPES.replace(TURNS, BENCHMARK)}
SELECT text_id, pos, sym, is_minus, coalesce(is_minus_star, false) AS is_minus_star,
       coalesce(is_plus_star, false) AS is_plus_star FROM sr""",
    "damaged_order_errors": f"""
WITH {SYMBOLS.replace(TURNS, BENCHMARK)},
sa AS ({_sa_sql(BENCHMARK)}),
da AS (SELECT 'swapped' AS damage, text_id, pos,
              CASE rank WHEN 2 THEN 5 WHEN 5 THEN 2 ELSE rank END AS rank FROM sa
       UNION ALL SELECT 'missing', text_id, pos, rank FROM sa WHERE rank <> 4
       UNION ALL SELECT 'doubled', text_id, pos, CASE rank WHEN 3 THEN 4 ELSE rank END FROM sa),
su AS (SELECT d.damage, d.text_id, d.pos, d.rank, sym, coalesce(a.rank, -1) AS ahead
       FROM da AS d JOIN sy ON sy.text_id = d.text_id AND sy.pos = d.pos
       LEFT JOIN da AS a ON a.damage = d.damage AND a.text_id = d.text_id AND a.pos = d.pos + 1),
er AS (SELECT damage, sy.text_id, 'position missing or not in the text' AS error
       FROM sy CROSS JOIN (SELECT DISTINCT damage FROM da) AS k
       WHERE NOT EXISTS (SELECT 1 FROM da WHERE da.damage = k.damage AND da.text_id = sy.text_id
                         AND da.pos = sy.pos)
       UNION ALL SELECT damage, text_id, 'rank given twice' FROM da
       GROUP BY damage, text_id, rank HAVING count(*) > 1
       UNION ALL SELECT s.damage, s.text_id, 'suffix is not below the next' FROM su AS s
       JOIN su AS t ON t.damage = s.damage AND t.text_id = s.text_id AND t.rank = s.rank + 1
       WHERE s.sym > t.sym OR s.sym = t.sym AND s.ahead >= t.ahead
       UNION ALL SELECT t.damage, t.text_id, 'rank missing' FROM su AS t
       WHERE t.rank > 0 AND NOT EXISTS (SELECT 1 FROM su AS s WHERE s.damage = t.damage
             AND s.text_id = t.text_id AND s.rank = t.rank - 1))
SELECT damage, text_id, error, count(*) AS n FROM er GROUP BY damage, text_id, error""",
}


def oracle_sql() -> dict[str, str]:
    return SQL | (llm.SQL if llm else {})
