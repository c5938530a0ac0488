"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, language_id, lattice_lm, licences, line_dedup, mixing, neighbours,
               pii, ring, simhash, spelling, warc, whitening)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(_table(spark, sf, "documents"))


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents"))


def op4_lattice_lm(spark: SparkSession, sf: str) -> DataFrame:
    return lattice_lm.score_texts(_table(spark, sf, "documents"))


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each benchmark item that a document holds, within the error budget."""
    return decontaminate.find_contaminated(_table(spark, sf, "documents"),
                                           _table(spark, sf, "benchmark"))


def op6_ring_shards(spark: SparkSession, sf: str) -> DataFrame:
    return ring.assign(_table(spark, sf, "documents"))


def op7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.neighbours(_table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(_table(spark, sf, "documents"))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without later copies of three-line windows."""
    return line_dedup.remove_repeats(_table(spark, sf, "documents"))


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf, "pages"))


def op11_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf, "documents"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf, "embeddings"))


def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_forms(_table(spark, sf, "documents"))


QUERIES = [op1_language_id, op2_simhash, op3_mixing, op4_lattice_lm, op5_decontaminate,
           op6_ring_shards, op7_neighbours, op8_pii, op9_line_dedup, op10_warc, op11_licences,
           op12_whitening, op13_spelling]

# A window is known by its three lines; a row by its id and text.
LINE_DEDUP = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, a, unnest(range(0, len(a))) AS i
      FROM (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM d)),
w AS (SELECT doc_id, text, i, a[i + 1] || chr(10) || a[i + 2] || chr(10) || a[i + 3] AS k
      FROM l WHERE i + 3 <= len(a) AND a[i + 1] || a[i + 2] || a[i + 3] <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, text, i) AS n FROM w),
c AS (SELECT DISTINCT doc_id, text, i + unnest([0, 1, 2]) AS i FROM r WHERE n > 1),
k AS (SELECT l.doc_id, l.text, string_agg(l.a[l.i + 1], chr(10) ORDER BY l.i) AS kept,
             count(*) AS n
      FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.text = l.text AND c.i = l.i
      WHERE c.i IS NULL GROUP BY l.doc_id, l.text)
SELECT s.doc_id, CASE WHEN s.text IS NOT NULL THEN coalesce(k.kept, '') END AS text,
       coalesce(len(string_split(s.text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(len(string_split(s.text, chr(10))) - coalesce(k.n, 0), 0)::BIGINT AS n_removed
FROM documents AS s LEFT JOIN k ON k.doc_id = s.doc_id AND k.text = s.text"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= 1000
      GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < target THEN target END AS refers_to
FROM p LEFT JOIN t ON t.payload_digest = p.payload_digest"""

# Near words share what is left without one code point; crc32 goes byte by byte through its table.
SPELLING = """
WITH RECURSIVE t AS (
SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1
       THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
o AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
             AS run
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run
            FROM documents) WHERE length(run) >= 7),
b AS (SELECT run, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h
      FROM (SELECT doc_id, run, count(*) AS times FROM o GROUP BY ALL)),
c AS (SELECT run, times, xor(4294967295, list_reduce([4294967295] || list_transform(
             range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS code FROM b, t),
w AS (SELECT CASE WHEN code % 31 = 0 THEN substr(run, 1, code % length(run))
                  || substr(run, code % length(run) + 2) ELSE run END AS word,
             sum(times)::BIGINT AS n FROM c GROUP BY 1),
v AS (SELECT word, n FROM w WHERE length(word) >= 7 AND n >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less
      FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d AS a JOIN d AS b
      ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM d AS a JOIN v AS b ON a.less = b.word
      UNION SELECT b.word, a.word, a.n FROM d AS a JOIN v AS b ON a.less = b.word),
g AS (SELECT word, count(*) AS n_near, max(near_n) AS form_n,
             arg_min(near, (-near_n, encode(near))) AS form FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN form_n >= 10 * v.n THEN form END AS form,
             CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n
      FROM v LEFT JOIN g ON g.word = v.word),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL
      UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word"""

SQL: dict[str, str] = {"op9_line_dedup": LINE_DEDUP, "op10_warc": WARC, "op13_spelling": SPELLING}
