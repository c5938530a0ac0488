"""What the operators of this subpackage share: row ids, the word rule, and small checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexorder.staging import Stages

# Words are runs of anything but these six characters; `bytes.split()` splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def utf8(column: str) -> Column:
    """A text as bytes, null as no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that ``df`` (case ignored, as Spark does) has not got."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def keep_rows(df: DataFrame, stages: Stages, name: str = "rows") -> tuple[DataFrame, str]:
    """``df`` written once with a row id, and the id's name.

    The id is fixed by the write, so every later read of the table sees the same one, whatever
    ids, nulls or repeated rows the table has.
    """
    row = free_name(df, "row_id")
    return stages.save(df.withColumn(row, F.monotonically_increasing_id()), name), row
