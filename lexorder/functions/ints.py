"""Unsigned integers as fixed-width bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _check_width(width: int) -> None:
    if not 1 <= width <= 8:
        raise ValueError("width must be between 1 and 8 bytes")


def pack_big_endian(value: Column, width: int) -> Column:
    """A non-negative integer as ``width`` big-endian bytes; one that does not fit is an error."""
    _check_width(width)
    bad = value < 0
    if width < 8:
        bad = bad | (value >= F.lit(1 << (8 * width)))
    return F.unhex(F.when(bad, F.raise_error(F.lit(f"integer does not fit {width} bytes")))
                   .otherwise(F.lpad(F.hex(value.cast("long")), 2 * width, "0")))


def unpack_big_endian(packed: Column) -> Column:
    """The integer held in up to eight big-endian bytes; 2^63 and more is an error."""
    return F.conv(F.hex(packed), 16, 10).cast("long")


def _reversed(packed: Column, width: int) -> Column:
    return F.concat(*[F.substring(packed, k, 1) for k in range(width, 0, -1)])


def pack_little_endian(value: Column, width: int = 5) -> Column:
    """A non-negative integer as ``width`` bytes, low byte first, as in packed suffix arrays."""
    return _reversed(pack_big_endian(value, width), width)


def unpack_little_endian(packed: Column, width: int = 5) -> Column:
    """The integer in ``width`` bytes, low byte first."""
    _check_width(width)
    return unpack_big_endian(_reversed(packed, width))
