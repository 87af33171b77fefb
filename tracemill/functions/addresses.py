"""IPv4 column expressions; all built-in functions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_to_number(ip: Column) -> Column:
    """Big-endian number of the first four dotted parts; NULL when a part is missing or no integer.

    Parts are not range-checked, so ``300.0.0.1`` is a (large) number and not an error.
    """
    parts = F.slice(F.split(ip, "[.]"), 1, 4)
    number = F.aggregate(
        parts,
        F.lit(0).cast("bigint"),
        lambda acc, part: F.try_add(F.shiftleft(acc, 8), part.try_cast("bigint")),
    )
    return F.when(F.size(parts) == 4, number)


def number_to_ip(number: Column) -> Column:
    """Dotted text of an IPv4 number."""
    return F.concat_ws(
        ".", *[F.shiftright(number, bits).bitwiseAND(255).cast("string") for bits in (24, 16, 8, 0)]
    )


def prefix_length(prefix: Column) -> Column:
    """Number of bits of ``a.b.c.d/len``; NULL when malformed."""
    return F.get(F.split(prefix, "/"), F.lit(1)).try_cast("int")


def prefix_start(prefix: Column) -> Column:
    """Base address of ``a.b.c.d/len``; NULL when malformed."""
    parts = F.split(prefix, "/")
    length = prefix_length(prefix)
    mask = F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.lit(32) - length)
    return F.when(length.between(0, 32), ip_to_number(F.get(parts, F.lit(0))).bitwiseAND(mask))


def slash24_number(ip: Column) -> Column:
    """The /24 of a numeric address."""
    return ip.bitwiseAND(F.lit(-256).cast("bigint"))


def slash24_text(ip: Column) -> Column:
    """Text before the last dot; the empty string when there is no dot."""
    return F.when(F.contains(ip, F.lit(".")), F.regexp_replace(ip, "[.][^.]*$", "")).otherwise("")
