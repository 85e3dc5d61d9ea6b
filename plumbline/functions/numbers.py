"""Lenient number reading and the rounding rules used in results."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(column: Column) -> Column:
    """Text to DOUBLE, NULL where it is not a plain decimal number.

    Casting alone would also take type suffixes (1.0d) and hexadecimal floats, and would
    refuse digit grouping with underscores; both are put right here.
    """
    odd = column.rlike(r"[xXpP]|[0-9.][dDfF]")
    grouped = F.when(
        column.contains("_"), F.regexp_replace(column, r"(?<=\d)_(?=\d)", "")
    ).otherwise(column)
    return F.when(~odd, grouped.try_cast("double"))


def to_whole(column: Column) -> Column:
    """Text to BIGINT, NULL where it is not a whole number written as one."""
    return column.try_cast("bigint")


def sql_is_real(expression: str) -> str:
    """Neither NULL nor NaN. Spark sorts NaN above every number, so tests need this guard."""
    return f"({expression} IS NOT NULL AND NOT isnan({expression}))"


def sql_one_decimal(expression: str) -> str:
    return f"format_string('%.1f', bround({expression}, 1))"
