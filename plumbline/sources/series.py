"""Series from CSV files and from tables with loosely named columns."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.functions.numbers import to_number, to_whole
from plumbline.functions.ordering import with_position
from plumbline.functions.text import strip
from plumbline.sources.headed import read_headed_csv

# Rows keep their order within a file under this key: Spark hands out the splits of a file in
# order and numbers rows upwards inside each.
_FILE_ORDER = "_file_order"
_SPLIT = "_split"


def _in_file_order(rows: DataFrame) -> DataFrame:
    return rows.withColumn(_FILE_ORDER, F.monotonically_increasing_id()).withColumn(
        _SPLIT, F.spark_partition_id()
    )


def read_panel_csv(
    spark: SparkSession,
    path: str | list[str],
    units: list[int] | None = None,
    unit_column: str = "UNITID",
    year_column: str = "YEAR",
    value_column: str = "RET_PCF",
    period_format: str = "Fall {year}",
) -> DataFrame:
    """A panel (unit by year) as one series per unit, ordered by period label.

    Rows whose unit, year or value cannot be read are skipped. ``units`` keeps some units only.
    Columns are found by the header of each file.
    """
    rows = _in_file_order(read_headed_csv(spark, path))
    before, _, after = period_format.partition("{year}")
    year = to_whole(F.col(year_column))
    label = (
        F.concat(F.lit(before), year.cast("string"), F.lit(after))
        if "{year}" in period_format
        else F.lit(period_format)
    )
    points = rows.select(
        to_whole(F.col(unit_column)).alias("kpi_id"),
        F.when(year.isNotNull(), label).alias("period"),
        F.col(value_column).alias("value_raw"),
        to_number(F.col(value_column)).alias("value"),
        _FILE_ORDER,
        _SPLIT,
    ).where("kpi_id IS NOT NULL AND period IS NOT NULL AND value IS NOT NULL")
    if units is not None:
        points = points.where(F.col("kpi_id").isin(units))
    placed = with_position(points, ["kpi_id"], ["period", _SPLIT], [_FILE_ORDER])
    return placed.select("kpi_id", "ord", "period", "value_raw", "value")


def read_series_csv(
    spark: SparkSession,
    path: str | list[str],
    key_column: str | None = None,
    order_column: str | None = None,
    period_column: str = "period",
    value_column: str = "value",
) -> DataFrame:
    """Named period and value columns, by the header of each file; rows without a number are skipped.

    Spark rows have no order of their own, so give ``order_column`` where there is one.
    Otherwise the order is that of the file. Neither needs a shuffle: ``ord`` only has to
    increase along a series.
    """
    rows = read_headed_csv(spark, path)
    order = (
        to_whole(F.col(order_column)) if order_column else F.monotonically_increasing_id()
    )
    return rows.select(
        (to_whole(F.col(key_column)) if key_column else F.lit(0).cast("bigint")).alias("kpi_id"),
        order.alias("ord"),
        F.coalesce(period_column, F.lit("")).alias("period"),
        F.col(value_column).alias("value_raw"),
        to_number(F.col(value_column)).alias("value"),
    ).where("value IS NOT NULL")


def read_positional_csv(
    spark: SparkSession, path: str | list[str], key: Column | None = None
) -> DataFrame:
    """First column period, second value, header or not.

    A header has no number in its second cell, so it falls out with the other unreadable rows.
    ``key`` may use ``_metadata`` or a partition column to tell several files apart.
    """
    rows = spark.read.schema("_c0 string, _c1 string").csv(path)
    points = _in_file_order(
        rows.select(
            (key if key is not None else F.lit(0)).cast("bigint").alias("kpi_id"),
            strip(F.col("_c0")).alias("period"),
            F.col("_c1").alias("value_raw"),
            to_number(F.col("_c1")).alias("value"),
        )
    ).where("value IS NOT NULL AND period <> ''")
    placed = with_position(points, ["kpi_id"], [_SPLIT], [_FILE_ORDER])
    return placed.select("kpi_id", "ord", "period", "value_raw", "value")


def resolve_columns(columns: list[str]) -> tuple[str, str]:
    """The period and value columns of a loosely named table; the last match of each wins."""
    if len(columns) < 2:
        raise ValueError("a series table needs at least two columns")

    def last_match(terms: list[str], default: str) -> str:
        matches = [
            column
            for column in columns
            if any(term in column.lower().strip() for term in terms)
        ]
        return matches[-1] if matches else default

    return (
        last_match(V.PERIOD_HEADER_TERMS, columns[0]),
        last_match(V.VALUE_HEADER_TERMS, columns[1]),
    )


def resolve_series_columns(table: DataFrame, key: str | None, order: Column) -> DataFrame:
    """A loosely named table as a series, its columns found by their headers.

    ``key`` names the column that tells series apart; it takes no part in the matching.
    """
    period_column, value_column = resolve_columns(
        [column for column in table.columns if column != key]
    )
    period = strip(F.col(f"`{period_column}`").cast("string"))
    raw = F.col(f"`{value_column}`")
    numeric = dict(table.dtypes)[value_column] != "string"
    return table.select(
        (F.col(f"`{key}`") if key else F.lit(0)).cast("bigint").alias("kpi_id"),
        order.cast("bigint").alias("ord"),
        period.alias("period"),
        raw.cast("string").alias("value_raw"),
        (raw.cast("double") if numeric else to_number(raw)).alias("value"),
    ).where((F.col("period") != "") & (F.lower("period") != "none") & F.col("value").isNotNull())


def series_from_numbers(
    table: DataFrame, key: Column, order: Column, period: Column, value: Column
) -> DataFrame:
    """A typed table as a series: no text is parsed, and the raw text is made only if asked for."""
    return table.select(
        key.cast("bigint").alias("kpi_id"),
        order.cast("bigint").alias("ord"),
        F.coalesce(period.cast("string"), F.lit(V.MISSING_PERIOD)).alias("period"),
        value.cast("string").alias("value_raw"),
        value.cast("double").alias("value"),
    )


def series_from_text(
    table: DataFrame, key: Column, order: Column, period: Column, value: Column
) -> DataFrame:
    """A table with values as text as a series; what is not a number keeps its raw text."""
    return table.select(
        key.cast("bigint").alias("kpi_id"),
        order.cast("bigint").alias("ord"),
        F.coalesce(period.cast("string"), F.lit(V.MISSING_PERIOD)).alias("period"),
        value.alias("value_raw"),
        to_number(value).alias("value"),
    )
