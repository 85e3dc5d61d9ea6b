"""KPI registries from CSV and from parsed-KPI JSON records."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.functions.numbers import to_number
from plumbline.functions.text import SQL_EMPTY_LIST, sql_list_cell
from plumbline.schema import PARSED_KPI, REGISTRY
from plumbline.sources.headed import read_headed_csv

_REQUIRED_CSV_FIELDS = [
    field
    for field in V.REGISTER_FIELDS + ["human_signoff_required"]
    if field not in V.LIST_FIELDS
]


def read_registry_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """All rows of CSV registries; columns are found by the header of each file, in any order.

    List columns hold comma-joined cells and may be absent. Cells with line breaks need
    ``multi_line=True``, which reads a file in one task; otherwise Spark splits large files.
    """
    rows = read_headed_csv(spark, path, multiLine=multi_line, escape='"')
    missing = [field for field in _REQUIRED_CSV_FIELDS if field not in rows.columns]
    if missing:
        raise ValueError(f"registry CSV lacks columns: {', '.join(missing)}")
    return rows.select(*[_csv_field(rows, field.name) for field in REGISTRY.fields])


def _csv_field(rows: DataFrame, field: str) -> Column:
    if field == "kpi_id":
        # Without an id column, the id follows from the name, the only key such files have.
        key = F.col("kpi_id").try_cast("bigint") if "kpi_id" in rows.columns else F.xxhash64("name")
        return key.alias(field)
    if field in V.LIST_FIELDS:
        cell = sql_list_cell(field) if field in rows.columns else SQL_EMPTY_LIST
        return F.expr(cell).alias(field)
    if field == "human_signoff_required":
        return (F.lower(F.coalesce(field, F.lit(""))) == "true").alias(field)
    return F.coalesce(field, F.lit("")).alias(field)


def read_parsed_kpi_json(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """Parsed-KPI records: registry fields plus their own ``historical_aggregates``.

    Records lacking a required field are left out; absent lists are empty and an absent
    sign-off counts as required. ``multi_line=True`` reads one indented object per file.
    """
    records = spark.read.schema(PARSED_KPI).option("multiLine", multi_line).json(path)
    complete = records.na.drop(subset=V.REQUIRED_JSON_FIELDS)
    return with_parsed_defaults(complete)


def with_parsed_defaults(records: DataFrame) -> DataFrame:
    no_points = F.array().cast(PARSED_KPI["historical_aggregates"].dataType)
    return records.withColumns(
        {
            "kpi_id": F.coalesce("kpi_id", F.xxhash64("name")),
            **{field: F.coalesce(field, F.expr(SQL_EMPTY_LIST)) for field in V.LIST_FIELDS},
            "human_signoff_required": F.coalesce("human_signoff_required", F.lit(True)),
            "historical_aggregates": F.coalesce("historical_aggregates", no_points),
        }
    )


def registry_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(*REGISTRY.names)


def series_of(parsed: DataFrame) -> DataFrame:
    """The series held inside parsed records, one row per point in list order."""
    return parsed.select(
        "kpi_id", F.posexplode("historical_aggregates").alias("ord", "point")
    ).select(
        "kpi_id",
        F.col("ord").cast("bigint").alias("ord"),
        F.coalesce("point.period", F.lit(V.MISSING_PERIOD)).alias("period"),
        F.col("point.value").alias("value_raw"),
        to_number(F.col("point.value")).alias("value"),
    )
