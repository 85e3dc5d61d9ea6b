"""Table layouts shared by every module."""

from pyspark.sql import types as T

_text_list = T.ArrayType(T.StringType())

REGISTRY = T.StructType(
    [
        T.StructField("kpi_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("definition", T.StringType()),
        T.StructField("formula", T.StringType()),
        T.StructField("time_period", T.StringType()),
        T.StructField("primary_source_system", T.StringType()),
        T.StructField("secondary_source_systems", _text_list),
        T.StructField("intended_audience", T.StringType()),
        T.StructField("identifier_fields", _text_list),
        T.StructField("source_systems_in_join", _text_list),
        T.StructField("data_owner", T.StringType()),
        T.StructField("data_steward", T.StringType()),
        T.StructField("known_limitations", T.StringType()),
        T.StructField("bias_or_equity_risks", T.StringType()),
        T.StructField("human_signoff_required", T.BooleanType()),
    ]
)

# One row per point. `ord` is the position in the series (unique per KPI, order only matters);
# `value` is NULL exactly where `value_raw` is not a number.
SERIES = T.StructType(
    [
        T.StructField("kpi_id", T.LongType()),
        T.StructField("ord", T.LongType()),
        T.StructField("period", T.StringType()),
        T.StructField("value_raw", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# A parsed KPI record as JSON: the registry fields plus its own series, values kept as text.
PARSED_KPI = T.StructType(
    REGISTRY.fields
    + [
        T.StructField(
            "historical_aggregates",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("period", T.StringType()),
                        T.StructField("value", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

SURVEY_FILE = T.StructType(
    [
        T.StructField("survey_id", T.LongType()),
        T.StructField("mode", T.StringType()),
        T.StructField("comments", _text_list),
    ]
)

SURVEY_CATEGORY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("comments", _text_list),
        T.StructField("theme_summary", T.StringType()),
    ]
)

SURVEY_ANALYSIS = T.StructType(
    [
        T.StructField("categories", T.ArrayType(SURVEY_CATEGORY)),
        T.StructField("priority_flags", _text_list),
        T.StructField("overall_sentiment", T.StringType()),
        T.StructField("key_insight", T.StringType()),
        T.StructField("total_analyzed", T.LongType()),
    ]
)
