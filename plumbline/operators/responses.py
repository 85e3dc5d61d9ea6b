"""Reading model responses held in a table: fences, validity, attempts and fields."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.functions.numbers import to_number
from plumbline.functions.text import sql_strip
from plumbline.schema import PARSED_KPI, SURVEY_ANALYSIS

_FENCE = "```"


def with_body(responses: DataFrame) -> DataFrame:
    """Add ``body``: the text without white space at its ends and without code fences.

    Where the text opens with a fence, its first line goes, and its last line if that is a
    fence too. Plain text functions only; a text without a fence is passed on untouched.
    """
    rest = "if(instr(body, '\\n') = 0, '', substring(body, instr(body, '\\n') + 1))"
    last_line = "substring_index(rest, '\\n', -1)"
    closed = (
        f"if(startswith({sql_strip(last_line)}, '{_FENCE}'),"
        f" substring(rest, 1, length(rest) - length({last_line})), rest)"
    )
    return (
        responses.withColumn("body", F.expr(sql_strip("raw")))
        .withColumn("rest", F.expr(f"if(startswith(body, '{_FENCE}'), {rest}, NULL)"))
        .withColumn("body", F.expr(f"if(rest IS NULL, body, {sql_strip(closed)})"))
        .drop("rest")
    )


# Spark's JSON readers take more than JSON unless told otherwise.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _is_one_json_value(body: Column, opening: str) -> Column:
    """True for exactly one well-formed JSON value of the kind that opens so, and nothing more.

    Spark's JSON readers stop after the first value. So the text is read as the first of two items
    of an array and again as the first of two fields of an object, and the second must be found
    both times: what a text would need to end an array early is malformed in an object.
    """
    items = F.from_json(F.concat(F.lit("["), body, F.lit(",0]")), "array<string>", _STRICT)
    fields = F.from_json(
        F.concat(F.lit('{"first":'), body, F.lit(',"second":0}')),
        "first string, second int",
        _STRICT,
    )
    alone = (F.size(items) == 2) & (items[1] == "0") & (fields["second"] == 0)
    return F.coalesce(body.startswith(opening) & alone, F.lit(False))


def is_json_object(body: Column) -> Column:
    return _is_one_json_value(body, "{")


def is_json_array(body: Column) -> Column:
    return _is_one_json_value(body, "[")


def read_responses(responses: DataFrame) -> DataFrame:
    """Add the unfenced text and whether it is a JSON object."""
    return with_body(responses).withColumn("is_valid", is_json_object(F.col("body")))


def first_valid_attempt(
    responses: DataFrame, max_attempts: int = V.MAX_ATTEMPTS
) -> DataFrame:
    """Per request: the first attempt that parses to an object, or a failure.

    Attempts beyond the limit are ignored; of two texts under one number the smaller counts. One
    aggregation with map-side combining, so that a request with very many stored attempts does not
    gather in one task.
    """
    counted = F.col("attempt") <= max_attempts
    usable = F.col("is_valid") & counted
    # Texts that cannot be chosen are dropped before rows are sorted for the aggregation.
    candidates = read_responses(responses).select(
        "request_id",
        counted.alias("counted"),
        F.when(usable, F.struct("attempt", "body")).alias("valid"),
    )
    return (
        candidates.groupBy("request_id")
        .agg(F.min("valid").alias("first"), F.count_if("counted").alias("attempts_seen"))
        .select(
            "request_id",
            F.col("first.attempt").alias("attempt"),
            F.col("first.body").alias("body"),
            "attempts_seen",
            F.when(F.col("first").isNull(), "failed").otherwise("parsed").alias("status"),
        )
    )


def chosen_records(responses: DataFrame, max_attempts: int = V.MAX_ATTEMPTS) -> DataFrame:
    """The record of the first valid attempt of each request in ``parsed``; failed ones are out."""
    chosen = first_valid_attempt(responses, max_attempts).where("status = 'parsed'")
    return chosen.withColumn("parsed", F.from_json("body", PARSED_KPI))


def parse_kpi_responses(responses: DataFrame) -> DataFrame:
    """Every response with its validity and, where valid, its typed fields in ``parsed``."""
    return read_responses(responses).withColumn(
        "parsed", F.when(F.col("is_valid"), F.from_json("body", PARSED_KPI))
    )


def _fallback_analysis(total: Column) -> Column:
    categories = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(count).cast("bigint").alias("count"),
                F.lit(sentiment).alias("sentiment"),
                F.array().cast("array<string>").alias("comments"),
                F.lit(theme).alias("theme_summary"),
            )
            for name, count, sentiment, theme in V.FALLBACK_CATEGORIES
        ]
    )
    return F.struct(
        categories.alias("categories"),
        F.array(*[F.lit(flag) for flag in V.FALLBACK_FLAGS]).alias("priority_flags"),
        F.lit(V.FALLBACK_OVERALL).alias("overall_sentiment"),
        F.lit(V.FALLBACK_INSIGHT).alias("key_insight"),
        total.cast("bigint").alias("total_analyzed"),
    )


def parse_survey_responses(responses: DataFrame) -> DataFrame:
    """Survey analyses in ``analysis``; an unreadable one is replaced and marked as fallback.

    Expects ``n_comments``, the number of comments that were sent, for the replacement.
    """
    read = read_responses(responses)
    return read.select(
        *[column for column in responses.columns if column != "raw"],
        (~F.col("is_valid")).alias("is_fallback"),
        F.when(F.col("is_valid"), F.from_json("body", SURVEY_ANALYSIS))
        .otherwise(_fallback_analysis(F.col("n_comments")))
        .alias("analysis"),
    )


def survey_categories(analyses: DataFrame) -> DataFrame:
    """One row per category of each analysis, in the order given.

    The outer form plus a test on the position: for a plain explode Spark would first filter on
    the size of the list, and so read the JSON twice.
    """
    listed = analyses.select(
        "request_id",
        "is_fallback",
        F.posexplode_outer("analysis.categories").alias("pos", "item"),
    )
    return listed.where("pos IS NOT NULL").select(
        "request_id",
        "is_fallback",
        (F.col("pos") + 1).alias("category_number"),
        "item.name",
        "item.count",
        "item.sentiment",
        "item.theme_summary",
    )


def parse_placeholder_series(responses: DataFrame) -> DataFrame:
    """Stand-in series from responses; an unreadable one gives the fixed placeholder, marked.

    Expects ``request_id`` and ``raw``; the request is the KPI the series is for.
    """
    fixed = F.array(
        *[
            F.struct(F.lit(period).alias("period"), F.lit(str(value)).alias("value"))
            for period, value in V.PLACEHOLDER_SERIES
        ]
    )
    points = "array<struct<period:string,value:string>>"
    valid = with_body(responses).withColumn("is_valid", is_json_array(F.col("body")))
    return (
        valid.select(
            F.col("request_id").alias("kpi_id"),
            (~F.col("is_valid")).alias("is_fallback"),
            F.posexplode(
                F.when(F.col("is_valid"), F.from_json("body", points)).otherwise(fixed)
            ).alias("ord", "point"),
        )
        .select(
            "kpi_id",
            F.col("ord").cast("bigint").alias("ord"),
            F.coalesce("point.period", F.lit(V.MISSING_PERIOD)).alias("period"),
            F.col("point.value").alias("value_raw"),
            to_number(F.col("point.value")).alias("value"),
            "is_fallback",
        )
    )
