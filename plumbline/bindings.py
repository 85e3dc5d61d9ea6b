"""The supplied tables read as KPI registries, series, responses and comments.

The rules follow the bindings of FIXTURES.md section 4, over whole tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import sql_list_cell, sql_literal
from plumbline.schema import PARSED_KPI, REGISTRY
from plumbline.sources.series import series_from_numbers, series_from_text

DEFINITIONS = [
    "Percentage of ordered units shipped in the year, held against a peer benchmark and target",
    "Total count of shipped units",
    "Units",
    "Survey rate of suppliers who improve; higher is better than the prior goal level",
    "First-time full-time supplier units shipped during the calendar year",
]
AUDIENCES = ["Board of Trustees", "Executive Cabinet", "Analysts", ""]
CATEGORY_BINDING = {
    "Licensing": ["license"],
    "Credentials": ["token", "@"],
    "English prose": ["the "],
    "Spanish prose": ["ción", "los "],
    "German prose": ["der "],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry_text_rows(rows: DataFrame, key: str, name: str) -> DataFrame:
    """A registry derived from a key, list fields still as comma-joined cells."""

    def pick(modulus: int, texts: dict[int, str], default: str | None) -> str:
        cases = " ".join(
            f"WHEN {remainder} THEN {sql_literal(value)}" for remainder, value in texts.items()
        )
        otherwise = sql_literal(default) if default is not None else "NULL"
        return f"CASE {key} % {modulus} {cases} ELSE {otherwise} END"

    fields = {
        "kpi_id": f"cast({key} AS bigint)",
        "name": name,
        "definition": pick(5, dict(enumerate(DEFINITIONS)), None),
        "formula": pick(4, {3: "sum of quantity", 2: "total = sum(quantity)"}, "shipped / ordered"),
        "time_period": pick(11, {0: ""}, "Calendar year"),
        "primary_source_system": pick(2, {0: "IPEDS"}, "SIS"),
        "secondary_source_systems": pick(3, {0: ""}, "SIS, ERP ,"),
        "intended_audience": pick(4, dict(enumerate(AUDIENCES)), None),
        "identifier_fields": pick(7, {0: ""}, "supp_id"),
        "source_systems_in_join": pick(6, {0: "IPEDS,SIS", 1: "SIS,SIS"}, "IPEDS"),
        "data_owner": pick(17, {0: "  "}, "Registrar"),
        "data_steward": f"if({key} % 13 = 0, NULL, 'Institutional Research')",
        "known_limitations": pick(8, {0: "Survey response bias"}, "Partial final year"),
        "bias_or_equity_risks": pick(
            5, {1: "none noted", 4: ""}, "Varies by demographic segment"
        ),
        "human_signoff_required": f"{key} % 19 <> 0",
    }
    return rows.selectExpr(*[f"{rule} AS {field}" for field, rule in fields.items()])


def as_registry(text_rows: DataFrame) -> DataFrame:
    lists = ["secondary_source_systems", "identifier_fields", "source_systems_in_join"]
    return text_rows.selectExpr(
        *[f"{sql_list_cell(name)} AS {name}" if name in lists else name for name in REGISTRY.names]
    )


def supplier_registry_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_text_rows(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")


def supplier_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_registry(supplier_registry_text(spark, sf_dir))


def customer_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_registry(
        registry_text_rows(table(spark, sf_dir, "customer"), "c_custkey", "c_name")
    )


def _cents(column: str) -> str:
    """Amounts with two decimals as whole cents: their sums do not depend on the order of rows."""
    return f"sum(cast(rint({column} * 100) AS bigint))"


def _exact_sum(column: str) -> Column:
    return F.expr(f"{_cents(column)} / 100 AS total")


def supplier_year_series(
    spark: SparkSession, sf_dir: str, complete_years: bool = False
) -> DataFrame:
    """Units shipped per supplier and year. The last year of the tables is a partial one;
    ``complete_years`` leaves it out."""
    lines = table(spark, sf_dir, "lineitem")
    if complete_years:
        lines = lines.where(F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp"))
    yearly = lines.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(
        _exact_sum("l_quantity")
    )
    return series_from_numbers(
        yearly, F.col("l_suppkey"), F.col("y") - 1994, F.col("y"), F.col("total")
    )


def _quarterly(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    quarter = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).alias("q")
    return table(spark, sf_dir, "lineitem").groupBy(key, quarter).agg(_exact_sum("l_quantity"))


def _quarter_label() -> Column:
    return F.concat(F.expr("q div 4"), F.lit(" Q"), F.col("q") % 4 + 1)


def supplier_quarter_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quarterly(spark, sf_dir, "l_suppkey")
    return series_from_numbers(
        rows, F.col("l_suppkey"), F.col("q"), _quarter_label(), F.col("total")
    )


def reported_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly series; every fourth supplier's report came without one."""
    return supplier_year_series(spark, sf_dir).where("kpi_id % 4 <> 0")


def parsed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarterly series of all but every eighth supplier, who has none to fall back on."""
    return supplier_quarter_series(spark, sf_dir).where("kpi_id % 8 <> 0")


def part_quarter_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quarterly(spark, sf_dir, "l_partkey")
    return series_from_numbers(
        rows, F.col("l_partkey"), F.col("q"), _quarter_label(), F.col("total")
    )


def messy_quarter_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier-quarter series with some values that are not numbers."""
    rows = _quarterly(spark, sf_dir, "l_suppkey")
    unread = (F.col("l_suppkey") + F.col("q")) % 41 == 0
    return series_from_text(
        rows,
        F.col("l_suppkey"),
        F.col("q"),
        _quarter_label(),
        F.when(unread, "n/a").otherwise(F.col("total").cast("string")),
    )


def user_day_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(_exact_sum("value"))
    )
    return series_from_numbers(
        daily, F.col("user_id"), F.unix_date("day"), F.col("day"), F.col("total")
    )


def customer_year_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("y"))
        .agg(_exact_sum("o_totalprice"))
    )
    return series_from_numbers(
        yearly, F.col("o_custkey"), F.col("y"), F.col("y"), F.col("total")
    )


def nation_year_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per nation and year. Orders are summed per customer before the join."""
    yearly = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("year"))
        .agg(F.expr(f"{_cents('o_totalprice')} AS part"))
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        yearly.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "year")
        .agg(F.expr("sum(part) / 100 AS total"))
    )


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.cast("bigint").alias("kpi_id"),
        F.when(k % 4 == 0, "N").when(k % 4 == 1, " y").when(k % 4 == 2, "\tY").otherwise("Y").alias("decision"),
    )


def data_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the series of a supplier's request comes from; some requests do not say."""
    k = F.col("s_suppkey")
    option = F.when(k % 5 == 1, "file").when(k % 5 == 2, "none").when(k % 5 == 3, "description")
    return table(spark, sf_dir, "supplier").select(
        k.cast("bigint").alias("kpi_id"), option.alias("data_option")
    )


def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier registry rows with their yearly series inside (at most one point per year)."""
    yearly = (
        supplier_year_series(spark, sf_dir)
        .groupBy("kpi_id")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "period", "value"))).alias("points"))
    )
    records = supplier_registry(spark, sf_dir).join(yearly, "kpi_id", "left")
    return records.withColumn(
        "historical_aggregates",
        F.transform("points", lambda point: F.struct(point["period"], point["value"])),
    ).select(*PARSED_KPI.names)


def _malformed(answer: Column, kind: Column) -> Column:
    """Texts that a lenient reader would take for the answer, one kind for each remainder of 6."""
    return (
        F.when(kind % 6 == 0, '{"name": "Unfinished", "definition": no quotes}')
        .when(kind % 6 == 1, "{'name': 'Quoted', 'definition': 'the wrong way'}")
        .when(kind % 6 == 2, F.concat(answer, F.lit(" Hope this helps!")))
        .when(kind % 6 == 3, F.concat(answer, F.lit(","), answer))
        .when(kind % 6 == 4, F.concat(answer, F.lit(",2] and more")))
        .otherwise('{"name": "Broken\nline"}')
    )


def kpi_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts per supplier; odd suppliers answer in code fences.

    Each attempt fails on its own: the first for every third supplier, the second for every other,
    the third for every fifth. Attempts after the first say so in their limitations.
    """
    attempts = parsed_records(spark, sf_dir).withColumn(
        "attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    )
    later = F.concat(F.lit("Attempt "), F.col("attempt"))
    attempts = attempts.withColumn(
        "known_limitations", F.when(F.col("attempt") > 1, later).otherwise(F.col("known_limitations"))
    ).select(
        F.col("kpi_id").alias("request_id"),
        "attempt",
        F.to_json(F.struct(*PARSED_KPI.names)).alias("answer"),
    )
    broken = F.col("request_id") % (
        F.when(F.col("attempt") == 1, 3).when(F.col("attempt") == 2, 2).otherwise(5)
    ) == 0
    fenced = F.concat(F.lit("```json\n"), F.col("answer"), F.lit("\n```"))
    return attempts.select(
        "request_id",
        "attempt",
        F.when(broken, _malformed(F.col("answer"), F.col("request_id") + F.col("attempt")))
        .when(F.col("request_id") % 2 == 1, fenced)
        .otherwise(F.col("answer"))
        .alias("raw"),
    )


def survey_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One survey analysis per customer: two categories, some malformed or incomplete."""
    k = F.col("c_custkey")
    sentiment = (
        F.when(k % 5 == 0, "positive")
        .when(k % 5 == 1, "negative")
        .when(k % 5 == 2, "mixed")
        .when(k % 5 == 3, "puzzled")
    )
    categories = F.array(
        F.struct(
            F.initcap("c_mktsegment").alias("name"),
            F.col("c_nationkey").alias("count"),
            sentiment.alias("sentiment"),
            F.array("c_name").alias("comments"),
            F.concat(F.lit("Said by "), F.col("c_name")).alias("theme_summary"),
        ),
        F.struct(
            F.lit("Balance").alias("name"),
            (k % 7).alias("count"),
            F.lit("neutral").alias("sentiment"),
            F.array().cast("array<string>").alias("comments"),
            F.lit("Account balance").alias("theme_summary"),
        ),
    )
    answer = F.to_json(
        F.struct(
            categories.alias("categories"),
            F.when(k % 2 == 0, F.array("c_name")).alias("priority_flags"),
            F.when(k % 3 != 0, sentiment).alias("overall_sentiment"),
            F.concat(F.lit("Look at "), F.col("c_mktsegment")).alias("key_insight"),
            (F.col("c_nationkey") + k % 7).alias("total_analyzed"),
        )
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("request_id"),
        (F.col("c_nationkey") + 1).alias("n_comments"),
        (k % 10 == 0).alias("is_sample"),
        F.when(k % 6 == 0, _malformed(answer, F.expr("c_custkey div 6")))
        .when(k % 6 == 1, F.concat(F.lit("```\n"), answer, F.lit("\n```")))
        .when(k % 6 == 2, "[1, 2]")
        .otherwise(answer)
        .alias("raw"),
    )


def placeholder_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stand-in series per customer, answered in plain form, in fences, or not at all."""
    k = F.col("c_custkey")
    points = F.array(
        *[
            F.struct(
                F.lit(f"Fall {2020 + i}").alias("period"), (k % 30 + 60 + i).alias("value")
            )
            for i in range(5)
        ]
    )
    answer = F.to_json(points)
    return table(spark, sf_dir, "customer").select(
        k.alias("request_id"),
        F.when(k % 8 == 0, F.concat(F.lit("Here it is: "), answer))
        .when(k % 16 == 4, F.concat(answer, F.lit("\n"), answer))
        .when(k % 16 == 12, F.concat(answer, F.lit(",0}")))
        .when(k % 4 == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .otherwise(answer)
        .alias("raw"),
    )


def document_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("comment_id"), F.col("text").alias("comment")
    )


SURVEY_DOCUMENTS = 20


def survey_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents bundled as survey records, a fixed range of ids to a record."""
    bundled = (
        document_comments(spark, sf_dir)
        .withColumn("survey_id", F.expr(f"comment_id div {SURVEY_DOCUMENTS}"))
        .groupBy("survey_id")
        .agg(F.sort_array(F.collect_list(F.struct("comment_id", "comment"))).alias("items"))
    )
    kind = F.col("survey_id") % 5
    return bundled.select(
        "survey_id",
        F.when(kind == 3, "skip").when(kind == 4, "sample").otherwise("real").alias("mode"),
        F.when(kind == 2, F.array().cast("array<string>"))
        .otherwise(F.transform("items", lambda item: item["comment"]))
        .alias("comments"),
    )
