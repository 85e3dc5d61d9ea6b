"""Tables behind a dashboard: one card per KPI and the survey section."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.functions.numbers import sql_one_decimal
from plumbline.functions.text import joined, sql_literal


def dashboard_mart(reports: DataFrame, series_facts: DataFrame) -> DataFrame:
    """One row of dashboard values per report.

    ``series_facts`` has one row per KPI on the series that is shown, as
    ``operators.review.resolved_facts`` makes them: n_points, latest_value, min_value, max_value and
    is_synthetic. Anomalies are those of the report. The points to draw are
    ``operators.series.chart_points``.
    """
    smart = "steps.step_9_design_quality.details.smart_framework"
    visual = "steps.step_9_design_quality.details.tufte_principles"
    overall = "steps.step_10_best_practices.details.overall"
    readiness = "steps.step_7_readiness.status"
    blockers = "steps.step_7_readiness.details.blockers"
    standing = f"coalesce(steps.step_10_best_practices.status, {sql_literal(V.NOT_AVAILABLE)})"
    has_chart = f"coalesce(n_points, 0) >= {V.MIN_CHART_POINTS}"
    required, not_set = [sql_literal(label) for label in V.SIGNOFF_LABELS]

    def shown(expression: str, default: str) -> str:
        return f"coalesce({expression}, {sql_literal(default)})"

    columns = {
        "readiness": readiness,
        "readiness_light": f"if({readiness} = {sql_literal(V.READY[0])}, 'green', 'red')",
        "smart_score": shown(f"{smart}.score", V.NOT_AVAILABLE),
        "visual_score": shown(f"{visual}.score", V.NOT_AVAILABLE),
        "visual_percent": shown(f"{visual}.percentage", V.NOT_AVAILABLE),
        "standards_score": shown(f"{overall}.total_score", V.NOT_AVAILABLE),
        "standards_percent": shown(f"{overall}.percentage", V.NOT_AVAILABLE),
        "standards_status": standing,
        "standards_light": f"CASE WHEN contains({standing}, 'Strong') THEN 'green'"
        f" WHEN contains({standing}, 'Partial') THEN 'amber' ELSE 'red' END",
        "blockers": f"if(size({blockers}) > 0, array_join({blockers}, '; '),"
        f" {sql_literal(V.NO_BLOCKERS)})",
        "n_points": "coalesce(n_points, 0)",
        "anomaly_count": "coalesce(steps.step_4_quality.details.anomaly_count, 0)",
        "is_synthetic": "coalesce(is_synthetic, false)",
        "has_chart": has_chart,
        "latest_value": f"if({has_chart} AND latest_value IS NOT NULL,"
        f" {sql_one_decimal('latest_value')}, {sql_literal(V.NOT_AVAILABLE)})",
        "axis_min": f"if({has_chart},"
        f" greatest(0, cast(min_value AS bigint) - {V.AXIS_MARGIN}), NULL)",
        "axis_max": f"if({has_chart}, cast(max_value AS bigint) + {V.AXIS_MARGIN}, NULL)",
        "source": shown("kpi_identity.primary_source_system", V.NOT_SPECIFIED),
        "data_owner": shown("kpi_identity.data_owner", V.NOT_SPECIFIED),
        "data_steward": shown("kpi_identity.data_steward", V.NOT_SPECIFIED),
        "human_signoff": f"if(coalesce(kpi_identity.human_signoff_required, true),"
        f" {required}, {not_set})",
        "known_limitations": shown("kpi_identity.known_limitations", V.NOT_SPECIFIED),
        "equity_risks": shown("kpi_identity.bias_or_equity_risks", V.NOT_SPECIFIED),
    }
    return reports.join(series_facts, "kpi_id", "left").selectExpr(
        "kpi_id", "kpi_name", *[f"{rule} AS {name}" for name, rule in columns.items()]
    )


def survey_section_mart(analyses: DataFrame) -> DataFrame:
    """Category rows of each survey analysis with the values shown beside them.

    Expects ``parse_survey_responses`` output plus ``is_sample``.
    """

    def light(column):
        return F.when(column.isin(V.SENTIMENTS), column).otherwise("other")

    overall = F.coalesce("analysis.overall_sentiment", F.lit(V.DEFAULT_OVERALL_SENTIMENT))
    sentiment = F.coalesce("item.sentiment", F.lit(V.DEFAULT_SENTIMENT))
    return analyses.select(
        "request_id",
        "is_sample",
        "is_fallback",
        F.initcap(overall).alias("overall_sentiment"),
        light(overall).alias("overall_light"),
        F.coalesce("analysis.key_insight", F.lit("")).alias("key_insight"),
        F.coalesce("analysis.total_analyzed", F.lit(0)).alias("total_analyzed"),
        joined(
            F.coalesce("analysis.priority_flags", F.array().cast("array<string>"))
        ).alias("priority_flags"),
        F.posexplode_outer("analysis.categories").alias("pos", "item"),
    ).select(
        "*",
        (F.col("pos") + 1).alias("category_number"),
        F.coalesce("item.name", F.lit("")).alias("category"),
        F.coalesce("item.count", F.lit(0)).alias("comments"),
        F.coalesce("item.theme_summary", F.lit("")).alias("theme"),
        sentiment.alias("sentiment"),
        light(sentiment).alias("sentiment_light"),
    ).drop("pos", "item")
