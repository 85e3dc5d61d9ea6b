"""Every operator bound to the supplied tables, as flat results."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline import fixed_values as V
from plumbline.functions.text import joined
from plumbline.operators import design, metadata, prompts, responses, review, standards
from plumbline.operators import comments as C
from plumbline.operators import series as S
from plumbline.plans import intake, marts
from plumbline.plans import report as R
from plumbline.sources import comments as comment_source
from plumbline.sources import registry as registry_source
from plumbline.sources import reports as report_source
from plumbline.sources import series as series_source
from plumbline.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _assessed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return R.assess(
        B.supplier_registry(spark, sf_dir), B.supplier_year_series(spark, sf_dir), **options
    )


def _core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assess_core(
        B.supplier_registry(spark, sf_dir), B.supplier_year_series(spark, sf_dir)
    )


def _with_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.registry_left_series(
        B.supplier_registry(spark, sf_dir), B.supplier_year_series(spark, sf_dir)
    )


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.with_findings(B.supplier_registry(spark, sf_dir))


def _step(rows: DataFrame, step: Column, **details: bool) -> DataFrame:
    """A step's status, notes and details; details marked True are lists."""
    return rows.select("kpi_id", step.alias("s")).selectExpr(
        "kpi_id",
        "s.status",
        "s.notes",
        *[
            f"array_join(s.details.{name}, '; ') AS {name}" if is_list else f"s.details.{name}"
            for name, is_list in details.items()
        ],
    )


# --- steps over the registry --------------------------------------------------------------


@query
def step1_register(spark, sf_dir):
    return _step(_findings(spark, sf_dir), metadata.register_step(), missing_fields=True)


@query
def step2_definition(spark, sf_dir):
    return _step(
        _findings(spark, sf_dir),
        metadata.definition_step(),
        issues=True,
        follow_up_prompts=True,
    )


@query
def step3_entity(spark, sf_dir):
    return _step(
        _findings(spark, sf_dir),
        metadata.entity_step(),
        joins_required=False,
        entity_risk_level=False,
        identifier_fields=True,
        recommendation=False,
        issues=True,
    )


@query
def step5_ai_use(spark, sf_dir):
    return _step(
        _findings(spark, sf_dir),
        metadata.ai_use_step(),
        permitted_ai_techniques=True,
        excluded_ai_techniques=True,
        rationale=True,
    )


@query
def step6_governance(spark, sf_dir):
    return _step(
        _findings(spark, sf_dir),
        metadata.governance_step(),
        missing_elements=True,
        guardrails=True,
    )


@query
def step7_readiness(spark, sf_dir):
    return _step(
        _core(spark, sf_dir),
        metadata.readiness_step(),
        blockers=True,
        next_actions=True,
        note=False,
    )


@query
def step8_summary(spark, sf_dir):
    return R.step8_summary(_core(spark, sf_dir))


@query
def step9_smart(spark, sf_dir):
    return design.with_design(_with_series(spark, sf_dir)).selectExpr(
        "kpi_id",
        *[f"{fact} AS {name.lower().replace('-', '_')}" for name, fact in design.SMART.items()],
        f"{design.SQL_SMART_SCORE} AS score",
        f"array_join({design.sql_smart_strengths()}, '; ') AS strengths",
        f"array_join({design.sql_smart_issues()}, '; ') AS issues",
    )


@query
def step9_tufte(spark, sf_dir):
    return design.with_design(_with_series(spark, sf_dir)).selectExpr(
        "kpi_id",
        *[f"{fact} AS {name}" for name, fact in design.VISUAL.items()],
        f"{design.SQL_VISUAL_SCORE} AS score",
        f"{design.SQL_VISUAL_PERCENT} AS percentage",
        f"array_join({design.sql_visual_strengths()}, '; ') AS strengths",
        f"array_join({design.sql_visual_issues()}, '; ') AS issues",
    )


@query
def step9_recommendations(spark, sf_dir):
    return design.with_design(_with_series(spark, sf_dir)).selectExpr(
        "kpi_id", f"array_join({design.sql_design_recommendations()}, '; ') AS recommendations"
    )


@query
def step9_status(spark, sf_dir):
    return design.with_design(_with_series(spark, sf_dir)).selectExpr(
        "kpi_id",
        "design_status AS status",
        "design_notes AS notes",
        f"{design.SQL_ACTIONABILITY} AS actionability",
    )


@query
def step10_standards(spark, sf_dir):
    return standards.with_standards(_with_series(spark, sf_dir)).selectExpr(
        "kpi_id",
        *standards.CHECKS,
        "standards_status AS status",
        "standards_notes AS notes",
        f"{standards.SQL_TOTAL_SCORE} AS total_score",
        f"array_join({standards.sql_standards_recommendations()}, '; ') AS recommendations",
    )


@query
def standards_scores(spark, sf_dir):
    return standards.standards_scores(
        standards.with_standards(_with_series(spark, sf_dir))
    )


@query
def optional_steps(spark, sf_dir):
    assessed = _assessed(spark, sf_dir, include_design=False, include_standards=False)
    return assessed.selectExpr(
        "kpi_id",
        "readiness_status",
        "design_status",
        "design_notes",
        "standards_status",
        "standards_notes",
    )


# --- reports ------------------------------------------------------------------------------


@query
def readiness_report(spark, sf_dir):
    return R.readiness_report(_assessed(spark, sf_dir))


@query
def batch_summary(spark, sf_dir):
    return R.batch_summary(_assessed(spark, sf_dir))


@query
def batch_counts(spark, sf_dir):
    return R.batch_counts(_core(spark, sf_dir))


@query
def batch_listing(spark, sf_dir):
    return R.batch_listing(_core(spark, sf_dir))


@query
def summary_long(spark, sf_dir):
    return R.summary_long(_assessed(spark, sf_dir))


@query
def report_long(spark, sf_dir):
    return R.report_long(_assessed(spark, sf_dir))


@query
def criterion_prevalence(spark, sf_dir):
    return R.criterion_prevalence(
        standards.with_standards(design.with_design(_with_series(spark, sf_dir)))
    )


@query
def report_json_sink(spark, sf_dir):
    path = scratch_path(spark, "reports.json")
    schema = report_source.write_report_json(_assessed(spark, sf_dir), path, by_name=True)
    return _report_fields(spark.read.schema(schema).json(path))


def _read_back(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """A CSV folder with a header as rows of the given layout, by position; empty cells are empty."""
    reader = spark.read.option("escape", '"').option("header", True).option("nullValue", "\0")
    return reader.schema(rows.schema).csv(path)


@query
def batch_csv_sink(spark, sf_dir):
    """The batch summary written under its published header, and read back."""
    path, assessed = scratch_path(spark, "batch.csv"), _assessed(spark, sf_dir)
    report_source.write_batch_csv(assessed, path)
    return _read_back(spark, path, R.batch_summary(assessed).drop("kpi_id"))


@query
def summary_csv_sink(spark, sf_dir):
    """The executive summaries written as lines, and read back."""
    path, assessed = scratch_path(spark, "summary.csv"), _assessed(spark, sf_dir)
    report_source.write_summary_csv(assessed, path)
    return _read_back(spark, path, R.summary_long(assessed))


@query
def anomalies_json_sink(spark, sf_dir):
    """The anomalies written beside the reports, and read back."""
    path, found = scratch_path(spark, "anomalies.json"), S.anomalies(B.messy_quarter_series(spark, sf_dir))
    report_source.write_anomalies_json(found, path)
    return spark.read.schema(found.schema).json(path)


def _report_fields(reports: DataFrame) -> DataFrame:
    steps = F.col("steps")
    return reports.select(
        "kpi_id",
        "kpi_name",
        "output_name",
        F.col("kpi_identity.definition").alias("definition"),
        joined(F.col("kpi_identity.secondary_source_systems")).alias("secondary_sources"),
        F.col("kpi_identity.data_steward").alias("data_steward"),
        F.col("kpi_identity.human_signoff_required").alias("human_signoff_required"),
        steps["step_2_definition"]["status"].alias("definition_status"),
        steps["step_4_quality"]["details"]["anomaly_count"].alias("anomaly_count"),
        steps["step_4_quality"]["details"]["stats"]["count"].alias("stats_count"),
        F.round(steps["step_4_quality"]["details"]["stats"]["mean"], 6).alias("stats_mean"),
        steps["step_7_readiness"]["status"].alias("readiness_status"),
        joined(steps["step_7_readiness"]["details"]["blockers"]).alias("blockers"),
        steps["step_9_design_quality"]["details"]["smart_framework"]["score"].alias(
            "smart_score"
        ),
        steps["step_9_design_quality"]["details"]["smart_framework"]["criteria"][
            "Achievable"
        ].alias("achievable"),
        steps["step_10_best_practices"]["details"]["overall"]["percentage"].alias(
            "standards_percent"
        ),
        steps["step_10_best_practices"]["details"]["agb_standards"]["checks"][
            "board_appropriate"
        ]["met"].alias("board_appropriate"),
        steps["step_4_quality"]["details"]["rule_notes"]["outlier_rule"].alias("outlier_rule"),
        steps["step_4_quality"]["details"]["rule_notes"]["step_change_rule"].alias("step_change_rule"),
        steps["step_9_design_quality"]["details"]["note"].alias("design_note"),
        steps["step_10_best_practices"]["details"]["note"].alias("standards_note"),
        F.concat_ws(
            "; ",
            *[
                steps["step_10_best_practices"]["details"][f"{org.lower()}_standards"]["organization"]
                for org in V.ORGANIZATIONS
            ],
        ).alias("organizations"),
    )


@query
def latest_report_scan(spark, sf_dir):
    """Reports written twice, the first time without any series, and once under a test name."""
    folder = scratch_path(spark, "generations")
    registry = B.supplier_registry(spark, sf_dir)
    series = B.supplier_year_series(spark, sf_dir)
    older = R.assess(registry, series.where(F.lit(False)))
    report_source.write_report_json(older, f"{folder}/first_report.json")
    schema = report_source.write_report_json(R.assess(registry, series), f"{folder}/second_report.json")
    report_source.write_report_json(older, f"{folder}/test_third_report.json")
    return _report_fields(report_source.scan_latest_reports(spark, folder, schema))


# --- series -------------------------------------------------------------------------------


@query
def series_stats(spark, sf_dir):
    return S.series_stats(B.part_quarter_series(spark, sf_dir)).select(
        "kpi_id",
        "n_points",
        "n_numeric",
        F.round("mean", 6).alias("mean"),
        F.round("stdev", 6).alias("stdev"),
        "min_value",
        "max_value",
    )


@query
def series_spread(spark, sf_dir):
    return S.series_spread(B.supplier_year_series(spark, sf_dir)).select(
        "kpi_id",
        "n_points",
        "spread",
        F.round("variation", 6).alias("variation"),
        "stable_range",
        "has_variation",
    )


@query
def non_numeric_points(spark, sf_dir):
    return S.non_numeric_points(B.messy_quarter_series(spark, sf_dir))


@query
def outliers(spark, sf_dir):
    return S.outliers(B.part_quarter_series(spark, sf_dir)).select(
        "kpi_id", "ord", "period", "value", F.round("z", 6).alias("z"), "z_score", "note"
    )


@query
def step_changes(spark, sf_dir):
    return S.step_changes(B.user_day_series(spark, sf_dir)).withColumn(
        "change", F.round("change", 6)
    )


@query
def anomalies(spark, sf_dir):
    return S.anomalies(B.messy_quarter_series(spark, sf_dir))


@query
def anomaly_rollup(spark, sf_dir):
    return S.registry_left_series(
        B.supplier_registry(spark, sf_dir), B.messy_quarter_series(spark, sf_dir)
    ).select(
        "kpi_id",
        "n_points",
        "n_numeric",
        "non_numeric_count",
        "outlier_count",
        "step_change_count",
        "anomaly_count",
        "anomalies_detected",
        "quality_status",
        "quality_notes",
    )


@query
def registry_left_series(spark, sf_dir):
    """Customers as KPIs, their events as series: most have none and are kept."""
    return S.registry_left_series(
        B.customer_registry(spark, sf_dir), B.user_day_series(spark, sf_dir)
    ).select("kpi_id", "name", "n_points", "anomaly_count", "anomalies_detected", "quality_status")


@query
def chart_points(spark, sf_dir):
    return S.chart_points(B.messy_quarter_series(spark, sf_dir))


# --- scans --------------------------------------------------------------------------------


def _write_csv(rows: DataFrame, path: str, second: Column) -> None:
    """Files of two kinds in one folder: rows where ``second`` holds go with the columns reversed."""
    for part, columns in ((~second, rows.columns), (second, rows.columns[::-1])):
        (
            rows.where(part)
            .select(*columns)
            .write.mode("append")
            .option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )


@query
def scan_kpi_registry_csv(spark, sf_dir):
    path = scratch_path(spark, "registry.csv")
    rows = B.supplier_registry_text(spark, sf_dir)
    multiline = F.concat(F.lit('As "reported",\n'), F.col("known_limitations"))
    _write_csv(rows.withColumn("known_limitations", multiline), path, F.col("kpi_id") % 2 == 1)
    return registry_source.read_registry_csv(spark, path, multi_line=True).select(
        "kpi_id",
        "name",
        "definition",
        "time_period",
        joined(F.col("secondary_source_systems")).alias("secondary_source_systems"),
        joined(F.col("identifier_fields")).alias("identifier_fields"),
        joined(F.col("source_systems_in_join")).alias("source_systems_in_join"),
        "data_owner",
        "data_steward",
        "known_limitations",
        "human_signoff_required",
    )


@query
def scan_panel_series(spark, sf_dir):
    """The nation panel written with unreadable rows among the good ones, and read back."""
    path = scratch_path(spark, "panel.csv")
    panel = B.nation_year_panel(spark, sf_dir).select(
        F.col("c_nationkey").cast("string").alias("UNITID"),
        F.col("year").cast("string").alias("YEAR"),
        F.col("total").cast("string").alias("RET_PCF"),
    )
    bad_rows = F.array(
        F.struct("UNITID", "YEAR", "RET_PCF"),
        F.struct(F.lit("unit").alias("UNITID"), "YEAR", "RET_PCF"),
        F.struct("UNITID", F.lit("").alias("YEAR"), "RET_PCF"),
        F.struct("UNITID", F.concat("YEAR", F.lit(".0")).alias("YEAR"), "RET_PCF"),
        F.struct("UNITID", "YEAR", F.lit("suppressed").alias("RET_PCF")),
    )
    rows = panel.select("UNITID", F.inline(bad_rows).alias("a", "b", "c"))
    of_unit = (F.col("UNITID") % 3 == 0).alias("second")
    rows = rows.select(F.col("a").alias("UNITID"), F.col("b").alias("YEAR"), F.col("c").alias("RET_PCF"), of_unit)
    _write_csv(rows, path, F.col("second"))
    return series_source.read_panel_csv(spark, path).select("kpi_id", "ord", "period", "value")


@query
def scan_series_csv(spark, sf_dir):
    path = scratch_path(spark, "series.csv")
    _write_csv(
        B.messy_quarter_series(spark, sf_dir).select(
            "kpi_id", "ord", "period", F.col("value_raw").alias("value")
        ),
        path,
        F.col("kpi_id") % 2 == 1,
    )
    return series_source.read_series_csv(
        spark, path, key_column="kpi_id", order_column="ord"
    ).select("kpi_id", "ord", "period", "value")


@query
def scan_series_positional(spark, sf_dir):
    """One folder per nation, with a header line and unreadable rows."""
    path = scratch_path(spark, "positional")
    panel = B.nation_year_panel(spark, sf_dir).select(
        F.col("c_nationkey").alias("nation"),
        F.col("year").cast("string").alias("period"),
        F.col("total").cast("string").alias("value"),
    )
    rows = panel.select(
        "nation",
        F.inline(
            F.array(
                F.struct("period", "value"),
                F.struct("period", F.lit("n/a").alias("value")),
                F.struct(F.lit(" ").alias("period"), "value"),
            )
        ),
    )
    (
        rows.repartition("nation")
        .sortWithinPartitions("nation", "period")
        .write.option("header", True)
        .partitionBy("nation")
        .csv(path)
    )
    return series_source.read_positional_csv(
        spark, path, key=F.regexp_extract("_metadata.file_path", r"nation=(\d+)", 1)
    ).select("kpi_id", "ord", "period", "value")


@query
def resolve_series_columns(spark, sf_dir):
    loose = B.nation_year_panel(spark, sf_dir).select(
        F.col("c_nationkey").alias("nation"),
        F.col("year").alias("Order Year"),
        F.concat(F.lit("year "), F.col("year")).alias("remark"),
        F.col("total").alias("Total Rate"),
    )
    return series_source.resolve_series_columns(loose, "nation", F.col("`Order Year`")).select(
        "kpi_id", "ord", "period", "value"
    )


@query
def scan_parsed_kpi_json(spark, sf_dir):
    """Parsed records written with some required or optional fields left out, and read back."""
    path = scratch_path(spark, "parsed.json")
    k = F.col("kpi_id")
    records = B.parsed_records(spark, sf_dir).withColumns(
        {
            "formula": F.when(k % 9 != 0, F.col("formula")),
            "identifier_fields": F.when(k % 4 != 0, F.col("identifier_fields")),
            "human_signoff_required": F.when(k % 10 != 0, F.col("human_signoff_required")),
        }
    )
    records.write.json(path)
    parsed = registry_source.read_parsed_kpi_json(spark, path)
    points = (
        registry_source.series_of(parsed)
        .groupBy("kpi_id")
        .agg(F.count("value").alias("n_points"), F.max_by("value", "ord").alias("latest_value"))
    )
    return (
        registry_source.registry_of(parsed)
        .join(points, "kpi_id", "left")
        .select(
            "kpi_id",
            "name",
            "formula",
            joined(F.col("secondary_source_systems")).alias("secondary_source_systems"),
            joined(F.col("identifier_fields")).alias("identifier_fields"),
            "human_signoff_required",
            "n_points",
            "latest_value",
        )
    )


@query
def scan_survey_comments(spark, sf_dir):
    path = scratch_path(spark, "surveys.json")
    B.survey_files(spark, sf_dir).write.json(path)
    return comment_source.survey_comments(comment_source.read_survey_files(spark, path))


# --- comments -----------------------------------------------------------------------------


@query
def categorize_comments(spark, sf_dir):
    return C.categorize_comments(
        B.document_comments(spark, sf_dir), B.CATEGORY_BINDING
    ).select("comment_id", "category")


@query
def categorize_comments_default(spark, sf_dir):
    """The built-in dictionary over the same texts."""
    return C.categorize_comments(B.document_comments(spark, sf_dir)).select(
        "comment_id", "category"
    )


@query
def categorize_comments_by_table(spark, sf_dir):
    """The same categories from a table of keywords."""
    rows = [
        (i, category, keyword)
        for i, (category, keywords) in enumerate(B.CATEGORY_BINDING.items())
        for keyword in keywords
    ]
    keywords = spark.createDataFrame(rows, "priority int, category string, keyword string")
    return C.categorize_by_table(B.document_comments(spark, sf_dir), keywords).select(
        "comment_id", "category"
    )


@query
def comment_category_counts(spark, sf_dir):
    return C.comment_category_counts(
        C.categorize_comments(B.document_comments(spark, sf_dir), B.CATEGORY_BINDING)
    )


# --- prompts and responses ----------------------------------------------------------------


@query
def kpi_parse_prompts(spark, sf_dir):
    described = B.supplier_registry(spark, sf_dir).select(
        "kpi_id",
        F.concat_ws(". ", "name", "definition", "formula", "time_period").alias("description"),
    )
    return prompts.kpi_parse_prompts(described)


@query
def refinement_prompts(spark, sf_dir):
    return prompts.refinement_prompts(R.report_json(_assessed(spark, sf_dir)))


@query
def placeholder_prompts(spark, sf_dir):
    registry = B.customer_registry(spark, sf_dir)
    choice = review.series_choice(
        registry, B.user_day_series(spark, sf_dir), B.customer_year_series(spark, sf_dir)
    )
    short = choice.where("origin = 'placeholder'").select("kpi_id")
    return prompts.placeholder_prompts(registry.join(short, "kpi_id", "left_semi"))


@query
def survey_prompt_batches(spark, sf_dir):
    return prompts.survey_prompt_batches(B.document_comments(spark, sf_dir))


@query
def parse_llm_kpi(spark, sf_dir):
    parsed = responses.parse_kpi_responses(B.kpi_responses(spark, sf_dir))
    return parsed.select(
        "request_id",
        "attempt",
        "is_valid",
        F.col("parsed.name").alias("name"),
        F.col("parsed.definition").alias("definition"),
        joined(F.col("parsed.source_systems_in_join")).alias("source_systems_in_join"),
        F.col("parsed.data_steward").alias("data_steward"),
        F.col("parsed.human_signoff_required").alias("human_signoff_required"),
        F.array_size("parsed.historical_aggregates").alias("n_points"),
    )


@query
def first_valid_attempt(spark, sf_dir):
    chosen = responses.first_valid_attempt(B.kpi_responses(spark, sf_dir))
    return chosen.select(
        "request_id",
        "status",
        "attempt",
        "attempts_seen",
        F.get_json_object("body", "$.name").alias("name"),
    )


@query
def parse_survey_analysis(spark, sf_dir):
    return responses.survey_categories(
        responses.parse_survey_responses(B.survey_responses(spark, sf_dir))
    )


@query
def placeholder_series(spark, sf_dir):
    return responses.parse_placeholder_series(B.placeholder_responses(spark, sf_dir))


@query
def survey_section_mart(spark, sf_dir):
    return marts.survey_section_mart(
        responses.parse_survey_responses(B.survey_responses(spark, sf_dir))
    )


# --- review and marts ---------------------------------------------------------------------


@query
def review_gate(spark, sf_dir):
    registry = B.supplier_registry(spark, sf_dir).select("kpi_id", "name")
    gate = F.when(F.col("is_approved"), "approved").otherwise("pending").alias("gate")
    return review.gated(registry, B.approvals(spark, sf_dir)).select("kpi_id", "name", gate)


@query
def field_review(spark, sf_dir):
    """What the first valid attempt of each request says, for people to confirm."""
    chosen = responses.chosen_records(B.kpi_responses(spark, sf_dir))
    return review.field_review(chosen.select(F.col("request_id").alias("kpi_id"), "parsed"))


@query
def intake_to_report(spark, sf_dir):
    """Responses through attempts, required fields, gate and choice of series to their reports."""
    found = intake.intake(
        B.kpi_responses(spark, sf_dir),
        B.approvals(spark, sf_dir),
        B.messy_quarter_series(spark, sf_dir).where("kpi_id % 7 <> 0"),
        B.data_options(spark, sf_dir),
    )
    return intake.intake_report(found)


@query
def series_fallback(spark, sf_dir):
    return review.series_fallback(
        B.customer_registry(spark, sf_dir),
        B.user_day_series(spark, sf_dir),
        B.customer_year_series(spark, sf_dir),
    )


@query
def dashboard_mart(spark, sf_dir):
    """Reports and the series shown beside them: their own, a parsed one, or the placeholder."""
    registry = B.supplier_registry(spark, sf_dir)
    first, second = B.reported_series(spark, sf_dir), B.parsed_series(spark, sf_dir)
    assessed = R.assess(registry, first)
    return marts.dashboard_mart(R.report_json(assessed), review.resolved_facts(registry, first, second))
