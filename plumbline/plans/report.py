"""The readiness report for a whole registry, and its flat, long and summary forms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.functions.text import (
    joined,
    safe_name,
    sql_list,
    sql_literal,
    sql_struct,
    sql_text,
)
from plumbline.operators import design, standards
from plumbline.operators.metadata import (
    SQL_EXCLUDED,
    SQL_PERMITTED,
    ai_use_step,
    definition_step,
    entity_step,
    governance_step,
    readiness_step,
    register_step,
    with_decision,
    with_findings,
)
from plumbline.operators.series import registry_left_series

# Report keys of the ten steps, in order.
STEPS = [
    "step_1_register",
    "step_2_definition",
    "step_3_entity",
    "step_4_quality",
    "step_5_ai",
    "step_6_governance",
    "step_7_readiness",
    "step_8_summary",
    "step_9_design_quality",
    "step_10_best_practices",
]


def _filled_in(text: str, value: str) -> str:
    """A fixed text with a value in its place."""
    before, after = text.split("{}")
    return f"concat({sql_literal(before)}, {value}, {sql_literal(after)})"


def _quality_step() -> Column:
    rules = sql_struct(
        outlier_rule=_filled_in(V.OUTLIER_RULE, "cast(z_threshold AS string)"),
        step_change_rule=_filled_in(
            V.STEP_CHANGE_RULE, "cast(cast(step_threshold * 100 AS bigint) AS string)"
        ),
        human_review=sql_literal(V.REVIEW_RULE),
    )
    return F.expr(
        sql_struct(
            status="quality_status",
            notes="quality_notes",
            details=sql_struct(
                anomalies_detected="anomalies_detected",
                anomaly_count="anomaly_count",
                stats=sql_struct(
                    count="coalesce(n_numeric, 0L)", mean="mean", stdev="stdev"
                ),
                rule_notes=rules,
            ),
        )
    )


def _summary_step() -> Column:
    summary = sql_struct(
        kpi_name="name",
        definition="definition",
        formula="formula",
        time_period="time_period",
        intended_audience="intended_audience",
        sources=sql_struct(
            primary="primary_source_system",
            secondary=sql_list("secondary_source_systems"),
            systems_in_join=sql_list("source_systems_in_join"),
            identifier_fields=sql_list("identifier_fields"),
        ),
        risks=sql_struct(
            definition_status="definition_status",
            entity_risk_level="entity_risk_level",
            anomalies_detected="anomalies_detected",
            governance_status="governance_status",
        ),
        ai_guidance=sql_struct(
            permitted=SQL_PERMITTED,
            excluded=SQL_EXCLUDED,
        ),
        governance=sql_struct(
            data_owner="data_owner",
            data_steward="data_steward",
            known_limitations="known_limitations",
            bias_or_equity_risks="bias_or_equity_risks",
            human_signoff_required="human_signoff_required",
        ),
        readiness_status="readiness_status",
        readiness_notes="readiness_notes",
        blockers="blockers",
    )
    return F.expr(
        sql_struct(
            status=sql_literal(V.SUMMARY_GENERATED[0]),
            notes=sql_literal(V.SUMMARY_GENERATED[1]),
            details=sql_struct(summary=summary),
        )
    )


def assess_core(registry: DataFrame, series: DataFrame, **options) -> DataFrame:
    """Steps 1 to 7: one row per KPI with the findings and outcomes as plain columns.

    The thresholds that the series were screened with are columns too, so that whatever is made of
    the assessment states those and no others. Everything but the series roll-up is a projection over the registry; a caller that selects
    a few columns pays for those only. Nested records are made by ``report_json`` alone.
    """
    screened = registry_left_series(with_findings(registry), series, **options)
    thresholds = {
        "z_threshold": options.get("z_threshold", V.Z_SCORE_THRESHOLD),
        "step_threshold": options.get("step_threshold", V.STEP_CHANGE_THRESHOLD),
    }
    return with_decision(
        screened.withColumns({name: F.lit(float(value)) for name, value in thresholds.items()})
    )


def assess(
    registry: DataFrame,
    series: DataFrame,
    include_design: bool = True,
    include_standards: bool = True,
    **options,
) -> DataFrame:
    """All ten steps. Steps 9 and 10 may be left out; they never affect readiness."""
    core = assess_core(registry, series, **options)
    designed = design.with_design(core) if include_design else design.without_design(core)
    return (
        standards.with_standards(designed)
        if include_standards
        else standards.without_standards(designed)
    )


def readiness_report(assessed: DataFrame) -> DataFrame:
    """One flat row per KPI with the outcome of every step."""
    return assessed.selectExpr(
        "kpi_id",
        "name AS kpi_name",
        "register_status",
        "array_join(missing_fields, '; ') AS missing_fields",
        "definition_status",
        "array_join(definition_issues, '; ') AS definition_issues",
        "entity_status",
        "entity_risk_level",
        "quality_status",
        "n_points",
        "anomaly_count",
        "round(mean, 4) AS mean",
        "round(stdev, 4) AS stdev",
        f"array_join({SQL_PERMITTED}, '; ') AS permitted_ai",
        "governance_status",
        "array_join(missing_elements, '; ') AS missing_elements",
        "readiness_status",
        "array_join(blockers, '; ') AS blockers",
        "design_status",
        "design_notes",
        "standards_status",
        "standards_notes",
    )


def report_long(assessed: DataFrame) -> DataFrame:
    """One row per KPI and step: status and notes."""
    generated = [sql_literal(text) for text in V.SUMMARY_GENERATED]
    outcomes = [
        *[
            (f"{step}_status", f"{step}_notes")
            for step in ["register", "definition", "entity", "quality", "ai", "governance"]
        ],
        ("readiness_status", "readiness_notes"),
        tuple(generated),
        ("design_status", "design_notes"),
        ("standards_status", "standards_notes"),
    ]
    rows = [
        f"{number}, {sql_literal(step)}, {status}, {notes}"
        for number, (step, (status, notes)) in enumerate(zip(STEPS, outcomes), start=1)
    ]
    return assessed.selectExpr(
        "kpi_id",
        "name AS kpi_name",
        f"stack({len(rows)}, {', '.join(rows)}) AS (step_number, step, status, notes)",
    )


def step8_summary(core: DataFrame) -> DataFrame:
    """The one-page summary, flattened."""
    return core.selectExpr(
        "kpi_id",
        f"{sql_literal(V.SUMMARY_GENERATED[0])} AS status",
        "name AS kpi_name",
        "definition",
        "formula",
        "time_period",
        "intended_audience",
        "primary_source_system AS primary_source",
        f"array_join({sql_list('secondary_source_systems')}, '; ') AS secondary_sources",
        f"array_join({sql_list('source_systems_in_join')}, '; ') AS systems_in_join",
        f"array_join({sql_list('identifier_fields')}, '; ') AS identifier_fields",
        "definition_status",
        "entity_risk_level",
        "anomalies_detected",
        "governance_status",
        f"array_join({SQL_PERMITTED}, '; ') AS permitted",
        f"array_join({SQL_EXCLUDED}, '; ') AS excluded",
        "data_owner",
        "data_steward",
        "known_limitations",
        "bias_or_equity_risks",
        "human_signoff_required",
        "readiness_status",
        "readiness_notes",
        "array_join(blockers, '; ') AS blockers",
    )


def report_json(assessed: DataFrame) -> DataFrame:
    """The nested report record: identity and ten steps, ready for a JSON sink.

    The rules it states are those of the assessment's own thresholds.

    Anomalies are a table of their own (``operators.series.anomalies``): a long series may
    have any number of them, and they are never gathered into one row.
    """
    identity = [
        "definition",
        "formula",
        "time_period",
        "primary_source_system",
        "secondary_source_systems",
        "intended_audience",
        "identifier_fields",
        "data_owner",
        "data_steward",
        "known_limitations",
        "bias_or_equity_risks",
        "human_signoff_required",
    ]
    steps = [
        register_step(),
        definition_step(),
        entity_step(),
        _quality_step(),
        ai_use_step(),
        governance_step(),
        readiness_step(),
        _summary_step(),
        design.design_step(skipped="design_skipped" in assessed.columns),
        standards.standards_step(skipped="standards_skipped" in assessed.columns),
    ]
    return assessed.select(
        "kpi_id",
        F.col("name").alias("kpi_name"),
        F.concat(safe_name(F.col("name")), F.lit("_report")).alias("output_name"),
        F.struct(*identity).alias("kpi_identity"),
        F.struct(*[step.alias(name) for name, step in zip(STEPS, steps)]).alias("steps"),
    )


def summary_long(assessed: DataFrame) -> DataFrame:
    """The executive summary as (section, label, value) rows, in reading order."""
    secondary = sql_list("secondary_source_systems")
    named_secondary = (
        f"if(size({secondary}) = 0, {sql_literal(V.NO_SECONDARY)}, array_join({secondary}, ', '))"
    )
    head = [
        (V.SUMMARY_IDENTITY, "KPI Name", sql_text("name")),
        (V.SUMMARY_IDENTITY, "Definition", sql_text("definition")),
        (V.SUMMARY_IDENTITY, "Formula", sql_text("formula")),
        (V.SUMMARY_IDENTITY, "Time Period", sql_text("time_period")),
        (V.SUMMARY_IDENTITY, "Primary Source System", sql_text("primary_source_system")),
        (V.SUMMARY_IDENTITY, "Secondary Source Systems", named_secondary),
        (V.SUMMARY_IDENTITY, "Intended Audience", sql_text("intended_audience")),
        (V.SUMMARY_RESULTS, "Readiness Status", "readiness_status"),
        (V.SUMMARY_RESULTS, "Definition Status", "definition_status"),
        (V.SUMMARY_RESULTS, "Entity Risk Level", "entity_risk_level"),
        (V.SUMMARY_RESULTS, "Anomalies Detected", "anomalies_detected"),
        (V.SUMMARY_RESULTS, "Governance Status", "governance_status"),
        (V.SUMMARY_RESULTS, "Design Quality", "design_status"),
        (V.SUMMARY_RESULTS, "Industry Standards", "standards_status"),
    ]
    signoff = "if(coalesce(human_signoff_required, false), 'True', 'False')"
    tail = [
        (V.SUMMARY_GOVERNANCE, "Data Owner", sql_text("data_owner")),
        (V.SUMMARY_GOVERNANCE, "Data Steward", sql_text("data_steward")),
        (V.SUMMARY_GOVERNANCE, "Known Limitations", sql_text("known_limitations")),
        (V.SUMMARY_GOVERNANCE, "Bias or Equity Risks", sql_text("bias_or_equity_risks")),
        (V.SUMMARY_GOVERNANCE, "Human Signoff Required", signoff),
    ]

    def line(section: str, label: str, value: str) -> str:
        return sql_struct(section=sql_literal(section), label=sql_literal(label), value=value)

    def lines(rows: list[tuple[str, str, str]]) -> str:
        return f"array({', '.join(line(*row) for row in rows)})"

    shown = f"if(size(blockers) = 0, array({sql_literal(V.NO_BLOCKERS)}), blockers)"
    middle = f"transform({shown}, b -> {line(V.SUMMARY_BLOCKERS, '', 'b')})"
    return assessed.selectExpr(
        "kpi_id",
        f"posexplode(concat({lines(head)}, {middle}, {lines(tail)})) AS (pos, line)",
    ).selectExpr("kpi_id", "pos + 1 AS line_number", "line.*")


def batch_summary(assessed: DataFrame) -> DataFrame:
    """Nine columns per KPI, blockers in one cell."""
    return assessed.selectExpr(
        "kpi_id",
        "name AS kpi_name",
        "readiness_status",
        "definition_status",
        "entity_risk_level AS entity_risk",
        "anomalies_detected",
        "governance_status",
        "design_status AS design_quality",
        "standards_status AS industry_standards",
        "array_join(blockers, '; ') AS blockers",
    )


def batch_counts(core: DataFrame) -> DataFrame:
    """How many KPIs were assessed, are ready and are blocked."""
    return core.agg(
        F.expr("count(1) AS total"),
        F.expr(f"count_if(readiness_status = {sql_literal(V.READY[0])}) AS ready"),
        F.expr(f"count_if(readiness_status = {sql_literal(V.NOT_READY[0])}) AS blocked"),
    )


def batch_listing(core: DataFrame) -> DataFrame:
    """Ready KPIs, and blocked KPIs with one row per blocker."""
    ready = f"readiness_status = {sql_literal(V.READY[0])}"
    return core.selectExpr(
        "kpi_id",
        "name AS kpi_name",
        f"if({ready}, 'Ready', 'Blocked') AS section",
        "explode_outer(blockers) AS blocker",
    )


def all_criteria() -> list[tuple[str, str, str]]:
    """(framework, criterion, fact) of the nineteen criteria of steps 9 and 10."""
    return (
        [("SMART", name, fact) for name, fact in design.SMART.items()]
        + [("Visualization", name, fact) for name, fact in design.VISUAL.items()]
        + [(org, check, check) for org, check, _, _ in V.STANDARDS]
    )


def criterion_prevalence(scored: DataFrame) -> DataFrame:
    """How many KPIs meet, miss or cannot be assessed on each criterion.

    All counts are taken in one aggregation to one row, which is then turned into rows.
    """
    criteria = all_criteria()
    counted = scored.agg(
        F.expr("count(1) AS kpis"),
        *[F.expr(f"count_if({fact}) AS met_{i}") for i, (_, _, fact) in enumerate(criteria)],
        *[F.expr(f"count_if(NOT {fact}) AS missed_{i}") for i, (_, _, fact) in enumerate(criteria)],
    )
    rows = [
        f"{sql_literal(framework)}, {sql_literal(name)}, met_{i}, missed_{i},"
        f" kpis - met_{i} - missed_{i}"
        for i, (framework, name, _) in enumerate(criteria)
    ]
    return counted.selectExpr(
        f"stack({len(rows)}, {', '.join(rows)})"
        " AS (framework, criterion, met, missed, not_assessed)"
    )
