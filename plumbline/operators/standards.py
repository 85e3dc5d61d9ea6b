"""Alignment with sector standards (step 10): nine yes/no checks by three organizations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.functions.text import (
    said,
    sql_filled,
    sql_literal,
    sql_mentions,
    sql_struct,
    sql_text,
    sql_texts_where,
)

CHECKS = [check for _, check, _, _ in V.STANDARDS]
SQL_TOTAL_SCORE = f"concat(standards_met, '/{len(V.STANDARDS)}')"
SQL_PERCENT = f"concat(cast(round(standards_met * 100 / {len(V.STANDARDS)}) AS int), '%')"


def standard_checks() -> dict[str, str]:
    """Check name to its test, in the order of the table of standards."""
    definition = sql_text("definition")
    source = sql_text("primary_source_system")
    trend = f"coalesce(n_points, 0) >= {V.MIN_POINTS_FOR_TREND}"
    return {
        "data_governance": f"{sql_filled('data_owner')} AND {sql_filled('data_steward')}",
        "equity_consideration": sql_filled("bias_or_equity_risks"),
        "limitations_documented": sql_filled("known_limitations"),
        "board_appropriate": sql_mentions(sql_text("intended_audience"), V.BOARD_TERMS),
        "multi_year_trend": trend,
        "contextualized": sql_mentions(definition, V.CONTEXT_TERMS),
        "standard_definitions": f"contains({source}, {sql_literal(V.STANDARD_SOURCE)})"
        f" OR {sql_mentions(definition, V.STANDARD_TERMS)}",
        "multi_year_data": trend,
        "auditable": f"{sql_filled('formula')} AND {sql_filled('primary_source_system')}",
    }


def checks_of(organization: str) -> list[str]:
    return [check for org, check, _, _ in V.STANDARDS if org == organization]


def met_name(organization: str) -> str:
    return f"{organization.lower()}_met"


def _count(checks: list[str]) -> str:
    return " + ".join(f"cast({check} AS int)" for check in checks)


def _by_alignment(position: int) -> str:
    percent = f"standards_met * 100 / {len(V.STANDARDS)}"
    return (
        f"CASE WHEN {percent} >= {V.STRONG_ALIGNMENT_PERCENT}"
        f" THEN {sql_literal(V.ALIGNMENT_STRONG[position])}"
        f" WHEN {percent} >= {V.PARTIAL_ALIGNMENT_PERCENT}"
        f" THEN {sql_literal(V.ALIGNMENT_PARTIAL[position])}"
        f" ELSE {sql_literal(V.ALIGNMENT_WEAK[position])} END"
    )


def with_standards(kpis: DataFrame) -> DataFrame:
    """Checks, scores, status and notes of step 10."""
    notes = f"concat({_by_alignment(1)}, ' (', {SQL_TOTAL_SCORE}, ' met, ', {SQL_PERCENT}, ')')"
    columns = {
        **standard_checks(),
        **{met_name(org): _count(checks_of(org)) for org in V.ORGANIZATIONS},
        "standards_met": _count(CHECKS),
        "standards_status": _by_alignment(0),
        "standards_notes": notes,
    }
    return kpis.selectExpr("*", *[f"{test} AS {name}" for name, test in columns.items()])


def without_standards(kpis: DataFrame) -> DataFrame:
    """The same columns with the step marked as skipped; its details then read NULL."""
    return with_standards(kpis).withColumns(
        {
            "standards_status": F.lit(V.STANDARDS_SKIPPED[0]),
            "standards_notes": F.lit(V.STANDARDS_SKIPPED[1]),
            "standards_skipped": F.lit(True),
        }
    )


def sql_standards_recommendations() -> str:
    return sql_texts_where(
        *[(f"NOT {check}", said(f"{org}: {standard}")) for org, check, standard, _ in V.STANDARDS]
    )


def _organization(organization: str) -> str:
    rows = [row for row in V.STANDARDS if row[0] == organization]
    return sql_struct(
        score=f"concat({met_name(organization)}, '/{len(rows)}')",
        checks=sql_struct(
            **{
                check: sql_struct(
                    standard=sql_literal(standard), met=check, reference=sql_literal(reference)
                )
                for _, check, standard, reference in rows
            }
        ),
        organization=sql_literal(V.ORGANIZATION_LABELS[organization]),
    )


def standards_step(skipped: bool = False) -> Column:
    """The full step as one nested column; a skipped one has the same type, without details."""
    details = sql_struct(
        **{f"{org.lower()}_standards": _organization(org) for org in V.ORGANIZATIONS},
        overall=sql_struct(
            total_score=SQL_TOTAL_SCORE, percentage=SQL_PERCENT, status="standards_status"
        ),
        recommendations=sql_standards_recommendations(),
        note=sql_literal(V.STANDARDS_NOTE),
    )
    return F.expr(
        sql_struct(
            status="standards_status",
            notes="standards_notes",
            details=f"if(true, NULL, {details})" if skipped else details,
        )
    )


def standards_scores(scored: DataFrame) -> DataFrame:
    """Scores in long form: one row per KPI and organization, and one overall. No shuffle."""
    rows = [(org, met_name(org), len(checks_of(org))) for org in V.ORGANIZATIONS]
    rows.append(("OVERALL", "standards_met", len(V.STANDARDS)))
    listed = ", ".join(f"{sql_literal(org)}, {met}, {total}" for org, met, total in rows)
    return scored.select(
        "kpi_id", F.expr(f"stack({len(rows)}, {listed}) AS (organization, met, total)")
    ).select("*", F.expr("cast(round(met * 100 / total) AS int) AS percentage"))
