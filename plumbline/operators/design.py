"""Design and visualization quality (step 9).

Columns expected: the registry and, where a series exists, one row of the quality roll-up.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.functions.numbers import sql_one_decimal
from plumbline.functions.text import (
    said,
    sql_filled,
    sql_literal,
    sql_mentions,
    sql_struct,
    sql_text,
    sql_texts_where,
)
from plumbline.operators.metadata import sql_shows_operator
from plumbline.operators.series import SQL_HAS_VARIATION, SQL_STABLE_RANGE

# Criterion name to the fact it rests on; a NULL fact means it cannot be assessed.
SMART = dict(
    zip(
        V.SMART_CRITERIA,
        ["is_specific", "is_measurable", "is_achievable", "has_audience", "has_period"],
    )
)
VISUAL = dict(
    zip(
        V.VISUAL_CRITERIA,
        ["has_ratio", "has_units", "has_comparison", "has_segments", "is_owned"],
    )
)


def _facts() -> dict[str, str]:
    """The plain yes/no facts the criteria are made of."""
    definition = sql_text("definition")
    risks = sql_text("bias_or_equity_risks")
    return {
        "is_specific": f"length({definition}) > {V.SPECIFIC_DEFINITION_LENGTH}",
        "is_measurable": sql_shows_operator(V.FORMULA_OPERATORS),
        "is_achievable": SQL_STABLE_RANGE,
        "has_audience": sql_filled("intended_audience"),
        "has_period": sql_filled("time_period"),
        "is_owned": f"{sql_filled('data_owner')} AND has_audience",
        "has_ratio": sql_shows_operator(V.RATIO_OPERATORS),
        "has_trend": f"coalesce(n_points, 0) >= {V.MIN_POINTS_FOR_TREND}",
        "has_units": sql_mentions(definition, V.UNIT_TERMS),
        "has_direction": sql_mentions(definition, V.DIRECTION_TERMS),
        "has_comparison": sql_mentions(definition, V.COMPARISON_TERMS),
        "has_variation": SQL_HAS_VARIATION,
        "has_segments": sql_mentions(risks, V.SEGMENT_TERMS),
        "names_segment": sql_mentions(risks, V.SEGMENT_ADVICE_TERMS),
        "names_goal": sql_mentions(definition, V.GOAL_TERMS),
    }


def _scores() -> dict[str, str]:
    def met(criteria: dict[str, str]) -> str:
        return " + ".join(f"coalesce(cast({fact} AS int), 0)" for fact in criteria.values())

    return {
        "smart_met": met(SMART),
        "smart_total": " + ".join(f"cast({fact} IS NOT NULL AS int)" for fact in SMART.values()),
        "visual_met": met(VISUAL),
    }


def with_design(kpis: DataFrame) -> DataFrame:
    """Facts, scores, status and notes of step 9; each column may use the ones before it."""
    notes = (
        f"concat('SMART: ', {SQL_SMART_SCORE}, ', Tufte: ', {SQL_VISUAL_SCORE},"
        f" ' (', {SQL_VISUAL_PERCENT}, '). ', {_by_scores(1)})"
    )
    columns = {
        **_facts(),
        **_scores(),
        "design_status": _by_scores(0),
        "design_notes": notes,
    }
    return kpis.selectExpr("*", *[f"{test} AS {name}" for name, test in columns.items()])


def without_design(kpis: DataFrame) -> DataFrame:
    """The same columns with the step marked as skipped; its details then read NULL."""
    return with_design(kpis).withColumns(
        {
            "design_status": F.lit(V.DESIGN_SKIPPED[0]),
            "design_notes": F.lit(V.DESIGN_SKIPPED[1]),
            "design_skipped": F.lit(True),
        }
    )


SQL_SMART_SCORE = "concat(smart_met, '/', smart_total)"
SQL_VISUAL_SCORE = f"concat(visual_met, '/{len(V.VISUAL_CRITERIA)}')"
SQL_VISUAL_PERCENT = f"concat(visual_met * {100 // len(V.VISUAL_CRITERIA)}, '%')"
SQL_ACTIONABILITY = "if(is_owned, 'High', 'Medium')"


def _by_scores(position: int) -> str:
    smart = f"smart_met >= {V.GOOD_DESIGN_SCORE}"
    visual = f"visual_met >= {V.GOOD_DESIGN_SCORE}"
    return (
        f"CASE WHEN {smart} AND {visual} THEN {sql_literal(V.DESIGN_STRONG[position])}"
        f" WHEN {smart} THEN {sql_literal(V.DESIGN_NEEDS_VISUALS[position])}"
        f" WHEN {visual} THEN {sql_literal(V.DESIGN_NEEDS_REFINEMENT[position])}"
        f" ELSE {sql_literal(V.DESIGN_WEAK[position])} END"
    )


def sql_smart_strengths() -> str:
    before, after = V.ACHIEVABLE_STRENGTH.split("{:.1f}")
    spread = sql_one_decimal("max_value - min_value")
    audience = sql_literal(V.RELEVANT_STRENGTH.format(""))
    period = sql_literal(V.TIME_BOUND_STRENGTH.format(""))
    return sql_texts_where(
        ("is_specific", said(V.SPECIFIC_STRENGTH)),
        ("is_measurable", said(V.MEASURABLE_STRENGTH)),
        ("is_achievable", f"concat({sql_literal(before)}, {spread}, {sql_literal(after)})"),
        ("has_audience", f"concat({audience}, {sql_text('intended_audience')})"),
        ("has_period", f"concat({period}, {sql_text('time_period')})"),
    )


def sql_smart_issues() -> str:
    return sql_texts_where(
        ("NOT is_specific", said(V.SPECIFIC_ISSUE)),
        ("NOT is_measurable", said(V.MEASURABLE_ISSUE)),
        ("NOT is_achievable", said(V.ACHIEVABLE_ISSUE)),
        ("NOT has_audience", said(V.RELEVANT_ISSUE)),
        ("NOT has_period", said(V.TIME_BOUND_ISSUE)),
    )


def _either(fact: str, when_true: str, otherwise: str) -> str:
    return f"if({fact}, {sql_literal(when_true)}, {sql_literal(otherwise)})"


def sql_visual_strengths() -> str:
    return sql_texts_where(
        ("has_ratio", _either("has_trend", V.RATIO_AND_TREND, V.RATIO_ONLY)),
        ("has_units", _either("has_direction", V.UNITS_AND_DIRECTION, V.UNITS_ONLY)),
        (
            "has_comparison",
            _either("has_variation", V.COMPARISON_AND_VARIATION, V.COMPARISON_ONLY),
        ),
        ("has_segments", said(V.SEGMENTS_READY)),
        ("is_owned", _either("has_direction", V.NARRATIVE_DIRECTED, V.NARRATIVE_OWNED)),
    )


def sql_visual_issues() -> str:
    return sql_texts_where(
        ("NOT has_ratio", _either("has_trend", V.TREND_ONLY, V.NO_RATIO_NO_TREND)),
        ("NOT has_units", said(V.UNITS_UNCLEAR)),
        ("NOT has_comparison", _either("has_variation", V.VARIATION_ONLY, V.NO_COMPARISON)),
        ("NOT has_segments", said(V.SEGMENTS_MISSING)),
        ("NOT is_owned", said(V.NARRATIVE_MISSING)),
    )


def sql_design_recommendations() -> str:
    return sql_texts_where(
        ("NOT names_segment", said(V.ADVISE_SEGMENTS)),
        ("NOT names_goal", said(V.ADVISE_GOAL)),
        ("has_trend", said(V.ADVISE_TREND)),
        ("NOT has_comparison", said(V.ADVISE_COMPARISON)),
        ("NOT has_direction", said(V.ADVISE_DIRECTION)),
        ("NOT has_ratio AND NOT has_trend", said(V.ADVISE_RATIO)),
    )


def design_step(skipped: bool = False) -> Column:
    """The full step as one nested column; a skipped one has the same type, without details."""
    details = sql_struct(
        smart_framework=sql_struct(
            score=SQL_SMART_SCORE,
            criteria=sql_struct(**SMART),
            strengths=sql_smart_strengths(),
            issues=sql_smart_issues(),
        ),
        tufte_principles=sql_struct(
            score=SQL_VISUAL_SCORE,
            percentage=SQL_VISUAL_PERCENT,
            criteria=sql_struct(**VISUAL),
            strengths=sql_visual_strengths(),
            issues=sql_visual_issues(),
            reference=sql_literal(V.VISUAL_SOURCE),
        ),
        actionability=SQL_ACTIONABILITY,
        recommendations=sql_design_recommendations(),
        note=sql_literal(V.DESIGN_NOTE),
    )
    return F.expr(
        sql_struct(
            status="design_status",
            notes="design_notes",
            details=f"if(true, NULL, {details})" if skipped else details,
        )
    )
