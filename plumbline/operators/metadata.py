"""Rules over the registry alone (steps 1, 2, 3, 5, 6) and the publish decision (step 7).

Every rule is an expression over the registry's own columns, so all steps of a report are
projections over one scan.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.functions.text import (
    SQL_EMPTY_LIST,
    said,
    sql_blank,
    sql_contains_any,
    sql_list,
    sql_literal,
    sql_mentions,
    sql_strip,
    sql_struct,
    sql_text,
    sql_texts,
    sql_texts_where,
)

_SYSTEMS = sql_list("source_systems_in_join")


def sql_shows_operator(operators: list[str]) -> str:
    return sql_contains_any(sql_text("formula"), operators)


def _missing_fields() -> str:
    """Registered fields that are empty. NULL texts are not counted, nor is the sign-off."""
    return sql_texts_where(
        *[
            (
                f"size({sql_list(field)}) = 0"
                if field in V.LIST_FIELDS
                else f"{field} IS NOT NULL AND {sql_blank(field)}",
                said(field),
            )
            for field in V.REGISTER_FIELDS
        ]
    )


def _definition_issues() -> str:
    short = f"length({sql_strip(sql_text('definition'))}) < {V.MIN_DEFINITION_LENGTH}"
    return sql_texts_where(
        (short, said(V.DEFINITION_SHORT)),
        (f"NOT {sql_shows_operator(V.FORMULA_OPERATORS)}", said(V.FORMULA_NO_OPERATOR)),
        (sql_blank("time_period"), said(V.TIME_PERIOD_MISSING)),
    )


def _entity_issues() -> str:
    return sql_texts_where(
        (
            f"joins_required AND size({sql_list('identifier_fields')}) = 0",
            said(V.JOIN_WITHOUT_IDENTIFIERS),
        ),
        (
            f"joins_required AND size(array_distinct({_SYSTEMS})) <> size({_SYSTEMS})",
            said(V.JOIN_DUPLICATES),
        ),
    )


def _missing_elements() -> str:
    return sql_texts_where(
        *[(sql_blank(field), said(field)) for field in V.GOVERNANCE_TEXT_FIELDS],
        ("NOT (human_signoff_required <=> true)", said(V.SIGNOFF_MISSING)),
    )


def with_findings(registry: DataFrame) -> DataFrame:
    """Add what the steps are decided on, each worked out once. Later ones use earlier ones."""
    comments = sql_mentions(
        f"concat_ws(' ', {sql_text('definition')}, {sql_text('known_limitations')})",
        V.SURVEY_TERMS,
    )
    risk = (
        "CASE WHEN NOT joins_required THEN 'Low'"
        " WHEN size(entity_issues) = 0 THEN 'Moderate' ELSE 'High' END"
    )
    return registry.selectExpr(
        "*",
        f"{_missing_fields()} AS missing_fields",
        f"{_definition_issues()} AS definition_issues",
        f"size({_SYSTEMS}) > 1 AS joins_required",
        f"{comments} AS has_survey_comments",
        f"{_missing_elements()} AS missing_elements",
        f"{_entity_issues()} AS entity_issues",
        f"{risk} AS entity_risk_level",
    )


# Per step: the condition on the findings, and status and notes when it holds and when not.
OUTCOMES = {
    "register": ("size(missing_fields) = 0", V.REGISTER_PASS, V.REGISTER_GAP),
    "definition": ("size(definition_issues) = 0", V.DEFINITION_CLEAR, V.DEFINITION_AMBIGUOUS),
    "entity": ("entity_risk_level <> 'High'", V.ENTITY_PASS, V.ENTITY_FAIL),
    "ai": ("true", V.AI_USE, V.AI_USE),
    "governance": (
        "size(missing_elements) = 0",
        V.GOVERNANCE_COMPLETE,
        V.GOVERNANCE_INCOMPLETE,
    ),
    "readiness": ("size(blockers) = 0", V.READY, V.NOT_READY),
}
_STEP_OF_BLOCKER = [
    ("definition", V.BLOCKER_DEFINITION),
    ("entity", V.BLOCKER_ENTITY),
    ("quality", V.BLOCKER_QUALITY),
    ("governance", V.BLOCKER_GOVERNANCE),
]


def _outcome(step: str, position: int) -> str:
    good, when_good, otherwise = OUTCOMES[step]
    return (
        f"if({good}, {sql_literal(when_good[position])}, {sql_literal(otherwise[position])})"
    )


def with_decision(findings: DataFrame) -> DataFrame:
    """Add status and notes of every step, the blockers and the publish decision.

    Needs the findings, ``quality_status`` and ``anomaly_count``.
    """
    blocked_by = {
        step: f"NOT ({OUTCOMES[step][0]})" if step in OUTCOMES else "anomaly_count > 0"
        for step, _ in _STEP_OF_BLOCKER
    }
    blockers = sql_texts_where(
        *[(blocked_by[step], said(text)) for step, text in _STEP_OF_BLOCKER]
    )
    outcomes = [
        f"{_outcome(step, position)} AS {step}_{name}"
        for step in OUTCOMES
        for position, name in enumerate(("status", "notes"))
    ]
    return findings.selectExpr("*", f"{blockers} AS blockers", *outcomes)


SQL_PERMITTED = sql_texts_where(
    ("joins_required", said(V.LINKAGE_TECHNIQUE)),
    ("true", said(V.SCREENING_TECHNIQUE)),
    ("has_survey_comments", said(V.COMMENT_TECHNIQUE)),
)
SQL_EXCLUDED = sql_texts(V.EXCLUDED_TECHNIQUES)


def _step(step: str, **details: str) -> Column:
    """A check result: status and notes, plus typed details."""
    return F.expr(
        sql_struct(
            status=_outcome(step, 0), notes=_outcome(step, 1), details=sql_struct(**details)
        )
    )


def register_step() -> Column:
    return _step("register", missing_fields="missing_fields")


def definition_step() -> Column:
    clear = OUTCOMES["definition"][0]
    return _step(
        "definition",
        issues="definition_issues",
        follow_up_prompts=f"if({clear}, {SQL_EMPTY_LIST}, {sql_texts(V.FOLLOW_UP_PROMPTS)})",
    )


def entity_step() -> Column:
    recommendation = (
        f"if(joins_required, {sql_literal(V.RESOLUTION_YES)}, {sql_literal(V.RESOLUTION_NO)})"
    )
    return _step(
        "entity",
        joins_required="joins_required",
        entity_risk_level="entity_risk_level",
        identifier_fields=sql_list("identifier_fields"),
        recommendation=recommendation,
        issues="entity_issues",
    )


def ai_use_step() -> Column:
    return _step(
        "ai",
        permitted_ai_techniques=SQL_PERMITTED,
        excluded_ai_techniques=SQL_EXCLUDED,
        rationale=sql_texts_where(
            ("joins_required", said(V.LINKAGE_RATIONALE)),
            ("true", said(V.SCREENING_RATIONALE)),
            ("has_survey_comments", said(V.COMMENT_RATIONALE)),
        ),
    )


def governance_step() -> Column:
    return _step(
        "governance", missing_elements="missing_elements", guardrails=sql_texts(V.GUARDRAILS)
    )


def readiness_step() -> Column:
    """The publish decision as a step, from ``blockers``."""
    return _step(
        "readiness",
        blockers="blockers",
        next_actions=(
            f"if(size(blockers) = 0, {sql_texts(V.NEXT_ACTIONS_READY)},"
            f" {sql_texts(V.NEXT_ACTIONS_BLOCKED)})"
        ),
        note=sql_literal(V.READINESS_NOTE),
    )
