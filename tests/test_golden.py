"""The worked example: one retention KPI with six points."""

import pytest

from plumbline import fixed_values as V
from plumbline.operators import series as S
from plumbline.plans import report as R


@pytest.fixture
def assessed(registry, retention_series):
    return R.assess(registry({}), retention_series)


def test_statuses(assessed):
    row = R.readiness_report(assessed).first()
    assert row.register_status == "Pass" and row.missing_fields == ""
    assert row.definition_status == "Clear"
    assert row.entity_risk_level == "Low" and row.entity_status == "Pass"
    assert row.quality_status == "Pass" and row.anomaly_count == 0
    assert row.governance_status == "Complete"
    assert row.readiness_status == "Ready for Dashboard Use" and row.blockers == ""
    assert row.permitted_ai == V.SCREENING_TECHNIQUE  # no survey in its texts
    assert row.mean == 89.25


def test_scores(assessed):
    row = R.report_json(assessed).selectExpr(
        "steps.step_9_design_quality.details.smart_framework.score AS smart",
        "steps.step_9_design_quality.details.tufte_principles.score AS visual",
        "steps.step_9_design_quality.details.tufte_principles.percentage AS percent",
        "steps.step_10_best_practices.details.overall.total_score AS standards",
        "steps.step_10_best_practices.status AS alignment",
        "steps.step_10_best_practices.notes AS alignment_notes",
        "steps.step_10_best_practices.details.recommendations AS gaps",
        "steps.step_9_design_quality.notes AS notes",
    ).first()
    assert (row.smart, row.visual, row.percent) == ("5/5", "4/5", "80%")
    assert row.standards == "8/9" and row.alignment == "Strong Alignment"
    assert row.alignment_notes == "Exceeds industry standards (8/9 met, 89%)"
    assert row.gaps == ["AGB: Includes target or peer comparison for context"]
    assert row.notes == "SMART: 5/5, Tufte: 4/5 (80%). Dashboard-ready."


def test_statistics(retention_series):
    row = S.series_spread(retention_series).first()
    stats = S.series_stats(retention_series).first()
    assert stats.mean == 89.25
    assert stats.stdev == pytest.approx(0.9464847243, abs=1e-9)
    assert row.variation == pytest.approx(0.0106, abs=1e-4)
    assert row.has_variation and row.stable_range
    z = S.screen_points(retention_series).agg({"z": "max"}).first()[0]
    assert z == pytest.approx(1.849, abs=1e-3)


def test_skipped_steps_never_affect_readiness(registry, retention_series):
    assessed = R.assess(
        registry({}), retention_series, include_design=False, include_standards=False
    )
    row = R.readiness_report(assessed).first()
    assert row.readiness_status == "Ready for Dashboard Use"
    assert (row.design_status, row.design_notes) == V.DESIGN_SKIPPED
    assert (row.standards_status, row.standards_notes) == V.STANDARDS_SKIPPED
    steps = R.report_json(assessed).select("steps.*").first()
    assert steps.step_9_design_quality.details is None
    assert steps.step_10_best_practices.details is None


def test_thresholds_reach_the_report(registry, retention_series):
    assessed = R.assess(registry({}), retention_series, step_threshold=0.01, z_threshold=1.5)
    reports = R.report_json(assessed)
    step = reports.select("steps.step_4_quality.*").first()
    assert step.status == "Needs Human Review"
    assert step.details.anomaly_count == 4  # three changes of more than 1 %, one z of 1.849
    assert step.details.rule_notes.outlier_rule == "z score at or above 1.5"
    assert step.details.rule_notes.step_change_rule == (
        "absolute percent change at or above 1 percent"
    )
