"""Steps 9 and 10, branch by branch."""

import pytest

from plumbline import fixed_values as V
from plumbline.operators import design as D
from plumbline.operators import standards as N
from plumbline.operators.series import registry_left_series
from plumbline.plans import report as R


def designed(registry_rows, table):
    return D.with_design(registry_left_series(registry_rows, table))


def test_definition_length_and_unassessed_range(registry, series):
    rows = registry({"definition": "x" * 50}, {"definition": "x" * 51})
    got = designed(rows, series([1, 2], [10, 10, 10])).orderBy("kpi_id").selectExpr(
        "is_specific", "is_achievable", f"{D.SQL_SMART_SCORE} AS score",
        f"{D.sql_smart_strengths()} AS strengths", f"{D.sql_smart_issues()} AS issues",
    ).collect()
    assert [r.is_specific for r in got] == [False, True]
    assert [r.is_achievable for r in got] == [None, True]
    assert [r.score for r in got] == ["3/4", "5/5"]
    assert got[0].issues == [V.SPECIFIC_ISSUE]
    assert V.ACHIEVABLE_STRENGTH.format(0.0) in got[1].strengths
    assert "Clear audience defined: Board of Trustees" in got[1].strengths


@pytest.mark.parametrize(
    "change, values, strength, issue",
    [
        ({"formula": "a / b"}, [1, 1, 1], V.RATIO_AND_TREND, None),
        ({"formula": "a ÷ b"}, [1], V.RATIO_ONLY, None),
        ({"formula": "a = b"}, [1, 1, 1], None, V.TREND_ONLY),
        ({"formula": "sum"}, [1], None, V.NO_RATIO_NO_TREND),
        ({"definition": "RATE, higher is better"}, [1], V.UNITS_AND_DIRECTION, None),
        ({"definition": "corporate"}, [1], V.UNITS_ONLY, None),
        ({"definition": "a count"}, [1], None, V.UNITS_UNCLEAR),
        ({"definition": "our Goal"}, [1, 2, 3], V.COMPARISON_AND_VARIATION, None),
        ({"definition": "compared to others"}, [1, 1, 1], V.COMPARISON_ONLY, None),
        ({"definition": "nothing"}, [1, 2, 3], None, V.VARIATION_ONLY),
        ({"definition": "nothing"}, [1, 2], None, V.NO_COMPARISON),
        ({"bias_or_equity_risks": "by Gender"}, [1], V.SEGMENTS_READY, None),
        ({"bias_or_equity_risks": ""}, [1], None, V.SEGMENTS_MISSING),
        ({"definition": "reduce it"}, [1], V.NARRATIVE_DIRECTED, None),
        ({"definition": "it"}, [1], V.NARRATIVE_OWNED, None),
        ({"data_owner": "", "definition": "reduce it"}, [1], None, V.NARRATIVE_MISSING),
    ],
)
def test_visual_texts(registry, series, change, values, strength, issue):
    row = designed(registry(change), series(values)).selectExpr(
        f"{D.sql_visual_strengths()} AS strengths", f"{D.sql_visual_issues()} AS issues"
    ).first()
    if strength:
        assert strength in row.strengths
    if issue:
        assert issue in row.issues
    assert len(row.strengths) + len(row.issues) == 5


def test_spaces_count_as_content_here(registry, series):
    """Steps 9 and 10 look at plain emptiness, unlike the governance step."""
    row = N.with_standards(
        designed(registry({"data_owner": "  ", "data_steward": "x"}), series([1]))
    ).selectExpr("is_owned", "data_governance").first()
    assert row.is_owned and row.data_governance


def test_recommendations(registry, series):
    rows = registry(
        {"bias_or_equity_risks": "race", "definition": "x", "formula": "sum"},
        {"definition": "maintain the target", "bias_or_equity_risks": "Segment"},
    )
    got = designed(rows, series([1], [1, 1, 1])).orderBy("kpi_id").selectExpr(
        f"{D.sql_design_recommendations()} AS advice"
    ).collect()
    assert got[0].advice == [
        V.ADVISE_SEGMENTS, V.ADVISE_GOAL, V.ADVISE_COMPARISON, V.ADVISE_DIRECTION, V.ADVISE_RATIO,
    ]
    assert got[1].advice == [V.ADVISE_TREND]


def test_four_statuses(registry, series):
    strong = {"definition": "Percentage that should improve against the target of the peer group"}
    weak_visual = {"definition": "x" * 60, "bias_or_equity_risks": "", "formula": "a = b"}
    weak_design = {"definition": "rate to reach the goal", "time_period": ""}
    weak = {"definition": "x", "formula": "x", "intended_audience": "", "time_period": ""}
    rows = designed(
        registry(strong, weak_visual, weak_design, weak), series([9, 9, 9], [9, 9, 9], [9, 90, 9])
    ).orderBy("kpi_id").collect()
    assert [r.design_status for r in rows] == [
        V.DESIGN_STRONG[0],
        V.DESIGN_NEEDS_VISUALS[0],
        V.DESIGN_NEEDS_REFINEMENT[0],
        V.DESIGN_WEAK[0],
    ]


def test_alignment_levels(registry, series):
    context = {"definition": RICH}
    rows = registry(
        context,
        {**context, "known_limitations": ""},
        {**context, "known_limitations": "", "bias_or_equity_risks": ""},
        {**context, "known_limitations": "", "bias_or_equity_risks": "", "data_steward": None},
    )
    scored = N.with_standards(registry_left_series(rows, series(*[[1, 1, 1]] * 4)))
    got = scored.orderBy("kpi_id").collect()
    assert [r.standards_met for r in got] == [9, 8, 7, 6]
    assert [r.standards_status for r in got] == [
        "Strong Alignment", "Strong Alignment", "Partial Alignment", "Needs Enhancement",
    ]
    assert got[2].standards_notes == "Meets most industry standards (7/9 met, 78%)"
    assert got[3].standards_notes == "Significant gaps in industry alignment (6/9 met, 67%)"
    long = N.standards_scores(scored).where("kpi_id = 4").collect()
    assert {(r.organization, r.met, r.total, r.percentage) for r in long} == {
        ("EDUCAUSE", 0, 3, 0), ("AGB", 3, 3, 100), ("NACUBO", 3, 3, 100), ("OVERALL", 6, 9, 67),
    }


RICH = "Full-time completion held against a peer benchmark"


def test_source_test_is_case_sensitive(registry, series):
    rows = registry(
        {"primary_source_system": "ipeds", "definition": "x"},
        {"primary_source_system": "My IPEDS feed", "definition": "x"},
        {"primary_source_system": "SIS", "definition": "as in Ipeds"},
    )
    got = N.with_standards(registry_left_series(rows, series([1]))).orderBy("kpi_id").collect()
    assert [r.standard_definitions for r in got] == [False, True, True]


def test_invariants_over_a_batch(registry, series):
    rows = registry({}, {"definition": "x"}, {"data_owner": " "}, {"formula": ""})
    assessed = R.assess(rows, series([1, 2, 3], [5, 5, 5]))
    flat = R.readiness_report(assessed).collect()
    assert len(flat) == 4
    for row in flat:
        assert (row.readiness_status == "Ready for Dashboard Use") == (row.blockers == "")
    counts = R.batch_counts(assessed).first()
    assert (counts.total, counts.ready + counts.blocked) == (4, 4)
    assert R.report_long(assessed).count() == 40
    listing = R.batch_listing(assessed).collect()
    assert sum(r.section == "Ready" for r in listing) == counts.ready
    for row in R.criterion_prevalence(assessed).collect():
        assert row.met + row.missed + row.not_assessed == 4
