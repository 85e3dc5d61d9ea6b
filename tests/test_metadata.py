"""Steps 1, 2, 3, 5, 6 and 7, branch by branch."""

from plumbline import fixed_values as V
from plumbline.functions.text import sql_blank, sql_list_cell
from plumbline.operators import metadata as M
from plumbline.plans import report as R


def details(registry_rows, step):
    rows = M.with_findings(registry_rows).select("kpi_id", step.alias("s")).orderBy("kpi_id")
    return [row.s for row in rows.collect()]


def test_blank_knows_all_white_space(spark):
    texts = [None, "", "  ", "\t\n", "  ", "\x1c", "x", " x "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.b for r in df.selectExpr("i", f"{sql_blank('t')} AS b").orderBy("i").collect()]
    assert got == [True, True, True, True, True, True, False, False]


def test_list_cell(spark):
    cells = [None, "", " , ,", "a", " a ,b ", "a,,b", ",a,", "first one, second"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.v for r in df.selectExpr("i", f"{sql_list_cell('c')} AS v").orderBy("i").collect()]
    expected = [[x.strip() for x in (c or "").split(",") if x.strip()] for c in cells]
    assert got == expected


def test_register(registry):
    rows = registry(
        {},
        {"secondary_source_systems": []},
        {"formula": " \t", "data_owner": ""},
        {"data_steward": None, "human_signoff_required": None},
    )
    found = [step.details.missing_fields for step in details(rows, M.register_step())]
    assert found == [[], ["secondary_source_systems"], ["formula", "data_owner"], []]
    status = [step.status for step in details(rows, M.register_step())]
    assert status == ["Pass", "Needs Attention", "Needs Attention", "Pass"]


def test_definition(registry):
    rows = registry(
        {"definition": "x" * 20},
        {"definition": "  " + "x" * 19 + "  "},
        {"formula": "a ÷ b"},
        {"formula": "a = b"},
        {"formula": "a per b", "time_period": "\n"},
        {"definition": None, "formula": None, "time_period": None},
    )
    steps = details(rows, M.definition_step())
    assert [step.details.issues for step in steps] == [
        [],
        [V.DEFINITION_SHORT],
        [],
        [],
        [V.FORMULA_NO_OPERATOR, V.TIME_PERIOD_MISSING],
        [V.DEFINITION_SHORT, V.FORMULA_NO_OPERATOR, V.TIME_PERIOD_MISSING],
    ]
    assert steps[0].details.follow_up_prompts == []
    assert steps[1].details.follow_up_prompts == V.FOLLOW_UP_PROMPTS
    assert [step.status for step in steps[:2]] == ["Clear", "Ambiguous"]


def test_entity(registry):
    rows = registry(
        {"source_systems_in_join": []},
        {"source_systems_in_join": ["A"], "identifier_fields": []},
        {"source_systems_in_join": ["A", "B"]},
        {"source_systems_in_join": ["A", "B"], "identifier_fields": []},
        {"source_systems_in_join": ["A", "A"]},
        {"source_systems_in_join": ["A", "A"], "identifier_fields": []},
    )
    steps = details(rows, M.entity_step())
    assert [step.details.entity_risk_level for step in steps] == [
        "Low", "Low", "Moderate", "High", "High", "High",
    ]
    assert [step.status for step in steps] == ["Pass"] * 3 + ["Fail"] * 3
    assert steps[5].details.issues == [V.JOIN_WITHOUT_IDENTIFIERS, V.JOIN_DUPLICATES]
    assert steps[2].details.recommendation == V.RESOLUTION_YES


def test_ai_use(registry):
    rows = registry(
        {"source_systems_in_join": ["A", "B"], "known_limitations": "SURVEY bias"},
        {"definition": "A Survey of things"},
    )
    steps = details(rows, M.ai_use_step())
    assert steps[0].details.permitted_ai_techniques == [
        V.LINKAGE_TECHNIQUE, V.SCREENING_TECHNIQUE, V.COMMENT_TECHNIQUE,
    ]
    assert steps[1].details.rationale == [V.SCREENING_RATIONALE, V.COMMENT_RATIONALE]
    assert steps[1].details.excluded_ai_techniques == V.EXCLUDED_TECHNIQUES


def test_governance(registry):
    fields = V.GOVERNANCE_TEXT_FIELDS
    rows = registry(
        {},
        *[{field: " "} for field in fields],
        {"human_signoff_required": False},
        {"human_signoff_required": None},
    )
    steps = details(rows, M.governance_step())
    assert [step.details.missing_elements for step in steps] == (
        [[]] + [[field] for field in fields] + [[V.SIGNOFF_MISSING]] * 2
    )
    assert {step.status for step in steps[1:]} == {"Incomplete"}


def test_readiness_collects_blockers_in_order(registry, series):
    rows = registry(
        {},
        {
            "definition": "short",
            "source_systems_in_join": ["A", "A"],
            "data_owner": "",
        },
    )
    core = R.assess_core(rows, series([10, 10, 10], [10, 20]))
    steps = [r.s for r in core.orderBy("kpi_id").select(M.readiness_step().alias("s")).collect()]
    assert steps[0].status == "Ready for Dashboard Use"
    assert steps[0].details.next_actions == V.NEXT_ACTIONS_READY
    assert steps[1].details.blockers == [
        V.BLOCKER_DEFINITION, V.BLOCKER_ENTITY, V.BLOCKER_QUALITY, V.BLOCKER_GOVERNANCE,
    ]
    assert steps[1].details.next_actions == V.NEXT_ACTIONS_BLOCKED
