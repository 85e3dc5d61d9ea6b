"""The results of every query as plain SQL over the supplied tables.

Written separately from the operators, so that the two check each other; only fixed texts and
prompt wording are shared.
"""

from plumbline import fixed_values as V
from plumbline.operators import prompts as P


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _join_where(*rules: tuple[str, str], separator: str = "; ") -> str:
    cases = ", ".join(f"CASE WHEN {condition} THEN {text} END" for condition, text in rules)
    return f"concat_ws({q(separator)}, {cases})"


def _has(expression: str, terms: list[str]) -> str:
    tests = " OR ".join(f"contains(lower({expression}), {q(term)})" for term in terms)
    return f"({tests})"


# --- bindings -----------------------------------------------------------------------------


def _registry(table: str, key: str, name: str) -> str:
    return f"""reg AS (
  SELECT {key} AS kpi_id, {name} AS name,
    CASE {key} % 5
      WHEN 0 THEN 'Percentage of ordered units shipped in the year, held against a peer benchmark and target'
      WHEN 1 THEN 'Total count of shipped units'
      WHEN 2 THEN 'Units'
      WHEN 3 THEN 'Survey rate of suppliers who improve; higher is better than the prior goal level'
      ELSE 'First-time full-time supplier units shipped during the calendar year' END AS definition,
    CASE {key} % 4 WHEN 3 THEN 'sum of quantity' WHEN 2 THEN 'total = sum(quantity)'
      ELSE 'shipped / ordered' END AS formula,
    CASE WHEN {key} % 11 = 0 THEN '' ELSE 'Calendar year' END AS time_period,
    CASE WHEN {key} % 2 = 0 THEN 'IPEDS' ELSE 'SIS' END AS source,
    CASE WHEN {key} % 3 = 0 THEN [] ELSE ['SIS', 'ERP'] END::VARCHAR[] AS secondary,
    CASE {key} % 4 WHEN 0 THEN 'Board of Trustees' WHEN 1 THEN 'Executive Cabinet'
      WHEN 2 THEN 'Analysts' ELSE '' END AS audience,
    CASE WHEN {key} % 7 = 0 THEN [] ELSE ['supp_id'] END::VARCHAR[] AS identifiers,
    CASE {key} % 6 WHEN 0 THEN ['IPEDS', 'SIS'] WHEN 1 THEN ['SIS', 'SIS'] ELSE ['IPEDS'] END AS systems,
    CASE WHEN {key} % 17 = 0 THEN '  ' ELSE 'Registrar' END AS data_owner,
    CASE WHEN {key} % 13 <> 0 THEN 'Institutional Research' END AS data_steward,
    CASE WHEN {key} % 8 = 0 THEN 'Survey response bias' ELSE 'Partial final year' END AS limitations,
    CASE {key} % 5 WHEN 1 THEN 'none noted' WHEN 4 THEN '' ELSE 'Varies by demographic segment' END AS risks,
    {key} % 19 <> 0 AS signoff
  FROM {table})"""


REG = _registry("supplier", "s_suppkey", "s_name")
CUSTOMER_REG = _registry("customer", "c_custkey", "c_name")


def _total(column: str) -> str:
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


def _supplier_year(name: str = "s") -> str:
    return f"""{name} AS (
  SELECT l_suppkey AS kpi_id, CAST(year(l_shipdate) - 1994 AS BIGINT) AS ord,
    CAST(year(l_shipdate) AS VARCHAR) AS period, {_total('l_quantity')} AS value
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate))"""


def _quarter(key: str, name: str = "s") -> str:
    return f"""{name} AS (
  SELECT {key} AS kpi_id, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS BIGINT) AS ord,
    CAST(year(l_shipdate) AS VARCHAR) || ' Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS period,
    {_total('l_quantity')} AS value
  FROM lineitem GROUP BY {key}, year(l_shipdate), quarter(l_shipdate))"""


MESSY = (
    _quarter("l_suppkey", "clean")
    + """,
s AS (
  SELECT kpi_id, ord, period,
    CASE WHEN (kpi_id + ord) % 41 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value_raw,
    CASE WHEN (kpi_id + ord) % 41 <> 0 THEN value END AS value
  FROM clean)"""
)


def _user_day(name: str = "s") -> str:
    return f"""{name} AS (
  SELECT user_id AS kpi_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS ord,
    CAST(CAST(ts AS DATE) AS VARCHAR) AS period, {_total('value')} AS value
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""


def _customer_year(name: str) -> str:
    return f"""{name} AS (
  SELECT o_custkey AS kpi_id, CAST(year(o_orderdate) AS BIGINT) AS ord,
    CAST(year(o_orderdate) AS VARCHAR) AS period, {_total('o_totalprice')} AS value
  FROM orders GROUP BY o_custkey, year(o_orderdate))"""


PANEL = f"""panel AS (
  SELECT CAST(c_nationkey AS BIGINT) AS kpi_id, CAST(year(o_orderdate) AS BIGINT) AS y,
    {_total('o_totalprice')} AS value
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY c_nationkey, year(o_orderdate))"""

# --- screening ----------------------------------------------------------------------------

SCREEN = f"""num AS (
  SELECT kpi_id, ord, period, value,
    count(*) OVER k AS n, avg(value) OVER k AS m, stddev_pop(value) OVER k AS sd,
    lag(value) OVER o AS from_value, lag(period) OVER o AS from_period
  FROM s WHERE value IS NOT NULL
  WINDOW k AS (PARTITION BY kpi_id), o AS (PARTITION BY kpi_id ORDER BY ord)),
measured AS (
  SELECT *, CASE WHEN n >= 3 AND sd > 0 THEN abs((value - m) / sd) END AS z,
    CASE WHEN from_value <> 0 THEN (value - from_value) / from_value END AS change
  FROM num),
scr AS (
  SELECT *, coalesce(z >= {V.Z_SCORE_THRESHOLD} AND NOT isnan(z), false) AS is_outlier,
    coalesce(abs(change) >= {V.STEP_CHANGE_THRESHOLD} AND NOT isnan(change), false) AS is_step
  FROM measured)"""

ROLLUP = """roll AS (
  SELECT kpi_id, count(*) AS n_points, count(value) AS n_numeric, avg(value) AS mean,
    stddev_pop(value) AS stdev, min(value) AS lo, max(value) AS hi,
    arg_max(value, CASE WHEN value IS NOT NULL THEN ord END) AS latest,
    count(*) FILTER (value IS NULL) AS non_numeric
  FROM s GROUP BY kpi_id),
flags AS (
  SELECT kpi_id, count(*) FILTER (is_outlier) AS outliers, count(*) FILTER (is_step) AS steps
  FROM scr GROUP BY kpi_id),
fact AS (
  SELECT reg.*, coalesce(roll.n_points, 0) AS n, roll.n_numeric, roll.mean, roll.stdev, roll.lo,
    roll.hi, roll.latest, roll.non_numeric, flags.outliers, flags.steps,
    coalesce(roll.non_numeric, 0) + coalesce(flags.outliers, 0) + coalesce(flags.steps, 0)
      AS anomaly_count
  FROM reg LEFT JOIN roll USING (kpi_id) LEFT JOIN flags USING (kpi_id))"""

FOUND = _join_where(
    ("length(trim(definition)) < 20", q(V.DEFINITION_SHORT)),
    ("NOT regexp_matches(formula, '[/÷=]')", q(V.FORMULA_NO_OPERATOR)),
    ("regexp_matches(time_period, '^\\s*$')", q(V.TIME_PERIOD_MISSING)),
)
ENTITY_ISSUES = _join_where(
    ("len(systems) > 1 AND len(identifiers) = 0", q(V.JOIN_WITHOUT_IDENTIFIERS)),
    ("len(systems) > 1 AND len(list_distinct(systems)) <> len(systems)", q(V.JOIN_DUPLICATES)),
)
MISSING_FIELDS = _join_where(
    ("trim(definition) = ''", q("definition")),
    ("trim(formula) = ''", q("formula")),
    ("trim(time_period) = ''", q("time_period")),
    ("len(secondary) = 0", q("secondary_source_systems")),
    ("trim(audience) = ''", q("intended_audience")),
    ("len(identifiers) = 0", q("identifier_fields")),
    ("len(systems) = 0", q("source_systems_in_join")),
    ("trim(data_owner) = ''", q("data_owner")),
    ("trim(data_steward) = ''", q("data_steward")),
    ("trim(limitations) = ''", q("known_limitations")),
    ("trim(risks) = ''", q("bias_or_equity_risks")),
)
MISSING_ELEMENTS = _join_where(
    ("trim(coalesce(data_owner, '')) = ''", q("data_owner")),
    ("trim(coalesce(data_steward, '')) = ''", q("data_steward")),
    ("trim(coalesce(limitations, '')) = ''", q("known_limitations")),
    ("trim(coalesce(risks, '')) = ''", q("bias_or_equity_risks")),
    ("signoff IS NOT TRUE", q(V.SIGNOFF_MISSING)),
)
RISK = f"CASE WHEN len(systems) <= 1 THEN 'Low' WHEN {ENTITY_ISSUES} = '' THEN 'Moderate' ELSE 'High' END"
SURVEY = _has("definition || ' ' || limitations", V.SURVEY_TERMS)
PERMITTED = _join_where(
    ("len(systems) > 1", q(V.LINKAGE_TECHNIQUE)),
    ("true", q(V.SCREENING_TECHNIQUE)),
    (SURVEY, q(V.COMMENT_TECHNIQUE)),
)

FINDINGS = f"""found AS (
  SELECT *, {MISSING_FIELDS} AS missing_fields, {FOUND} AS definition_issues,
    {ENTITY_ISSUES} AS entity_issues, {RISK} AS entity_risk_level,
    {MISSING_ELEMENTS} AS missing_elements, {PERMITTED} AS permitted
  FROM fact)"""

DECIDED = f"""decided AS (
  SELECT *,
    CASE WHEN anomaly_count = 0 THEN 'Pass' ELSE 'Needs Human Review' END AS quality_status,
    CASE WHEN anomaly_count = 0 THEN 'No' ELSE 'Yes' END AS anomalies_detected,
    CASE WHEN definition_issues = '' THEN 'Clear' ELSE 'Ambiguous' END AS definition_status,
    CASE WHEN entity_risk_level = 'High' THEN 'Fail' ELSE 'Pass' END AS entity_status,
    CASE WHEN missing_elements = '' THEN 'Complete' ELSE 'Incomplete' END AS governance_status,
    {_join_where(
        ("definition_issues <> ''", q(V.BLOCKER_DEFINITION)),
        ("entity_risk_level = 'High'", q(V.BLOCKER_ENTITY)),
        ("anomaly_count > 0", q(V.BLOCKER_QUALITY)),
        ("missing_elements <> ''", q(V.BLOCKER_GOVERNANCE)),
    )} AS blockers
  FROM found),
core AS (
  SELECT *, CASE WHEN blockers = '' THEN 'Ready for Dashboard Use' ELSE 'Not Ready' END
    AS readiness_status
  FROM decided)"""

_CV = "(CASE WHEN mean > 0 THEN stdev / mean ELSE 0 END)"
DESIGN = f"""facts AS (
  SELECT *, length(definition) > 50 AS specific,
    regexp_matches(formula, '[/÷=]') AS measurable,
    CASE WHEN n >= 3 THEN hi - lo < hi * 0.3::DOUBLE END AS achievable,
    audience <> '' AS relevant, time_period <> '' AS time_bound,
    regexp_matches(formula, '[/÷]') AS ratio, n >= 3 AS trend,
    {_has('definition', V.UNIT_TERMS)} AS units,
    {_has('definition', V.DIRECTION_TERMS)} AS direction,
    {_has('definition', V.COMPARISON_TERMS)} AS comparison,
    coalesce(n >= 3 AND {_CV} > 0.01, false) AS variation,
    {_has('risks', V.SEGMENT_TERMS)} AS segments,
    data_owner <> '' AND audience <> '' AS owned
  FROM core),
scored AS (
  SELECT *, specific::INT + measurable::INT + coalesce(achievable::INT, 0) + relevant::INT
      + time_bound::INT AS smart_met,
    CASE WHEN achievable IS NULL THEN 4 ELSE 5 END AS smart_total,
    ratio::INT + units::INT + comparison::INT + segments::INT + owned::INT AS visual_met
  FROM facts),
designed AS (
  SELECT *, smart_met || '/' || smart_total AS smart_score, visual_met || '/5' AS visual_score,
    (visual_met * 20) || '%' AS visual_percent,
    CASE WHEN smart_met >= 4 AND visual_met >= 4 THEN {q(V.DESIGN_STRONG[0])}
      WHEN smart_met >= 4 THEN {q(V.DESIGN_NEEDS_VISUALS[0])}
      WHEN visual_met >= 4 THEN {q(V.DESIGN_NEEDS_REFINEMENT[0])}
      ELSE {q(V.DESIGN_WEAK[0])} END AS design_status,
    'SMART: ' || smart_met || '/' || smart_total || ', Tufte: ' || visual_met || '/5 ('
      || (visual_met * 20) || '%). ' || CASE
      WHEN smart_met >= 4 AND visual_met >= 4 THEN {q(V.DESIGN_STRONG[1])}
      WHEN smart_met >= 4 THEN {q(V.DESIGN_NEEDS_VISUALS[1])}
      WHEN visual_met >= 4 THEN {q(V.DESIGN_NEEDS_REFINEMENT[1])}
      ELSE {q(V.DESIGN_WEAK[1])} END AS design_notes
  FROM scored)"""

CHECKS = [check for _, check, _, _ in V.STANDARDS]
STANDARDS = f"""checked AS (
  SELECT *, data_owner <> '' AND coalesce(data_steward, '') <> '' AS data_governance,
    risks <> '' AS equity_consideration, limitations <> '' AS limitations_documented,
    {_has('audience', V.BOARD_TERMS)} AS board_appropriate, n >= 3 AS multi_year_trend,
    {_has('definition', V.CONTEXT_TERMS)} AS contextualized,
    contains(source, 'IPEDS') OR {_has('definition', V.STANDARD_TERMS)} AS standard_definitions,
    n >= 3 AS multi_year_data, formula <> '' AND source <> '' AS auditable
  FROM designed),
summed AS (
  SELECT *, data_governance::INT + equity_consideration::INT + limitations_documented::INT AS educause,
    board_appropriate::INT + multi_year_trend::INT + contextualized::INT AS agb,
    standard_definitions::INT + multi_year_data::INT + auditable::INT AS nacubo
  FROM checked),
aligned AS (
  SELECT *, educause + agb + nacubo AS met,
    CASE WHEN educause + agb + nacubo >= 8 THEN {q(V.ALIGNMENT_STRONG[0])}
      WHEN educause + agb + nacubo = 7 THEN {q(V.ALIGNMENT_PARTIAL[0])}
      ELSE {q(V.ALIGNMENT_WEAK[0])} END AS standards_status,
    CASE WHEN educause + agb + nacubo >= 8 THEN {q(V.ALIGNMENT_STRONG[1])}
      WHEN educause + agb + nacubo = 7 THEN {q(V.ALIGNMENT_PARTIAL[1])}
      ELSE {q(V.ALIGNMENT_WEAK[1])} END || ' (' || (educause + agb + nacubo) || '/9 met, '
      || CAST(round((educause + agb + nacubo) * 100 / 9.0) AS INT) || '%)' AS standards_notes
  FROM summed)"""

ASSESSED = _with(REG, _supplier_year(), SCREEN, ROLLUP, FINDINGS, DECIDED, DESIGN, STANDARDS)
CORE = _with(REG, _supplier_year(), SCREEN, ROLLUP, FINDINGS, DECIDED)
REGISTRY_ONLY = _with(
    REG, "fact AS (SELECT * FROM reg)", FINDINGS
)

SMART_STRENGTHS = _join_where(
    ("specific", q(V.SPECIFIC_STRENGTH)),
    ("measurable", q(V.MEASURABLE_STRENGTH)),
    (
        "achievable",
        "'Historical data shows stable, realistic range (variance: ' || printf('%.1f', hi - lo) || ')'",
    ),
    ("relevant", "'Clear audience defined: ' || audience"),
    ("time_bound", "'Reporting cycle defined: ' || time_period"),
)
_SMART_ISSUES = [
    ("NOT specific", V.SPECIFIC_ISSUE),
    ("NOT measurable", V.MEASURABLE_ISSUE),
    ("NOT achievable", V.ACHIEVABLE_ISSUE),
    ("NOT relevant", V.RELEVANT_ISSUE),
    ("NOT time_bound", V.TIME_BOUND_ISSUE),
]
_VISUAL_ISSUES = [
    ("NOT ratio AND trend", V.TREND_ONLY),
    ("NOT ratio AND NOT trend", V.NO_RATIO_NO_TREND),
    ("NOT units", V.UNITS_UNCLEAR),
    ("NOT comparison AND variation", V.VARIATION_ONLY),
    ("NOT comparison AND NOT variation", V.NO_COMPARISON),
    ("NOT segments", V.SEGMENTS_MISSING),
    ("NOT owned", V.NARRATIVE_MISSING),
]
_GAPS = [(f"NOT {check}", f"{org}: {standard}") for org, check, standard, _ in V.STANDARDS]
_BLOCKERS = [
    ("definition_issues <> ''", V.BLOCKER_DEFINITION),
    ("entity_risk_level = 'High'", V.BLOCKER_ENTITY),
    ("anomaly_count > 0", V.BLOCKER_QUALITY),
    ("missing_elements <> ''", V.BLOCKER_GOVERNANCE),
]


def _quoted(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(condition, q(text)) for condition, text in rules]


VISUAL_STRENGTHS = _join_where(
    *_quoted(
        [
            ("ratio AND trend", V.RATIO_AND_TREND),
            ("ratio AND NOT trend", V.RATIO_ONLY),
            ("units AND direction", V.UNITS_AND_DIRECTION),
            ("units AND NOT direction", V.UNITS_ONLY),
            ("comparison AND variation", V.COMPARISON_AND_VARIATION),
            ("comparison AND NOT variation", V.COMPARISON_ONLY),
            ("segments", V.SEGMENTS_READY),
            ("owned AND direction", V.NARRATIVE_DIRECTED),
            ("owned AND NOT direction", V.NARRATIVE_OWNED),
        ]
    )
)
RECOMMENDATIONS = _join_where(
    *_quoted(
        [
            (f"NOT {_has('risks', V.SEGMENT_ADVICE_TERMS)}", V.ADVISE_SEGMENTS),
            (f"NOT {_has('definition', V.GOAL_TERMS)}", V.ADVISE_GOAL),
            ("trend", V.ADVISE_TREND),
            ("NOT comparison", V.ADVISE_COMPARISON),
            ("NOT direction", V.ADVISE_DIRECTION),
            ("NOT ratio AND NOT trend", V.ADVISE_RATIO),
        ]
    )
)


def _pick(condition: str, good: tuple, bad: tuple) -> str:
    return (
        f"CASE WHEN {condition} THEN {q(good[0])} ELSE {q(bad[0])} END AS status, "
        f"CASE WHEN {condition} THEN {q(good[1])} ELSE {q(bad[1])} END AS notes"
    )


def _list(items: list[str]) -> str:
    return q("; ".join(items))


# --- report statements --------------------------------------------------------------------

STEP_ROWS = [
    ("step_1_register", "missing_fields = ''", V.REGISTER_PASS, V.REGISTER_GAP),
    ("step_2_definition", "definition_issues = ''", V.DEFINITION_CLEAR, V.DEFINITION_AMBIGUOUS),
    ("step_3_entity", "entity_risk_level <> 'High'", V.ENTITY_PASS, V.ENTITY_FAIL),
    ("step_4_quality", "anomaly_count = 0", V.QUALITY_PASS, V.QUALITY_REVIEW),
    ("step_5_ai", "true", V.AI_USE, V.AI_USE),
    ("step_6_governance", "missing_elements = ''", V.GOVERNANCE_COMPLETE, V.GOVERNANCE_INCOMPLETE),
    ("step_7_readiness", "blockers = ''", V.READY, V.NOT_READY),
    ("step_8_summary", "true", V.SUMMARY_GENERATED, V.SUMMARY_GENERATED),
]


def _report_long() -> str:
    rows = [
        f"SELECT kpi_id, name AS kpi_name, {number} AS step_number, {q(step)} AS step, "
        f"{_pick(good, when_good, otherwise)} FROM aligned"
        for number, (step, good, when_good, otherwise) in enumerate(STEP_ROWS, start=1)
    ]
    rows.append(
        "SELECT kpi_id, name, 9, 'step_9_design_quality', design_status, design_notes FROM aligned"
    )
    rows.append(
        "SELECT kpi_id, name, 10, 'step_10_best_practices', standards_status, standards_notes"
        " FROM aligned"
    )
    return ASSESSED + "\nUNION ALL ".join(rows)


def _blocker_rows(source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT kpi_id, name, {number} AS rank, {q(text)} AS blocker FROM {source} WHERE {condition}"
        for number, (condition, text) in enumerate(_BLOCKERS, start=1)
    )


def _summary_long() -> str:
    head = [
        ("KPI Name", "name"),
        ("Definition", "definition"),
        ("Formula", "formula"),
        ("Time Period", "time_period"),
        ("Primary Source System", "source"),
        (
            "Secondary Source Systems",
            "CASE WHEN len(secondary) = 0 THEN 'None' ELSE array_to_string(secondary, ', ') END",
        ),
        ("Intended Audience", "audience"),
    ]
    results = [
        ("Readiness Status", "readiness_status"),
        ("Definition Status", "definition_status"),
        ("Entity Risk Level", "entity_risk_level"),
        ("Anomalies Detected", "anomalies_detected"),
        ("Governance Status", "governance_status"),
        ("Design Quality", "design_status"),
        ("Industry Standards", "standards_status"),
    ]
    tail = [
        ("Data Owner", "data_owner"),
        ("Data Steward", "coalesce(data_steward, '')"),
        ("Known Limitations", "limitations"),
        ("Bias or Equity Risks", "risks"),
        ("Human Signoff Required", "CASE WHEN signoff THEN 'True' ELSE 'False' END"),
    ]
    rows = []
    for block, section, lines in (
        (1, V.SUMMARY_IDENTITY, head),
        (2, V.SUMMARY_RESULTS, results),
        (4, V.SUMMARY_GOVERNANCE, tail),
    ):
        rows += [
            f"SELECT kpi_id, {block * 100 + i} AS rank, {q(section)} AS section, {q(label)} AS label,"
            f" {value} AS value FROM aligned"
            for i, (label, value) in enumerate(lines)
        ]
    rows.append(
        f"SELECT kpi_id, 300 + rank, {q(V.SUMMARY_BLOCKERS)}, '', blocker"
        f" FROM ({_blocker_rows('aligned')})"
    )
    rows.append(
        f"SELECT kpi_id, 300, {q(V.SUMMARY_BLOCKERS)}, '', {q(V.NO_BLOCKERS)}"
        " FROM aligned WHERE blockers = ''"
    )
    union = "\nUNION ALL ".join(rows)
    return (
        ASSESSED
        + "SELECT kpi_id, CAST(row_number() OVER (PARTITION BY kpi_id ORDER BY rank) AS INT)"
        f" AS line_number, section, label, value FROM ({union})"
    )


def _prevalence() -> str:
    criteria = (
        [
            ("SMART", name, fact)
            for name, fact in zip(
                V.SMART_CRITERIA,
                ["specific", "measurable", "achievable", "relevant", "time_bound"],
            )
        ]
        + [
            ("Visualization", name, fact)
            for name, fact in zip(
                V.VISUAL_CRITERIA, ["ratio", "units", "comparison", "segments", "owned"]
            )
        ]
        + [(org, check, check) for org, check, _, _ in V.STANDARDS]
    )
    rows = [
        f"SELECT {q(framework)} AS framework, {q(name)} AS criterion,"
        f" count(*) FILTER ({fact}) AS met, count(*) FILTER (NOT {fact}) AS missed,"
        f" count(*) FILTER ({fact} IS NULL) AS not_assessed FROM aligned"
        for framework, name, fact in criteria
    ]
    return ASSESSED + "\nUNION ALL ".join(rows)


def _scores() -> str:
    rows = [
        f"SELECT kpi_id, {q(name)} AS organization, {met} AS met, {total} AS total,"
        f" CAST(round({met} * 100 / {total}.0) AS INT) AS percentage FROM aligned"
        for name, met, total in [
            ("EDUCAUSE", "educause", 3),
            ("AGB", "agb", 3),
            ("NACUBO", "nacubo", 3),
            ("OVERALL", "met", 9),
        ]
    ]
    return ASSESSED + "\nUNION ALL ".join(rows)


REPORT_FIELDS = """SELECT kpi_id, name AS kpi_name,
  replace(replace(name, ' ', '_'), '/', '_') || '_report' AS output_name, definition,
  array_to_string(secondary, '; ') AS secondary_sources, data_steward,
  signoff AS human_signoff_required, definition_status, anomaly_count,
  coalesce(n_numeric, 0) AS stats_count, round(mean, 6) AS stats_mean, readiness_status,
  blockers, smart_score, achievable,
  CAST(round(met * 100 / 9.0) AS INT) || '%' AS standards_percent, board_appropriate,
  'z score at or above 2.5' AS outlier_rule,
  'absolute percent change at or above 25 percent' AS step_change_rule,
""" + f"""  {q(V.DESIGN_NOTE)} AS design_note, {q(V.STANDARDS_NOTE)} AS standards_note,
  {q("; ".join(V.ORGANIZATION_LABELS[org] for org in V.ORGANIZATIONS))} AS organizations
FROM aligned"""


def _bracketed(rules: list[tuple[str, str]]) -> str:
    listed = _join_where(*[(c, q(f"'{text}'")) for c, text in rules], separator=", ")
    return f"CASE WHEN {listed} = '' THEN 'None' ELSE '[' || {listed} || ']' END"


def _refinement_prompts() -> str:
    lines = [
        ("Name: ", "name"),
        ("Definition: ", "definition"),
        ("Formula: ", "formula"),
        ("Time Period: ", "time_period"),
        ("Primary Source: ", "source"),
        ("Data Owner: ", "data_owner"),
        ("Data Steward: ", "coalesce(data_steward, '')"),
        ("Known Limitations: ", "limitations"),
        ("Bias/Equity Risks: ", "risks"),
        ("Readiness Status: ", "readiness_status"),
        ("Blockers: ", _bracketed(_BLOCKERS)),
        ("SMART Issues: ", _bracketed(_SMART_ISSUES)),
        ("Tufte Issues: ", _bracketed(_VISUAL_ISSUES)),
        ("Industry Gaps: ", _bracketed(_GAPS)),
    ]
    body = " || chr(10) || ".join(f"{q(label)} || {value}" for label, value in lines)
    return (
        ASSESSED
        + f"SELECT kpi_id, {q(P.REFINEMENT_INTRODUCTION)} || chr(10) || chr(10) || {body}"
        f" || chr(10) || chr(10) || {q(P.REFINEMENT_TASK)} AS prompt FROM aligned"
    )


def _dashboard() -> str:
    values = [value for _, value in V.PLACEHOLDER_SERIES]
    shown = f"""yearly AS (
  SELECT kpi_id, count(*) AS n, arg_max(value, ord) AS last_shown, min(value) AS lo, max(value) AS hi
  FROM s GROUP BY kpi_id),
later AS (
  SELECT kpi_id, count(*) AS n, arg_max(value, ord) AS last_shown, min(value) AS lo, max(value) AS hi
  FROM sq WHERE kpi_id % 8 <> 0 GROUP BY kpi_id),
shown AS (
  SELECT kpi_id, coalesce(a.n, b.n, 0) < 2 AS synthetic,
    CASE WHEN synthetic THEN {len(values)} ELSE coalesce(a.n, b.n) END AS points,
    CASE WHEN synthetic THEN {float(values[-1])} WHEN a.n > 0 THEN a.last_shown ELSE b.last_shown END AS last_shown,
    CASE WHEN synthetic THEN {float(min(values))} WHEN a.n > 0 THEN a.lo ELSE b.lo END AS least,
    CASE WHEN synthetic THEN {float(max(values))} WHEN a.n > 0 THEN a.hi ELSE b.hi END AS most
  FROM reg LEFT JOIN yearly a USING (kpi_id) LEFT JOIN later b USING (kpi_id))"""
    own = _supplier_year("years") + ",\ns AS (SELECT * FROM years WHERE kpi_id % 4 <> 0)"
    prefix = _with(
        REG, own, _quarter("l_suppkey", "sq"), SCREEN, ROLLUP, FINDINGS, DECIDED, DESIGN, STANDARDS, shown
    )
    return prefix + f"""SELECT kpi_id, name AS kpi_name, readiness_status AS readiness,
  CASE WHEN blockers = '' THEN 'green' ELSE 'red' END AS readiness_light,
  smart_score, visual_score, visual_percent, met || '/9' AS standards_score,
  CAST(round(met * 100 / 9.0) AS INT) || '%' AS standards_percent, standards_status,
  CASE WHEN met >= 8 THEN 'green' WHEN met = 7 THEN 'amber' ELSE 'red' END AS standards_light,
  CASE WHEN blockers = '' THEN {q(V.NO_BLOCKERS)} ELSE blockers END AS blockers,
  CAST(points AS BIGINT) AS n_points, anomaly_count, synthetic AS is_synthetic, true AS has_chart,
  printf('%.1f', last_shown) AS latest_value,
  greatest(0, CAST(trunc(least) AS BIGINT) - 5) AS axis_min, CAST(trunc(most) AS BIGINT) + 5 AS axis_max,
  source, data_owner, coalesce(data_steward, 'Not specified') AS data_steward,
  CASE WHEN signoff THEN 'Required' ELSE 'Not set' END AS human_signoff,
  limitations AS known_limitations, risks AS equity_risks
FROM aligned JOIN shown USING (kpi_id)"""


# --- responses and comments ---------------------------------------------------------------

ATTEMPTS = """tries AS (
  SELECT reg.*, attempt,
    NOT (kpi_id % CASE attempt WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 5 END = 0) AS valid
  FROM reg, (VALUES (1), (2), (3)) AS t(attempt))"""

SURVEY_ANSWERS = f"""ans AS (
  SELECT c_custkey AS k, c_name, c_nationkey, c_mktsegment,
    c_custkey % 6 IN (0, 2) AS is_fallback,
    CASE c_custkey % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'mixed'
      WHEN 3 THEN 'puzzled' END AS sentiment
  FROM customer),
cats AS (
  SELECT k, 1 AS pos, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS name,
    CAST(c_nationkey AS BIGINT) AS cnt, sentiment, 'Said by ' || c_name AS theme
  FROM ans WHERE NOT is_fallback
  UNION ALL
  SELECT k, 2, 'Balance', k % 7, 'neutral', 'Account balance' FROM ans WHERE NOT is_fallback
  UNION ALL
  SELECT k, pos, name, cnt, sent, theme FROM ans, (VALUES {", ".join(
      f"({i}, {q(name)}, {count}, {q(sentiment)}, {q(theme)})"
      for i, (name, count, sentiment, theme) in enumerate(V.FALLBACK_CATEGORIES, start=1)
  )}) AS f(pos, name, cnt, sent, theme) WHERE is_fallback)"""


def _category_case(categories: dict[str, list[str]]) -> str:
    cases = " ".join(f"WHEN {_has('text', words)} THEN {q(name)}" for name, words in categories.items())
    return f"CASE {cases} END"


CATEGORY_BINDING = {
    "Licensing": ["license"],
    "Credentials": ["token", "@"],
    "English prose": ["the "],
    "Spanish prose": ["ción", "los "],
    "German prose": ["der "],
}


def _field_review() -> str:
    scalars = [
        ("name", "name"),
        ("definition", "definition"),
        ("formula", "formula"),
        ("time_period", "time_period"),
        ("primary_source_system", "source"),
        ("intended_audience", "audience"),
        ("data_owner", "data_owner"),
        ("data_steward", "coalesce(data_steward, 'NOT FOUND')"),
        ("known_limitations", "limitations"),
        ("bias_or_equity_risks", "risks"),
        ("human_signoff_required", "CASE WHEN signoff THEN 'True' ELSE 'False' END"),
    ]
    lists = [
        ("secondary_source_systems", "secondary"),
        ("identifier_fields", "identifiers"),
        ("source_systems_in_join", "systems"),
    ]
    rows = [
        f"SELECT kpi_id, {i} AS block, 0 AS pos, {q(field)} AS field, {value} AS value FROM kept"
        for i, (field, value) in enumerate(scalars)
    ]
    for i, (field, column) in enumerate(lists, start=20):
        rows.append(
            f"SELECT kpi_id, {i}, pos, {q(field)}, {column}[pos] FROM (SELECT kpi_id, {column},"
            f" unnest(range(1, len({column}) + 1)) AS pos FROM kept)"
        )
        rows.append(f"SELECT kpi_id, {i}, 0, {q(field)}, '(none)' FROM kept WHERE len({column}) = 0")
    rows.append(
        "SELECT kpi_id, 30, 0, 'historical_aggregates', count(s.ord) || ' data points'"
        " FROM kept LEFT JOIN s USING (kpi_id) GROUP BY kpi_id"
    )
    rows.append(
        "SELECT kpi_id, 31, s.ord, 'historical_aggregates', period || ': ' || CAST(value AS VARCHAR)"
        " FROM kept JOIN s USING (kpi_id)"
    )
    union = "\nUNION ALL ".join(rows)
    return (
        _with(
            REG,
            ATTEMPTS,
            _supplier_year(),
            "kept AS (SELECT * REPLACE (CASE WHEN attempt > 1 THEN 'Attempt ' || attempt"
            " ELSE limitations END AS limitations) FROM tries"
            " WHERE valid QUALIFY row_number() OVER (PARTITION BY kpi_id ORDER BY attempt) = 1)",
        )
        + "SELECT kpi_id, CAST(row_number() OVER (PARTITION BY kpi_id ORDER BY block, pos) AS INT)"
        f" AS line_number, field, value FROM ({union})"
    )


def _intake() -> str:
    parts = [
        REG.replace("reg AS", "raw AS", 1),
        ATTEMPTS.replace("reg.*", "raw.*").replace("FROM reg", "FROM raw"),
        """judged AS (
  SELECT *, count(*) OVER (PARTITION BY kpi_id) AS seen,
    CASE WHEN NOT bool_or(valid) OVER (PARTITION BY kpi_id) THEN 'no valid response'
      WHEN data_steward IS NULL THEN 'lacks data_steward'
      WHEN kpi_id % 4 = 0 THEN 'not confirmed' END AS reason,
    CASE kpi_id % 5 WHEN 1 THEN 'file' WHEN 2 THEN 'none' ELSE 'description' END AS data_option
  FROM tries
  QUALIFY row_number() OVER (PARTITION BY kpi_id ORDER BY NOT valid, attempt) = 1)""",
        """reg AS (
  SELECT * REPLACE (CASE WHEN attempt > 1 THEN 'Attempt ' || attempt ELSE limitations END AS limitations)
  FROM judged WHERE reason IS NULL)""",
        _supplier_year("years"),
        MESSY.replace("s AS (\n", "messy AS (\n", 1),
        """s AS (
  SELECT kpi_id, ord, value, period FROM years JOIN reg USING (kpi_id) WHERE data_option = 'description'
  UNION ALL SELECT kpi_id, ord, value, period FROM messy JOIN reg USING (kpi_id)
  WHERE data_option = 'file' AND kpi_id % 7 <> 0)""",
    ]
    return _with(*parts, SCREEN, ROLLUP, FINDINGS, DECIDED) + """SELECT j.kpi_id,
  CASE WHEN j.reason IS NULL THEN 'reported' ELSE 'rejected' END AS outcome, j.reason,
  CASE WHEN j.valid THEN j.attempt END AS attempt, j.seen AS attempts_seen, j.data_option,
  core.name AS kpi_name, core.n AS n_points, core.anomaly_count, core.readiness_status, core.blockers
FROM judged j LEFT JOIN core USING (kpi_id)"""


FALLBACK = """sizes AS (
  SELECT kpi_id, name, definition, time_period, a.n AS na, b.n AS nb
  FROM reg LEFT JOIN (SELECT kpi_id, count(*) AS n FROM sa GROUP BY kpi_id) a USING (kpi_id)
    LEFT JOIN (SELECT kpi_id, count(*) AS n FROM sb GROUP BY kpi_id) b USING (kpi_id)),
choice AS (
  SELECT *, CASE WHEN coalesce(na, nb, 0) < 2 THEN 'placeholder'
    WHEN na IS NOT NULL THEN 'report' ELSE 'parsed' END AS origin
  FROM sizes)"""


def _anomalies() -> str:
    return (
        _with(MESSY, SCREEN)
        + f"""SELECT kpi_id, ord, 1 AS kind_order, 'NonNumeric' AS type, period, value_raw,
  NULL::DOUBLE AS value, NULL::DOUBLE AS z_score, NULL::VARCHAR AS from_period,
  NULL::VARCHAR AS to_period, NULL::DOUBLE AS from_value, NULL::DOUBLE AS to_value,
  NULL::DOUBLE AS pct_change, {q(V.NON_NUMERIC_NOTE)} AS note
FROM s WHERE value IS NULL
UNION ALL SELECT kpi_id, ord, 2, 'Outlier', period, NULL, value, round_even(z, 2), NULL, NULL,
  NULL, NULL, NULL, {q(V.OUTLIER_NOTE)} FROM scr WHERE is_outlier
UNION ALL SELECT kpi_id, ord, 3, 'StepChange', NULL, NULL, NULL, NULL, from_period, period,
  from_value, value, round_even(change * 100, 1), {q(V.STEP_CHANGE_NOTE)} FROM scr WHERE is_step"""
    )


def statements() -> dict[str, str]:
    sample = ", ".join(f"({i}, {q(text)})" for i, text in enumerate(V.SAMPLE_COMMENTS, start=1))
    placeholder = ", ".join(
        f"({i}, {q(period)}, {value}::DOUBLE)"
        for i, (period, value) in enumerate(V.PLACEHOLDER_SERIES)
    )
    return {
        "step1_register": REGISTRY_ONLY
        + f"SELECT kpi_id, {_pick(*STEP_ROWS[0][1:])}, missing_fields FROM found",
        "step2_definition": REGISTRY_ONLY
        + f"SELECT kpi_id, {_pick(*STEP_ROWS[1][1:])}, definition_issues AS issues,"
        f" CASE WHEN definition_issues = '' THEN '' ELSE {_list(V.FOLLOW_UP_PROMPTS)} END"
        " AS follow_up_prompts FROM found",
        "step3_entity": REGISTRY_ONLY
        + f"SELECT kpi_id, {_pick(*STEP_ROWS[2][1:])}, len(systems) > 1 AS joins_required,"
        " entity_risk_level, array_to_string(identifiers, '; ') AS identifier_fields,"
        f" CASE WHEN len(systems) > 1 THEN {q(V.RESOLUTION_YES)} ELSE {q(V.RESOLUTION_NO)} END"
        " AS recommendation, entity_issues AS issues FROM found",
        "step5_ai_use": REGISTRY_ONLY
        + f"SELECT kpi_id, {_pick(*STEP_ROWS[4][1:])}, permitted AS permitted_ai_techniques,"
        f" {_list(V.EXCLUDED_TECHNIQUES)} AS excluded_ai_techniques, "
        + _join_where(
            ("len(systems) > 1", q(V.LINKAGE_RATIONALE)),
            ("true", q(V.SCREENING_RATIONALE)),
            (SURVEY, q(V.COMMENT_RATIONALE)),
        )
        + " AS rationale FROM found",
        "step6_governance": REGISTRY_ONLY
        + f"SELECT kpi_id, {_pick(*STEP_ROWS[5][1:])}, missing_elements,"
        f" {_list(V.GUARDRAILS)} AS guardrails FROM found",
        "step7_readiness": CORE
        + f"SELECT kpi_id, {_pick(*STEP_ROWS[6][1:])}, blockers,"
        f" CASE WHEN blockers = '' THEN {_list(V.NEXT_ACTIONS_READY)}"
        f" ELSE {_list(V.NEXT_ACTIONS_BLOCKED)} END AS next_actions,"
        f" {q(V.READINESS_NOTE)} AS note FROM core",
        "step8_summary": CORE
        + f"SELECT kpi_id, 'Generated' AS status, name AS kpi_name, definition, formula, time_period,"
        " audience AS intended_audience, source AS primary_source,"
        " array_to_string(secondary, '; ') AS secondary_sources,"
        " array_to_string(systems, '; ') AS systems_in_join,"
        " array_to_string(identifiers, '; ') AS identifier_fields, definition_status,"
        " entity_risk_level, anomalies_detected, governance_status, permitted,"
        f" {_list(V.EXCLUDED_TECHNIQUES)} AS excluded, data_owner, data_steward,"
        " limitations AS known_limitations, risks AS bias_or_equity_risks,"
        " signoff AS human_signoff_required, readiness_status,"
        f" CASE WHEN blockers = '' THEN {q(V.READY[1])} ELSE {q(V.NOT_READY[1])} END"
        " AS readiness_notes, blockers FROM core",
        "step9_smart": ASSESSED
        + "SELECT kpi_id, specific, measurable, achievable, relevant, time_bound,"
        f" smart_score AS score, {SMART_STRENGTHS} AS strengths,"
        f" {_join_where(*_quoted(_SMART_ISSUES))} AS issues FROM aligned",
        "step9_tufte": ASSESSED
        + "SELECT kpi_id, ratio AS data_ink_ratio, units AS chartjunk_avoidance,"
        " comparison AS data_density, segments AS small_multiples, owned AS narrative_clarity,"
        f" visual_score AS score, visual_percent AS percentage, {VISUAL_STRENGTHS} AS strengths,"
        f" {_join_where(*_quoted(_VISUAL_ISSUES))} AS issues FROM aligned",
        "step9_recommendations": ASSESSED
        + f"SELECT kpi_id, {RECOMMENDATIONS} AS recommendations FROM aligned",
        "step9_status": ASSESSED
        + "SELECT kpi_id, design_status AS status, design_notes AS notes,"
        " CASE WHEN owned THEN 'High' ELSE 'Medium' END AS actionability FROM aligned",
        "step10_standards": ASSESSED
        + f"SELECT kpi_id, {', '.join(CHECKS)}, standards_status AS status,"
        " standards_notes AS notes, met || '/9' AS total_score,"
        f" {_join_where(*_quoted(_GAPS))} AS recommendations FROM aligned",
        "standards_scores": _scores(),
        "optional_steps": CORE
        + f"SELECT kpi_id, readiness_status, {q(V.DESIGN_SKIPPED[0])} AS design_status,"
        f" {q(V.DESIGN_SKIPPED[1])} AS design_notes, {q(V.STANDARDS_SKIPPED[0])} AS standards_status,"
        f" {q(V.STANDARDS_SKIPPED[1])} AS standards_notes FROM core",
        "readiness_report": ASSESSED
        + "SELECT kpi_id, name AS kpi_name,"
        " CASE WHEN missing_fields = '' THEN 'Pass' ELSE 'Needs Attention' END AS register_status,"
        " missing_fields, definition_status, definition_issues, entity_status, entity_risk_level,"
        " quality_status, n AS n_points, anomaly_count, round(mean, 4) AS mean,"
        " round(stdev, 4) AS stdev, permitted AS permitted_ai, governance_status, missing_elements,"
        " readiness_status, blockers, design_status, design_notes, standards_status,"
        " standards_notes FROM aligned",
        "batch_summary": ASSESSED
        + "SELECT kpi_id, name AS kpi_name, readiness_status, definition_status,"
        " entity_risk_level AS entity_risk, anomalies_detected, governance_status,"
        " design_status AS design_quality, standards_status AS industry_standards, blockers"
        " FROM aligned",
        "batch_counts": CORE
        + "SELECT count(*) AS total, count(*) FILTER (blockers = '') AS ready,"
        " count(*) FILTER (blockers <> '') AS blocked FROM core",
        "batch_listing": CORE
        + "SELECT kpi_id, name AS kpi_name, 'Blocked' AS section, blocker"
        f" FROM ({_blocker_rows('core')})"
        " UNION ALL SELECT kpi_id, name, 'Ready', NULL FROM core WHERE blockers = ''",
        "summary_long": _summary_long(),
        "report_long": _report_long(),
        "criterion_prevalence": _prevalence(),
        "batch_csv_sink": ASSESSED
        + "SELECT name AS kpi_name, readiness_status, definition_status,"
        " entity_risk_level AS entity_risk, anomalies_detected, governance_status,"
        " design_status AS design_quality, standards_status AS industry_standards, blockers"
        " FROM aligned",
        "summary_csv_sink": _summary_long(),
        "anomalies_json_sink": _anomalies(),
        "report_json_sink": ASSESSED + REPORT_FIELDS,
        "latest_report_scan": ASSESSED + REPORT_FIELDS,
        "series_stats": _with(_quarter("l_partkey"))
        + "SELECT kpi_id, count(*) AS n_points, count(value) AS n_numeric,"
        " round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev,"
        " min(value) AS min_value, max(value) AS max_value FROM s GROUP BY kpi_id",
        "series_spread": _with(_supplier_year())
        + "SELECT kpi_id, n AS n_points, hi - lo AS spread, round(cv, 6) AS variation,"
        " CASE WHEN n >= 3 THEN hi - lo < hi * 0.3::DOUBLE END AS stable_range,"
        " n >= 3 AND cv > 0.01 AS has_variation FROM (SELECT kpi_id, count(*) AS n,"
        " min(value) AS lo, max(value) AS hi,"
        " CASE WHEN avg(value) > 0 THEN stddev_pop(value) / avg(value) ELSE 0 END AS cv"
        " FROM s GROUP BY kpi_id)",
        "non_numeric_points": _with(MESSY)
        + f"SELECT kpi_id, ord, period, value_raw, {q(V.NON_NUMERIC_NOTE)} AS note"
        " FROM s WHERE value IS NULL",
        "outliers": _with(_quarter("l_partkey"), SCREEN)
        + "SELECT kpi_id, ord, period, value, round(z, 6) AS z, round_even(z, 2) AS z_score,"
        f" {q(V.OUTLIER_NOTE)} AS note FROM scr WHERE is_outlier",
        "step_changes": _with(_user_day(), SCREEN)
        + "SELECT kpi_id, ord, from_period, period AS to_period, from_value, value AS to_value,"
        " round(change, 6) AS change, round_even(change * 100, 1) AS pct_change,"
        f" {q(V.STEP_CHANGE_NOTE)} AS note FROM scr WHERE is_step",
        "anomalies": _anomalies(),
        "anomaly_rollup": _with(REG, MESSY, SCREEN, ROLLUP)
        + "SELECT kpi_id, n AS n_points, n_numeric, non_numeric AS non_numeric_count,"
        " coalesce(outliers, 0) AS outlier_count, coalesce(steps, 0) AS step_change_count,"
        " anomaly_count, CASE WHEN anomaly_count = 0 THEN 'No' ELSE 'Yes' END AS anomalies_detected,"
        f" CASE WHEN anomaly_count = 0 THEN {q(V.QUALITY_PASS[0])} ELSE {q(V.QUALITY_REVIEW[0])} END"
        " AS quality_status,"
        f" CASE WHEN anomaly_count = 0 THEN {q(V.QUALITY_PASS[1])} ELSE {q(V.QUALITY_REVIEW[1])} END"
        " AS quality_notes FROM fact",
        "registry_left_series": _with(CUSTOMER_REG, _user_day(), SCREEN, ROLLUP)
        + "SELECT kpi_id, name, n AS n_points, anomaly_count,"
        " CASE WHEN anomaly_count = 0 THEN 'No' ELSE 'Yes' END AS anomalies_detected,"
        " CASE WHEN anomaly_count = 0 THEN 'Pass' ELSE 'Needs Human Review' END AS quality_status"
        " FROM fact",
        "chart_points": _with(
            MESSY,
            SCREEN,
            """place AS (SELECT kpi_id, period, min(ord) AS ord FROM s GROUP BY kpi_id, period),
marks AS (
  SELECT place.kpi_id, place.ord, count(*) FILTER (is_outlier) AS om,
    arg_min(round_even(z, 2), scr.ord) FILTER (is_outlier) AS oz,
    count(*) FILTER (is_step) AS sm,
    arg_min(round_even(change * 100, 1), scr.ord) FILTER (is_step) AS sp
  FROM scr JOIN place USING (kpi_id, period) GROUP BY place.kpi_id, place.ord)""",
        )
        + "SELECT s.kpi_id, s.ord, s.period, s.value, coalesce(om, 0) AS outlier_marks,"
        " oz AS z_score, coalesce(sm, 0) AS step_marks, sp AS pct_change"
        " FROM s LEFT JOIN marks USING (kpi_id, ord)",
        "scan_kpi_registry_csv": _with(REG)
        + "SELECT kpi_id, name, definition, time_period,"
        " array_to_string(secondary, '; ') AS secondary_source_systems,"
        " array_to_string(identifiers, '; ') AS identifier_fields,"
        " array_to_string(systems, '; ') AS source_systems_in_join, data_owner,"
        " coalesce(data_steward, '') AS data_steward,"
        " 'As \"reported\",' || chr(10) || limitations AS known_limitations,"
        " signoff AS human_signoff_required FROM reg",
        "scan_panel_series": _with(PANEL)
        + "SELECT kpi_id, row_number() OVER (PARTITION BY kpi_id ORDER BY y) - 1 AS ord,"
        " 'Fall ' || y AS period, value FROM panel",
        "scan_series_csv": _with(MESSY)
        + "SELECT kpi_id, ord, period, value FROM s WHERE value IS NOT NULL",
        "scan_series_positional": _with(PANEL)
        + "SELECT kpi_id, row_number() OVER (PARTITION BY kpi_id ORDER BY y) - 1 AS ord,"
        " CAST(y AS VARCHAR) AS period, value FROM panel",
        "resolve_series_columns": _with(PANEL)
        + "SELECT kpi_id, y AS ord, CAST(y AS VARCHAR) AS period, value FROM panel",
        "scan_parsed_kpi_json": _with(REG, _supplier_year())
        + "SELECT kpi_id, any_value(name) AS name, any_value(formula) AS formula,"
        " any_value(array_to_string(secondary, '; ')) AS secondary_source_systems,"
        " any_value(CASE WHEN kpi_id % 4 = 0 THEN '' ELSE array_to_string(identifiers, '; ') END)"
        " AS identifier_fields,"
        " any_value(kpi_id % 10 = 0 OR signoff) AS human_signoff_required,"
        " count(*) AS n_points, arg_max(value, ord) AS latest_value"
        " FROM reg JOIN s USING (kpi_id) WHERE kpi_id % 9 <> 0 AND data_steward IS NOT NULL"
        " GROUP BY kpi_id",
        "scan_survey_comments": f"""WITH d AS (
  SELECT doc_id, doc_id // 20 AS survey_id, text,
    CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS INT) AS pos
  FROM documents)
SELECT survey_id, false AS is_sample, pos AS comment_number, text AS comment
FROM d WHERE survey_id % 5 IN (0, 1)
UNION ALL
SELECT survey_id, true, pos, comment FROM (SELECT DISTINCT survey_id FROM d) AS v,
  (VALUES {sample}) AS t(pos, comment) WHERE survey_id % 5 IN (2, 4)""",
        "categorize_comments": f"SELECT doc_id AS comment_id, {_category_case(CATEGORY_BINDING)}"
        " AS category FROM documents",
        "categorize_comments_by_table": f"SELECT doc_id AS comment_id,"
        f" {_category_case(CATEGORY_BINDING)} AS category FROM documents",
        "categorize_comments_default": "SELECT doc_id AS comment_id,"
        f" {_category_case(V.COMMENT_CATEGORIES)} AS category FROM documents",
        "comment_category_counts": f"""WITH c AS (
  SELECT {_category_case(CATEGORY_BINDING)} AS category FROM documents)
SELECT coalesce(category, 'UNCATEGORIZED') AS category, count(*) AS comments,
  NULL::INT AS categorized_percent FROM c GROUP BY category
UNION ALL
SELECT 'TOTAL', count(*), CAST(trunc(count(category) / count(*) * 100) AS INT) FROM c""",
        "kpi_parse_prompts": _with(REG)
        + f"SELECT kpi_id, {q(P.KPI_INSTRUCTIONS)} || chr(10) || chr(10) || {q(P.KPI_REQUEST)}"
        " || chr(10) || chr(10) || name || '. ' || definition || '. ' || formula || '. '"
        " || time_period AS prompt FROM reg",
        "refinement_prompts": _refinement_prompts(),
        "placeholder_prompts": _with(
            CUSTOMER_REG, _user_day("sa"), _customer_year("sb"), FALLBACK
        )
        + f"SELECT kpi_id, {q(P.PLACEHOLDER_INTRODUCTION)} || chr(10) || chr(10) || 'KPI: ' || name"
        " || chr(10) || 'Definition: ' || definition || chr(10) || 'Time Period: ' || time_period"
        f" || chr(10) || chr(10) || {q(P.PLACEHOLDER_TASK)} AS prompt"
        " FROM choice WHERE origin = 'placeholder'",
        "survey_prompt_batches": f"""WITH d AS (
  SELECT rank // 50 AS batch_id, text, rank % 50 + 1 AS i
  FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents))
SELECT batch_id, CAST(count(*) AS INT) AS n_comments,
  {q(P.SURVEY_INTRODUCTION)} || chr(10) || chr(10) || 'Comments to analyze:' || chr(10)
  || string_agg(i || '. ' || text, chr(10) ORDER BY i) || chr(10) || chr(10)
  || {q(P.SURVEY_TASK)} AS prompt
FROM d GROUP BY batch_id""",
        "parse_llm_kpi": _with(
            REG,
            ATTEMPTS,
            _supplier_year(),
            "sizes AS (SELECT kpi_id, CAST(count(*) AS INT) AS n FROM s GROUP BY kpi_id)",
        )
        + "SELECT kpi_id AS request_id, attempt, valid AS is_valid,"
        " CASE WHEN valid THEN name END AS name, CASE WHEN valid THEN definition END AS definition,"
        " CASE WHEN valid THEN array_to_string(systems, '; ') END AS source_systems_in_join,"
        " CASE WHEN valid THEN data_steward END AS data_steward,"
        " CASE WHEN valid THEN signoff END AS human_signoff_required,"
        " CASE WHEN valid THEN n END AS n_points FROM tries LEFT JOIN sizes USING (kpi_id)",
        "first_valid_attempt": _with(REG, ATTEMPTS)
        + "SELECT kpi_id AS request_id, CASE WHEN bool_or(valid) THEN 'parsed' ELSE 'failed' END"
        " AS status, min(attempt) FILTER (valid) AS attempt, count(*) AS attempts_seen,"
        " any_value(name) FILTER (valid) AS name FROM tries GROUP BY kpi_id",
        "parse_survey_analysis": _with(SURVEY_ANSWERS)
        + "SELECT k AS request_id, is_fallback, pos AS category_number, name, cnt AS count,"
        " cats.sentiment, theme AS theme_summary FROM cats JOIN ans USING (k)",
        "placeholder_series": f"""SELECT c_custkey AS kpi_id, CAST(i AS BIGINT) AS ord,
  'Fall ' || (2020 + i) AS period, CAST(c_custkey % 30 + 60 + i AS VARCHAR) AS value_raw,
  CAST(c_custkey % 30 + 60 + i AS DOUBLE) AS value, false AS is_fallback
FROM customer, range(5) AS r(i) WHERE c_custkey % 4 <> 0
UNION ALL
SELECT c_custkey, CAST(t.ord AS BIGINT), t.period, CAST(t.value AS VARCHAR), t.value, true
FROM customer, (VALUES {placeholder}) AS t(ord, period, value) WHERE c_custkey % 4 = 0""",
        "survey_section_mart": _with(
            SURVEY_ANSWERS,
            f"""tops AS (
  SELECT *, CASE WHEN is_fallback THEN {q(V.FALLBACK_OVERALL)}
      ELSE coalesce(CASE WHEN k % 3 <> 0 THEN sentiment END, 'mixed') END AS overall
  FROM ans)""",
        )
        + f"""SELECT k AS request_id, k % 10 = 0 AS is_sample, is_fallback,
  upper(left(overall, 1)) || substr(overall, 2) AS overall_sentiment,
  CASE WHEN overall IN ('positive', 'negative', 'mixed', 'neutral') THEN overall ELSE 'other' END
    AS overall_light,
  CASE WHEN is_fallback THEN {q(V.FALLBACK_INSIGHT)} ELSE 'Look at ' || c_mktsegment END AS key_insight,
  CAST(CASE WHEN is_fallback THEN c_nationkey + 1 ELSE c_nationkey + k % 7 END AS BIGINT)
    AS total_analyzed,
  CASE WHEN is_fallback THEN {_list(V.FALLBACK_FLAGS)} WHEN k % 2 = 0 THEN c_name ELSE '' END
    AS priority_flags,
  pos AS category_number, name AS category, cnt AS comments, theme,
  coalesce(cats.sentiment, 'neutral') AS sentiment,
  CASE WHEN coalesce(cats.sentiment, 'neutral') IN ('positive', 'negative', 'mixed', 'neutral')
    THEN coalesce(cats.sentiment, 'neutral') ELSE 'other' END AS sentiment_light
FROM cats JOIN tops USING (k)""",
        "review_gate": "SELECT s_suppkey AS kpi_id, s_name AS name,"
        " CASE WHEN s_suppkey % 4 = 0 THEN 'pending' ELSE 'approved' END AS gate FROM supplier",
        "field_review": _field_review(),
        "intake_to_report": _intake(),
        "series_fallback": _with(
            CUSTOMER_REG, _user_day("sa"), _customer_year("sb"), FALLBACK
        )
        + f"""SELECT kpi_id, sa.ord, sa.period, sa.value, 'report' AS origin, false AS is_synthetic
FROM sa JOIN choice USING (kpi_id) WHERE origin = 'report'
UNION ALL SELECT kpi_id, sb.ord, sb.period, sb.value, 'parsed', false
FROM sb JOIN choice USING (kpi_id) WHERE origin = 'parsed'
UNION ALL SELECT kpi_id, CAST(t.ord AS BIGINT), t.period, t.value, 'placeholder', true
FROM choice, (VALUES {placeholder}) AS t(ord, period, value) WHERE origin = 'placeholder'""",
        "dashboard_mart": _dashboard(),
    }
