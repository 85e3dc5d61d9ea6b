"""Comments, prompts, model responses, review and dashboard tables."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import RETENTION, RETENTION_POINTS
from plumbline import fixed_values as V
from plumbline.operators import comments as C
from plumbline.operators import prompts as P
from plumbline.operators import responses as A
from plumbline.operators import review as H
from plumbline.plans import marts
from plumbline.plans import report as R
from plumbline.schema import PARSED_KPI
from plumbline.sources.registry import registry_of, series_of, with_parsed_defaults

ANSWER = json.dumps(
    {k: v for k, v in RETENTION.items() if k != "kpi_id"}
    | {"historical_aggregates": [{"period": p, "value": v} for p, v in RETENTION_POINTS]},
    indent=2,
)
FENCED = "```json\n" + ANSWER + "\n```"
BROKEN = '{"name": "Unfinished", "definition": no quotes}'


@pytest.fixture
def sample_comments(spark):
    return spark.createDataFrame(
        list(enumerate(V.SAMPLE_COMMENTS)), "comment_id long, comment string"
    )


def test_sample_comment_counts(sample_comments):
    rows = C.comment_category_counts(C.categorize_comments(sample_comments)).collect()
    assert {r.category: r.comments for r in rows} == {
        "Registration & Enrollment": 2,
        "Advising & Support": 2,
        "Financial Aid & Billing": 3,
        "Facilities & Resources": 2,
        "Career Services": 1,
        "TOTAL": 10,
    }
    assert [r.categorized_percent for r in rows if r.category == "TOTAL"] == [100]


def test_first_category_in_order_wins(spark):
    rows = spark.createDataFrame(
        [(1, "Office HOURS of my professor"), (2, "paid"), (3, "nothing"), (4, None)],
        "comment_id long, comment string",
    )
    got = C.categorize_comments(rows).orderBy("comment_id").collect()
    assert [r.category for r in got] == [
        "Facilities & Resources", "Financial Aid & Billing", None, None,
    ]
    counts = C.comment_category_counts(C.categorize_comments(rows)).collect()
    assert {r.category: (r.comments, r.categorized_percent) for r in counts}["TOTAL"] == (4, 50)
    assert {r.category: r.comments for r in counts}["UNCATEGORIZED"] == 2


def test_comments_can_come_as_a_stream(spark, sample_comments, tmp_path):
    sample_comments.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(sample_comments.schema).parquet(f"{tmp_path}/in")
    query = (
        C.categorize_comments(stream)
        .writeStream.format("memory")
        .queryName("categorized")
        .option("checkpointLocation", f"{tmp_path}/check")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(60)
    assert spark.table("categorized").where("category IS NOT NULL").count() == 10


RAW = [
    (ANSWER, True),
    (FENCED, True),
    ("  \n" + FENCED + "\n\n", True),
    ("```\n" + ANSWER, True),  # a fence that is never closed
    ("```json\n" + ANSWER + "\n  ``` ", True),
    (BROKEN, False),
    ("[1, 2]", False),
    ("", False),
    (None, False),
    ("```", False),
    (ANSWER + " Hope this helps!", False),
    ("Here you are: " + ANSWER, False),
    (ANSWER + ANSWER, False),
    ("{}", True),
    ('{"name": "a ``` inside"}', True),
    ('"text"', False),
    ("null", False),
    ("{'name': 'A'}", False),
    ('{"a": 1},2] garbage', False),
    ('{"a": 1},{"b": 2}', False),
    ('{"a": 1},{"b": 2}]', False),
    ('{"a": 1},"second":0}', False),
    ('{"name": "two\nlines"}', False),
    ('{"name": "two\\nlines"}', True),
    ('{"a": 1, "a": 2}', True),
    ('{"a": 01}', False),
    ('{"a": 1,}', False),
    ('{"a": NaN}', False),
    ('{"a": [{"b": null}, "\u2028é"]}', True),
    ('{"a": 1} // no', False),
]


def test_which_responses_are_objects(spark):
    df = spark.createDataFrame(
        [(i, 1, raw) for i, (raw, _) in enumerate(RAW)], "request_id long, attempt int, raw string"
    )
    rows = A.read_responses(df).orderBy("request_id").collect()
    assert [r.is_valid for r in rows] == [valid for _, valid in RAW]
    for row in rows[:5]:
        assert json.loads(row.body) == json.loads(ANSWER)


def test_valid_response_keeps_its_fields(spark):
    df = spark.createDataFrame([(1, 1, FENCED)], "request_id long, attempt int, raw string")
    row = A.parse_kpi_responses(df).first().parsed
    assert row.name == "First-Year Retention Rate"
    assert len(row.historical_aggregates) == 6
    assert row.human_signoff_required is True


def test_attempts(spark):
    tries = [
        (1, 1, BROKEN), (1, 2, ANSWER), (1, 3, FENCED),
        (2, 1, BROKEN), (2, 2, BROKEN), (2, 3, "[1]"), (2, 4, ANSWER),
        (3, 2, FENCED), (3, 1, ANSWER),
    ]
    df = spark.createDataFrame(tries, "request_id long, attempt int, raw string")
    rows = {r.request_id: r for r in A.first_valid_attempt(df).collect()}
    assert (rows[1].status, rows[1].attempt) == ("parsed", 2)
    assert (rows[2].status, rows[2].attempt, rows[2].body) == ("failed", None, None)
    assert rows[2].attempts_seen == 3  # the fourth is ignored
    assert rows[3].attempt == 1


def test_survey_answers_and_fallback(spark):
    answer = {
        "categories": [
            {"name": "A", "count": 2, "sentiment": "positive", "theme_summary": "t"},
            {"name": "B"},
        ],
        "overall_sentiment": "odd",
        "total_analyzed": 3,
    }
    rows = [(1, json.dumps(answer), 3, False), (2, "sorry", 7, True), (3, '{"categories": []}', 1, False)]
    df = spark.createDataFrame(rows, "request_id long, raw string, n_comments int, is_sample boolean")
    analyses = A.parse_survey_responses(df)
    listed = A.survey_categories(analyses).collect()
    assert [(r.name, r["count"]) for r in listed if r.request_id == 1] == [("A", 2), ("B", None)]
    assert [(r.name, r["count"], r.sentiment, r.theme_summary) for r in listed if r.is_fallback] == (
        V.FALLBACK_CATEGORIES
    )
    mart = marts.survey_section_mart(analyses).orderBy("request_id", "category_number").collect()
    first = mart[1]
    assert (first.category, first.comments, first.sentiment, first.sentiment_light) == (
        "B", 0, "neutral", "neutral",
    )
    assert (first.overall_sentiment, first.overall_light) == ("Odd", "other")
    fallback = [r for r in mart if r.request_id == 2]
    assert {r.total_analyzed for r in fallback} == {7} and {r.is_sample for r in fallback} == {True}
    empty = [r for r in mart if r.request_id == 3]
    assert len(empty) == 1 and empty[0].overall_sentiment == "Mixed"


def test_placeholder_series_from_responses(spark):
    good = '[{"period": "Fall 2020", "value": 71.5}, {"value": "n/a"}]'
    rows = [(1, f"```\n{good}\n```"), (2, '{"period": "x"}'), (3, good + " done"), (4, None)]
    df = spark.createDataFrame(rows, "request_id long, raw string")
    got = {}
    for r in A.parse_placeholder_series(df).orderBy("kpi_id", "ord").collect():
        got.setdefault((r.kpi_id, r.is_fallback), []).append((r.period, r.value))
    assert got == {
        (1, False): [("Fall 2020", 71.5), ("Unknown", None)],
        **{(k, True): V.PLACEHOLDER_SERIES for k in (2, 3, 4)},
    }


def test_kpi_prompt_is_self_contained(spark):
    df = spark.createDataFrame([(1, "First-Year Retention Rate, {x}")], "kpi_id long, description string")
    prompt = P.kpi_parse_prompts(df).first().prompt
    assert '"historical_aggregates"' in prompt
    assert "JSON" in prompt and all(field in prompt for field in V.REQUIRED_JSON_FIELDS)
    assert prompt.endswith("First-Year Retention Rate, {x}")
    for field in PARSED_KPI.names[1:]:
        assert f'"{field}"' in prompt


def test_placeholder_prompt_states_every_rule_of_the_series(spark):
    rows = [(1, "Retention", "Share who return", "Fall to fall"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "kpi_id long, name string, definition string, time_period string")
    first, second = [r.prompt for r in P.placeholder_prompts(df).orderBy("kpi_id").collect()]
    assert "KPI: Retention\nDefinition: Share who return\nTime Period: Fall to fall\n" in first
    assert f"Time Period: {V.DEFAULT_PLACEHOLDER_PERIOD}\n" in second
    rules = ["five years", "small college", "straight line", "rise", "vary", "dip", "exactly 5 points", "2024-25"]
    rules += ["Fall 2020", "number, such as 0.0", "percentage from 60 to 95", "JSON array", '"period"', '"value"']
    assert not [rule for rule in rules if rule not in first or rule not in second]


def test_refinement_prompt(registry, retention_series):
    rows = registry({}, {"definition": "x", "data_steward": None, "formula": "x"})
    prompts = P.refinement_prompts(R.report_json(R.assess(rows, retention_series)))
    good, bad = [r.prompt for r in prompts.orderBy("kpi_id").collect()]
    assert "\nBlockers: None\n" in good and "\nSMART Issues: None\n" in good
    assert (
        "\nIndustry Gaps: ['AGB: Includes target or peer comparison for context']\n" in good
    )
    assert "\nBlockers: ['Definition ambiguous', 'Governance incomplete']\n" in bad
    assert "\nData Steward: \n" in bad


def test_survey_prompt_numbers_every_comment(spark, sample_comments):
    got = P.survey_prompt_batches(sample_comments, comments_per_prompt=4).orderBy("batch_id")
    rows = got.collect()
    assert [r.n_comments for r in rows] == [4, 4, 2]
    for row in rows:
        part = V.SAMPLE_COMMENTS[row.batch_id * 4 : row.batch_id * 4 + 4]
        lines = "\n".join(f"{i}. {text}" for i, text in enumerate(part, 1))
        assert "Comments to analyze:\n" + lines + "\n\n" in row.prompt


def test_review_gate(spark, registry):
    rows = registry({}, {}, {}, {})
    votes = spark.createDataFrame(
        [(1, "N"), (1, "\tY\n"), (2, "N"), (3, "yes"), (4, None), (9, "Y")],
        "kpi_id long, decision string",
    )
    assert [r.kpi_id for r in H.approved(rows, votes).collect()] == [1]
    assert sorted(r.kpi_id for r in H.pending(rows, votes).collect()) == [2, 3, 4]


def test_the_chosen_record_is_that_of_the_first_valid_attempt(spark):
    tries = [
        (1, 3, '{"name": "third"}'), (1, 2, '{"name": "b"}'), (1, 2, '{"name": "a"}'), (1, 1, BROKEN),
        (2, 1, '{"name": "only"}'), (3, 4, '{"name": "too late"}'),
    ]
    df = spark.createDataFrame(tries, "request_id long, attempt int, raw string")
    rows = A.chosen_records(df).orderBy("request_id").collect()
    assert [(r.request_id, r.attempt, r.parsed.name) for r in rows] == [(1, 2, "a"), (2, 1, "only")]


def test_field_review(spark):
    df = spark.createDataFrame([(1, 1, '{"name": "N", "identifier_fields": ["a", "b"]}')],
                               "request_id long, attempt int, raw string")
    parsed = A.parse_kpi_responses(df).select(F.col("request_id").alias("kpi_id"), "parsed")
    rows = H.field_review(parsed).orderBy("line_number").collect()
    listing = [(r.field, r.value) for r in rows]
    assert listing[:2] == [("name", "N"), ("definition", "NOT FOUND")]
    assert listing[10] == ("human_signoff_required", "NOT FOUND")
    assert listing[11:] == [
        ("secondary_source_systems", "(none)"),
        ("identifier_fields", "a"),
        ("identifier_fields", "b"),
        ("source_systems_in_join", "(none)"),
        ("historical_aggregates", "0 data points"),
    ]


def test_series_fallback(registry, series):
    rows = registry({}, {}, {}, {})
    report = series([1, 2], [], [7])
    parsed = series([9, 9, 9], [3, 4], [5, 6], [8])
    got = H.series_fallback(rows, report, parsed).orderBy("kpi_id", "ord").collect()
    shown = {}
    for r in got:
        shown.setdefault((r.kpi_id, r.origin, r.is_synthetic), []).append(r.value)
    placeholder = [value for _, value in V.PLACEHOLDER_SERIES]
    assert shown == {
        (1, "report", False): [1.0, 2.0],
        (2, "parsed", False): [3.0, 4.0],
        (3, "placeholder", True): placeholder,  # one point of its own is too few
        (4, "placeholder", True): placeholder,
    }


def test_dashboard(spark, registry, retention_series):
    rows = registry({}, {"definition": "x", "data_owner": None, "human_signoff_required": False})
    reports = R.report_json(R.assess(rows, retention_series))
    facts = spark.createDataFrame(
        [(1, 6, 91.0, 88.0, 91.0, 0, False)],
        "kpi_id long, n_points long, latest_value double, min_value double, max_value double,"
        " anomaly_count long, is_synthetic boolean",
    )
    ready, blocked = marts.dashboard_mart(reports, facts).orderBy("kpi_id").collect()
    assert (ready.readiness_light, ready.standards_light) == ("green", "green")
    assert (ready.latest_value, ready.axis_min, ready.axis_max) == ("91.0", 83, 96)
    assert ready.blockers == V.NO_BLOCKERS and ready.human_signoff == "Required"
    assert (blocked.readiness_light, blocked.has_chart) == ("red", False)
    assert (blocked.latest_value, blocked.axis_min) == ("N/A", None)
    assert (blocked.data_owner, blocked.human_signoff) == ("Not specified", "Not set")


def test_skipped_steps_show_as_not_available(spark, registry, retention_series):
    assessed = R.assess(
        registry({}), retention_series, include_design=False, include_standards=False
    )
    reports = R.report_json(assessed)
    facts = spark.createDataFrame(
        [],
        "kpi_id long, n_points long, latest_value double, min_value double, max_value double,"
        " anomaly_count long, is_synthetic boolean",
    )
    row = marts.dashboard_mart(reports, facts).first()
    assert {row.smart_score, row.visual_percent, row.standards_score} == {"N/A"}
    assert (row.standards_status, row.standards_light) == ("Skipped", "red")
    assert "\nSMART Issues: None\n" in P.refinement_prompts(reports).first().prompt


def test_intake_to_report(spark):
    """Response text to parsed record to report, as one chain of tables."""
    tries = [(1, 1, BROKEN), (1, 2, FENCED)]
    df = spark.createDataFrame(tries, "request_id long, attempt int, raw string")
    chosen = A.first_valid_attempt(df).where("status = 'parsed'")
    records = chosen.select(F.from_json("body", PARSED_KPI).alias("r")).select("r.*")
    parsed = with_parsed_defaults(records)
    row = R.readiness_report(R.assess(registry_of(parsed), series_of(parsed))).first()
    assert row.readiness_status == "Ready for Dashboard Use" and row.n_points == 6
