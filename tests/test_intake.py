"""Intake from responses to reports, ranks, prompt batches, and the series shown beside a report."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import RETENTION
from plumbline import fixed_values as V
from plumbline.functions.ordering import with_position, with_rank
from plumbline.operators import prompts, review
from plumbline.operators import series as S
from plumbline.plans import intake

POINTS = [{"period": "P0", "value": 1}, {"period": "P1", "value": 1.5}, {"period": "P2", "value": "x"}]
SERIES = "kpi_id long, ord long, period string, value_raw string, value double"


def answer(**changes):
    record = {k: v for k, v in RETENTION.items() if k != "kpi_id"} | {"historical_aggregates": POINTS}
    return json.dumps({k: v for k, v in (record | changes).items() if v is not None})


@pytest.fixture(scope="module")
def found(spark):
    tries = [
        (1, 1, "no"), (1, 2, answer(name="second")), (1, 3, answer(name="third")),
        (2, 1, "{'name': 1}"), (2, 2, answer() + " thanks"),
        (3, 1, answer(formula=None, data_owner=None)),
        (4, 1, answer()), (5, 1, answer(historical_aggregates=None)), (6, 1, answer()), (7, 1, answer()),
        (8, 4, answer()),
    ]
    responses = spark.createDataFrame(tries, "request_id long, attempt int, raw string")
    votes = [(k, "Y") for k in (1, 2, 3, 5, 6, 7, 7, 99)] + [(4, "N"), (7, "N")]
    options = [(5, "file"), (6, "file"), (7, "none"), (5, "file")]
    points = [(5, i, f"F{i}", str(v), float(v)) for i, v in enumerate([1, 1, 4])] + [(1, 0, "F", "9", 9.0)]
    return intake.intake(
        responses,
        spark.createDataFrame(votes, "kpi_id long, decision string"),
        spark.createDataFrame(points, SERIES),
        spark.createDataFrame(options, "kpi_id long, data_option string"),
    )


def test_rejected_requests_keep_their_reason(found):
    rows = {r.kpi_id: (r.reason, r.attempts_seen) for r in found.rejected.collect()}
    assert rows == {
        2: (intake.NO_RESPONSE, 2),
        3: ("lacks formula, data_owner", 1),
        4: (intake.NOT_CONFIRMED, 1),
        8: (intake.NO_RESPONSE, 0),
    }


def test_accepted_requests_bring_their_series(found):
    assert {r.kpi_id: r.name for r in found.registry.collect()} == {
        1: "second", 5: RETENTION["name"], 6: RETENTION["name"], 7: RETENTION["name"]
    }
    shown = {}
    for r in found.series.orderBy("kpi_id", "ord").collect():
        shown.setdefault(r.kpi_id, []).append((r.period, r.value))
    assert shown == {
        1: [("P0", 1.0), ("P1", 1.5), ("P2", None)],  # its own: no file was named
        5: [("F0", 1.0), ("F1", 1.0), ("F2", 4.0)],
    }


def test_every_request_has_one_row_in_the_report(found):
    rows = {r.kpi_id: r for r in intake.intake_report(found).collect()}
    assert sorted(rows) == list(range(1, 9))
    assert (rows[1].outcome, rows[1].n_points, rows[1].anomaly_count) == ("reported", 3, 2)
    assert (rows[6].n_points, rows[7].n_points, rows[6].anomaly_count) == (0, 0, 0)
    assert rows[2].readiness_status is None and rows[2].outcome == "rejected"


def test_ranks_are_dense_for_any_keys(spark):
    rows = [(k % 3, None if k < 40 else (k - 500) * 86_400_000) for k in range(1000)] + [(None, 5)]
    df = spark.createDataFrame(rows, "g long, t long").repartition(7)
    got = with_rank(df, ["g"], ["t"]).collect()
    for g in range(3):
        own = sorted((r.ord, r.t) for r in got if r.g == g)
        assert [o for o, _ in own] == list(range(len(own)))
        keys = [-(10**18) if t is None else t for _, t in own]
        assert keys == sorted(keys)
    assert len(got) == 1000
    whole = with_rank(df.select("t"), [], ["t"], "n").collect()
    assert sorted(r.n for r in whole) == list(range(1001))


def test_epoch_series_have_bounded_chunks_after_ranking(spark):
    """20,000 points a day apart, in milliseconds: by key each is a chunk of its own."""
    rows = spark.range(20_000).selectExpr(
        "1L AS kpi_id", "1500000000000 + id * 86400000 AS ord", "'p' AS period",
        "cast(id % 10 AS string) AS value_raw", "cast(id % 10 + if(id = 12345, 500, 0) AS double) AS value",
    )
    ranked = with_rank(rows.withColumnRenamed("ord", "t"), ["kpi_id"], ["t"]).drop("t")
    chunks = ranked.groupBy(F.expr(S.sql_chunk(5_000))).count().collect()
    assert [c["count"] for c in chunks] == [5_000] * 4
    few = S.outliers(ranked, chunk_points=5_000).collect()
    assert [(r.ord, r.value) for r in few] == [(12_345, 505.0)]
    assert S.step_changes(ranked, chunk_points=5_000).count() == S.step_changes(ranked).count()


def test_points_without_position_come_first(spark):
    rows = [(1, None, "z", "5", 5.0), (1, 0, "a", "10", 10.0), (1, -7, "b", "2", 2.0)]
    df = spark.createDataFrame(rows, SERIES)
    steps = [(r.from_period, r.to_period) for r in S.step_changes(df, chunk_points=2).collect()]
    assert sorted(steps) == [("b", "a"), ("z", "b")]


def test_prompts_hold_a_bounded_number_of_comments_for_any_ids(spark):
    rows = [(i, f"c{i}") for i in range(-49, 50)] + [(None, f"n{i:03}") for i in range(120)]
    rows += [(7, "again"), (10**15, None)]
    df = spark.createDataFrame(rows, "comment_id long, comment string")
    got = prompts.survey_prompt_batches(df, comments_per_prompt=50).orderBy("batch_id").collect()
    assert [(r.batch_id, r.n_comments) for r in got] == [(0, 50), (1, 50), (2, 50), (3, 50), (4, 21)]
    assert "1. n000\n2. n001\n" in got[0].prompt and "50. n049\n" in got[0].prompt
    assert "20. n119\n21. c-49\n" in got[2].prompt


def test_the_shown_series_is_chosen_once_for_card_and_points(registry, series):
    rows = registry({}, {}, {}, {})
    report = series([1, 2], [], [7])
    parsed = series([9, 9, 9], [3, "x", 4], [5, 6], [8])
    facts = {r.kpi_id: r for r in review.resolved_facts(rows, report, parsed).collect()}
    shown = review.series_fallback(rows, report, parsed).collect()
    for kpi, fact in facts.items():
        own = sorted((r.ord, r.value, r.origin, r.is_synthetic) for r in shown if r.kpi_id == kpi)
        numbers = [v for _, v, _, _ in own if v is not None]
        assert {(o, s) for _, _, o, s in own} == {(fact.origin, fact.is_synthetic)}
        assert (fact.n_points, fact.latest_value) == (len(own), numbers[-1])
        assert (fact.min_value, fact.max_value) == (min(numbers), max(numbers))
    assert [facts[k].origin for k in (1, 2, 3, 4)] == ["report", "parsed", "placeholder", "placeholder"]
    assert facts[4].n_points == len(V.PLACEHOLDER_SERIES)


def final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_stored_series_is_read_once(spark, tmp_path):
    path = str(tmp_path / "series")
    spark.range(5_000).selectExpr(
        "id % 7 AS kpi_id", "id AS ord", "concat('p', id) AS period", "cast(id % 13 AS string) AS value_raw",
        "if(id % 13 = 5, NULL, cast(id % 13 AS double)) AS value",
    ).write.parquet(path)
    stored = spark.read.parquet(path)
    for operator in (S.outliers, S.step_changes, S.anomalies, S.chart_points, S.quality_rollup):
        plan = final_plan(operator(stored))
        assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
        if operator in (S.outliers, S.step_changes, S.anomalies, S.quality_rollup):
            assert "SortAggregate" not in plan
    placed = final_plan(with_position(stored.drop("ord"), ["kpi_id"], ["period"], ["value_raw"]))
    assert placed.count("FileScan") == 1


def test_candidate_series_are_read_once_each(spark, registry, tmp_path):
    paths = [str(tmp_path / name) for name in ("first", "second")]
    for path in paths:
        spark.range(50).selectExpr(
            "id % 3 + 1 AS kpi_id", "id AS ord", "'p' AS period", "'1' AS value_raw", "1D AS value"
        ).write.parquet(path)
    first, second = (spark.read.parquet(path) for path in paths)
    plan = final_plan(review.series_fallback(registry({}, {}, {}), first, second))
    assert plan.count("FileScan") == 2
    assert final_plan(review.resolved_facts(registry({}), first, second)).count("FileScan") == 2
