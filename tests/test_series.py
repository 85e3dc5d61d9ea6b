"""Series screening against a plain statement of the rules, with any division into chunks."""

import math
from statistics import mean, pstdev

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.functions.numbers import to_number
from plumbline.operators import series as S
from plumbline.schema import SERIES
from pyspark.sql import functions as F


def expected_flags(values):
    """(position, kind) pairs for one series, straight from the rules."""
    numbers = [(i, v) for i, v in enumerate(values) if isinstance(v, float)]
    found = {(i, "NonNumeric") for i, v in enumerate(values) if not isinstance(v, float)}
    only = [v for _, v in numbers]
    if len(only) >= 3 and pstdev(only) > 0:
        m, s = mean(only), pstdev(only)
        found |= {(i, "Outlier") for i, v in numbers if abs((v - m) / s) >= 2.5}
    for (_, before), (i, v) in zip(numbers, numbers[1:]):
        if before != 0 and abs((v - before) / before) >= 0.25:
            found.add((i, "StepChange"))
    return found


def flags(series, **options):
    found = {}
    for row in S.anomalies(series, **options).collect():
        found.setdefault(row.kpi_id, set()).add((row.ord, row.type))
    return found


SPIKE_8 = [0.0] * 7 + [1.0]
SPIKE_7 = [0.0] * 6 + [1.0]


def test_outlier_needs_eight_points(series):
    found = S.outliers(series(SPIKE_8, SPIKE_7)).collect()
    assert [(row.kpi_id, row.ord, row.z_score) for row in found] == [(1, 7, 2.65)]


def test_step_change_bounds_and_bridging(series):
    rows = S.step_changes(
        series(
            [100, 125],  # exactly a quarter
            [100, 124.9],
            [0, 50, 60],  # no change from a zero base
            [-100, -50],  # negative base
            [100, "n/a", None, 200],  # bridges over unread points
        )
    ).collect()
    got = sorted((r.kpi_id, r.from_period, r.to_period, r.pct_change) for r in rows)
    assert got == [(1, "P0", "P1", 25.0), (4, "P0", "P1", -50.0), (5, "P0", "P3", 100.0)]


@pytest.mark.parametrize("chunk_points", [1, 2, 3, 100_000])
def test_chunks_do_not_change_the_result(series, chunk_points):
    lists = [
        [],
        [5.0],
        [5.0, 5.0, 5.0],
        ["x"],
        [10.0, "x", "y", "z", 20.0, None, 21.0],
        [1.0] * 9 + [50.0] + [1.0] * 9,
        [0.1] * 7,
        [100.0, 130.0, 90.0, "?", 91.0, 200.0, 0.0, 5.0, 7.0],
    ]
    table = series(*lists)
    got = flags(table, chunk_points=chunk_points)
    assert got == {k: f for k, v in enumerate(lists, 1) if (f := expected_flags(v))}
    roll = {r.kpi_id: r for r in S.quality_rollup(table, chunk_points=chunk_points).collect()}
    stats = {r.kpi_id: r for r in S.series_stats(table).collect()}
    assert roll.keys() == stats.keys() == set(range(2, len(lists) + 1))
    for k, row in roll.items():
        numbers = [v for v in lists[k - 1] if isinstance(v, float)]
        assert (row.n_points, row.n_numeric) == (len(lists[k - 1]), len(numbers))
        if numbers:
            assert row.mean == pytest.approx(mean(numbers), rel=1e-12)
            assert row.stdev == pytest.approx(pstdev(numbers), rel=1e-9, abs=1e-12)
            assert stats[k].stdev == pytest.approx(row.stdev, rel=1e-9, abs=1e-12)
            assert row.latest_value == numbers[-1]
    assert roll[7].stdev == 0.0  # a constant series, whatever its rounding


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.lists(
            st.one_of(st.integers(-5, 40).map(float), st.sampled_from(["n/a", None])), max_size=14
        ),
        min_size=1,
        max_size=6,
    ),
    st.integers(1, 6),
)
def test_any_series(spark, lists, chunk_points):
    rows = [
        (k, i, f"P{i}", None if v is None else str(v), v if isinstance(v, float) else None)
        for k, values in enumerate(lists, 1)
        for i, v in enumerate(values)
    ]
    table = spark.createDataFrame(rows, SERIES)
    expected = {k: f for k, v in enumerate(lists, 1) if (f := expected_flags(v))}
    # Values are whole numbers: leave out the rare case that hits a threshold exactly.
    for values in lists:
        only = [v for v in values if isinstance(v, float)]
        if len(only) >= 3 and pstdev(only) > 0:
            zs = [abs((v - mean(only)) / pstdev(only)) for v in only]
            if any(abs(z - 2.5) < 1e-9 for z in zs):
                return
    assert flags(table, chunk_points=chunk_points) == expected


def test_one_hot_series_spreads_over_tasks(spark):
    """A third of all points in one series: its chunks must not meet in one partition."""
    hot = spark.range(0, 4000).selectExpr("0L AS kpi_id", "id AS ord")
    rest = spark.range(0, 8000).selectExpr("1 + id % 800 AS kpi_id", "id div 800 AS ord")
    table = hot.unionByName(rest).selectExpr(
        "kpi_id",
        "ord",
        "concat('P', ord) AS period",
        "cast(ord AS string) AS value_raw",
        "cast(100 + ord % 7 + if(ord = 777, 900, 0) AS double) AS value",
    )
    whole = S.screen_points(table).where("is_outlier OR is_step_change")
    split = S.screen_points(table, chunk_points=100).where("is_outlier OR is_step_change")
    columns = ["kpi_id", "ord", "from_period", "is_outlier", "is_step_change"]
    assert sorted(whole.select(columns).collect()) == sorted(split.select(columns).collect())
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(kpi_id" in plan and "chunk" in plan
    # The window over points is partitioned by chunk as well, so no task sorts a whole series.
    spread = (
        table.selectExpr("kpi_id", "ord div 100 AS chunk")
        .where("kpi_id = 0")
        .repartition(4, "kpi_id", "chunk")
        .select(F.spark_partition_id().alias("p"))
        .groupBy("p")
        .count()
        .collect()
    )
    assert len(spread) == 4


def test_nan_and_infinity_raise_no_flag(spark):
    nan, inf = float("nan"), float("inf")
    values = [1.0, nan, 1.0, 1.0, inf, 1.0]
    rows = [(1, i, f"P{i}", str(v), v) for i, v in enumerate(values)]
    found = S.anomalies(spark.createDataFrame(rows, SERIES)).collect()
    assert [(r.ord, r.type) for r in found] == [(4, "StepChange")]  # a jump to infinity


def test_reading_numbers(spark):
    texts = [
        "1.5", " 2 ", "1e3", "-.5", "5.", "+3", "1_000", "inf", "NaN",
        "1.0d", "1f", "0x1p3", "", "n/a", None, "1 2", "12,5",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", to_number(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got[:8] == [1.5, 2.0, 1000.0, -0.5, 5.0, 3.0, 1000.0, math.inf]
    assert math.isnan(got[8])
    assert got[9:] == [None] * 8


def test_kpis_without_points_stay(registry, series):
    rows = S.registry_left_series(registry({}, {}), series([1, 9])).orderBy("kpi_id").collect()
    assert [(r.n_points, r.anomaly_count, r.quality_status) for r in rows] == [
        (2, 1, "Needs Human Review"),
        (0, 0, "Pass"),
    ]


def test_rollup_counts_match_the_long_table(series):
    table = series([1, "x", 5, 5, 5, 5, 5, 5, 5, 99], [2, 2, 4, None])
    rolled = S.quality_rollup(table).collect()
    long = S.anomalies(table).groupBy("kpi_id").count().collect()
    assert {r.kpi_id: r["count"] for r in long} == {
        r.kpi_id: r.non_numeric_count + r.outlier_count + r.step_change_count for r in rolled
    }


def test_chart_marks_the_first_point_of_a_label(series):
    table = series([100, 100, 200, 100], labels=["A", "B", "A", "C"])
    by_label = S.chart_points(table).orderBy("ord").collect()
    assert [(r.period, r.step_marks, r.pct_change) for r in by_label] == [
        ("A", 1, 100.0), ("B", 0, None), ("A", 0, None), ("C", 1, -50.0),
    ]
    by_position = S.chart_points(table, match="position").orderBy("ord").collect()
    assert [r.step_marks for r in by_position] == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        S.chart_points(table, match="nearest")


def test_spread_tests(series):
    rows = S.series_spread(
        series(
            [70, 100],  # too few to assess
            [70, 100, 100],  # a range of exactly 0.3 x maximum is not below it
            [71, 100, 100],
            [0, 0, 0],
            [-5, -5, -6],
            [100, 100, 100.5],
            ["x", "y", "z"],
        )
    ).orderBy("kpi_id").collect()
    assert [r.stable_range for r in rows] == [None, False, True, False, False, True, None]
    assert [r.has_variation for r in rows] == [False, True, True, False, False, False, False]
