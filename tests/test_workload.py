"""Every registered query: against SQL, against the published counts, and its plan."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from plumbline import bindings as B
from plumbline import oracle, workload
from plumbline.operators import design as D
from plumbline.operators.series import registry_left_series
from plumbline.plans import report as R

DATA = "/root/testdata"
SMALL = f"{DATA}/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the supplied tables")

# Those of the optional subpackage have tests beside its own.
QUERIES = workload.QUERIES
SQL = oracle.statements()
SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    result = QUERIES[name](spark, SMALL)
    columns = sorted(result.columns)
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: SQL_TYPES[t] for c, t in result.dtypes} == types
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()
    got = [tuple(row[c] for c in columns) for row in result.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_the_entry_lists_every_query():
    assert workload.QUERIES.keys() <= entry_module.queries().keys()
    assert oracle.statements().items() <= entry_module.oracle_sql().items()


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 10


@pytest.mark.parametrize(
    "sf, kpis, clear, high, moderate, anomaly, complete, ready, achievable",
    [
        ("0.001", 10, 6, 3, 1, 8, 7, 2, 6),
        ("0.01", 100, 55, 20, 14, 59, 65, 15, 57),
        ("0.1", 1000, 546, 191, 143, 535, 659, 139, 683),
    ],
)
def test_known_counts(spark, sf, kpis, clear, high, moderate, anomaly, complete, ready, achievable):
    """Counts worked out beforehand for the supplier registry over complete years."""
    folder = f"{DATA}/sf{sf}"
    registry = B.supplier_registry(spark, folder)
    series = B.supplier_year_series(spark, folder, complete_years=True)
    got = R.readiness_report(R.assess(registry, series)).selectExpr(
        "count(1)",
        "count_if(definition_status = 'Clear')",
        "count_if(entity_risk_level = 'High')",
        "count_if(entity_risk_level = 'Moderate')",
        "count_if(anomaly_count > 0)",
        "count_if(governance_status = 'Complete')",
        "count_if(readiness_status = 'Ready for Dashboard Use')",
    ).first()
    assert tuple(got) == (kpis, clear, high, moderate, anomaly, complete, ready)
    stable = D.with_design(registry_left_series(registry, series))
    assert stable.where("is_achievable").count() == achievable


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


WRITES = {"scan_", "report_json_sink", "latest_report_scan", "batch_csv_sink", "summary_csv_sink", "anomalies_json_sink"}


@pytest.mark.parametrize(
    "name", sorted(n for n in QUERIES if not any(n.startswith(w) for w in WRITES))
)
def test_plans_are_distributed_and_native(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow", "InPandas"):
        assert unwanted not in plan
    # No window without a partition, which would move all rows into one task.
    assert "SinglePartition" not in plan or name in {"batch_counts", "criterion_prevalence"}


@pytest.mark.parametrize(
    "name",
    [
        "step1_register", "step2_definition", "step3_entity", "step5_ai_use", "step6_governance",
        "categorize_comments", "categorize_comments_default", "kpi_parse_prompts",
        "parse_survey_analysis", "survey_section_mart", "placeholder_series",
    ],
)
def test_row_wise_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, SMALL))


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["series_stats"](spark, SMALL))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate" in plan
    filtered = plan_of(B.supplier_year_series(spark, SMALL, complete_years=True))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in filtered


def test_a_derived_series_is_scanned_once(spark):
    """Both uses of a series in the screening share the exchange of its aggregation."""
    frame = QUERIES["outliers"](spark, SMALL)
    frame.collect()
    final = plan_of(frame).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_values_survive_at_full_precision(spark):
    rows = B.nation_year_panel(spark, SMALL).collect()
    assert all(math.isclose(r.total * 100, round(r.total * 100), abs_tol=1e-3) for r in rows)
