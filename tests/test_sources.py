"""Readers and writers on small files with the irregularities they must survive."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import RETENTION, RETENTION_POINTS
from plumbline import fixed_values as V
from plumbline.functions.ordering import with_position
from plumbline.operators.series import anomalies
from plumbline.plans import report as R
from plumbline.sources import comments as comment_source
from plumbline.sources import registry as registry_source
from plumbline.sources import reports as report_source
from plumbline.sources import series as series_source
from plumbline.sources.headed import header_lines, read_headed_csv
from plumbline.sources.scratch import scratch_path

HEADER = (
    "name,definition,formula,time_period,primary_source_system,secondary_source_systems,"
    "identifier_fields,source_systems_in_join,intended_audience,data_owner,data_steward,"
    "known_limitations,bias_or_equity_risks,human_signoff_required\n"
)


def test_registry_csv_reads_all_rows_and_quoting(spark, tmp_path):
    file = tmp_path / "registry.csv"
    file.write_text(
        HEADER
        + 'A,"Says ""so"", twice",a/b,Year,SIS,"x, y ,,",,"SIS,ERP",Board,O,S,"two\nlines",r,TRUE\n'
        + "B,,,,,,,,,,,,,yes\n",
        encoding="utf-8",
    )
    rows = registry_source.read_registry_csv(spark, str(file), multi_line=True)
    a, b = rows.orderBy("name").collect()
    assert a.definition == 'Says "so", twice'
    assert a.known_limitations == "two\nlines"
    assert a.secondary_source_systems == ["x", "y"] and a.identifier_fields == []
    assert a.source_systems_in_join == ["SIS", "ERP"] and a.human_signoff_required is True
    assert b.definition == "" and b.human_signoff_required is False
    assert a.kpi_id != b.kpi_id


def test_registry_csv_finds_columns_by_name(spark, tmp_path):
    file = tmp_path / "registry.csv"
    names = [n for n in HEADER.strip().split(",") if n not in V.LIST_FIELDS][::-1]
    file.write_text(",".join(["kpi_id"] + names) + "\n" + ",".join(["7"] + names) + "\n")
    row = registry_source.read_registry_csv(spark, str(file)).first()
    assert row.kpi_id == 7 and row.formula == "formula" and row.identifier_fields == []
    file.write_text("name\nA\n")
    with pytest.raises(ValueError, match="definition"):
        registry_source.read_registry_csv(spark, str(file))


def test_registries_in_different_column_orders(spark, tmp_path):
    names = HEADER.strip().split(",")
    short = [n for n in names if n not in V.LIST_FIELDS][::-1]
    (tmp_path / "a.csv").write_text("kpi_id," + HEADER + ",".join(["1"] + names) + "\n")
    (tmp_path / "b.csv").write_text(",".join(short + ["kpi_id"]) + "\n" + ",".join(short + ["2"]) + "\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("kpi_id," + HEADER)
    rows = registry_source.read_registry_csv(spark, str(tmp_path)).orderBy("kpi_id").collect()
    assert [(r.kpi_id, r.formula, r.data_steward) for r in rows] == [
        (1, "formula", "data_steward"), (2, "formula", "data_steward")
    ]
    assert [r.identifier_fields for r in rows] == [["identifier_fields"], []]


def test_headers_are_grouped_and_partition_columns_kept(spark, tmp_path):
    for i, header in enumerate(["a,b", "b,a", "a,b", "c,a"]):
        (tmp_path / f"part={i}").mkdir()
        (tmp_path / f"part={i}" / "x.csv").write_text(header + "\n" + header.replace(",", f"{i},") + f"{i}\n")
    found = header_lines(spark, str(tmp_path))
    assert {h: len(files) for h, files in found.items()} == {"a,b": 2, "b,a": 1, "c,a": 1}
    rows = read_headed_csv(spark, str(tmp_path)).orderBy("part").collect()
    assert [(r.part, r.a, r.b, r.c) for r in rows] == [
        (0, "a0", "b0", None), (1, "a1", "b1", None), (2, "a2", "b2", None), (3, "a3", None, "c3"),
    ]
    one = read_headed_csv(spark, [str(tmp_path / "part=1"), str(tmp_path / "part=0")])
    assert sorted((r.a, r.b) for r in one.collect()) == [("a0", "b0"), ("a1", "b1")]


def test_series_files_in_different_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("UNITID,YEAR,RET_PCF\n1,2020,88\n")
    (tmp_path / "b.csv").write_text("YEAR,RET_PCF,UNITID\n2021,89,1\n2020,70,2\n")
    rows = series_source.read_panel_csv(spark, str(tmp_path)).orderBy("kpi_id", "ord").collect()
    assert [(r.kpi_id, r.ord, r.period, r.value) for r in rows] == [
        (1, 0, "Fall 2020", 88.0), (1, 1, "Fall 2021", 89.0), (2, 0, "Fall 2020", 70.0)
    ]
    folder = tmp_path / "series"
    folder.mkdir()
    (folder / "a.csv").write_text("period,value\nP,1\n")
    (folder / "b.csv").write_text("value,note,period\n2,x,Q\n")
    rows = series_source.read_series_csv(spark, str(folder)).collect()
    assert sorted((r.period, r.value) for r in rows) == [("P", 1.0), ("Q", 2.0)]


def test_panel_csv(spark, tmp_path):
    file = tmp_path / "panel.csv"
    file.write_text(
        "YEAR,UNITID,RET_PCF\n2021,1,90\n2019,1,88\n2020,1,89\n2020,2,70\n2020.0,1,1\n"
        "2022,1,\n2022,one,5\n,1,5\n2022,,5\n2023,1\n2020,1,89.5\n"
    )
    rows = series_source.read_panel_csv(spark, str(file)).orderBy("kpi_id", "ord").collect()
    assert [(r.kpi_id, r.ord, r.period, r.value) for r in rows] == [
        (1, 0, "Fall 2019", 88.0),
        (1, 1, "Fall 2020", 89.0),
        (1, 2, "Fall 2020", 89.5),  # equal labels keep the order of the file
        (1, 3, "Fall 2021", 90.0),
        (2, 0, "Fall 2020", 70.0),
    ]
    one = series_source.read_panel_csv(
        spark, str(file), units=[2], period_format="AY {year}-x"
    ).collect()
    assert [(r.kpi_id, r.period) for r in one] == [(2, "AY 2020-x")]


def test_series_csv(spark, tmp_path):
    file = tmp_path / "series.csv"
    file.write_text("period,value\nB,1\nA,x\n,2\nA,3.5\nC\n")
    rows = series_source.read_series_csv(spark, str(file)).orderBy("ord").collect()
    assert [(r.period, r.value) for r in rows] == [("B", 1.0), ("", 2.0), ("A", 3.5)]


@pytest.mark.parametrize("header", ["", "term,rate\n"])
def test_positional_csv(spark, tmp_path, header):
    file = tmp_path / "series.csv"
    file.write_text(header + "F20,1\n F21 ,2,extra\n  ,3\nF22,bad\nF23\nF24,4\n")
    rows = series_source.read_positional_csv(spark, str(file)).orderBy("ord").collect()
    assert [(r.ord, r.period, r.value) for r in rows] == [
        (0, "F20", 1.0), (1, "F21", 2.0), (2, "F24", 4.0),
    ]


@pytest.mark.parametrize(
    "columns, expected",
    [
        (["a", "b"], ("a", "b")),
        (["Academic Year", "Rate"], ("Academic Year", "Rate")),
        (["Rate", "Fall Term"], ("Fall Term", "Rate")),
        (["term", "value", "pct"], ("term", "pct")),  # the last match wins
        (["when", "what"], ("when", "when")),  # the n of "when" makes it a value column
    ],
)
def test_header_resolution(columns, expected):
    assert series_source.resolve_columns(columns) == expected


def test_loosely_named_table(spark):
    table = spark.createDataFrame(
        [(1, " Fall 20 ", "1.5"), (2, "None", "2"), (3, "", "3"), (4, "x", "n/a"), (5, "y", "4")],
        "row int, `Entry Term` string, `Total Rate` string",
    )
    rows = series_source.resolve_series_columns(table, "row", F.col("row")).collect()
    assert [(r.kpi_id, r.period, r.value) for r in rows] == [(1, "Fall 20", 1.5), (5, "y", 4.0)]


def test_positions_match_a_plain_row_number(spark):
    rows = spark.range(0, 500).selectExpr("id % 3 AS g", "(id * 7919) % 50 AS b", "id AS o")
    got = with_position(rows, ["g"], ["b"], ["o"])
    expected = rows.selectExpr(
        "*", "cast(row_number() OVER (PARTITION BY g ORDER BY b, o) - 1 AS bigint) AS ord"
    )
    assert sorted(got.collect()) == sorted(expected.collect())


def test_parsed_kpi_json(spark, tmp_path):
    record = {k: v for k, v in RETENTION.items() if k != "kpi_id"}
    record["historical_aggregates"] = [
        {"period": period, "value": value} for period, value in RETENTION_POINTS
    ] + [{"period": "Fall 2024", "value": "n/a"}]
    bare = {k: record[k] for k in V.REQUIRED_JSON_FIELDS} | {"name": "Bare"}
    broken = {k: v for k, v in bare.items() if k != "formula"}
    file = tmp_path / "parsed.json"
    file.write_text("\n".join(json.dumps(r) for r in (record, bare, broken)))
    parsed = registry_source.read_parsed_kpi_json(spark, str(file))
    rows = {r.name: r for r in registry_source.registry_of(parsed).collect()}
    assert rows.keys() == {"First-Year Retention Rate", "Bare"}
    assert rows["Bare"].identifier_fields == [] and rows["Bare"].human_signoff_required is True
    points = registry_source.series_of(parsed).orderBy("ord").collect()
    assert [(p.period, p.value) for p in points[:6]] == RETENTION_POINTS
    assert (points[6].value_raw, points[6].value) == ("n/a", None)
    indented = tmp_path / "one.json"
    indented.write_text(json.dumps(record, indent=2))
    one = registry_source.read_parsed_kpi_json(spark, str(indented), multi_line=True)
    assert one.count() == 1


def test_reports_round_trip_and_latest_wins(spark, tmp_path, registry, series):
    rows = registry({"name": "A/B rate"}, {"name": "Other"})
    old = R.assess(rows, series([1, 9]))
    new = R.assess(rows, series([1, 1]))
    report_source.write_report_json(old, f"{tmp_path}/a_report.json")
    schema = report_source.write_report_json(new, f"{tmp_path}/b_report.json")
    report_source.write_report_json(old, f"{tmp_path}/test_c_report.json")
    report_source.write_report_json(old, f"{tmp_path}/ignored.json")
    found = report_source.scan_latest_reports(spark, str(tmp_path), schema)
    got = {r.kpi_name: r for r in found.collect()}
    assert {name: r.steps.step_4_quality.status for name, r in got.items()} == {
        "A/B rate": "Pass", "Other": "Pass",
    }
    assert got["A/B rate"].output_name == "A_B_rate_report"
    assert sorted(map(str, found.collect())) == sorted(map(str, R.report_json(new).collect()))


def test_summary_and_batch_csv(spark, tmp_path, registry, series):
    assessed = R.assess(registry({}, {"formula": 'say "x, y"'}), series([1, 1, 1]))
    report_source.write_summary_csv(assessed, f"{tmp_path}/summary")
    report_source.write_batch_csv(assessed, f"{tmp_path}/batch")
    lines = spark.read.csv(f"{tmp_path}/summary", header=True, escape='"').collect()
    formula = {r.kpi_id: r.value for r in lines if r.label == "Formula"}
    assert formula["2"] == 'say "x, y"'
    blockers = {r.kpi_id: r.value for r in lines if r.section == "BLOCKERS"}
    assert blockers == {"1": V.NO_BLOCKERS, "2": V.BLOCKER_DEFINITION}
    audience = {r.value for r in lines if r.label == "Intended Audience"}
    assert audience == {"Board of Trustees"}
    assert spark.read.csv(f"{tmp_path}/batch", header=True).columns == V.BATCH_HEADER


def test_anomalies_are_written_beside_the_reports(spark, tmp_path, series):
    found = anomalies(series([1, 9, "x"]))
    report_source.write_anomalies_json(found, f"{tmp_path}/anomalies")
    assert spark.read.json(f"{tmp_path}/anomalies").count() == 2


def test_survey_comment_modes(spark, tmp_path):
    file = tmp_path / "surveys.json"
    file.write_text(
        "\n".join(
            [
                '{"survey_id": 1, "mode": "real", "comments": ["b", "a"]}',
                '{"survey_id": 2, "mode": "real", "comments": []}',
                '{"survey_id": 3, "mode": "skip", "comments": ["x"]}',
                '{"survey_id": 4, "mode": "sample"}',
                '{"survey_id": 5}',
                "not json",
            ]
        )
    )
    rows = comment_source.survey_comments(
        comment_source.read_survey_files(spark, str(file))
    ).collect()
    own = [(r.comment_number, r.comment) for r in rows if not r.is_sample]
    assert own == [(1, "b"), (2, "a")]
    sample = {}
    for r in rows:
        if r.is_sample:
            sample.setdefault(r.survey_id, []).append(r.comment)
    assert sample == {i: V.SAMPLE_COMMENTS for i in (2, 4, 5, None)}


def test_missing_survey_file(spark, tmp_path):
    gone = f"{tmp_path}/gone.json"
    with pytest.raises(AnalysisException):
        comment_source.read_survey_files(spark, gone)
    surveys = comment_source.read_survey_files(spark, gone, missing_as_sample=True)
    rows = comment_source.survey_comments(surveys).collect()
    assert [r.comment for r in rows] == V.SAMPLE_COMMENTS and all(r.is_sample for r in rows)


def test_scratch_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(shared) and second.endswith("/x")
