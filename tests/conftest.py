import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from plumbline.schema import REGISTRY, SERIES  # noqa: E402
from plumbline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        master="local[4]",
        shuffle_partitions=4,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# The worked example.
RETENTION = {
    "kpi_id": 1,
    "name": "First-Year Retention Rate",
    "definition": "Percentage of first-time, full-time degree-seeking undergraduates"
    " who return for the following fall term",
    "formula": "Returning FTFT Students / FTFT Cohort",
    "time_period": "Fall-to-fall, annually",
    "primary_source_system": "IPEDS",
    "secondary_source_systems": ["SIS"],
    "intended_audience": "Board of Trustees",
    "identifier_fields": ["student_id"],
    "source_systems_in_join": ["IPEDS"],
    "data_owner": "Registrar",
    "data_steward": "Institutional Research",
    "known_limitations": "COVID-era cohorts may show atypical patterns;"
    " census date timing affects counts",
    "bias_or_equity_risks": "Retention rates vary by demographic segment;"
    " monitor equity gaps by race/ethnicity and income level",
    "human_signoff_required": True,
}
RETENTION_POINTS = [
    ("Fall 2018", 88.0),
    ("Fall 2019", 89.5),
    ("Fall 2020", 88.5),
    ("Fall 2021", 89.0),
    ("Fall 2022", 89.5),
    ("Fall 2023", 91.0),
]


@pytest.fixture
def registry(spark):
    """Registry rows that differ from the retention KPI in the fields given."""

    def build(*changes):
        rows = [{**RETENTION, "kpi_id": i, **change} for i, change in enumerate(changes, start=1)]
        return spark.createDataFrame(
            [tuple(row[name] for name in REGISTRY.names) for row in rows], REGISTRY
        )

    return build


def _number(value):
    if value is None or isinstance(value, str):
        return None
    return float(value)


@pytest.fixture
def series(spark):
    """Series from lists of values; texts stay unread."""

    def build(*lists, labels=None):
        rows = [
            (
                kpi,
                position,
                labels[position] if labels else f"P{position}",
                None if value is None else str(value),
                _number(value),
            )
            for kpi, values in enumerate(lists, start=1)
            for position, value in enumerate(values)
        ]
        return spark.createDataFrame(rows, SERIES)

    return build


@pytest.fixture
def retention_series(spark):
    rows = [
        (1, position, period, str(value), value)
        for position, (period, value) in enumerate(RETENTION_POINTS)
    ]
    return spark.createDataFrame(rows, SERIES)
