"""From stored model responses to readiness reports, as one plan with a branch for what is rejected.

A request passes through the choice of its first valid attempt, the test for required fields and the
people's gate. What falls out on the way is kept with the reason; what passes becomes a registry and
its series, where a file may take the place of the points a description held.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.operators.responses import first_valid_attempt
from plumbline.operators.review import gated
from plumbline.plans import report
from plumbline.schema import PARSED_KPI
from plumbline.sources.registry import registry_of, series_of, with_parsed_defaults
from plumbline.sources.scratch import stored

# Where a request's series comes from.
OWN, FILE, NONE = "description", "file", "none"

NO_RESPONSE = "no valid response"
NOT_CONFIRMED = "not confirmed"


class Intake(NamedTuple):
    """What an intake run comes to."""

    registry: DataFrame  # accepted records
    series: DataFrame  # their series
    rejected: DataFrame  # kpi_id, attempts_seen, reason
    requests: DataFrame  # every request: kpi_id, attempt, attempts_seen, data_option, reason


def judged_requests(
    responses: DataFrame, approvals: DataFrame, options: DataFrame, max_attempts: int = V.MAX_ATTEMPTS
) -> DataFrame:
    """One row per request with its record and, if it goes no further, the reason.

    The first reason in the order of the stages counts. ``options`` (kpi_id, data_option) says where
    the series is to come from; a request without one keeps its own points.
    """
    chosen = first_valid_attempt(responses, max_attempts).select(
        F.col("request_id").alias("kpi_id"),
        "attempt",
        "attempts_seen",
        F.from_json("body", PARSED_KPI).alias("parsed"),
    )
    source = options.groupBy("kpi_id").agg(F.min("data_option").alias("data_option"))
    absent = F.filter(
        F.array(*[F.when(F.col(f"parsed.{f}").isNull(), F.lit(f)) for f in V.REQUIRED_JSON_FIELDS]),
        lambda field: field.isNotNull(),
    )
    return (
        gated(chosen, approvals)
        .join(source, "kpi_id", "left")
        .withColumns(
            {
                "data_option": F.coalesce("data_option", F.lit(OWN)),
                "reason": F.when(F.col("attempt").isNull(), NO_RESPONSE)
                .when(F.size(absent) > 0, F.concat(F.lit("lacks "), F.array_join(absent, ", ")))
                .when(~F.col("is_approved"), NOT_CONFIRMED),
            }
        )
        .drop("is_approved")
    )


def intake(
    responses: DataFrame,
    approvals: DataFrame,
    file_series: DataFrame,
    options: DataFrame,
    max_attempts: int = V.MAX_ATTEMPTS,
) -> Intake:
    """Accepted records with their series beside the rejected requests.

    The judged requests are stored once, so that responses are parsed once for all branches. A
    request that names a file without points has no series, and its own points do not come back.
    """
    judged = stored(judged_requests(responses, approvals, options, max_attempts), "judged-requests")
    records = judged.where("reason IS NULL")
    fields = [F.col("kpi_id")] + [
        F.col(f"parsed.{name}").alias(name) for name in PARSED_KPI.names if name != "kpi_id"
    ]
    parsed = with_parsed_defaults(records.select(*fields))
    own = with_parsed_defaults(records.where(F.col("data_option") == OWN).select(*fields))
    from_file = records.where(F.col("data_option") == FILE).select("kpi_id")
    columns = ["kpi_id", "ord", "period", "value_raw", "value"]
    series = series_of(own).select(*columns).unionByName(
        file_series.join(from_file, "kpi_id", "left_semi").select(*columns)
    )
    requests = judged.drop("parsed")
    rejected = requests.where("reason IS NOT NULL").select("kpi_id", "attempts_seen", "reason")
    return Intake(registry_of(parsed), series, rejected, requests)


def intake_report(found: Intake, **options) -> DataFrame:
    """One row per request: the outcome of the checks, or why it never came to them."""
    assessed = report.assess(found.registry, found.series, **options).select(
        "kpi_id",
        F.col("name").alias("kpi_name"),
        "n_points",
        "anomaly_count",
        "readiness_status",
        F.array_join("blockers", "; ").alias("blockers"),
    )
    return found.requests.join(assessed, "kpi_id", "left").select(
        "kpi_id",
        F.when(F.col("reason").isNull(), "reported").otherwise("rejected").alias("outcome"),
        "reason",
        "attempt",
        "attempts_seen",
        "data_option",
        "kpi_name",
        "n_points",
        "anomaly_count",
        "readiness_status",
        "blockers",
    )
