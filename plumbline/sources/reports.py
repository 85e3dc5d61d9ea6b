"""Writing reports and finding the latest ones again."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline import fixed_values as V
from plumbline.plans.report import batch_summary, report_json, summary_long
from plumbline.sources.scratch import stored


def write_report_json(
    assessed: DataFrame, path: str, mode: str = "errorifexists", by_name: bool = False
) -> StructType:
    """Nested reports as JSON lines. Returns the schema to read them back with.

    ``by_name`` writes a folder for each report under its path-safe name, ``output_name=...``; a
    reader of ``path`` gets the name back from the folder.
    """
    reports = report_json(assessed)
    writer = reports.repartition("output_name").write.partitionBy("output_name") if by_name else reports.write
    writer.mode(mode).json(path)
    return reports.schema


def write_anomalies_json(found: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The anomalies that belong to the reports, one JSON line each, keyed by kpi_id."""
    found.write.mode(mode).json(path)


def _write_csv(rows: DataFrame, path: str, mode: str) -> None:
    (
        rows.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_summary_csv(assessed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The executive summary of every KPI as CSV; lines keep their number."""
    _write_csv(summary_long(assessed), path, mode)


def write_batch_csv(assessed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The nine-column batch summary as CSV with its published header."""
    _write_csv(batch_summary(assessed).drop("kpi_id").toDF(*V.BATCH_HEADER), path, mode)


# Chosen reports that are sent to all tasks, at most: a path and a number each.
BROADCAST_REPORTS = 200_000


def scan_latest_reports(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    multi_line: bool = False,
    broadcast_reports: int = BROADCAST_REPORTS,
) -> DataFrame:
    """The newest report of each KPI among ``*_report.json`` files or folders.

    Names that start with ``test_`` are ignored. Newest is by modification time, then by path, then
    by a digest of the text, so the choice is settled; a text that stands twice in one file comes
    twice. Reports without a KPI id are left out.

    Two phases: the first reads the key of each report and where it stands, and picks the newest by
    an aggregation over those few columns; the second parses the chosen texts alone. Up to
    ``broadcast_reports`` choices are sent to the scan, so that no report is shuffled; more are joined.
    """
    texts = (
        spark.read.option("wholetext", multi_line)
        .text(f"{folder.rstrip('/')}/*_report.json")
        .select(
            "value",
            F.xxhash64("value").alias("digest"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
        .where(~F.col("path").rlike(r"/test_[^/]*_report\.json(/|$)"))
    )
    keyed = texts.select(
        F.get_json_object("value", "$.kpi_id").try_cast("bigint").alias("kpi_id"),
        F.struct("modified", "path", "digest").alias("place"),
    ).where("kpi_id IS NOT NULL")
    newest = stored(
        keyed.groupBy("kpi_id").agg(F.max("place").alias("place")).select("place.path", "place.digest"),
        "newest-reports",
    )
    wanted = F.broadcast(newest) if newest.count() <= broadcast_reports else newest
    chosen = texts.join(wanted, ["path", "digest"], "left_semi")
    return chosen.select(F.from_json("value", schema).alias("report")).select("report.*")
