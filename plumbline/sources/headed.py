"""CSV files whose columns are found by the header of each file.

Spark reads a set of files by the header of the first and takes the columns of all others by
position. Here the header line of every file is looked at first, files are grouped by it, each group
is read on its own, and the groups are put together by column name.
"""

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GLOB = set("*?[{")


def _first_lines(batches):
    """The first line of the split that a task reads, and no more of it."""
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def header_lines(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """The files of each distinct first line; empty files have none.

    Every split is a task that ends at its first line, so this reads next to nothing. What comes to
    the driver is a path a file, which the listing of files holds there anyway.
    """
    # A session of its own for the split settings: a split to a task, files never cut finely.
    probe = spark.newSession()
    for key in ("maxPartitionBytes", "openCostInBytes"):
        probe.conf.set(f"spark.sql.files.{key}", "128m")
    probe.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    lines = probe.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    first = lines.mapInArrow(_first_lines, "value string, file string, start long").where("start = 0")
    files = defaultdict(list)
    for row in first.toLocalIterator():
        files[row["value"]].append(row["file"])
    return {header: sorted(files[header]) for header in sorted(files)}


def read_headed_csv(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Rows of CSV files with a header each; columns are matched by name, absent ones are NULL.

    A header is one line. Names are matched without regard to case, as Spark resolves them. Files
    keep their partition columns where ``path`` is one folder.
    """
    reader = spark.read.options(header=True, **options)
    found = header_lines(spark, path)
    if len(found) < 2:
        return reader.csv(path)
    if isinstance(path, str) and not _GLOB & set(path):
        reader = reader.option("basePath", path)
    groups = [reader.csv(files) for files in found.values()]
    rows = groups[0]
    for group in groups[1:]:
        rows = rows.unionByName(group, allowMissingColumns=True)
    return rows
