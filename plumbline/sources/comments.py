"""Survey comments from JSON records, with the sample comments as stand-in."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.schema import SURVEY_FILE


def read_survey_files(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = False,
    missing_as_sample: bool = False,
) -> DataFrame:
    """Records with a mode (real, sample or skip) and a list of comments.

    An unreadable record keeps its row with an empty mode, which then counts as sample. So does
    a path that does not exist, if ``missing_as_sample`` is set.
    """
    try:
        return spark.read.schema(SURVEY_FILE).option("multiLine", multi_line).json(path)
    except AnalysisException as error:
        if not (missing_as_sample and error.getCondition() == "PATH_NOT_FOUND"):
            raise
        return spark.range(1).select(
            *[F.lit(None).cast(field.dataType).alias(field.name) for field in SURVEY_FILE]
        )


def survey_comments(surveys: DataFrame) -> DataFrame:
    """One row per comment. Real surveys give their own comments; a skipped survey gives none;
    every other survey, and a real one without comments, gives the sample."""
    own = (F.col("mode") == "real") & (F.size("comments") > 0)
    skipped = F.coalesce(F.col("mode") == "skip", F.lit(False))
    uses_own = F.coalesce(own, F.lit(False))
    sample = F.array(*[F.lit(comment) for comment in V.SAMPLE_COMMENTS])
    return (
        surveys.where(~skipped)
        .select(
            "survey_id",
            (~uses_own).alias("is_sample"),
            F.posexplode(F.when(uses_own, F.col("comments")).otherwise(sample)).alias(
                "pos", "comment"
            ),
        )
        .select("survey_id", "is_sample", (F.col("pos") + 1).alias("comment_number"), "comment")
    )
