"""Keyword classification of free-text comments."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.sources.scratch import stored

GRAM = 3  # letters of an entry of the keyword index


def category_of(lowered: Column, categories: dict[str, list[str]]) -> Column:
    """The first category, in dictionary order, one of whose keywords occurs in the text.

    A chain of tests compiled into the projection: no dictionary table, join or shuffle. A category
    without keywords takes no text.
    """
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for category, keywords in categories.items():
        if keywords:
            tests = [lowered.contains(keyword) for keyword in keywords]
            chain = chain.when(reduce(or_, tests), category)
    return chain


def categorize_comments(
    comments: DataFrame,
    categories: dict[str, list[str]] = V.COMMENT_CATEGORIES,
    column: str = "comment",
) -> DataFrame:
    """Add ``category``; NULL where no keyword occurs. Lower-cases each text once."""
    return (
        comments.withColumn("_lowered", F.lower(column))
        .withColumn("category", category_of(F.col("_lowered"), categories))
        .drop("_lowered")
    )


def _grams(text: Column, size: int) -> Column:
    """All distinct runs of ``size`` characters."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return F.array_distinct(runs)


def categorize_by_table(
    comments: DataFrame, keywords: DataFrame, column: str = "comment", gram: int = GRAM
) -> DataFrame:
    """Add ``category`` from a keyword table of any size (priority, category, keyword).

    An inverted index takes the place of testing every keyword on every text: each keyword is
    filed under that of its runs of ``gram`` characters which the fewest texts hold, texts meet
    the keywords of their runs in an equi-join, and what is met is confirmed on the whole text. The
    least priority wins, then the first category by name. Keywords shorter than a run are filed
    under themselves; empty and NULL ones are left out, and NULL texts have no category.
    """
    row = next(n for i in range(len(comments.columns) + 1) if (n := f"row_{i}") not in comments.columns)
    rows = stored(comments.withColumn(row, F.monotonically_increasing_id()), "numbered-comments")
    texts = rows.select(F.col(row).alias("row"), F.lower(column).alias("text")).where("text IS NOT NULL")
    table = stored(keywords.where("keyword <> ''").select("priority", "category", "keyword"), "keywords")

    sizes = range(1, gram + 1)
    of_keyword = [F.when(F.least(F.length("keyword"), F.lit(gram)) == n, _grams(F.col("keyword"), n)) for n in sizes]
    filed = table.select("keyword", F.explode(F.coalesce(*of_keyword)).alias("run")).distinct()
    wanted = stored(filed.select("run").distinct(), "keyword-runs")
    # Runs of the lengths that keywords have; those of no keyword go no further than the semi-join.
    lengths = [r["n"] for r in wanted.select(F.length("run").alias("n")).distinct().collect()]
    found = texts.select("row", F.explode(F.flatten(F.array(*[_grams(F.col("text"), n) for n in sorted(lengths)]))).alias("run")) if lengths else texts.select("row", F.lit("").alias("run")).where("false")
    met = stored(found.join(wanted, "run", "left_semi"), "text-runs")
    frequency = met.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        filed.join(frequency, "run")
        .groupBy("keyword")
        .agg(F.min(F.struct("n", "run")).alias("best"), F.count(F.lit(1)).alias("held"))
        # A keyword one of whose runs no text holds is in no text.
        .join(filed.groupBy("keyword").agg(F.count(F.lit(1)).alias("runs")), "keyword")
        .where("held = runs")
        .select("keyword", F.col("best.run").alias("run"))
    )
    candidates = met.join(rarest, "run").select("row", "keyword")
    confirmed = candidates.join(texts, "row").where(F.contains("text", "keyword")).select("row", "keyword")
    first = (
        confirmed.join(table, "keyword")
        .groupBy("row")
        .agg(F.min(F.struct("priority", "category")).alias("first"))
        .select(F.col("row").alias(row), F.col("first.category").alias("category"))
    )
    return rows.drop("category").join(first, row, "left").drop(row)


def comment_category_counts(categorized: DataFrame) -> DataFrame:
    """Comments per category, the uncategorized, and the totals with the whole percentage."""
    # Counted per category first: the roll-up then only sees one row per category.
    per_category = categorized.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count("category").alias("found")
    )
    counts = per_category.rollup("category").agg(
        F.sum("n").alias("comments"),
        F.sum("found").alias("categorized"),
        F.grouping("category").alias("is_total"),
    )
    label = (
        F.when(F.col("is_total") == 1, "TOTAL")
        .when(F.col("category").isNull(), "UNCATEGORIZED")
        .otherwise(F.col("category"))
    )
    share = F.try_divide(F.col("categorized"), F.col("comments")) * 100
    return counts.select(
        label.alias("category"),
        "comments",
        F.when(F.col("is_total") == 1, share.cast("int")).alias("categorized_percent"),
    )
