"""A training-data pipeline over ``documents``: five stages, each written and read again.

Every stage works on all that its predecessor kept, and its decisions take effect: toxic documents
go, repeated lines and the documents made of nothing else go, one document of each near-duplicate
group stays, secrets are cut out of texts, and what is left is packed into sequences.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import lines, queries, secrets, simhash, toxicity
from plumbline.llm.tables import stored, table


def _counted(docs: DataFrame) -> DataFrame:
    """The documents with ``n_chars`` brought up to date, if there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, queries.toxicity_model(spark, sf_dir))
    return scored.where("predicted = 0").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(lines.without_repeats(docs)).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.redact(docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("secret_scans", cut_secrets),
    ("best_fit_packing", pack),
]

#: SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
