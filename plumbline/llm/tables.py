"""Reading the supplied tables, and cutting a plan with a stored table."""

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.scratch import scratch_path

CODEC = "zstd"  # of stored tables: less disk for texts than by Spark's default


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared scratch folder and read back.

    What reads the result no longer depends on the tasks that made it, so an executor that is
    lost later costs nothing, and rows are in the same files for every reader.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, column: str, parts: int) -> DataFrame:
    """The rows stored like ``stored``, in files dealt by a column.

    What groups the result by that column reads its files as they are, without a shuffle. The table's
    name is known to this session only; its files are in the shared folder.
    """
    path = scratch_path(df.sparkSession, name)
    table = f"{name}_{path.split('/')[-2]}".replace("-", "_")
    df.write.bucketBy(parts, column).option("path", path).option("compression", CODEC).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def trimmed(work):
    """A task function over batches that gives its memory back to the system when it ends.

    Python workers are kept for later tasks, and what an allocator keeps for reuse in one of them is
    lost to the others of an executor.
    """

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def whole_text(column: str = "text") -> Column:
    """The text of a row; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(columns: list[str], *stems: str) -> list[str]:
    """Column names beginning like the stems that none of the columns has, whatever the case."""
    taken = {c.lower() for c in columns}
    return [next(n for i in range(len(taken) + 1) if (n := f"{stem}_{i}") not in taken) for stem in stems]


def crc_class(column: str, modulus: int) -> Column:
    """crc32 of a column's text form, modulo; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes as a DuckDB expression, a bit at a time."""
    byte = f"CAST(('0x' || substr(hex(encode({text})), 2 * i - 1, 2)) AS BIGINT)"
    steps = f"[{byte}, -1, -1, -1, -1, -1, -1, -1, -1]"
    values = f"flatten(list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {steps}))"
    step = "CASE WHEN v >= 0 THEN xor(acc, v) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END"
    return f"xor(list_reduce({values}, lambda acc, v: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def text_batches(batches, columns, limit_chars: int = 4_000_000):
    """Rows of Arrow batches as lists of Python values, at most about limit_chars of text at a time.

    The last of ``columns`` is the text.
    """
    for batch in batches:
        index = [batch.schema.get_field_index(c) for c in columns]
        texts = batch.column(index[-1])
        start, size = 0, 0
        lengths = [len(t) if (t := s.as_buffer()) is not None else 0 for s in texts] if len(texts) else []
        for i, n in enumerate(lengths):
            if size and size + n > limit_chars:
                part = batch.slice(start, i - start)
                yield [part.column(k).to_pylist() for k in index]
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            part = batch.slice(start)
            yield [part.column(k).to_pylist() for k in index]
