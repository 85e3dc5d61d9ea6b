"""Positions inside groups, without ever sorting a whole group in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.scratch import stored


def with_position(
    rows: DataFrame, group: list[str], bucket: list[str], order: list[str], name: str = "ord"
) -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by ``bucket`` then ``order``.

    A plain row_number over ``group`` would put a hot group into one task. Here rows are
    numbered within (group, bucket) and shifted by the number of rows in earlier buckets,
    which is a running sum over one small row per bucket. ``bucket`` must be the leading part
    of the sort order and small enough each to sort in a task, e.g. a label plus the number of
    the scan partition (bounded by the split size). Group and bucket must not be NULL.
    """
    groups, buckets, orders, columns = (
        ", ".join(f"`{c}`" for c in names) for names in (group, bucket, order, rows.columns)
    )
    keys = f"{groups}, {buckets}"
    # The rows are dealt once; a test of the row's number keeps Spark from computing them for each use.
    return rows.sparkSession.sql(
        f"""WITH dealt AS (
  SELECT /*+ REPARTITION({keys}) */ * FROM {{rows}} WHERE monotonically_increasing_id() >= 0
),
counts AS (SELECT {keys}, count(1) AS _rows FROM dealt GROUP BY {keys}),
offsets AS (
  SELECT {keys}, coalesce(sum(_rows) OVER (PARTITION BY {groups} ORDER BY {buckets}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _shift
  FROM counts
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {orders}) AS _row FROM dealt
)
SELECT {columns}, cast(_shift + _row - 1 AS bigint) AS `{name}`
FROM numbered JOIN offsets USING ({keys})""",
        rows=rows,
    )


def with_rank(rows: DataFrame, group: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """Add the 0-based rank of each row in its group by any sort key: a time, an id, a text.

    Rows are dealt by ranges of the whole order, which cuts a hot group into as many parts as its
    size asks for, and are stored with the number of their part; ranks are the positions inside a
    part plus the rows of the group's earlier parts. So ranks are dense whatever the gaps between
    keys. NULL keys come first; rows equal in all of ``order`` rank in any order. Rows with a NULL in
    ``group`` belong to no group and are left out; without a group all rows are one.
    """
    known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in group)) if group else rows
    dealt = known.repartitionByRange(*group, *order).withColumns(
        {"_part": F.spark_partition_id(), "_all": F.lit(0)}
    )
    placed = with_position(stored(dealt, "ranked"), group or ["_all"], ["_part"], order, name)
    return placed.select(*rows.columns, name)
