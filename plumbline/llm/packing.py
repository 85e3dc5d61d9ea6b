"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenized and cut into pieces; full pieces are sequences of their own. The others are
packed in bulk-synchronous rounds:

* gaps (open sequences) and pieces are range-sorted together by size, largest first, a gap before
  a piece of its size;
* a sweep matches every piece to its successor, the smallest gap that holds it. Sweeps run in all
  partitions at once: reading a gap as an opening and a piece as a closing bracket, a piece's gap is
  its matching bracket. Nesting depths are running sums, so each partition needs only two numbers
  of the partitions before it;
* of the pieces that want one gap, the larger has the first rank and gets it; the others find the
  next gap outwards, which the bracket structure gives them, or wait;
* matched gaps shrink, and the next round begins. When no gap holds any piece that is left, as many
  empty sequences are opened as those pieces need at least.

A round is one range shuffle and one shuffle by depth; its result is stored and carries on as the
next round's input. A depth holds at most two rows for each distinct size, however many pieces there
are. Rounds run until every piece is placed.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.tables import stored, trimmed
from plumbline.llm.word_bpe import WordBpe

CAPACITY = 2_048
END = 0


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(other columns, piece, start, length, ids): every document's tokens in pieces.

    ``ids`` holds little-endian unsigned 32-bit ids; a document ends with the id ``end``, so an
    empty or null text is one piece of one id. ``tokenizer`` is the path of the vocabulary.
    """
    kept = docs.drop("piece", "start", "length", "ids")
    names = [c for c in kept.columns if c != text]
    schema = T.StructType(
        [kept.schema[c] for c in names]
        + [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def cut(batches):
        bpe = WordBpe(tokenizer)
        last = end.to_bytes(4, "little")
        for b in batches:
            rows, number, ids = [], [], []
            for i, t in enumerate(b.column(text)):
                tokens = bpe.encode(t.as_py() or "") + last
                for k, lo in enumerate(range(0, len(tokens), 4 * capacity)):
                    rows.append(i)
                    number.append(k)
                    ids.append(tokens[lo : lo + 4 * capacity])
            taken, number = pa.array(rows, pa.int64()), np.array(number, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *[b.column(c).take(taken) for c in names],
                    pa.array(number),
                    pa.array(number.astype(np.int64) * capacity),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                [*names, "piece", "start", "length", "ids"],
            )

    return kept.mapInArrow(trimmed(cut), schema)


NONE = 1 << 40  # above any sum of brackets


def sweep(rows: DataFrame, partitions: int) -> DataFrame:
    """One round: every row of (is_gap, id, size) with its match, (other, other_size) or nulls."""
    order = [F.desc("size"), F.desc("is_gap"), F.asc("id")]
    ranged = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def sums(batches):
        """Sums of brackets within a partition, and the least sum up to a row and before it."""
        total, low, at = 0, NONE, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            run = total + np.cumsum(np.where(np.array(b.column("is_gap").to_pylist()), 1, -1))
            lows = np.minimum.accumulate(np.append(low, run))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(run), pa.array(lows[1:]), pa.array(lows[:-1]), pa.array(np.arange(at, at + n))],
                [*b.schema.names, "run", "low", "low_before", "at"],
            )
            total, low, at = int(run[-1]), int(lows[-1]), at + n

    added = [T.StructField(c, T.LongType()) for c in ("run", "low", "low_before", "at")]
    # Stored, so that which row is in which partition is settled.
    summed = stored(
        ranged.mapInArrow(sums, T.StructType([*rows.schema.fields, *added])).withColumn(
            "part", F.spark_partition_id()
        ),
        "sweep",
    )
    # Two numbers a partition come to the driver, and what lies before each partition goes back.
    ends = summed.groupBy("part").agg(F.max_by("run", "at").alias("run"), F.min("low").alias("low"))
    before, total, low = [], 0, 0
    for p in sorted(ends.collect(), key=lambda r: r["part"]):
        before.append((p["part"], total, low))
        low, total = min(low, total + p["low"]), total + p["run"]
    bases = summed.sparkSession.createDataFrame(before or [(0, 0, 0)], "part int, base long, floor long")
    based = summed.join(F.broadcast(bases), "part")  # as many rows as partitions
    floor = F.least("floor", F.col("base") + F.col("low"))
    floor_before = F.least("floor", F.col("base") + F.col("low_before"))
    depth = F.col("base") + F.col("run") - floor
    # A gap opens its depth; a piece closes the one above, unless it sinks the floor: then no gap
    # is left for it.
    levels = based.withColumn(
        "level",
        F.when(F.col("is_gap"), depth).when(floor == floor_before, depth + 1),
    )
    by_level = Window.partitionBy("level").orderBy("part", "at")
    other = lambda c: F.when(F.col("is_gap"), F.lead(c).over(by_level)).otherwise(F.lag(c).over(by_level))
    matched = levels.where("level IS NOT NULL").select(
        "is_gap", "id", "size", other("id").alias("other"), other("size").alias("other_size")
    )
    loose = levels.where("level IS NULL").select(
        "is_gap", "id", "size", F.lit(None).cast("long").alias("other"), F.lit(None).cast("long").alias("other_size")
    )
    return matched.unionByName(loose)


def best_fit(items: DataFrame, capacity: int = CAPACITY, rows_per_task: int = 100_000) -> DataFrame:
    """(id, sequence_id, offset) for every (id, size), ids distinct and 0 or more, sizes 1 to capacity.

    A full piece's sequence has the piece's id; others have negative ids.
    """
    spark = items.sparkSession
    full = items.where(F.col("size") == capacity).select(
        "id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    state = items.where(F.col("size") < capacity).select(F.lit(False).alias("is_gap"), "id", F.col("size").cast("long"))
    left = state.agg(
        F.count("*").alias("n"), F.sum("size").alias("tokens"), F.min("size").alias("least"),
        F.count(F.when(F.col("size") * 2 > capacity, 1)).alias("large"),
    ).first()
    placed, opened, gaps, fresh = [full], 0, 0, left["large"]
    stuck = True
    while left["n"]:
        if stuck:
            # At least so many sequences are needed for what is left: no gap holds any of it.
            more = max(fresh, math.ceil(left["tokens"] / capacity))
            new = spark.range(opened, opened + more).select(
                F.lit(True).alias("is_gap"), (-1 - F.col("id")).alias("id"), F.lit(capacity).cast("long").alias("size")
            )
            state, opened, gaps, fresh = state.where("NOT is_gap").unionByName(new), opened + more, more, 0
        tasks = max(1, math.ceil((left["n"] + gaps) / rows_per_task))
        found = stored(sweep(state, tasks), "round")
        placed.append(
            found.where("NOT is_gap AND other IS NOT NULL").select(
                "id", F.col("other").alias("sequence_id"), (capacity - F.col("other_size")).alias("offset")
            )
        )
        rest = F.when(~F.col("is_gap") & F.col("other").isNull(), F.col("size"))
        room = F.when(F.col("is_gap"), F.col("size") - F.coalesce("other_size", F.lit(0)))
        left = found.agg(
            F.count(rest).alias("n"), F.sum(rest).alias("tokens"), F.min(rest).alias("least"),
            F.count(room).alias("gaps"), F.max(room).alias("widest"),
        ).first()
        # With every gap too small for the least piece, the next sweep would match nothing.
        stuck, gaps = (left["widest"] or 0) < (left["least"] or 0), left["gaps"]
        size = F.when(F.col("is_gap"), room).otherwise(F.col("size"))
        # Gaps too small for anything that is left are closed.
        state = found.where("is_gap OR other IS NULL").select("is_gap", "id", size.alias("size")).where(
            ~F.col("is_gap") | (F.col("size") >= (left["least"] or 0))
        )
    result = placed[0]
    for more in placed[1:]:
        result = result.unionByName(more)
    return result


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces, any table with a ``length`` of 1 to capacity, with ``sequence_id`` and ``offset``.

    Within a sequence offsets follow one another without a gap, from 0. Repeated rows are pieces of
    their own.
    """
    kept = stored(
        cut.drop("sequence_id", "offset", "__id").withColumn("__id", F.monotonically_increasing_id()), "pieces"
    )
    placed = best_fit(kept.select(F.col("__id").alias("id"), F.col("length").alias("size")), capacity)
    return kept.join(placed.withColumnRenamed("id", "__id"), "__id").drop("__id")
