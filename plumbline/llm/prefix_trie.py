"""The prefix trie of conversations, screened by a count-min sketch of prefix digests.

A node of depth d is a distinct sequence of first d turns. Its digest is the exclusive or of the
hashes of (position, turn), 128 bits, so digests of all prefixes are running sums that long
conversations take in chunks. All digests are counted into a count-min sketch, a table a task,
merged block by block. A count is never too low, so an estimate of one proves that one conversation
alone has the prefix: such tails are nodes as they stand and are written out where they are read.
Only prefixes that may be shared are shuffled and grouped by their digest.

Sums over subtrees need no walk by levels. A conversation saves its text at the nodes of which it is
not the smallest member, and these are the top of its path; so a node's saving is the sum over its
members of what their paths save from the node on. Leaves are counted by their smallest members.

The sketch has four counters a prefix up to ``MOST_COUNTERS`` a row. Beyond that it screens less and
more prefixes are grouped; results are the same. Member lists are hashed in ascending order as a
stream of chunks of joined ids, so no list of members is ever held.

Turns are ordered by ``turn``, null first; ties by the digest of role and text. Null roles and texts
are empty. Repeated rows are turns of their own. Rows without a conversation id take no part. An
empty table has no nodes. Other columns play no part.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import with_position
from plumbline.llm.tables import crc32_sql, stored

CHUNK = 1_024  # turns of a conversation that a window adds up
IDS = 4_096  # range of conversation ids joined into one text
SKETCH_ROWS = 3
LEAST_COUNTERS = 1 << 12
MOST_COUNTERS = 1 << 26  # of a row; the screen that is broadcast has a bit for each
SKETCH_BLOCK = 1 << 14
KEY = ["k1", "k2"]
COLUMNS = [
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
]


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv, pos, turn_hash, chars): the turns of each conversation numbered from 0.

    Rows are dealt by ranges of the whole order and numbered within ranges, so a conversation of
    any length spreads over tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("turn_hash"),
        F.length(text).cast("long").alias("chars"),
    )
    dealt = stored(
        slim.repartitionByRange("conv", "turn", "turn_hash").withColumn("part", F.spark_partition_id()),
        "dealt-turns",
    )
    placed = with_position(dealt, ["conv"], ["part"], ["turn", "turn_hash"], "pos")
    return stored(placed.select("conv", "pos", "turn_hash", "chars"), "turns")


def with_shared_heads(turns: DataFrame, every: int = 100, classes: int = 6) -> DataFrame:
    """The turns rebuilt: each conversation begins with the head of the first one of its hundred.

    Its own turns follow after as many of them as the head may have: crc32 of the id modulo
    ``classes``.
    """
    most = classes - 1
    base = F.col("conv") - F.col("conv") % every
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % classes
    item = F.struct(F.col("pos").alias("pos"), F.col("turn_hash").alias("turn_hash"), F.col("chars").alias("chars"))
    heads = (
        turns.where((F.col("conv") % every == 0) & (F.col("pos") < most))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.sort_array(F.collect_list(item)).alias("head"))  # `most` turns at the most
    )
    joined = turns.withColumn("base", base).join(heads, "base", "left").withColumn("h", h.cast("int"))
    none = F.expr("cast(array() as array<struct<pos: bigint, turn_hash: binary, chars: bigint>>)")
    head = F.when(F.col("pos") == 0, F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))).otherwise(none)
    behind = F.least(F.col("h"), F.size(F.coalesce("head", none)))
    own = F.when(
        F.col("pos") >= F.col("h"),
        F.array(
            F.struct((behind + F.col("pos") - F.col("h")).cast("long").alias("pos"), F.col("turn_hash"), F.col("chars"))
        ),
    ).otherwise(none)
    return joined.select("conv", F.explode(F.concat(head, own)).alias("turn")).select("conv", "turn.*")


def prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for every prefix: its digest, its parent's, the last turn's length and what is before it."""
    hashed = turns.select(
        "conv",
        "pos",
        "chars",
        F.expr(f"pos div {chunk}").alias("chunk"),
        F.xxhash64("pos", "turn_hash").alias("f1"),
        F.xxhash64("turn_hash", F.lit(1), "pos").alias("f2"),
    )
    totals = [F.bit_xor("f1").alias("c1"), F.bit_xor("f2").alias("c2"), F.sum("chars").alias("c_chars")]
    by_conv = Window.partitionBy("conv")
    earlier = by_conv.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        hashed.groupBy("conv", "chunk")
        .agg(*totals)
        .select(
            "conv",
            "chunk",
            *[F.bit_xor(c).over(earlier).alias(c) for c in ("c1", "c2")],
            F.sum("c_chars").over(earlier).alias("c_chars"),
            F.lead("chunk").over(by_conv.orderBy("chunk")).isNotNull().alias("goes_on"),
        )
        .where("chunk > 0 or goes_on")
    )
    inside = Window.partitionBy("conv", "chunk").orderBy("pos")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = hashed.select(
        "*",
        F.bit_xor("f1").over(running).alias("r1"),
        F.bit_xor("f2").over(running).alias("r2"),
        F.sum("chars").over(running).alias("r_chars"),
        F.lead("pos").over(inside).isNull().alias("ends_chunk"),
    ).join(carried, ["conv", "chunk"], "left")

    def whole(run: str, carry: str) -> Column:
        return F.col(run).bitwiseXOR(F.coalesce(carry, F.lit(0).cast("long")))

    return summed.select(
        "conv",
        (F.col("pos") + 1).alias("depth"),
        whole("r1", "c1").alias("k1"),
        whole("r2", "c2").alias("k2"),
        whole("r1", "c1").bitwiseXOR(F.col("f1")).alias("p1"),
        whole("r2", "c2").bitwiseXOR(F.col("f2")).alias("p2"),
        "chars",
        (F.col("r_chars") + F.coalesce("c_chars", F.lit(0)) - F.col("chars")).alias("before"),
        (F.col("ends_chunk") & ~F.coalesce("goes_on", F.lit(False))).alias("last"),
    )


def _cells(k1: np.ndarray, k2: np.ndarray, counters: int):
    """The counter of each digest in every row of the sketch."""
    a, b = k1.view(np.uint64), k2.view(np.uint64) | np.uint64(1)
    for row in range(SKETCH_ROWS):
        yield ((a + np.uint64(row) * b) & np.uint64(counters - 1)).astype(np.int64)


def _keys(batch: pa.RecordBatch, names) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def counters_for(n: int, most: int = MOST_COUNTERS) -> int:
    return min(most, max(LEAST_COUNTERS, 1 << math.ceil(math.log2(4 * max(1, n)))))


def sketch(rows: DataFrame, counters: int) -> np.ndarray:
    """For each counter of each row of the sketch whether it counted two digests or more, as bits."""
    block = min(SKETCH_BLOCK, counters)

    def counted(batches):
        table = np.zeros((SKETCH_ROWS, counters), np.uint8)
        for batch in batches:
            for row, cells in enumerate(_cells(*_keys(batch, KEY), counters)):
                own, n = np.unique(cells, return_counts=True)
                table[row, own] = np.minimum(table[row, own] + np.minimum(n, 2), 2)
        parts = table.reshape(-1, block)
        for k in np.flatnonzero(parts.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "counts": pa.array([parts[k].tobytes()])})

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, np.uint8)
        for counts in parts.counts:
            total = np.minimum(total + np.frombuffer(counts, np.uint8), 2)
        return pd.DataFrame({"block": parts.block.iloc[:1], "bits": [np.packbits(total > 1).tobytes()]})

    blocks = (
        rows.select(*KEY)
        .mapInArrow(counted, "block long, counts binary")
        .groupBy("block")
        .applyInPandas(merged, "block long, bits binary")
    )
    bits = np.zeros((SKETCH_ROWS * counters // block, block // 8), np.uint8)
    for found in blocks.toLocalIterator():
        bits[found.block] = np.frombuffer(found.bits, np.uint8)
    return bits.reshape(SKETCH_ROWS, -1)


def screened(rows: DataFrame, counters: int) -> DataFrame:
    """The prefixes with ``single`` and ``parent_single``: proven to have one member only."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch(rows, counters))

    def single(k1, k2):
        proven = np.zeros(len(k1), bool)
        for bits, cells in zip(shared.value, _cells(k1, k2, counters)):
            proven |= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 0
        return proven

    def judged(batches):
        for batch in batches:
            own = single(*_keys(batch, KEY))
            parent = single(*_keys(batch, ["p1", "p2"])) & (batch.column("depth").to_numpy() > 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array(parent)], [*batch.schema.names, "single", "parent_single"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(judged, f"{fields}, single boolean, parent_single boolean")


def member_digests(ends: DataFrame, ids: int = IDS) -> DataFrame:
    """(k1, k2, ends_sha256): the hash of each key's ids (k1, k2, conv), ascending and comma-joined."""
    parts = (
        ends.groupBy(*KEY, F.floor(F.col("conv") / ids).alias("range"))
        .agg(F.sort_array(F.collect_list("conv")).alias("list"))  # one range of ids at the most
        .select(*KEY, "range", F.array_join(F.col("list").cast("array<string>"), ",").alias("ids"))
    )

    def hashed(batches):
        key, digest = None, None
        for batch in batches:
            found = []
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if (k1, k2) == key:
                    digest.update(b"," + text.encode())
                    continue
                if key:
                    found.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256(text.encode())
            yield _digests(found)
        yield _digests([(*key, digest.hexdigest())] if key else [])

    dealt = parts.repartition(*KEY).sortWithinPartitions(*KEY, "range")
    return dealt.mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def _digests(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string()]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, [*KEY, "ends_sha256"])


def nodes(
    turns: DataFrame, convs: DataFrame, most_counters: int = MOST_COUNTERS, chunk: int = CHUNK, ids: int = IDS
) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, pos, turn_hash, chars) of all ``convs`` (conv).

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 of each node. ``convs`` are distinct; positions count from 0.
    """
    rows = stored(prefixes(turns, chunk), "prefixes")
    rows = stored(screened(rows, counters_for(rows.count(), most_counters)), "screened")
    single, maybe = rows.where("single"), rows.where("not single")

    same = [F.min(c).alias(c) for c in ("depth", "p1", "p2")]
    groups = stored(
        maybe.groupBy(*KEY).agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n_convs"), *same), "groups"
    )
    tops = single.where("not parent_single")
    of_parent = [F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = stored(
        groups.select(*of_parent).unionByName(tops.select(*of_parent)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children")),
        "children",
    )

    # What each conversation saves on its path, and whether it stands for a leaf.
    known = groups.join(children, KEY, "left").select(*KEY, "least", F.col("n_children").isNull().alias("childless"))
    first = F.col("least") == F.col("conv")
    on_path = maybe.join(known, KEY).select(
        "conv",
        F.when(first, 0).otherwise(F.col("chars")).alias("saves"),
        (F.col("last") & first & F.col("childless")).cast("int").alias("leaf"),
    )
    flat = [F.lit(0).cast("long").alias("saves"), F.lit(1).alias("leaf")]
    paths = stored(
        on_path.withColumn("turned", F.lit(1))
        .unionByName(single.where("last").select("conv", *flat, F.lit(1).alias("turned")))
        .unionByName(convs.select("conv", F.lit(0).cast("long").alias("saves"), F.lit(0).alias("leaf"), F.lit(0).alias("turned")))
        .groupBy("conv")
        .agg(F.sum("saves").alias("saves"), F.max("leaf").alias("leaf"), F.max("turned").alias("turned")),
        "paths",
    )
    left = F.greatest(F.lit(0).cast("long"), F.col("saves") - F.col("before"))
    below = (
        maybe.select("conv", *KEY, "before")
        .join(paths.select("conv", "saves", "leaf"), "conv")
        .groupBy(*KEY)
        .agg(F.sum("leaf").cast("long").alias("n_leaves"), F.sum(left).alias("saved_tokens"))
    )

    turnless = paths.where("turned = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv")
    digests = stored(member_digests(maybe.where("last").select(*KEY, "conv").unionByName(turnless), ids), "member-digests")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    ends = F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    count = F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")

    # The root is a node of its own: its digest is zero and no row carries it.
    at_root = (F.col("k1") == 0) & (F.col("k2") == 0)
    whole = paths.agg(
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum("leaf").cast("long").alias("leaves"),
        F.sum("saves").alias("saved_tokens"),
    )
    root = (
        whole.unionByName(children.where(at_root).select("n_children"), allowMissingColumns=True)
        .unionByName(digests.where(at_root).select("ends_sha256"), allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in (*whole.columns, "n_children", "ends_sha256")])
        .where("n_convs > 0")
        .select(
            "conv_id",
            F.lit(0).cast("long").alias("depth"),
            F.lit(None).cast("long").alias("parent_conv_id"),
            "n_convs",
            count,
            F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"),
            "saved_tokens",
            ends,
        )
    )
    smallest = F.lit(paths.agg(F.min("conv")).first()[0]).cast("long")

    parents = groups.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("above"))
    # A parent that is in no group was proven to have one member, which is the node's as well.
    parent = F.when(F.col("depth") == 1, smallest).otherwise(F.coalesce("above", "least")).alias("parent_conv_id")
    grouped = (
        groups.join(below, KEY)
        .join(children, KEY, "left")
        .join(digests, KEY, "left")
        .join(parents, ["p1", "p2"], "left")
        .select(F.col("least").alias("conv_id"), "depth", parent, "n_convs", count, "n_leaves", "saved_tokens", ends)
    )

    one = F.lit(1).cast("long")
    alone = [
        one.alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv").cast("string").cast("binary"), 256))
        .otherwise(nothing)
        .alias("ends_sha256"),
    ]
    conv = F.col("conv").alias("conv_id")
    heads = tops.withColumn("least", F.col("conv")).join(parents, ["p1", "p2"], "left").select(conv, "depth", parent, *alone)
    tails = single.where("parent_single").select(conv, "depth", F.col("conv").alias("parent_conv_id"), *alone)
    return tails.unionByName(heads).unionByName(grouped).unionByName(root).select(*COLUMNS)


def trie(conversations: DataFrame, **options) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turn, role, text) as they stand."""
    turns = ordered_turns(conversations)
    return nodes(turns, turns.where("pos = 0").select("conv"), **options)


def sql() -> str:
    """The query's result as DuckDB SQL: prefixes as texts of digests, subtrees by their beginning."""
    return f"""
WITH turns AS (
  SELECT conv_id AS c, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS turn_hash,
    length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT c, h, coalesce(n, 0) AS n
  FROM (SELECT c, c - c % 100 AS base, {crc32_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM turns))
  LEFT JOIN (SELECT c AS base, count(*) AS n FROM turns GROUP BY c) USING (base)
),
rebuilt AS (
  SELECT convs.c, pos, turn_hash, chars FROM convs JOIN turns ON turns.c = convs.c - convs.c % 100 AND pos < h
  UNION ALL
  SELECT c, pos - h + least(h, n) AS pos, turn_hash, chars FROM turns JOIN convs USING (c) WHERE pos >= h
),
paths AS (
  SELECT c, chars, string_agg(turn_hash, '') OVER (PARTITION BY c ORDER BY pos) AS k FROM rebuilt
  UNION ALL
  SELECT c, 0, '' FROM convs
),
wholes AS (SELECT c, arg_max(k, length(k)) AS k FROM paths GROUP BY c),
nodes AS (
  SELECT k, min(c) AS conv_id, length(k) // 32 AS depth, count(*) AS n_convs,
    (count(*) - 1) * min(chars) AS saves, substr(k, 1, length(k) - 32) AS above
  FROM paths GROUP BY k
),
children AS (SELECT above AS k, count(*) AS n_children FROM nodes WHERE k <> '' GROUP BY above),
full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (k)
),
sums AS (
  SELECT u.k, count(*) FILTER (v.n_children = 0) AS n_leaves, CAST(sum(v.saves) AS BIGINT) AS saved_tokens
  FROM full_nodes u JOIN full_nodes v ON starts_with(v.k, u.k) GROUP BY u.k
),
ends AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest FROM wholes GROUP BY k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens,
  coalesce(digest, sha256('')) AS ends_sha256
FROM full_nodes n JOIN sums USING (k)
LEFT JOIN nodes p ON p.k = n.above AND n.k <> ''
LEFT JOIN ends ON ends.k = n.k
"""
