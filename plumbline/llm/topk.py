"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights, one term a component. Candidates and queries are dealt
into blocks of bounded size; every candidate block meets every query block in one task. There the
candidates become postings: for each term, the candidates that have it and their weights. Terms
are taken one at a time, each query that has the term scattering its weight times the postings into
a dense score array. Partition selection picks the best of a block for each query, and the blocks'
winners are merged. Every score is computed; nothing is pruned or capped.

Vectors that are null, or hold components that are null or not finite once scaled, take no part; an
empty vector scores 0 with every other. Components beyond the shorter of two vectors count as absent. A query's own row
is every row of its id. A repeated query row is answered once for each repetition, a repeated
candidate row is found as often as it stands. Rows without an id take no part. Ties go to the
smaller id. Blocks whose scores may exceed 64 bits are added up in whole numbers of any size, and rows
are ranked by these; a score beyond 64 bits is returned as the nearest number that has them.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import stored

BLOCK = 1_024  # candidates of a block
QUERY_BLOCK = 1_024  # queries of a block


def weights(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component: whole numbers, held as doubles as they may be any size."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    # What has no fraction bits left is whole as it is.
    return F.transform(
        F.col(vector),
        lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)),
    )


def usable(vector: str, scale: float = 1.0) -> Column:
    """Whether a vector is there and all of its components are finite numbers, scaled too."""

    def finite(x):
        scaled = F.lit(float(scale)) * x.cast("double")
        return x.isNotNull() & ~F.isnan(scaled) & (F.abs(scaled) < float("inf"))

    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, finite), F.lit(False))


def accumulate(queries: list, candidates: list) -> np.ndarray:
    """Scores of all candidates (rows) for all queries (columns), one term at a time."""
    terms = max([len(w) for w in queries] + [len(w) for w in candidates] + [0])

    def dense(rows):
        table = np.zeros((len(rows), terms))
        for i, w in enumerate(rows):
            table[i, : len(w)] = w
        return table

    q, c = dense(queries), dense(candidates)
    largest = lambda x: int(np.abs(x).max(initial=0))
    bound = largest(q) * largest(c) * terms
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    if kind is object:
        q, c = (np.array([[int(x) for x in row] for row in t], object).reshape(t.shape) for t in (q, c))
    else:
        q, c = q.astype(np.int64), c.astype(np.int64)
    scores = np.zeros((len(candidates), len(queries)), kind)
    for t in range(terms):
        posting = np.flatnonzero(c[:, t])
        asking = np.flatnonzero(q[:, t])
        if not len(posting) or not len(asking):
            continue
        given = c[posting, t].astype(kind)[:, None] * q[asking, t].astype(kind)[None, :]
        if len(posting) == len(candidates) and len(asking) == len(queries):
            scores += given
        elif len(asking) == len(queries):
            scores[posting] += given
        else:
            scores[np.ix_(posting, asking)] += given
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own, k: int):
    """Positions of the k best of each column, best first, ties to the smaller id.

    ``ids`` are in ascending order. Candidates of the query's own id are left out.
    """
    for j, me in enumerate(own):
        column = scores[:, j]
        lo, hi = np.searchsorted(ids, me), np.searchsorted(ids, me, side="right")
        rest = np.concatenate([np.arange(lo), np.arange(hi, len(ids))]) if hi > lo else np.arange(len(ids))
        if len(rest) > k:
            values = column[rest]
            least = np.partition(values, len(values) - k)[len(values) - k]
            above = rest[values > least]
            level = rest[values == least][: k - len(above)]
            rest = np.concatenate([above, level])
        if column.dtype == object:
            yield j, np.array(sorted(rest, key=lambda i: (-column[i], ids[i])), np.int64)
        else:
            yield j, rest[np.lexsort((ids[rest], -column[rest].astype(np.int64)))]


def ranked(score: int) -> str:
    """A text that sorts like the number, of any size up to 9,998 digits."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + "".join(str(9 - int(d)) for d in digits)


def _held(score: int) -> tuple[int, str]:
    """The number as 64 bits hold it, and a text that ranks it among those they cannot hold."""
    held = max(-(2**63), min(2**63 - 1, score))
    return held, "" if -(2**63) < score < 2**63 - 1 else ranked(score)


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank from 1, key, score): the k rows of highest score for every query row."""
    vectors = stored(
        rows.where(usable(vector, scale) & F.col(key).isNotNull()).select(
            F.col(key).cast("long").alias("id"),
            weights(vector, scale).alias("w"),
            is_query.alias("q"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "weights",
    )
    n, nq = vectors.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(nq / query_block))
    # By the row's number, so that rows alike in id and vector are dealt out like any others.
    place = lambda count, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")
    candidates = vectors.select(
        "id",
        "w",
        place(blocks, 1).alias("c_block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q_block"),
    )
    queries = vectors.where("q").select(
        "id",
        "w",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c_block"),
        place(query_blocks, 2).alias("q_block"),
    )

    def best(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(given):
            asked = asked.assign(t=asked.w.map(tuple)).sort_values(["id", "t"]).reset_index(drop=True)
            given = given.sort_values("id")
            ids = given.id.to_numpy()
            block_of = int(asked.q_block.iloc[0])
            candidates = list(given.w)
            for lo in range(0, len(asked), 256):
                part = asked.iloc[lo : lo + 256]
                scores = accumulate(list(part.w), candidates)
                for j, rows in select(scores, ids, part.id, k):
                    found += [
                        (block_of, lo + j, int(part.id.iloc[j]), int(ids[i]), *_held(int(scores[i, j]))) for i in rows
                    ]
        return pd.DataFrame(found, columns=["q_block", "q_row", "query_id", "id", "score", "beyond"])

    winners = (
        queries.groupBy("c_block", "q_block")
        .cogroup(candidates.groupBy("c_block", "q_block"))
        .applyInPandas(best, "q_block int, q_row int, query_id long, id long, score long, beyond string")
    )
    # ``beyond`` ranks the scores that 64 bits cannot hold; of the others it is empty.
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), F.desc("beyond"), "id")
    return (
        winners.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(key), "score")
    )


def sql(k: int = 5, scale: int = 256, every: int = 50) -> str:
    return f"""
WITH valid AS (
  SELECT vec_id, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
terms AS (
  SELECT vec_id, CAST(unnest(w) AS BIGINT) AS weight, unnest(range(len(w))) AS term FROM valid
),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.weight * c.weight) AS score
  FROM terms q JOIN terms c USING (term)
  WHERE q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id
  GROUP BY ALL
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
)
WHERE rank <= {k}
"""
