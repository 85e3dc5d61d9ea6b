"""Spelling variants of a corpus's words by a bit-sliced position index.

The index holds, for each (position, letter), the set of vocabulary words with that letter there, as
bits of machine words. A word is looked up letter by letter for the whole vocabulary at once: the
set of words without an error so far is cut down by the letter's set at the same position, and the
sets with one error follow it, replaced letters at the same position, inserted and deleted ones at
the position shifted by one. What is left at the end are the words exactly one edit away.

Words of six letters or more that differ by one edit share their first three or their last three
letters, so Spark deals the vocabulary by these two keys and a task indexes one key's words. A key
with more than ``BLOCK`` words is cut into blocks and every block of words meets every block of
questions, so no task holds more than two blocks whatever the vocabulary. A pair that shares both
keys counts under the first one. No pairs are emitted: a task returns for each word how many near
words it has and the best of them, and these are added up.

Null and empty texts have no words. Repeated rows count as often as they stand; a null id counts as
an empty one in the hash that deletes letters. Among near words of equal count the smallest in
code-point order is the form. Other columns of the input play no part.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import jumped
from plumbline.llm.tables import crc32_sql, stored, text_batches, trimmed

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5  # how much more frequent a word's form must be
DROP_CLASS = 199
KEY = 3  # letters of a key; one edit leaves one of two such ends whole if 2 * KEY <= LEAST_LENGTH
BLOCK = 4_096  # words of an index
FLUSH = 200_000  # distinct words counted in a task before they are handed on
CELLS = 1 << 18  # machine words worked on at once

RUN = re.compile("[a-zÀ-ÿ]+")


def text_words(doc_id, text: str | None):
    """(word, occurrences) of a text's runs of letters, those that the hash picks less one letter."""
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    runs = RUN.findall(lowered) if len(lowered) < 4_000_000 else (m[0] for m in RUN.finditer(lowered))
    own = "" if doc_id is None else doc_id
    for word, n in Counter(runs).items():
        h = zlib.crc32(f"{own}:{word}".encode())
        if h % DROP_CLASS == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        yield word, n


def vocabulary(
    docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LEAST_LENGTH, count: int = LEAST_COUNT
) -> DataFrame:
    """(word, n) of all words long and frequent enough over all texts."""

    def counted(batches):
        found = Counter()
        for ids, texts in text_batches(batches, [key, text]):
            for doc_id, value in zip(ids, texts):
                for word, n in text_words(doc_id, value):
                    if len(word) >= length:
                        found[word] += n
                if len(found) >= FLUSH:
                    yield _batch(found)
                    found = Counter()
        yield _batch(found)

    partial = docs.select(key, text).mapInArrow(trimmed(counted), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def _batch(found: Counter) -> pa.RecordBatch:
    columns = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n"])


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


class PositionIndex:
    """Bit sets of equally long words by (position, letter). A word's bit is its place in the list."""

    def __init__(self, words: list[str]):
        self.size, self.length = len(words), len(words[0])
        self.width = (self.size + 63) // 64
        codes = _codes(words, self.length)
        slots = np.arange(self.length, dtype=np.int64) * 256 + codes
        self.slots, place = np.unique(slots, return_inverse=True)
        bit = np.left_shift(np.uint64(1), np.arange(self.size, dtype=np.uint64) % np.uint64(64))
        # One more set stays empty: that of letters no word has at a position.
        self.sets = np.zeros((len(self.slots) + 1, self.width), np.uint64)
        column = np.arange(self.size) // 64
        np.bitwise_or.at(
            self.sets,
            (place.reshape(codes.shape).ravel(), np.repeat(column, self.length)),
            np.repeat(bit, self.length),
        )
        self.all = np.zeros(self.width, np.uint64)
        np.bitwise_or.at(self.all, column, bit)

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """The sets of words with these letters at a position, one row a letter."""
        if not 0 <= position < self.length:
            return self.sets[np.full(len(letters), len(self.slots))]
        slot = position * 256 + letters.astype(np.int64)
        place = np.searchsorted(self.slots, slot)
        known = self.slots[np.minimum(place, len(self.slots) - 1)] == slot
        return self.sets[np.where(known, place, len(self.slots))]

    def near(self, codes: np.ndarray, other_start: int = 0) -> np.ndarray:
        """Bit sets of the words one edit away from each row of ``codes``.

        Words that share the first ``other_start`` letters are left out.
        """
        length, shift = codes.shape[1], self.length - codes.shape[1]
        exact = np.repeat(self.all[None, :], len(codes), axis=0)
        one = np.zeros_like(exact)
        same_start = None
        for i in range(length):
            if i == other_start and other_start:
                same_start = exact.copy()
            here = self.at(i, codes[:, i])
            if shift == 0:  # a letter replaced
                one = (one & here) | (exact & ~here)
            elif shift == 1:  # a letter more in the indexed word
                one = (one | exact) & self.at(i + 1, codes[:, i])
            else:  # a letter less
                one = (one & self.at(i - 1, codes[:, i])) | exact
            exact &= here
        if shift == 1:
            one |= exact
        return one if same_start is None else one & ~same_start


def lookup(words: list[str], counts: list[int], asked: list[str], other_start: int = 0):
    """(word, near words, count of the best, the best) for asked words that have near words."""
    order = sorted(range(len(words)), key=lambda j: (-counts[j], words[j]))
    by_length, questions = {}, {}
    for j in order:
        by_length.setdefault(len(words[j]), []).append(j)
    for word in asked:
        questions.setdefault(len(word), []).append(word)
    indexes = {m: PositionIndex([words[j] for j in own]) for m, own in by_length.items()}
    for length, group in questions.items():
        near = [m for m in (length - 1, length, length + 1) if m in indexes]
        step = max(1, CELLS // max([indexes[m].width for m in near], default=1))
        for lo in range(0, len(group), step):
            part = group[lo : lo + step]
            codes = _codes(part, length)
            total, best = np.zeros(len(part), np.int64), [None] * len(part)
            for m in near:
                found = indexes[m].near(codes, other_start)
                total += np.bitwise_count(found).sum(axis=1, dtype=np.int64)
                some = found != 0
                for k in np.flatnonzero(some.any(axis=1)):
                    at = int(some[k].argmax())
                    low = int(found[k, at])
                    j = by_length[m][at * 64 + (low & -low).bit_length() - 1]
                    candidate = (-counts[j], words[j])
                    best[k] = candidate if best[k] is None else min(best[k], candidate)
            for word, n, found in zip(part, total.tolist(), best):
                if found:
                    yield word, n, -found[0], found[1]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) for words (word, n) that have words one edit away."""
    ends = F.explode(
        F.array(
            F.struct(F.lit(0).alias("end"), F.substring("word", 1, KEY).alias("key")),
            F.struct(F.lit(1).alias("end"), F.substring("word", -KEY, KEY).alias("key")),
        )
    )
    dealt = words.select("word", "n", ends.alias("at")).select("word", "n", "at.end", "at.key")
    blocks = dealt.groupBy("end", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    # A word is indexed in one row of the grid of blocks and asked in one column of it.
    cells = F.expr(
        "flatten(transform(sequence(0, blocks - 1), j -> if(j = own,"
        " array(named_struct('row', own, 'col', own, 'held', true, 'asks', true)),"
        " array(named_struct('row', own, 'col', j, 'held', true, 'asks', false),"
        " named_struct('row', j, 'col', own, 'held', false, 'asks', true)))))"
    )
    grid = (
        dealt.join(blocks, ["end", "key"])
        .withColumn("own", own)
        .select("word", "n", "end", "key", F.explode(cells).alias("cell"))
        .select("word", "n", "end", "key", "cell.*")
    )

    def looked_up(rows: pd.DataFrame) -> pd.DataFrame:
        held = rows[rows.held]
        found = lookup(
            held.word.tolist(),
            held.n.tolist(),
            rows.word[rows.asks].tolist(),
            KEY if rows.end.iloc[0] else 0,
        )
        return pd.DataFrame(list(found), columns=["word", "n_near", "best_n", "best"])

    partial = grid.groupBy("end", "key", "row", "col").applyInPandas(
        looked_up, "word string, n_near long, best_n long, best string"
    )
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return (
        partial.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), first.alias("first"))
        .select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")
    )


def variants(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    length: int = LEAST_LENGTH,
    count: int = LEAST_COUNT,
    ratio: int = RATIO,
    block: int = BLOCK,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary of ``docs``.

    ``form`` is the most frequent near word if it is at least ``ratio`` times as frequent, ``root``
    the last word that forms lead to.
    """
    if length < 2 * KEY or ratio < 2:
        raise ValueError(f"words need {2 * KEY} letters at least, and forms must be more frequent")
    words = stored(vocabulary(docs, text, key, length, count), "vocabulary")
    formed = F.col("best_n") >= ratio * F.col("n")
    judged = stored(
        words.join(near_words(words, block), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best")).alias("form"),
            F.when(formed, F.col("best_n")).alias("form_n"),
        ),
        "near-words",
    )
    pointers = judged.where("form is not null").select(F.col("word").alias("a"), F.col("form").alias("root"))
    roots = jumped(pointers).select(F.col("a").alias("word"), "root")
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def sql() -> str:
    """The query's result as DuckDB SQL: words that share a form with one letter less."""
    return rf"""
WITH RECURSIVE texts AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS own,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
),
runs AS (
  SELECT own, word, count(*) AS n
  FROM (SELECT own, unnest(regexp_extract_all(t, '[a-zÀ-ÿ]+')) AS word FROM texts)
  GROUP BY own, word
),
hashed AS (
  SELECT word, n, {crc32_sql("own || ':' || word")} AS h FROM runs
),
spelled AS (
  SELECT n, CASE WHEN h % {DROP_CLASS} = 0
    THEN substr(word, 1, CAST(h % length(word) AS INT)) || substr(word, CAST(h % length(word) AS INT) + 2)
    ELSE word END AS word
  FROM hashed
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
),
shorter AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n
  FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION
  SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word
),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n
  FROM pairs GROUP BY word
),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN best_n >= {RATIO} * n THEN best END AS form,
    CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
followed AS (
  SELECT word, word AS here, 0 AS steps FROM formed
  UNION ALL
  SELECT followed.word, formed.form, steps + 1
  FROM followed JOIN formed ON followed.here = formed.word WHERE formed.form IS NOT NULL
),
roots AS (SELECT word, arg_max(here, steps) AS root FROM followed GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
