"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams in order of frequency. A document's own most
frequent n-grams are compared to each profile: every n-gram adds how far its rank is out of place
in the profile, and one the profile lacks adds the most. The nearest profile names the language.

N-grams are taken inside words, which are runs of letters in lower case with a mark on either side.
Counts cover the whole text. Profiles are learned in Spark from at most ``per_language`` documents
of each language, chosen by the hash of their key; all of a chosen document's text counts. A text
that is null or has no letters is ``und`` with score 0, as is any text when nothing was learned.
Ties go to the language whose name sorts first. Repeated rows are judged one by one; other columns
are carried along, columns named like the results are replaced.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.tables import text_batches, trimmed

WORD = re.compile(r"[^\W\d_]+")
SIZES = (1, 2, 3)
PROFILE = 300


def word_grams(word: str, sizes=SIZES) -> list[str]:
    marked = f"_{word}_"
    return [
        g
        for n in sizes
        for i in range(len(marked) - n + 1)
        if (g := marked[i : i + n]) != "_"
    ]


class Grams:
    """Numbers for n-grams, and the n-grams of words seen before, within a limit of memory.

    Numbers are local to a task; ``order`` holds each n-gram's characters as one integer, so that
    ties are broken alike everywhere.
    """

    def __init__(self, profiles=None, words: int = 150_000, grams: int = 300_000, size: int = PROFILE):
        self.profiles, self.size = profiles or {}, size
        self.words, self.grams = words, grams
        self.clear()

    def clear(self):
        self.known, self.number, self.names = {}, {}, []
        self.order = np.zeros(4096, np.int64)
        # A gram that a profile lacks is ``size`` out of place wherever it stands.
        self.ranks = np.full((len(self.profiles), 4096), -1, np.int64)

    def of(self, word: str) -> np.ndarray:
        found = []
        for g in word_grams(word):
            k = self.number.get(g)
            if k is None:
                k = self.number[g] = len(self.names)
                self.names.append(g)
                if k == len(self.order):
                    self.order = np.concatenate([self.order, np.zeros_like(self.order)])
                    self.ranks = np.concatenate([self.ranks, np.full_like(self.ranks, -1)], axis=1)
                code = 0
                for c in g.ljust(max(SIZES), chr(0)):
                    code = code << 21 | ord(c)
                self.order[k] = code
                for i, ranks in enumerate(self.profiles.values()):
                    self.ranks[i, k] = ranks.get(g, -1)
            found.append(k)
        return np.array(found, np.int64)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the n-grams of a whole text, and how often each occurs."""
        if len(self.names) > self.grams:
            self.clear()
        known, arrays, times, sizes = self.known, [], [], []
        for word, n in Counter(WORD.findall(text.lower())).items():
            a = known.get(word)
            if a is None:
                a = self.of(word)
                if len(known) >= self.words:
                    known.clear()
                if len(word) <= 30:
                    known[word] = a
            arrays.append(a)
            times.append(n)
            sizes.append(len(a))
        if not arrays:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        every = np.bincount(np.concatenate(arrays), np.repeat(times, sizes), len(self.names))
        present = np.flatnonzero(every)
        return present, every[present].astype(np.int64)

    def top(self, text: str) -> np.ndarray:
        """The most frequent n-grams of a text, in order; ties by their characters."""
        present, n = self.counts(text)
        if len(n) > self.size:
            least = np.partition(n, len(n) - self.size)[len(n) - self.size]
            present, n = present[n >= least], n[n >= least]
        return present[np.lexsort((self.order[present], -n))][: self.size]

    def nearest(self, text: str | None) -> tuple[str, float]:
        """(language, score): 1 if all ranks agree with the profile's, 0 if none is in it."""
        top = self.top(text) if text and self.profiles else ()
        if not len(top):
            return "und", 0.0
        ranks = self.ranks[:, top]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(far.argmin())  # profiles are in order of their names
        return list(self.profiles)[best], 1 - int(far[best]) / (self.size * len(top))


def learn(
    docs: DataFrame,
    language: str = "lang",
    text: str = "text",
    key: str = "doc_id",
    per_language: int = 1_000,
    size: int = PROFILE,
) -> dict[str, dict[str, int]]:
    """Profiles {language: {n-gram: rank}} from rows with a non-null language and text."""
    rows = docs.select(key, language, text).where(
        F.col(language).isNotNull() & F.col(text).isNotNull()
    )
    order = [F.xxhash64(key), F.col(key)]

    def first(found, *groups):
        ranks = F.row_number().over(Window.partitionBy(language, *groups).orderBy(*order))
        return found.withColumn("__n", ranks).where(F.col("__n") <= per_language)

    # The first of each of many parts of a language, then the first of those: no task sees a
    # language whole.
    parts = F.pmod(F.xxhash64(key, F.lit("part")), F.lit(64))
    chosen = first(first(rows.select(key, language).distinct(), parts)).select(key, language)
    # per_language keys a language: the broadcast is bounded by the number of languages.
    sampled = rows.join(F.broadcast(chosen), [key, language], "left_semi")

    def counted(batches):
        grams = Grams()
        for languages, texts in text_batches(batches, [language, text]):
            sums: dict = {}
            for name, t in zip(languages, texts):
                numbers, n = grams.counts(t)
                total = sums.setdefault(name, Counter())
                for k, x in zip(numbers.tolist(), n.tolist()):
                    total[grams.names[k]] += x
            out = [(name, g, n) for name, c in sums.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                ["language", "gram", "n"],
            )

    totals = (
        sampled.mapInArrow(trimmed(counted), "language string, gram string, n long")
        .groupBy("language", "gram")
        .agg(F.sum("n").alias("n"))
    )
    ranked = totals.withColumn(
        "rank", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    ).where(F.col("rank") <= size)
    profiles: dict[str, dict[str, int]] = {}
    for r in ranked.collect():  # size rows a language
        profiles.setdefault(r["language"], {})[r["gram"]] = r["rank"] - 1
    return dict(sorted(profiles.items()))


def identify(docs: DataFrame, profiles, text: str = "text", size: int = PROFILE) -> DataFrame:
    """The documents with ``lang_pred`` and ``score``."""
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def judged(batches):
        grams = Grams(profiles, size=size)
        for b in batches:
            found = [grams.nearest(t.as_py()) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                [*b.schema.names, "lang_pred", "score"],
            )

    return kept.mapInArrow(trimmed(judged), schema)
