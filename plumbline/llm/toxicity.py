"""Toxicity: a factorization machine over hashed terms.

A text's terms are its lower-case words and their beginnings (prefixes), hashed into a fixed
number of buckets. Besides a weight for each bucket the machine learns a short vector for each;
the inner product of two vectors is the weight of the pair, so two harmless terms that are
harmful together, such as an insult and the mention of a group, are seen.

Fitting takes three steps: a bounded sample of labelled rows is drawn by hash, a Spark job
counts in how many rows of each class every bucket occurs, and the buckets that tell the classes
apart best become the machine's features. The sample's rows over those features are a small
matrix, on which the machine is fitted by gradient steps. Scoring is one pass over the texts
without a shuffle.

A null or empty text has no terms and gets the base rate's score. Repeated rows are scored one by
one; other columns are carried along, columns named like the results are replaced.
"""

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.tables import stored, text_batches, trimmed

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
BUCKETS = 1 << 20
#: Rows of either class that a model is fitted on, at most.
PER_CLASS = 3_000


def word_buckets(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and of its beginnings."""
    terms = [word + "$"] + [word[:n] for n in PREFIXES if len(word) > n]
    return [zlib.crc32(t.encode()) % buckets for t in terms]


class Model(NamedTuple):
    """Bounded by ``features`` and ``rank``."""

    index: dict  # bucket -> position of the feature
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, features) -> float:
        """Probability of the label, from the positions of the features present."""
        if len(features):
            v = self.vectors[features]
            s = v.sum(axis=0)
            z = self.bias + self.weights[features].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
        else:
            z = self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def sample_keys(rows: DataFrame, label: str, per_class: int = PER_CLASS, key: str = "doc_id") -> DataFrame:
    """(key, label): at most ``per_class`` distinct keys of either class, those of the smallest hash."""
    keys = rows.select(key, label).where(f"{label} IN (0, 1)").distinct()
    order = F.xxhash64(key)
    chosen = [
        keys.where(F.col(label) == y).orderBy(order, key).limit(per_class) for y in (0, 1)
    ]
    return chosen[0].union(chosen[1])


def sample(
    rows: DataFrame, label: str, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """At most ``per_class`` rows of either class, those of the smallest key hash.

    Keys are ranked first, and the few chosen (two times ``per_class``, the bound of the broadcast)
    meet the texts in a join. A key may stand on any number of rows: of what is found, the rows of
    the smallest hash of key and text stay, as many as were asked for.
    """
    picked = sample_keys(rows, label, per_class, key)
    met = rows.join(F.broadcast(picked), [key, label], "left_semi")
    order = [F.xxhash64(key), F.col(key), F.xxhash64(text)]
    drawn = [met.where(F.col(label) == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    return drawn[0].union(drawn[1])


def class_totals(rows: DataFrame, label: str) -> dict[int, int]:
    """How many rows either class has."""
    counts = rows.where(f"{label} IN (0, 1)").groupBy(label).count().collect()
    return {int(r[label]): r["count"] for r in counts}


def fit(
    labelled: DataFrame,
    label: str = "toxic",
    text: str = "text",
    key: str = "doc_id",
    per_class: int = PER_CLASS,
    features: int = 1_024,
    rank: int = 8,
    epochs: int = 30,
    seed: int = 7,
    totals: dict | None = None,
) -> Model:
    """Fit on a sample of ``labelled`` (key, text, label in 0 and 1).

    ``per_class`` bounds the rows of either class the machine is fitted on. Without rows of both
    classes the model has no features and answers with the base rate. ``totals`` has the rows of
    each class that the base rate is taken from; it must be given where ``labelled`` is a sample
    itself, and is otherwise counted over all of ``labelled``.
    """
    given = labelled.where(F.col(text).isNotNull())
    if totals is None:
        totals = class_totals(given, label)
    rows = stored(sample(given.select(key, text, label), label, per_class, key, text), "labelled-sample")
    held = class_totals(rows, label)

    def presence(batches):
        for texts, labels in _columns(batches, text, label):
            count = {}
            for t, y in zip(texts, labels):
                for b in _distinct_buckets(t):
                    n = count.setdefault(b, [0, 0])
                    n[y] += 1
            found = list(count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found, pa.int64()),
                    pa.array([count[b][0] for b in found], pa.int64()),
                    pa.array([count[b][1] for b in found], pa.int64()),
                ],
                ["bucket", "n0", "n1"],
            )

    sums = (
        rows.mapInArrow(trimmed(presence), "bucket long, n0 long, n1 long")
        .groupBy("bucket")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    all0, all1 = totals.get(0, 0), totals.get(1, 0)
    base = float(np.log((all1 + 1) / (all0 + 1)))
    n0, n1 = held.get(0, 0), held.get(1, 0)
    if not n0 or not n1:
        return Model({}, base, np.zeros(0), np.zeros((0, rank)))
    # How well presence tells the classes apart: the signed root of the likelihood ratio, roughly.
    p0, p1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
    pooled = (F.col("n0") + F.col("n1") + 1) / (n0 + n1 + 2)
    contrast = F.abs(p1 - p0) / F.sqrt(pooled * (1 - pooled) + 1e-9)
    top = (
        sums.where("n0 + n1 >= 3")
        .orderBy(F.desc(contrast), "bucket")
        .limit(features)
        .select("bucket")
        .collect()
    )
    index = {r["bucket"]: i for i, r in enumerate(top)}

    def present(batches):
        for texts, labels in _columns(batches, text, label):
            lists = [sorted({index[b] for b in _distinct_buckets(t) if b in index}) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.list_(pa.int32())), pa.array(labels, pa.int32())],
                ["features", "label"],
            )

    matrix = rows.mapInArrow(present, "features array<int>, label int").toPandas()
    matrix = matrix.assign(k=matrix.features.map(tuple)).sort_values(["label", "k"])
    x = np.zeros((len(matrix), len(index)), np.float32)
    for i, f in enumerate(matrix.features):
        x[i, f] = 1
    y = matrix.label.to_numpy(np.float32)
    bias, w, v = descend(x, y, rank, epochs, seed)
    # The sample may hold a larger share of a class than the labels do; the bias makes up for it.
    drawn = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return Model(index, bias + base - float(drawn), w, v)


def descend(x, y, rank, epochs, seed, step=0.05, batch=256, keep=1e-3):
    """Fit the machine by Adam on the logistic loss with decay of weights and vectors."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    params = [np.zeros(1, np.float32), np.zeros(m, np.float32), rng.normal(0, 0.02, (m, rank)).astype(np.float32)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            xb, (b, w, v) = x[rows], params
            s = xb @ v
            z = b[0] + xb @ w + 0.5 * (s * s - xb @ (v * v)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            gx = g @ xb
            grads = [
                np.array([g.sum()], np.float32),
                gx + keep * w,
                xb.T @ (g[:, None] * s) - gx[:, None] * v + keep * v,
            ]
            t += 1
            for p, q, a, c in zip(params, grads, first, second):
                a += 0.1 * (q - a)
                c += 0.001 * (q * q - c)
                p -= step * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)
    return float(params[0][0]), params[1].astype(float), params[2].astype(float)


def _columns(batches, text, label):
    for labels, texts in text_batches(batches, [label, text]):
        yield [t or "" for t in texts], labels


def _distinct_buckets(text: str) -> set[int]:
    found = set()
    for w in set(WORD.findall(text.lower())):
        found.update(word_buckets(w))
    return found


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5, words: int = 100_000) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted``.

    ``words`` bounds a task's memory of words and their features; it never changes a score.
    """
    kept = docs.drop("score", "predicted")
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )

    def scored(batches):
        known: dict = {}
        for b in batches:
            scores = []
            for t in b.column(text):
                found = set()
                # Distinct space-separated pieces first: most repeat in a text.
                for w in set(WORD.findall((t.as_py() or "").lower())):
                    f = known.get(w)
                    if f is None:
                        f = tuple(model.index[k] for k in word_buckets(w) if k in model.index)
                        if len(known) >= words:
                            known.clear()
                        known[w] = f
                    if f:
                        found.update(f)
                scores.append(model.score(np.array(sorted(found), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                ],
                [*b.schema.names, "score", "predicted"],
            )

    return kept.mapInArrow(trimmed(scored), schema)
