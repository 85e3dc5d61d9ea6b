"""SimHash near-dedup by a binary trie self-join.

A fingerprint's bit is set if it is set in over half of the hashes of a text's word shingles. All
distinct fingerprints form a binary trie. The self-join walks pairs of its nodes together, adds up
the bits in which the two paths differ, and drops a pair as soon as the sum exceeds the budget.

The top levels of the trie are walked by Spark: a fingerprint's prefix is its node, and it is sent
to every pair of nodes within the budget that its node is part of. A task then walks the two
subtrees of one pair, whole frontiers at a time as arrays, and in chunks, so memory stays bounded.
Pairs of subtrees already known to be in one component are not walked again; a first walk with a
budget of one bit finds most such groups cheaply. A task returns a spanning forest of the links it
found, at most one edge a fingerprint, from which components are built. No list of pairs exists.

A null text is an empty one; texts without words have the fingerprint zero and link like any
other. Equal fingerprints are one node of the trie however many documents have them. Repeated rows
and ids give a row each; a null doc_id takes part, and a component of such rows only has a null id.
"""

import math
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.components import components
from plumbline.llm.tables import stored, trimmed, unused

SHINGLE = 4
BUDGET = 4
SEED = 42


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    # On UTF-8 bytes lower() changes A-Z alone and split() splits at 20 and 09 to 0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    ones, n = np.zeros(64, np.int64), 0
    if len(words) < size:
        hashes = [digest(joined, seed)]
    else:
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :])]
    for lo in range(0, len(hashes), 65_536):
        part = np.array(hashes[lo : lo + 65_536], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """The documents without their text, with ``fp``, the fingerprint as a signed number."""
    kept = docs.drop("fp")
    names = [c for c in kept.columns if c != text]
    schema = T.StructType([kept.schema[c] for c in names] + [T.StructField("fp", T.LongType())])

    def hashed(batches):
        for b in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in b.column(text)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(found.view(np.int64))], [*names, "fp"]
            )

    return kept.mapInArrow(trimmed(hashed), schema)


class Trie:
    """The levels of a binary trie over sorted distinct keys, from a depth on.

    A node of a level is a run of keys; ``child[b]`` is the run's part with the next bit b, -1 if
    there is none. Levels end where every run is at most ``leaf`` keys long.
    """

    def __init__(self, keys: np.ndarray, depth: int, leaf: int):
        self.keys, self.levels = keys, []
        starts = np.zeros(1, np.int64) if len(keys) else np.zeros(0, np.int64)
        while True:
            sizes = np.diff(np.append(starts, len(keys)))
            level = {"start": starts, "size": sizes}
            self.levels.append(level)
            if depth == 64 or not len(sizes) or sizes.max() <= leaf:
                break
            prefix = keys >> np.uint64(63 - depth)
            below = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            parent = np.searchsorted(starts, below, side="right") - 1
            bit = (prefix[below] & np.uint64(1)).astype(np.int64)
            child = np.full((2, len(starts)), -1, np.int64)
            child[bit, parent] = np.arange(len(below))
            level["child"] = child
            starts, depth = below, depth + 1

    def marks(self, labels: np.ndarray) -> list[np.ndarray]:
        """For every level, the one label that all keys of a node have, else -1."""
        found = []
        for level in self.levels:
            if not len(level["start"]):
                found.append(np.zeros(0, np.int64))
                continue
            low = np.minimum.reduceat(labels, level["start"])
            high = np.maximum.reduceat(labels, level["start"])
            found.append(np.where(low == high, low, -1))
        return found


def union(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merge the sets of x[i] and y[i] in place; a set's label is its smallest member."""
    while len(x):
        a, b = labels[x], labels[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further


def walk(a: Trie, b: Trie | None, diff: int, budget: int, labels, shift: int, leaf: int = 64, chunk: int = 1 << 17):
    """Union all keys of ``a`` and ``b`` (None: ``a`` with itself) within the budget of each other.

    Keys of ``b`` stand ``shift`` behind those of ``a`` in ``labels``. ``diff`` is in how many bits
    the two roots differ.
    """
    own, b = b is None, b or a
    if not len(a.keys) or not len(b.keys):
        return
    last = min(len(a.levels), len(b.levels)) - 1
    mark_a = a.marks(labels[: len(a.keys)])
    mark_b = mark_a if own else b.marks(labels[shift : shift + len(b.keys)])
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, diff, np.int8))]
    while stack:
        level, i, j, d = stack.pop()
        if not len(i):
            continue
        if len(i) > chunk:
            stack += [(level, i[k : k + chunk], j[k : k + chunk], d[k : k + chunk]) for k in range(0, len(i), chunk)]
            continue
        la, lb = a.levels[level], b.levels[level]
        joined = (mark_a[level][i] == mark_b[level][j]) & (mark_a[level][i] >= 0)
        i, j, d = i[~joined], j[~joined], d[~joined]
        work = la["size"][i] * lb["size"][j]
        done = (work <= leaf) | (level == last)
        _compare(a, b, own, la, lb, i[done], j[done], budget, labels, shift)
        i, j, d = i[~done], j[~done], d[~done]
        if level == last:
            continue
        below = []
        for p in (0, 1):
            for q in (0, 1):
                if own and p > q:
                    pairs = i != j  # of a node and itself, one order of the halves will do
                else:
                    pairs = np.ones(len(i), bool)
                ci, cj, cd = la["child"][p][i], lb["child"][q][j], d + np.int8(p != q)
                keep = pairs & (ci >= 0) & (cj >= 0) & (cd <= budget)
                below.append((ci[keep], cj[keep], cd[keep]))
        stack.append((level + 1, *map(np.concatenate, zip(*below))))


def _compare(a, b, own, la, lb, i, j, budget, labels, shift, most: int = 1 << 21):
    """Union the keys of small node pairs that differ in at most ``budget`` bits."""
    sizes = la["size"][i] * lb["size"][j]
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(i):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        if hi == lo + 1 and sizes[lo] > most:  # runs of the last level may be long: by rows
            rows, width = int(la["size"][i[lo]]), int(lb["size"][j[lo]])
            step = max(1, most // width)
            for r in range(0, rows, step):
                k = np.arange(r, min(rows, r + step))
                x = np.repeat(la["start"][i[lo]] + k, width)
                y = np.tile(lb["start"][j[lo]] + np.arange(width), len(k))
                _link(a, b, own, x, y, budget, labels, shift)
        else:
            n = sizes[lo:hi]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(lb["size"][j[lo:hi]], n)
            x = np.repeat(la["start"][i[lo:hi]], n) + k // width
            y = np.repeat(lb["start"][j[lo:hi]], n) + k % width
            _link(a, b, own, x, y, budget, labels, shift)
        lo = hi


def _link(a, b, own, x, y, budget, labels, shift):
    near = np.bitwise_count(a.keys[x] ^ b.keys[y]) <= budget
    if own:
        near &= x < y
    union(labels, x[near], y[near] + (0 if own else shift))


def forest(first: np.ndarray, second: np.ndarray | None, depth: int, diff: int, budget: int):
    """Spanning edges (key, key) of the links within one subtree, or between two."""
    a = Trie(first, depth, 8)
    b = None if second is None else Trie(second, depth, 8)
    keys = first if second is None else np.concatenate([first, second])
    labels = np.arange(len(keys))
    for most in sorted({min(1, budget), budget}):
        if diff <= most:
            walk(a, b, diff, most, labels, len(first))
    other = np.flatnonzero(labels != np.arange(len(keys)))
    return keys[other], keys[labels[other]]


def _masks(bits: int, budget: int) -> Column:
    """All ways for two prefixes of ``bits`` bits to differ within the budget."""
    masks = [
        sum(1 << k for k in chosen)
        for m in range(min(budget, bits) + 1)
        for chosen in combinations(range(bits), m)
    ]
    return F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))


def links(
    fps: DataFrame, budget: int = BUDGET, subtree: int = 1 << 20, least_depth: int = 4, step: int = 4
) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of ``fps`` linked to one another.

    ``subtree`` is how many fingerprints a node of the top levels should hold about; a task holds
    two nodes of at most twice as many. The top levels end at the depth that the number of all
    fingerprints asks for; only pairs with a node that holds more go on, ``step`` bits at a time.
    """
    n = fps.count()
    depth = min(20, max(least_depth, math.ceil(math.log2(max(1, n / subtree)))))
    # A fingerprint is sent to every pair of nodes within the budget that its node is part of: a
    # mask says in which bits the other node differs.
    rows, parts = fps.select("fp", _masks(depth, budget).alias("mask")), []
    while True:
        node = F.shiftrightunsigned("fp", 64 - depth)
        sent = rows.select("fp", "mask", node.alias("node"), node.bitwiseXOR(F.col("mask")).alias("other"))
        heavy = stored(
            fps.groupBy(node.alias("node")).count().where(F.col("count") > 2 * subtree).select("node"), "heavy-nodes"
        )
        if depth + step > 60 or heavy.isEmpty():
            parts.append(sent.withColumn("depth", F.lit(depth)))
            break
        own, far = heavy.withColumn("own", F.lit(True)), heavy.select(F.col("node").alias("other"), F.lit(True).alias("far"))
        marked = sent.join(own, "node", "left").join(far, "other", "left")
        deeper = F.coalesce("own", "far", F.lit(False))
        parts.append(marked.where(~deeper).select("fp", "mask", "node", "other", F.lit(depth).alias("depth")))
        further = marked.where(deeper).select("fp", F.col("mask").alias("above"), _masks(step, budget).alias("below"))
        rows = further.where(F.bit_count("above") + F.bit_count("below") <= budget).select(
            "fp", F.shiftleft("above", step).bitwiseOR(F.col("below")).alias("mask")
        )
        depth += step
        # Below a heavy node few of the nodes that a mask names are there.
        there = fps.select(F.shiftrightunsigned("fp", 64 - depth).alias("there")).distinct()
        named = F.shiftrightunsigned("fp", 64 - depth).bitwiseXOR(F.col("mask"))
        rows = stored(rows.withColumn("there", named).join(there, "there", "left_semi").drop("there"), "deeper-pairs")
    pairs = [p.select("depth", "fp", F.least("node", "other").alias("low"), F.greatest("node", "other").alias("high")) for p in parts]

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        depth, low, high = int(rows.depth.iloc[0]), int(rows.low.iloc[0]), int(rows.high.iloc[0])
        keys = np.unique(rows.fp.to_numpy().view(np.uint64))
        side = keys >> np.uint64(64 - depth)
        first = keys[side == low]
        second = None if low == high else keys[side == high]
        x, y = forest(first, second, depth, (low ^ high).bit_count(), budget)
        return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    every = reduce(DataFrame.unionByName, pairs)
    return every.groupBy("depth", "low", "high").applyInPandas(joined, "a long, b long")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, budget: int = BUDGET
) -> DataFrame:
    """(key, fp, component_id): the smallest key reachable from each document over links."""
    slim = stored(fingerprints(docs.select(key, text), text, size), "fingerprints")
    fps = stored(slim.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), budget)).withColumnRenamed("node", "fp")
    rooted = stored(
        fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"),
        "rooted",
    )
    groups = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "groups")
    of_fp = stored(rooted.join(groups, "root").select("fp", "component_id"), "group-of-fingerprint")
    return slim.join(of_fp, "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One document of every component, with all its columns: that of the smallest key.

    Rows without a key come last. Rows of one key are told apart by fingerprint and then by place,
    so one row stays of each component whatever keys repeat or are absent, and no other goes.
    """
    (row,) = unused(docs.columns, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    found = near_duplicates(rows.select(row, text), text, row, size, budget)
    place = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), "fp", F.col(row).alias("row"))
    kept = (
        found.join(rows.select(row, key), row)
        .groupBy("component_id")
        .agg(F.min(place).alias("first"))
        .select(F.col("first.row").alias(row))
    )
    return rows.join(kept, row, "left_semi").select(docs.columns)
