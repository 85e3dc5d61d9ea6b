"""Embedding near-dedup on a robust-pruned flat graph.

Distinct vectors are dealt to overlapping shards, each to the cells of its nearest centres. A task
builds the graph of a shard: near and random candidates of every node are pruned so that a candidate
goes if a kept neighbour is clearly nearer to it than the node is, edges are made to go both ways,
and what the medoid cannot reach is tied to its nearest reachable node. A node's lists from all its
shards are united.

Every vector is then looked up in the shards it may have neighbours in. A greedy search goes from a
shard's medoids with a beam of the best nodes seen; from all nodes in range, or nearly, it expands
until no further one is met, so the number of neighbours has no bound. A vector with very many
neighbours is compared with the whole shard instead, which is what its expansion would come to. Cosines are computed anew in
double precision before a pair counts. A sample of vectors is compared with all rows by brute force;
while the recall falls short, the search is repeated with more shards and a wider beam.

Cells that are tight (their radius and the range together stay under ``TIGHT``) are searched by every
vector that can have a neighbour in them, however many they are, so a large group of near copies
loses no link between its cells. Cells of more than ``SHARD`` vectors are split by hash and searched
in all parts; the questions to a shard are cut into buckets. So a task holds a bounded number of
vectors whatever the group. No pairs leave a task: it returns how many links each vector has and a
spanning forest of the links. Equal vectors are one node with a weight.

Each pair is counted in one place: where both vectors ask the other's shard, by the vector of the
smaller shard, or within a shard by the smaller node.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing.
Components beyond the shorter of two vectors count as zero. Every row counts as a vector, repeated
ids and rows too. A null id takes part; a component without any id has a null component. Columns
other than the id and the vector are left out.

Centres are fitted on at most ``SAMPLE`` vectors and there are at most ``MOST_CENTRES`` of them, both
within ``MOST_BYTES``; all other work is on all vectors.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.simhash import union
from plumbline.llm.tables import stored
from plumbline.llm.topk import usable

THRESHOLD = 0.9
SHARD = 4_096  # vectors of a shard, about
SAMPLE = 20_000  # vectors that centres are fitted on
MOST_CENTRES = 4_096
MOST_BYTES = 1 << 26  # of the sample, and of the centres that every task has; fewer of either if vectors are long
OVERLAP = 2  # shards that a vector is indexed in
PROBES = 3  # nearest cells that a vector is looked up in
BEAM = 48
MEDOIDS = 64  # of a shard, where searches begin
ENTRIES = 8  # medoids nearest to the question
CROWD = 48  # nodes in range from which a question is compared with its whole shard
DEGREE = 28
ALPHA = 1.2
NEAR, RANDOM = 48, 16  # candidates of a node
SLACK = 0.03  # nodes this much out of range are expanded too
TIGHT = math.radians(60)
BUCKET = 16_384  # questions to a shard in one task
AUDIT = 256  # vectors compared with all
RECALL = 0.99
PART = 20  # bits of a shard's number for its part of a cell


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, free of overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow column as unit rows, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return unit(flat.reshape(-1, dim))
    rows = np.zeros((len(lengths), dim))
    rows[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return unit(rows)


def centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7):
    """k unit centres of unit vectors by spherical k-means, and the angle each cell spans."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        home = _best(sample, found)
        sums = np.zeros_like(found)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1)
        found[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    home = _best(sample, found)
    span = np.zeros(k)
    angles = np.arccos(np.clip(np.einsum("ij,ij->i", sample, found[home]), -1, 1))
    np.maximum.at(span, home, angles)
    return found, span


def _best(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.concatenate([(rows[i : i + 1024] @ found.T).argmax(axis=1) for i in range(0, len(rows), 1024)])


def prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours (-1: none) of ``nodes`` among their candidates (-1: none), by robust pruning."""
    found = np.full((len(nodes), degree), -1, np.int64)
    for lo in range(0, len(nodes), 256):
        own, some = nodes[lo : lo + 256], candidates[lo : lo + 256]
        some = np.where(some == own[:, None], -1, some)
        vectors = x[some]
        near = np.einsum("ij,ikj->ik", x[own], vectors)
        near[some < 0] = -np.inf
        order = np.argsort(-near, axis=1, kind="stable")
        some, near = np.take_along_axis(some, order, 1), np.take_along_axis(near, order, 1)
        vectors = np.take_along_axis(vectors, order[:, :, None], 1)
        among = np.matmul(vectors, vectors.transpose(0, 2, 1))
        alive = some >= 0
        rows = np.arange(len(own))
        for d in range(degree):
            pick = alive.argmax(axis=1)
            has = alive[rows, pick]
            if not has.any():
                break
            found[lo + rows[has], d] = some[rows, pick][has]
            alive &= alpha * alpha * (1 - among[rows, pick]) > 1 - near
            alive[rows, pick] = False
    return found


def build(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, seed: int = 7) -> np.ndarray:
    """Neighbour lists (-1: none) of the graph of unit vectors."""
    n, rng = len(x), np.random.default_rng(seed)
    x = x.astype(np.float32)
    near = min(NEAR + 1, n)
    candidates = np.concatenate(
        [
            np.concatenate(
                [np.argpartition(-(x[lo : lo + 512] @ x.T), near - 1, axis=1)[:, :near] for lo in range(0, n, 512)]
            ),
            rng.integers(0, n, (n, RANDOM)),
        ],
        axis=1,
    )
    lists = prune(x, np.arange(n), candidates, degree, alpha)
    # Both ways, pruned again where lists grow too long.
    source, target = np.repeat(np.arange(n), degree), lists.ravel()
    real = target >= 0
    a, b = np.concatenate([source[real], target[real]]), np.concatenate([target[real], source[real]])
    lists = prune(x, np.arange(n), _rows(n, a, b, x, 3 * degree), degree, alpha)
    return _reachable(x, lists)


def _rows(n: int, a: np.ndarray, b: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """Edges a to b as one row a node, the nearest ``width`` of each."""
    near = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
    order = np.lexsort((-near, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    rows = np.full((n, width), -1, np.int64)
    rows[a[place < width], place[place < width]] = b[place < width]
    return rows


def medoids(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """Nodes nearest to the centres of the shard's clusters, that of the whole first."""
    k = min(k, len(x))
    middles = np.concatenate([x.mean(axis=0)[None, :], centres(x, k, rounds=2)[0].astype(x.dtype)])
    return np.array(list(dict.fromkeys((x @ middles.T).argmax(axis=0).tolist())))


def _reachable(x: np.ndarray, lists: np.ndarray, most: int = 4) -> np.ndarray:
    """The lists, with edges to what the shard's medoid did not reach from the nearest nodes it did.

    A node gets ``most`` such edges at a time, so lists stay short; what is reached takes the rest.
    """
    reached, front = np.zeros(len(x), bool), medoids(x, 1)[:1]
    while True:
        while len(front):
            reached[front] = True
            after = np.unique(lists[front])
            front = after[(after >= 0) & ~reached[after]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return lists
        safe = np.flatnonzero(reached)
        near = [(x[lost[i : i + 512]] @ x[safe].T) for i in range(0, len(lost), 512)]
        nearest = np.concatenate([safe[n.argmax(axis=1)] for n in near])
        order = np.lexsort((-np.concatenate([n.max(axis=1) for n in near]), nearest))
        nearest, lost = nearest[order], lost[order]
        place = np.arange(len(nearest)) - np.searchsorted(nearest, nearest)
        taken = place < most
        more = np.full((len(x), most), -1, np.int64)
        more[nearest[taken], place[taken]] = lost[taken]
        lists, front = np.concatenate([lists, more], axis=1), lost[taken]


def search(x, lists, questions, threshold: float, beam: int = BEAM, slack: float = SLACK, step: int = 4, starts=None):
    """For each question the nodes at a cosine of ``threshold`` or more, as a table of flags."""
    n, q = len(x), len(questions)
    slim, asked = x.astype(np.float32), questions.astype(np.float32)
    starts = medoids(slim) if starts is None else starts
    seen = np.zeros((q, n), bool)
    near = np.full((q, n), -np.inf, np.float32)
    turn = np.zeros((q, n), np.int16)
    width = min(beam, n)
    # The beam begins with the medoids nearest to the question.
    first = asked @ slim[starts].T
    seen[:, starts], near[:, starts] = True, first
    order = np.argsort(-first, axis=1)[:, : min(ENTRIES, width)]
    ids = np.zeros((q, width), np.int64)
    score = np.full((q, width), -np.inf, np.float32)
    fresh = np.zeros((q, width), bool)
    ids[:, : order.shape[1]] = starts[order]
    score[:, : order.shape[1]] = np.take_along_axis(first, order, 1)
    fresh[:, : order.shape[1]] = True
    active = np.arange(q)
    while len(active):
        # The best nodes of each beam that were not expanded yet.
        rank = np.where(fresh[active], score[active], -np.inf)
        take = np.argpartition(-rank, min(step, width) - 1, axis=1)[:, :step]
        chosen = np.take_along_axis(fresh[active], take, 1)
        nodes = np.take_along_axis(ids[active], take, 1)
        fresh[active[:, None], take] = False
        after = np.where(chosen[:, :, None], lists[nodes], -1).reshape(len(active), -1)
        columns = np.arange(after.shape[1], dtype=np.int16)[None, :]
        r = np.broadcast_to(active[:, None], after.shape)
        new = (after >= 0) & ~seen[r, after]
        turn[r[new], after[new]] = np.broadcast_to(columns, after.shape)[new]
        new &= turn[r, after] == columns  # a node met twice at once counts once
        rr, nn = r[new], after[new]
        seen[rr, nn] = True
        value = np.full(after.shape, -np.inf, np.float32)
        value[new] = np.einsum("ij,ij->i", asked[rr], slim[nn])
        near[rr, nn] = value[new]
        every = np.concatenate([score[active], value], axis=1)
        keep = np.argpartition(-every, width - 1, axis=1)[:, :width]
        score[active] = np.take_along_axis(every, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], after], axis=1), keep, 1)
        fresh[active] = np.take_along_axis(np.concatenate([fresh[active], new], axis=1), keep, 1)
        active = active[fresh[active].any(axis=1)]
    # Range expansion: all that is in range or nearly, until nothing more is met. Where that is very
    # many nodes, expanding them one by one comes to the whole shard, which one product compares.
    least = np.float32(threshold - slack)
    found = np.zeros((q, n), bool)
    crowded = (near >= least).sum(axis=1) >= CROWD
    for i in np.flatnonzero(~crowded):
        row, asks = near[i], asked[i]
        open_ = np.flatnonzero(row >= least)
        while len(open_) and not crowded[i]:
            after = np.unique(lists[open_])
            after = after[(after >= 0) & ~seen[i, after]]
            seen[i, after] = True
            row[after] = slim[after] @ asks
            open_ = after[row[after] >= least]
            crowded[i] = (row >= least).sum() >= CROWD
    near[crowded] = asked[crowded] @ slim.T
    rr, nodes = np.nonzero(near >= np.float32(threshold - 1e-4))
    for lo in range(0, len(rr), 65536):
        r, b = rr[lo : lo + 65536], nodes[lo : lo + 65536]
        found[r, b] = np.einsum("ij,ij->i", questions[r], x[b]) >= threshold
    return found


def _lists(column, ids: np.ndarray) -> np.ndarray:
    """Neighbour lists of node numbers as lists of places in sorted ``ids``; others are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    place = np.where(ids[place] == flat, place, -1)
    lists = np.full((len(lengths), max(1, int(lengths.max(initial=0)))), -1, np.int64)
    lists[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = place
    return lists


def links_of_shard(held: pa.Table, asks: pa.Table, dim: int, threshold: float, beam: int, batch: int = 256):
    """(0, node, links) for nodes with links counted here, and (1, node, node) for a forest of them.

    ``held`` has id, vec, weight, home, cells and lists of a shard's vectors, home being their own
    shard; ``asks`` has the same of the vectors looked up as q_id and so on, q_shard being the shard.
    """
    nothing = [np.zeros(0, np.int64)] * 3
    if not held.num_rows or not asks.num_rows:
        return nothing
    held = held.sort_by("id")
    ids, weight = held["id"].to_numpy(), held["weight"].to_numpy()
    x, lists = matrix(held["vec"], dim), _lists(held["lists"], held["id"].to_numpy())
    here = asks["q_shard"][0].as_py()
    own = held["home"].to_numpy() == here
    cells = held["cells"].combine_chunks()
    owner = np.repeat(np.arange(len(ids)), np.diff(cells.offsets.to_numpy()))
    back = np.unique(cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + owner)
    q_ids, q_weight, q_home = (asks[c].to_numpy() for c in ("q_id", "q_weight", "q_home"))
    q = matrix(asks["q_vec"], dim)
    count, q_count = np.zeros(len(ids), np.int64), np.zeros(len(q_ids), np.int64)
    labels, starts = np.arange(len(ids) + len(q_ids)), medoids(x)
    for lo in range(0, len(q_ids), batch):
        r, b = np.nonzero(search(x, lists, q[lo : lo + batch], threshold, beam, starts=starts) & own)
        r = r + lo
        key = (q_home[r] >> PART) * len(ids) + b
        place = np.minimum(np.searchsorted(back, key), len(back) - 1)
        both_ask = back[place] == key
        mine = np.where(q_home[r] == here, q_ids[r] < ids[b], ~both_ask | (q_home[r] < here))
        r, b = r[mine], b[mine]
        np.add.at(q_count, r, weight[b])
        np.add.at(count, b, q_weight[r])
        union(labels, b, r + len(ids))
    every = np.concatenate([ids, q_ids])
    tied = np.flatnonzero(labels != np.arange(len(labels)))
    a, b = every[tied], every[labels[tied]]
    some, q_some = count > 0, q_count > 0
    return [
        np.concatenate([np.zeros(some.sum() + q_some.sum(), np.int64), np.ones(len(a), np.int64)]),
        np.concatenate([ids[some], q_ids[q_some], a]),
        np.concatenate([count[some], q_count[q_some], b]),
    ]


def _linked(dim: int, threshold: float, beam: int):
    def linked(held: pa.Table, asks: pa.Table) -> pa.Table:
        columns = links_of_shard(held, asks, dim, threshold, beam)
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["kind", "a", "b"])

    return linked


class Cells:
    """Centres with the angle their cells span, and into how many parts a cell is split."""

    def __init__(self, found: np.ndarray, span: np.ndarray, threshold: float):
        self.found, self.range = found, math.acos(threshold)
        self.reach = np.where(span * 1.05 + self.range < TIGHT, np.cos(np.minimum(span * 1.05 + self.range, np.pi)), np.inf)

    def asked(self, x: np.ndarray, probes: int) -> list[np.ndarray]:
        """The cells to look each vector up in, its own first."""
        near = x @ self.found.T
        order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        must = near >= self.reach
        np.put_along_axis(must, order, False, 1)
        return [np.concatenate([o, np.flatnonzero(m)]) if m.any() else o for o, m in zip(order, must)]


def _assigned(nodes: DataFrame, cells: Cells, dim: int, probes: int) -> DataFrame:
    """The nodes with ``cells``, those to be looked up in, the own first."""

    def near(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lists = cells.asked(matrix(part.column("vec"), dim), probes)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lists, pa.list_(pa.int32()))], [*part.schema.names, "cells"]
                )

    return nodes.mapInArrow(near, "id long, vec array<double>, weight long, cells array<int>")


def _graph(members: DataFrame, dim: int) -> DataFrame:
    """(id, lists): united neighbour lists of the graphs of all shards."""

    def built(table: pa.Table) -> pa.Table:
        ids, lists = table["id"].to_numpy(), build(matrix(table["vec"], dim))
        sizes = (lists >= 0).sum(axis=1)
        flat = pa.array(ids[lists[lists >= 0]])
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        return pa.Table.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, flat)], ["id", "lists"])

    parts = members.groupBy("shard").applyInArrow(built, "id long, lists array<long>")
    return parts.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("lists"))).alias("lists"))


def _shards(cell: Column, parts: Column) -> Column:
    """Numbers of all shards of a cell."""
    return F.transform(F.sequence(F.lit(0), F.get(parts, cell) - 1), lambda p: F.shiftleft(cell.cast("long"), PART) + p)


def links(nodes: DataFrame, dim: int, threshold: float = THRESHOLD, shard: int = SHARD, probes: int = PROBES, recall: float = RECALL):
    """(links, edges, recall) of distinct vectors (id, vec, weight).

    ``links`` (id, n) counts the rows linked to a vector, its own copies apart; ``edges`` (a, b) are
    a forest of the links.
    """
    spark, n = nodes.sparkSession, nodes.count()
    if not n:
        return spark.createDataFrame([], "id long, n long"), spark.createDataFrame([], "a long, b long"), 1.0
    by_hash = nodes.select("id", "vec").orderBy(F.xxhash64("id"))
    most = max(1, MOST_BYTES // (8 * dim))
    sample = matrix(by_hash.limit(min(SAMPLE, most)).select("vec").toArrow()["vec"], dim)
    k = min(MOST_CENTRES, most, len(sample), math.ceil(n / shard))
    cells = Cells(*centres(sample, k), threshold)
    probes, beam = min(probes, k), BEAM

    assigned = stored(_assigned(nodes, cells, dim, probes), "assigned")
    of_cell = assigned.select(F.explode(F.slice("cells", 1, OVERLAP)).alias("cell"))
    sizes = of_cell.groupBy("cell").count().collect()  # k rows at most
    split = {r["cell"]: math.ceil(r["count"] / (2 * shard)) for r in sizes}
    parts = F.array(*[F.lit(split.get(c, 1)) for c in range(k)])
    home = F.shiftleft(F.col("cells")[0].cast("long"), PART) + F.pmod(F.xxhash64("id"), F.get(parts, F.col("cells")[0]))
    member_of = F.transform(
        F.slice("cells", 1, OVERLAP),
        lambda c: F.shiftleft(c.cast("long"), PART) + F.pmod(F.xxhash64("id"), F.get(parts, c)),
    )
    columns = ["id", "vec", "weight", home.alias("home")]
    graph = stored(_graph(assigned.select("id", "vec", F.explode(member_of).alias("shard")), dim), "graph")

    while True:
        asked = F.explode(F.flatten(F.transform("cells", lambda c: _shards(c, parts)))).alias("shard")
        asks = assigned.select(*columns, asked)
        buckets = asks.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("buckets"))
        buckets = stored(buckets, "buckets")
        held = (
            assigned.select(*columns, "cells", F.explode(member_of).alias("shard"))
            .join(graph, "id")
            .join(buckets, "shard")
            .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
        )
        bucket = F.pmod(F.xxhash64("id", "shard"), "buckets").cast("int").alias("q_bucket")
        asks = asks.join(buckets, "shard").select(
            *[F.col(c).alias(f"q_{c}") for c in ("id", "vec", "weight", "home", "shard")], bucket
        )

        found = stored(
            held.groupBy("shard", "bucket")
            .cogroup(asks.groupBy("q_shard", "q_bucket"))
            .applyInArrow(_linked(dim, threshold, beam), "kind long, a long, b long"),
            "found-links",
        )
        counts = stored(
            found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n")), "link-counts"
        )
        measured = audit(nodes, counts, dim, threshold)
        if measured >= recall or (probes >= k and beam >= 8 * BEAM):
            return counts, found.where("kind = 1").select("a", "b"), measured
        probes, beam = min(k, 2 * probes), 2 * beam
        assigned = stored(_assigned(nodes, cells, dim, probes), "assigned")


def audit(nodes: DataFrame, counts: DataFrame, dim: int, threshold: float, size: int = AUDIT) -> float:
    """The share of links found, by brute force for some vectors with found links and some others.

    Links that are counted exist, so the share is that of the counts.
    """
    joined = nodes.join(counts, "id", "left").select("id", "vec", "weight", F.coalesce("n", F.lit(0)).alias("n"))
    order = F.xxhash64("id", F.lit(3))
    picked = [joined.where(test).orderBy(order).limit(size).toArrow() for test in ("n > 0", "n = 0")]
    picked = pa.concat_tables(picked)
    asked, own = matrix(picked["vec"], dim), picked["id"].to_numpy()

    def met(batches):
        total = 0
        for batch in batches:
            weight, ids = batch.column("weight").to_numpy(), batch.column("id").to_numpy()
            for lo in range(0, batch.num_rows, 1024):
                part = slice(lo, lo + 1024)
                near = matrix(batch.column("vec").slice(lo, 1024), dim) @ asked.T >= threshold
                near &= ids[part, None] != own[None, :]
                total += int((near * weight[part, None]).sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    true = nodes.mapInArrow(met, "n long").agg(F.sum("n")).first()[0]
    return min(1.0, float(picked["n"].to_numpy().sum()) / true) if true else 1.0


def near_duplicates(
    rows: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD, **options
) -> DataFrame:
    """(key, n_links, component_id, kept, audit_recall) for every row.

    ``kept`` holds for the row whose id is that of its component; rows without an id are not kept.
    """
    slim = rows.select(F.col(key).alias("key"), F.col(vector).alias("vec"))
    whole = usable("vec") & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    slim = stored(slim.withColumn("whole", whole).withColumn("vec", F.col("vec").cast("array<double>")), "vectors")
    taken = slim.where("whole")
    distinct = taken.groupBy("vec").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("weight"))
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-vectors")
    dim = distinct.agg(F.max(F.size("vec"))).first()[0] or 1
    counts, edges, recall = links(distinct.select("id", "vec", "weight"), dim, threshold, **options)

    roots = components(edges).withColumnRenamed("node", "id")
    rooted = stored(
        distinct.select("id", "least", "weight").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")),
        "rooted",
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    judged = (
        rooted.join(groups, "root")
        .join(counts, "id", "left")
        .select("id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    )
    of_vector = distinct.select("id", "vec").join(judged, "id").select("vec", "n_links", "component_id")
    alone = slim.where("not whole").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    every = taken.join(of_vector, "vec").select("key", "n_links", "component_id").unionByName(alone)
    return every.select(
        F.col("key").alias(key),
        "n_links",
        "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"),
        F.lit(recall).alias("audit_recall"),
    )


def sql() -> str:
    """The query's result as DuckDB SQL, all pairs compared."""
    return f"""
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
),
whole AS (
  SELECT r, vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM vectors
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
),
linked AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS b_id FROM whole a JOIN whole b
    ON a.r <> b.r AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {THRESHOLD}
),
reached AS (
  SELECT r, r AS at_r, vec_id AS at_id FROM vectors
  UNION
  SELECT reached.r, linked.b, linked.b_id FROM reached JOIN linked ON linked.a = reached.at_r
),
least AS (SELECT r, min(at_id) AS component_id FROM reached GROUP BY r),
counts AS (SELECT a AS r, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept,
  CAST(1 AS DOUBLE) AS audit_recall
FROM vectors JOIN least USING (r) LEFT JOIN counts USING (r)
"""
