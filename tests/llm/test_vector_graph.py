"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from plumbline.llm import vector_graph as graph

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, threshold=0.9):
    """n_links and component of each row."""
    dim = max([len(v) for _, v in rows if v] + [1])
    x = np.zeros((len(rows), dim))
    for i, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v):
            x[i, : len(v)] = v
    whole = np.abs(x).max(axis=1) > 0
    x[whole] = graph.unit(x[whole])
    near = (x @ x.T >= threshold) & whole[:, None] & whole[None, :]
    np.fill_diagonal(near, False)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(near)):
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    ids = {}
    for i, root in enumerate(label):
        if rows[i][0] is not None:
            ids[root] = min(ids.get(root, rows[i][0]), rows[i][0])
    return [(rows[i][0], int(near[i].sum()), ids.get(label[i])) for i in range(len(rows))]


def found(df):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    x = [c + 0.25 * rng.normal(size=24) for c in centres for _ in range(12)]
    hot = rng.normal(size=24)
    x += [hot + 0.2 * rng.normal(size=24) for _ in range(300)] + list(rng.normal(size=(300, 24)))
    x += [x[0]] * 40
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_links_equal_brute_force_in_one_shard(spark, planted):
    want = brute(planted)
    df = graph.near_duplicates(spark.createDataFrame(planted, SCHEMA))
    got = found(df)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert np.mean([g[2] == w[2] for g, w in zip(got, want)]) >= 0.99
    assert df.where("kept <> (vec_id = component_id) or audit_recall < 0.98").isEmpty()


def test_many_split_shards_lose_no_more(spark, planted):
    """Shards of a tenth of the rows, with a group of near copies larger than a shard."""
    want = brute(planted)
    got = found(graph.near_duplicates(spark.createDataFrame(planted, SCHEMA), shard=60, probes=3))
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    # Counts are of pairs: both ends count, so they add up to an even number.
    assert sum(g[1] for g in got) % 2 == 0


def test_unusable_vectors_repeats_scale_and_nulls(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a), (3, [2.0, 0.0]), (9, [1e300, 1e290, 0.0]), (9, a), (None, b), (None, [0.0, 1e-300])]
    rows += [(10, None), (11, []), (12, [0.0, 0.0, 0.0]), (13, [None, 1.0, 0.0]), (14, [float("nan")] * 3)]
    rows += [(15, [float("inf"), 0.0, 0.0]), (None, None), (20, [0.0, 0.0, -1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n_links int, key string")
    result = graph.near_duplicates(df)
    assert found(result) == ordered(brute(rows))
    assert {r.vec_id for r in result.where("kept").collect()} == {3, 10, 11, 12, 13, 14, 15, 20}


def test_empty_tables(spark):
    assert graph.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(1, None)], SCHEMA)
    assert found(graph.near_duplicates(only)) == [(1, 0, 1)]


def test_graph_is_bounded_and_reaches_all():
    rng = np.random.default_rng(1)
    x = graph.unit(np.concatenate([rng.normal(size=(200, 8)), 0.01 * rng.normal(size=(200, 8)) + 1]))
    lists = graph.build(x)
    start = int(graph.medoids(x)[0])
    reached, front = {start}, [start]
    while front:
        front = [int(j) for i in front for j in lists[i] if j >= 0 and int(j) not in reached and not reached.add(int(j))]
    assert len(reached) == len(x)
    hits = graph.search(x, lists, x, 0.9)
    true = x @ x.T >= 0.9
    assert not (hits & ~true).any() and hits.sum() >= 0.99 * true.sum()


def test_pruning_drops_what_a_kept_neighbour_covers():
    x = graph.unit(np.array([[1.0, 0, 0], [1, 0.1, 0], [1, 0.2, 0], [1, 0, -0.3]]))
    kept = graph.prune(x, np.array([0]), np.array([[1, 2, 3, -1]]), 3, 1.2)[0]
    assert kept.tolist() == [1, 3, -1]
