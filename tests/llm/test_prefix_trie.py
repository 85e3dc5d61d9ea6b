"""The prefix trie against a plain one, with long and hot conversations and a crowded sketch."""

import hashlib
import random
import zlib

import pytest

from plumbline.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(paths: dict) -> dict:
    """Nodes by walking every path: (conv_id, depth) with the other columns."""
    members, ends = {}, {}
    for conv, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
        ends.setdefault(tuple(turns), []).append(conv)
    rows = {}
    for node, convs in members.items():
        below = [other for other in members if other[: len(node)] == node]
        children = [other for other in below if len(other) == len(node) + 1]
        leaf = lambda n: not any(o[: len(n)] == n and len(o) == len(n) + 1 for o in members)
        saved = sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        rows[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None,
            len(convs),
            len(children),
            sum(map(leaf, below)),
            saved,
            hashlib.sha256(ids.encode()).hexdigest(),
        )
    return rows


def found(df) -> dict:
    rows = df.collect()
    got = {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in rows
    }
    assert len(got) == len(rows)
    return got


def in_order(rows) -> dict:
    paths = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            paths.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(turns, key=lambda x: x[0])] for c, turns in paths.items()}


@pytest.fixture(scope="module")
def random_rows():
    pick = random.Random(4)
    rows = []
    for conv in range(60):
        for turn in range(pick.randint(1, 6)):
            rows.append((conv, turn if turn else None, pick.choice(["user", None]), pick.choice(["ä", "bb", "", None])))
    rows += [(100, t, "user", "same") for t in range(3)] + [(None, 0, "user", "no id")]
    return rows


@pytest.mark.parametrize("options", [{}, {"most_counters": 16}, {"chunk": 2, "ids": 3}])
def test_trie_equals_plain_one(spark, random_rows, options):
    df = spark.createDataFrame(random_rows, SCHEMA)
    assert found(trie.trie(df, **options)) == plain(in_order(random_rows))


def test_rebuilt_conversations_share_heads(spark):
    pick = random.Random(5)
    rows = []
    for conv in [*range(0, 12), *range(95, 110), 250, 399]:
        rows += [(conv, t, "user", pick.choice("ab")) for t in range(pick.randint(1, 8))]
    paths, rebuilt = in_order(rows), {}
    for conv, own in paths.items():
        h = zlib.crc32(str(conv).encode()) % 6
        rebuilt[conv] = paths.get(conv - conv % 100, [])[:h] + own[h:]
    assert any(not turns for turns in rebuilt.values()) or len(rebuilt) == len(paths)
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    nodes = trie.nodes(trie.with_shared_heads(turns), turns.where("pos = 0").select("conv"))
    assert found(nodes) == plain(rebuilt)


def test_long_conversation_and_many_equal_ones(spark):
    rows = [(0, t, "user", f"t{t % 7}") for t in range(150)]
    rows += [(c, t, "user", f"t{t}") for c in range(1, 200) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(trie.trie(df, chunk=16, ids=8))
    ids = ",".join(str(c) for c in range(1, 200))
    assert got[0, 2][1] == 200 and got[0, 2][5] == hashlib.sha256(ids.encode()).hexdigest()
    assert got[0, 0][4] == 199 * 4 and len(got) == 151


def test_turnless_conversations_stay_members_of_the_root(spark):
    turns = spark.createDataFrame([], "conv long, pos long, turn_hash binary, chars long")
    convs = spark.createDataFrame([(3,), (1,)], "conv long")
    (root,) = trie.nodes(turns, convs).collect()
    assert (root.conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (1, 2, 0, 1, 0)
    assert root.ends_sha256 == hashlib.sha256(b"1,3").hexdigest()


def test_empty_table_repeats_long_texts_and_other_columns(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "x" * 100_000, 5, "k")] * 2 + [(2, 0, "user", "x" * 100_000, 6, "k")]
    df = spark.createDataFrame(rows, SCHEMA + ", depth int, k1 string")
    got = found(trie.trie(df))
    assert got[1, 1][:2] == (1, 2) and got[1, 2][1] == 1 and got[1, 0][4] == 100_000


def test_sketch_never_counts_too_low(spark):
    rows = [(k * 7919, k * 104729) for k in range(300)] + [(7919, 104729)]
    df = spark.createDataFrame(rows, "k1 long, k2 long").selectExpr("*", "2L as depth", "k1 as p1", "k2 as p2")
    for counters in (64, 4096):
        judged = trie.screened(df, counters).collect()
        assert not any(r.single for r in judged if r.k1 == 7919)
    assert sum(r.single for r in judged) > 250


def test_parents_proven_single_of_nodes_that_are_not(spark):
    """Of a thousand prefixes of one member each some collide in every row of the sketch, after a parent that does not."""
    rows = [(conv, turn, "user", f"{conv} {turn}") for conv in range(50) for turn in range(20)]
    got = found(trie.trie(spark.createDataFrame(rows, SCHEMA)))
    want = {(c, d): c if d > 1 else 0 for c in range(50) for d in range(1, 21)} | {(0, 0): None}
    assert {k: v[0] for k, v in got.items()} == want
