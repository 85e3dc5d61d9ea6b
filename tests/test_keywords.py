"""Categories from a keyword table against the chain of tests."""

import random

import pytest

from plumbline.operators import comments as C

TABLE = "priority int, category string, keyword string"


def by_chain(texts, rows):
    found = []
    for text in texts:
        hits = [(p, c) for p, c, k in rows if k and text is not None and k in text.lower()]
        found.append(min(hits)[1] if hits else None)
    return found


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(8)
    word = lambda: "".join(pick.choice("abcdé ") for _ in range(pick.randint(1, 9)))
    return [" ".join(word() for _ in range(pick.randint(0, 12))).upper() for _ in range(300)] + [None, "", "@", "a\nb"]


def categorized(spark, texts, rows, **options):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "row_0 int, comment string, category string")
    out = C.categorize_by_table(df, spark.createDataFrame(rows, TABLE), **options)
    assert sorted(out.columns) == ["category", "comment", "row_0"]
    got = {r.row_0: r.category for r in out.collect()}
    return [got[i] for i in range(len(texts))]


def test_table_equals_chain(spark, texts):
    pick = random.Random(9)
    rows = [(pick.randint(0, 9), f"c{i % 7}", "".join(pick.choice("abcdé @") for _ in range(pick.randint(1, 6)))) for i in range(60)]
    rows += [(3, "x", "a\nb"), (0, "never", ""), (0, "never", None), (1, "twice", "abc"), (1, "twice", "abc")]
    want = by_chain(texts, rows)
    assert len(set(want)) > 5
    assert categorized(spark, texts, rows) == want
    assert categorized(spark, texts, rows, gram=2) == want


def test_ten_thousand_keywords(spark, texts):
    pick = random.Random(10)
    rows = [(i, f"c{i}", "".join(pick.choice("abcdé") for _ in range(pick.randint(4, 8)))) for i in range(10_000)]
    assert categorized(spark, texts, rows) == by_chain(texts, rows)


def test_empty_tables_and_empty_keyword_lists(spark, texts):
    assert categorized(spark, texts[:5], [(1, "none", "")]) == [None] * 5
    empty = spark.createDataFrame([], "row_0 int, comment string")
    assert C.categorize_by_table(empty, spark.createDataFrame([(1, "a", "b")], TABLE)).collect() == []
    df = spark.createDataFrame([("has b",)], "comment string")
    assert C.categorize_comments(df, {"empty": [], "b": ["b"]}).first().category == "b"
    assert C.categorize_comments(df, {"empty": []}).first().category is None
    assert C.categorize_comments(df, {}).first().category is None
