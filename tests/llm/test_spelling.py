"""Spelling variants against plain edit distance."""

import random
import zlib
from collections import Counter

import pytest

from plumbline.llm import spelling

SCHEMA = "doc_id long, text string"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows) -> dict:
    counts = Counter()
    for doc_id, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        runs = "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in lowered).split()
        for run in runs:
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    result, form = {}, {}
    for word, n in counts.items():
        near = sorted((-counts[o], o) for o in counts if one_edit(word, o))
        best = near[0] if near and -near[0][0] >= 5 * n else None
        form[word] = best and best[1]
        result[word] = (n, len(near), best and best[1], best and -best[0])
    for word in result:
        root = word
        while form[root]:
            root = form[root]
        result[word] += (root,)
    return result


def found(df) -> dict:
    rows = df.collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(2)
    stems = ["".join(pick.choice("abcé") for _ in range(pick.randint(6, 8))) for _ in range(12)]
    words = []
    for stem in stems:
        words += [stem] * 130
        for _ in range(6):
            i = pick.randrange(len(stem))
            variant = stem[:i] + pick.choice(["", "a", "bÿ", stem[i] * 2]) + stem[i + 1 :]
            words += [variant.capitalize()] * pick.choice([5, 6, 25])
            words += [variant + "e"] * 5
    pick.shuffle(words)
    texts = [(i, ", ".join(words[i::40])) for i in range(40)]
    return texts + [(None, "abcabc abcabc-abcabc9abcabc ABCABC"), (50, None), (51, ""), (52, "×÷×÷×÷ " * 5), (52, "x" * 70_000)]


@pytest.mark.parametrize("block", [spelling.BLOCK, 5])
def test_variants_equal_plain_edit_distance(spark, rows, block):
    want = plain(rows)
    assert sum(w[2] is not None for w in want.values()) > 20 and "×÷×÷×÷" in want
    got = found(spelling.variants(spark.createDataFrame(rows, SCHEMA), block=block))
    assert got == want


def test_ties_go_to_the_smaller_word_and_forms_are_followed(spark):
    words = ["grundla"] * 5 + ["grundlaa"] * 25 + ["grundlab"] * 25 + ["grundlaaa"] * 125
    text = " ".join(words)
    got = found(spelling.variants(spark.createDataFrame([(1, text)], SCHEMA)))
    assert got == plain([(1, text)])
    assert got["grundla"][2] == "grundlaa" and got["grundla"][4] == "grundlaaa"


def test_repeated_rows_count_and_other_columns_do_not(spark):
    rows = [(7, "letters", "w", 1)] * 5
    df = spark.createDataFrame(rows, SCHEMA + ", word string, n int")
    assert found(spelling.variants(df)) == {"letters": (5, 0, None, None, "letters")}


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_words(spark):
    long = "ab" * 9_000
    text = " ".join([long] * 25 + [long[:-1]] * 5)
    got = found(spelling.variants(spark.createDataFrame([(3, text)], SCHEMA)))
    assert got[long[:-1]][2] == long


def test_index_finds_exactly_one_edit():
    pick = random.Random(3)
    words = sorted({"".join(pick.choice("aé") for _ in range(pick.randint(6, 9))) for _ in range(400)})
    counts = [pick.randint(1, 4) for _ in words]
    got = {w: rest for w, *rest in spelling.lookup(words, counts, words)}
    for word in words:
        near = sorted((-n, o) for o, n in zip(words, counts) if one_edit(word, o))
        assert got.get(word) == ([len(near), -near[0][0], near[0][1]] if near else None)
