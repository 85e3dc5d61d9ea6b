"""Line dedup against plain Jaccard components, with planted pairs just above the threshold."""

import random

import pytest

from plumbline.llm import lines

SCHEMA = "doc_id long, text string"


def shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def plain(rows):
    """Per row: (key, lines, removed positions), links between all similar lines."""
    places, order = {}, sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    for r in order:
        for at, line in enumerate((rows[r][1] or "").split("\n") if rows[r][1] is not None else []):
            if line.strip():
                places.setdefault(line, []).append((r, at))
    distinct, label = list(places), {}
    for i, a in enumerate(distinct):
        label[a] = a
        for b in distinct[:i]:
            if jaccard(a, b) >= 0.8 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = {k: new if v == old else v for k, v in label.items()}
    rank = {r: i for i, r in enumerate(order)}
    first = {}
    for line, found in places.items():
        best = min((rank[r], at, r) for r, at in found)
        first[label[line]] = min(first.get(label[line], best), best)
    removed = {r: [] for r in range(len(rows))}
    for line, found in places.items():
        _, kept_at, kept = first[label[line]]
        for r, at in found:
            if (r, at) != (kept, kept_at):
                removed[r].append((at, rows[kept][0], kept_at))
    count = [sum(bool(x.strip()) for x in (t or "").split("\n")) for _, t in rows]
    return [(rows[r][0], count[r], sorted(removed[r])) for r in range(len(rows))]


def found(df):
    return [(r.doc_id, r.n_lines, sorted((x.at, x.kept_key, x.kept_at) for x in r.removed)) for r in df.collect()]


def edited(pick, line, low, high):
    """A variant of a line at a similarity between the bounds."""
    while True:
        words = line.split(" ")
        for _ in range(pick.randint(1, 3)):
            words[pick.randrange(len(words))] = "".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 7)))
        new = " ".join(words)
        if low <= jaccard(line, new) < high:
            return new


@pytest.fixture(scope="module")
def word():
    pick = random.Random(11)
    return lambda: "".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 9)))


def test_result_equals_plain_components(spark, word):
    pick = random.Random(1)
    base = [" ".join(word() for _ in range(pick.randint(2, 30))) for _ in range(60)]
    rows = []
    for i in range(80):
        own = [pick.choice(base) for _ in range(3)] + ["", " \t"]
        own += [edited(pick, pick.choice([b for b in base if len(b) > 100]), 0.4, 1)]
        own += [word(), "ä" * pick.randint(1, 9), "kurz"]
        pick.shuffle(own)
        rows.append((i // 2 if i % 9 else None, "\n".join(own)))
    rows += [(7, rows[14][1]), (90, None), (91, ""), (92, " \n\n"), (93, "kurz"), (None, None)]
    got = found(lines.removed_lines(spark.createDataFrame(rows, SCHEMA).coalesce(1)))
    want = plain(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]))
    wrong = sum(a != b for a, b in zip(sorted(got, key=key), sorted(want, key=key)))
    assert len(got) == len(want) and wrong <= 1  # a link below one in three hundred may be missed


def test_recall_of_pairs_just_above_the_threshold(spark, word):
    pick, rows = random.Random(2), []
    for i in range(300):
        line = " ".join(word() for _ in range(pick.randint(20, 50)))
        rows += [(2 * i, line), (2 * i + 1, edited(pick, line, 0.80, 0.85))]
    gone = [r for r in found(lines.removed_lines(spark.createDataFrame(rows, SCHEMA))) if r[2]]
    assert all(r[2] == [(0, r[0] - 1, 0)] for r in gone)  # nothing else is linked
    assert len(gone) >= 0.97 * 300


def test_lines_of_one_template_are_told_apart(spark, word):
    """A hot band whose lines are all below the threshold, and copies among them."""
    pick = random.Random(3)
    common = " ".join(word() for _ in range(14))
    other = lambda: " ".join(word() for _ in range(9))
    texts = [common + " " + other() for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[i] + ".") for i in range(0, 120, 10)]
    got = {r[0]: r[2] for r in found(lines.removed_lines(spark.createDataFrame(rows, SCHEMA)))}
    want = {r[0]: r[2] for r in plain(rows)}
    assert pick and got == want


def test_without_repeats_keeps_columns_order_and_blank_lines(spark):
    long = "the quick brown fox jumps over the lazy dog again and again until the night falls on all"
    rows = [
        (1, f"{long}\nown line of one", 1, 2, "x"), (2, f"\n{long}.\n \nown line of two\n", 1, 2, "x"),
        (3, long, 1, 2, "x"), (3, long, 1, 2, "x"), (4, None, 1, 2, "x"), (5, "", 1, 2, "x"), (6, "\n", 1, 2, "x"),
        (7, "y" * 60_000, 1, 2, "x"), (8, "y" * 60_001 + "\nmore", 1, 2, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", removed int, n_lines int, row string")
    out = lines.without_repeats(df)
    assert out.columns == df.columns
    kept = {r.doc_id: (r.text, r.removed, r.n_lines, r.row) for r in out.collect()}
    texts = {1: rows[0][1], 2: "\n \nown line of two\n", 4: None, 5: "", 6: "\n", 7: rows[7][1], 8: "more"}
    assert kept == {k: (t, 1, 2, "x") for k, t in texts.items()}
    assert lines.without_repeats(df.limit(0)).collect() == []
    assert lines.removed_lines(df.limit(0)).collect() == []


def test_bands_of_the_low_hashes_are_those_of_all(spark):
    """Few low hashes in a range must not change a band; such lists are planted beside plain ones."""
    pick = random.Random(6)
    lists = [[pick.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 3, 24, 96, 97, 150, 400, 2000)]
    lists += [[x for x in many if x >= 0 or pick.random() < 0.02] for many in lists[-3:]]
    lists += [[(x >> 61 << 61) + 2**60 + i for i, x in enumerate(many)] for many in lists[-3:]]

    def plain_choice(hashes):
        found = []
        for k in range(-4, 4):
            found += sorted(x for x in hashes if x >> 61 == k)[:3]
        return found

    df = spark.createDataFrame([(v, plain_choice(v)) for v in lists], "s array<long>, least array<long>")
    for row in df.select(lines.bands("s").alias("got"), lines.bands("least").alias("want")).collect():
        assert row.got == row.want


def test_the_line_that_stands_most_often_settles_its_variants(spark, word, monkeypatch):
    """Variants like one line, not like each other, are asked about that line first."""
    pick, asked = random.Random(8), []
    stored = lines.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "pairs":
            asked.append(out.count())
        return out

    monkeypatch.setattr(lines, "stored", counted)
    base = " ".join(word() for _ in range(40))
    rows = [(i, edited(pick, base, 0.84, 0.92)) for i in range(60)] + [(100 + i, base) for i in range(5)]
    got = found(lines.removed_lines(spark.createDataFrame(rows, SCHEMA)))
    assert sum(len(r[2]) for r in got) == 64
    assert sum(asked) <= 2 * 60


def test_few_lines_of_a_hot_group_meet(spark, word, monkeypatch):
    """Lines with a common passage, and far variants of one line: links are found without all pairs."""
    pick, asked = random.Random(9), []
    stored = lines.stored

    def counted(df, name):
        out = stored(df, name)
        if name in ("pairs", "against"):
            asked.append(out.count())
        return out

    monkeypatch.setattr(lines, "stored", counted)
    common, base = " ".join(word() for _ in range(14)), " ".join(word() for _ in range(40))
    texts = [common + " " + " ".join(word() for _ in range(9)) for _ in range(150)]
    texts += [edited(pick, base, 0.84, 0.95) for _ in range(60)]
    far = [edited(pick, edited(pick, base, 0.7, 0.75), 0.7, 0.9) for _ in range(60)]
    texts += [base] + far + [t + "." for t in texts[:150:10] + far[::5]]
    rows = list(enumerate(texts)) + [(1000, base)]
    got = {r[0]: r[2] for r in found(lines.removed_lines(spark.createDataFrame(rows, SCHEMA)))}
    assert got == {r[0]: r[2] for r in plain(rows)}
    assert sum(asked) <= 10 * len(rows)
