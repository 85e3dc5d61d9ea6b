"""Operators without SQL against plain versions, and the odd inputs that all must take."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from plumbline.llm import byte_bpe, language, lines, packing, quality, secrets, simhash, spelling, toxicity, urls


def test_secret_links_equal_a_plain_version(spark):
    pick = random.Random(4)
    pieces = [
        "login: alice", "pwd: hunter2x", "a@b.org", "https://h.example/x", "db.example.org:5432", "AKIA" + "A" * 16,
        "password = abcdefghijklmn", "0a" * 10, "aB3" * 9, "\n", "\n \n", "words of no interest " * 4, "x" * 130, " ",
    ]
    texts = [" ".join(pick.choice(pieces) for _ in range(pick.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.linked] for r in secrets.find(df).collect()}
    for i, text in enumerate(texts):
        strong = [(k, secrets.ROLES[k], a, b) for k, a, b in secrets.strong_spans(text)]
        taken = {(a, b) for _, _, a, b in strong}
        weak = [w for w in secrets.weak_spans(text) if w[2:] not in taken]
        blanks = [m.end() for m in secrets.BLANK.finditer(text)]
        block = lambda at: sum(at >= b for b in blanks)
        want = set()
        for kind, role, a, b in weak:
            for _, other, c, d in strong + weak:
                near = block(a) == block(c) or (a <= d + secrets.REACH and c <= b + secrets.REACH)
                if near and (role == "secret") != (other == "secret"):
                    want.add((kind, a, b))
        assert sorted(got[i]) == sorted(want), text


def test_languages_equal_plain_profiles(spark):
    pick = random.Random(5)
    words = {"aa": "the and cat dog ñandú", "bb": "der und hund katze", "cc": "el los perro gato the"}
    rows = [(i, " ".join(pick.choice(words[n].split()) for _ in range(pick.randint(3, 30))), n) for i, n in enumerate(pick.choices(list(words), k=90))]
    size = 40
    profiles = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=size)

    def counts(texts):
        found = Counter()
        for t in texts:
            for w in language.WORD.findall(t.lower()):
                found.update(language.word_grams(w))
        return found

    plain = {}
    for name in words:
        top = sorted(counts(t for _, t, n in rows if n == name).items(), key=lambda x: (-x[1], x[0]))[:size]
        plain[name] = {g: i for i, (g, _) in enumerate(top)}
    assert profiles == plain
    texts = [t for _, t, _ in rows[:40]] + ["", "12", "zzz", "THE KATZE " * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, profiles, size=size).collect()}
    code = lambda g: [ord(c) for c in g.ljust(3, chr(0))]
    for i, text in enumerate(texts):
        top = [g for g, _ in sorted(counts([text]).items(), key=lambda x: (-x[1], code(x[0])))[:size]]
        if not top:
            assert got[i] == ("und", 0.0)
            continue
        far = {n: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(top)) for n, p in plain.items()}
        best = min(far, key=lambda n: (far[n], n))
        assert got[i][0] == best and math.isclose(got[i][1], 1 - far[best] / (size * len(top)))


def test_segmentation_finds_the_best_of_all_splits():
    pick = random.Random(6)

    def every(name):
        if not name:
            yield []
        for i in range(1, len(name) + 1):
            for rest in every(name[i:]):
                yield [name[:i], *rest]

    for _ in range(60):
        words = {"".join(pick.choice("ab") for _ in range(pick.randint(2, 4))): -pick.uniform(1, 12) for _ in range(5)}
        name = "".join(pick.choice("abc") for _ in range(pick.randint(1, 9)))
        other = lambda p: -5.0 + urls.LETTER * len(p)
        cost = lambda parts: sum(words.get(p, other(p)) for p in parts)
        # A piece that is a word may also be taken for none.
        value = lambda parts: sum(max(words.get(p, -math.inf), other(p)) for p in parts)
        found = urls.segment(name, words, -5.0)
        assert "".join(found) == name
        assert math.isclose(value(found), max(map(value, every(name)))) and cost(found) <= value(found) + 1e-9


def test_url_scores_equal_plain_naive_bayes(spark):
    rows = [(i, f"http://casino-{w}.example/{p}/{i}", "") for i, (w, p) in enumerate([("win", "play"), ("fun", "play"), ("win", "bonus")])]
    rows += [(10 + i, f"http://{w}-shop.example/{p}", "") for i, (w, p) in enumerate([("tea", "list"), ("hat", "play"), ("tea", "new")])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(df, urls.learn(df)).collect()}
    tokens = {i: r.words + [t if t.isalpha() else "0" for t in urls_tokens(r.path)] for i, r in got.items()}
    counts = {True: Counter(), False: Counter()}
    for i, found in tokens.items():
        counts[i < 10].update(found)
    size = len(set().union(*tokens.values())) + 1
    weight = lambda t: math.log((counts[True][t] + 1) / (sum(counts[True].values()) + size)) - math.log(
        (counts[False][t] + 1) / (sum(counts[False].values()) + size)
    )
    for i, found in tokens.items():
        z = math.log(4 / 4) + sum(map(weight, found))
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
        assert got[i].verdict == ("block" if i < 10 else "allow")


def urls_tokens(path):
    import re

    return re.findall("[a-z]+|[0-9]+", path.lower())


def test_toxicity_scores_equal_the_sum_over_pairs_and_learn_interactions(spark):
    pick = random.Random(7)
    fill = lambda: " ".join(pick.choice(["sun", "tree", "road", "lamp", "book"]) for _ in range(6))
    rows = []
    for i in range(400):
        insult, group = pick.random() < 0.5, pick.random() < 0.5
        words = fill() + " vermin" * insult + " foreigners" * group
        rows.append((i, words, int(insult and group)))
    train = spark.createDataFrame(rows[:300], "doc_id long, text string, toxic int")
    model = toxicity.fit(train, features=256, epochs=60)
    held = spark.createDataFrame([r[:2] for r in rows[300:]] + [(999, None), (998, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(held, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows[300:]]) >= 0.97
    for i, text in [r[:2] for r in rows[300:330]] + [(999, ""), (998, "")]:
        buckets = {b for w in toxicity.WORD.findall(text.lower()) for b in toxicity.word_buckets(w)}
        f = sorted(model.index[b] for b in buckets if b in model.index)
        pairs = sum(model.vectors[a] @ model.vectors[b] for k, a in enumerate(f) for b in f[:k])
        z = model.bias + sum(model.weights[a] for a in f) + pairs
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-z)), rel_tol=1e-6)


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PROFILES = {"xx": {"_a": 0, "a": 1}}
MODEL = toxicity.Model({}, -1.0, np.zeros(0), np.zeros((0, 4)))
OPERATORS = {
    "quality": quality.judge,
    "byte_bpe": lambda d: byte_bpe.decode(byte_bpe.encode(d, RANKS), RANKS),
    "lines": lines.removed_lines,
    "without_repeats": lines.without_repeats,
    "secrets": secrets.find,
    "redact": secrets.redact,
    "pieces": lambda d: packing.pieces(d, WORDS),
    "language": lambda d: language.identify(d, PROFILES),
    "simhash": simhash.near_duplicates,
    "one_of_each": simhash.one_of_each,
    "toxicity": lambda d: toxicity.score(d, MODEL),
    "spelling": lambda d: spelling.variants(d, count=1),
}
CLASHES = "score predicted words scope spans strong linked removed row row_0 all at ids bytes fp piece n whole_0 words_0 lines_0 kept word h1 cell".split()
TEXTS = [None, "", " \n\t", "plain text of some words", "plain text of some words", "login: bob pwd: hunter2x", "word " * 40_000, "y" * 60_000]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, name):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert OPERATORS[name](df).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_repeats_and_long_texts_change_nothing(spark, name):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    schema = "doc_id long, text string"
    plain = spark.createDataFrame(rows, schema).coalesce(1)
    odd = spark.createDataFrame([(*r, *[7] * len(CLASHES)) for r in rows], schema + "".join(f", {c} int" for c in CLASHES)).coalesce(1)
    a, b = OPERATORS[name](plain), OPERATORS[name](odd)
    common = [c for c in a.columns if c in b.columns]
    assert common == a.columns or set(a.columns) - set(b.columns) == set()
    key = lambda row: repr(row)
    assert sorted(map(key, a.select(common).collect())) == sorted(map(key, b.select(common).collect()))
