"""Each operation on small tables: plain versions, and nulls, empty texts, ties and repeats."""

import base64
import math
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import (
    byte_bpe,
    components,
    language,
    lines,
    packing,
    quality,
    queries,
    secrets,
    simhash,
    topk,
    toxicity,
    urls,
)
from plumbline.llm.word_bpe import WordBpe

TEXTS = ["one two three four five", None, "", " \n ", "one two three four five", "İ é 日本 \x1c don't 12", "x" * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0.5) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 0.5), (None, "no id", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double")


def test_quality_counts_words_lines_and_repeats(spark):
    text = "a b c a b c #x\nline\nline\n\n"
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.word_chars, row.n_symbols) == (9, 16, 1)
    assert (row.n_dup_lines, row.n_repeat_words) == (1, 6)
    assert row.base_failed and not row.kept


def test_quality_takes_nulls_and_repeats(docs):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    assert all(r.base_failed and not r.kept for r in rows if not (r.text or "").strip())


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 6)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None]), (62, [float("nan")] * 6), (63, []), (64, rows[3][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), block=16, query_block=4).collect()
    whole = {i: np.floor(256 * np.array(v, float)) for i, v in rows if i is not None and i not in (60, 61, 62)}
    pad = lambda v: np.append(v, np.zeros(6 - len(v)))
    want = []
    for q in [i for i in whole if i % 7 == 0]:
        scores = sorted((-int(pad(whole[q]) @ pad(v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_ranks_scores_beyond_64_bits(spark):
    big = [1e9, -1e9, 1e30, -1e30, 3e14, 0.5, -0.25, 2.0**40 + 0.3]
    rows = [(i, [big[i % 8], big[(i * 3) % 8]]) for i in range(24)] + [(30, [1e308, 0.0]), (31, [7.0] * 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, w string, row int")
    got = topk.search(df, F.col("vec_id") % 7 == 0, block=5, query_block=3).collect()
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i != 30}
    want = []
    for q in [i for i in whole if i % 7 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)
    numbers = [10**40, 99, 100, 5, 0, -1, -9, -10, -(10**40), -(10**40) - 1]
    assert sorted(numbers, key=topk.ranked) == sorted(numbers)
    assert topk.search(df.limit(0), F.lit(True)).collect() == []


def test_byte_bpe_equals_the_library_and_round_trips(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.decode(byte_bpe.encode(docs, path, chunk_chars=40), path).collect()
    want = [(r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, list(r.ids), bytes(r.bytes)) for r in rows), key=key) == sorted(want, key=key)


def test_word_bpe_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    ours, library = WordBpe(path, words=3), Tokenizer.from_file(path)
    marks = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|EndOfText|> y", "<|endoftext"]
    for text in ["It's THE end, don't!'s x12", "ŉ ǅ z² ½ 日本", "", "'ll we'VE ''s --'t", "a\x1cb İ", *marks]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == np.array(ids, "<u4").tobytes()


def test_packing_places_every_piece_without_gaps(spark):
    rng = np.random.default_rng(2)
    sizes = [*rng.integers(1, 33, 400), *[7] * 150, 32, 32]
    rows = [(i, int(n)) for i, n in enumerate(sizes)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), capacity=32).collect()
    assert sorted(r.doc_id for r in packed) == list(range(len(sizes)))
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    # Best fit by decreasing size, one piece after the other, needs as many.
    gaps = []
    for n in sorted(map(int, sizes), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 32) - n)
    assert len(bins) <= len(gaps) + 1


def test_packing_takes_empty_tables_and_null_texts(spark, docs):
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0
    rows = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=8).collect()
    assert [r.length for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert all(len(r.ids) == 4 * r.length <= 32 for r in rows)


@pytest.mark.parametrize("hot, subtree", [(False, 1 << 20), (True, 5)])
def test_simhash_components_equal_brute_force(spark, hot, subtree):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    if hot:  # most fingerprints share their leading bits, so their node must be split
        base[5:] = (base[5:] & 0xFFFFFFFF) | 0x5A5A5A5A << 32
    keys = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, n, replace=False))) for b in base for n in (0, 2, 5, 9)]
    df = spark.createDataFrame([(k,) for k in sorted(set(keys))], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(df, subtree=subtree)).collect()}
    found = sorted(set(keys))
    parent = {k: k for k in found}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(found):
        for b in found[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    assert {k: roots.get(k, k) for k in found} == {k: top(k) for k in found}


def test_simhash_links_textless_documents_and_copies(docs):
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert rows[1].component_id == rows[2].component_id == rows[3].component_id == 1
    assert rows[4].component_id == 0 and rows[1].fp == 0
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None)[:2] == [0, 1]
    assert len([r for r in kept if r.doc_id == 0]) == 1


def plain_fingerprint(text):
    """Bit by bit, as the contract says."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_equal_the_plain_ones():
    rng = np.random.default_rng(6)
    words = ["Ab", "é", "x\x1cy", "日", "the", "İ"]
    texts = [*TEXTS, *(" \t".join(rng.choice(words, n)) for n in (1, 3, 4, 5, 40)), "w " * 70_000]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_one_of_each_loses_no_distinct_document_and_keeps_no_copy(spark):
    a, b = "one two three four five six seven", "quite other words stand in this text here"
    rows = [(1, a), (1, b), (1, a), (2, b), (None, a), (None, "third " + b), (None, "third " + b), (5, "lone text")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row_0 int")
    kept = simhash.one_of_each(df).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept if r.doc_id) == [
        (False, 1, a), (False, 1, b), (False, 5, "lone text")
    ]
    assert [r.text for r in kept if r.doc_id is None] == ["third " + b]
    assert df.columns == simhash.one_of_each(df).columns
    assert simhash.one_of_each(df.limit(0)).collect() == []


def test_lines_keep_the_first_of_equal_and_similar_ones(spark):
    long = "the quick brown fox jumps over the lazy dog again and again until the night falls on all"
    rows = [(1, f"{long}\nown line of one"), (2, f"{long}.\n\nown line of two"), (3, long), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in lines.without_repeats(df).collect()}
    assert kept == {1: rows[0][1], 2: "\nown line of two", 4: None, 5: ""}


def test_secrets_report_weak_parts_only_together(spark):
    near = "login: alice pwd: hunter2x"
    alone = "pwd: hunter2x and nothing else"
    strong = 'token = "abcdefghijkl" AKIA' + "A" * 14 + " " + "0a" * 8
    df = spark.createDataFrame(
        [(1, near), (2, alone), (3, strong), (4, None), (1, near)], "doc_id long, text string"
    )
    rows = secrets.find(df).collect()
    linked = {r.doc_id: [x.kind for x in r.linked] for r in rows}
    assert linked[1] == ["account", "short_pass"] and linked[2] == [] and linked[4] == []
    assert [x.kind for r in rows if r.doc_id == 3 for x in r.strong] == ["assign", "access", "hex"]
    cut = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert cut[2] == alone and cut[4] is None and "hunter2x" not in cut[1]


def test_urls_follow_rules_and_split_names(spark):
    rows = [
        (1, "http://a.Example.net/en/1?x"), (2, "http://b.net/x"), (3, "http://x.org/fr/1"),
        (4, "https://free-casino.example.com/a"), (5, None), (6, "nonsense"), (7, "http://freecasino.example.com/b"),
        (8, "http://quiet-garden.example.com/a"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df, urls.learn(df, html=None)).collect()}
    assert [got[i].rule for i in range(1, 4)] == ["example.net/en/", "net/", "org/fr/"]
    assert [got[i].verdict for i in range(1, 4)] == ["allow", "block", "allow"]
    assert got[1].host == "a.example.net" and got[1].path == "/en/1"
    assert (got[5].host, got[6].host, got[5].path) == ("", "", "")
    assert "casino" in got[7].words and got[4].verdict == "block" and got[8].verdict == "allow"


def test_language_names_the_nearest_profile(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(4)] + [(9 + i, "der hund und die katze", "de") for i in range(4)]
    profiles = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "the dog"), (2, "die hunde"), (3, None), (4, "12 !")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, profiles).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == ("und", 0.0)


def test_toxicity_learns_and_scores_empty_texts(spark):
    rows = [(i, f"plain words here number {i % 7}", 0) for i in range(60)] + [(100 + i, "you awful moron here", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, features=64, epochs=20)
    new = spark.createDataFrame([(1, "what a moron"), (2, "plain words"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(new, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0
    assert got[3].score == got[4].score and 0 <= got[3].score <= 1
    assert toxicity.fit(df.where("toxic = 0")).index == {}


def test_toxicity_keeps_the_base_rate_of_all_labels(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda y: ["calm", "tidy", "moron", "plain"][int(rng.integers(1, 4) if y else rng.choice([0, 1, 1, 2, 3, 3]))]
    rows = [(i, " ".join(word(i % 20 == 0) for _ in range(3)), int(i % 20 == 0)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(queries.toxicity, "PER_CLASS", 60)
    scored = toxicity.score(df, queries.toxicity_model(spark, str(tmp_path))).collect()
    assert 0.02 < np.mean([r.score for r in scored]) < 0.12  # one in twenty is toxic
    assert np.mean([r.predicted for r in scored if not r.toxic]) < 0.05


def test_toxicity_samples_no_more_rows_than_asked_for(spark):
    rows = [(i % 5, f"text {i % 97}", i % 5 // 3) for i in range(2_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    drawn = toxicity.sample(df, "toxic", 30).collect()
    assert {y: len([r for r in drawn if r.toxic == y]) for y in (0, 1)} == {0: 30, 1: 30}
    assert toxicity.sample_keys(df, "toxic", 2).count() == 4


def test_urls_split_a_name_that_many_pages_have(spark):
    rows = [(i, f"http://freecasino.example.com/p{i}", "<p>play at freecasino.example.com</p>") for i in range(50)]
    rows += [(100 + i, f"http://garden{i}.example/x", "a free garden and a casino " * 3) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(df, urls.learn(df)).collect()}
    assert got[0].words == ["free", "casino", "example"] and got[0].verdict == "block"
    assert got[100].verdict == "allow"


def test_urls_use_every_word_and_token(spark):
    filler = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    html = " ".join(f"{filler(i)} {filler(i)}" for i in range(21_000)) + " zyxwvut quetzal"
    rows = [(0, "http://b.example/a", html), (1, "http://casino.example/zebra", "")]
    rows += [(2 + i, f"http://a{i}.example/calm", "") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = urls.learn(df)
    new = [(1, "http://casino.example/unseen"), (2, "http://casino.example/"), (3, "http://zyxwvutquetzal.example/a")]
    a, b, c = urls.judge(spark.createDataFrame(new, "page_id long, url string"), model).orderBy("page_id").collect()
    assert c.words == ["zyxwvut", "quetzal"]  # each seen once, behind 21,000 commoner words
    assert a.score == b.score and a.words == ["casino"]  # a token never seen weighs nothing


def test_secrets_take_endpoints_and_addresses_of_any_length(spark):
    label = "q" * 200
    ends = [f"{label}.example.org:8080", ".".join("abcdefghijkl") + ".example.org:80", f"...{'z' * 30}://host/path"]
    texts = [f"login: alice {e}\npwd: hunter2x" for e in ends] + [f"{label}@{label}.{label}.org pwd: hunter2x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [texts[r.doc_id][x.start : x.end] for x in r.linked] for r in secrets.find(df).collect()}
    assert ends[0] in spans[0] and ends[1] in spans[1] and ends[2].lstrip(".") in spans[2]
    assert f"{label}@{label}.{label}.org" in spans[3]


def test_secrets_take_long_parts_whole_and_blocks_as_scopes(spark):
    token, word = "aB3" * 70, "x1" * 60
    url = "https://u:pw@host.example/" + "q" * 300
    apart = "login: alice\n" + "plain setting of no interest\n" * 8 + "pwd: hunter2x\n"
    texts = [
        f"login: alice\n{token}", f"login: alice pwd: {word}!", 'login: alice pwd: "two words here" end',
        f"pwd: hunter2x {url} end", f"login: {'z' * 100} pwd: hunter2x", apart, apart.replace("\npwd", "\n\npwd"),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    m = "[removed]"
    assert [cut[i] for i in range(5)] == [
        f"login: {m}\n{m}", f"login: {m} pwd: {m}", f'login: {m} pwd: "{m}" end', f"pwd: {m} {m} end", f"login: {m} pwd: {m}"
    ]
    assert "alice" not in cut[5] and "hunter2x" not in cut[5] and cut[6] == texts[6]
