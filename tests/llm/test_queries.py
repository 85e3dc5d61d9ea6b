"""The queries against their SQL, the native ones' plans, and the pipeline against a plain one."""

import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import queries
from test_lines import plain as plain_lines

DATA = "/root/testdata"
SMALL = f"{DATA}/sf0.001"
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
supplied = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the supplied tables")


@supplied
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "pages", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    result = queries.QUERIES[name](spark, SMALL)
    columns = sorted(result.columns)
    relation = duck.sql(queries.SQL[name])
    assert sorted(relation.columns) == columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: SQL_TYPES[t] for c, t in result.dtypes} == types
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"SELECT {quoted} FROM ({queries.SQL[name]})").fetchall()
    got = [tuple(row[c] for c in columns) for row in result.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


@supplied
@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_line_dedup"])
def test_native_queries_start_no_python(spark, name, monkeypatch):
    plans = []

    def seen(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())

    if name == "op4_line_dedup":
        from plumbline.llm import lines

        stored = lines.stored
        monkeypatch.setattr(lines, "stored", lambda df, n: seen(df) or stored(df, n))
    seen(queries.QUERIES[name](spark, SMALL))
    assert plans and not any(re.search("Python|Arrow|InPandas", plan) for plan in plans)


# --- the pipeline ---------------------------------------------------------------------------


def fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_pipeline(rows, toxic):
    """(doc_id, text) of what is packed: each stage on all its predecessor kept."""
    rows = [r for r in rows if r[0] not in toxic]
    kept = []
    for (doc_id, text), (_, n, removed) in zip(rows, plain_lines(rows)):
        gone = {at for at, _, _ in removed}
        if gone and len(gone) == n:
            continue
        parts = [] if text is None else text.split("\n")
        kept.append((doc_id, text if text is None else "\n".join(p for i, p in enumerate(parts) if i not in gone)))
    prints = [fingerprint(t) for _, t in kept]
    label = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for i, (doc_id, _) in enumerate(kept):
        least[label[i]] = min(least.get(label[i], doc_id), doc_id)
    kept = [r for i, r in enumerate(kept) if r[0] == least[label[i]]]
    return [(d, None if t is None else re.sub(r"AKIA\w+|(?<=password = )\w+|password = \w+", "[removed]", t)) for d, t in kept]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    pick = random.Random(21)
    word = lambda: "".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 8)))
    vocabulary = [word() for _ in range(400)]
    line = lambda: " ".join(pick.choice(vocabulary) for _ in range(pick.randint(8, 20)))
    rows = [(i, "\n".join(line() for _ in range(pick.randint(1, 4)))) for i in range(70)]
    shared = line()
    rows += [(100 + i, f"{line()}\n{shared}\n{line()}") for i in range(10)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    rows += [(300 + i, f"you vile moron number {word()} {line()}") for i in range(40)]
    rows += [(400, f"{line()} AKIA{'Z' * 16} {line()}"), (401, None), (402, ""), (403, "x" * 50_000), (404, line())]
    folder = str(tmp_path_factory.mktemp("corpus"))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], columns)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(d, 1, int(300 <= d < 400)) for d, _ in rows if zlib.crc32(str(d).encode()) % 5 or d < 50]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_pipeline_equals_a_plain_one(spark, corpus):
    folder, rows = corpus
    scored = queries.op10_toxicity(spark, folder).collect()
    toxic = {r.doc_id for r in scored if r.predicted}
    assert {d for d, _ in rows if 300 <= d < 400} <= toxic and not any(d < 300 for d in toxic)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for doc_id, text in plain_pipeline(rows, toxic):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, lo in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[lo : lo + 2048], "<u4")
            want[doc_id, piece] = (lo, len(part), zlib.crc32(part.tobytes()))
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == want
    assert len(packed) == len(want) and 400 in {r.doc_id for r in packed}
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0] + [n for _, n in places[:-1]]))


def test_stages_keep_the_columns_of_documents(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_pipeline_takes_an_empty_table(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
