"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

1. Texts are split into pre-tokens. A task numbers the distinct words of a chunk of documents and
   keeps, for every pre-token in order, its word's number: the positions. The words go out in
   blocks, one for each bucket of the word hash.
2. Blocks are shuffled by bucket, so all mentions of a word meet in one task, at most one from a
   chunk, and the word is encoded once there. However common a word is, a chunk sends it once.
3. The ids go back to the chunks, are joined to the words' numbers and put in place by position.

Chunks are bounded in characters, so the memory of each step is bounded. What step 1 makes is
stored before use: a task that is lost and run again meets the same numbers.

Decoding joins each id to the vocabulary's bytes. That table's size is fixed by the vocabulary
(some 50,000 rows), so it is sent to every task and joined there.

A null text is an empty one, without tokens. No special token is ever produced. Repeated keys and
rows give a row each.
"""

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.tables import stored_by, text_batches, trimmed

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHER = re.compile(f"[^\t\n\r -~{LETTERS}]")
# The same splitter for texts in plain characters only, in forms that are faster to match.
PLAIN = re.compile(
    rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 bytes and a rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str = PATTERN):
    """A function that cuts a text into its pre-tokens."""
    anything = regex.compile(pattern)
    plain = PLAIN if pattern == PATTERN else None
    return lambda t: (plain if plain and not OTHER.search(t) else anything).findall(t)


def press(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2**32, compressed byte plane by byte plane."""
    out = [np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()]
    for a in arrays:
        out.append(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpress(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:4].view("<u4")[0])
    sizes, at, found = raw[4 : 4 + 4 * n].view("<u4").tolist(), 4 + 4 * n, []
    for size in sizes:
        planes = raw[at : at + 4 * size].reshape(4, size)
        found.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
        at += 4 * size
    return found


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] numbers each."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


PLACED = 1 << 18  # words put in place at once
CHUNK = "chunk string, bucket int, key binary, sizes binary, payload binary"


def pretokens(docs: DataFrame, key: str, text: str, pattern: str, buckets: int, chunk_chars: int) -> DataFrame:
    """Chunks of documents: a row of word numbers (bucket null), and a block of words a bucket."""
    kind = docs.select(key).schema[key].dataType
    arrow = T.StructType([T.StructField("key", kind)])

    def cut(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        split, part = splitter(pattern), TaskContext.get().partitionId()
        key_type = to_arrow_schema(arrow).field("key").type
        for at, (keys, texts) in enumerate(_chunks(batches, [key, text], chunk_chars)):
            number, codes, sizes = {}, [], []
            for t in texts:
                words = split(t or "")
                sizes.append(len(words))
                codes.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)))
            # Words in order of bucket, then as first met; the numbers follow that order.
            raw = [w.encode() for w in number]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(raw), np.uint32)
            place[order] = np.arange(len(raw))
            codes = place[np.concatenate(codes)] if raw else np.zeros(0, np.uint32)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("key", key_type)])) as w:
                w.write_batch(pa.record_batch([pa.array(keys, key_type)], ["key"]))
            name = f"{part}-{at}"
            rows = [(name, None, sink.getvalue().to_pybytes(), press(np.array(sizes)), press(codes))]
            starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                words = [raw[k] for k in order[starts[b] : starts[b + 1]]]
                if words:
                    lengths = press(np.array([len(w) for w in words]))
                    rows.append((name, b, None, lengths, zstandard.ZstdCompressor(level=1).compress(b"".join(words))))
            types = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], x) for i, x in enumerate(types)],
                ["chunk", "bucket", "key", "sizes", "payload"],
            )

    return docs.select(key, text).mapInArrow(trimmed(cut), CHUNK)


def _chunks(batches, columns, limit):
    """Batches of rows joined up to about ``limit`` characters of text."""
    keys, texts, size = [], [], 0
    for k, t in text_batches(batches, columns, limit):
        n = sum(len(x) for x in t if x)
        if texts and size + n > limit:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys, texts, size = keys + k, texts + t, size + n
    if texts:
        yield keys, texts


def encoded_words(blocks: DataFrame, ranks, pattern: str, buckets: int, remembered: int = 100_000) -> DataFrame:
    """Blocks of words (chunk, bucket, ...) as blocks of ids, every distinct word encoded once.

    A task remembers the words it has encoded, with their ids packed, within a limit of memory: of
    words and, so that long ones cannot fill it, of bytes (32 a word on the whole).
    """

    def encode(batches):
        # The splitting pattern has done its work; single words are merged here.
        merger = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known, held = {}, 0
        for b in batches:
            sizes, payload = [], []
            for s, p in zip(b.column("sizes"), b.column("payload")):
                lengths = unpress(s.as_py())[0].astype(np.int64)
                raw = zstandard.ZstdDecompressor().decompress(p.as_py())
                ids, counts, at = [], [], 0
                for n in lengths.tolist():
                    word = raw[at : at + n]
                    at += n
                    found = known.get(word)
                    if found is None:
                        held += n
                        if len(known) >= remembered or held > 32 * remembered:
                            known, held = {}, n
                        found = known[word] = np.array(merger._encode_single_piece(word), "<u4").tobytes()
                    ids.append(found)
                    counts.append(len(found) // 4)
                sizes.append(press(np.array(counts)))
                payload.append(press(np.frombuffer(b"".join(ids), "<u4")))
            yield pa.RecordBatch.from_arrays(
                [b.column("chunk"), b.column("bucket"), pa.array(sizes, pa.binary()), pa.array(payload, pa.binary())],
                ["chunk", "bucket", "sizes", "payload"],
            )

    return (
        blocks.select("chunk", "bucket", "sizes", "payload")
        .repartition(buckets, "bucket")
        .mapInArrow(trimmed(encode), "chunk string, bucket int, sizes binary, payload binary")
    )


def encode(
    docs: DataFrame,
    ranks_path: str,
    key: str = "doc_id",
    text: str = "text",
    pattern: str = PATTERN,
    buckets: int | None = None,
    chunk_chars: int = 6_000_000,
) -> DataFrame:
    """(key, ids): every document's token ids. ``buckets`` defaults to the shuffle partitions.

    ``chunk_chars`` bounds what a task holds; ids do not depend on it.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))  # the vocabulary: fixed size
    cut = pretokens(docs, key, text, pattern, buckets, chunk_chars)
    # Stored by chunk, so that positions stay where they are and only words and ids are shuffled.
    chunks = stored_by(cut, "pretokens", "chunk", buckets)
    words = encoded_words(chunks.where("bucket IS NOT NULL"), ranks, pattern, buckets)
    kind = docs.select(key).schema[key].dataType

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        """One chunk: its documents' numbers (one row) and its words' ids (a row a bucket)."""
        ends, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for r in sorted(right.to_pylist(), key=lambda r: r["bucket"]):
            ends.append(unpress(r["sizes"])[0].astype(np.int64))
            values.append(unpress(r["payload"])[0])
        counts, values = np.concatenate(ends), np.concatenate(values)
        starts = np.cumsum(counts) - counts
        tables = []
        for row in left.to_pylist():
            codes, sizes = unpress(row["payload"])[0], unpress(row["sizes"])[0].astype(np.int64)
            each = counts[codes]
            ids = np.empty(each.sum(), np.int32)
            at = 0
            for lo in range(0, len(codes), PLACED):
                part = slice(lo, lo + PLACED)
                run = _runs(starts[codes[part]], each[part])
                ids[at : at + len(run)] = values[run]
                at += len(run)
            upto = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(sizes))]
            keys = pa.ipc.open_stream(row["key"]).read_all().column("key").combine_chunks()
            tables.append(
                pa.table({key: keys, "ids": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids))})
            )
        return pa.concat_tables(tables)

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    positions = chunks.where("bucket IS NULL").select("chunk", "key", "sizes", "payload")
    return positions.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(place, schema)


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """The rows with the bytes their ids stand for; null ids are none. Unknown ids are an error."""
    spark = tokens.sparkSession
    kept = tokens.drop(name)
    table = spark.sparkContext.broadcast({n: b for b, n in read_ranks(spark, ranks_path).items()})
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.BinaryType())])

    def joined(batches):
        of = table.value.__getitem__
        for b in batches:
            found = [b"".join(map(of, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in b.column(ids)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*b.schema.names, name])

    return kept.mapInArrow(trimmed(joined), schema)
