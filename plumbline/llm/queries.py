"""The operations bound to the supplied tables: one query each, over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, language, lines, packing, prefix_trie, quality, secrets, simhash, spelling, topk, toxicity, urls, vector_graph
from plumbline.llm.tables import crc_class, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op2_quality_rules(spark, sf_dir):
    """Texts of ``documents`` measured and judged by the threshold table."""
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


SQL["op2_quality_rules"] = quality.sql()


@query
def op7_language_id(spark, sf_dir):
    """Language of every text of ``documents``; a quarter of the documents is never learned from."""
    held_out = F.coalesce(crc_class("doc_id", 4) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.learn(docs.where(~held_out))
    return language.identify(docs.select("doc_id", "text"), profiles).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


@query
def op9_url_filters(spark, sf_dir):
    """Verdict on every URL of ``pages``."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages.select("page_id", "url"), urls.learn(pages)).select(
        "page_id", "host", "path", "rule", "verdict", "score"
    )


def toxicity_model(spark, sf_dir):
    """Learned from ``labels``, a fifth of the documents apart."""
    learned = F.coalesce(crc_class("doc_id", 5) != 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(learned & F.col("toxic").isNotNull())
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = toxicity.sample_keys(labels, "toxic", toxicity.PER_CLASS)
    # 2 * PER_CLASS distinct keys at most are broadcast to the texts; the base rate is that of all labels.
    totals = toxicity.class_totals(labels, "toxic")
    return toxicity.fit(texts.join(F.broadcast(marked), "doc_id"), totals=totals)


@query
def op10_toxicity(spark, sf_dir):
    """Toxicity of every text of ``documents``."""
    held_out = F.coalesce(crc_class("doc_id", 5) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity_model(spark, sf_dir)).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


@query
def op5_secret_scans(spark, sf_dir):
    """Secrets in every text of ``documents``, weak parts where they meet their complements."""
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("strong", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(secrets.listed("strong").cast("binary"), 256).alias("base_sha256"),
        secrets.listed(secrets.every()).alias("spans"),
    )


@query
def op1_topk_search(spark, sf_dir):
    """The five rows of ``embeddings`` that score highest for every fiftieth one."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


SQL["op1_topk_search"] = topk.sql()


@query
def op8_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every text of ``documents``."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def packed_documents(docs):
    """Pieces of documents with the digest of their ids, packed."""
    cut = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op6_best_fit_packing(spark, sf_dir):
    """All ``documents`` packed into sequences of 2048 tokens."""
    return packed_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op3_byte_bpe(spark, sf_dir):
    """Token ids of every text of ``documents``, and the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks)
    return byte_bpe.decode(tokens, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op4_line_dedup(spark, sf_dir):
    """Lines of ``documents`` that repeat an earlier line exactly or nearly, by document.

    ``kept`` has for each removed line the document and position of the line that stands for it.
    """
    found = lines.removed_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed.at").cast("array<string>"), ",").alias("removed"),
        F.array_join(
            F.transform("removed", lambda x: F.concat_ws(":", x["kept_key"], x["kept_at"])), ","
        ).alias("kept"),
    )


@query
def op13_spelling_variants(spark, sf_dir):
    """Frequent words of ``documents`` with their near words, form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


SQL["op13_spelling_variants"] = spelling.sql()


@query
def op11_conversation_prefix_trie(spark, sf_dir):
    """Nodes of the prefix trie of ``conversations``, rebuilt to begin alike within each hundred."""
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    rebuilt = prefix_trie.with_shared_heads(turns)
    return prefix_trie.nodes(rebuilt, turns.where("pos = 0").select("conv"))


SQL["op11_conversation_prefix_trie"] = prefix_trie.sql()


@query
def op12_embedding_near_dedup(spark, sf_dir):
    """Links and components of all rows of ``embeddings``."""
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op12_embedding_near_dedup"] = vector_graph.sql()
