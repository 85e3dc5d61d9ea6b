"""URL filters: rules first, then words of the host and path weighed by naive Bayes.

``split_url`` and ``with_rule`` are native expressions. Where no rule fits, the host is segmented
into words by a unigram Viterbi search and a multinomial naive Bayes model weighs the words of
host and path. Everything the model needs is learned from the pages:

* word counts for the segmentation come from the words of every page's text and path. Hosts do not
  count, nor do host names in texts: a concatenated name is no word, however many pages it has;
* classes come from seed words (distant supervision): a page is an example of ``block`` if a
  seed is one of its host's words and of ``allow`` otherwise. Naive Bayes then learns which other
  words go with them.

A null URL, or one without ``://``, has an empty host and path, fits no rule, and is judged by the
prior alone. Repeated rows are judged one by one; other columns are carried along, except columns
named like the results, which are replaced.
"""

import math
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The rules of the contract, (verdict, host and path).
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

#: Words that mark an unwanted host, as examples to learn from.
SEEDS = frozenset(
    "casino bet bets poker slots jackpot pills viagra pharma adult porn sex xxx escort spam "
    "scam phishing malware warez torrent ads adserver tracker clickbait".split()
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (lower case in A-Z) and ``path``, both empty without ``://``."""
    rest = F.split(F.coalesce(F.col(url), F.lit("")), "://", 2)
    after = F.coalesce(F.get(rest, 1), F.lit(""))
    parts = pages.withColumn("__rest", after)
    authority = F.regexp_extract("__rest", r"^[^/?#]*", 0)
    return (
        parts.withColumns(
            {
                "host": lower_ascii(authority),
                "path": F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1),
            }
        )
    ).drop("__rest")


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` and ``rule_verdict``: the longest rule whose host and path fit, else null.

    Rules compile to one CASE, longest first; of two of one length the first given wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        host, slash, path = text.partition("/")
        fits = (
            (F.col("host") == host) | F.col("host").endswith("." + host)
        ) & F.col("path").startswith(slash + path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


#: Log probability of one more character of an unknown word.
LETTER = math.log(1 / 10)
#: A natural logarithm in a sum of whole numbers, so that no order of adding changes a score.
UNIT = 2**40


class Model(NamedTuple):
    """What scoring needs. The tables stay in Spark and hold every word and token."""

    words: DataFrame  # (word, n) of all words
    total: int  # occurrences of all words, the seeds' extra ones included
    seeds: frozenset
    extra_words: int
    hosts: DataFrame  # (host, words) of the pages learned from
    weights: DataFrame  # (token, weight): log P(token | block) - log P(token | allow), in UNITs
    prior: float


def unknown(total: int) -> float:
    """Log probability of an unknown word but for its length: that of ten of all occurrences."""
    return math.log(10 / max(100, total))


def segment(name: str, words: dict, opening: float) -> list[str]:
    """The most likely split of a name into words (Viterbi over unigrams).

    ``words`` has the log probability of every word that stands in the name. A piece that is no
    word costs ``opening`` and a flat amount a character, so the shorter an unknown word the
    likelier, and one long unknown piece beats many short ones. Ties go to the longest last word.
    """
    n, sizes = len(name), sorted({len(w) for w in words}, reverse=True)
    best, cut = [0.0] + [-math.inf] * n, [0] * (n + 1)
    run = [0.0] + [-math.inf] * n  # best score with an unknown piece ending here
    start = [0] * (n + 1)
    for end in range(1, n + 1):
        # An unknown piece goes on from the character before, or starts here.
        fresh = best[end - 1] + opening + LETTER
        if end > 1 and run[end - 1] + LETTER >= fresh:
            run[end], start[end] = run[end - 1] + LETTER, start[end - 1]
        else:
            run[end], start[end] = fresh, end - 1
        best[end], cut[end] = run[end], start[end]
        for size in sizes:
            p = words.get(name[end - size : end]) if size <= end else None
            if p is not None and best[end - size] + p > best[end]:
                best[end], cut[end] = best[end - size] + p, end - size
    found, end = [], n
    while end:
        found.append(name[cut[end] : end])
        end = cut[end]
    return found[::-1]


def host_labels(host: str = "host") -> Column:
    """The labels of a host, the top-level label and ``www`` apart."""
    named = F.split(F.regexp_extract(host, r"(?s)^(.*)\.", 1), "[^a-z0-9]+")
    return F.filter(named, lambda x: (x != "") & (x != "www"))


def path_words(path: str = "path") -> Column:
    """Words of a path, digits as one token."""
    found = F.regexp_extract_all(F.lower(path), F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    return F.transform(found, lambda x: F.when(x.rlike("^[0-9]"), "0").otherwise(x))


def segmented(hosts: DataFrame, counts: DataFrame, total: int, seeds, extra_words: int) -> DataFrame:
    """(host, words) of distinct hosts, split by the whole table of word counts.

    Every distinct label meets the counts of the words that stand in it: its pieces of a length
    that some word has are joined with the table. A task holds one label's words at a time.
    """
    named = stored(
        hosts.select("host", F.posexplode(host_labels()).alias("pos", "label")), "url-labels"
    )
    labels = stored(named.select("label").distinct(), "url-distinct-labels")
    longest = labels.agg(F.max(F.length("label")).alias("n")).first().n or 0
    # A short word must be common to be one: it would split any name.
    lengths = [
        r.size
        for r in counts.select(F.length("word").alias("size")).distinct().collect()
        if 2 < r.size <= longest
    ]
    runs = labels.select("label", F.explode(F.array_distinct(F.regexp_extract_all("label", F.lit("([a-z]+)"), F.lit(1)))).alias("run"))
    sized = runs.select("label", "run", F.explode(F.array(*map(F.lit, sorted(lengths))).cast("array<int>")).alias("size"))
    pieces = (
        sized.where(F.length("run") >= F.col("size"))
        .select("label", "run", "size", F.explode(F.sequence(F.lit(1), F.length("run") - F.col("size") + 1)).alias("at"))
        .select("label", F.col("run").substr(F.col("at"), F.col("size")).alias("word"))
    )
    met = pieces.join(counts, "word").groupBy("label").agg(F.collect_set(F.struct("word", "n")).alias("met"))

    def split(batches):
        for b in batches:
            rows = []
            for label, found in zip(b.column("label").to_pylist(), b.column("met").to_pylist()):
                known = {x["word"]: x["n"] for x in found or ()}
                for w in seeds:
                    if w in label:
                        known[w] = known.get(w, 0) + extra_words
                rows.append(segment(label, {w: math.log(n / total) for w, n in known.items() if n}, unknown(total)))
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array(rows, pa.list_(pa.string()))], ["label", "words"]
            )

    cuts = stored(
        labels.join(met, "label", "left").mapInArrow(split, "label string, words array<string>"),
        "url-label-words",
    )
    by_host = (
        named.join(cuts, "label")
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("w"))
        .select("host", F.flatten("w.words").alias("words"))
    )
    whole = hosts.select("host").join(by_host, "host", "left")
    return stored(
        whole.select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words")), "url-hosts"
    )


def word_counts(pages: DataFrame, url: str = "url", html: str | None = "html") -> DataFrame:
    """(word, n): how often each word stands in the pages' texts and paths, all pages counted."""
    texts = [F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://[^/?#]*([^?#]*)", 1)]
    if html and html in pages.columns:
        no_code = r"(?s)<(script|style)\b.*?</\1>|<[^>]*>|&#?[A-Za-z0-9]+;|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
        texts.append(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), no_code, " "))
    words = F.split(F.lower(F.concat_ws(" ", *texts)), "[^a-z]+")
    return (
        pages.select(F.explode(words).alias("word"))
        .where(F.length("word") > 1)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def learn(
    pages: DataFrame,
    url: str = "url",
    html: str | None = "html",
    seeds=SEEDS,
    extra_words: int = 1_000,
) -> Model:
    """Learn both models from all pages, with the counts of all words and all tokens.

    Seeds are always words of the dictionary. To the driver come totals only.
    """
    counts = stored(word_counts(pages, url, html), "url-word-counts")
    total = (counts.agg(F.sum("n").alias("n")).first().n or 0) + extra_words * len(seeds)
    parts = split_url(pages.select(url), url).select("host", "path")
    hosts = segmented(parts.select("host").distinct(), counts, total, seeds, extra_words)
    # Stored, so that what follows deals out rows itself and a common host can be split.
    named = stored(
        parts.join(hosts, "host").select(
            F.arrays_overlap("words", F.array(*map(F.lit, sorted(seeds))).cast("array<string>")).alias("block"),
            F.concat("words", path_words()).alias("tokens"),
        ),
        "url-tokens",
    )
    classes = {r.block: r["count"] for r in named.groupBy("block").count().collect()}
    seen = stored(
        named.select("block", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(
            F.sum(F.col("block").cast("long")).alias("block"),
            F.sum((~F.col("block")).cast("long")).alias("allow"),
        ),
        "url-token-counts",
    )
    sums = seen.agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("b"), F.sum("allow").alias("a")).first()
    size = sums.n + 1
    weight = F.log((F.col("block") + 1) / float((sums.b or 0) + size)) - F.log(
        (F.col("allow") + 1) / float((sums.a or 0) + size)
    )
    return Model(
        counts,
        total,
        frozenset(seeds),
        extra_words,
        hosts,
        seen.select("token", F.round(weight * UNIT).cast("long").alias("weight")),
        math.log((classes.get(True, 0) + 1) / (classes.get(False, 0) + 1)),
    )


def judge(
    pages: DataFrame, model: Model, rules=RULES, url: str = "url", threshold: float = 0.5
) -> DataFrame:
    """The pages with host, path, rule, ``words`` of the host, ``score`` and ``verdict``.

    ``score`` is the model's probability of block; the verdict is the rule's where one fits. A
    token that no page learned from has weighs nothing.
    """
    results = ["host", "path", "rule", "rule_verdict", "words", "score", "verdict"]
    ruled = with_rule(split_url(pages.drop(*results[2:]), url), rules)
    hosts, new = model.hosts, ruled.select("host").distinct().join(model.hosts, "host", "left_anti")
    if not new.isEmpty():
        hosts = hosts.unionByName(segmented(new, model.words, model.total, model.seeds, model.extra_words))
    rows = stored(
        ruled.join(hosts, "host").withColumn("__row", F.monotonically_increasing_id()), "url-rows"
    )
    tokens = rows.select("__row", F.explode(F.concat("words", path_words())).alias("token"))
    sums = tokens.join(model.weights, "token").groupBy("__row").agg(F.sum("weight").alias("__sum"))
    z = F.lit(model.prior) + F.coalesce(F.col("__sum") / float(UNIT), F.lit(0.0))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
    by_words = F.when(F.col("score") > threshold, "block").otherwise("allow")
    order = [c for c in ruled.columns if c != "rule_verdict"]
    return (
        rows.join(sums, "__row", "left")
        .withColumn("score", score)
        .withColumn("verdict", F.coalesce("rule_verdict", by_words))
        .select(*order, "words", "score", "verdict")
    )
