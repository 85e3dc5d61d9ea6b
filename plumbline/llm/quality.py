"""Quality rules: one threshold table, compiled into one projection of native functions.

Every text is measured by Spark's own string and array functions and judged in the same
projection; no row is shuffled and no user function runs. A null or empty text counts as a text
without words. Extra columns of the input are carried along; columns of the same names as the
measures are replaced by them. Repeated rows are judged one by one.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import unused, whole_text

# Fixed values of the rules' contract: white space, and the characters counted as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

STOP_WORDS = (
    "the of and to in a is that was for it with as on be by are from this at "
    "der die das und ist ein eine nicht von zu mit den auf für "
    "de la le les et un une des que est en dans du pour "
    "el los las que y en un una es del para con por se"
).split()
_STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})


class Rule(NamedTuple):
    """A measure and the range it must lie in; None leaves an end open."""

    measure: str
    least: float | None
    most: float | None


BASE = (Rule("n_words", 50, None), Rule("repeat_word_share", None, 0.5))
RULES = (
    Rule("n_words", 50, 1_000_000),
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbol_share", None, 0.1),
    Rule("exclaim_share", None, 0.1),
    Rule("upper_share", None, 0.3),
    Rule("stop_word_share", 0.02, None),
    Rule("dup_line_share", None, 0.4),
    Rule("repeat_word_share", None, 0.3),
)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column, size: int) -> Column:
    """Words that lie in a window of ``size`` words which occurs twice or more.

    Windows are sorted by a 64-bit hash, then position, so equal ones are neighbours, and equal
    hashes are confirmed on the words. The positions of repeated windows, in order, each add what
    they cover beyond the one before. Texts all of whose windows differ are not sorted.
    """

    def repeated(w, s):
        def same(x, y):
            equal = x["h"] == y["h"]
            for k in range(size):
                equal = equal & (F.get(w, x["i"] + k) == F.get(w, y["i"] + k))
            return equal

        return F.transform(
            F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))),
            lambda x: x["i"],
        )

    def covered(p):
        return F.aggregate(
            F.transform(
                p, lambda x, i: F.least(F.lit(size), x - F.coalesce(F.get(p, i - 1), F.lit(-size)))
            ),
            F.lit(0),
            lambda total, x: total + x,
        )

    def count(w):
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - size),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]),
        )
        return _let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
                _let(
                    F.sort_array(
                        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
                    ),
                    lambda s: _let(F.sort_array(repeated(w, s)), covered),
                )
            ),
        )

    return F.when(F.size(words) > size, _let(words, count)).otherwise(0)


def measured(docs: DataFrame, text: str = "text", window: int = 3) -> DataFrame:
    """The documents with every measure that a rule may name.

    Columns named like a measure are replaced, all others carried along.
    """
    whole, split, listed = unused(docs.columns, "whole", "words", "lines")
    # The words and lines are made in a projection of their own: each is used many times.
    parts = docs.withColumn(whole, whole_text(text)).withColumns(
        {
            split: F.array_remove(F.split(whole, SPACE), ""),
            listed: F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    words, lines = F.col(split), F.col(listed)
    counts = parts.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(SYMBOL)).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeated_words(words, window).cast("long"),
            "n_exclaims": F.regexp_count(whole, F.lit("!")).cast("long"),
            "n_upper": F.regexp_count(whole, F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long"),
            "n_stop_words": F.size(
                F.filter(words, lambda w: w.isin(*_STOP_FORMS))
            ).cast("long"),
        }
    )
    n, lines_n = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return counts.withColumns(
        {
            "mean_word_length": F.col("word_chars") / n,
            "symbol_share": F.col("n_symbols") / n,
            "exclaim_share": F.col("n_exclaims") / n,
            "upper_share": F.col("n_upper") / chars,
            "stop_word_share": F.col("n_stop_words") / n,
            "dup_line_share": F.col("n_dup_lines") / lines_n,
            "repeat_word_share": F.col("n_repeat_words") / n,
        }
    ).drop(whole, split, listed)


def broken(rules) -> Column:
    """Whether any rule of the table is broken: one disjunction of comparisons."""
    tests = [F.col(r.measure) < r.least for r in rules if r.least is not None]
    tests += [F.col(r.measure) > r.most for r in rules if r.most is not None]
    verdict = F.lit(False)
    for test in tests:
        verdict = verdict | test
    return verdict


def judge(docs: DataFrame, rules=RULES, base=BASE, text: str = "text") -> DataFrame:
    """The documents with their measures, ``base_failed`` and ``kept``."""
    failed = broken(base)
    return measured(docs, text).withColumns(
        {"base_failed": failed, "kept": ~failed & ~broken(rules)}
    )


def sql() -> str:
    """The query's result as DuckDB SQL, with the same threshold table."""
    tests = [f"{r.measure} < {r.least}" for r in RULES if r.least is not None]
    tests += [f"{r.measure} > {r.most}" for r in RULES if r.most is not None]
    stops = ", ".join(f"'{w}'" for w in _STOP_FORMS)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
),
parts AS (
  SELECT k, doc_id, t,
    [w FOR w IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF w <> ''] AS words,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM texts
),
windows AS (
  SELECT k, i, list_aggregate(words[i:i + 2], 'string_agg', ' ') AS g
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM parts WHERE len(words) > 2)
),
repeated AS (
  SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, g) > 1
),
covered AS (
  SELECT k, count(DISTINCT i + d) AS n
  FROM repeated, (SELECT unnest([0, 1, 2]) AS d) GROUP BY k
),
counts AS (
  SELECT doc_id, len(words) AS n_words,
    CAST(coalesce(list_sum([length(w) FOR w IN words]), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims,
    length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper,
    len([w FOR w IN words IF w IN ({stops})]) AS n_stop_words
  FROM parts LEFT JOIN covered USING (k)
),
shares AS (
  SELECT *,
    word_chars / greatest(n_words, 1) AS mean_word_length,
    n_symbols / greatest(n_words, 1) AS symbol_share,
    n_exclaims / greatest(n_words, 1) AS exclaim_share,
    n_upper / greatest(word_chars, 1) AS upper_share,
    n_stop_words / greatest(n_words, 1) AS stop_word_share,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
    n_repeat_words / greatest(n_words, 1) AS repeat_word_share
  FROM counts
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM shares
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(tests)}) AS kept
FROM judged
"""
