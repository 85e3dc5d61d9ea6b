"""Fuzzy line dedup by MinHash, in native DataFrame operations only.

Lines are the parts of a text between line feeds. Equal lines are one line from the start, so each
distinct line is signed once. Its shingles are runs of characters, hashed to 64 bits; a line shorter
than a shingle is its own only shingle. The signature takes the ``rows`` smallest hashes in each of eight
ranges of the hash space, and each range's choice is one band. Two lines with similarity s share a
band with probability 1 - (1 - s^rows)^8, which is 0.997 at 0.8.

Lines that share a band are candidates, verified by the exact Jaccard similarity of the sets of all
their shingles; pairs whose sets differ too much in size to be similar are left out before. Within a
group a representative meets others, not every pair: what proves similar is joined into a component by
distributed union-find, and only groups that still hold several components go on. Of few lines all pairs
meet. In a larger group all meet one representative. Two lines of which one is unlike it are similar only if

* all they have in common is in the representative, so each has that much in common with it; or
* they share a fresh shingle, which the representative lacks. A line of n shingles lacks at most 0.2 n of a
  similar one's, so in the order fresh shingles first, and each kind by hash, their first common shingle
  is among the first 0.2 n + 1. What can follow in both, and what each shares with the representative,
  bounds what they have in common.

Pairs that pass such a bound meet. So no link among candidates is lost, and lines that share a passage
without being similar need not all meet.

Of each component one line stays, its first occurrence by document id (null last), then by place in
the table and position. Every row of the input has a row in the result. A null text has no lines;
blank lines stay where they are and are not counted. Repeated rows and ids are rows of their own, so
the lines of a repeated row repeat those of the first. Other columns are carried along by
``without_repeats`` whatever their names, and play no part.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.tables import stored, stored_by

SHINGLE = 8
ROWS = 3
SIMILARITY = 0.8
RANGE_BITS = 3  # eight bands
ALL_PAIRS = 8  # lines of a group whose pairs all meet


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def shingles(line: str | Column, size: int = SHINGLE) -> Column:
    """Hashes of all distinct shingles of ``size`` characters, in any order."""
    # Four bytes a character: a shingle is cut out by its place, however long the line.
    wide = F.encode(line, "UTF-32")

    def hashed(b):
        last = F.floor(F.octet_length(b) / 4).cast("int") - size
        return F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.greatest(last, F.lit(0)) * 4 + 1, F.lit(4)),
                lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * size))),
            )
        )

    return _let(wide, hashed)


def bands(hashes: Column, rows: int = ROWS) -> Column:
    """Keys of the bands that a line has: a hash of the smallest ``rows`` of each range.

    Of many hashes only the low ones of each range are sorted. If they hold ``rows`` of every range,
    these are the smallest of all; if not, all are sorted.
    """
    bucket = lambda x: F.shiftright(x, 64 - RANGE_BITS)
    ranges = 1 << RANGE_BITS
    enough = 4 * rows * ranges

    def smallest(s):
        return F.filter(
            s,
            lambda x, i: F.coalesce(bucket(x) != bucket(F.get(s, i - rows)), F.lit(True)),
        )

    def of_all(s):
        return _let(F.sort_array(s), smallest)

    def of_low(s):
        limit = F.shiftleft(F.floor(F.lit(enough << 30) / F.size(s)).cast("long"), 64 - RANGE_BITS - 30)
        low = _let(limit, lambda t: F.filter(s, lambda x: x.bitwiseAND(F.lit((1 << (64 - RANGE_BITS)) - 1)) < t))
        return _let(of_all(low), lambda c: F.when(F.size(c) == rows * ranges, c).otherwise(of_all(s)))

    def keys(chosen):
        def key(x, i):
            # The last of a range takes those before it in the range along.
            others = [F.get(chosen, i - k) for k in range(rows - 1, 0, -1)]
            same = [F.when(bucket(o) == bucket(x), o) for o in others]
            last = F.coalesce(bucket(x) != bucket(F.get(chosen, i + 1)), F.lit(True))
            return F.when(last, F.xxhash64(bucket(x), *same, x))

        return F.array_compact(F.transform(chosen, key))

    chosen = _let(hashes, lambda s: F.when(F.size(s) > enough, of_low(s)).otherwise(of_all(s)))
    return _let(chosen, keys)


def signature(line: str, size: int, rows: int) -> Column:
    """How many shingles a line has, and its bands."""
    return _let(
        shingles(line, size), lambda s: F.struct(F.size(s).alias("size"), bands(s, rows).alias("bands"))
    )


def _lines(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns with ``at`` and ``line``: every line that is not blank, with two hashes of it."""
    found = rows.select(*columns, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return found.where(F.col("line").rlike(r"\S")).withColumns(
        {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")}
    )


def band_members(distinct: DataFrame) -> DataFrame:
    """(band, id, size, order) of every band that two or more different lines share."""
    listed = distinct.select(F.explode("bands").alias("band"), "id", "size", (-F.col("n")).alias("order"))
    ends = listed.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    shared = stored(ends.where("low < high").select("band"), "shared-bands")
    return stored(listed.join(shared, "band"), "band-members")


def _enough(shared, left, right, similarity: float) -> Column:
    """Whether sets of two sizes with so many common shingles are similar."""
    return shared >= similarity * (left + right - shared)


def _with_lines(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (rep, id) with their lines ``a`` and ``b``."""
    left = texts.select(F.col("id").alias("rep"), F.col("line").alias("a"))
    return pairs.join(left, "rep").join(texts.select("id", F.col("line").alias("b")), "id")


def _near(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (rep, id) of lines that are similar, by the sets of all their shingles."""
    # Both sets are named inside the condition: a filter pushed to the join would make them at each use.
    enough = lambda x, y: lambda n: _enough(n, F.size(x), F.size(y), similarity)
    similar = _let(
        shingles("a", size),
        lambda x: _let(shingles("b", size), lambda y: _let(F.size(F.array_intersect(x, y)), enough(x, y))),
    )
    return _with_lines(pairs, texts).where(similar).select("rep", "id")


def _against(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """Pairs (rep, id, ...) with ``shared``, the number of common shingles, and ``fresh``.

    ``fresh`` has the first of the line's shingles that its representative lacks, in the order of hashes:
    as many as the line can lack of a line similar to it, and one more.
    """
    spare = lambda y: F.size(y) - F.ceil(similarity * F.size(y) - F.lit(1e-6)).cast("int") + 1
    told = _let(
        shingles("a", size),
        lambda x: _let(
            shingles("b", size),
            lambda y: _let(
                F.array_except(y, x),
                lambda e: F.struct(
                    (F.size(y) - F.size(e)).alias("shared"), F.slice(F.sort_array(e), 1, spare(y)).alias("fresh")
                ),
            ),
        ),
    )
    return _with_lines(pairs, texts).withColumn("told", told).select(*pairs.columns, "told.*")


def _bucket(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(1))) * 32).cast("int")


def _within(against: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) about one representative that may be similar by what each shares with it.

    For lines of which one is unlike the representative and that share none of their fresh shingles: all
    that they have in common is in the representative, so neither has less in common with that.
    """
    most = F.col("shared") * ((1 + similarity) / similarity) - F.col("size")  # size of the other line
    sizes = F.sequence(_bucket(F.floor(similarity * F.col("size")) - 1), _bucket(F.ceil(most) + 1))
    unlike = (
        against.where(~_enough(F.col("shared"), F.col("size"), F.col("rep_size"), similarity))
        .where(most >= similarity * F.col("size") - 1)
        .select("rep", F.explode(sizes).alias("bucket"), *[F.col(c).alias(f"{c}_x") for c in ("id", "root", "size", "shared")])
    )
    others = against.select("rep", _bucket(F.col("size")).alias("bucket"), "id", "root", "size", "shared")
    may = (
        F.expr("id <> id_x AND root <> root_x")
        & (F.least("size", "size_x") >= similarity * F.greatest("size", "size_x"))
        & _enough(F.least("shared", "shared_x"), F.col("size"), F.col("size_x"), similarity)
    )
    return unlike.join(others, ["rep", "bucket"]).where(may).select(F.col("id_x").alias("a"), F.col("id").alias("b"))


def _sharing(against: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) about one representative that may be similar, by a fresh shingle that both have.

    What they have in common of the representative is at most what one of them has, and of fresh shingles
    at most what follows in both on the first that they share.
    """
    fresh = against.select("rep", "id", "root", "size", "shared", "fresh", F.posexplode("fresh").alias("at", "shingle"))
    fresh = fresh.withColumn("before", F.get("fresh", F.col("at") - 1)).drop("fresh")
    ends = fresh.groupBy("rep", "shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    fresh = stored(fresh.join(ends.where("low < high").select("rep", "shingle"), ["rep", "shingle"]), "fresh-shingles")
    other = fresh.select("rep", "shingle", *[F.col(c).alias(f"{c}_x") for c in ("id", "root", "size", "shared", "at", "before")])
    # Where the shingles before are equal too, this is not the first that they share.
    first = F.expr("before IS NULL OR before_x IS NULL OR before <> before_x")
    most = F.expr("least(shared, shared_x) + least(size - shared - at, size_x - shared_x - at_x)")
    may = F.expr("id < id_x AND root <> root_x") & _enough(most, F.col("size"), F.col("size_x"), similarity)
    return fresh.join(other, ["rep", "shingle"]).where(may & first).select(F.col("id").alias("a"), F.col("id_x").alias("b"))


def _open(groups: DataFrame) -> DataFrame:
    """The groups (group, id, root, ...) that hold several components, ``small`` if all pairs are few."""
    ends = groups.groupBy("group").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), (F.count(F.lit(1)) <= ALL_PAIRS).alias("small")
    )
    return groups.join(ends.where("low < high").select("group", "small"), "group")


def _chosen(groups: DataFrame) -> DataFrame:
    """A representative of each group: the line that stands most often, as others are like it."""
    first = F.min(F.struct("order", "id", "root", "size")).alias("r")
    return groups.groupBy("group").agg(first).select(
        "group", F.col("r.id").alias("rep"), F.col("r.root").alias("rep_root"), F.col("r.size").alias("rep_size")
    )


def similar_lines(distinct: DataFrame, similarity: float, size: int) -> DataFrame:
    """(node, root) of the distinct lines (id, line, n, size, bands) that are similar to others."""
    members = band_members(distinct).withColumnRenamed("band", "group")
    lines = stored(members.select("id", "size", "order").distinct(), "candidates")
    # Candidates only, and stored by id, so that no round shuffles them.
    texts = stored_by(
        distinct.join(lines, "id", "left_semi").select("id", "line"),
        "candidate-lines",
        "id",
        int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )
    found = {"roots": None, "tested": None}

    def linked(edges: DataFrame) -> None:
        """Joins the components by further links (rep, id)."""
        if edges.isEmpty():
            return
        edges = edges.select(F.col("rep").alias("a"), F.col("id").alias("b"))
        if found["roots"] is not None:
            edges = edges.unionByName(found["roots"].select(F.col("node").alias("a"), F.col("root").alias("b")))
        found["roots"] = stored(components(edges), "line-roots")

    def named(rows: DataFrame) -> DataFrame:
        """The rows with the component's ``root`` of their ``id``."""
        if found["roots"] is None:
            return rows.withColumn("root", F.col("id"))
        roots = found["roots"].withColumnRenamed("node", "id")
        return rows.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))

    def meet(pairs: DataFrame) -> None:
        """Tests pairs (a, b) that have not met yet, and joins the components of the similar ones."""
        asked = pairs.select(F.least("a", "b").alias("rep"), F.greatest("a", "b").alias("id")).distinct()
        tested = found["tested"]
        if tested is not None:
            asked = asked.join(tested, ["rep", "id"], "left_anti")
        asked = stored(asked, "pairs")
        found["tested"] = asked if tested is None else tested.unionByName(asked)
        linked(stored(_near(asked, texts, similarity, size), "near-lines"))

    # Sets of such different sizes cannot be similar enough, so these two need not meet.
    fits = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y)
    # First each line meets one representative only: most groups are settled by it.
    met = members.join(_chosen(members.withColumn("root", F.col("id"))), "group")
    met = met.where(F.expr("id <> rep") & fits("size", "rep_size")).groupBy("id").agg(F.min("rep").alias("rep"))
    meet(met.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    groups = stored(_open(named(members)), "open-groups")
    small = groups.where("small").select("group", "id", "size", "root")
    other = small.select("group", *[F.col(c).alias(f"{c}_x") for c in ("id", "size", "root")])
    both = small.join(other, "group").where(F.expr("id < id_x AND root <> root_x") & fits("size", "size_x"))
    meet(both.select(F.col("id").alias("a"), F.col("id_x").alias("b")))
    # Groups of one representative are one from here on.
    large = groups.where("NOT small").drop("small")
    about = large.join(_chosen(large), "group").where("id <> rep")
    about = about.select("rep", "rep_size", "id", "size").distinct()
    against = stored(_against(about, texts, similarity, size), "against")
    like = _enough(F.col("shared"), F.col("size"), F.col("rep_size"), similarity)
    linked(against.where(like).select("rep", "id"))
    meet(_within(named(against.drop("fresh")), similarity))
    meet(_sharing(named(against), similarity))
    if found["roots"] is None:
        return distinct.select(F.col("id").alias("node"), F.col("id").alias("root")).where(F.lit(False))
    return found["roots"]


def repeats(rows: DataFrame, similarity: float, size: int, signature_rows: int) -> DataFrame:
    """(row, removed) of numbered documents (row, key, text) that have lines to go.

    ``removed`` lists position, and key, row and position of the line that stays, in order.
    """
    distinct = stored(
        _lines(rows)
        .groupBy("line", "h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("line", "h1", "h2", "n", F.monotonically_increasing_id().alias("id"))
        .withColumn("signed", signature("line", size, signature_rows)),
        "distinct-lines",
    )
    roots = similar_lines(distinct.select("id", "line", "n", "signed.*"), similarity, size)
    # Lines that stand once and are like no other need not be looked at again.
    lone = distinct.select("h1", "h2", "n", "id")
    heads = roots.select(F.col("root").alias("id")).distinct().withColumn("head", F.lit(True))
    classes = stored(
        lone.join(roots.withColumnRenamed("node", "id"), "id", "left")
        .join(heads, "id", "left")
        .where("n > 1 OR root IS NOT NULL OR head")
        .select("h1", "h2", F.coalesce("root", "id").alias("class")),
        "line-classes",
    )
    place = F.struct(F.col("key").isNull().alias("no_key"), "key", "row", "at")
    classed = stored(
        _lines(rows, "row", "key").drop("line").join(classes, ["h1", "h2"]).select("class", place.alias("place")),
        "classed-lines",
    )
    kept = stored(classed.groupBy("class").agg(F.min("place").alias("kept")), "kept-lines")
    gone = classed.join(kept, "class").where("place <> kept")
    item = F.struct(
        F.col("place.at").alias("at"),
        F.col("kept.key").alias("kept_key"),
        F.col("kept.row").alias("kept_row"),
        F.col("kept.at").alias("kept_at"),
    )
    return gone.groupBy(F.col("place.row").alias("row")).agg(F.array_sort(F.collect_list(item)).alias("removed"))


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    columns = [F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")]
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    others = F.struct(*rest, F.lit(0).alias("")).alias("all")  # never without a field
    return stored(docs.select(*columns, others), "numbered-documents")


def removed_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    size: int = SHINGLE,
    rows: int = ROWS,
) -> DataFrame:
    """(key, n_lines, removed): one row for every row, with the lines that another stands for.

    ``removed`` is empty where nothing goes. An item has the line's position ``at`` and the key and
    position of the line that stays.
    """
    numbered = _numbered(docs.select(key, text), key, text)
    gone = repeats(numbered, similarity, size, rows)
    n_lines = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S")))
    counted = numbered.select("row", "key", F.coalesce(n_lines, F.lit(0)).alias("n_lines"))
    joined = counted.join(gone, "row", "left")
    none = F.array().cast(gone.schema["removed"].dataType)
    return joined.select(F.col("key").alias(key), "n_lines", F.coalesce("removed", none).alias("removed"))


def without_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    size: int = SHINGLE,
    rows: int = ROWS,
) -> DataFrame:
    """The documents with repeated lines taken out of their texts.

    Documents all of whose lines repeat others are left out; those without any line stay.
    """
    numbered = _numbered(docs, key, text)
    gone = repeats(numbered.drop("all"), similarity, size, rows).select("row", "removed.at")
    parts = F.split("text", "\n")
    stay = _let(
        parts,
        lambda x: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("at")), lambda i: F.get(x, i)
        ),
    )
    had = F.size(F.filter(parts, lambda x: x.rlike(r"\S")))
    joined = numbered.join(gone, "row", "left").where(F.col("at").isNull() | (F.size("at") < had))
    left = F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return joined.select(
        *[left.alias(c) if c == text else F.col("all").getField(c).alias(c) for c in docs.columns]
    )
