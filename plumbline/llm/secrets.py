"""Secret scans with multipart linking.

Three strong patterns (assignments of credentials, access identifiers, long hex runs) are found in
every whole text and always reported. Weak candidates, each harmless alone, are reported only when
the parts of a credential meet: an identifier, a secret and an endpoint are linked by an interval
join within scopes. A part's interval is its span widened by ``reach`` characters; parts of one
document whose intervals overlap and whose kinds complement each other support one another. So do
complements in one block, the lines between two blank ones, at any distance.

One pass over the texts emits the spans, a few short rows a document. The join runs on spans only:
each part is listed under the cells its interval touches, so a join partition holds one cell of one
text and not one document. Texts that are equal share one scope, keyed by a 128-bit digest, so a
group of copies is linked once.

A null text is an empty one and has no spans. Spans are in code points, ends exclusive. Repeated
rows and repeated ids give a row each; columns of the input are carried along, columns named like
the results are replaced.
"""

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.tables import stored, trimmed

# Fixed values of the contract: the strong kinds in order, their patterns and least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

DIGIT = re.compile("[0-9]")
#: Weak kinds: (kind, role, signs, pattern). A text without one of the signs has no match; they
#: only save time. The span is that of the group that matched where there is one.
WEAK = (
    (
        "account",
        "identifier",
        ":=",
        re.compile(
            r"(?i:\b(?:user(?:name)?|login|account|client_id|key_id)\b)[\"']?[ ]*[:=][ ]*[\"']?"
            r"([\w.@+-]{3,})"
        ),
    ),
    ("email", "identifier", "@", re.compile(r"(?<![\w.+-])[.+-]*(\w[\w.+-]*@[\w-]+(?:\.[\w-]+)+)")),
    (
        "opaque",
        "secret",
        "0123456789",
        re.compile(
            r"(?<![\w+/=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9a-z+/_=-]*[A-Z])"
            r"[A-Za-z0-9+/_=-]{20,}(?![\w+/=-])"
        ),
    ),
    (
        "short_pass",
        "secret",
        ":=",
        # A quoted value goes on to its closing quote, at most to the end of the line.
        re.compile(
            r"(?i:\b(?:pass|pwd|pin|auth)\b)[\"']?[ ]*[:=][ ]*"
            r"(?:\"([^\"\r\n]{4,})\"|'([^'\r\n]{4,})'|[\"']?([^\s\"']{4,}))"
        ),
    ),
    ("url", "endpoint", ":", re.compile(r"(?<![\w+.-])[0-9+.-]*([a-z][a-z0-9+.-]+://[^\s\"'<>]{4,})")),
    (
        "host_port",
        "endpoint",
        ":",
        re.compile(r"(?<![\w.-])[.-]*([a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,}:[0-9]{2,5})\b"),
    ),
)
#: What a strong span is when it takes part in linking.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret"}
REACH = 120
#: What parts the blocks of a text: a blank line.
BLANK = re.compile(r"\n[^\S\n]*(?=\n)")

SPAN = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("role", T.StringType()),
            T.StructField("weak", T.BooleanType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
        ]
    )
)


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strong kinds, by start, then kind as listed."""
    found, lower = [], text.lower()
    if any(w in lower for w in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def weak_spans(text: str) -> list[tuple[str, str, int, int]]:
    found = []
    digits = DIGIT.search(text) is not None
    for kind, role, signs, pattern in WEAK:
        if digits if signs[0] == "0" else any(x in text for x in signs):
            found += [(kind, role, *m.span(m.lastindex or 0)) for m in pattern.finditer(text)]
    return found


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``spans`` (strong and weak) and ``scope``, the digest of the text."""
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("scope", T.BinaryType()), T.StructField("spans", SPAN)]
    )
    arrow = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("role", pa.string()), ("weak", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("block", pa.int32())]
        )
    )

    def scanned(batches):
        for b in batches:
            scopes, spans = [], []
            for t in b.column(text):
                t = t.as_py() or ""
                strong = strong_spans(t)
                blanks = [m.end() for m in BLANK.finditer(t)]
                taken = {(a, e) for _, a, e in strong}
                spans.append(
                    [dict(kind=k, role=ROLES[k], weak=False, start=a, end=e, block=bisect_right(blanks, a)) for k, a, e in strong]
                    + [
                        dict(kind=k, role=r, weak=True, start=a, end=e, block=bisect_right(blanks, a))
                        for k, r, a, e in weak_spans(t)
                        if (a, e) not in taken
                    ]
                )
                scopes.append(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(scopes, pa.binary()), pa.array(spans, arrow)],
                [*b.schema.names, "scope", "spans"],
            )

    return docs.mapInArrow(trimmed(scanned), schema)


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts that a part of another role supports, from (scope, kind, role, weak, start, end, block).

    Two parts support each other if one is a secret and the other an identifier or an endpoint, and
    they stand in one block of the text, however far apart, or their gap is at most ``reach``. A part is listed under every cell its widened interval
    touches; a pair may meet in several cells, so support is a semi-join and no pair is emitted.
    """
    low = F.floor(F.greatest(F.col("start") - reach, F.lit(0)) / reach)
    high = F.floor((F.col("end") + reach) / reach)
    touched = parts.withColumn("cell", F.explode(F.sequence(low, high)))
    # The other side needs only the cells of its own span: the weak side's are already widened.
    own = parts.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach)))
    )
    weak = touched.where("weak").alias("w")
    other = own.select("scope", "cell", "role", "start", "end").distinct().alias("o")
    meets = (
        (F.col("w.scope") == F.col("o.scope"))
        & (F.col("w.cell") == F.col("o.cell"))
        & (F.col("w.start") <= F.col("o.end") + reach)
        & (F.col("o.start") <= F.col("w.end") + reach)
        & ((F.col("w.role") == "secret") != (F.col("o.role") == "secret"))
    )
    columns = ["scope", "kind", "start", "end"]
    secret = F.col("role") == "secret"
    blocks = (
        parts.groupBy("scope", "block")
        .agg(F.max(secret).alias("with_secret"), F.max(~secret).alias("with_other"))
        .where("with_secret AND with_other")
    )
    # Where a block has both sides, each of its parts has a complement.
    within = parts.where("weak").join(blocks, ["scope", "block"], "left_semi").select(*columns)
    near = weak.join(other, meets, "left_semi").select(*columns)
    return near.unionByName(within).distinct()


SHAPE = "array<struct<kind:string,start:int,end:int>>"


def _links(slim: DataFrame, reach: int) -> DataFrame:
    """(scope, linked): the supported weak parts of every text that has any."""
    parts = (
        slim.where(F.exists("spans", lambda x: x["weak"]))
        .select("scope", F.inline("spans"))
        .distinct()
    )
    # A list holds the weak spans of one text. Stored, so that the join back deals out both sides
    # itself and can split a scope that many copies share.
    return stored(
        linked(parts, reach)
        .groupBy("scope")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
        .select("scope", F.transform("found", _shape).alias("linked")),
        "secret-links",
    )


def _shape(x) -> Column:
    return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def _with_links(scanned: DataFrame, links: DataFrame | None) -> DataFrame:
    strong = F.transform(F.filter("spans", lambda x: ~x["weak"]), _shape)
    joined = (
        scanned.withColumn("linked", F.lit(None).cast(SHAPE))
        if links is None
        else scanned.join(links, "scope", "left")
    )
    return joined.withColumns(
        {"strong": strong, "linked": F.coalesce("linked", F.array().cast(SHAPE))}
    ).drop("scope", "spans")


def find(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """The documents without their text, with ``strong`` and ``linked``: arrays of (kind, start, end)."""
    kept = docs.drop("scope", "spans", "strong", "linked")
    slim = stored(scan(kept, text).drop(text), "secret-spans")
    return _with_links(slim, _links(slim, reach))


def listed(spans) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def every(strong="strong", linked="linked") -> Column:
    """Strong and linked spans together, by start; at one start the strong come first, as listed."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = lambda x: F.struct(
        x["start"].alias("start"),
        F.coalesce(F.nullif(F.array_position(order, x["kind"]), F.lit(0)), F.lit(99)).alias("rank"),
        x["kind"].alias("kind"),
        x["end"].alias("end"),
    )
    return F.array_sort(F.transform(F.concat(strong, linked), keyed))


def redact(docs: DataFrame, text: str = "text", reach: int = REACH, mark: str = "[removed]") -> DataFrame:
    """The documents with every reported span cut out of the text and a mark in its place.

    Overlapping spans are cut as one. A null text stays null.
    """
    # Under names of their own the columns cannot clash with those made here.
    kept = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    columns, text = docs.columns, f"c{docs.columns.index(text)}"
    links = _links(stored(scan(kept.select(text), text).drop(text), "secret-spans"), reach)
    # Only texts with weak candidates meet the links; all others are cut where they are.
    scanned, weak = scan(kept, text), F.exists("spans", lambda x: x["weak"])
    found = (
        _with_links(scanned.where(~weak), None)
        .unionByName(_with_links(scanned.where(weak), links))
        .select(*kept.columns, every().alias("__all"))
    )
    schema = kept.schema

    def cut(batches):
        for b in batches:
            texts = []
            for t, spans in zip(b.column(text), b.column("__all")):
                t, out, at = t.as_py(), [], 0
                if t is None:
                    texts.append(None)
                    continue
                for s in spans.as_py():
                    if s["end"] <= at:
                        continue
                    if s["start"] >= at:
                        out += [t[at : s["start"]], mark]
                    at = s["end"]
                texts.append("".join(out) + t[at:])
            names = [f.name for f in schema.fields]
            arrays = [pa.array(texts, pa.string()) if n == text else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return found.mapInArrow(trimmed(cut), schema).toDF(*columns)
