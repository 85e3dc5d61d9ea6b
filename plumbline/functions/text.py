"""Text tests and list building.

Rules are written as SQL expressions: the functions named ``sql_*`` return expression text, so
that a whole rule set reaches Spark in one call instead of hundreds of small ones. The others
work on columns.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a text. Spark's plain trim() only knows spaces.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(code) for code in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

SQL_EMPTY_LIST = "cast(array() AS array<string>)"


def sql_literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sql_text(name: str) -> str:
    """The column with NULL read as the empty text."""
    return f"coalesce({name}, '')"


def sql_strip(expression: str) -> str:
    return f"btrim({expression}, {sql_literal(_SPACES)})"


def sql_blank(name: str) -> str:
    return f"({sql_strip(sql_text(name))} = '')"


def sql_filled(name: str) -> str:
    """Not NULL and not empty; spaces count as content."""
    return f"({sql_text(name)} <> '')"


def sql_contains_any(expression: str, terms: list[str]) -> str:
    pattern = "|".join(re.escape(term) for term in terms)
    return f"({expression} RLIKE {sql_literal(pattern)})"


def sql_mentions(expression: str, terms: list[str]) -> str:
    """Case-insensitive substring test against a short list of terms."""
    return sql_contains_any(f"lower({expression})", terms)


def sql_list(name: str) -> str:
    """The list column with NULL read as the empty list."""
    return f"coalesce({name}, {SQL_EMPTY_LIST})"


def sql_texts(items: list[str]) -> str:
    return f"array({', '.join(sql_literal(item) for item in items)})"


def sql_texts_where(*rules: tuple[str, str]) -> str:
    """The items whose condition holds, in order. Items are expressions; see ``said``.

    A concatenation of one-item lists stays inside generated code; filter() would not.
    """
    parts = [f"if({condition}, array({item}), {SQL_EMPTY_LIST})" for condition, item in rules]
    return f"concat({', '.join(parts)})"


def said(text: str) -> str:
    return sql_literal(text)


def sql_struct(**fields: str) -> str:
    parts = [f"{sql_literal(name)}, {expression}" for name, expression in fields.items()]
    return f"named_struct({', '.join(parts)})"


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(_SPACES))


def sql_list_cell(name: str) -> str:
    """A comma-joined cell as a list: items stripped, empty items left out."""
    ends = sql_literal(_SPACES + ",")
    bare = f"btrim({sql_text(name)}, {ends})"
    between = sql_literal(f"[{_SPACES}]*,[{_SPACES},]*")
    return f"if({bare} = '', {SQL_EMPTY_LIST}, split({bare}, {between}))"


def joined(items: Column | str, separator: str = "; ") -> Column:
    return F.array_join(items, separator)


def safe_name(column: Column) -> Column:
    """A name usable in an output path."""
    return F.translate(column, " /", "__")


def quoted_list(items: Column) -> Column:
    """A list of texts as it reads in a prompt, e.g. ['a', 'b']."""
    quoted = F.transform(
        items,
        lambda item: F.when(
            item.contains("'") & ~item.contains('"'), F.concat(F.lit('"'), item, F.lit('"'))
        ).otherwise(F.concat(F.lit("'"), F.replace(item, F.lit("'"), F.lit("\\'")), F.lit("'"))),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
