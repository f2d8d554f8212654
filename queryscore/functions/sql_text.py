"""Column functions over SQL text, model answers and displayed cells.

Everything here is built from JVM expressions with generated code: no Python
workers and, on the paths that see long texts, no higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from queryscore import fixed_values as fv


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(c, F.lit(fv.SPACE_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(fv.SPACE_CHARS))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def _starts_with_any(c: Column, words: list[str]) -> Column:
    text = F.lower(lstrip(c))
    hit = F.lit(False)
    for word in words:
        hit = hit | text.startswith(word)
    return F.coalesce(hit, F.lit(False))


def is_select(c: Column) -> Column:
    """The trimmed text starts with ``select`` or ``with``; null and blank are false."""
    return _starts_with_any(c, fv.SELECT_WORDS)


def looks_like_write(c: Column) -> Column:
    """The text starts with one of the write words."""
    return _starts_with_any(c, fv.WRITE_WORDS)


def cap_cell(c: Column, max_cell: int = fv.CELL_CHARS) -> Column:
    """Display form of a cell: null as ``NULL``, long text cut with an ellipsis."""
    text = F.coalesce(c.cast("string"), F.lit(fv.NULL_CELL))
    return F.when(
        F.length(text) > max_cell,
        F.concat(F.substring(text, 1, max_cell), F.lit(fv.ELLIPSIS)),
    ).otherwise(text)


def extract_final_sql(c: Column) -> Column:
    """The query a model committed to, or null.

    After the first marker: the body of a leading fenced block, else the first
    line up to its first semicolon; one trailing semicolon is dropped.
    """
    rest = F.regexp_extract(c, fv.FINAL_SQL_PATTERN, 1)
    first_line = F.substring_index(F.substring_index(rest, "\n", 1), ";", 1)
    body = strip(
        F.when(
            rest.rlike(fv.FENCE_PATTERN), F.regexp_extract(rest, fv.FENCE_PATTERN, 1)
        ).otherwise(first_line)
    )
    return F.nullif(strip(F.regexp_replace(body, r";\z", "")), F.lit(""))


def repr_text(c: Column) -> Column:
    """A string quoted the way displayed result rows quote their cells."""
    escaped = c
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when(c.contains("'") & ~c.contains('"'), double).otherwise(single)


def row_text(cells: list[Column]) -> Column:
    """A displayed result row: quoted cells in parentheses."""
    quoted = [repr_text(c) for c in cells]
    if len(quoted) == 1:
        return F.concat(F.lit("("), quoted[0], F.lit(",)"))
    return F.concat(F.lit("("), F.concat_ws(", ", *quoted), F.lit(")"))
