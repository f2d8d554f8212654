"""Set-overlap scores of two SQL texts: token bigrams and schema items.

Sets are arrays of plain strings, so Spark's array set functions take their
hash-based path and stay linear in the text length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from queryscore import fixed_values as fv


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays read as sets; two empty sets score 1.

    Free of branches, so that Spark computes each argument once.
    """
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(F.array_union(a, b))), F.lit(1.0))


def tokens(c: Column) -> Column:
    """Lower-case word and symbol tokens in order."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return F.regexp_extract_all(text, F.lit(fv.TOKEN_PATTERN), F.lit(0))


def bigrams(c: Column) -> Column:
    """Distinct adjacent token pairs, each as ``left right``.

    No token holds a space, so the pair text is unambiguous. The zero-width match
    at every token start yields overlapping pairs in one pass.
    """
    spaced = F.array_join(tokens(c), " ")
    pairs = F.regexp_extract_all(
        spaced, F.lit("(?<![^ ])(?=([^ ]+ [^ ]+))"), F.lit(1)
    )
    return F.array_distinct(pairs)


def bigram_jaccard(pred: Column, gold: Column) -> Column:
    return jaccard(bigrams(pred), bigrams(gold))


# --- schema items -----------------------------------------------------------------

_KEYWORDS = (
    "all and any as asc between both by case cast cross current_date current_time "
    "current_timestamp desc distinct else end escape except exists false for from glob group "
    "having ilike in inner intersect into is isnull join lateral leading left like limit minus "
    "natural not notnull null offset on or order outer over partition recursive regexp right "
    "rlike select semi anti set some then trailing true union using values when where window with"
).split()
# Words that are names elsewhere and mean something here only; such a phrase has no item.
_PHRASES = "|".join([
    r"nulls\s+(?:first|last)\b", r"unbounded\s+(?:preceding|following)\b", r"current\s+row\b",
    r"\d++\s+(?:preceding|following)\b", r"(?:rows|range|groups)\s+(?=between\b|unbounded\b|current\b|\d)",
    r"filter\s*(?=\()", r"full\s+(?=outer\b|join\b)", r"fetch\s+(?:first|next)\s+\d*+\s*rows?\s+only\b",
    r"top\s+(?=\d)",
])

# Keywords are marked once; afterwards a word without the mark is an identifier.
_MARK = "\x01"
_BY_LETTER = {k[0]: [w[1:] for w in _KEYWORDS if w[0] == k[0]] for k in _KEYWORDS}
# A word behind a dot is a column, whatever it is.
_KEYWORD = rf"(?=[{''.join(_BY_LETTER)}])\b(?<!\.)(?<!\.\s)(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in _BY_LETTER.items()) + r")\b"

_WORD = r"[\p{L}_][\p{L}\p{N}_$]*+"
_QUOTED = r'"[^"]+"|`[^`]+`|\[[\p{L}_][^\]]*\]'
_IDENT = rf"(?:\b{_WORD}|{_QUOTED})"
# Repeated groups are possessive: those run as loops, others recurse and a long text ends the JVM.
_DOTTED = rf"{_IDENT}(?:\s*\.\s*{_IDENT})*+"
_ALIAS = rf"(?:\s+{_MARK}as\s+{_IDENT}|\s+{_IDENT})?"
_FROM_LIST = rf"{_DOTTED}{_ALIAS}(?:\s*,\s*{_DOTTED}{_ALIAS})*+"
# ``from`` that names no table.
_OTHER_FROM = rf"{_MARK}distinct\s+{_MARK}from\b|\b(?:extract|substring|trim)\s*\([^(),]*?{_MARK}from\b"

_TABLES = rf"{_OTHER_FROM}|{_MARK}(?:from|join)\s+({_FROM_LIST})"
_LISTED = rf"(?:^|,)\s*(?:{_IDENT}\s*\.\s*)*+({_IDENT})(?!\s*\.)"

# Alternatives that consume context come first; only a column reaches the group.
_COLUMNS = "|".join(
    [
        _OTHER_FROM,
        rf"{_MARK}(?:from|join)\s+{_FROM_LIST}",
        rf"(?:{_MARK}with(?:\s+{_MARK}recursive)?|,)\s*{_IDENT}\s+{_MARK}as\s*\(",  # common table expression
        rf"{_MARK}as\s+{_IDENT}",  # alias or cast type
        r"\b(?:date|timestamp|interval)\s+0\b",  # typed literal
        rf"(?:\)|{_MARK}end)\s*{_IDENT}(?!\s*[.(])",  # alias of a call, subquery or case
        rf"{_MARK}\w+",
        rf"\b\d[\p{{L}}\p{{N}}_.]*(?:\s+{_IDENT}(?!\s*[.(]))?",  # number and its alias
        rf"{_IDENT}\s*\(",  # call
        rf"({_IDENT}(?!\s*\.)|(?<=\.)\s*\*)(?:\s+{_IDENT}(?!\s*[.(]))?",  # column and its alias
    ]
)


# Up to its end, or to that of the text: what is left open is looked at once.
_COMMENT = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)"


def _plain(c: Column) -> Column:
    """Lower-case SQL without comments, string literals as numbers, keywords marked."""
    text = F.lower(F.coalesce(c, F.lit("")))
    no_comments = F.regexp_replace(
        text, rf"(?=['\"`/-])(?:('(?:[^']|'')*+'|\"[^\"]*+\"|`[^`]*+`)|--[^\n]*+|{_COMMENT})", "$1 "
    )
    no_strings = F.regexp_replace(no_comments, r"'(?:[^']|'')*+'", " 0 ")
    no_phrases = F.regexp_replace(no_strings, rf"\b(?<!\.)(?<!\.\s)(?:{_PHRASES})", " ")
    return F.regexp_replace(no_phrases, _KEYWORD, _MARK + "$0")


def _unquoted(names: Column) -> Column:
    """Identifier quotes removed and empty entries dropped, by way of one joined text."""
    sep = "\x1f"
    joined = F.regexp_replace(F.array_join(names, sep), rf'["`\[\]{_MARK}]', "")
    return F.array_remove(F.split(joined, sep), "")


def table_names(c: Column) -> Column:
    """Tables named after FROM or JOIN, lower case, in order of first appearance."""
    lists = F.array_remove(F.regexp_extract_all(_plain(c), F.lit(_TABLES), F.lit(1)), "")
    names = F.regexp_extract_all(F.array_join(lists, ","), F.lit(_LISTED), F.lit(1))
    return F.array_distinct(_unquoted(names))


def column_names(c: Column) -> Column:
    """Columns a query mentions, lower case, without table prefixes."""
    names = F.regexp_extract_all(_plain(c), F.lit(_COLUMNS), F.lit(1))
    return F.array_distinct(_unquoted(names))


def schema_items(c: Column) -> Column:
    """Tables as ``t:name`` and columns as ``c:name``."""
    sep = "\x1f"

    def tagged(names: Column, tag: str) -> Column:
        return F.regexp_replace(F.array_join(names, sep + tag), r"\A(?=[\s\S])", tag)

    both = F.concat_ws(sep, tagged(table_names(c), "t:"), tagged(column_names(c), "c:"))
    return F.array_remove(F.split(both, sep), "")


def schema_link_jaccard(pred: Column, gold: Column) -> Column:
    return jaccard(schema_items(pred), schema_items(gold))
