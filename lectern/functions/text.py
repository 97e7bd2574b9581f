"""Column functions on text, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = r"[A-Z]\w*"
#: Unicode white space plus the four separators that Java's class leaves out
SPACE = r"(?U)[\s\x1c-\x1f]+"


def tokenize(text: Column) -> Column:
    """Lower-cased words; no stemming, punctuation stays."""
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_tags(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"<[^>]+>", " "))


def type_names(text: Column) -> Column:
    """Capitalised identifiers, qualified ones as a whole, in order and once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?U)\b({TYPE}(?:::{TYPE})*)\b"), F.lit(1)))


def is_symbol_lookup(query: Column) -> Column:
    """A qualified name, or one word that starts upper case or holds an underscore once brackets and the like are stripped."""
    q = F.trim(query)
    bare = F.regexp_replace(q, r"^[()<>*&\[\]]+|[()<>*&\[\]]+$", "")
    first = F.substring(bare, 1, 1)
    single = ~q.contains(" ") & (bare != "") & (((F.upper(first) == first) & (F.lower(first) != first)) | bare.contains("_"))
    return F.coalesce(q.contains("::") | single, F.lit(False))


def last_member(symbol: Column) -> Column:
    return F.regexp_extract(symbol, r"([^:.]*)$", 1)


def qualifier(symbol: Column) -> Column:
    """What is before the last ``::``; '' if there is none."""
    return F.when(symbol.contains("::"), F.regexp_extract(symbol, r"(?s)^(.*)::", 1)).otherwise(F.lit(""))


def strip_templates(symbol: Column, depth: int = 8) -> Column:
    """Without template arguments nested up to ``depth`` deep; an opening bracket that stays open takes the rest with it."""
    for _ in range(depth):
        symbol = F.regexp_replace(symbol, r"<[^<>]*>", "")
    return F.regexp_replace(symbol, r"(?s)<.*$", "")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def contains_any(text: Column, words: list[str]) -> Column:
    """Substring test, not a word test."""
    out = F.lit(False)
    for w in words:
        out = out | F.lower(text).contains(w)
    return out


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)
