"""Running a query: the syntax tree as one predicate over record columns."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import let, norm_plain

from . import language as L

#: Field -> columns that are searched together.
COLUMNS = {
    "title": ("title",), "abstract": ("abstract",), "title_abstract": ("title", "abstract"), "keywords": ("keywords",), "author": ("authors",), "journal": ("journal",), "affiliation": ("affiliation",),
    "all": ("title", "abstract", "keywords", "authors", "journal", "affiliation"),
}


def _text(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The normal form of the named columns that the records have, word by word between spaces."""
    kinds = dict(df.dtypes)
    parts = [F.concat_ws(" ", n) if kinds[n].startswith("array") else F.col(n) for n in names if n in kinds]
    joined = F.concat_ws(" . ", *parts) if parts else F.lit("")
    return F.concat(F.lit(" "), norm_plain(joined), F.lit(" "))


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z0-9*?]+", value.lower())


def _pattern(value: str) -> str:
    return " ".join(re.sub(r"[*?]", lambda m: "[a-z0-9]*" if m[0] == "*" else "[a-z0-9]", w) for w in _words(value))


def _holds(text: Column, value: str) -> Column:
    words = _words(value)
    if not words:
        return F.lit(False)
    if any("*" in w or "?" in w for w in words):
        return text.rlike(f" {_pattern(value)} ")
    return F.contains(text, F.lit(f" {' '.join(words)} "))


def _near(text: Column, left: str, right: str, n: int) -> Column:
    """Whether the words of both literals stand at most n words apart, in either order."""
    a, b = (_words(x) for x in (left, right))
    if not a or not b:
        return F.lit(False)

    def fits(token: Column, word: str) -> Column:
        return token.rlike(f"^{_pattern(word)}$") if "*" in word or "?" in word else token == word

    def starts(words: Column, wanted: list[str]) -> Column:
        at = F.filter(F.transform(words, lambda t, i: F.when(fits(t, wanted[0]), i)), lambda i: i.isNotNull())
        rest = lambda i: functools.reduce(lambda x, y: x & y, [F.coalesce(fits(F.get(words, i + k), w), F.lit(False)) for k, w in enumerate(wanted) if k], F.lit(True))
        return F.filter(at, rest)

    apart = lambda i, j: F.when(i < j, j - i - len(a)).otherwise(i - j - len(b))
    close = lambda p: F.exists(p["a"], lambda i: F.exists(p["b"], lambda j: (i != j) & (apart(i, j) >= 0) & (apart(i, j) <= n)))
    return let(F.split(F.trim(text), " "), lambda words: let(F.struct(starts(words, a).alias("a"), starts(words, b).alias("b")), close))


def predicate(df: DataFrame, node: L.Node, fields: tuple[str, ...] = L.DEFAULT_FIELDS) -> Column:
    """True or false for each record, never null."""
    scope = tuple(c for f in fields for c in COLUMNS[L.ALIASES.get(f, f)])
    match node:
        case L.Term(value) | L.Phrase(value):
            return F.coalesce(_holds(_text(df, scope), value), F.lit(False))
        case L.Vocabulary(vocabulary, term):
            if vocabulary == "MeSH" and "mesh" in df.columns:
                return F.coalesce(F.array_contains(F.transform("mesh", F.lower), F.lit(term.lower())), F.lit(False))
            return predicate(df, L.Phrase(term), fields)
        case L.Field(name, child):
            return predicate(df, child, (name,))
        case L.Not(child):
            return ~predicate(df, child, fields)
        case L.Boolean(op, children):
            return functools.reduce(lambda a, b: a & b if op == "AND" else a | b, [predicate(df, c, fields) for c in children])
        case L.Near(left, right, n):
            a, b = L.literal(left), L.literal(right)
            if a is None or b is None:  # a window needs words on both sides
                return predicate(df, left, fields) & predicate(df, right, fields)
            text = _text(df, scope)
            # both must occur at all: a cheap test before words are counted
            return F.coalesce(F.when(_holds(text, a) & _holds(text, b), _near(text, a, b, n)), F.lit(False))
    raise TypeError(type(node))


def years(year: Column, year_from: int | None, year_to: int | None) -> Column:
    """Bounds on the year; records without one stay."""
    out = F.lit(True)
    if year_from is not None:
        out = out & (year >= year_from)
    if year_to is not None:
        out = out & (year <= year_to)
    return year.isNull() | out


def run(records: DataFrame, search: L.Search, limit: int | None = None) -> DataFrame:
    """The records that a search finds."""
    found = records.where(predicate(records, search.tree, search.fields))
    if search.year_from is not None or search.year_to is not None:
        found = found.where(years(F.col("year"), search.year_from, search.year_to))
    return found if limit is None else found.limit(limit)
