"""Column helpers for text: white space, fragments, first matches, identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutylens.functions.lexicon import J

EDGE = " \t\r\n,;:.-"
#: What ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def case(branches) -> Column:
    """The value of the first condition that holds, of (condition, value) pairs; null if none does.

    One flat CASE: nested ones make generated code that grows with their depth.
    """
    (first, value), *rest = branches
    out = F.when(first, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def fragment(c: Column) -> Column:
    """Squeezed, without punctuation at the ends; null if nothing is left."""
    return none_if_empty(F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(EDGE)))


def lowered(c: Column) -> Column:
    return none_if_empty(F.lower(squeeze(c)))


def plain(s: Column) -> Column:
    """Small letters, also those that a pattern takes for a plain letter: what a pattern finds in s, a search of a word finds here."""
    return F.lower(F.translate(s, "\u017f\u212a\u0130\u0131", "skii"))


def may_match(low: Column, pattern: str) -> Column:
    """False only where the pattern can't match, as the word it begins with is not there; low: plain of the text."""
    word = re.match(r"\\b([A-Za-z]+)(\?)?", pattern)
    start = word[1][: -1 if word[2] else None].lower() if word else ""
    return low.contains(start) if start else F.lit(True)


def found(c: Column, pattern: str, group: int = 0, low: Column | None = None) -> Column:
    """The first match, or its group; null without one, or for an empty one. low: plain(c), if there is one, spares most searches."""
    match = F.regexp_extract(c, J + pattern, group)
    return none_if_empty(match if low is None else F.when(may_match(low, pattern), match))


def first_found(c: Column, patterns: list[str], low: Column | None = None) -> Column:
    """The match of the first pattern of the list that matches anywhere."""
    return F.coalesce(*[found(c, p, 0, low) for p in patterns])


def stable_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(value, 256), 1, 16))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The entry for a value, or the value."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, c), c)


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_END, -1)


def computed(d: DataFrame, **columns: Column) -> DataFrame:
    """d with columns that are computed once for each row, however often what follows uses or filters by them.

    A filter or projection after a plain projection takes its expressions apart and repeats them; it can't do so with a generator's.
    """
    return d.withColumn("__made", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).select(*d.columns, "__made.*")
