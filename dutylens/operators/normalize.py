"""Canonical values of an obligation's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutylens.functions import lexicon as L
from dutylens.functions.text import case, lookup, lowered, none_if_empty, squeeze, strip


def frequency(f: Column) -> Column:
    f = lowered(f)
    every, times = r"^every\s+(\d+)\s+(minute|hour|day|week|month|year)s?$", r"^(\d+)\s+times?\s+(?:per|a)\s+(day|week|month|quarter|year)$"
    amount = lambda p: F.regexp_replace(F.regexp_extract(f, p, 1), r"^0+(?=\d)", "")
    unit = F.regexp_extract(f, every, 2)
    return (
        F.when(F.array_contains(F.array(*[F.lit(k) for k in L.FREQUENCY_ALIASES]), f), lookup(f, L.FREQUENCY_ALIASES))
        .when(f.rlike(every), F.concat(F.lit("every "), amount(every), F.lit(" "), unit, F.when(amount(every) == "1", "").otherwise("s")))
        .when(f.rlike(times), F.concat(amount(times), F.lit(" times per "), F.regexp_extract(f, times, 2)))
        .otherwise(f)
    )


def technology(names: Column) -> Column:
    """Canonical names, each once, by letters regardless of case."""

    def one(t: Column) -> Column:
        t = squeeze(t)
        entries = F.create_map(*[F.lit(x) for kv in L.TECHNOLOGY_ALIASES.items() for x in kv])
        return F.coalesce(F.try_element_at(entries, F.lower(t)), t)

    compare = lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0)
    return F.array_sort(F.array_distinct(F.transform(names, one)), compare)


def object_text(obj: Column, names: Column) -> Column:
    """Small letters, without "using <technology>"."""
    o = lowered(obj)
    for p in L.USING_PHRASES:
        o = F.regexp_replace(o, L.J + p, "")
    o = F.aggregate(names, o, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit(r"(?iuU)\s+(?:using|with|via)\s+\Q"), t, F.lit(r"\E\b")), F.lit("")))
    return none_if_empty(F.btrim(F.regexp_replace(o, r"(?U)\s+", " "), F.lit(" ,;:.-")))


def modality(m: Column, negated: Column) -> tuple[Column, Column, Column]:
    """Modality, negation and strength; an unknown modality is an error."""
    m = F.upper(strip(m))
    known = F.when(m.isin(*L.STRENGTH), m).otherwise(F.raise_error(F.concat(F.lit("unknown modality: "), F.coalesce(m, F.lit("null")))))
    kind = F.when(negated | (m == "PROHIBITED"), F.lit("PROHIBITED")).otherwise(known)
    return kind, kind == "PROHIBITED", case((kind == k, F.lit(v)) for k, v in L.STRENGTH.items())


def normalize(obligations: DataFrame) -> DataFrame:
    kind, negated, strength = modality(F.col("modality"), F.col("negated"))
    d = obligations.withColumns({"technology": technology(F.col("technology")), "strength": strength, "modality": kind, "negated": negated})
    return d.withColumns({
        "subject": lookup(lowered(F.col("subject")), L.SUBJECT_SYNONYMS),
        "action": lookup(lowered(F.col("action")), L.ACTION_SYNONYMS),
        "object": object_text(F.col("object"), F.col("technology")),
        "scope": none_if_empty(strip(F.regexp_replace(lowered(F.col("scope")), "^(for|during|on|within) ", ""))),
        "frequency": frequency(F.col("frequency")),
        "condition": lowered(F.col("condition")),
        "exception": lowered(F.col("exception")),
    })
