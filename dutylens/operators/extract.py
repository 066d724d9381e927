"""From a sentence to an obligation, or to nothing: ordered rules as columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutylens.functions import lexicon as L
from dutylens.functions.text import EDGE, case, computed, first_found, found, fragment, may_match, none_if_empty, plain, squeeze, stable_id, strip


def modality_rule(s: Column, low: Column) -> Column:
    """Index of the first modality rule of the list that matches anywhere; null without one. low: plain(s)."""
    return case((may_match(low, L.phrase(words)) & s.rlike(L.J + L.phrase(words)), F.lit(i)) for i, (words, *_) in enumerate(L.MODALITY))


def _by_rule(s: Column, rule: Column, shape: str) -> Column:
    """Group 1 of `shape` with the phrase of the rule in place of {}; a branch for each rule, so that no pattern is compiled for a row."""
    return case((rule == i, F.regexp_extract(s, shape.replace("{}", L.phrase(words)), 1)) for i, (words, *_) in enumerate(L.MODALITY))


def cut_qualifiers(text: Column) -> Column:
    """Up to the first frequency, scope, condition or exception."""
    stops = "|".join([*L.FREQUENCY, *L.SCOPE, rf"\b(?:{L.CONDITION_OPENERS})\s+.", rf"\b(?:{L.EXCEPTION_OPENERS})\s+."])
    return strip(F.regexp_extract(text, f"(?siuU)^(.*?)(?:{stops}|$)", 1))


def technologies(s: Column, low: Column) -> Column:
    return F.array_compact(F.array(*[F.when(may_match(low, p) & s.rlike(L.J + p), F.lit(name)) for name, p in L.TECHNOLOGY]))


def topic(s: Column) -> Column:
    """The first topic of which a word stands anywhere, also within another word."""
    low = F.lower(s)
    return case((reduce(or_, [low.contains(w) for w in words]), F.lit(name)) for name, words in L.TOPICS.items())


def confidence(subject: Column, action: Column, obj: Column, strength: Column) -> Column:
    has = lambda c, w: F.when(c.isNotNull(), w).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.lit(0.5) + has(subject, 0.15) + has(action, 0.15) + has(obj, 0.10) + F.lit(0.10) * strength), 3)


def extract(sentences: DataFrame) -> DataFrame:
    """policy_id, section_id, sentence (and whatever else comes along) -> obligations; other sentences fall out."""
    s = F.col("sentence")
    d = computed(sentences, low=plain(s))
    low = F.col("low")
    d = computed(d, passive=low.contains("prohibited") & s.rlike(L.J + L.passive()), rule=modality_rule(s, low)).where("passive or rule is not null")
    entry = lambda i, kind: F.element_at(F.array(*[F.lit(r[i]) for r in L.MODALITY]), F.col("rule") + 1).cast(kind)
    d = d.withColumns({
        "before": _by_rule(s, F.col("rule"), "(?siuU)^(.*?){}"),
        "after": _by_rule(s, F.col("rule"), "(?siuU)^.*?{}(.*)$"),
        "actor": F.lower(fragment(F.regexp_extract(s, L.J + L.passive(), 2))),
        "matter": F.lower(fragment(F.regexp_extract(s, L.J + L.passive(), 1))),
    })
    d = d.withColumn("rest", F.btrim(cut_qualifiers(F.regexp_replace(strip(F.col("after")), r"(?iuU)^from\s+", "")), F.lit(EDGE)))
    words = F.split(squeeze(F.col("rest")), " ", 2)
    p = F.col("passive")
    d = d.withColumns({
        "subject": F.when(p, F.col("actor")).otherwise(fragment(F.col("before"))),
        "action": F.when(p, F.col("matter")).otherwise(fragment(F.lower(none_if_empty(F.get(words, F.lit(0)))))),
        "object": F.when(~p, fragment(F.get(words, F.lit(1)))),
        "scope": F.when(p, F.col("actor")).otherwise(fragment(F.lower(first_found(s, L.SCOPE, low)))),
        "modality": F.when(p, F.lit("PROHIBITED")).otherwise(entry(1, "string")),
        "negated": F.when(p, F.lit(True)).otherwise(entry(2, "boolean")),
        "strength": F.when(p, F.lit(1.0)).otherwise(entry(3, "double")),
        "technology": technologies(s, low),
        "frequency": fragment(F.lower(first_found(s, L.FREQUENCY, low))),
        "condition": fragment(found(s, L.condition(), 1)),
        "exception": fragment(found(s, L.exception(), 1)),
        "topic": topic(s),
    })
    d = d.withColumn("confidence", confidence(F.col("subject"), F.col("action"), F.col("object"), F.col("strength")))
    d = d.withColumn("obligation_id", stable_id("obligation", F.concat_ws(":", "policy_id", "section_id", "sentence")))
    return d.drop("low", "passive", "rule", "before", "after", "actor", "matter", "rest")
