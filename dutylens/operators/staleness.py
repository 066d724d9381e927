"""Policies past their review, and obligations on deprecated technology."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutylens.functions import lexicon as L
from dutylens.functions.text import stable_id


def stale_policies(policies: DataFrame, today: date, days: int = L.STALE_DAYS) -> DataFrame:
    """policy_id, title, review_date -> a finding for each policy whose review is more than `days` ago."""
    age = F.datediff(F.lit(today), "review_date")
    d = policies.withColumn("age_days", age).where(F.col("age_days") > days)
    months = F.bround(F.col("age_days") / 30.4).cast("int")
    return d.select(
        stable_id("finding", F.concat_ws(":", F.lit("STALE_POLICY"), "policy_id", F.col("review_date").cast("string"))).alias("finding_id"),
        F.lit("STALE_POLICY").alias("finding_type"), "policy_id", F.lit(None).cast("string").alias("source_obligation_id"), F.lit("MEDIUM").alias("severity"),
        F.lit(1.0).alias("confidence"), F.lit(1.0).alias("deterministic_score"), F.col("review_date").cast("string").alias("subject_of"), "age_days", months.alias("months_overdue"),
        F.format_string(L.EXPLANATIONS["STALE_POLICY"], "title", F.col("review_date").cast("string"), months).alias("explanation"),
    )


def stale_references(obligations: DataFrame) -> DataFrame:
    """A finding for each distinct (policy, obligation, deprecated term); terms are compared without regard to case.

    The deprecated set is a constant of 15 terms, so it is a literal map and needs no join.
    """
    known = F.create_map(*[F.lit(x) for term in L.DEPRECATED for x in (term.lower(), term)])
    d = obligations.select("policy_id", "obligation_id", F.explode("technology").alias("term")).where(F.try_element_at(known, F.lower("term")).isNotNull()).distinct()
    return d.select(
        stable_id("finding", F.concat_ws(":", F.lit("STALE_REFERENCE"), "policy_id", "term", "obligation_id")).alias("finding_id"),
        F.lit("STALE_REFERENCE").alias("finding_type"), "policy_id", F.col("obligation_id").alias("source_obligation_id"), F.lit("HIGH").alias("severity"),
        F.lit(1.0).alias("confidence"), F.lit(1.0).alias("deterministic_score"), F.col("term").alias("subject_of"),
        F.lit(None).cast("int").alias("age_days"), F.lit(None).cast("int").alias("months_overdue"),
        F.format_string(L.EXPLANATIONS["STALE_REFERENCE"], "term").alias("explanation"),
    )
