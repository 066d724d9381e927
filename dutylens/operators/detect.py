"""Findings from candidate pairs: one CASE, first kind wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.functions import lexicon as L
from dutylens.functions.text import case, stable_id
from dutylens.operators.candidates import CARRIED, with_ends

NEAR, COMMON = 0.95, 5
ALIKE = ("action", "object")  # of both sides of any finding; see comparable()
BASE = {"CONTRADICTION": 0.80, "FREQUENCY_MISMATCH": 0.65, "MODALITY_INCONSISTENCY": 0.55, "REDUNDANCY": 0.45}
EVIDENCE = ["policy_id", "section_id", "sentence", "subject", "action", "object", "scope", "frequency", "modality", "negated", "technology"]


def s(c: str) -> Column:
    return F.col(f"s.{c}")


def t(c: str) -> Column:
    return F.col(f"t.{c}")


def cadence_days(f: Column) -> Column:
    """Days of "every N units"; null for anything else."""
    p = r"^every (\d+) (minute|hour|day|week|month|year)s?$"
    unit = case((F.regexp_extract(f, p, 2) == name, F.lit(days)) for name, days in L.UNIT_DAYS.items())
    return F.when(f.rlike(p), F.regexp_extract(f, p, 1).cast("double") * unit)


def compatible(c: str) -> Column:
    """Equal, or unknown on one side."""
    return s(c).isNull() | t(c).isNull() | (s(c) == t(c))


def comparable() -> Column:
    tech = (F.size(s("technology")) == 0) | (F.size(t("technology")) == 0) | F.arrays_overlap(s("technology"), t("technology"))
    return F.col("same_action") & F.col("same_object") & compatible("subject") & compatible("scope") & tech


def ratio(a: Column, b: Column) -> Column:
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(low <= 0, F.lit(1.0)).otherwise(high / low)


def kind() -> Column:
    a, b = cadence_days(s("frequency")), cadence_days(t("frequency"))
    positive = ~s("negated") & ~t("negated")
    rare = lambda e: e("corpus_frequency").isNull() | (e("corpus_frequency") < COMMON)
    barred = (s("modality") == "PROHIBITED") | (t("modality") == "PROHIBITED")
    return (
        F.when(~comparable(), None)
        .when(F.col("negation_mismatch") & barred, F.lit("CONTRADICTION"))
        .when(positive & a.isNotNull() & b.isNotNull() & (a != b), F.lit("FREQUENCY_MISMATCH"))
        .when(positive & F.col("same_frequency") & F.col("modality_mismatch"), F.lit("MODALITY_INCONSISTENCY"))
        .when(rare(s) & rare(t) & ~F.col("modality_mismatch") & ~F.col("negation_mismatch") & F.col("same_frequency") & (F.col("cosine") >= NEAR), F.lit("REDUNDANCY"))
    )


def severity() -> Column:
    r = ratio(cadence_days(s("frequency")), cadence_days(t("frequency")))
    required = (s("modality") == "REQUIRED") | (t("modality") == "REQUIRED")
    return (
        F.when(F.col("finding_type") == "CONTRADICTION", F.when(required, "CRITICAL").otherwise("HIGH"))
        .when(F.col("finding_type") == "FREQUENCY_MISMATCH", F.when(r >= 4, "HIGH").when(r >= 2, "MEDIUM").otherwise("LOW"))
        .when(F.col("finding_type") == "MODALITY_INCONSISTENCY", F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def explanation() -> Column:
    values = {"FREQUENCY_MISMATCH": (s("frequency"), t("frequency"))}
    return case((F.col("finding_type") == name, F.format_string(L.EXPLANATIONS[name], *values.get(name, ()))) for name in BASE)


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def findings(candidates: DataFrame, obligations: DataFrame) -> DataFrame:
    """One row per finding, the best first of those with one finding_id."""
    o = obligations if "corpus_frequency" in obligations.columns else obligations.withColumn("corpus_frequency", F.lit(None).cast("int"))
    d = with_ends(candidates, o, [c for c in CARRIED if c != "ord"] + ["corpus_frequency"]).withColumn("finding_type", kind()).where("finding_type is not null")
    base = case((F.col("finding_type") == name, F.lit(value)) for name, value in BASE.items())
    sure = (s("confidence") + t("confidence")) / 2.0
    one_scope = F.when(s("scope").isNull() != t("scope").isNull(), F.lit(-0.10)).otherwise(F.lit(0.0))
    d = d.withColumns({
        "severity": severity(),
        "deterministic_score": F.round(_unit(base + 0.10 * F.col("cosine") + 0.05 * (F.col("n_same") / 5.0) + 0.05 * sure + one_scope), 4),
        "confidence": F.round(_unit(0.65 * F.col("cosine") + 0.35 * sure), 4),
        "finding_id": stable_id("finding", F.concat_ws(":", "finding_type", "id_low", "id_high")),
        "explanation": explanation(),
        "evidence": F.struct(*[e(c).alias(f"{name}_{c}") for c in EVIDENCE for name, e in (("source", s), ("target", t))], F.round("cosine", 4).alias("cosine_similarity")),
        "source_obligation_id": s("obligation_id"),
        "target_obligation_id": t("obligation_id"),
        "llm_verified": F.lit(False),
    })
    first = Window.partitionBy("finding_id").orderBy(F.desc("cosine"), "id_low", "id_high", "src_ord", "tgt_ord")
    d = d.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return d.select("finding_id", "finding_type", "source_obligation_id", "target_obligation_id", "severity", "confidence", "deterministic_score", "llm_verified", "explanation", "evidence", "src_ord", "tgt_ord")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("deterministic_score"), "finding_type", "finding_id")
