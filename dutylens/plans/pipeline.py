"""The whole analysis: documents -> policies, obligations, candidates, findings, statistics."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.operators import candidates, corpus, detect, embed, evaluate, extract, ingest, normalize, staleness, verify
from dutylens.sources import documents as sources
from dutylens.sources.scratch import written

FINDING = ["finding_id", "finding_type", "source_obligation_id", "target_obligation_id", "severity", "confidence", "deterministic_score", "llm_verified", "explanation", "evidence"]
# what a stage that failed leaves: tables without rows
PAIRS = "id_low string, id_high string, cosine double, same_policy boolean, same_subject boolean, same_action boolean, same_object boolean, same_scope boolean, same_frequency boolean, modality_mismatch boolean, negation_mismatch boolean, n_same int"
EVIDENCE = "struct<" + ", ".join(f"{side}_{c}: {({'negated': 'boolean', 'technology': 'array<string>'}).get(c, 'string')}" for c in detect.EVIDENCE for side in ("source", "target")) + ", cosine_similarity: double>"
FOUND = f"finding_id string, finding_type string, source_obligation_id string, target_obligation_id string, severity string, confidence double, deterministic_score double, llm_verified boolean, explanation string, evidence {EVIDENCE}"


@dataclass
class Result:
    policies: DataFrame
    obligations: DataFrame
    candidates: DataFrame
    findings: DataFrame
    warnings: DataFrame
    statistics: DataFrame
    processing_time_ms: float = 0.0
    stages_failed: list[str] = field(default_factory=list)


class StageFailed(RuntimeError):
    """A stage of an analysis that has to be whole."""


def obligations_of(sentences: DataFrame, encoder: embed.Encoder | None = None) -> DataFrame:
    """sentence rows (policy_id, section_id, sentence, ord) -> canonical obligations with vectors."""
    return embed.embed(normalize.normalize(extract.extract(sentences)), encoder)


def message(e: Exception) -> str:
    """The first line of what went wrong, or its kind."""
    return (str(e).strip() or type(e).__name__).splitlines()[0]


def analyze_table(
    documents: DataFrame, today: date | None = None, provider: verify.Provider | None = None, threshold: float = candidates.THRESHOLD, top_k: int | None = candidates.TOP_K, encoder: embed.Encoder | None = None,
    whole: bool = False,
) -> Result:
    """documents: doc, path, raw and optionally error. Rows with an error, or without a text, become warnings; the rest is analysed.

    Every stage is written to the shared folder, as several others read it. A stage after normalisation that fails ends nothing:
    it leaves a warning `[stage]: message`, and the stages after it go on with what there is (no counts, no pairs, no findings of its kind).
    Such a result is not whole, which `stages_failed` says, here and in the statistics.

    whole: for callers that see findings only. A stage that fails, or a document with an error, raises StageFailed instead.
    """
    began = time.perf_counter()
    spark = documents.sparkSession
    notes: dict[str, str] = {}

    def attempt(stage: str, action: Callable[[], DataFrame], otherwise: Callable[[], DataFrame]):
        try:
            return action()
        except Exception as e:  # noqa: BLE001  whatever it is, the stages after it go on
            note = f"[{stage}]: {message(e)}"
            if whole:
                raise StageFailed(note) from e
            notes[stage] = note
            return otherwise()

    d = documents if "error" in documents.columns else documents.withColumn("error", F.lit(None).cast("string"))
    # few or small documents come in few partitions; every stage after them is dealt over all cores
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = d.withColumn("error", F.when(F.col("error").isNull() & F.col("raw").isNull(), "no text").otherwise(F.col("error")))
    read = written(ingest.policies(d.repartition(parts)), "read")
    if whole and not read.where("error is not null").isEmpty():
        raise StageFailed(sources.warnings_of(read).first()["warning"])
    pol = read.where("error is null")
    sections = written(ingest.sections(pol).select("doc", "policy_id", "section_index", "section_id", "lines"), "sections")
    sentences = ingest.sentences(sections.repartition(parts)).repartition(parts)
    ord_ = F.struct("doc", "section_index", "sentence_index")  # the place of a sentence in the input
    canonical = written(normalize.normalize(extract.extract(sentences.withColumn("ord", ord_))), "canonical")
    bare = lambda: canonical.withColumns({"embedding_text": F.lit(None).cast("string"), "vector": F.lit(None).cast(embed.VECTOR), "backend": F.lit("none")})
    obligations = attempt("embeddings", lambda: written(embed.embed(canonical, encoder), "obligations"), bare)
    counted = attempt("corpus_frequency", lambda: written(corpus.corpus_frequency(obligations), "counted"), lambda: obligations.withColumn("corpus_frequency", F.lit(None).cast("int")))
    at = counted.schema["ord"].dataType.simpleString()
    pairs = attempt("candidates", lambda: written(candidates.candidates(counted, threshold, top_k), "pairs"), lambda: spark.createDataFrame([], f"src_ord {at}, tgt_ord {at}, {PAIRS}"))
    found = attempt("detection", lambda: written(detect.findings(pairs, counted).select(*FINDING), "findings"), lambda: spark.createDataFrame([], FOUND))
    keys = pol.select("policy_id", "title", "review_date")
    none = {"target_obligation_id": F.lit(None).cast("string"), "llm_verified": F.lit(False), "evidence": F.lit(None).cast(EVIDENCE)}
    late = lambda: staleness.stale_policies(keys, today or date.today()).unionByName(staleness.stale_references(counted)).withColumns(none)
    stale = attempt("staleness", lambda: written(late().select(*FINDING), "stale"), lambda: spark.createDataFrame([], FOUND))
    both = found.withColumn("stage", F.lit(0)).unionByName(stale.withColumn("stage", F.lit(1)))
    done = attempt("llm", lambda: verify.verify(both, counted, provider), lambda: verify.verify(both, counted, None))
    hashed = counted.where("embedding_error is not null").select("embedding_text", "embedding_error").distinct().groupBy("embedding_error").agg(F.count("*").alias("n")) if "embedding_error" in counted.columns else None
    warnings = sources.warnings_of(read).unionByName(done.warnings.select("warning"))
    if hashed is not None:
        warnings = warnings.unionByName(hashed.select(F.format_string("[embeddings]: %d texts were hashed: %s", "n", "embedding_error").alias("warning")))
    if notes:
        warnings = warnings.unionByName(spark.createDataFrame([(n,) for n in notes.values()], "warning string"))
    pol = pol.join(ingest.section_counts(sections), "doc").withColumn("source_file", F.col("path"))
    sent = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("count"))), F.lit(0)).cast("long").alias(f"llm_{s}_findings")
    asked = done.stats if provider is not None else done.stats.where("false")
    stats = evaluate.counts(done.findings).crossJoin(read.agg(  # one row each
        F.count("*").alias("documents_received"), F.count_if(F.col("error").isNull()).alias("policies_processed"), F.count_if(F.col("error").isNotNull()).alias("documents_failed"),
    )).crossJoin(counted.agg(F.count("*").alias("obligations_extracted"), F.coalesce(F.array_join(F.array_sort(F.collect_set("backend")), "+"), F.lit("")).alias("embedding_backend"))).crossJoin(
        pairs.agg(F.count("*").alias("candidate_pairs"))
    ).crossJoin(asked.agg(*[sent(s) for s in ("verified", "rejected", "bypassed", "dropped", "failed")]))
    name = type(provider).__name__ if provider is not None else None
    stats = stats.withColumns({
        "llm_enabled": F.lit(provider is not None), "llm_provider": F.lit(name).cast("string"), "llm_model": F.lit(getattr(provider, "model", None)).cast("string"),
        "llm_eligible_findings": F.lit(done.eligible).cast("long"), "stages_failed": F.array(*[F.lit(n) for n in notes]).cast("array<string>"),
    })
    stats = written(stats, "statistics")
    return Result(pol, counted, pairs, done.findings, written(warnings, "warnings"), stats, (time.perf_counter() - began) * 1000.0, list(notes))


def analyze(spark: SparkSession, documents: object, **options) -> Result:
    """documents: a path or an iterable of paths."""
    return analyze_table(sources.read_documents(spark, documents), **options)


def finding_order(found: DataFrame, verified: bool = False) -> DataFrame:
    """Rank of each finding in the output: pair findings by score, then staleness; all by score once verified."""
    keys = [F.desc("deterministic_score"), "finding_type", "finding_id"]
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*(keys if verified else ["stage", *keys]))))
