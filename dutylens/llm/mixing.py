"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash, so "hash below a threshold" is a sample that grows with the threshold: a mix for a
smaller budget is contained in the mix for a larger one. The threshold of a source is found by histograms: tokens are
summed by (source, leading hash bits), a running sum finds the one bucket in which the budget ends, and only the
documents of that bucket are counted again by further bits. Nothing is sorted by size or hash but those few buckets.

Cases: a null text has size 0; a null source is a source of its own and comes last; rows with the same doc_id (or,
where that is null, the same text) share a hash and are taken together; an empty table gives an empty result; further
columns of the table are ignored by the plan and kept by `mix_rows`.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.llm.common import free_name, n_words, with_columns_apart, written

#: Bits of the 60-bit hash by which each level of the histogram refines.
LEVELS = (12, 16, 32)
#: Sources whose rules are broadcast, some hundred bytes each; tasks to which the rows of a source are dealt beyond.
FEW, SALTS = 100_000, 32


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 of the id; of the text where there is no id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: null sources are ''."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, max_passes: int) -> DataFrame:
    """(skey, source, source_size) -> + target: the budget poured out by weight, each source up to max_passes times its size.

    One row per source goes through the one-partition windows here. Sums are decimals, so they are exact.
    """
    unit = lcm(*weights)
    every = Window.partitionBy()
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("decimal(38,0)"))
    s = s.withColumn("cap", (F.col("source_size") * max_passes).cast("decimal(38,0)"))
    s = s.withColumn("budget", F.floor(F.sum("source_size").over(every) * F.lit(share)).cast("decimal(38,0)"))
    s = s.withColumn("ratio", (F.col("cap") * unit / F.col("w")).cast("decimal(38,0)"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(upto), F.lit(0)).cast("decimal(38,0)"))
    s = s.withColumn("w_left", (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0))).cast("decimal(38,0)"))
    s = s.withColumn("full", (F.col("cap").cast("double") * F.col("w_left").cast("double")) <= ((F.col("budget") - F.col("cap_before")).cast("double") * F.col("w").cast("double")))
    free = ~F.col("full")
    s = s.withColumn("rest", (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))).cast("decimal(38,0)"))
    s = s.withColumn("w_free", F.sum(F.when(free, F.col("w"))).over(every).cast("decimal(38,0)"))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("rest") * F.col("w")).cast("double") / F.col("w_free").cast("double"))
    return s.select("skey", "source", "source_size", target.alias("target"))


def plan_mix(keyed: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, max_passes: int = 3) -> DataFrame:
    """(skey, source, size, h) of every document -> per source: source_size, target, passes, threshold, closed.

    A document is taken `passes` times, and once more if h < threshold, or h = threshold where closed.
    """
    sizes = keyed.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, max_passes)
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    plan = plan.withColumn("left", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    plan = written(plan, "mix-plan")
    shift = sum(LEVELS)
    for level, bits in enumerate(LEVELS):
        last = level == len(LEVELS) - 1
        inside = F.shiftright("h", shift) == F.col("prefix")
        shift -= bits
        # only documents in the bucket where the budget of their source ends are counted again
        rows = keyed.join(plan.select("skey", "prefix"), "skey").where(inside) if level else keyed
        counts = rows.groupBy("skey", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("skey").orderBy("bucket")
        ends = counts.withColumn("upto", F.sum("size").over(upto)).join(plan.select("skey", "left"), "skey").where(F.col("upto") > F.col("left"))
        ends = ends.groupBy("skey").agg(F.min(F.struct("bucket", "upto", "size")).alias("end"))
        plan = plan.join(ends, "skey", "left")
        if last:
            near = (F.col("end.upto") - F.col("left")) < (F.col("left") - (F.col("end.upto") - F.col("end.size")))
            plan = plan.select("skey", "source", "source_size", "target", "passes", F.coalesce(F.col("end.bucket"), F.lit(0)).cast("long").alias("threshold"), F.coalesce(near, F.lit(False)).alias("closed"))
        else:
            plan = plan.select("skey", "source", "source_size", "target", "passes", (F.col("left") - F.coalesce(F.col("end.upto") - F.col("end.size"), F.lit(0))).alias("left"), F.coalesce(F.col("end.bucket"), F.lit(-1)).cast("long").alias("prefix"))
        plan = written(plan, "mix-plan")
    return plan


def _with_rule(rows: DataFrame, key: str, rule: DataFrame) -> DataFrame:
    """rows with the rule (a struct) of their source. Rules of up to FEW sources are broadcast.

    For more, the rows of a source are dealt to SALTS tasks that all have its rule, so that a source with a third of the rows is no one task's work.
    """
    if rule.count() <= FEW:
        return rows.join(F.broadcast(rule.withColumnRenamed("skey", key)), key)
    salt = free_name(rows, "salt")
    dealt = rule.withColumnRenamed("skey", key).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(dealt.hint("merge"), [key, salt]).drop(salt)


def _times(h: Column, rule: str) -> Column:
    of = lambda c: F.col(f"{rule}.{c}")
    return of("passes") + ((h < of("threshold")) | ((h == of("threshold")) & of("closed"))).cast("int")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, max_passes: int = 3) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken and passes."""
    d = with_columns_apart(docs, ["doc_id", "text", "source"])
    keyed = d.select("doc_id", "source", source_key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("h"))
    keyed = written(keyed, "mix-keys")
    plan = plan_mix(keyed.select("skey", "source", "size", "h"), weights, share, max_passes)
    rule = plan.select("skey", F.struct("source_size", "target", "passes", "threshold", "closed").alias("rule"))
    out = _with_rule(keyed, "skey", rule).withColumn("times", _times(F.col("h"), "rule"))
    return out.select("doc_id", "size", "rule.source_size", "rule.target", (F.col("size") * F.col("times")).cast("long").alias("taken"), F.col("times").cast("int").alias("passes"))


def mix_rows(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, max_passes: int = 3) -> DataFrame:
    """The mix itself: the rows of docs with their own columns, each as often as it is taken (0 to max_passes)."""
    d = with_columns_apart(docs, ["doc_id", "text", "source"])
    keyed = written(d.select("source", source_key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-keys")
    plan = plan_mix(keyed, weights, share, max_passes)
    key, name, copy = (free_name(docs, n) for n in ("skey", "rule", "copy"))
    rule = plan.select("skey", F.struct("threshold", "closed", "passes").alias(name))
    there = {c.lower(): f"`{c}`" for c in docs.columns}
    col = lambda n: F.col(there[n]) if n in there else F.lit(None).cast("string")
    joined = _with_rule(docs.withColumn(key, source_key(col("source"))), key, rule)
    # empty documents weigh nothing and have no share to fill: they stay once
    times = F.when(n_words(col("text")) == 0, F.lit(1)).otherwise(_times(document_hash(col("doc_id"), col("text")), name))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
