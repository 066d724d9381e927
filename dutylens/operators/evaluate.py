"""Counts, matching against labels, and diagnostics of what was missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.functions.text import case, squeeze
from dutylens.operators.detect import NEAR, compatible, s, t

#: Kinds of findings as the labels name them.
LABEL_KIND = {"CONTRADICTION": "DIRECT_CONFLICT", "FREQUENCY_MISMATCH": "PARTIAL_CONFLICT", "REDUNDANCY": "REDUNDANCY", "STALE_POLICY": "STALE_POLICY", "STALE_REFERENCE": "STALE_REFERENCE"}


def counts(found: DataFrame) -> DataFrame:
    """findings_total and sorted maps by type and severity, in one row."""
    both = found.groupBy("finding_type", "severity").agg(F.count("*").alias("n"))
    by = lambda c: both.groupBy(c).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings_total")).crossJoin(by("finding_type")).crossJoin(by("severity"))  # one row each


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def predicted_keys(found: DataFrame, files: DataFrame, kinds: dict[str, str] = LABEL_KIND) -> DataFrame:
    """(kind, file_a, file_b, what) of pair findings over two files, what = the action; files: policy_id, file."""
    name = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    d = found.select(F.try_element_at(name, F.col("finding_type")).alias("kind"), F.col("evidence.source_policy_id").alias("pa"), F.col("evidence.target_policy_id").alias("pb"), F.col("evidence.source_action").alias("what"))
    d = d.where("kind is not null").join(files.select(F.col("policy_id").alias("pa"), F.col("file").alias("fa")), "pa").join(files.select(F.col("policy_id").alias("pb"), F.col("file").alias("fb")), "pb").where("fa <> fb")
    low, high = unordered(F.col("fa"), F.col("fb"))
    return d.select("kind", low.alias("file_a"), high.alias("file_b"), F.lower(squeeze(F.coalesce("what", F.lit("")))).alias("what"))


def predicted_stale_keys(stale: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, file_a, file_b, what) of staleness findings: one file, the term for references."""
    d = stale.join(files, "policy_id")
    return d.select(F.col("finding_type").alias("kind"), F.col("file").alias("file_a"), F.lit("").alias("file_b"), F.when(F.col("finding_type") == "STALE_REFERENCE", F.lower("subject_of")).otherwise("").alias("what"))


def label_keys(labels: DataFrame) -> DataFrame:
    """(kind, file_a, file_b, what) of label rows: what = after the last " on ", or after "mentions " for references."""
    what = F.when(F.col("finding_subtype") == "STALE_REFERENCE", F.regexp_extract("description", r"(?s)mentions (.*)$", 1)).when(F.col("finding_subtype") == "STALE_POLICY", F.lit("")).otherwise(F.regexp_extract("description", r"(?s)^.* on (.*)$", 1))
    single = F.col("policy").isNotNull() & (F.col("policy") != "")
    low, high = unordered(F.col("policy_a"), F.col("policy_b"))
    return labels.select(F.col("finding_subtype").alias("kind"), F.when(single, F.col("policy")).otherwise(low).alias("file_a"), F.when(single, F.lit("")).otherwise(high).alias("file_b"), F.lower(F.regexp_replace(squeeze(what), r"\.$", "")).alias("what"))


KEY = ["kind", "file_a", "file_b", "what"]


def matched(predicted: DataFrame, labels: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Per key: tp, fp, fn of one-to-one matching of repeated keys."""
    side = lambda d, n: d.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in key]).agg(F.count("*").alias(n))
    both = side(predicted, "p").join(side(labels, "l"), key, "full").fillna(0, ["p", "l"])
    return both.select(*key, F.least("p", "l").alias("tp"), F.greatest(F.col("p") - F.col("l"), F.lit(0)).alias("fp"), F.greatest(F.col("l") - F.col("p"), F.lit(0)).alias("fn"))


def scores(match: DataFrame, by: str | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, over all or by a column; a quotient by zero is zero."""
    g = match.groupBy(by) if by else match.groupBy()
    d = g.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    d = d.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return d.withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def missed(match: DataFrame) -> DataFrame:
    return match.where("fn > 0")


def spurious(match: DataFrame) -> DataFrame:
    return match.where("fp > 0")


def frequency_histogram(obligations: DataFrame) -> DataFrame:
    f = F.col("corpus_frequency")
    bucket = F.when(f <= 3, f.cast("string")).when(f <= 6, "4-6").when(f <= 10, "7-10").otherwise("11+")
    return obligations.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def best_pair(pairs: DataFrame, group: list[str], score: str = "cosine") -> DataFrame:
    """The row with the highest score of each group; the first by ord among equals."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), "src_ord", "tgt_ord")
    return pairs.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def redundancy_gates(ends: DataFrame) -> DataFrame:
    """For pairs with structs s and t (see candidates.with_ends), flags and cosine: which condition of a redundancy fails first."""
    tech = (F.size(s("technology")) == 0) | (F.size(t("technology")) == 0) | F.arrays_overlap(s("technology"), t("technology"))
    gates = {
        "action": F.col("same_action"), "object": F.col("same_object"), "subject": compatible("subject"), "scope": compatible("scope"), "technology": tech,
        "modality": ~F.col("modality_mismatch"), "negation": ~F.col("negation_mismatch"), "frequency": F.col("same_frequency"), "similarity": F.col("cosine") >= NEAR,
    }
    first = case((~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items())
    return ends.withColumn("first_failed", F.coalesce(first, F.lit("none")))


def labelled_redundancies(pairs: DataFrame, labels: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Pairs (file_a, file_b, cosine) from the threshold on, and whether a label has the two files."""
    wanted = labels.where("kind = 'REDUNDANCY'").select("file_a", "file_b").distinct().withColumn("labelled", F.lit(True))
    return pairs.where(F.col("cosine") >= threshold).join(wanted, ["file_a", "file_b"], "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


def label_recall(labels: DataFrame, extracts: DataFrame, key: list[str], by: str) -> DataFrame:
    """Labels with and without an extract of the same key, by a column of the labels, with recall."""
    hit = labels.join(extracts.select(*key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return hit.groupBy(by).agg(F.count("*").alias("labels"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits")).withColumn("misses", F.col("labels") - F.col("hits")).withColumn("recall", F.col("hits") / F.col("labels"))


def text_overlap(labels: DataFrame, sentences: DataFrame) -> DataFrame:
    """Per label (key, text): is its text a sentence, word for word; candidates for containment share a word that few do."""
    norm = lambda c: F.lower(squeeze(F.col(c)))
    have = sentences.select(norm("sentence").alias("text")).distinct().withColumn("exact", F.lit(True))
    return labels.withColumn("norm", norm("text")).join(have.withColumnRenamed("text", "norm"), "norm", "left").withColumn("exact", F.coalesce("exact", F.lit(False))).drop("norm")


def contained(labels: DataFrame, sentences: DataFrame) -> DataFrame:
    """(label text, sentence) where one contains the other, both squeezed and in small letters.

    A text of three words and more lies in another only if its inner words stand there whole, so its longest one is joined with all words of
    the longer texts. A shorter text may begin and end within words: its first letters, up to 4, are joined with all pieces of that length.
    Equi-joins that miss nothing, and no cross product.
    """
    norm = lambda c: F.lower(squeeze(F.col(c)))
    a, b = labels.select(norm("text").alias("label")).distinct(), sentences.select(norm("sentence").alias("sentence")).distinct()
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]

    def within(short: DataFrame, x: str, long: DataFrame, y: str) -> DataFrame:
        words = F.split(F.col(x), " ")
        short = short.where(F.length(x) > 0).withColumn("inner", F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))
        by_word = short.where(F.size("inner") > 0).withColumn("piece", longest(F.col("inner"))).join(long.withColumn("piece", F.explode(F.array_distinct(F.split(F.col(y), " ")))), "piece")
        few = short.where(F.size("inner") == 0).withColumn("piece", F.substring(x, 1, 4))
        out = by_word.select(x, y).where(F.contains(y, x))
        sizes = [r["n"] for r in few.select(F.length("piece").alias("n")).distinct().collect()]  # 4 at most
        if sizes:
            letters = F.filter(F.split(F.col(y), ""), lambda c: c != "")
            pieces = lambda cs, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(cs) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(cs, i, n), ""))
            every = F.array_distinct(F.flatten(F.array(*[pieces(F.col("letters"), n) for n in sorted(sizes)])))
            out = out.unionByName(few.join(long.withColumn("letters", letters).withColumn("piece", F.explode(every)), "piece").select(x, y).where(F.contains(y, x)))
        return out

    return within(a, "label", b, "sentence").select("label", "sentence").unionByName(within(b, "sentence", a, "label").select("label", "sentence")).distinct()


def values_of(d: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): distinct values and how often."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return d.select(stacked.alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def per_file(sentences: DataFrame, labels: DataFrame, file: str = "file") -> DataFrame:
    """Sentences and labels of each file."""
    count = lambda d, n: d.groupBy(file).agg(F.count("*").alias(n))
    return count(sentences, "sentences").join(count(labels, "labels"), file, "full").fillna(0)


def best_overlap(left: DataFrame, right: DataFrame, group: str, other: str, item: str) -> DataFrame:
    """For each group the other with the most items in common; the smaller name among equals."""
    shared = left.select(group, item).distinct().join(right.select(other, item).distinct(), item).groupBy(group, other).agg(F.count("*").alias("shared"))
    order = Window.partitionBy(group).orderBy(F.desc("shared"), other)
    return shared.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def sentences_with(sentences: DataFrame, keywords: DataFrame, file: str = "file") -> DataFrame:
    """Sentences of a file that contain one of the file's keywords; keywords: file, keyword."""
    return sentences.join(keywords, file).where(F.contains(F.lower("sentence"), F.lower("keyword")))


def sample(match: DataFrame, n: int = 10) -> DataFrame:
    """The first n matches by key: a sample for the eye."""
    return match.where("tp > 0").orderBy(*KEY).limit(n)
