"""From raw documents to sentences: cleaning, metadata, sections, sentence split. All of it is columns and windows.

Documents: doc (key), path, raw. Where a document's lines are exploded, windows are per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.functions import lexicon as L
from dutylens.functions.text import LINE_END, lines_of, none_if_empty, squeeze, stable_id, strip

FIELDS = ["title", *L.METADATA]


def clean_text(raw: Column) -> Column:
    """Unix line ends, no NUL, no blanks at line ends, one blank line for many, nothing blank at the ends."""
    t = F.regexp_replace(F.regexp_replace(raw, "\r\n?", "\n"), "\x00", "")
    t = F.regexp_replace(t, LINE_END, "\n")
    t = F.regexp_replace(t, r"(?mU)[^\S\n]+$", "")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def iso_date(v: Column) -> Column:
    """A date in ISO form, extended, basic or as a week date; null for anything else."""
    v = F.btrim(v)
    week = F.regexp_extract_all(v, F.lit(r"^(\d{4})-?W(\d{2})-?(\d)?$"), F.lit(1))
    monday = F.date_add(F.date_trunc("week", F.try_to_date(F.concat(F.get(week, F.lit(0)), F.lit("-01-04")))).cast("date"), (F.try_to_number(F.regexp_extract(v, r"W(\d{2})", 1), F.lit("99")).cast("int") - 1) * 7)
    day = F.coalesce(none_if_empty(F.regexp_extract(v, r"W\d{2}-?(\d)$", 1)), F.lit("1")).cast("int")
    from_week = F.when(day.between(1, 7), F.date_add(monday, day - 1))
    return (
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(v, "yyyy-MM-dd"))
        .when(v.rlike(r"^\d{8}$"), F.try_to_date(v, "yyyyMMdd"))
        .when(v.rlike(r"^\d{4}(-W\d{2}(-\d)?|W\d{2}\d?)$"), from_week)
    )


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))


def metadata(text: Column, path: Column) -> dict[str, Column]:
    """The seven fields: the first line of the first 40 that has them, bold marks ignored; a Markdown title line wins."""
    lines = F.transform(F.slice(lines_of(text), 1, 40), lambda x: F.replace(strip(x), F.lit("**"), F.lit("")))

    def first(pattern: str) -> Column:
        hits = F.filter(lines, lambda x: x.rlike(L.J + pattern))
        return F.when(F.size(hits) > 0, strip(F.regexp_extract(F.get(hits, F.lit(0)), L.J + pattern, 1)))

    out = {k: first(L.metadata_line(k)) for k in L.METADATA}
    marked = F.filter(F.transform(F.slice(lines_of(text), 1, 20), strip), lambda x: x.startswith("# "))
    h1 = F.when((suffix(path) == ".md") & (F.size(marked) > 0), strip(F.substring(F.get(marked, F.lit(0)), F.lit(3), F.length(F.get(marked, F.lit(0))))))
    out["title"] = F.coalesce(none_if_empty(h1), none_if_empty(first(L.TITLE_LINE)), _stem(path))
    return out | {k: iso_date(out[k]) for k in ("effective_date", "review_date")}


def policies(documents: DataFrame) -> DataFrame:
    """doc, path, raw -> + text, policy_id, the metadata fields, file_type, character_count."""
    d = documents.withColumn("text", clean_text(F.col("raw")))
    d = d.withColumn("policy_id", stable_id("policy", F.concat_ws(":", "path", "text")))
    return d.withColumns({k: c for k, c in metadata(F.col("text"), F.col("path")).items()} | {"file_type": suffix(F.col("path")), "character_count": F.length("text")})


def is_metadata_line(line: Column) -> Column:
    line = strip(line)
    return line.rlike(L.J + "|".join(f"(?:{p})" for p in [L.TITLE_LINE, *[L.metadata_line(k) for k in L.METADATA]])) | line.startswith("# ")


def heading(line: Column) -> Column:
    """The title of a heading line, or null. Any line that begins with a number is one."""
    mark, number = (F.when(line.rlike("(?U)" + p), strip(F.regexp_extract(line, "(?U)" + p, 1))) for p in (L.HEADING_MARK, L.HEADING_NUMBER))
    return F.coalesce(mark, number)


def sections(policies: DataFrame) -> DataFrame:
    """policy_id, text -> one row per section: doc, policy_id, section_index, section_id, title, text, lines."""
    lines = policies.select("doc", "policy_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("heading", heading(F.col("line")))
    order = Window.partitionBy("doc").orderBy("pos")
    blocks = lines.withColumn("block", F.count("heading").over(order))
    content = F.when(F.col("heading").isNull() & (strip(F.col("line")) != "") & ~is_metadata_line(F.col("line")), F.struct("pos", strip(F.col("line")).alias("line")))
    blocks = blocks.groupBy("doc", "policy_id", "block").agg(F.max("heading").alias("title"), F.array_sort(F.collect_list(content)).alias("found"))
    blocks = blocks.where(F.size("found") > 0).withColumn("lines", F.transform("found", lambda x: x["line"]))
    blocks = blocks.withColumn("section_index", F.row_number().over(Window.partitionBy("doc").orderBy("block")) - 1)
    ident = F.concat_ws(":", "policy_id", F.col("section_index").cast("string"), F.coalesce(none_if_empty(F.col("title")), F.lit("document")))
    full = blocks.select("doc", "policy_id", "section_index", stable_id("section", ident).alias("section_id"), "title", F.array_join("lines", "\n").alias("text"), "lines")
    empty = policies.select("doc", "policy_id").join(full.select("doc").distinct(), "doc", "left_anti")
    return full.unionByName(empty.select(
        "doc", "policy_id", F.lit(0).alias("section_index"), stable_id("section", F.concat_ws(":", "policy_id", F.lit("document"))).alias("section_id"),
        F.lit(None).cast("string").alias("title"), F.lit("").alias("text"), F.array().cast("array<string>").alias("lines"),
    ))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, squeezed."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), squeeze), lambda p: p != "")


def split_sentences(text: Column) -> Column:
    """Cut after . ! or ? where a capital or digit follows."""
    return F.filter(F.transform(F.split(squeeze(text), r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"), strip), lambda s: s != "")


def units(lines: Column) -> Column:
    """Lines joined to units: a bullet starts a new one, and so does a line after one that ends a sentence.

    All lines become one text, in which a line's first two characters say whether it starts a unit (a line has no \\n of its own):
    the work grows with the lines, not with their square.
    """
    bullet = r"(?U)^(?:[-*+](?:\s+|$)|\d+\.\s+)"
    marked = F.transform(lines, lambda x, i: F.concat(F.when((i == 0) | x.rlike(bullet), "\n-").otherwise("\n+"), strip(F.regexp_replace(x, bullet, ""))))
    joined = F.regexp_replace(F.array_join(marked, ""), r"(?<![.!?])\n\+", " ")
    return F.slice(F.split(joined, r"\n[-+]"), F.lit(2), F.size(lines))


def sentences(sections: DataFrame) -> DataFrame:
    """One row per sentence: doc, policy_id, section_id, section_index, sentence_index, sentence."""
    s = sections.withColumn("sentences", F.flatten(F.transform(units(F.col("lines")), split_sentences)))
    return s.select("doc", "policy_id", "section_id", "section_index", F.posexplode("sentences").alias("sentence_index", "sentence"))


def section_counts(sections: DataFrame) -> DataFrame:
    """How many sections each document has; the empty fallback counts."""
    return sections.groupBy("doc").agg(F.count("*").alias("section_count"))
