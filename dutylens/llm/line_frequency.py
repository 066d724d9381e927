"""Quality rules on lines that many documents of a host share.

Every line with a word is normalised (small letters, single blanks, digits as 0) and hashed. Per host, the distinct
documents that have a line are counted, where documents of equal text are one document: copies of a page don't make
its text boilerplate. Lines in more documents than the limit are removed, and a document that loses more than
`max_lost` of its words is rejected. Documents without a host share one.

The limit of a host is max(min_docs, share * its distinct documents), but never above most_docs, so that it stops growing with the
host: a line in thousands of documents is boilerplate however many more there are. Basic rules come first: too few words, or too
many of them in repeated 3-word windows.

Cases: a null text has no words and fails the basic rules; long texts are counted whole; repeated rows get the same
verdict; an empty table gives an empty result; further columns are ignored by `judge` and kept by `keep_rows`, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutylens.llm.common import free_name, use_workers, with_columns_apart, written

#: Tasks to which the lines of a host are dealt.
SALTS = 32
SYMBOLS = "#*$%&|<>"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split() would also cut at.
UNITS = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DIGIT = re.compile(r"[0-9]")
CONTROL = re.compile("[\x1c-\x1f]")
ODD = re.compile("[" + UNITS + "]")


def words_of(text: str) -> list[str]:
    return text.split() if text.isascii() and not CONTROL.search(text) else WORDS.findall(text) if ODD.search(text) else text.split()


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that stand in a window of `width` words that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    window = code[:n]
    for k in range(1, width):
        _, window = np.unique(window * len(ids) + code[k : n + k], return_inverse=True)
    often = np.bincount(window)[window] > 1
    if not often.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= often
    return int(covered.sum())


def normal_line(line: str) -> str:
    return DIGIT.sub("0", " ".join(words_of(line.lower())))


def measures(text: str | None) -> tuple[int, int, int, int, int, list[str], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; the distinct normalised lines and their words."""
    text = text or ""
    words = words_of(text)
    seen: set[str] = set()
    dup = 0
    lines: dict[str, int] = {}
    for line in text.split("\n"):
        found = len(words_of(line))
        if not found:
            continue
        dup += line in seen
        seen.add(line)
        normal = normal_line(line)
        lines[normal] = lines.get(normal, 0) + found
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), list(lines), list(lines.values())


def line_hash(normal: str) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(normal.encode("utf-8", "surrogatepass"))
    return h - 2**64 if h >= 2**63 else h


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines whose normalised hash is among those gone; lines without a word stay."""
    return "\n".join(line for line in text.split("\n") if not words_of(line) or line_hash(normal_line(line)) not in gone)


def host_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), source.cast("string")), F.lit(""))


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row per document: host, hash of the text, the measures, hashes and words of its distinct lines."""
    use_workers(docs.sparkSession)
    d = with_columns_apart(docs, ["doc_id", "source", "text"])
    d = d.select("doc_id", host_of(F.col("source")).alias("host"), F.xxhash64(F.col("text").cast("string")).alias("same"), F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "host", "same", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                rows = [measures(t) for t in part.column(3).to_pylist()]
                hashes = [[line_hash(x) for x in r[5]] for r in rows]
                cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *cols, pa.array(hashes, pa.list_(pa.int64())), pa.array([r[6] for r in rows], pa.list_(pa.int64()))], names=names)

    return d.mapInArrow(run, f"doc_id {kind}, host string, same bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, line_hash array<bigint>, line_words array<bigint>")


def frequent_lines(lines: DataFrame, hosts: DataFrame, min_docs: int, share: float, most_docs: int) -> DataFrame:
    """(host, line): lines in more distinct documents of the host than its limit."""
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    # the lines of a host are dealt out, so that a host with a third of them is no one task's work
    dealt = counted.withColumn("salt", F.pmod("line", F.lit(SALTS)).cast("int"))
    limits = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(limits, ["host", "salt"]).where(F.col("n") > F.least(F.lit(float(most_docs)), F.greatest(F.lit(float(min_docs)), F.col("docs") * share))).select("host", "line")


def _counted(all_docs: DataFrame, min_docs: int, share: float, most_docs: int) -> DataFrame:
    """(host, same, removed_words, cut): the words and hashes of the frequent lines of every distinct text of a host that has some."""
    # documents of one host with the same text are one from here on
    once = all_docs.select("host", "same", F.arrays_zip("line_hash", "line_words").alias("lines")).dropDuplicates(["host", "same"])
    once = written(once, "line-texts")
    lines = once.select("host", "same", F.explode("lines").alias("x")).select("host", "same", F.col("x.line_hash").alias("line"), F.col("x.line_words").alias("words"))
    hosts = once.groupBy("host").agg(F.count("*").alias("docs"))
    often = written(frequent_lines(lines, hosts, min_docs, share, most_docs), "line-frequent")
    return lines.join(often, ["host", "line"]).groupBy("host", "same").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("cut"))


def _verdict(out: DataFrame, max_lost: float, min_words: int, max_repeated: float) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (F.col("removed_words") <= max_lost * F.col("n_words")))


def judge(docs: DataFrame, min_docs: int = 10, share: float = 0.01, most_docs: int = 100, max_lost: float = 0.5, min_words: int = 50, max_repeated: float = 50.0) -> DataFrame:
    """Per document: doc_id, the measures, base_failed, removed_words and kept."""
    all_docs = written(measured(docs), "line-measures")
    lost = _counted(all_docs, min_docs, share, most_docs).drop("cut")
    out = _verdict(all_docs.drop("line_hash", "line_words").join(lost, ["host", "same"], "left"), max_lost, min_words, max_repeated)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def keep_rows(docs: DataFrame, min_docs: int = 10, share: float = 0.01, most_docs: int = 100, max_lost: float = 0.5, min_words: int = 50, max_repeated: float = 50.0) -> DataFrame:
    """The rows of docs that `judge` keeps, with all their columns, and their texts without the frequent lines."""
    name = next((c for c in docs.columns if c.lower() == "text"), None)
    if name is None:
        return docs.where(F.lit(False))  # no words, no row
    all_docs = written(measured(docs), "line-measures")
    lost = _counted(all_docs, min_docs, share, most_docs)
    rules = _verdict(all_docs.drop("doc_id", "line_hash", "line_words").dropDuplicates(["host", "same"]).join(lost, ["host", "same"], "left"), max_lost, min_words, max_repeated)
    host, same, cut = (free_name(docs, n) for n in ("host", "same", "cut"))
    rules = written(rules.where("kept").select(F.col("host").alias(host), F.col("same").alias(same), F.coalesce("cut", F.array().cast("array<bigint>")).alias(cut)), "line-rules")
    source = next((F.col(f"`{c}`") for c in docs.columns if c.lower() == "source"), F.lit(None))
    named = docs.withColumn(host, host_of(source)).withColumn(same, F.xxhash64(F.col(f"`{name}`").cast("string")))
    cols = [F.col(f"`{c}`").cast("string").alias(c) if c == name else F.col(f"`{c}`") for c in docs.columns]
    rows = named.join(rules, [host, same]).select(*cols, cut)
    at = docs.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                texts = [without_lines(t, set(gone)) if gone else t for t, gone in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist())]
                columns = list(part.columns[:-1])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    return rows.mapInArrow(run, rows.drop(cut).schema)
