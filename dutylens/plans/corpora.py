"""Obligation corpora made from the relational tables, in Spark and in DuckDB's SQL; every row of the table gives one.

A sentence per order, and the same sentences as bullets of a document per policy: subject, modal phrase, action and object by customer, and technology, scope, frequency,
condition or exception for some. A document per customer, with a title, metadata, headings and bullets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECTS = ["Employees", "Security teams", "Contractors", "Operators"]
MODALS = ["must", "must not", "should", "may", "shall", "are required to"]
VERBS = ["review", "rotate", "encrypt", "use"]
NOUNS = ["files", "keys"]
TECH = ["TLS 1.0", "SHA-1", "TLS 1.1", "WEP", "AES-256"]
CADENCE = ["", " every 30 days", " every 90 days", " quarterly"]


def pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def over(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("long")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, such as of one small file, over all cores; larger ones stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, policy_id, section_id, sentence."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        pick(SUBJECTS, k), F.lit(" "), pick(MODALS, over(k, 4)), F.lit(" "), pick(VERBS, c), F.lit("-c"), c.cast("string"), F.lit(" ledger "), c.cast("string"), F.lit(" "), pick(NOUNS, over(k, 24)),
        F.when(c % 50 == 0, F.concat(F.lit(" using "), pick(TECH, over(c, 50)))).otherwise(""), F.when(F.col("o_orderstatus") == "O", " on production systems").otherwise(""),
        pick(CADENCE, over(k, 3)), F.when(k % 13 == 0, " if risk is high").otherwise(""), F.when(k % 17 == 0, " unless an approval exists").otherwise(""), F.lit("."),
    )
    passive = F.concat(F.lit("Ledger-c"), c.cast("string"), F.lit(" export is prohibited for contractors."))
    d = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return d.select(k.alias("ord"), F.concat(F.lit("policy_"), (k % 211).cast("string")).alias("policy_id"), F.concat(F.lit("section_"), (k % 3).cast("string")).alias("section_id"), F.when(k % 19 == 0, passive).otherwise(text).alias("sentence"))


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SENTENCES_SQL = f"""SELECT o_orderkey AS ord, 'policy_' || (o_orderkey % 211) AS policy_id, 'section_' || (o_orderkey % 3) AS section_id,
  CASE WHEN o_orderkey % 19 = 0 THEN 'Ledger-c' || o_custkey || ' export is prohibited for contractors.' ELSE
  ({listed(SUBJECTS)})[o_orderkey % 4 + 1] || ' ' || ({listed(MODALS)})[(o_orderkey // 4) % 6 + 1] || ' ' || ({listed(VERBS)})[o_custkey % 4 + 1] || '-c' || o_custkey || ' ledger ' || o_custkey || ' ' || ({listed(NOUNS)})[(o_orderkey // 24) % 2 + 1]
  || CASE WHEN o_custkey % 50 = 0 THEN ' using ' || ({listed(TECH)})[(o_custkey // 50) % 5 + 1] ELSE '' END || CASE WHEN o_orderstatus = 'O' THEN ' on production systems' ELSE '' END
  || ({listed(CADENCE)})[(o_orderkey // 3) % 4 + 1] || CASE WHEN o_orderkey % 13 = 0 THEN ' if risk is high' ELSE '' END || CASE WHEN o_orderkey % 17 = 0 THEN ' unless an approval exists' ELSE '' END || '.' END AS sentence
FROM orders"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, path, raw."""
    k = F.col("c_custkey").cast("string")
    day = F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), (F.col("c_custkey") * 37 % 1600).cast("int")), "yyyy-MM-dd")
    raw = F.concat(
        F.lit("# Policy of "), F.col("c_name"), F.lit("  \r\n\r\n\r\n**Owner:** "), F.col("c_mktsegment"), F.lit("\nVersion: "), k, F.lit(".0\n**Last Reviewed:** "), day, F.lit("\n\n## Rules\n- Employees must review ledger "), k,
        F.lit(" files. Operators may not\n  copy them\n- Contractors shall rotate keys quarterly.\n\n"), F.when(F.col("c_custkey") % 3 == 0, "1. Scope\nAll teams are covered.\nStatus: active\n").otherwise("## Empty\n\n"),
        F.lit("### Closing\nReviews are "), F.when(F.col("c_acctbal") < 0, "mandatory").otherwise("optional"), F.lit("! Ask\nthe owner.\n"),
    )
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc"), F.concat(F.lit("/policies/p"), k, F.lit(".md")).alias("path"), raw.alias("raw"))


DOCUMENTS_SQL = r"""SELECT c_custkey AS doc, '/policies/p' || c_custkey || '.md' AS path,
  '# Policy of ' || c_name || '  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || '**Owner:** ' || c_mktsegment || chr(10) || 'Version: ' || c_custkey || '.0' || chr(10) || '**Last Reviewed:** '
  || strftime(DATE '2022-01-01' + (c_custkey * 37 % 1600)::INT, '%Y-%m-%d') || chr(10) || chr(10) || '## Rules' || chr(10) || '- Employees must review ledger ' || c_custkey || ' files. Operators may not' || chr(10) || '  copy them' || chr(10)
  || '- Contractors shall rotate keys quarterly.' || chr(10) || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '1. Scope' || chr(10) || 'All teams are covered.' || chr(10) || 'Status: active' || chr(10) ELSE '## Empty' || chr(10) || chr(10) END
  || '### Closing' || chr(10) || 'Reviews are ' || CASE WHEN c_acctbal < 0 THEN 'mandatory' ELSE 'optional' END || '! Ask' || chr(10) || 'the owner.' || chr(10) AS raw
FROM customer"""


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, path, raw: the sentences above as one document per policy, a heading per section, a bullet per sentence.

    A policy has its share of the orders, 1 in 211, in one document of some megabytes at most per million orders.
    """
    d = sentences(spark, sf_dir).withColumn("doc", F.regexp_extract("policy_id", r"(\d+)", 1).cast("long"))
    bullets = F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), F.col("sentence")).alias("line"))))
    part = d.groupBy("doc", "section_id").agg(F.array_join(F.transform(bullets, lambda x: x["line"]), "\n").alias("lines"))
    part = part.select("doc", F.struct("section_id", F.concat(F.lit("## Section "), F.col("section_id"), F.lit("\n"), F.col("lines")).alias("text")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "\n\n")
    k = F.col("doc").cast("string")
    day = F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), (F.col("doc") * 37 % 1600).cast("int")), "yyyy-MM-dd")
    raw = F.concat(F.lit("# Policy "), k, F.lit("\n**Owner:** Risk\n**Last Reviewed:** "), day, F.lit("\n\n"), F.col("body"), F.lit("\n"))
    return part.groupBy("doc").agg(body.alias("body")).select("doc", F.concat(F.lit("/policies/"), k, F.lit(".md")).alias("path"), raw.alias("raw"))
