"""The thin queries over the corpus operators, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutylens.llm import ann, bpe, line_frequency, mixing, pii, sharding, simhash, token_scan, toxicity, warc_fixity

#: The key of the pseudonyms in these queries; a real run brings its own.
PII_KEY = "dutylens-demonstration-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), end_id=50256)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, max_passes=3)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op4_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages stored as WARC files, audited against a second replica, stored with damage: changed, blanked and cut payloads, lost and added records."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    n_files = max(1, -(-pages.count() // 1000))
    html, hit = F.coalesce(F.col("html"), F.lit("")), lambda n, k: F.coalesce(F.col("page_id") % n == k, F.lit(False))
    stored = F.when(hit(97, 11), F.concat(F.lit("X"), F.substring(html, F.lit(2), F.length(html)))).when(hit(389, 7), F.repeat(F.lit("0"), F.octet_length(html)))
    stored = stored.when(hit(193, 5), F.substring(html, F.lit(1), F.floor(F.length(html) / 2).cast("int"))).otherwise(html)
    both = pages.withColumn("extra", F.lit(False)).unionByName(pages.where(hit(307, 2)).select((-1 - F.col("page_id")).alias("page_id"), "url", "html", F.lit(True).alias("extra")))
    extra = F.col("extra")
    payloads = {"a": F.when(~extra, html), "b": F.when(extra, html).when(~hit(211, 3), stored)}
    replicas = warc_fixity.write_replicas(both, n_files, payloads, ("extra",))
    return warc_fixity.audit(*[warc_fixity.read_warc(spark, r) for r in replicas.values()])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), n_shards=8)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, found="n_private")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.link_documents(table(spark, sf_dir, "documents"), radius=3)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS w, 3 * source_size AS cap, (sum(source_size) OVER ())::HUGEINT AS budget FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER before, 0)::HUGEINT AS cap_before, ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0))::HUGEINT AS w_left
  FROM w WINDOW before AS (ORDER BY cap * 10 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap::DOUBLE * w_left::DOUBLE <= (budget - cap_before)::DOUBLE * w::DOUBLE AS is_full FROM o),
t AS (SELECT source, source_size,
    CASE WHEN is_full THEN cap::DOUBLE ELSE ((budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * w)::DOUBLE / (sum(CASE WHEN NOT is_full THEN w END) OVER ())::DOUBLE END AS target
  FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 0 END::INT AS passes FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT g.source, g.h, g.size, sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) AS upto, p.target - p.passes * p.source_size::DOUBLE AS rest
  FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source),
k AS (SELECT source, h, (upto <= rest OR (upto - size <= rest AND upto > rest AND upto - rest < rest - (upto - size))) AS more FROM c)
SELECT d.doc_id, d.size, p.source_size::BIGINT AS source_size, p.target, (d.size * (p.passes + k.more::INT))::BIGINT AS taken, (p.passes + k.more::INT)::INT AS passes
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""


OP4_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
s AS (SELECT 'a' AS side, page_id, url, html, html AS stored FROM p
  UNION ALL SELECT 'b', page_id, url, html, CASE WHEN page_id % 97 = 11 THEN 'X' || substr(html, 2) WHEN page_id % 389 = 7 THEN repeat('0', strlen(html)) WHEN page_id % 193 = 5 THEN substr(html, 1, length(html) // 2) ELSE html END
    FROM p WHERE coalesce(page_id % 211 <> 3, true)
  UNION ALL SELECT 'b', -1 - page_id, url, html, html FROM p WHERE page_id % 307 = 2),
f AS (SELECT side, page_id, url, 'file=' || ('0x' || substr(md5(concat_ws('|', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''))), 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / 1000.0))::BIGINT FROM pages) AS file,
    'WARC/1.1' || n || 'WARC-Type: response' || n || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || n || 'WARC-Target-URI: ' || coalesce(url, '') || n || 'Content-Length: ' || strlen(html) || n || n || stored || n || n AS record
  FROM s, (SELECT chr(13) || chr(10) AS n)),
o AS (SELECT side, file, page_id, coalesce(url, '') AS url, strlen(record)::BIGINT AS length, sha256(record) AS sha,
    coalesce(sum(strlen(record)) OVER (PARTITION BY side, file ORDER BY page_id NULLS FIRST, url NULLS FIRST, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM f),
g AS (SELECT side, file, page_id, url, sha, count(*) AS n, min(pos) AS pos, min(length) AS length FROM o GROUP BY ALL),
m AS (SELECT x.*, x.n - coalesce(y.n, 0) AS more FROM g x LEFT JOIN g y ON x.side <> y.side AND x.file = y.file AND x.page_id IS NOT DISTINCT FROM y.page_id AND x.url = y.url AND x.sha = y.sha),
k AS (SELECT *, row_number() OVER (PARTITION BY side, file, page_id, url ORDER BY pos, sha) AS nth FROM m WHERE more > 0)
SELECT coalesce(a.file, b.file) AS file, coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.url, b.url) AS url, coalesce(a.pos, b.pos) AS "offset", coalesce(a.length, b.length) AS length, coalesce(a.more, b.more)::BIGINT AS copies,
  CASE WHEN b.sha IS NULL THEN 'missing' WHEN a.sha IS NULL THEN 'extra' ELSE 'altered' END AS fault, a.sha AS expected, b.sha AS found
FROM (SELECT * FROM k WHERE side = 'a') a FULL JOIN (SELECT * FROM k WHERE side = 'b') b ON a.file = b.file AND a.page_id IS NOT DISTINCT FROM b.page_id AND a.url = b.url AND a.nth = b.nth
"""

OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, '') AS host, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
t AS (SELECT r, i, concat_ws(chr(1), w, lead(w) OVER o, lead(w, 2) OVER o) AS t FROM w WINDOW o AS (PARTITION BY r ORDER BY i) QUALIFY lead(w, 2) OVER o IS NOT NULL),
b AS (SELECT r, i FROM t QUALIFY count(*) OVER (PARTITION BY r, t) > 1),
n AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM b, (VALUES (0), (1), (2)) v(k) GROUP BY r),
l AS (SELECT r, host, text, x AS line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
    regexp_replace(array_to_string(regexp_extract_all(lower(x), '[^\x20\x09-\x0D]+'), ' '), '[0-9]', '0', 'g') AS normal
  FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS x FROM d) WHERE len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 0),
dup AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM l GROUP BY r),
docs AS (SELECT host, count(*) AS docs FROM (SELECT DISTINCT host, text FROM d) GROUP BY host),
often AS (SELECT host, normal FROM (SELECT host, normal, count(DISTINCT text) AS n FROM l GROUP BY host, normal) JOIN docs USING (host) WHERE n > least(100, greatest(10, docs * 0.01::DOUBLE))),
lost AS (SELECT r, sum(words)::BIGINT AS removed_words FROM l JOIN often USING (host, normal) GROUP BY r),
f AS (SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(list_sum(list_transform(d.words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN n USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5 * n_words) AS kept, removed_words FROM f
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokens": op1_tokens,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_fixity": op4_fixity,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_ann": op7_ann,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_line_frequency": op10_line_frequency,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op4_fixity": OP4_SQL, "op10_line_frequency": OP10_SQL}
