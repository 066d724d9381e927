"""Every query over the obligation engine, with the SQL that says the same where SQL can.

Queries run over whole tables. The SQL is written for DuckDB, from the same rule tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.functions import lexicon as L
from dutylens.functions.text import stable_id
from dutylens.operators import blocks, candidates, corpus, detect, embed, evaluate, extract, ingest, normalize, staleness, verify
from dutylens.plans import corpora, pipeline
from dutylens.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TODAY = date(2026, 1, 1)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL parts


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(c: str, p: str) -> str:
    return f"regexp_matches({c}, {q('(?i)' + p)})"


def first(c: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, {q('(?i)' + p)}), '')" for p in patterns) + ")"


def frag(c: str) -> str:
    return rf"nullif(trim(regexp_replace({c}, '\s+', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(10) || ',;:.-'), '')"


def by_rule(value) -> str:
    return "CASE rule " + " ".join(f"WHEN {i} THEN {value(w)}" for i, (w, *_) in enumerate(L.MODALITY)) + " END"


def picked(values: list, i: str = "rule") -> str:
    return "([" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + f"])[{i} + 1]"


STOPS = "|".join([*L.FREQUENCY, *L.SCOPE, rf"\b(?:{L.CONDITION_OPENERS})\s+.", rf"\b(?:{L.EXCEPTION_OPENERS})\s+."])
TOPIC_SQL = "CASE " + " ".join(f"WHEN {has('lower(sentence)', '|'.join(w))} THEN {q(t)}" for t, w in L.TOPICS.items()) + " END"
TECH_SQL = "list_filter([" + ", ".join(f"CASE WHEN {has('sentence', p)} THEN {q(n)} END" for n, p in L.TECHNOLOGY) + "], lambda x: x IS NOT NULL)"
RULES_SQL = "CASE " + " ".join(f"WHEN {has('sentence', L.phrase(w))} THEN {i}" for i, (w, *_) in enumerate(L.MODALITY)) + " END"

EXTRACT_SQL = rf"""o AS ({corpora.SENTENCES_SQL}),
m AS (SELECT *, {has("sentence", L.passive())} AS passive, {RULES_SQL} AS rule FROM o),
r AS (SELECT *, {by_rule(lambda w: f"regexp_extract(sentence, {q('(?is)^(.*?)' + L.phrase(w))}, 1)")} AS before,
  {by_rule(lambda w: f"regexp_extract(sentence, {q('(?is)^.*?' + L.phrase(w) + '(.*)$')}, 1)")} AS after FROM m WHERE passive OR rule IS NOT NULL),
c AS (SELECT *, trim(regexp_replace(trim(regexp_extract(regexp_replace(trim(after), '(?i)^from\s+', ''), {q("(?is)^(.*?)(?:" + STOPS + "|$)")}, 1)), '\s+', ' ', 'g'), ' ,;:.-') AS rest FROM r),
x AS (SELECT ord, policy_id, section_id, sentence, 'obligation_' || substr(sha256(policy_id || ':' || section_id || ':' || sentence), 1, 16) AS obligation_id,
  CASE WHEN passive THEN lower({frag(f"regexp_extract(sentence, {q('(?i)' + L.passive())}, 2)")}) ELSE {frag("before")} END AS subject,
  CASE WHEN passive THEN lower({frag(f"regexp_extract(sentence, {q('(?i)' + L.passive())}, 1)")}) ELSE {frag("lower(split_part(rest, ' ', 1))")} END AS action,
  CASE WHEN NOT passive THEN {frag("CASE WHEN contains(rest, ' ') THEN substr(rest, strpos(rest, ' ') + 1) END")} END AS object,
  CASE WHEN passive THEN lower({frag(f"regexp_extract(sentence, {q('(?i)' + L.passive())}, 2)")}) ELSE {frag("lower(" + first("sentence", L.SCOPE) + ")")} END AS scope,
  CASE WHEN passive THEN 'PROHIBITED' ELSE {picked([m[1] for m in L.MODALITY])} END AS modality,
  CASE WHEN passive THEN true ELSE {picked([str(m[2]).lower() for m in L.MODALITY])}::BOOLEAN END AS negated,
  CASE WHEN passive THEN 1.0 ELSE {picked([m[3] for m in L.MODALITY])} END::DOUBLE AS strength,
  {TECH_SQL} AS technology, {frag("lower(" + first("sentence", L.FREQUENCY) + ")")} AS frequency,
  {frag(f"nullif(regexp_extract(sentence, {q('(?i)' + L.condition())}, 1), '')")} AS condition, {frag(f"nullif(regexp_extract(sentence, {q('(?i)' + L.exception())}, 1), '')")} AS exception, {TOPIC_SQL} AS topic FROM c),
x2 AS (SELECT *, round(least(1.0, 0.5 + CASE WHEN subject IS NULL THEN 0 ELSE 0.15 END + CASE WHEN action IS NULL THEN 0 ELSE 0.15 END + CASE WHEN object IS NULL THEN 0 ELSE 0.1 END + 0.1 * strength)::DOUBLE, 3) AS confidence FROM x)"""


def case_of(c: str, entries: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in entries.items()) + f" ELSE {c} END"


def _plain_object() -> str:
    out = "lower(object)"
    for p in L.USING_PHRASES:
        out = f"regexp_replace({out}, {q(p)}, '', 'gi')"
    for name, _ in L.TECHNOLOGY:
        escaped = name.replace(".", r"\.").replace("-", r"\-")
        out = f"CASE WHEN list_contains(technology, {q(name)}) THEN regexp_replace({out}, {q(chr(92) + 's+(?:using|with|via)' + chr(92) + 's+' + escaped + chr(92) + 'b')}, '', 'gi') ELSE {out} END" if name in corpora.TECH else out
    return out


EVERY = r"^every\s+(\d+)\s+(minute|hour|day|week|month|year)s?$"
FREQUENCY_SQL = f"""CASE WHEN frequency IN ({", ".join(map(q, L.FREQUENCY_ALIASES))}) THEN {case_of("frequency", L.FREQUENCY_ALIASES)}
  WHEN regexp_matches(frequency, {q(EVERY)}) THEN 'every ' || regexp_extract(frequency, {q(EVERY)}, 1)::BIGINT || ' ' || regexp_extract(frequency, {q(EVERY)}, 2) || CASE WHEN regexp_extract(frequency, {q(EVERY)}, 1)::BIGINT = 1 THEN '' ELSE 's' END
  ELSE frequency END"""
NORMAL_SQL = rf"""{EXTRACT_SQL},
n AS (SELECT ord, policy_id, section_id, sentence, obligation_id, {case_of("lower(subject)", L.SUBJECT_SYNONYMS)} AS subject, {case_of("lower(action)", L.ACTION_SYNONYMS)} AS action,
  nullif(trim(regexp_replace({_plain_object()}, '\s+', ' ', 'g'), ' ,;:.-'), '') AS object, regexp_replace(lower(scope), '^(for|during|on|within) ', '') AS scope, {FREQUENCY_SQL} AS frequency,
  lower(condition) AS condition, lower(exception) AS exception, CASE WHEN negated THEN 'PROHIBITED' ELSE modality END AS modality, (negated OR modality = 'PROHIBITED') AS negated,
  CASE WHEN negated OR modality IN ('PROHIBITED', 'REQUIRED') THEN 1.0 WHEN modality = 'RECOMMENDED' THEN 0.8 ELSE 0.7 END::DOUBLE AS strength, technology, topic, confidence FROM x2)"""
VECTOR_SQL = rf"""{NORMAL_SQL},
e AS MATERIALIZED (SELECT *, concat_ws(' | ', subject, action, object, scope, frequency, nullif(array_to_string(technology, ' '), ''), condition, exception) AS t FROM n),
tok AS (SELECT t, regexp_extract_all(lower(t), '[a-z0-9]+(?:[.-][a-z0-9]+)*') AS k FROM (SELECT DISTINCT t FROM e)),
feat AS (SELECT t, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || '::' || k[i + 1]))) AS f FROM tok),
vec AS MATERIALIZED (SELECT t, (('0x' || substr(sha256(f), 1, 16))::UBIGINT % 384)::INT AS place, sum(CASE WHEN ('0x' || substr(sha256(f), 17, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS v FROM feat GROUP BY ALL HAVING v <> 0),
sq AS MATERIALIZED (SELECT t, sum(v * v)::BIGINT AS sq FROM vec GROUP BY t)"""
PAIRS_SQL = rf"""{VECTOR_SQL},
a AS MATERIALIZED (SELECT e.*, coalesce(sq, 0) AS sq FROM e LEFT JOIN sq USING (t)),
anchor AS (SELECT ord, coalesce('t' || topic, '') AS tp, 'a' AS kind, action AS anchor FROM a WHERE action IS NOT NULL UNION ALL SELECT ord, coalesce('t' || topic, ''), 'o', object FROM a WHERE object IS NOT NULL
  UNION ALL SELECT ord, coalesce('t' || topic, ''), 't', unnest(technology) FROM a),
ids AS MATERIALIZED (SELECT DISTINCT x.ord AS src_ord, y.ord AS tgt_ord FROM anchor x JOIN anchor y ON x.tp = y.tp AND x.kind = y.kind AND x.anchor = y.anchor AND x.ord < y.ord),
p0 AS MATERIALIZED (SELECT src_ord, tgt_ord, s, g, s.t AS st, g.t AS gt FROM ids JOIN a s ON s.ord = src_ord JOIN a g ON g.ord = tgt_ord
  WHERE NOT (s.policy_id = g.policy_id AND s.section_id = g.section_id AND s.sentence = g.sentence)),
tp AS (SELECT DISTINCT st, gt FROM p0),
px AS MATERIALIZED (SELECT st, gt, x.place, x.v FROM tp JOIN vec x ON x.t = st),
dots AS MATERIALIZED (SELECT st, gt, sum(px.v * y.v)::BIGINT AS dot FROM px JOIN vec y ON y.t = px.gt AND y.place = px.place GROUP BY st, gt),
p AS MATERIALIZED (SELECT src_ord, tgt_ord, s, g, CASE WHEN s.sq = 0 OR g.sq = 0 THEN 0.0 ELSE least(1.0, greatest(-1.0, coalesce(dot, 0)::DOUBLE / sqrt(s.sq::DOUBLE * g.sq::DOUBLE))) END AS cosine,
  s.policy_id = g.policy_id AS same_policy, s.subject IS NOT DISTINCT FROM g.subject AS same_subject, s.action IS NOT DISTINCT FROM g.action AS same_action, s.object IS NOT DISTINCT FROM g.object AS same_object,
  s.scope IS NOT DISTINCT FROM g.scope AS same_scope, s.frequency IS NOT DISTINCT FROM g.frequency AS same_frequency, s.modality <> g.modality AS modality_mismatch, s.negated <> g.negated AS negation_mismatch
  FROM p0 LEFT JOIN dots USING (st, gt)),
cand AS MATERIALIZED (SELECT *, same_subject::INT + same_action::INT + same_object::INT + same_scope::INT + same_frequency::INT AS n_same FROM p WHERE cosine >= 0.55)"""
# Texts of different customers share neither action nor object, which keeps their cosine far below 0.95, so near texts are looked for within an action.
FREQ_SQL = rf"""{PAIRS_SQL},
keyed AS (SELECT ord, policy_id, t, action, regexp_replace(regexp_replace(trim(lower(sentence)), '\s+', ' ', 'g'), '[^\w\s]', '', 'g') AS key FROM a),
ta AS (SELECT DISTINCT t, action FROM a), tt AS (SELECT x.t AS st, y.t AS gt FROM ta x JOIN ta y ON x.action = y.action),
tx AS MATERIALIZED (SELECT st, gt, x.place, x.v FROM tt JOIN vec x ON x.t = st),
near AS MATERIALIZED (SELECT st, gt FROM (SELECT st, gt, sum(tx.v * y.v) AS dot FROM tx JOIN vec y ON y.t = tx.gt AND y.place = tx.place GROUP BY st, gt) JOIN sq a1 ON a1.t = st JOIN sq a2 ON a2.t = gt WHERE dot::DOUBLE / sqrt(a1.sq::DOUBLE * a2.sq::DOUBLE) >= 0.95),
seen AS (SELECT k.ord, o.policy_id FROM keyed k JOIN keyed o ON o.key = k.key UNION SELECT k.ord, o.policy_id FROM keyed k JOIN near ON near.st = k.t JOIN keyed o ON o.t = near.gt),
freq AS MATERIALIZED (SELECT ord, count(DISTINCT policy_id)::INT AS corpus_frequency FROM seen GROUP BY ord)"""


def days(c: str) -> str:
    p = q(r"^every (\d+) (minute|hour|day|week|month|year)s?$")
    unit = "CASE regexp_extract(" + c + f", {p}, 2) " + " ".join(f"WHEN {q(k)} THEN {v!r}::DOUBLE" for k, v in L.UNIT_DAYS.items()) + " END"
    return f"CASE WHEN regexp_matches({c}, {p}) THEN regexp_extract({c}, {p}, 1)::DOUBLE * {unit} END"


def compat(c: str) -> str:
    return f"(s.{c} IS NULL OR g.{c} IS NULL OR s.{c} = g.{c})"


FINDINGS_SQL = rf"""{FREQ_SQL},
d AS (SELECT cand.*, f1.corpus_frequency AS f1, f2.corpus_frequency AS f2, {days("s.frequency")} AS d1, {days("g.frequency")} AS d2,
  same_action AND same_object AND {compat("subject")} AND {compat("scope")} AND (len(s.technology) = 0 OR len(g.technology) = 0 OR list_has_any(s.technology, g.technology)) AS ok
  FROM cand JOIN freq f1 ON f1.ord = src_ord JOIN freq f2 ON f2.ord = tgt_ord),
k AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN negation_mismatch AND (s.modality = 'PROHIBITED' OR g.modality = 'PROHIBITED') THEN 'CONTRADICTION'
  WHEN NOT s.negated AND NOT g.negated AND d1 <> d2 THEN 'FREQUENCY_MISMATCH' WHEN NOT s.negated AND NOT g.negated AND same_frequency AND modality_mismatch THEN 'MODALITY_INCONSISTENCY'
  WHEN f1 < 5 AND f2 < 5 AND NOT modality_mismatch AND NOT negation_mismatch AND same_frequency AND cosine >= 0.95 THEN 'REDUNDANCY' END AS finding_type FROM d),
f AS (SELECT 'finding_' || substr(sha256(finding_type || ':' || least(s.obligation_id, g.obligation_id) || ':' || greatest(s.obligation_id, g.obligation_id)), 1, 16) AS finding_id, finding_type,
  s.obligation_id AS source_obligation_id, g.obligation_id AS target_obligation_id,
  CASE finding_type WHEN 'CONTRADICTION' THEN CASE WHEN s.modality = 'REQUIRED' OR g.modality = 'REQUIRED' THEN 'CRITICAL' ELSE 'HIGH' END
    WHEN 'FREQUENCY_MISMATCH' THEN CASE WHEN least(d1, d2) <= 0 THEN 'LOW' WHEN greatest(d1, d2) / least(d1, d2) >= 4 THEN 'HIGH' WHEN greatest(d1, d2) / least(d1, d2) >= 2 THEN 'MEDIUM' ELSE 'LOW' END
    WHEN 'MODALITY_INCONSISTENCY' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  round(least(1.0, greatest(0.0, CASE finding_type WHEN 'CONTRADICTION' THEN 0.80::DOUBLE WHEN 'FREQUENCY_MISMATCH' THEN 0.65::DOUBLE WHEN 'MODALITY_INCONSISTENCY' THEN 0.55::DOUBLE ELSE 0.45::DOUBLE END + 0.10::DOUBLE * cosine
    + 0.05::DOUBLE * (n_same / 5.0::DOUBLE) + 0.05::DOUBLE * ((s.confidence + g.confidence) / 2.0::DOUBLE) + CASE WHEN (s.scope IS NULL) <> (g.scope IS NULL) THEN -0.10::DOUBLE ELSE 0.0::DOUBLE END)), 4) AS deterministic_score,
  round(least(1.0, greatest(0.0, 0.65::DOUBLE * cosine + 0.35::DOUBLE * ((s.confidence + g.confidence) / 2.0::DOUBLE))), 4) AS confidence, src_ord, tgt_ord, cosine, s, g
  FROM k WHERE finding_type IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY cosine DESC, least(s.obligation_id, g.obligation_id), greatest(s.obligation_id, g.obligation_id), src_ord, tgt_ord) = 1)"""

# ---------------------------------------------------------------- ingestion


@query(r"""SELECT doc_id, strlen(t) AS n_bytes, sha256(t) AS sha, 'policy_' || substr(sha256('/documents/' || doc_id || '.txt:' || t), 1, 16) AS policy_id, len(string_split(t, chr(10)))::INT AS n_lines
FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(13), '', 'g'), ' ' || chr(10) || chr(9)) AS t FROM documents)""")
def ingest_clean_text(spark, sf):
    t = ingest.clean_text(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha"), stable_id("policy", F.concat(F.lit("/documents/"), F.col("doc_id").cast("string"), F.lit(".txt:"), F.col("t"))).alias("policy_id"), F.size(F.split("t", "\n")).alias("n_lines"))


@query(r"""SELECT doc_id, (i - 1)::INT AS sentence_index, p[i] AS sentence FROM (
  SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS p FROM documents))""")
def ingest_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(ingest.split_sentences(F.col("text"))).alias("sentence_index", "sentence"))


@query(r"""SELECT doc_id, (i - 1)::INT AS paragraph, p[i] AS text FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents))""")
def ingest_paragraphs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(ingest.paragraphs(F.col("text"))).alias("paragraph", "text"))


@query(r"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN date_trunc('week', d)::DATE WHEN 3 THEN d END::VARCHAR AS day FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def ingest_dates(spark, sf):
    """The day of every order in the ISO forms, and in forms that are none."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    year, week = F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")
    text = (
        F.when(k == 0, day.cast("string")).when(k == 1, F.date_format(day, "yyyyMMdd")).when(k == 2, F.concat(year, F.lit("-W"), week)).when(k == 3, F.concat(year, F.lit("W"), week, (F.weekday(day) + 1).cast("string")))
        .when(k == 4, F.date_format(day, "dd.MM.yyyy")).otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("-02-30")))
    )
    return table(spark, sf, "orders").select("o_orderkey", ingest.iso_date(text).cast("string").alias("day"))


LINES_SQL = rf"""raw AS ({corpora.DOCUMENTS_SQL}),
clean AS (SELECT doc, path, trim(regexp_replace(regexp_replace(replace(raw, chr(13), ''), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM raw),
pol AS (SELECT *, 'policy_' || substr(sha256(path || ':' || text), 1, 16) AS policy_id FROM clean)"""


@query(rf"""WITH {LINES_SQL} SELECT doc, policy_id, regexp_extract(text, '# (.*)', 1) AS title, regexp_extract(text, 'Version: (.*)', 1) AS version, regexp_extract(text, 'Owner:\*\* (.*)', 1) AS owner, NULL::VARCHAR AS department,
  CAST(regexp_extract(text, 'Reviewed:\*\* (.*)', 1) AS DATE)::VARCHAR AS review_date, CASE WHEN doc % 3 = 0 THEN 'active' END AS status, '.md' AS file_type, length(text)::INT AS character_count FROM pol""")
def ingest_metadata(spark, sf):
    return ingest.policies(corpora.documents(spark, sf)).select("doc", "policy_id", "title", "version", "owner", "department", F.col("review_date").cast("string").alias("review_date"), "status", "file_type", "character_count")


SECTIONS_SQL = rf"""{LINES_SQL},
l AS (SELECT doc, policy_id, i, s[i] AS line FROM (SELECT doc, policy_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT *, string_split(text, chr(10)) AS s FROM pol))),
h AS (SELECT *, coalesce(nullif(regexp_extract(line, '^\s*#{{2,6}}\s+(.+?)\s*$', 1), ''), nullif(regexp_extract(line, '^\s*\d+(?:\.\d+)*[.)]?\s+(.+?)\s*$', 1), '')) AS heading FROM l),
b AS (SELECT *, count(heading) OVER (PARTITION BY doc ORDER BY i) AS block FROM h),
k AS (SELECT doc, policy_id, block, max(heading) AS title, string_agg(trim(line), chr(10) ORDER BY i) FILTER (heading IS NULL AND trim(line) <> '' AND NOT regexp_matches(trim(line), '(?i)^\s*((title|#)\s*:?\s*.+|(version|owner|author|department|effective\s+date|review\s+date|last\s+reviewed|status)\s*:.+)$')) AS text FROM b GROUP BY ALL),
s AS (SELECT doc, policy_id, title, text, (row_number() OVER (PARTITION BY doc ORDER BY block) - 1)::INT AS section_index FROM k WHERE text IS NOT NULL)"""


@query(rf"WITH {SECTIONS_SQL} SELECT doc, section_index, 'section_' || substr(sha256(policy_id || ':' || section_index || ':' || coalesce(title, 'document')), 1, 16) AS section_id, title, text FROM s")
def ingest_sections(spark, sf):
    return ingest.sections(ingest.policies(corpora.documents(spark, sf))).select("doc", "section_index", "section_id", "title", "text")


@query(rf"""WITH {SECTIONS_SQL},
sl AS (SELECT doc, section_index, i, x[i] AS line FROM (SELECT doc, section_index, x, unnest(generate_series(1, len(x))) AS i FROM (SELECT *, string_split(text, chr(10)) AS x FROM s))),
sb AS (SELECT doc, section_index, i, regexp_matches(line, '^[-*+](\s+|$)') AS bullet, trim(regexp_replace(line, '^[-*+](\s+|$)', '')) AS body FROM sl),
su AS (SELECT *, (bullet OR coalesce(regexp_matches(lag(body) OVER o, '[.!?]$'), true))::INT AS starts FROM sb WINDOW o AS (PARTITION BY doc, section_index ORDER BY i)),
sg AS (SELECT doc, section_index, unit, string_agg(body, ' ' ORDER BY i) AS body FROM (SELECT *, sum(starts) OVER (PARTITION BY doc, section_index ORDER BY i) AS unit FROM su) GROUP BY ALL),
sp AS (SELECT doc, section_index, unit, string_split(regexp_replace(trim(regexp_replace(body, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM sg),
se AS (SELECT doc, section_index, unit, j, p[j] AS sentence FROM (SELECT *, unnest(generate_series(1, len(p))) AS j FROM sp) WHERE p[j] <> '')
SELECT doc, section_index, (row_number() OVER (PARTITION BY doc, section_index ORDER BY unit, j) - 1)::INT AS sentence_index, sentence FROM se""")
def ingest_policy_sentences(spark, sf):
    return ingest.sentences(ingest.sections(ingest.policies(corpora.documents(spark, sf)))).select("doc", "section_index", "sentence_index", "sentence")


# ---------------------------------------------------------------- extraction and normalisation


def flat(d: DataFrame, *more: str) -> DataFrame:
    """Obligations with technology as text."""
    cols = ["ord", "obligation_id", "subject", "action", "object", "scope", "frequency", "condition", "exception", "topic", "modality", "negated", "strength", "confidence"]
    return d.select(*cols, F.array_join("technology", ",").alias("technology"), *more)


FLAT_SQL = "SELECT ord, obligation_id, subject, action, object, scope, frequency, condition, exception, topic, modality, negated, strength, confidence, array_to_string(technology, ',') AS technology"


@query(f"WITH {EXTRACT_SQL} {FLAT_SQL} FROM x2")
def extract_obligations(spark, sf):
    return flat(extract.extract(corpora.sentences(spark, sf)))


@query(f"WITH {EXTRACT_SQL} SELECT modality, topic, count(*) AS n FROM x GROUP BY ALL")
def extract_counts(spark, sf):
    return extract.extract(corpora.sentences(spark, sf)).groupBy("modality", "topic").agg(F.count("*").alias("n"))


@query(f"WITH {NORMAL_SQL} {FLAT_SQL} FROM n")
def normalize_obligations(spark, sf):
    return flat(normalize.normalize(extract.extract(corpora.sentences(spark, sf))))


# ---------------------------------------------------------------- vectors


def obligations(spark, sf) -> DataFrame:
    """Written once, as the operators after it read it several times."""
    return written(pipeline.obligations_of(corpora.sentences(spark, sf)), "obligations")


@query(f"WITH {VECTOR_SQL} SELECT ord, t AS embedding_text, sq, places, mark FROM e JOIN (SELECT t, sum(v * v)::BIGINT AS sq, count(*)::INT AS places, sum(place * v)::BIGINT AS mark FROM vec GROUP BY t) USING (t)")
def embed_hash_vectors(spark, sf):
    mark = F.aggregate(F.zip_with("vector.idx", "vector.val", lambda i, v: i.cast("long") * v), F.lit(0).cast("long"), lambda a, x: a + x)
    return obligations(spark, sf).select("ord", "embedding_text", F.col("vector.sq").alias("sq"), F.size("vector.idx").alias("places"), mark.alias("mark"))


@query("""SELECT a, b, round(c, 5) AS cosine FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id) WHERE c >= 0.3""")
def cosine_pairs(spark, sf):
    return blocks.array_pairs(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.3).select("a", "b", F.round("c", 5).alias("cosine"))


# ---------------------------------------------------------------- candidates and findings


PAIR = "src_ord, tgt_ord, round(cosine, 9) AS cosine, same_policy, same_subject, same_action, same_object, same_scope, same_frequency, modality_mismatch, negation_mismatch, n_same::INT AS n_same"


def plain(pairs: DataFrame) -> DataFrame:
    return pairs.select("src_ord", "tgt_ord", F.round("cosine", 9).alias("cosine"), "same_policy", "same_subject", "same_action", "same_object", "same_scope", "same_frequency", "modality_mismatch", "negation_mismatch", F.col("n_same").cast("int").alias("n_same"))


@query(f"WITH {PAIRS_SQL} SELECT {PAIR} FROM cand")
def candidates_flags(spark, sf):
    return plain(blocks.pairs(obligations(spark, sf), candidates.THRESHOLD, ids=False))


@query(f"WITH {PAIRS_SQL} SELECT src_ord, tgt_ord, row_number() OVER (ORDER BY modality_mismatch DESC, negation_mismatch DESC, cosine DESC, n_same DESC, least(s.obligation_id, g.obligation_id) DESC, greatest(s.obligation_id, g.obligation_id) DESC, src_ord, tgt_ord) AS place FROM cand QUALIFY place <= 100")
def candidates_priority(spark, sf):
    """The hundred most urgent pairs. If a hundred of the most similar ones mismatch twice, no other comes before them."""
    o = obligations(spark, sf)
    for threshold in (0.95, candidates.THRESHOLD):
        best = written(candidates.candidates(o, threshold, top_k=None).orderBy(*candidates.priority()).limit(100), "best")
        if best.where("modality_mismatch and negation_mismatch").count() == 100:
            break
    return best.withColumn("place", F.row_number().over(Window.orderBy(*candidates.priority())).cast("long")).select("src_ord", "tgt_ord", "place")


@query(f"WITH {PAIRS_SQL} SELECT {PAIR} FROM cand WHERE s.policy_id <> g.policy_id")
def candidates_across_policies(spark, sf):
    return plain(blocks.pairs(obligations(spark, sf), candidates.THRESHOLD, across=False, ids=False))


@query(f"WITH {PAIRS_SQL} SELECT src_ord, tgt_ord, row_number() OVER (ORDER BY cosine DESC, least(s.obligation_id, g.obligation_id), greatest(s.obligation_id, g.obligation_id), src_ord, tgt_ord) AS place FROM cand QUALIFY place <= 100")
def candidates_order(spark, sf):
    """The first hundred pairs of the output order."""
    o = obligations(spark, sf)
    for threshold in (0.95, candidates.THRESHOLD):  # no other pair comes before those of a higher cosine
        best = written(candidates.ordered(candidates.candidates(o, threshold, top_k=None)).limit(100), "best")
        if best.count() == 100:
            break
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("cosine"), "id_low", "id_high", "src_ord", "tgt_ord")).cast("long")).select("src_ord", "tgt_ord", "place")


@query("""WITH RECURSIVE p AS (SELECT x.s_suppkey AS src_ord, y.s_suppkey AS tgt_ord, least(x.s_name, y.s_name) AS id_low, greatest(x.s_name, y.s_name) AS id_high, (x.s_suppkey + y.s_suppkey) % 7 = 0 AS modality_mismatch,
    x.s_suppkey * y.s_suppkey % 5 = 0 AS negation_mismatch, ((x.s_suppkey * 31 + y.s_suppkey * 17) % 10)::INT AS tenths, ((x.s_suppkey + 2 * y.s_suppkey) % 6)::INT AS n_same
  FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY modality_mismatch DESC, negation_mismatch DESC, tenths DESC, n_same DESC, id_low DESC, id_high DESC, src_ord, tgt_ord) AS i FROM p),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS ends, NULL::BIGINT AS a, NULL::BIGINT AS b
  UNION ALL SELECT o.i, CASE WHEN ok THEN list_concat(ends, [src_ord, tgt_ord]) ELSE ends END, CASE WHEN ok THEN src_ord END, CASE WHEN ok THEN tgt_ord END
  FROM (SELECT o.*, walk.ends, len(list_filter(ends, lambda e: e = src_ord)) < 2 AND len(list_filter(ends, lambda e: e = tgt_ord)) < 2 AS ok FROM walk JOIN o ON o.i = walk.i + 1) o)
SELECT a AS src_ord, b AS tgt_ord FROM walk WHERE a IS NOT NULL""")
def capped_pairs(spark, sf):
    """The cap of two pairs for each supplier, over all pairs of a nation; the SQL goes through them one by one."""
    side = lambda s: table(spark, sf, "supplier").select("s_nationkey", F.col("s_suppkey").alias(s), F.col("s_name").alias(f"{s}_name"))
    a, b = F.col("src_ord"), F.col("tgt_ord")
    pairs = side("src_ord").join(side("tgt_ord"), "s_nationkey").where(a < b).select(
        "src_ord", "tgt_ord", F.least("src_ord_name", "tgt_ord_name").alias("id_low"), F.greatest("src_ord_name", "tgt_ord_name").alias("id_high"), ((a * 31 + b * 17) % 10 / 10).alias("cosine"),
        ((a + b) % 7 == 0).alias("modality_mismatch"), (a * b % 5 == 0).alias("negation_mismatch"), ((a + 2 * b) % 6).cast("int").alias("n_same"),
    )
    return candidates.capped(pairs, 2).select("src_ord", "tgt_ord")


@query()
def candidates_topk(spark, sf):
    """At most 20 pairs for each obligation; tests hold it against a pass in order."""
    return plain(candidates.candidates(obligations(spark, sf)))


@query(f"WITH {FREQ_SQL} SELECT ord, corpus_frequency FROM freq")
def corpus_frequency(spark, sf):
    return corpus.corpus_frequency(obligations(spark, sf)).select("ord", "corpus_frequency")


@query(f"WITH {FREQ_SQL} SELECT CASE WHEN corpus_frequency <= 3 THEN corpus_frequency::VARCHAR WHEN corpus_frequency <= 6 THEN '4-6' WHEN corpus_frequency <= 10 THEN '7-10' ELSE '11+' END AS bucket, count(*) AS n FROM freq GROUP BY 1")
def corpus_histogram(spark, sf):
    return evaluate.frequency_histogram(corpus.corpus_frequency(obligations(spark, sf)))


def found(spark, sf) -> DataFrame:
    o = written(corpus.corpus_frequency(obligations(spark, sf)), "counted")
    return detect.findings(candidates.candidates(o, top_k=None, alike=detect.ALIKE), o)


@query(f"WITH {FINDINGS_SQL} SELECT finding_id, finding_type, source_obligation_id, target_obligation_id, severity, deterministic_score, confidence FROM f")
def findings_all(spark, sf):
    return found(spark, sf).select("finding_id", "finding_type", "source_obligation_id", "target_obligation_id", "severity", "deterministic_score", "confidence")


@query(f"WITH {FINDINGS_SQL} SELECT finding_type, severity, count(*) AS n FROM f GROUP BY ALL")
def stats_by_type_severity(spark, sf):
    return found(spark, sf).groupBy("finding_type", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {FINDINGS_SQL} SELECT finding_id, s.policy_id AS source_policy_id, g.policy_id AS target_policy_id, s.frequency AS source_frequency, g.frequency AS target_frequency, round(cosine, 4) AS cosine_similarity FROM f WHERE finding_type = 'FREQUENCY_MISMATCH'")
def find_frequency_mismatch(spark, sf):
    return found(spark, sf).where("finding_type = 'FREQUENCY_MISMATCH'").select("finding_id", *[F.col(f"evidence.{c}").alias(c) for c in ("source_policy_id", "target_policy_id", "source_frequency", "target_frequency", "cosine_similarity")])


SIDES = [(side, alias, c) for c in detect.EVIDENCE for side, alias in (("source", "s"), ("target", "g"))]
EXPLAINED_SQL = "CASE finding_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" if "%s" not in v else f"WHEN {q(k)} THEN replace(replace({q(v.replace('%s', '<a>', 1).replace('%s', '<b>', 1))}, '<a>', s.frequency), '<b>', g.frequency)" for k, v in L.EXPLANATIONS.items() if k in detect.BASE) + " END"


@query(f"WITH {FINDINGS_SQL} SELECT finding_id, " + ", ".join(f"array_to_string({a}.{c}, ',') AS {side}_{c}" if c == "technology" else f"{a}.{c} AS {side}_{c}" for side, a, c in SIDES) + f", round(cosine, 4) AS cosine_similarity, {EXPLAINED_SQL} AS explanation FROM f")
def findings_evidence(spark, sf):
    """All 23 fields of the evidence, and the explanation, of every finding."""
    cols = [F.col(f"evidence.{side}_{c}") for side, _, c in SIDES]
    return found(spark, sf).select("finding_id", *[(F.array_join(x, ",") if c == "technology" else x).alias(f"{side}_{c}") for x, (side, _, c) in zip(cols, SIDES)], F.col("evidence.cosine_similarity").alias("cosine_similarity"), "explanation")


@query(f"WITH {FINDINGS_SQL} SELECT finding_id, row_number() OVER (ORDER BY deterministic_score DESC, finding_type, finding_id) AS rank FROM f")
def findings_order(spark, sf):
    """The place of every finding in the output."""
    return pipeline.finding_order(found(spark, sf).withColumn("stage", F.lit(0))).select("finding_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FINDINGS_SQL} SELECT CASE WHEN deterministic_score >= 0.95 THEN 'bypass' WHEN deterministic_score < 0.50 THEN 'drop' ELSE 'verify' END AS route, finding_type, count(*) AS n FROM f GROUP BY ALL")
def verify_routing(spark, sf):
    return found(spark, sf).groupBy(verify.route(F.col("deterministic_score")).alias("route"), "finding_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS verified, CASE c_custkey % 7 WHEN 0 THEN 0.75 WHEN 1 THEN 1.0 END::DOUBLE AS confidence, CASE c_custkey % 7 WHEN 0 THEN 'fine' WHEN 1 THEN 'no' END AS explanation FROM customer")
def verify_parse(spark, sf):
    replies = ['{"verified": true, "confidence": 0.75, "explanation": " fine "}', '{"verified": false, "confidence": 7, "explanation": "no"}', '{"verified": "yes", "confidence": 0.5, "explanation": "x"}', '{"verified": true, "confidence": true, "explanation": "x"}', '{"verified": true, "confidence": 0.5, "explanation": " "}', "[]", "not json"]
    reply = verify.parsed(corpora.pick(replies, F.col("c_custkey")))
    return table(spark, sf, "customer").select("c_custkey", reply.alias("r")).select("c_custkey", "r.verified", "r.confidence", "r.explanation")


# ---------------------------------------------------------------- staleness


@query("""WITH p AS (SELECT 'policy_' || s_suppkey AS policy_id, s_name AS title, (DATE '2022-01-01' + (s_suppkey * 37 % 1600)::INT) AS d FROM supplier)
SELECT 'finding_' || substr(sha256('STALE_POLICY:' || policy_id || ':' || d::DATE::VARCHAR), 1, 16) AS finding_id, policy_id, (DATE '2026-01-01' - d::DATE)::INT AS age_days, round_even((DATE '2026-01-01' - d::DATE) / 30.4::DOUBLE, 0)::INT AS months_overdue,
  'Policy ''' || title || ''' was last scheduled for review on ' || d::DATE::VARCHAR || ' (' || round_even((DATE '2026-01-01' - d::DATE) / 30.4::DOUBLE, 0)::INT || ' months ago), which exceeds the 18-month staleness threshold.' AS explanation
FROM p WHERE DATE '2026-01-01' - d::DATE > 548""")
def stale_policies(spark, sf):
    d = table(spark, sf, "supplier").select(F.concat(F.lit("policy_"), F.col("s_suppkey").cast("string")).alias("policy_id"), F.col("s_name").alias("title"), F.date_add(F.lit("2022-01-01").cast("date"), (F.col("s_suppkey") * 37 % 1600).cast("int")).alias("review_date"))
    return staleness.stale_policies(d, TODAY).select("finding_id", "policy_id", "age_days", "months_overdue", "explanation")


@query(f"WITH {NORMAL_SQL}, refs AS (SELECT DISTINCT policy_id, obligation_id, term FROM (SELECT policy_id, obligation_id, unnest(technology) AS term FROM n) WHERE lower(term) IN ({', '.join(q(t.lower()) for t in L.DEPRECATED)})) "
       "SELECT 'finding_' || substr(sha256('STALE_REFERENCE:' || policy_id || ':' || term || ':' || obligation_id), 1, 16) AS finding_id, policy_id, obligation_id AS source_obligation_id, term AS subject_of, 'HIGH' AS severity FROM refs")  # fmt: skip
def stale_references(spark, sf):
    d = normalize.normalize(extract.extract(corpora.sentences(spark, sf)))
    return staleness.stale_references(d).select("finding_id", "policy_id", "source_obligation_id", "subject_of", "severity")


# ---------------------------------------------------------------- evaluation


MATCH_SQL = """p AS (SELECT 'd' || doc_id % 97 AS file, count(*) AS p FROM labels WHERE toxic = 1 GROUP BY 1), l AS (SELECT 'd' || doc_id % 97 AS file, count(*) AS l FROM labels WHERE quality = 0 GROUP BY 1),
m AS (SELECT coalesce(p.file, l.file) AS file, coalesce(p, 0) AS p, coalesce(l, 0) AS l FROM p FULL JOIN l ON p.file = l.file)"""


def matches(spark, sf) -> DataFrame:
    d = table(spark, sf, "labels").withColumn("file", F.concat(F.lit("d"), (F.col("doc_id") % 97).cast("string")))
    return evaluate.matched(d.where("toxic = 1"), d.where("quality = 0"), ["file"])


@query(f"WITH {MATCH_SQL} SELECT file, least(p, l) AS tp, greatest(p - l, 0) AS fp, greatest(l - p, 0) AS fn FROM m")
def eval_multiset(spark, sf):
    return matches(spark, sf)


@query(f"WITH {MATCH_SQL}, s AS (SELECT sum(least(p, l))::BIGINT AS tp, sum(greatest(p - l, 0))::BIGINT AS fp, sum(greatest(l - p, 0))::BIGINT AS fn FROM m) SELECT tp, fp, fn, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM s")
def eval_prf(spark, sf):
    return evaluate.scores(matches(spark, sf))


@query("SELECT lang, count(*) AS labels, sum((toxic = 1)::INT)::BIGINT AS hits, count(*) - sum((toxic = 1)::INT)::BIGINT AS misses, sum((toxic = 1)::INT) / count(*)::DOUBLE AS recall FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def label_recall(spark, sf):
    labels = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "lang").join(labels.select("doc_id"), "doc_id")
    return evaluate.label_recall(d, labels.where("toxic = 1"), ["doc_id"], "lang")


@query("SELECT item_id, (text IN (SELECT text FROM documents)) AS exact FROM (SELECT item_id, trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS text FROM benchmark) b".replace("(SELECT text FROM documents)", "(SELECT trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) FROM documents WHERE text IS NOT NULL)"))
def label_text_overlap(spark, sf):
    return evaluate.text_overlap(table(spark, sf, "benchmark"), table(spark, sf, "documents").select(F.col("text").alias("sentence"))).select("item_id", "exact")


@query("SELECT c AS \"column\", v AS value, count(*) AS n FROM (SELECT 'l_returnflag' AS c, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem) GROUP BY ALL")
def value_inventory(spark, sf):
    return evaluate.values_of(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""WITH a AS (SELECT DISTINCT c_mktsegment AS g, c_nationkey AS i FROM customer), b AS (SELECT DISTINCT s_nationkey AS i, s_suppkey AS o FROM supplier), c AS (SELECT g, o, count(*) AS shared FROM a JOIN b USING (i) GROUP BY ALL)
SELECT g AS segment, o AS supplier, shared FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY shared DESC, o) = 1""")
def best_overlap(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return evaluate.best_overlap(a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation")), "segment", "supplier", "nation")


@query(f"WITH {PAIRS_SQL} SELECT least(s.policy_id, g.policy_id) AS policy_a, greatest(s.policy_id, g.policy_id) AS policy_b, src_ord, tgt_ord FROM cand WHERE s.policy_id <> g.policy_id QUALIFY row_number() OVER (PARTITION BY policy_a, policy_b ORDER BY cosine DESC, src_ord, tgt_ord) = 1")
def best_pair_argmax(spark, sf):
    o = obligations(spark, sf)
    pairs = blocks.pairs(o, candidates.THRESHOLD, across=False, ids=False, ends=["policy_id"])
    return evaluate.best_pair(pairs.select("src_ord", "tgt_ord", "cosine", F.least("s_policy_id", "t_policy_id").alias("policy_a"), F.greatest("s_policy_id", "t_policy_id").alias("policy_b")), ["policy_a", "policy_b"]).select("policy_a", "policy_b", "src_ord", "tgt_ord")


@query(f"""WITH {PAIRS_SQL} SELECT CASE WHEN NOT same_action THEN 'action' WHEN NOT same_object THEN 'object' WHEN NOT {compat("subject")} THEN 'subject' WHEN NOT {compat("scope")} THEN 'scope'
  WHEN NOT (len(s.technology) = 0 OR len(g.technology) = 0 OR list_has_any(s.technology, g.technology)) THEN 'technology' WHEN modality_mismatch THEN 'modality' WHEN negation_mismatch THEN 'negation'
  WHEN NOT same_frequency THEN 'frequency' WHEN cosine < 0.95 THEN 'similarity' ELSE 'none' END AS first_failed, count(*) AS n FROM cand GROUP BY 1""")
def redundancy_gates(spark, sf):
    """Which condition of a redundancy fails first, over all candidate pairs."""
    o = obligations(spark, sf)
    # only pairs that pass the first two are joined with the columns of their ends
    early = blocks.pairs(o, candidates.THRESHOLD, ids=False).where("not (same_action and same_object)").select(F.when(~F.col("same_action"), "action").otherwise("object").alias("first_failed"))
    ends = candidates.with_ends(blocks.pairs(o, candidates.THRESHOLD, alike=detect.ALIKE, ids=False), o, ["subject", "scope", "technology"])
    return early.unionByName(evaluate.redundancy_gates(ends).select("first_failed")).groupBy("first_failed").agg(F.count("*").alias("n"))


# Labels about the pairs of sentences of one customer, as rows of a label file: kind, files, a description in words.
LABELS_SQL = f"""o2 AS (SELECT o_orderkey AS k, o_custkey AS c, 'policy_' || (o_orderkey % 211) || '.md' AS file FROM orders),
lp AS (SELECT CASE WHEN (x.k + y.k) % 2 = 0 THEN 'DIRECT_CONFLICT' ELSE 'REDUNDANCY' END AS kind, x.file AS fa, y.file AS fb, ({corpora.listed(corpora.VERBS)})[x.c % 4 + 1] || '-c' || x.c AS what FROM o2 x JOIN o2 y ON x.c = y.c AND x.k < y.k WHERE (x.k + y.k) % 3 <> 0 AND x.file <> y.file),
ls AS (SELECT file, ({corpora.listed(corpora.TECH)})[(c // 50) % 5 + 1] AS term FROM o2 WHERE c % 50 = 0 AND k % 2 = 0),
labels2 AS (SELECT kind, least(fa, fb) AS file_a, greatest(fa, fb) AS file_b, what FROM lp UNION ALL SELECT 'STALE_REFERENCE', file, '', lower(term) FROM ls)"""


def label_rows(spark, sf) -> DataFrame:
    """finding_subtype, policy_a, policy_b, policy, description."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    o = table(spark, sf, "orders").select(c.alias("c"), k.alias("k"), F.concat(F.lit("policy_"), (k % 211).cast("string"), F.lit(".md")).alias("file"))
    side = lambda s: o.select("c", F.col("k").alias(f"k{s}"), F.col("file").alias(f"f{s}"))
    what = F.concat(corpora.pick(corpora.VERBS, F.col("c")), F.lit("-c"), F.col("c").cast("string"))
    pairs = side("a").join(side("b"), "c").where("ka < kb and (ka + kb) % 3 <> 0 and fa <> fb")
    null = F.lit(None).cast("string")
    pairs = pairs.select(F.when((F.col("ka") + F.col("kb")) % 2 == 0, "DIRECT_CONFLICT").otherwise("REDUNDANCY").alias("finding_subtype"), F.col("fa").alias("policy_a"), F.col("fb").alias("policy_b"), null.alias("policy"),
                         F.concat(F.lit("Policies on one matter differ on "), F.upper(what), F.lit(".")).alias("description"))
    single = o.where("c % 50 = 0 and k % 2 = 0").select(F.lit("STALE_REFERENCE").alias("finding_subtype"), null.alias("policy_a"), null.alias("policy_b"), F.col("file").alias("policy"), F.concat(F.lit("The policy mentions  "), corpora.pick(corpora.TECH, corpora.over(F.col("c"), 50))).alias("description"))
    return pairs.unionByName(single)


def predicted(spark, sf) -> DataFrame:
    """The keys of the findings of the first two kinds and of the stale references, as of obligations()."""
    o = written(corpus.corpus_frequency(obligations(spark, sf)), "counted")
    files = o.select("policy_id", F.concat("policy_id", F.lit(".md")).alias("file")).distinct()
    pairs = evaluate.predicted_keys(detect.findings(candidates.candidates(o, top_k=None, alike=detect.ALIKE), o), files)
    return pairs.unionByName(evaluate.predicted_stale_keys(staleness.stale_references(o), files))


PREDICTED_SQL = f"""{FINDINGS_SQL}, pk AS (SELECT CASE finding_type WHEN 'CONTRADICTION' THEN 'DIRECT_CONFLICT' WHEN 'FREQUENCY_MISMATCH' THEN 'PARTIAL_CONFLICT' WHEN 'REDUNDANCY' THEN 'REDUNDANCY' END AS kind,
  least(s.policy_id, g.policy_id) || '.md' AS file_a, greatest(s.policy_id, g.policy_id) || '.md' AS file_b, lower(coalesce(s.action, '')) AS what FROM f WHERE finding_type <> 'MODALITY_INCONSISTENCY' AND s.policy_id <> g.policy_id
  UNION ALL SELECT 'STALE_REFERENCE', policy_id || '.md', '', lower(term) FROM (SELECT DISTINCT policy_id, obligation_id, term FROM (SELECT policy_id, obligation_id, unnest(technology) AS term FROM n) WHERE lower(term) IN ({', '.join(q(t.lower()) for t in L.DEPRECATED)})))"""
AGAINST_SQL = f"""{PREDICTED_SQL}, {LABELS_SQL}, np AS (SELECT kind, file_a, file_b, what, count(*) AS p FROM pk GROUP BY ALL), nl AS (SELECT kind, file_a, file_b, what, count(*) AS l FROM labels2 GROUP BY ALL),
mm AS (SELECT kind, file_a, file_b, what, coalesce(p, 0) AS p, coalesce(l, 0) AS l FROM np FULL JOIN nl USING (kind, file_a, file_b, what))"""


@query(f"WITH {LABELS_SQL} SELECT * FROM labels2")
def eval_label_keys(spark, sf):
    return evaluate.label_keys(label_rows(spark, sf))


@query(f"WITH {PREDICTED_SQL} SELECT * FROM pk")
def eval_predicted_keys(spark, sf):
    return predicted(spark, sf)


@query(f"WITH {AGAINST_SQL}, s AS (SELECT kind, sum(least(p, l))::BIGINT AS tp, sum(greatest(p - l, 0))::BIGINT AS fp, sum(greatest(l - p, 0))::BIGINT AS fn FROM mm GROUP BY kind) SELECT kind, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM s")
def eval_against_labels(spark, sf):
    """Findings matched with labels, by kind."""
    return evaluate.scores(evaluate.matched(predicted(spark, sf), evaluate.label_keys(label_rows(spark, sf))), "kind")


@query(f"WITH {AGAINST_SQL} SELECT 'missed' AS list, kind, file_a, file_b, what, l - p AS n FROM mm WHERE l > p UNION ALL SELECT 'spurious', kind, file_a, file_b, what, p - l FROM mm WHERE p > l")
def eval_confusion(spark, sf):
    """Labels without a finding, and findings without a label."""
    m = written(evaluate.matched(predicted(spark, sf), evaluate.label_keys(label_rows(spark, sf))), "matched")
    part = lambda d, name, n: d.select(F.lit(name).alias("list"), *evaluate.KEY, F.col(n).alias("n"))
    return part(evaluate.missed(m), "missed", "fn").unionByName(part(evaluate.spurious(m), "spurious", "fp"))


@query(f"WITH {PAIRS_SQL}, {LABELS_SQL}, w AS (SELECT DISTINCT file_a, file_b FROM labels2 WHERE kind = 'REDUNDANCY'), h AS (SELECT src_ord, tgt_ord, least(s.policy_id, g.policy_id) || '.md' AS file_a, greatest(s.policy_id, g.policy_id) || '.md' AS file_b FROM cand WHERE cosine >= 0.90) SELECT src_ord, tgt_ord, file_a, file_b, (file_a, file_b) IN (SELECT (file_a, file_b) FROM w) AS labelled FROM h")
def eval_redundancy_pairs(spark, sf):
    """Pairs of 0.90 and more, and whether a label has their files."""
    o = obligations(spark, sf)
    pairs = candidates.with_ends(candidates.candidates(o, 0.90, top_k=None).select("src_ord", "tgt_ord", "cosine"), o, ["policy_id"])
    low, high = evaluate.unordered(F.col("s.policy_id"), F.col("t.policy_id"))
    pairs = pairs.select("src_ord", "tgt_ord", "cosine", F.concat(low, F.lit(".md")).alias("file_a"), F.concat(high, F.lit(".md")).alias("file_b"))
    return evaluate.labelled_redundancies(pairs, evaluate.label_keys(label_rows(spark, sf))).select("src_ord", "tgt_ord", "file_a", "file_b", "labelled")


@query(r"""WITH a AS (SELECT DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS label FROM benchmark), b AS (SELECT DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS sentence FROM documents)
SELECT md5(label) AS label, md5(sentence) AS sentence FROM a JOIN b ON (contains(sentence, label) AND label <> '') OR (contains(label, sentence) AND sentence <> '')""")
def label_containment(spark, sf):
    """Passages that lie in whole texts, and whole texts that lie in passages."""
    return evaluate.contained(table(spark, sf, "benchmark"), table(spark, sf, "documents").select(F.col("text").alias("sentence"))).select(F.md5("label").alias("label"), F.md5("sentence").alias("sentence"))


@query(f"WITH o AS ({corpora.SENTENCES_SQL}), k AS (SELECT 'policy_' || s_suppkey % 230 AS policy_id, count(*) AS labels FROM supplier GROUP BY 1) SELECT policy_id, coalesce(x.n, 0) AS sentences, coalesce(labels, 0) AS labels FROM (SELECT policy_id, count(*) AS n FROM o GROUP BY 1) x FULL JOIN k USING (policy_id)")
def sentences_per_file(spark, sf):
    labels = table(spark, sf, "supplier").select(F.concat(F.lit("policy_"), (F.col("s_suppkey") % 230).cast("string")).alias("policy_id"))
    return evaluate.per_file(corpora.sentences(spark, sf), labels, "policy_id")


@query(f"WITH o AS ({corpora.SENTENCES_SQL}), k AS (SELECT DISTINCT 'policy_' || s_suppkey % 211 AS policy_id, ({corpora.listed([v.upper() for v in corpora.VERBS])})[s_nationkey % 4 + 1] AS keyword FROM supplier) SELECT ord, policy_id, keyword FROM o JOIN k USING (policy_id) WHERE contains(lower(sentence), lower(keyword))")
def keyword_sentences(spark, sf):
    words = table(spark, sf, "supplier").select(F.concat(F.lit("policy_"), (F.col("s_suppkey") % 211).cast("string")).alias("policy_id"), corpora.pick([v.upper() for v in corpora.VERBS], F.col("s_nationkey")).alias("keyword")).distinct()
    return evaluate.sentences_with(corpora.sentences(spark, sf), words, "policy_id").select("ord", "policy_id", "keyword")


# ---------------------------------------------------------------- the whole analysis


def analyzed(spark, sf, top_k: int | None) -> DataFrame:
    """Counts show no warnings, so a stage that fails ends the query."""
    found = pipeline.analyze_table(corpora.policy_documents(spark, sf), today=TODAY, top_k=top_k, whole=True).findings
    return found.groupBy("finding_type", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {FINDINGS_SQL}, refs AS (SELECT DISTINCT policy_id, obligation_id, term FROM (SELECT policy_id, obligation_id, unnest(technology) AS term FROM n) WHERE lower(term) IN ({', '.join(q(t.lower()) for t in L.DEPRECATED)})),
late AS (SELECT doc FROM (SELECT DISTINCT o_orderkey % 211 AS doc FROM orders) WHERE DATE '2026-01-01' - (DATE '2022-01-01' + (doc * 37 % 1600)::INT)::DATE > 548)
SELECT finding_type, severity, count(*) AS n FROM (SELECT finding_type, severity FROM f UNION ALL SELECT 'STALE_REFERENCE', 'HIGH' FROM refs UNION ALL SELECT 'STALE_POLICY', 'MEDIUM' FROM late) GROUP BY ALL""")
def analyze_documents(spark, sf):
    """From raw documents, one per policy, to all findings; every candidate pair counts."""
    return analyzed(spark, sf, None)


@query()
def analyze_documents_capped(spark, sf):
    """The same with at most 20 pairs for each obligation."""
    return analyzed(spark, sf, candidates.TOP_K)
