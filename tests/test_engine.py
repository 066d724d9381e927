"""The obligation engine on literal inputs, and against plain Python where the algorithm is its own."""

import hashlib
import math
import random
import sys
import time
import zipfile
from datetime import date

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from dutylens.functions.vectors import cosine
from dutylens.operators import blocks, candidates, corpus, detect, embed, evaluate, extract, ingest, normalize, staleness, verify
from dutylens.plans import pipeline
from dutylens.sources import documents as sources


def obligations(spark, sentences, policies=None):
    rows = [(i, f"p{policies[i] if policies else i}", "s", s) for i, s in enumerate(sentences)]
    return spark.createDataFrame(rows, "ord long, policy_id string, section_id string, sentence string")


def one(spark, sentence):
    got = normalize.normalize(extract.extract(obligations(spark, [sentence]))).collect()
    return got[0].asDict() if got else None


def test_extraction(spark):
    texts = [
        "Employees must use multi-factor authentication for remote access.",
        "Contractors must not store keys unless TLS 1.2 is used.",
        "If risk is high, admins should rotate credentials every 90 days.",
        "Guest wifi is prohibited for all users. (Reference: WEP)",
        "Nothing to see here.",
        "Staff are prohibited from using USB sticks on production systems.",
        "Workers are required to  check logs, once per week.",
        "Data may be kept; backups are not required.",
        "😀 É teams MUST NOT share",
    ]
    got = {r["ord"]: r for r in normalize.normalize(extract.extract(obligations(spark, texts))).collect()}
    assert set(got) == {0, 1, 2, 3, 5, 6, 7, 8}
    f = lambda i, *c: tuple(got[i][k] for k in c)
    assert f(0, "subject", "action", "object", "scope", "modality", "technology") == ("employees", "use", "multi-factor authentication", "remote access", "REQUIRED", ["multi-factor authentication"])
    assert f(1, "subject", "action", "object", "modality", "negated", "exception") == ("contractors", "store", "keys", "PROHIBITED", True, "tls 1")
    assert f(2, "condition", "frequency", "modality", "strength") == ("risk is high", "every 90 days", "RECOMMENDED", 0.8)
    assert f(3, "subject", "scope", "action", "object", "technology", "strength") == ("all users", "all users", "guest wifi", None, ["WEP"], 1.0)
    assert f(5, "subject", "action", "object", "scope") == ("staff are", "using", "usb sticks", "production systems")
    assert f(6, "subject", "action", "object", "frequency") == ("employees", "review", "logs", "every 1 week")
    assert f(7, "modality") == ("REQUIRED",) and f(8, "subject", "modality") == ("😀 é teams", "PROHIBITED")
    assert got[0]["confidence"] == 1.0 and got[8]["confidence"] == 0.9
    assert got[0]["obligation_id"] == "obligation_" + hashlib.sha256(f"p0:s:{texts[0]}".encode()).hexdigest()[:16]


@pytest.mark.parametrize("text, want", [("daily", "every 1 day"), ("Every 2 Days", "every 2 days"), ("every 1 months", "every 1 month"), ("once a quarter", "every 3 months"), ("3 time per week", "3 times per week"), ("now and then", "now and then"), (None, None)])
def test_frequency(spark, text, want):
    d = spark.createDataFrame([(text,)], "f string")
    assert d.select(normalize.frequency(F.col("f"))).first()[0] == want


def test_technology_and_object(spark):
    d = spark.createDataFrame([(["vpn", "MFA", "VPN", "Foo  Bar"], "Secure Tunnels using VPN daily via foo bar.")], "t array<string>, o string")
    names = normalize.technology(F.col("t"))
    assert d.select(names).first()[0] == ["Foo Bar", "multi-factor authentication", "VPN"]
    assert d.select(normalize.object_text(F.col("o"), names)).first()[0] == "secure tunnels daily"


RAW = "# Access Policy\r\n\r\n\r\n**Author:** Ann\r\n**Last Reviewed:** 2021-08-15\r\nStatus: active\r\n\r\nIntro line\r\n## Rules\r\n- First must do\r\n  this thing\r\n- Second shall not. Third may.\r\n1. Numbered\r\n30 days after\r\nText here. More text!\r\nand more\r\n# Dropped\r\nTitle lost\r\n\x00## Empty\r\n"


def test_ingestion(spark):
    d = spark.createDataFrame([(0, "/x/a.md", RAW), (1, "/x/b.txt", ""), (2, "/x/c.TXT", "Title: T\nEffective Date: 20230328\nReview Date: 2023-3-1\nBody one.")], "doc int, path string, raw string")
    pol = ingest.policies(d)
    p = {r["doc"]: r for r in pol.collect()}
    assert (p[0]["title"], p[0]["owner"], p[0]["status"], p[0]["review_date"]) == ("Access Policy", "Ann", "active", date(2021, 8, 15))
    assert (p[1]["title"], p[2]["title"], p[2]["effective_date"], p[2]["review_date"], p[2]["file_type"]) == ("b", "T", date(2023, 3, 28), None, ".txt")
    assert "\r" not in p[0]["text"] and "\n\n\n" not in p[0]["text"] and p[0]["policy_id"] == "policy_" + hashlib.sha256(f"/x/a.md:{p[0]['text']}".encode()).hexdigest()[:16]
    s = ingest.sections(pol)
    got = [(r["doc"], r["section_index"], r["title"], r["text"]) for r in s.orderBy("doc", "section_index").collect()]
    assert got == [
        (0, 0, None, "**Author:** Ann\n**Last Reviewed:** 2021-08-15\nIntro line"), (0, 1, "Rules", "- First must do\nthis thing\n- Second shall not. Third may."),
        (0, 2, "days after", "Text here. More text!\nand more"), (1, 0, None, ""), (2, 0, None, "Body one."),
    ]
    text = [r["sentence"] for r in ingest.sentences(s).where("doc = 0 and section_index > 0").orderBy("section_index", "sentence_index").collect()]
    assert text == ["First must do this thing", "Second shall not.", "Third may.", "Text here.", "More text!", "and more"]


@pytest.mark.parametrize("text, want", [("2023-03-28", date(2023, 3, 28)), ("20230328", date(2023, 3, 28)), ("2023-W13-2", date(2023, 3, 28)), ("2023W132", date(2023, 3, 28)), ("2023", None), ("2023-3-1", None), ("2023-02-30", None), ("soon", None)])
def test_iso_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(ingest.iso_date(F.col("v"))).first()[0] == want


def vector(text):
    import re

    t = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())
    out = {}
    for f in t + [f"{a}::{b}" for a, b in zip(t, t[1:])]:
        h = hashlib.sha256(f.encode()).digest()
        k = int.from_bytes(h[:8], "big") % 384
        out[k] = out.get(k, 0) + (1 if h[8] % 2 == 0 else -1)
    return {k: v for k, v in out.items() if v}


def test_hash_vectors(spark):
    texts = ["employees | rotate keys | every 90 days", "a", "", "TLS 1.2 tls 1.2 TLS 1.2", "x-y.z é w"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", embed.hash_vector(F.col("t")).alias("v"))
    for r in d.select("t", "v", embed.dense(F.col("v")).alias("e")).collect():
        want = vector(r["t"])
        assert dict(zip(r["v"]["idx"], r["v"]["val"])) == want and r["v"]["sq"] == sum(x * x for x in want.values()) and len(r["e"]) == 384
        assert math.isclose(sum(x * x for x in r["e"]), 1.0 if want else 0.0, abs_tol=1e-5)


def test_hash_vectors_in_batches(spark, monkeypatch):
    """As columns and plain Python have them, whatever a worker still knows; features of a row cost no square of their number."""
    texts = ["employees | rotate keys | every 90 days", "a", "", "TLS 1.2 tls 1.2 TLS 1.2", "x-y.z \u00e9 w", "\u212aey \u0130d", None]
    rows = [(i, t, [t], i % 2 == 0) for i, t in enumerate(texts * 3)]
    monkeypatch.setattr(embed, "KNOWN", 3)
    d = spark.createDataFrame(rows, "ord long, t string, l array<string>, b boolean").where("t is not null").repartition(2)
    got = embed.with_hash_vectors(d, "t")
    assert got.columns == [*d.columns, "vector"]
    got = got.withColumn("again", embed.hash_vector(F.col("t"))).collect()
    assert len(got) == 18 and all(r["vector"] == r["again"] and r["l"] == [r["t"]] and r["b"] == (r["ord"] % 2 == 0) for r in got)
    assert all(dict(zip(r["vector"]["idx"], r["vector"]["val"])) == vector(r["t"]) for r in got if r["t"].isascii())
    long = spark.createDataFrame([(" ".join(f"w{k}" for k in range(30_000)),)], "t string")
    began = time.perf_counter()
    assert embed.with_hash_vectors(long, "t").first()["vector"]["sq"] > 0 and time.perf_counter() - began < 10


def test_encoder_plugs_in(spark):
    o = normalize.normalize(extract.extract(obligations(spark, ["A must run.", "B must stop."])))
    r = embed.embed(o, lambda ts: [[3.0, 4.0] for _ in ts]).collect()
    assert all([round(x, 4) for x in x["embedding"]] == [0.6, 0.8] and x["backend"] == "encoder" for x in r)


def test_cosine(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([], [1.0]), ([0.0], [1.0])]
    d = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in d.select(cosine(F.col("a"), F.col("b"))).collect()] == [0, 1, 0, 0]
    with pytest.raises(Exception, match="dimension"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()


@pytest.mark.parametrize("seed, k", [(1, 1), (2, 2), (3, 5)])
def test_cap_equals_a_pass_in_order(spark, seed, k):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(120)}
    rows = [(a, b, f"o{a:02}", f"o{b:02}", rng.choice([0.6, 0.7, 0.9]), rng.random() < 0.3, rng.random() < 0.2, rng.randint(0, 5)) for a, b in sorted(edges)]
    d = spark.createDataFrame(rows, "src_ord long, tgt_ord long, id_low string, id_high string, cosine double, modality_mismatch boolean, negation_mismatch boolean, n_same int")
    order = sorted(rows, key=lambda r: (r[0], r[1]))
    order.sort(key=lambda r: (r[5], r[6], r[4], r[7], (r[2], r[3])), reverse=True)
    degree, want = {}, set()
    for a, b, *_ in order:
        if degree.get(a, 0) < k and degree.get(b, 0) < k:
            want.add((a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    assert {(r["src_ord"], r["tgt_ord"]) for r in candidates.capped(d, k).collect()} == want


@pytest.mark.parametrize("band", [40, 400, 4_000_000])
def test_cap_takes_few_passes(spark, monkeypatch, band):
    """All pairs of 90 alike, so that each depends on those before it: rounds of safe pairs would be 45 (two ends at a time)."""
    n, k, tables = 90, 2, []
    d = spark.range(n).select(F.col("id").alias("src_ord")).crossJoin(spark.range(n).select(F.col("id").alias("tgt_ord"))).where("src_ord < tgt_ord").selectExpr(
        "src_ord", "tgt_ord", "format_string('o%02d', src_ord) as id_low", "format_string('o%02d', tgt_ord) as id_high", "0.75d as cosine", "src_ord % 9 = 0 as modality_mismatch", "false as negation_mismatch", "1 as n_same",
    )
    rows = sorted([tuple(r) for r in d.collect()], key=lambda r: (r[5], r[2], r[3]), reverse=True)
    degree, want = dict.fromkeys(range(n), 0), set()
    for a, b, *_ in rows:
        if degree[a] < k and degree[b] < k:
            want.add((a, b))
            degree[a], degree[b] = degree[a] + 1, degree[b] + 1
    monkeypatch.setattr(candidates, "BAND", band)
    real = candidates.written
    monkeypatch.setattr(candidates, "written", lambda df, name: tables.append(name) or real(df, name))
    assert {(r["src_ord"], r["tgt_ord"]) for r in candidates.capped(d, k).collect()} == want
    assert len(tables) <= 3 + 3 * (1 + len(rows) // band // 2)


@pytest.mark.parametrize("seed, k, across", [(1, 2, True), (2, 3, False)])
def test_cap_lists_no_large_group(spark, monkeypatch, seed, k, across):
    """Large groups under a cap: the pairs of a pass in order over all of them, which are never written all at once."""
    rng = random.Random(seed)
    some = lambda *v: rng.choice(v)
    texts = [f"{some('Staff', 'Admins')} {some('must', 'must not', 'should', 'may')} {some('rotate', 'review', 'copy')} {some('file', 'key')} {rng.randint(0, 9)}{some('', ' using WEP', ' using SHA-1 and WEP')}{some('', ' every 30 days')}." for _ in range(150)]
    o = pipeline.obligations_of(obligations(spark, texts, [i % 7 for i in range(150)])).persist()
    every = candidates.candidates(o, 0.55, None, across).collect()
    urgency = lambda r: (r["modality_mismatch"], r["negation_mismatch"], r["cosine"], r["n_same"], r["id_low"], r["id_high"])
    degree, want = {}, set()
    for r in sorted(sorted(every, key=lambda r: (r["src_ord"], r["tgt_ord"])), key=urgency, reverse=True):
        a, b = r["src_ord"], r["tgt_ord"]
        if degree.get(a, 0) < k and degree.get(b, 0) < k:
            want.add(tuple(r[c] for c in every[0].__fields__))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    for name, value in (("BLOCK", 10), ("LISTED", 12)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(candidates, "BAND", 60)
    sizes, real = [], candidates.written

    def counted(df, name):
        d = real(df, name)
        sizes.append(d.count())
        return d

    monkeypatch.setattr(candidates, "written", counted)
    got = candidates.candidates(o, 0.55, k, across).select(*every[0].__fields__).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert max(sizes) < len(every) / 4 and len(sizes) > 6


def test_candidates_and_findings(spark):
    texts = [
        "Employees must rotate database keys every 30 days.", "Employees must not rotate database keys.", "Employees must rotate database keys every 90 days.", "Employees should rotate database keys every 30 days.",
        "Employees must rotate database keys every 30 days.", "Visitors wear badges.", "Employees must rotate database keys every 3 months on production systems.",
    ]
    o = corpus.corpus_frequency(pipeline.obligations_of(obligations(spark, texts))).persist()
    pairs = candidates.candidates(o)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = {(r["src_ord"], r["tgt_ord"]): (r["finding_type"], r["severity"]) for r in detect.findings(pairs, o).collect()}
    assert got[(0, 1)] == ("CONTRADICTION", "CRITICAL") and got[(1, 3)] == ("CONTRADICTION", "HIGH")
    assert got[(0, 2)] == ("FREQUENCY_MISMATCH", "MEDIUM") and got[(0, 3)] == ("MODALITY_INCONSISTENCY", "MEDIUM") and got[(0, 4)] == ("REDUNDANCY", "LOW")
    assert (2, 6) not in got or got[(2, 6)][0] != "FREQUENCY_MISMATCH"  # a quarter is 90 days
    # its own policy, the one with the same words, and the one that differs in modality only, which vectors leave out
    assert {r["ord"]: r["corpus_frequency"] for r in o.collect()}[0] == 3
    assert candidates.candidates(o, include_same_policy=False, top_k=1).count() <= 3
    for bad in ({"threshold": 2.0}, {"top_k": 0}):
        with pytest.raises(ValueError):
            candidates.candidates(o, **bad)


def test_near_texts_are_complete(spark):
    rng = random.Random(4)
    base = " ".join(f"w{k}" for k in range(60))
    texts = [base + f" v{k}" for k in range(6)] + [" ".join(f"u{rng.randint(0, 30)}" for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["solo", "solo solo solo solo solo solo solo solo x"]
    d = spark.createDataFrame([(t,) for t in sorted(set(texts))], "embedding_text string").withColumns({"vector": embed.hash_vector(F.col("embedding_text")), "id": F.xxhash64("embedding_text")})
    name = {r["id"]: r["embedding_text"] for r in d.collect()}
    v = {t: vector(t) for t in texts}
    n = {t: sum(x * x for x in v[t].values()) for t in texts}
    cos = lambda a, b: sum(x * v[b].get(k, 0) for k, x in v[a].items()) / math.sqrt(n[a] * n[b])
    want = {(a, b) for a in v for b in v if a != b and n[a] and n[b] and cos(a, b) >= 0.9}
    assert {(name[r["a"]], name[r["b"]]) for r in corpus.near_texts(d, 0.9).collect()} == want and want


@pytest.mark.parametrize("threshold", [0.9, 0.95])
def test_near_texts_by_two_and_three_places(spark, threshold):
    """Both ways find all pairs, vectors that one or two places dominate included, and three let fewer texts meet."""
    rng = random.Random(9)
    base = [1] * 30
    rows = [dict(enumerate(base))]
    for _ in range(60):  # near ones and others, multiples, and some of few or heavy places
        rows.append({k + (rng.random() < 0.06): v for k, v in enumerate(base)} | {40 + rng.randint(0, 60): 1 for _ in range(rng.randint(0, 2))})
        rows.append({rng.randint(0, 40): rng.choice([-1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 12))})
        rows.append({rng.randint(0, 4): 9, rng.randint(5, 8): rng.choice([1, 9, 18])} | {10 + rng.randint(0, 90): 1 for _ in range(rng.randint(0, 3))})
        rows.append({k: 2 * v for k, v in rng.choice(rows).items()})
    rows = list({tuple(sorted(r.items())): r for r in rows}.values())
    kind = f"id long, vector {embed.VECTOR}"
    d = spark.createDataFrame([(i, (sorted(r), [r[k] for k in sorted(r)], sum(v * v for v in r.values()))) for i, r in enumerate(rows)], kind)
    sq = [sum(v * v for v in r.values()) for r in rows]
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and sum(v * b.get(k, 0) for k, v in a.items()) / math.sqrt(sq[i] * sq[j]) >= threshold}
    for shared in (2, 3):
        got = [tuple(r) for r in corpus.sparse_candidates(d, threshold, shared).collect()]
        assert want <= set(got) and len(set(got)) == len(got) and all(a < b for a, b in got) and len(want) > 200, shared


def test_near_texts_of_many_meet_by_three(spark, monkeypatch):
    """Where many texts share two rare places, three are asked for."""
    rng = random.Random(10)
    rows = [(i, (sorted(v), [1] * 20, 20)) for i, v in enumerate(rng.sample(range(60), 20) for _ in range(3000))]
    d, asked = spark.createDataFrame(rows, f"id long, vector {embed.VECTOR}"), []
    chosen = corpus._chosen
    monkeypatch.setattr(corpus, "_chosen", lambda p, n: asked.append(n) or chosen(p, n))
    monkeypatch.setattr(corpus, "SHUFFLED", 1)
    corpus.sparse_candidates(d, 0.95)
    corpus.sparse_candidates(d.limit(20), 0.95)
    assert asked == [2, 3, 2]  # keys of two are only listed where there is need


def test_staleness(spark):
    today = date(2026, 7, 12)
    rows = [("a", "A", date(2025, 1, 10)), ("b", "B", date(2025, 1, 9)), ("c", "C", None), ("d", "D", date(2024, 8, 27))]
    got = {r["policy_id"]: r for r in staleness.stale_policies(spark.createDataFrame(rows, "policy_id string, title string, review_date date"), today).collect()}
    assert set(got) == {"b", "d"} and (got["b"]["age_days"], got["d"]["age_days"], got["d"]["months_overdue"]) == (549, 684, 22)
    o = spark.createDataFrame([("p", "o1", ["md5", "TLS 1.3"]), ("p", "o1", ["md5"]), ("p", "o2", ["SHA-1", "DES"])], "policy_id string, obligation_id string, technology array<string>")
    assert sorted((r["source_obligation_id"], r["subject_of"]) for r in staleness.stale_references(o).collect()) == [("o1", "md5"), ("o2", "DES"), ("o2", "SHA-1")]


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Model:
    model = "test"

    def generate(self, prompt):
        if "rotate a" in prompt:
            return '{"verified": true, "confidence": 1.5, "explanation": " yes "}'
        if "rotate b" in prompt:
            return '{"verified": false, "confidence": 0.2, "explanation": "no"}'
        raise RuntimeError("down")


def test_verification(spark):
    o = spark.createDataFrame([(i, f"o{i}", f"rotate {c}") for i, c in enumerate("abc")], "ord long, obligation_id string, sentence string")
    rows = [(f"f{i}", "X", f"o{i}", f"o{i}", 0.6, 0.5, False, "why") for i in range(3)] + [("f3", "X", "o0", "zz", 0.6, 0.5, False, "why"), ("f4", "X", "o0", "o0", 0.97, 0.5, False, "why"), ("f5", "X", "o0", "o0", 0.4, 0.5, False, "why")]
    f = spark.createDataFrame(rows, "finding_id string, finding_type string, source_obligation_id string, target_obligation_id string, deterministic_score double, confidence double, llm_verified boolean, explanation string")
    v = verify.verify(f, o, Model())
    got = {r["finding_id"]: r for r in v.findings.collect()}
    assert set(got) == {"f0", "f2", "f3", "f4"} and got["f0"]["llm_verified"] and got["f0"]["confidence"] == 1.0 and got["f0"]["explanation"] == "why LLM verification: yes"
    assert {r["status"]: r["count"] for r in v.stats.collect()} == {"verified": 1, "rejected": 1, "failed": 2, "bypassed": 1, "dropped": 1} and v.warnings.count() == 2
    assert verify.verify(f, o, None).findings.count() == 6
    with pytest.raises(ValueError):
        verify.verify(f, o, None, 0.9, 0.5)


@pytest.mark.parametrize("reply", ["not json", "[]", '{"verified": "yes", "confidence": 1, "explanation": "x"}', '{"verified": true, "confidence": true, "explanation": "x"}', '{"verified": true, "confidence": 1, "explanation": " "}', None])
def test_bad_replies(spark, reply):
    with pytest.raises(ValueError):
        verify.parse_reply(reply)
    assert spark.createDataFrame([(reply,)], "r string").select(verify.parsed(F.col("r")).alias("p")).first()["p"] is None


def test_matching(spark):
    p = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    labels = spark.createDataFrame([("x",), ("z",)], "k string")
    m = evaluate.matched(p, labels, ["k"])
    assert {r["k"]: (r["tp"], r["fp"], r["fn"]) for r in m.collect()} == {"x": (1, 1, 0), "y": (0, 1, 0), "z": (0, 0, 1)}
    s = evaluate.scores(m).first()
    assert (round(s["precision"], 4), s["recall"], s["f1"]) == (0.3333, 0.5, 0.4) and evaluate.scores(m.limit(0)).first()["f1"] == 0


def test_documents(spark, tmp_path):
    (tmp_path / "a b.md").write_bytes(b"# A\n\xff Users must log out.\n")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "e.pdf").write_bytes(b"no pdf")
    (tmp_path / "f.csv").write_text("x")
    names = ["a b.md", "d.docx", "e.pdf", "f.csv", "gone.txt", "."]
    got = [(r["doc"], r["raw"], r["error"]) for r in sources.read_documents(spark, [str(tmp_path / n) for n in names]).orderBy("doc").collect()]
    assert got[0][1] == "# A\n� Users must log out.\n" and got[1][1] == "One\nTwo" and [bool(g[2]) for g in got] == [False, False, True, True, True, True]
    assert sources.check_upload("../x.exe", 3)[0] == 415 and sources.check_upload("x.md", 0)[0] == 422 and sources.check_upload("x.md", 3) is None and sources.staged_name(2, "a/b.md") == "2-b.md"
    with pytest.raises(TypeError):
        sources.paths_of(123)
    r = pipeline.analyze(spark, [str(tmp_path / "a b.md"), str(tmp_path / "gone.txt")], today=date(2026, 1, 1))
    s = r.statistics.first()
    assert (s["documents_received"], s["policies_processed"], s["obligations_extracted"]) == (2, 1, 1) and r.warnings.count() == 1


class Counting:
    """Answers, and notes every prompt in a file, as it runs in other processes."""

    def __init__(self, log):
        self.log = log

    def generate(self, prompt):
        with open(self.log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad":
            raise RuntimeError("no answer")
        return '{"verified": true, "confidence": 0.5, "explanation": "' + prompt + '"}'


def test_replies_are_kept(spark, tmp_path):
    """A prompt is sent once, over readers and runs; what failed is sent again in the next run."""
    log = tmp_path / "log"
    cached = verify.CachedProvider(Counting(str(log)), str(tmp_path / "replies"))
    prompts = lambda *p: spark.createDataFrame([(x,) for x in p], "prompt string")
    for asked, sent in ((("a", "b", "a", "bad"), ["a", "b", "bad"]), (("b", "c", "bad"), ["bad", "c"])):
        log.write_text("")
        got = verify.ask(prompts(*asked), cached)
        rows = {r["prompt"]: (r["verified"], r["reply_explanation"], r["error"]) for r in got.collect()}
        assert got.count() == len(set(asked)) and sorted(log.read_text().split()) == sent
        assert rows == {p: (None, None, "no answer") if p == "bad" else (True, p, None) for p in asked}
    assert cached.generate("x") and cached.replies(spark).count() == 3


def documents(spark, n=5):
    rules = ["Employees must rotate database keys every 30 days.", "Employees must not rotate database keys.", "Contractors should use SHA-1."]
    raw = "# Policy {}\n**Last Reviewed:** 2020-01-01\n\n## Rules\n" + "\n".join("- " + r for r in rules) + "\n"
    return spark.createDataFrame([(i, f"/p{i}.md", raw.format(i)) for i in range(n)], "doc long, path string, raw string")


def angle(texts):
    """Two dimensions: what is about keys lies near one direction, the rest across."""
    return [[1.0, 0.01 * (len(t) % 7)] if "keys" in t else [0.0, 1.0] for t in texts]


def test_encoder_in_the_whole_analysis(spark):
    """An encoder's vectors go through counts, pairs and findings; a batch that fails is hashed and told."""
    r = pipeline.analyze_table(documents(spark), today=date(2026, 1, 1), top_k=None, encoder=angle)
    s = r.statistics.first()
    assert s["embedding_backend"] == "encoder" and s["by_finding_type"]["CONTRADICTION"] == 25 and r.warnings.count() == 0
    assert {o["corpus_frequency"] for o in r.obligations.collect()} == {5}
    assert {len(o["embedding"]) for o in r.obligations.collect()} == {2}

    def broken(texts):
        raise RuntimeError("no model here")

    r = pipeline.analyze_table(documents(spark), today=date(2026, 1, 1), top_k=None, encoder=broken)
    assert [w["warning"] for w in r.warnings.collect()] == ["[embeddings]: 3 texts were hashed: no model here"]
    s = r.statistics.first()
    assert s["embedding_backend"] == "hashing" and s["by_finding_type"]["CONTRADICTION"] == 25


def test_near_texts_of_an_encoder(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 24))
    x = np.concatenate([base, base + 0.18 * rng.standard_normal((30, 24)), base + 0.4 * rng.standard_normal((30, 24)), np.zeros((2, 24))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    f = x.astype(np.float32).astype(float)
    n = np.maximum(np.linalg.norm(f, axis=1), 1e-30)
    like = (f @ f.T) / n[:, None] / n
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(like >= 0.95)) if i != j}
    assert {(r["a"], r["b"]) for r in corpus.near_texts(d).collect()} == want and len(want) > 40


def test_model_is_loaded_once(monkeypatch):
    """On the first device that takes it; a model that can't be loaded is not tried again."""
    tries = []

    def load(device):
        tries.append(device)
        if device == "cuda":
            raise RuntimeError("out of memory")
        return angle

    monkeypatch.setattr(embed, "devices", lambda: ["cuda", "cpu"])
    model = embed.ModelEncoder("m", load)
    assert model.device() == "not-loaded" and model(["keys"]) == angle(["keys"]) == model(["keys"]) and tries == ["cuda", "cpu"] and model.device() == "cpu"
    monkeypatch.setattr(embed, "devices", lambda: ["cuda"])
    lost = embed.ModelEncoder("lost", load)
    for _ in range(2):
        with pytest.raises(RuntimeError, match="can't be loaded"):
            lost(["x"])
    assert tries == ["cuda", "cpu", "cuda"]
    model.forget()
    assert model.device() == "not-loaded"


@pytest.mark.parametrize("stage, owner, name", [
    ("embeddings", embed, "embed"), ("corpus_frequency", corpus, "corpus_frequency"), ("candidates", candidates, "candidates"), ("detection", detect, "findings"),
    ("staleness", staleness, "stale_references"), ("llm", verify, "ask"),
])
def test_a_stage_that_fails_ends_nothing(spark, monkeypatch, stage, owner, name):
    """Whether it fails when it is planned or when it runs (the last two in turn)."""

    def fails(d, *args, **kw):
        if stage in ("embeddings", "candidates"):
            return d.select(F.raise_error(F.lit("out of order")).alias("x"))
        raise RuntimeError("out of order")

    monkeypatch.setattr(owner, name, fails)
    r = pipeline.analyze_table(documents(spark), today=date(2026, 1, 1), top_k=None, provider=Model() if stage == "llm" else None)
    notes = [w["warning"] for w in r.warnings.collect()]
    assert len(notes) == 1 and notes[0].startswith(f"[{stage}]: ") and "out of order" in notes[0]
    s, kinds = r.statistics.first(), r.findings.groupBy("finding_type").count().collect()
    kinds = {k["finding_type"]: k["count"] for k in kinds}
    assert s["obligations_extracted"] == 15 and s["policies_processed"] == 5 and s["by_finding_type"] == kinds
    assert kinds.get("CONTRADICTION", 0) == (0 if stage in ("embeddings", "candidates", "detection") else 25)
    assert kinds.get("STALE_POLICY", 0) == (0 if stage == "staleness" else 5)


@pytest.mark.parametrize("stage, owner, name", [
    ("embeddings", embed, "embed"), ("corpus_frequency", corpus, "corpus_frequency"), ("candidates", candidates, "candidates"), ("detection", detect, "findings"),
    ("staleness", staleness, "stale_references"), ("llm", verify, "verify"),
])
def test_a_failure_is_no_result(spark, monkeypatch, stage, owner, name):
    """The queries give counts of findings only, so a stage that fails ends them; elsewhere the statistics name it."""
    from dutylens.plans import catalog

    def fails(d, *args, **kw):
        if stage in ("embeddings", "candidates"):
            return d.select(F.raise_error(F.lit("out of order")).alias("x"))
        raise RuntimeError("out of order")

    monkeypatch.setattr(catalog.corpora, "policy_documents", lambda spark, sf: documents(spark, 2))
    monkeypatch.setattr(owner, name, fails)
    for query in (catalog.analyze_documents, catalog.analyze_documents_capped):
        with pytest.raises(pipeline.StageFailed, match=rf"^\[{stage}\]: .*out of order"):
            query(spark, "")
    if stage != "llm":  # what is called in its place is the same function here
        r = pipeline.analyze_table(documents(spark, 2), today=date(2026, 1, 1))
        assert r.stages_failed == r.statistics.first()["stages_failed"] == [stage]


def test_a_document_without_text_failed(spark, monkeypatch):
    from dutylens.plans import catalog

    rows = documents(spark, 2).unionByName(spark.createDataFrame([(7, "/p7.md", None)], "doc long, path string, raw string"))
    r = pipeline.analyze_table(rows, today=date(2026, 1, 1))
    s = r.statistics.first()
    assert (s["documents_received"], s["policies_processed"], s["documents_failed"]) == (3, 2, 1) and r.policies.count() == 2
    assert ["/p7.md" in w["warning"] and "no text" in w["warning"] for w in r.warnings.collect()] == [True] and s["stages_failed"] == r.stages_failed == []
    monkeypatch.setattr(catalog.corpora, "policy_documents", lambda spark, sf: rows)
    with pytest.raises(pipeline.StageFailed, match="no text"):
        catalog.analyze_documents(spark, "")


def test_results_and_labels(spark, tmp_path):
    """Results are written in both formats, labels are read as text."""
    r = pipeline.analyze_table(documents(spark, 2), today=date(2026, 1, 1), provider=Model())
    s = r.statistics.first()
    assert s["llm_enabled"] and s["llm_provider"] == "Model" and s["llm_eligible_findings"] == s["llm_verified_findings"] + s["llm_rejected_findings"] + s["llm_failed_findings"] > 0
    for fmt in ("parquet", "json"):
        sources.write_result(r, str(tmp_path / fmt), fmt)
        back = spark.read.format(fmt).load(str(tmp_path / fmt / "findings"))
        assert back.count() == r.findings.count() == s["findings_total"]
    with pytest.raises(ValueError):
        sources.write_result(r, str(tmp_path / "x"), "csv")
    (tmp_path / "l.csv").write_bytes(b'\xef\xbb\xbfa,b\n1,"x, ""y"""\n')
    assert [tuple(x) for x in sources.read_labels(spark, str(tmp_path / "l.csv"), ["a", "b"]).collect()] == [("1", 'x, "y"')]
    staged = sources.stage_uploads([("../a.md", [b"# A\n", b"Users must log out.\n"]), ("a.md", [b"x"])], str(tmp_path / "staged"))
    assert [p.rsplit("/", 1)[-1] for p in staged] == ["0-a.md", "1-a.md"] and open(staged[0], "rb").read() == b"# A\nUsers must log out.\n"
    for name, parts in (("a.exe", [b"x"]), ("a.md", [])):
        with pytest.raises(ValueError):
            sources.stage_uploads([(name, parts)], str(tmp_path / "staged"))
    with pytest.raises(ValueError):
        sources.stage_uploads([], str(tmp_path / "staged"))


@pytest.mark.parametrize("top_k", [None, 2])
def test_whole_analysis(spark, top_k):
    bad = spark.createDataFrame([(5, "/p5.pdf", None, "can't be read")], "doc long, path string, raw string, error string")
    rows = documents(spark).withColumn("error", F.lit(None).cast("string")).unionByName(bad)
    r = pipeline.analyze_table(rows, today=date(2026, 1, 1), top_k=top_k)
    s = r.statistics.first()
    assert (s["documents_received"], s["policies_processed"], s["documents_failed"], s["obligations_extracted"]) == (6, 5, 1, 15) and r.warnings.count() == 1
    kinds = s["by_finding_type"]
    assert kinds["STALE_POLICY"] == 5 and kinds["STALE_REFERENCE"] == 5
    if top_k is None:  # each of 5 with each of 5, the own policy included; the same text stands in 5 policies, so none is redundant
        assert kinds["CONTRADICTION"] == 25 and "REDUNDANCY" not in kinds
    else:
        rows = sorted(candidates.candidates(r.obligations, top_k=None).collect(), key=lambda p: (p["src_ord"], p["tgt_ord"]))
        rows.sort(key=lambda p: (p["modality_mismatch"], p["negation_mismatch"], p["cosine"], p["n_same"], p["id_low"], p["id_high"]), reverse=True)
        degree, want = {}, set()
        for p in rows:  # a pass in order of priority
            a, b = p["src_ord"], p["tgt_ord"]
            if max(degree.get(a, 0), degree.get(b, 0)) < top_k:
                want.add((a, b))
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        assert {(p["src_ord"], p["tgt_ord"]) for p in r.candidates.collect()} == want and len(want) < len(rows)


def test_scratch_folder(spark):
    from dutylens.sources.scratch import written

    d = spark.range(3).select("id", F.struct("id").alias("s"), F.lit(None).cast("string").alias("n"))
    assert written(d, "t").orderBy("id").collect() == d.orderBy("id").collect()


@pytest.mark.parametrize("block", [2048, 16])
def test_blocked_pairs_are_those_of_the_joins(spark, monkeypatch, block):
    """Every pair once, whatever anchors it shares and however its groups are dealt out, with the columns' own cosines."""
    from dutylens.functions.vectors import sparse_cosine
    from dutylens.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", block)
    rng = random.Random(5)
    names = ["TLS 1.0", "WEP", "SHA-1"]
    kind = "ord long, policy_id string, section_id string, obligation_id string, sentence string, subject string, action string, object string, scope string, frequency string, technology array<string>, modality string, negated boolean, topic string, condition string, exception string"
    rows = []
    for i in range(400):
        pick = lambda *v: rng.choice(v)
        rows.append((
            i, f"p{i % 7}", "s", f"o{rng.randint(0, 99):03}", f"sentence {rng.randint(0, 60)}", pick(None, "staff", "teams"), pick(None, "review", "rotate", "use"), pick(None, f"file {i % 50}", "keys"),
            pick(None, "home"), pick(None, "every 30 days"), rng.sample(names, rng.choice([0, 1, 1, 2, 3])), pick("REQUIRED", "PROHIBITED"), pick(True, False), pick(None, "network"), None, pick(None, "risk is high"),
        ))
    rows.append((400, "p1", "s", "o1", "bare", None, None, None, None, None, ["WEP"], "REQUIRED", False, "network", None, None))
    o = candidates.written(embed.embed(spark.createDataFrame(rows, kind)), "o")
    for across in (True, False):
        plain = candidates.with_ends(candidates.anchored(o, across), o, ["policy_id", "subject", "action", "object", "scope", "frequency", "modality", "negated", "obligation_id", "vector"])
        plain = plain.withColumn("cosine", sparse_cosine(F.col("s.vector"), F.col("t.vector"))).where("cosine >= 0.55").withColumns(candidates.flags())
        plain = plain.select("src_ord", "tgt_ord", F.least("s.obligation_id", "t.obligation_id"), F.greatest("s.obligation_id", "t.obligation_id"), "cosine", *candidates.flags())
        want = sorted(map(tuple, plain.collect()))
        got = blocks.pairs(o, 0.55, across)
        assert len(want) > 4000 and sorted(map(tuple, got.drop("n_same").collect())) == want
        assert got.where("n_same <> int(same_subject) + int(same_action) + int(same_object) + int(same_scope) + int(same_frequency)").isEmpty()
        alike = blocks.pairs(o, 0.55, across, alike=("action", "object"), ids=False, ends=["policy_id"])
        assert sorted((r[0], r[1], r["s_policy_id"], r["t_policy_id"]) for r in alike.collect()) == sorted((w[0], w[1], f"p{w[0] % 7}" if w[0] < 400 else "p1", f"p{w[1] % 7}" if w[1] < 400 else "p1") for w in want if w[7] and w[8])


def test_array_pairs_are_those_of_the_column(spark, monkeypatch):
    """Blocks of arrays give the pairs and the cosines of vectors.cosine, zero and null arrays included."""
    from dutylens.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 20)
    rng = random.Random(6)
    rows = [(i, i % 3 if i % 11 else None, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(500, 1, [0.0] * 6), (501, 1, None), (502, 2, []), (503, 9, [1.0] * 6)]
    d = spark.createDataFrame(rows, "id long, label int, x array<float>")
    side = lambda s: d.select("label", F.col("id").alias(s), F.col("x").alias(f"x{s}"))
    want = side("a").join(side("b"), "label").where("a < b").select("a", "b", cosine(F.col("xa"), F.col("xb")).alias("c")).where("c >= 0.3")
    assert sorted(map(tuple, blocks.array_pairs(d, "label", "id", "x", 0.3).collect())) == sorted(map(tuple, want.collect()))

def test_units_of_lines(spark):
    """As the rules say, and in time that grows with the lines: a section may be one long list."""
    parts = lambda lines: spark.createDataFrame([(lines,)], "l array<string>").select(ingest.units(F.col("l"))).first()[0]
    assert parts([]) == []
    assert parts(["a", "b.", "c", "- d", "-", "e", "2. f!", "+ g", "h?", "i"]) == ["a b.", "c", "d", " e", "f!", "g h?", "i"]
    assert parts(["+x", "-y", "* ", "+ z.", "+ w"]) == ["+x -y", "", "z.", "w"]
    many = [f"- line {i}" for i in range(60_000)]
    began = time.perf_counter()
    assert parts(many) == [x[2:] for x in many]
    assert time.perf_counter() - began < 10
