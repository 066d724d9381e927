"""The corpus operators against brute force, on small tables with odd rows."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from dutylens.llm import ann, bpe, line_frequency, mixing, pii, sharding, simhash, token_scan, toxicity, warc_fixity
from dutylens.llm.common import components
from dutylens.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, skey string, h string, part string, fp string, host string"


def table(spark, rows):
    """documents with columns whose names clash with ours."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, s in rows], DOCS)


def odd_rows():
    rng = random.Random(5)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "Ünï", "日本", "x1"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))), f"s{i % 4}" if i % 9 else None) for i in range(90)]
    rows += [(100 + i, rows[0][1], "s0") for i in range(40)]  # one text in a third of the rows
    return [*rows, (200, None, "s1"), (201, "", "s2"), (None, "no id here", "s1"), (203, "long " * 20_000, "s3"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (204, " \t\n ", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ------------------------------------------------------------------ op 1


def test_token_scan(spark, docs, tmp_path):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    encode = token_scan.byte_coder(path)
    want = Counter((i, len(encode(t or ""))) for i, t, _ in odd_rows())
    for block in (1, 7, 1 << 19):
        if block == 1:
            got = token_scan.count_tokens(table(spark, [r for r in odd_rows() if len(r[1] or "") < 50][:20]), path, 50256, block_tokens=block)
            assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == Counter((i, len(encode(t or ""))) for i, t, _ in [r for r in odd_rows() if len(r[1] or "") < 50][:20])
        else:
            got = token_scan.count_tokens(docs, path, 50256, block_tokens=max(block, 500))
            assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want


def test_token_scan_of_files(spark, tmp_path):
    end = 9
    np.array([1, 2, 9, 9, 3, 4, 5, 9, 6], "<u4").tofile(tmp_path / "a.tok")
    np.array([], "<u4").tofile(tmp_path / "b.tok")
    np.array([1] * 5000, "<u4").tofile(tmp_path / "c.tok")
    got = {(r["file"], r["nth"]): (r["n_tokens"], r["ended"]) for r in token_scan.scan_tokens(spark, str(tmp_path), end, "<u4", block_tokens=2).collect()}
    assert got == {("a.tok", 0): (2, True), ("a.tok", 1): (0, True), ("a.tok", 2): (3, True), ("a.tok", 3): (1, False), ("c.tok", 0): (5000, False)}
    (tmp_path / "d.tok").write_bytes(b"123")
    with pytest.raises(ValueError):
        token_scan.scan_tokens(spark, str(tmp_path), end, "<u4")


def test_token_files_are_found(spark, docs, empty, tmp_path, monkeypatch):
    """Paths with and without a scheme; what is lost on the way is an error, never a shorter result."""
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    for folder in (f"file:{tmp_path}/with space/a", f"file://{tmp_path}/b", f"{tmp_path}/c"):
        manifest, where = token_scan.write_token_files(docs, path, 50256, folder=folder)
        assert token_scan.scan_tokens(spark, folder, 50256).count() == token_scan.scan_tokens(spark, where, 50256).count() == manifest.count() == len(odd_rows())
    with pytest.raises(FileNotFoundError):
        token_scan.scan_tokens(spark, f"{tmp_path}/nowhere", 50256)
    with pytest.raises(ValueError):
        token_scan.open_store("dbfs:/folder")
    assert token_scan.count_tokens(empty, path, 50256).count() == 0
    listed = token_scan.token_files
    monkeypatch.setattr(token_scan, "token_files", lambda folder: listed(folder)[1:])
    with pytest.raises(RuntimeError):
        token_scan.count_tokens(docs.repartition(3), path, 50256)


# ------------------------------------------------------------------ op 2


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    size = {(i, s): len(WORD.findall(t or "")) for i, t, s in odd_rows()}
    assert sorted(r["size"] for r in rows) == sorted(len(WORD.findall(t or "")) for _, t, _ in odd_rows())
    total = defaultdict(int)
    for _, t, s in odd_rows():
        total[s] += len(WORD.findall(t or ""))
    names = sorted([s for s in total if s is not None]) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free, left, target = set(names), sum(total.values()), {}
    while True:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 3 * total[s]}
        if not full:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: 3 * total[s] for s in full}
        left, free = left - sum(3 * total[s] for s in full), free - full
    source = {i: s for i, _, s in odd_rows()}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert math.isclose(r["target"], target[s]) and r["source_size"] == total[s] and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"] * (3 if r["doc_id"] == 7 else 1))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names), (taken, target, size)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert mixing.mix(empty).count() == 0
    out = mixing.mix_rows(docs)
    assert out.columns == docs.columns
    passes = Counter()
    for r in rows:
        passes[r["doc_id"]] += r["passes"] if r["size"] else 1
    assert Counter(r["doc_id"] for r in out.collect()) == +passes


def test_mixes_are_nested(docs):
    small, large = ({(r["doc_id"]): r["passes"] for r in mixing.mix(docs, share=s).collect()} for s in (0.2, 0.6))
    assert all(small[i] <= large[i] for i in small)


# ------------------------------------------------------------------ op 3


def test_toxicity(spark, empty):
    rng = random.Random(3)
    clean = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["grumbloid", "grumbling", "1diot", "id*ot", "scum"])
        rows.append((i, " ".join(words), "s"))
        marks.append((i, int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "scum scum you scum", "s"), (1002, "w1 " * 50_000, "s")]
    d, labels = table(spark, rows), spark.createDataFrame([*marks, (3, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    import zlib

    assert len(got) == len(rows)
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i, _ in marks) and got[None]["held_out"] is False
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[1000]["score"] == got[1001]["score"] and got[1002]["predicted"] == 0
    assert {r["doc_id"] for r in toxicity.keep_clean(d, labels).collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.keep_clean(d, labels).columns == d.columns
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.toxicity(d, none).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_isotonic_and_trees():
    xs, ys = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(ys) > 0).all() and np.allclose(ys, [0, 0.5, 1])
    x = np.random.default_rng(0).random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert (((toxicity.Trees().fit(x, y).raw(x) > 0) == (y > 0)).mean()) > 0.97


# ------------------------------------------------------------------ op 4


PAGES = "page_id long, url string, html string, file string, at string, sha string, node string, value string"


def pages_of(spark, rows):
    """pages with columns whose names clash with ours."""
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], PAGES)


def stored_files(folder):
    """name -> bytes of a replica's files, unpacked by Python."""
    import gzip

    out = {}
    for root, _, names in os.walk(folder):
        for n in names:
            if n.startswith("part-"):
                raw = open(os.path.join(root, n), "rb").read()
                out[os.path.relpath(root, folder)] = gzip.decompress(raw) if n.endswith(".gz") else raw
    return out


def records_in(raw):
    """(offset, bytes) of each record, by the lengths in their headers."""
    at = 0
    while at < len(raw):
        head = raw.index(b"\r\n\r\n", at)
        size = int(re.search(rb"Content-Length: (\d+)", raw[at:head])[1])
        end = head + 4 + size + 4
        yield at, raw[at:end]
        at = end


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_files(spark, monkeypatch, compression):
    """What is written is WARC, and what is read is what Python reads; small splits cut records anywhere."""
    rows = [(i, f"http://h{i % 3}/p{i}", "<p>" + "xé\r\n\r\n" * (i % 70) + "</p>") for i in range(300)] + [(5, "http://h2/p5", "a")] * 3 + [(None, None, None), (9001, "", ""), (9002, "u", "long " * 40_000)]
    folder = warc_fixity.write_warc(pages_of(spark, rows), 4, compression=compression)
    files = stored_files(folder)
    want = {(name, at, len(b), hashlib.sha256(b).hexdigest()) for name, raw in files.items() for at, b in records_in(raw)}
    assert len(want) == len(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "1237b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = warc_fixity.read_warc(spark, folder).collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert len(got) == len(rows) and {(r["file"], r["at"], r["length"], r["sha"]) for r in got} == want
        assert Counter((r["page_id"], r["url"]) for r in got) == Counter((i, u or "") for i, u, _ in rows)


def test_fixity(spark, monkeypatch):
    """Each kind of damage in the middle of one file is one fault; copies are counted; whole files come and go."""
    monkeypatch.setattr(warc_fixity, "LEAF", 8)
    monkeypatch.setattr(warc_fixity, "FAN_OUT", 6)
    monkeypatch.setattr(warc_fixity, "BUCKET", 5000)
    rows = [(i, f"http://h{i % 3}/p{i}", "<p>" + "x" * (i * 37 % 700) + f"{i}</p>") for i in range(1000)] + [(5, "http://h2/p5", "twin")] * 4

    def replica(changed, n_files=1):
        d = spark.createDataFrame([(i, u, h, changed.get(i, h)) for i, u, h in rows if changed.get(i, h) is not None] + [(i, "http://new", h, h) for i, h in changed.items() if i >= 5000], "page_id long, url string, html string, stored string")
        return warc_fixity.write_warc(d, n_files, "stored")

    def faults(a, b):
        return sorted((r["page_id"], r["fault"], r["copies"]) for r in warc_fixity.audit(*[warc_fixity.read_warc(spark, x) for x in (a, b)]).collect())

    whole = replica({})
    assert faults(whole, replica({})) == []
    got = warc_fixity.audit(*[warc_fixity.read_warc(spark, x) for x in (whole, replica({5000: "added", 3: "X", 600: rows[600][2] + "and more", 998: None}))]).collect()
    assert sorted((r["page_id"], r["fault"], r["copies"]) for r in got) == [(3, "altered", 1), (600, "altered", 1), (998, "missing", 1), (5000, "extra", 1)]
    files = {at: b for at, b in records_in(stored_files(whole)["file=0"])}
    assert all(hashlib.sha256(files[r["offset"]]).hexdigest() == r["expected"] and len(files[r["offset"]]) == r["length"] for r in got if r["fault"] != "extra")
    # few records are looked at
    few = warc_fixity.mismatching_records(*[warc_fixity.read_warc(spark, x) for x in (whole, replica({500: "<p>"}))])
    assert 2 <= few.count() < 150 and few.where("page_id = 500").count() == 2
    # copies, files that are lost, empty replicas
    two = [warc_fixity.read_warc(spark, warc_fixity.write_warc(pages_of(spark, r), 5)) for r in (rows, rows[:-2], rows[:0])]
    assert [(r["page_id"], r["fault"], r["copies"]) for r in warc_fixity.audit(two[0], two[1]).collect()] == [(5, "missing", 2)]
    lost = two[0].where("file <> 'file=2'")
    n = two[0].where("file = 'file=2'").count()
    assert [{r["fault"]: r["n"] for r in warc_fixity.audit(x, y).groupBy("fault").agg(F.sum("copies").alias("n")).collect()} for x, y in ((two[0], lost), (lost, two[0]))] == [{"missing": n}, {"extra": n}]
    assert warc_fixity.audit(two[2], two[2]).count() == 0 and warc_fixity.audit(two[2], two[0]).agg({"copies": "sum"}).first()[0] == len(rows)


def test_fixity_of_damaged_bytes(spark):
    """Bytes of a stored file changed, cut and inserted on disk."""
    rows = [(i, f"http://h/p{i}", f"text of page {i} " * 30) for i in range(300)]
    whole = warc_fixity.write_warc(pages_of(spark, rows), 1, compression="none")
    for change, want in (
        (lambda b: b.replace(b"text of page 150 ", b"text of page \xff50 ", 1).replace(b"text of page 70 " * 30, b"text of").replace(b"<urn:page:90>", b"<urn:page:?>")[:-4], [(150, "altered"), (299, "altered"), (70, "altered"), (90, "missing"), (None, "extra")]),
        (lambda b: b[50:-100], [(0, "missing"), (299, "altered"), (None, "extra")]),
    ):
        other = warc_fixity.write_warc(pages_of(spark, rows), 1, compression="none")
        name = next(os.path.join(r, n) for r, _, ns in os.walk(other) for n in ns if n.startswith("part-"))
        os.remove(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))
        raw = open(name, "rb").read()
        open(name, "wb").write(change(raw))
        got = warc_fixity.audit(*[warc_fixity.read_warc(spark, x) for x in (whole, other)]).collect()
        assert sorted(((r["page_id"], r["fault"]) for r in got), key=str) == sorted(want, key=str), want


# ------------------------------------------------------------------ op 5


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.no_padding()
    lib.no_truncation()
    texts = [t for _, t, _ in odd_rows()] + ["a<|endoftext|>b <|startoftext|>", "aaaaaaa aaaa", "İstanbul ΣΑΣ \x1c z don't I'LL", "naïve é 日本語 😀😀 ½ ٣٤ ﬁ", "x" * 3000, "ab" * 999 + "!!", "\x00 \x85 q​q"]
    coder = bpe.Coder(path)
    assert coder.merges.ordered
    for (n, ids, text), t in zip(coder.encode(texts), texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == want and n == len(want)
        assert text == lib.decode(want, skip_special_tokens=False) == coder.decode(want)
    coder.merges.ordered = False  # one place at a time gives the same
    assert [list(coder.merges.encode_words([w])[0]) for w in ("aaaaaaa</w>"[:7], "banana")] == [list(bpe.Coder(path).merges.encode_words([w])[0]) for w in ("aaaaaaa", "banana")]
    rows = bpe.encode_documents(docs, path, with_text=True).collect()
    for r in rows:
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, _ in odd_rows())
    assert bpe.encode_documents(empty, path).count() == 0


def test_bpe_cache_turns_over(monkeypatch):
    path = tokenizer_file("word_bpe_49k.json")
    texts = [" ".join(f"w{i * 7 + j} the" for j in range(7)) for i in range(40)]
    want = list(bpe.Coder(path).encode(texts))
    monkeypatch.setattr(bpe, "CACHED_RUNS", 20)
    coder = bpe.Coder(path)
    assert [x for t in texts for x in coder.encode([t])] == want


# ------------------------------------------------------------------ op 6


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 8).collect()
    assert len(rows) == len(odd_rows())
    total = defaultdict(int)
    slots = defaultdict(list)
    for r in rows:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(total) <= set(range(8))
    assert sharding.shard(empty).count() == 0


def test_shards_are_even(spark):
    rng = random.Random(2)
    rows = [(i, "abc" * rng.randint(1, 200) + str(i), "s") for i in range(1500)] + [(5000 + i, "same text " * 20, "s") for i in range(800)] + [(9000 + i, None, "s") for i in range(300)]
    rows += [(9500 + i // 3, f"twin {i // 3}", "s") for i in range(90)]
    got = sharding.shard(table(spark, rows), 8).collect()
    total, where = defaultdict(int), defaultdict(set)
    text = {i: t for i, t, _ in rows}
    for r in got:
        total[r["shard"]] += r["size"]
        where[text[r["doc_id"]]].add(r["shard"])
        assert r["size"] == len((text[r["doc_id"]] or "").encode()) + 1
    mean = sum(total.values()) / 8
    assert len(total) == 8 and all(abs(v - mean) < 0.05 * mean for v in total.values()), total
    assert all(len(s) == 1 for t, s in where.items() if t != "same text " * 20)


def shards_of(rows, n_shards):
    """The rows' places by sorting them all: doc_id, size, crc, shard, slot."""
    import xxhash
    import zlib

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    hi = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    lo = lambda i: 42 if i is None else signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42))
    rows = sorted((hi(t or ""), lo(i), i, t or "") for i, t, _ in rows)
    sizes = [len(t.encode()) + 1 for *_, t in rows]
    total, limit, groups = sum(sizes), 64 * n_shards, defaultdict(list)
    for k, r in enumerate(rows):
        groups[r[0]].append(k)
    before, out, used = np.cumsum([0, *sizes]), [], Counter()
    for k, (h, _, i, t) in enumerate(rows):
        own = groups[h]
        size, count = sum(sizes[j] for j in own), len(own)
        cut = size * limit > total or count * limit > len(rows)
        middle = before[k] + sizes[k] / 2 if cut else (before[own[0]] + before[own[-1] + 1]) / 2
        at = min(n_shards - 1, int(middle * n_shards / total))
        out.append((i, sizes[k], zlib.crc32(t.encode()), at, used[at]))
        used[at] += 1
    return out


def test_shards_by_sorting(spark, docs, monkeypatch):
    """Every place, for several layouts of the table, with ranges that start out overfull and with one huge record."""
    monkeypatch.setattr(sharding, "SAMPLE", 64)
    rng = random.Random(4)
    rows = [(i % 700 if i % 50 else None, " ".join(["w"] * rng.randint(0, 60)) + str(i % 900), "s") for i in range(1500)] + [(5, "same again", "s")] * 700
    for given in (odd_rows(), rows):
        want = Counter(shards_of(given, 8))
        for parts in (1, 7):
            got = sharding.shard(table(spark, given).repartition(parts), 8).collect()
            assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want


# ------------------------------------------------------------------ op 7


def ann_results(found):
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def ann_recall(got, ids, x, k=5):
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = ann.exact_cosine(x[i][None, :], x)
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        hit += len({j for j, _ in got[ids[i]]} & set(ids[best]))
        total += len(best)
        place = {v: n for n, v in enumerate(ids)}
        assert all(math.isclose(v, s[place[j]], abs_tol=1e-12) for j, v in got[ids[i]])
        assert got[ids[i]] == sorted(got[ids[i]], key=lambda r: (-r[1], r[0])) and len(got[ids[i]]) == len(best)
    return hit / total


def clustered(n, d=16, centres=40):
    rng = np.random.default_rng(0)
    return (rng.standard_normal((centres, d))[rng.integers(0, centres, n)] + 0.4 * rng.standard_normal((n, d))).astype(np.float32)


@pytest.mark.parametrize("levels", [1, 2])
def test_ann(spark, monkeypatch, levels):
    """One vector in a third of the rows, odd rows, several parts; with two levels, each part is cut again by a fit of its own."""
    if levels == 2:
        monkeypatch.setattr(ann, "FAN_OUT", 4)
        monkeypatch.setattr(ann, "BLOCK", 1024)
        monkeypatch.setattr(ann, "QUERIES", 8)
    x = clustered(6000)
    x[1000:3000] = x[1000]
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)]
    rows += [(i, e, None, None) for i, e in ((6050, None), (6100, [0.0] * 16), (6150, [float("nan")] * 16), (6200, [None] * 16), (None, [1.0] * 16), (6250, [1.0, 2.0]))]
    told = {}
    got = ann_results(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string, a int"), n_parts=16, told=told))
    f = x.astype(float)
    assert ann_recall(got, np.arange(6000), f) >= 0.9 and set(got) == set(range(0, 6000, 50))
    assert told["parts"] == ([16] if levels == 1 else [4, 16]) and told["probes"][0] < told["parts"][0]
    for i in range(1000, 3000, 50):
        assert [j for j, _ in got[i]] == [j for j in range(1000, 1010) if j != i][:5]


def test_ann_of_the_given_vectors(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    d = spark.read.parquet(path)
    rows, told = d.collect(), {}
    got = ann_results(ann.nearest(d, told=told))
    assert told["parts"][0] > 1
    assert ann_recall(got, np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)) >= 0.9


def test_ann_ties(spark):
    """Multiples of one vector tie wherever they are; ids that stand for several vectors are one candidate each."""
    v = [3.0, 1.0, 2.0, 5.0]
    rows = [(100 - i, [c * 2.0 ** (i % 60 - 30) for c in v]) for i in range(100)]
    got = ann_results(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert {q: [j for j, _ in r] for q, r in got.items()} == {50: [1, 2, 3, 4, 5], 100: [1, 2, 3, 4, 5]}
    rows = [(i % 7 + 1, [math.cos(i), math.sin(i)]) for i in range(70)] + [(50, [1.0, 0.0])] * 3
    got = ann_results(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))[50]
    best = sorted((max(math.cos(i) for i in range(70) if i % 7 == j), -j - 1) for j in range(7))[::-1][:5]
    assert [j for j, _ in got] == [-j for _, j in best] and np.allclose([s for _, s in got], [s for s, _ in best])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(few).collect()] == [(0, 1, 1)]
    assert ann.nearest(few.limit(0)).count() == 0


# ------------------------------------------------------------------ op 8


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(reversed(s))) % 10 == 0


def test_pii(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004"]
    days = [(date(1985, 1, 1) + timedelta(days=k)) for k in range(0, 9000, 37)]
    rows = [(i, f"pay {c} now") for i, c in enumerate(cards)] + [(10 + i, f"born {d.isoformat()}.") for i, d in enumerate(days)]
    rows += [(1000, "Jo.Doe7@mail.example.com, 10.0.0.1 and +1 (704) 555-7713! DE89 3704 0044 0532 0130 00"), (1001, "4111111111111112 999.1.1.1 2021-02-30 v2.0. DE88 3704 0044 0532 0130 00"), (1002, None), (1003, ""), (1004, "token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\"")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS m", "'q' AS p", "doc_id AS n")
    got = {r["doc_id"]: r for r in pii.pseudonymise(d, "key", found="n_found").collect()}
    new = [got[i]["text"][4:-4] for i in range(3)]
    assert all(luhn(re.sub(r"\D", "", c)) for c in new) and re.sub(r"\D", "", new[0]) == re.sub(r"\D", "", new[1]) != "4111111111111111"
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", new[1]) and re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", new[2])
    moved = [date.fromisoformat(got[10 + i]["text"][5:-1]) for i in range(len(days))]
    assert len(set(moved)) == len(days) and all(a.year // 100 == b.year // 100 for a, b in zip(days, moved)) and sum(a != b for a, b in zip(days, moved)) > 0.9 * len(days)
    assert not any(x in got[1000]["text"] for x in ("Jo.Doe7", "10.0.0.1", "555-7713", "3704 0044"))
    assert re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d@mail\.example\.com, \d+\.\d+\.\d+\.\d+ and \+1 \(\d{3}\) \d{3}-\d{4}! DE\d\d( \d{4}){4} \d\d", got[1000]["text"]) and got[1000]["n_found"] == 4
    iban = re.search(r"DE.*$", got[1000]["text"])[0].replace(" ", "")
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert got[1001]["text"] == rows[-4][1] and got[1001]["n_found"] == 0
    assert got[1002]["text"] is None and got[1003]["text"] == "" and got[1004]["n_found"] == 1
    assert pii.pseudonymise(d, "key").columns == d.columns and pii.pseudonymise(d.limit(0), "key").count() == 0
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(d, "another").collect()}
    assert other[0] != got[0]["text"]


class Codes:
    """Pseudonyms of single values, or with back what stood before them, written anew in Python."""

    def __init__(self, key, back=False):
        self.key, self.back = key, back

    def digest(self, *parts):
        return hashlib.sha256("|".join([self.key, *map(str, parts)]).encode()).hexdigest()

    def rounds(self):
        return range(pii.ROUNDS, 0, -1) if self.back else range(1, pii.ROUNDS + 1)

    def string(self, s, kind, alphabets):
        a, b = s[: len(s) // 2], s[len(s) // 2 :]
        for i in self.rounds():
            if self.back:
                a, b = b, a
            d, new = self.digest(kind, i, len(a), b), ""
            for j, c in enumerate(a, 1):
                by = int(d[(j - 1) * 2 % 60 :][:4], 16) + j
                own = next((x for x in alphabets if c in x), None)
                new += own[(own.index(c) + (-by if self.back else by)) % len(own)] if own else c
            a, b = (new, b) if self.back else (b, new)
        return a + b

    def pair(self, a, b, na, nb, kind):
        sign = -1 if self.back else 1
        for i in self.rounds():
            if i % 2 == 0:
                a = (a + sign * int(self.digest(kind, i, b)[:15], 16)) % na
            else:
                b = (b + sign * int(self.digest(kind, i, a)[:15], 16)) % nb
        return a, b

    def fill(self, shape, values, pattern):
        values = iter(values)
        return "".join(next(values) if re.match(pattern, c) else c for c in shape)

    def card(self, m):
        d = re.sub(r"\D", "", m)
        body = d[0] + self.string(d[1:-1], "card", [pii.DIGITS])
        return self.fill(m, next(body + c for c in pii.DIGITS if luhn(body + c)), r"\d")

    def ip(self, m):
        o = [int(x) for x in m.split(".")]
        a, b = self.pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"

    def phone(self, m):
        head = (re.match(r"(\+\d{1,3}(?=[ .(-])|\+\d)", m) or [""])[0]
        return head + self.fill(m[len(head) :], self.string(re.sub(r"\D", "", m[len(head) :]), "phone", [pii.DIGITS]), r"\d")

    def ssn(self, m):
        d = self.string(re.sub(r"\D", "", m), "ssn", [pii.DIGITS])
        while re.match(r"000|666|9|...00", d) or d.endswith("0000"):
            d = self.string(d, "ssn", [pii.DIGITS])
        return self.fill(m, d, r"\d")

    def iban(self, m):
        c = m.replace(" ", "")
        body = self.string(c[4:], "iban", [pii.DIGITS, pii.LARGE])
        rest = 98 - int("".join(str(int(x, 36)) for x in body + c[:2] + "00")) % 97
        return self.fill(m, c[:2] + f"{rest:02d}" + body, "[0-9A-Z]")

    def day(self, d):
        first = date(d.year // 100 * 100, 1, 1)
        na, nb = (75, 487) if first.year % 400 == 0 else (92, 397)
        a, b = self.pair((d - first).days // nb, (d - first).days % nb, na, nb, "date")
        return first + timedelta(days=a * nb + b)

    def date(self, m):
        if "-" in m:
            return self.day(date.fromisoformat(m)).isoformat()
        if "." in m:
            return self.day(datetime.strptime(m, "%d.%m.%Y").date()).strftime("%d.%m.%Y")
        if int(m[:2]) <= 12:
            return self.day(datetime.strptime(m, "%m/%d/%Y").date()).strftime("%m/%d/%Y")
        d = self.day(datetime.strptime(m, "%d/%m/%Y").date())
        while d.day <= 12:
            d = self.day(d)
        return d.strftime("%d/%m/%Y")

    def email(self, m):
        return self.string(m.split("@")[0], "email", [pii.DIGITS, pii.SMALL, pii.LARGE]) + "@" + m.split("@")[1]

    def secret(self, m):
        return self.string(m, "secret", [pii.DIGITS, pii.HEX, pii.HEX.upper()])


def test_pseudonyms_are_undone(spark):
    """Of every kind: one pseudonym for each value, valid again, and undone by who has the key."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice(pii.DIGITS) for _ in range(n))
    card = lambda n: next(c for c in (f"4{digits(n - 2)}{k}" for k in [*pii.DIGITS] * 100) if luhn(c))

    def iban(body):
        rest = 98 - int("".join(str(int(x, 36)) for x in body + "DE00")) % 97
        return f"DE{rest:02d}{body}"

    days = [date(1999, 1, 1) + timedelta(days=k) for k in range(366)]
    ssns = {f"{rng.randint(1, 899):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(1500)}
    values = {
        "card": [card(n) for n in (13, 15, 16, 19) for _ in range(40)],
        "ip": [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(150)],
        "phone": [f"+{rng.choice([1, 49, 380])} ({digits(3)}) {digits(3)}-{digits(4)}" for _ in range(150)] + [f"{digits(3)}-{digits(3)}-{digits(4)}" for _ in range(50)],
        "ssn": [s for s in ssns if not s.startswith("666")],
        "iban": [iban(digits(rng.choice([12, 18]))) for _ in range(60)] + [iban("ABCD" + digits(14)) for _ in range(20)],
        "date": [d.isoformat() for d in days] + [d.strftime("%d.%m.%Y") for d in days[:60]] + sorted({d.strftime(x) for d in days for x in ("%m/%d/%Y", "%d/%m/%Y")}),
        "email": [f"{rng.choice(['Ann', 'bob', 'c.D'])}{digits(5)}@mail.org" for _ in range(100)],
        "secret": [hashlib.sha1(digits(9).encode()).hexdigest() for _ in range(60)] + [hashlib.md5(digits(9).encode()).hexdigest().upper() for _ in range(30)],
    }
    undo, code = Codes("key", back=True), Codes("key")
    shape = lambda s: re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
    rows = [(kind, v, f'"{v}"' if kind == "secret" else v) for kind, vs in values.items() for v in dict.fromkeys(vs)]
    out = pii.pseudonymise(spark.createDataFrame(rows, "kind string, value string, text string"), "key", found="n").collect()
    new = defaultdict(set)
    for r in out:
        got = r["text"].strip('"')
        assert getattr(undo, r["kind"])(got) == r["value"] and getattr(code, r["kind"])(r["value"]) == got, r
        assert shape(got) == shape(r["value"]) or r["kind"] == "ip"
        new[r["kind"]].add(got)
    assert all(len(new[k]) == len(set(vs)) for k, vs in values.items())
    assert not any(re.match("000|666|9", s) or "-00-" in s or s.endswith("0000") for s in new["ssn"]) and all(luhn(c) for c in new["card"])


def test_pii_odd_tables(spark):
    """Repeated rows, a very long text, and columns that have our names."""
    rows = [(1, "a@b.org 10.0.0.1", "x", None), (1, "a@b.org 10.0.0.1", "x", None), (2, "mail a@b.org " + "word 10.0.0.1, " * 40_000, None, 2), (3, None, None, None), (4, "", "y", 4)]
    d = spark.createDataFrame(rows, "doc_id long, Text string, done string, done_ int").withColumnRenamed("done_", "__done")
    got = pii.pseudonymise(d, "key").collect()
    assert pii.pseudonymise(d, "key").columns == d.columns and [(r["doc_id"], r["done"], r["__done"]) for r in got] == [(i, a, b) for i, _, a, b in rows]
    assert got[0]["Text"] == got[1]["Text"] != rows[0][1] and got[2]["Text"].count(got[0]["Text"].split()[1] + ",") == 40_000 and "10.0.0.1" not in got[2]["Text"]
    assert pii.pseudonymise(d.drop("Text"), "key").columns == ["doc_id", "done", "__done"]


def test_cards_beside_numbers(spark):
    one, two, four = "4111111111111111", "5500000000000004", "4111 1111 1111 1111"
    beside = [f"{one} 123", f"{one} 12 items", f"room 12 {one}", f"room 1234 {four}", f"{four} 1234 x", f"7 {one} 8 {two} 9", f"{one} {two}", f"{one} 2021-02-03", f"{one} 12-3a", f"5-{one}", f"{one} 12/05/2020", f"{one} 12.5", f"{one} 123-45-6789"]
    plain = ["12345678-1234-1234-1234-123456789abc", "4" * 40, "4111111111111112 3", "1 2 3", "99999999999999999999 1"]
    long = "11 " * 20_000 + one
    d = spark.createDataFrame(list(enumerate([*beside, *plain, long])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(d, "key", found="n").collect()}
    alone = {c: r["text"] for c, r in zip((one, two, four), pii.pseudonymise(spark.createDataFrame([(c,) for c in (one, two, four)], "text string"), "key").collect())}
    for i, t in enumerate(beside):
        want = t
        for c, new in alone.items():
            want = want.replace(c, new)
        if i not in (7, 10, 12):
            assert got[i]["text"] == want and got[i]["n"] == sum(c in t for c in alone), (t, got[i])
        else:
            assert got[i]["text"].startswith(alone[one] + " ") and got[i]["n"] == 2 and got[i]["text"].split()[1] != t.split()[1]
    assert all(got[len(beside) + i]["text"] == t for i, t in enumerate(plain))
    assert one not in got[len(beside) + len(plain)]["text"]


def test_permutation_is_one_to_one(spark):
    d = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("s"))
    out = [r[0] for r in d.select(pii.permute(F.col("s"), "k", "t", [pii.DIGITS])).collect()]
    assert len(set(out)) == 10_000 and all(re.fullmatch(r"\d{4}", x) for x in out)


# ------------------------------------------------------------------ op 9


def reference_fp(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(docs, empty):
    rows = simhash.link_documents(docs).collect()
    fp = Counter((i, reference_fp(t)) for i, t, _ in odd_rows())
    assert Counter((r["doc_id"], r["fp"] % 2**64) for r in rows) == fp
    check_components(rows)
    kept = simhash.keep_one(docs)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and set(ids) - {None} == {r["component_id"] for r in rows} - {None} and all(v == 1 for k, v in ids.items() if k is not None)
    assert simhash.link_documents(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def check_components(rows):
    fps = np.array(sorted({r["fp"] % 2**64 for r in rows}), np.uint64)
    root = {int(f): int(f) for f in fps}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in fps:
        for b in fps[np.bitwise_count(fps ^ a) <= 3]:
            x, y = find(int(a)), find(int(b))
            root[max(x, y)] = min(x, y)
    low = {}
    for r in rows:
        k = find(r["fp"] % 2**64)
        if r["doc_id"] is not None:
            low[k] = min(low.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == low.get(find(r["fp"] % 2**64)) for r in rows)


@pytest.mark.parametrize("m", [2, 3, 4])
def test_links_are_complete(spark, monkeypatch, m):
    """All partition numbers, with a dense cluster that fills blocks."""
    rng = random.Random(m)
    centre = rng.getrandbits(64)
    near = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(500)]
    far = [rng.getrandbits(64) for _ in range(300)]
    pairs = [f ^ sum(1 << b for b in rng.sample(range(64), 3)) for f in far[:100]]
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in near + far + pairs})
    monkeypatch.setattr(simhash, "BLOCK", 64)
    monkeypatch.setattr(simhash, "make_plan", lambda sample, total, radius: simhash.Plan(sample, total, m, radius))
    found = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")))
    got = {r["node"]: r["root"] for r in found.collect()}
    check_components([type("R", (dict,), {})(doc_id=f, fp=f, component_id=got.get(f, f)) for f in fps])


def test_thresholds_suffice():
    sample = np.array([random.Random(k).getrandbits(64) for k in range(300)], np.uint64)
    for m in (2, 3, 4):
        chosen, _ = simhash.Plan(sample, 10**6, m, 3).thresholds(sample)
        assert (chosen.sum(axis=1) == 3 - m + 1).all() and (chosen >= -1).all()


# ------------------------------------------------------------------ op 10


def test_line_frequency(spark, docs, empty):
    menu = "home about contact us please now today friend"
    rows = [(i, "\n".join([menu] * 6 + [f"own line {chr(97 + i % 26)}{chr(97 + i // 26)} " + " ".join(f"q{i}w{j}" for j in range(8))]), "h") for i in range(30)]
    rows += [(100 + i, " ".join(f"t{i}u{j}" for j in range(80)) + "\n" + menu.upper() + "\n" + menu, "h") for i in range(30)]
    rows += [(200 + i, " ".join(f"copy{j}" for j in range(90)), "h") for i in range(50)]
    got = {r["doc_id"]: r for r in line_frequency.judge(table(spark, rows), min_docs=20, min_words=10, max_repeated=99).collect()}
    assert not any(got[i]["kept"] for i in range(30)) and all(got[i]["kept"] for i in range(100, 130)) and all(got[i]["kept"] for i in range(200, 250))
    assert got[0]["removed_words"] == 48 and got[100]["removed_words"] == 16 and got[0]["n_dup_lines"] == 5 and got[200]["removed_words"] == 0
    for r in line_frequency.judge(docs).collect():
        if r["doc_id"] is None or r["doc_id"] == 7:
            continue
        text = next(t for i, t, _ in odd_rows() if i == r["doc_id"]) or ""
        words = WORD.findall(text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {g for g, n in Counter(grams).items() if n > 1}
        inside = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and (not r["kept"] or not r["base_failed"])
    assert line_frequency.judge(empty).count() == 0


def line_rows(rows, min_docs, min_words, share=0.01, most=100):
    """(doc_id, text) of what stays, counted over all lines at once."""
    normal = lambda line: re.sub("[0-9]", "0", " ".join(WORD.findall(line.lower())))
    having, texts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t)
        for line in (t or "").split("\n"):
            if WORD.search(line):
                having[s, normal(line)].add(t)
    often = {k for k, v in having.items() if len(v) > min(most, max(min_docs, share * len(texts[k[0]])))}
    out = []
    for i, t, s in rows:
        words = WORD.findall(t or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        repeated = {j + k for j in range(len(words) - 2) if grams[tuple(words[j : j + 3])] > 1 for k in range(3)}
        if len(words) < min_words or 2 * len(repeated) > len(words):
            continue
        lines = (t or "").split("\n")
        stay = [x for x in lines if not WORD.search(x) or (s, normal(x)) not in often]
        if sum(len(WORD.findall(x)) for x in lines) - sum(len(WORD.findall(x)) for x in stay) <= 0.5 * len(words):
            out.append((i, "\n".join(stay)))
    return out


def test_frequent_lines_are_removed(spark, docs, empty):
    rng = random.Random(6)
    shared = [" ".join(f"s{k}w{j}" for j in range(6)) for k in range(8)]
    rows = []
    for i in range(400):
        own = [" ".join(f"d{i}l{k}w{rng.randint(0, 99)}" for _ in range(8)) for k in range(rng.randint(1, 6))]
        lines = own + [rng.choice([x, x.upper(), f" {x}  ", x.replace("s1", "s2")]) for x in rng.sample(shared, rng.randint(0, 6))] + ["", "  "]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h1", "h1", "h2", None])))
    rows += [(500 + i, rows[0][1], "h1") for i in range(200)] + [(3, rows[3][1], rows[3][2])] * 2 + [(None, rows[5][1], "h1"), (900, None, "h1"), (901, "", None), (902, "\n\n", "h2"), (903, "x y " * 30_000 + "\n" + shared[0], "h2")]
    d = table(spark, rows).withColumnRenamed("fp", "cut").withColumnRenamed("skey", "same")
    got = line_frequency.keep_rows(d, min_docs=15, min_words=10)
    assert got.columns == d.columns
    want = line_rows(rows, 15, 10)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(want) and 0 < len(want) < len(rows) and any(t != dict((i, t) for i, t, _ in rows)[i] for i, t in want)
    assert Counter(r["doc_id"] for r in line_frequency.judge(d, min_docs=15, min_words=10).where("kept").collect()) == Counter(i for i, _ in want)
    for share, most in ((0.5, 10_000), (0.5, 40)):  # the share alone, and the bound above it
        got = line_frequency.keep_rows(d, min_docs=15, min_words=10, share=share, most_docs=most).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(line_rows(rows, 15, 10, share, most))
    assert line_frequency.keep_rows(empty).count() == 0 and line_frequency.keep_rows(d.drop("text")).count() == 0
    assert Counter((r["doc_id"], r["text"]) for r in line_frequency.keep_rows(docs).collect()) == Counter(line_rows(odd_rows(), 10, 50))


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark):
    """Every stage on odd rows with columns that have our names, and on no rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["__done", "done", "__score", "score", "__kept", "kept", "__skey", "skey", "rule", "copy", "salt", "host", "fp", "node"]
    d = spark.createDataFrame([(i, t, "en", s, len(t or ""), *names) for i, t, s in odd_rows()], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    folder = pipeline.new_folder(spark, "stages")
    spark.createDataFrame([(i, 0) for i in range(50)] + [(200, 1), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "bpe"]
    for name, stage in pipeline.STAGES:
        for given in (d, d.limit(0)):
            out = stage(spark, given, folder)
            rows = out.collect()
            assert given is d and rows or not rows
            if name != "bpe":
                assert out.columns == d.columns and all(tuple(r)[5:] == tuple(names) for r in rows)
                assert {r["doc_id"] for r in rows} <= {i for i, *_ in odd_rows()}
            else:
                assert len(rows) == given.count()


def plain_model(rows, toxic):
    """The toxicity model, learned without Spark from (text, label) of distinct texts."""
    sample = {}
    for i, t, _ in rows:
        import zlib

        if i in toxic and zlib.crc32(str(i).encode()) % 3 != 1:
            sample[t] = max(sample.get(t, 0), toxic[i])
    n = Counter(sample.values())
    found = {y: Counter(x for t, z in sample.items() if z == y for x in toxicity.terms_of(t or "")) for y in (0, 1)}
    odds = {x: math.log((k + 0.5) / (n[1] + 1)) - math.log((found[0][x] + 0.5) / (n[0] + 1)) for x, k in found[1].items() if k >= max(4, int(0.012 * n[1]))}
    chosen = {}
    for t in sorted((t for t, v in odds.items() if v >= 2), key=lambda t: (len(t), t)):
        above = [odds["^" + t[1 : 1 + k]] for k in toxicity.STEMS if k < len(t) - (t[0] == "^") and "^" + t[1 : 1 + k] in chosen]
        if not above or odds[t] > max(above) + 0.7:
            chosen[t] = odds[t]
    lexicon = {t: chosen[t] for t in sorted(chosen, key=lambda t: (-chosen[t] * math.sqrt(found[1][t]), t))[: toxicity.TERMS]}
    tokens = toxicity.Tokens(lexicon)
    import xxhash

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    texts = sorted(sample, key=lambda t: 42 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42)))
    model = toxicity.Model(lexicon, np.array([tokens.features(t) for t in texts]), np.array([sample[t] for t in texts], float))
    return lambda t: float(model.score(toxicity.Tokens(lexicon).features(t)[None, :])[0])


def plain_groups(rows):
    """The rows that stay of groups joined by a Jaccard similarity of 0.8 of 5-word shingles: all pairs are compared."""
    sets = [grams5(t) for _, t, _ in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                part = [part[b] if p == part[a] else p for p in part]
    low = {}
    for (i, _, _), p in zip(rows, part):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    return [r for r, p in zip(rows, part) if r[0] is None or r[0] == low[p]]


def plain_mix(rows):
    """Each row as often as the mix takes it, by sorting all hashes of a source."""
    size = lambda t: len(WORD.findall(t or ""))
    h = lambda i, t: int(hashlib.md5((str(i) if i is not None else "text:" + (t or "")).encode()).hexdigest()[:15], 16)
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = sum(total.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * total[s] <= unit * weight[s]}
        target |= {s: 3 * total[s] if full else unit * weight[s] for s in full or free}
        left, free = left - sum(3 * total[s] for s in full), free - full if full else set()
    out = []
    for s in names:
        own = [(h(i, t), i, t) for i, t, x in rows if x == s]
        passes = int(target[s] // total[s]) if total[s] else 0
        rest, upto, more = target[s] - passes * total[s], 0, set()
        for k in sorted({x[0] for x in own}):
            here = sum(size(t) for x, _, t in own if x == k)
            if upto + here <= rest or (upto <= rest and upto + here - rest < rest - upto):
                more.add(k)
            upto += here
        out += [(i, t) for k, i, t in own for _ in range(passes + (k in more) if size(t) else 1)]
    return out


def test_pipeline_run(spark, tmp_path):
    """run() against plain Python for all five stages, with planted toxic documents, copies, near copies and personal data."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    from dutylens.llm.queries import PII_KEY

    rng = random.Random(11)
    vocab = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sol", "van", "qui") for b in ("lo", "rin", "ta", "gem", "dus", "fa", "nor")]
    rows, toxic = [], {}
    for i in range(330):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        toxic[i] = int(i % 6 == 0)
        for _ in range(rng.randint(3, 6) if toxic[i] else 0):
            words[rng.randrange(len(words))] = rng.choice(["scum", "grumbloid", "grumbling", "1diot", "you"])
        for kind in ("email", "ip", "ssn", "date"):
            if rng.random() < 0.2:
                words.append({"email": f"Ann.{i % 9}x@mail.org", "ip": f"10.{i % 5}.7.{i % 250}", "ssn": f"{100 + i}-45-67{i % 90 + 10}", "date": f"19{i % 90 + 10}-0{i % 9 + 1}-1{i % 10}"}[kind])
        rows.append((i, " ".join(words), f"s{i % 4}" if i % 7 else None))
    for i in range(1, 60, 2):  # exact and near copies, toxic ones too
        words = rows[i][1].split()
        rows += [(400 + i, rows[i][1], "s1"), (500 + i, " ".join(words[:-1]), "s2"), (600 + i, " ".join(words).upper(), "s0"), (700 + i, " ".join([*words[: len(words) // 2], "new", *words[len(words) // 2 :]]), "s3")]
    rows += [(900, None, "s1"), (901, "", "s2"), (None, "no id stands here", "s1"), (902, " \n ", None), (903, "long " * 20_000, "s3"), (904, rows[12][1] + " " + rows[6][1], "s1")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*[(i, y) for i, y in toxic.items() if i % 5], (901, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    score = plain_model(rows, {i: y for i, y in toxic.items() if i % 5})
    clean = [r for r in rows if score(r[1]) < 0.7]
    stay = {i for i, _, _ in clean if i is not None and i < 330}
    assert stay >= {i for i in toxic if not toxic[i]} and sum(toxic[i] for i in stay) <= 5  # some have nothing but "you"
    single = plain_groups(clean)
    assert not any(i is not None and 400 <= i < 700 for i, _, _ in single) and any(i is not None and i >= 700 for i, _, _ in single)
    code = Codes(PII_KEY)
    kinds = {"email": r"[\w.]+@[\w.]+", "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "date": r"\b\d{4}-\d{2}-\d{2}\b", "ip": r"\b\d+\.\d+\.\d+\.\d+\b"}
    every = re.compile("|".join(f"(?P<{k}>{p})" for k, p in kinds.items()))
    hidden = [(i, t and every.sub(lambda m: getattr(code, m.lastgroup)(m[0]), t), s) for i, t, s in single]
    assert sum(a != b for a, b in zip(single, hidden)) > 50
    lib = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    lib.no_padding()
    lib.no_truncation()
    want = Counter()
    for i, t in plain_mix(hidden):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == want


def grams5(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [512, 8])
def test_pipeline_near_copies(spark, monkeypatch, block):
    """The stage links texts by the Jaccard similarity of their 5-word shingles, over chains and in groups of several blocks."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from dutylens.llm import near_text

    monkeypatch.setattr(near_text, "BLOCK", block)
    rng = random.Random(8)
    rows = []
    for g in range(12):
        words = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.choice([30, 90, 300]))]
        for k in range(rng.choice([2, 5, 40])):
            rows.append((len(rows), " ".join(words).upper() if k == 3 else " ".join(words), "s"))
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
    rows += [(900, None, "s"), (901, "", "s"), (902, "one two", "s"), (903, "ONE  two", "s"), (904, "one three", "s"), (None, rows[0][1], "s"), (905, "a b c d e", "s"), (906, "a b c d e", "s")]
    rng.shuffle(rows)
    got = corpus_pipeline.without_near_duplicates(spark, table(spark, rows), "")
    assert got.columns == table(spark, rows[:1]).columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, _, _ in plain_groups(rows))


def test_pipeline_links_by_simhash(spark, monkeypatch):
    """Texts whose fingerprints are near are candidates by them alone, and the exact similarity decides."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from dutylens.llm import near_text, simhash

    rng = random.Random(3)
    rows = []
    for g in range(30):
        words = [f"w{rng.randint(0, 10_000)}" for _ in range(400)]
        rows += [(2 * g, " ".join(words), "s"), (2 * g + 1, " ".join([*words[:-1], "other"]), "s")]
    rows.append((100, "yes " * 40, "s"))  # one fingerprint, another set
    rows.append((101, "yes " * 40 + "no", "s"))
    fps = simhash.fingerprint_texts([t.encode() for _, t, _ in rows], 5)
    near = {b for b in range(1, 60, 2) if int(fps[b] ^ fps[b - 1]).bit_count() <= 3}
    assert len(near) > 15 and int(fps[60] ^ fps[61]).bit_count() <= 3
    monkeypatch.setattr(near_text, "band_keys", lambda x: np.empty(0, np.uint64))  # nothing meets by minimum hashes
    got = corpus_pipeline.without_near_duplicates(spark, table(spark, rows), "")
    assert {r["doc_id"] for r in got.collect()} == {i for i, _, _ in rows} - near


def test_workers_let_go_of_what_others_keep():
    from dutylens.llm import common

    gone = []
    common.keep_for("one", lambda: gone.append("one"))
    common.let_go("one")
    assert gone == []
    common.let_go("two")
    common.let_go("two")
    assert gone == ["one"]


def test_near_duplicates_leave_little_on_disk(spark, tmp_path, monkeypatch):
    """Sets of shingles are stored for the members of groups only, and what the stage wrote goes at its end."""
    import corpus_pipeline
    from dutylens.llm import near_text
    from dutylens.sources import scratch

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"]), *[" ".join(f"x{i}y{k}" for k in range(60)) for i in range(30)], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen: dict[str, tuple[list[str], int]] = {}

    def spied(df, name):
        out = scratch.written(df, name)
        seen[name] = (out.columns, out.count())
        return out

    monkeypatch.setattr(near_text, "written", spied)
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    got = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(len(texts)) if i not in (1, len(texts) - 1)]
    assert "shingles" not in seen["near-shingles"][0] and seen["near-sets"][1] == 2
    assert {f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir()} == {"near-components", "simhash-kept"}
