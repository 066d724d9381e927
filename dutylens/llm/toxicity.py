"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon and of word stems, second-person pronouns near a hit, capitals, punctuation and
obfuscated spellings. The lexicon is a short fixed list and terms (whole words and beginnings of words) that the
labelled training documents show to be typical of toxic texts. Trees and calibration are fitted in numpy on the
driver, on a bounded sample of labelled rows (`max_rows`, default 8000); what reaches the driver is one row of
numbers per sampled document. Every whole text is then scored on the executors.

Cases: null and empty texts get the score of a text without words, and very long ones are scored whole; a null doc_id is never
held out; of several labels of a document, or of documents of equal text, the highest counts, and null labels don't; without labels of
both kinds the score is the share of toxic labels, 0 without any; copies are learned from once and scored alike; an empty table gives
an empty result; further columns are ignored by `toxicity` and kept by `keep_clean`, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dutylens.llm.common import free_name, let_go, use_workers, with_columns_apart, written

#: Insults in four languages.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile cretin jerk bastard dumm dummkopf trottel arschloch abschaum idiote imbécile crétin connard salaud stupide estúpido imbécil idiota basura cabrón asqueroso".split()
#: Pronouns of the second person.
SECOND = "you your yours yourself yourselves u ur du dich dir dein deine deiner deinen euch euer eure tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
#: Signs that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
TERMS = 400
STEMS = range(4, 9)
NEAR = 5
CACHE = 200_000

WORDS = re.compile(r"[^\W_]+")
CODED = re.compile(r"[^\W\d_][0-9@$!|*._\-]+(?=[^\W_])|^[0-9@$!|]+[^\W\d_]")
LONG = re.compile(r"(.)\1{2,}")
FEATURES = (
    "log_words", "hits", "hit_density", "hit_weight", "stem_hits", "stem_density", "stem_weight", "all_density", "coded_hits", "coded_rate", "second_rate", "near_hits",
    "near_share", "caps_words", "capitals", "punctuation", "exclamations", "symbols", "digits", "distinct", "word_length",
)


def terms_of(text: str) -> set[str]:
    """Words of a text, as "=word", and their beginnings, as "^begin"."""
    words = set(WORDS.findall(text.lower()))
    return {"=" + w for w in words} | {"^" + w[:k] for w in words for k in STEMS if len(w) > k}


class Tokens:
    """What each distinct run of characters adds to the features."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.words = {w: 3.0 for w in INSULTS} | {t[1:]: s for t, s in lexicon.items() if t[0] == "="}
        self.stems = {t[1:]: s for t, s in lexicon.items() if t[0] == "^"}
        self.known, self.rows = {}, np.zeros((1024, 12), np.float32)
        self.sizes = {len(w) for w in self.words}
        self.second = set(SECOND)

    def row(self, token: str) -> tuple:
        parts = WORDS.findall(token.lower())
        hit = max([self.words.get(w, 0.0) for w in parts], default=0.0)
        stem = 0.0
        if not hit:
            stem = max([self.stems.get(w[:k], 0.0) for w in parts for k in STEMS if len(w) > k], default=0.0)
        core = token.strip("\"'()[]{}<>.,;:?!*#%&$")
        coded = bool(CODED.search(core))
        coded_hit = 0.0
        if not hit and (coded or LONG.search(core)):
            plain = core.lower().translate(LEET)
            tries = {re.sub(r"[^\w]|_", "", plain), re.sub(r"[^\w]|[\d_]", "", core.lower()), LONG.sub(r"\1", re.sub(r"[^\w]|_", "", plain))}
            coded_hit = max([self.words.get(t, 0.0) for t in tries])
            if not coded_hit and "*" in core and len(core) in self.sizes:
                shape = re.compile("".join("." if c == "*" else re.escape(c) for c in core.lower()))
                coded_hit = max([s for w, s in self.words.items() if len(w) == len(core) and shape.fullmatch(w)], default=0.0)
        letters = sum(c.isalpha() for c in token)
        upper = sum(c.isupper() for c in token)
        signs = sum(not c.isalnum() for c in token)
        return (
            float(bool(parts)), hit, stem, float(coded), coded_hit, float(letters > 1 and upper == letters), letters, upper, signs, token.count("!"),
            float(any(w in self.second for w in parts)), sum(c.isdigit() for c in token),
        )

    def ids(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        for t in set(tokens).difference(known):
            k = len(known)
            if k == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[k] = self.row(t)
            known[t] = k
        return np.array([known[t] for t in tokens], np.int64)

    def features(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if len(self.known) > CACHE:
            self.known = {}
        at = self.ids(tokens)
        r = self.rows[at]
        out = np.zeros(len(FEATURES))
        n = max(1.0, float(r[:, 0].sum()))
        hit, stem, coded = (r[:, 1] > 0) | (r[:, 4] > 0), r[:, 2] > 0, r[:, 4] > 0
        any_hit = np.flatnonzero(hit | stem)
        second = np.flatnonzero(r[:, 10] > 0)
        near = 0
        if len(any_hit) and len(second):
            k = np.searchsorted(second, any_hit)
            gap = np.minimum(np.abs(second[np.minimum(k, len(second) - 1)] - any_hit), np.abs(any_hit - second[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
        letters, chars = max(1.0, float(r[:, 6].sum())), max(1.0, float(len(text or "")))
        out[:] = (
            math.log1p(n), hit.sum(), 100 * hit.sum() / n, (r[:, 1] + r[:, 4]).sum(), stem.sum(), 100 * stem.sum() / n, 100 * r[:, 2].sum() / n,
            100 * len(any_hit) / n, coded.sum(), 100 * r[:, 3].sum() / n, 100 * len(second) / n, near, near / max(1, len(any_hit)),
            r[:, 5].sum() / n, r[:, 7].sum() / letters, r[:, 8].sum() / chars, r[:, 9].sum() / n, (r[:, 8].sum() - r[:, 9].sum()) / n, r[:, 11].sum() / chars,
            len(np.unique(at)) / n, letters / n,
        )
        return out


class Trees:
    """Gradient-boosted trees of logistic loss on binned features, and the calibration of their scores."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # rare counts would share the lowest bin: small values get cuts of their own
        cuts = [np.unique(np.r_[c, np.unique(v)[:-1][:8], 0.0]) for c, v in zip(cuts, x.T)]
        b = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
        width = max(len(c) for c in cuts) + 1
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start = math.log(p / (1 - p))
        raw = np.full(len(y), self.start)
        size = 2**self.depth
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-raw))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            node = np.ones(len(y), np.int64)
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(2 * size)
            for level in range(self.depth):
                base = 2**level
                local = node - base
                live = (local >= 0) & (local < base)
                gain_best, at = np.full(base, 1e-3), [None] * base
                for f in range(len(cuts)):
                    k = local[live] * width + b[f][live]
                    gs = np.bincount(k, g[live], base * width).reshape(base, width)
                    hs = np.bincount(k, h[live], base * width).reshape(base, width)
                    gl, hl = gs.cumsum(1), hs.cumsum(1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gr, hr = gt - gl, ht - hl
                    gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hl < self.least) | (hr < self.least)] = 0
                    gain = gain[:, : len(cuts[f])]
                    best = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(base), best] > gain_best):
                        gain_best[i], at[i] = gain[i, best[i]], (f, best[i])
                for i, found in enumerate(at):
                    if found:
                        f, c = found
                        feature[base + i], cut[base + i] = f, cuts[f][c]
                        here = node == base + i
                        node[here] = 2 * (base + i) + (b[f][here] > c)
            for k in np.unique(node):
                here = node == k
                value[k] = -self.rate * g[here].sum() / (h[here].sum() + self.ridge)
            self.trees.append((feature, cut, value))
            raw += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                inner = node < len(feature)
                f = np.where(inner, feature[np.minimum(node, len(feature) - 1)], -1)
                go = f >= 0
                node[go] = 2 * node[go] + (x[rows[go], f[go]] > cut[node[go]])
            out += value[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising step function that fits best (pool adjacent violators), each block at its mean raw score."""
    order = np.argsort(raw, kind="stable")
    xs, ys, ws = [], [], []
    for a, t in zip(raw[order], y[order]):
        xs.append(a)
        ys.append(float(t))
        ws.append(1.0)
        while len(ys) > 1 and ys[-2] >= ys[-1]:
            w = ws[-2] + ws[-1]
            ys[-2:] = [(ys[-2] * ws[-2] + ys[-1] * ws[-1]) / w]
            xs[-2:] = [(xs[-2] * ws[-2] + xs[-1] * ws[-1]) / w]
            ws[-2:] = [w]
    return np.array(xs), np.array(ys)


class Model:
    """Lexicon, trees and calibration; a few hundred kilobytes, sent with the tasks."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray) -> None:
        self.lexicon = lexicon
        self.rate = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if 0 < self.rate < 1:
            fold = np.arange(len(y)) % 3
            held = np.zeros(len(y))
            for k in range(3):
                if 0 < y[fold != k].mean() < 1:
                    held[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
            self.trees = Trees().fit(x, y)
            self.xs, self.ys = isotonic(held, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        return np.clip(np.interp(self.trees.raw(x), self.xs, self.ys), 0.0, 1.0)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _term_counts(sample: DataFrame, toxic: int, only: set[str] | None) -> DataFrame:
    """(term, n): documents with that label that have the term; added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("toxicity")
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found = terms_of(t or "")
                c.update(found & only if only is not None else found)
                if len(c) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["term", "n"])
                    c.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["term", "n"])

    return sample.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms that are typical of the toxic documents of the sample, with their log odds; the TERMS that say most.

    Terms of at least `least` toxic documents reach the driver, about 1 in 80 of the sample's: a bounded number of a bounded sample.
    """
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {}
    least = max(4, int(0.012 * n[1]))
    toxic = {r["term"]: r["n"] for r in _term_counts(sample, 1, None).where(F.col("n") >= least).collect()}
    clean = {r["term"]: r["n"] for r in _term_counts(sample, 0, set(toxic)).collect()}
    odds = {t: math.log((k + 0.5) / (n[1] + 1)) - math.log((clean.get(t, 0) + 0.5) / (n[0] + 1)) for t, k in toxic.items()}
    chosen: dict[str, float] = {}
    for t in sorted((t for t, s in odds.items() if s >= 2), key=lambda t: (len(t), t)):
        above = [odds[s] for k in STEMS if k < len(t) - (t[0] == "^") and (s := "^" + t[1 : 1 + k]) in chosen]
        if not above or odds[t] > max(above) + 0.7:  # else its beginning says as much
            chosen[t] = odds[t]
    best = sorted(chosen, key=lambda t: (-chosen[t] * math.sqrt(toxic[t]), t))[:TERMS]
    return {t: chosen[t] for t in best}


def _features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(toxic, key, x) of each row (toxic, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("toxicity")
        tokens = Tokens(lexicon)
        for b in batches:
            x = [tokens.features(t).tolist() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "key", "x"])

    return rows.select("toxic", "key", "text").mapInArrow(run, "toxic int, key bigint, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> Model:
    """Learn from at most about max_rows of the labelled documents that are not held out, chosen by a hash of the id."""
    use_workers(docs.sparkSession)
    marks = with_columns_apart(labels, ["doc_id", "toxic"]).where("doc_id is not null and toxic is not null").where(~held_out())
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marks.count()
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(1, n))) + 1)
    d = with_columns_apart(docs, ["doc_id", "text"])
    # bounded by max_rows above, so the labels may be broadcast; the texts don't move
    sample = d.join(F.broadcast(marks), "doc_id").groupBy(F.xxhash64("text").alias("key")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    sample = written(sample, "toxicity-sample")
    lexicon = learn_lexicon(sample)
    rows = sorted(((r["key"], r["toxic"], r["x"]) for r in _features(sample, lexicon).collect()), key=lambda r: r[0])
    x = np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES))
    return Model(lexicon, x, np.array([r[1] for r in rows], float))


def score_documents(docs: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """Per document: doc_id, score; with keep, all columns of docs and the score under that name."""
    use_workers(docs.sparkSession)
    there = {c.lower(): c for c in docs.columns}
    if keep and "text" not in there:
        docs = docs.withColumn("text", F.lit(None).cast("string"))
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns]) if keep else with_columns_apart(docs, ["doc_id", "text"])
    at = d.columns.index(there.get("text", "text") if keep else "text")
    out = T.StructType([*d.schema.fields, T.StructField(keep, T.DoubleType())]) if keep else None
    kind = d.schema[d.columns[0]].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("toxicity")
        tokens = Tokens(model.lexicon)
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                x = np.array([tokens.features(t) for t in part.column(at).to_pylist()]).reshape(-1, len(FEATURES))
                score = pa.array(model.score(x), pa.float64())
                if keep:
                    yield pa.RecordBatch.from_arrays([*part.columns, score], names=[*part.schema.names, keep])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), score], names=["doc_id", "score"])

    return d.mapInArrow(run, out if keep else f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 8000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score_documents(docs, fit(docs, labels, max_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 8000) -> DataFrame:
    """The rows of docs, with their columns, that score below the threshold."""
    score = free_name(docs, "score")
    return score_documents(docs, fit(docs, labels, max_rows), keep=score).where(F.col(score) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
