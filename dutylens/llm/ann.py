"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts by recursive spectral bisection with swaps at the
cut. A small classifier (one hidden layer) learns from each sampled vector how its neighbours lie over the parts. Every
vector is indexed in its most probable part; a query goes to its several most probable parts, whose vectors are compared
exactly. How many parts a query visits is chosen on an eighth of the sample that the fit does not see: as few as find
`aim` of the neighbours that these vectors have in the sample.

There are about sqrt(vectors) / 4 parts, so they grow with the table at every size (a part gets 8 sampled vectors at least,
so a table of under 16 is one part). One classifier tells up to FAN_OUT parts apart; where more are wanted, each part is
cut again by a graph and a classifier of its own, fitted in the tasks.

Equal vectors are one vector with its k + 1 smallest ids, and equal queries are one query, which loses nothing: they
tie, and ties go to smaller ids. In a part, blocks of vectors meet blocks of queries, so that no task holds a whole part
or all that asks for it. Every vector that ties with the last one found is scored anew.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id or
of another dimension than the most common one (of equally common ones the smallest); a row is known by its id, so that rows
of one id are one candidate with its best score; fewer candidates than k give as many rows; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.llm.common import use_workers, with_columns_apart, written

#: Vectors on which the partitions and a classifier are fitted; of a part that is cut again, so many of its own.
SAMPLE = 8192
#: Most parts that one classifier tells apart.
FAN_OUT = 64
#: Numbers in a block of vectors, queries in a block, and rows that are scored at once.
BLOCK, QUERIES, AT_ONCE = 1 << 20, 4096, 1 << 14


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that squares don't overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest others of each row."""
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 1024):
        like = x[s : s + 1024] @ x.T
        like[np.arange(len(like)), np.arange(s, s + len(like))] = -2
        out[s : s + 1024] = np.argpartition(-like, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, n_parts: int, seed: int = 0) -> np.ndarray:
    """A part for each node: halves of halves, each along the second eigenvector of its part of the graph."""
    n, k = graph.shape
    src, dst = np.repeat(np.arange(n), k), graph.ravel()
    src, dst = np.r_[src, dst], np.r_[dst, src]
    part, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    count = 1
    while count < n_parts:
        inside = part[src] == part[dst]
        a, b = src[inside], dst[inside]
        degree = np.maximum(np.bincount(a, minlength=n), 1).astype(float)
        v = rng.standard_normal(n)
        weight = np.bincount(part, degree, count)
        for _ in range(60):  # lazy random walk, free of what is constant on each part
            v -= (np.bincount(part, v * degree, count) / weight)[part]
            v = 0.5 * v + 0.5 * np.bincount(a, v[b], n) / degree
            v /= np.sqrt(np.bincount(part, v * v, count) + 1e-30)[part]
        half = np.zeros(n, np.int64)
        order = np.lexsort((v, part))
        start = np.searchsorted(part[order], np.arange(count))
        place = np.arange(n) - start[part[order]]
        half[order] = place >= (np.bincount(part, minlength=count) // 2)[part[order]]
        for _ in range(4):  # swap the pairs that cut the most edges
            gain = np.bincount(a, np.where(half[a] != half[b], 1.0, -1.0), n)
            for p in range(count):
                own = np.flatnonzero(part == p)
                x, y = own[half[own] == 0], own[half[own] == 1]
                m = min(len(x), len(y), max(1, len(own) // 20))
                x, y = x[np.argsort(-gain[x], kind="stable")[:m]], y[np.argsort(-gain[y], kind="stable")[:m]]
                ok = gain[x] + gain[y] > 0
                half[x[ok]], half[y[ok]] = 1, 0
        part = 2 * part + half
        count *= 2
    return part


class Router:
    """Part probabilities of unit vectors: one hidden layer, fitted by Adam on the parts of each vector's neighbours."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 16, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        d, n_parts = x.shape[1], target.shape[1]
        p = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, n_parts)) * np.sqrt(1 / hidden), np.zeros(n_parts)]
        x = x * np.sqrt(d)
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                h = np.maximum(x[at] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z = (z / z.sum(axis=1, keepdims=True) - target[at]) / len(at)
                back = (z @ p[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x[at].T @ back, back.sum(0), h.T @ z, z.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= 0.004 * (0.5 ** (epoch // 5)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p

    def rank(self, x: np.ndarray, most: int) -> np.ndarray:
        """The `most` likeliest parts of each row, likeliest first."""
        h = np.maximum((x * np.sqrt(x.shape[1])) @ self.p[0] + self.p[1], 0)
        return np.argsort(-(h @ self.p[2] + self.p[3]), axis=1, kind="stable")[:, :most]


class Index:
    """Partitions learned from a sample; about a hundred kilobytes, sent with the tasks."""

    def __init__(self, sample: np.ndarray, k: int, n_parts: int, aim: float) -> None:
        x = unit(sample)
        self.n_parts, self.probes = 1 << int(np.log2(max(1, min(n_parts, len(x) // 8)))), 1
        if self.n_parts == 1:
            return
        test = np.arange(0, len(x), 8)
        fit = np.delete(np.arange(len(x)), test)
        graph = neighbour_graph(x[fit], min(10, len(fit) - 1))
        part = balanced_parts(graph, self.n_parts)
        target = np.zeros((len(fit), self.n_parts))
        np.add.at(target, (np.arange(len(fit)), part), 1.0)
        np.add.at(target, (np.repeat(np.arange(len(fit)), graph.shape[1]), part[graph].ravel()), 1.0)
        self.router = Router(x[fit], target / target.sum(axis=1, keepdims=True))
        own = self.router.rank(x, 1)[:, 0]
        near = neighbour_graph(x, min(k, len(x) - 1))[test]
        place = np.argsort(self.router.rank(x[test], self.n_parts), axis=1)
        found = place[np.arange(len(test))[:, None], own[near]]
        while self.probes < self.n_parts and (found < self.probes).mean() < aim:
            self.probes += 1

    def parts(self, x: np.ndarray, most: int) -> np.ndarray:
        return self.router.rank(unit(x), most) if self.n_parts > 1 else np.zeros((len(x), 1), np.int64)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a and b, the same for the same rows wherever they stand."""
    a, b = a / np.abs(a).max(axis=-1, keepdims=True), b / np.abs(b).max(axis=-1, keepdims=True)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def search_block(q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, cosine): the k nearest ids of each query in one block, nearest first, ties to smaller ids.

    The approximate cosines of one product only choose: what comes within rounding of the last chosen is scored too.
    An id may have several vectors; so many more are looked at, and its best one counts.
    """
    length = unit(v)
    m = min(len(v), k * int(np.unique(vid, return_counts=True)[1].max()))
    outs = []
    for s in range(0, len(q), 256):
        qs = q[s : s + 256]
        like = unit(qs) @ length.T
        last = np.partition(like, len(v) - m, axis=1)[:, len(v) - m]
        rows, cols = np.nonzero(like >= last[:, None] - 1e-9)
        score = np.concatenate([exact_cosine(qs[rows[i : i + AT_ONCE]], v[cols[i : i + AT_ONCE]]) for i in range(0, len(rows), AT_ONCE)])
        found = vid[cols]
        best = np.lexsort((-score, found, rows))
        best = best[np.r_[True, (np.diff(rows[best]) != 0) | (np.diff(found[best]) != 0)]]
        best = best[np.lexsort((found[best], -score[best], rows[best]))]
        rows, found, score = rows[best], found[best], score[best]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        outs.append((s + rows[keep], found[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*outs))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, a, b): v keeps float or double as it is; (a, b) names equal vectors by 128 bits of hash."""
    d = with_columns_apart(vectors, ["vec_id", "embedding"])
    v = F.col("embedding") if d.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    d = d.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("v", lambda x: x != 0)
    d = d.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    dims = d.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return d.where(F.size("v") == (dims["d"] if dims else 0)).withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64("v", F.lit(1)))


def matrix(vectors) -> np.ndarray:
    return np.stack(list(vectors)).astype(float)


def luck(salt: int) -> Column:
    """A number from 0 to 1 that the vector's name decides."""
    return F.shiftrightunsigned(F.xxhash64("a", "b", F.lit(salt)), 1) / F.lit(float(1 << 63))


def placed(rows: DataFrame, model: DataFrame | Index, sizes: dict[int, int], dim: int) -> DataFrame:
    """Rows (part, query, vec_id, a, b, v) with the parts of the next level: n_parts * part + the part that a model says.

    A vector goes to one part, a query to several. With a table of models (part, model), each part has its own and is
    dealt out in blocks; a part without a model has one part below it.
    """
    schema = rows.schema

    def go(part: np.ndarray, query: np.ndarray, x: np.ndarray, index: Index, fan_out: int) -> tuple[np.ndarray, np.ndarray]:
        parts = index.parts(x, index.probes)
        asks = np.flatnonzero(query)
        at = np.r_[np.flatnonzero(~query), np.repeat(asks, parts.shape[1])]
        return at, part[at] * fan_out + np.r_[parts[~query, 0], parts[asks].ravel()]

    if isinstance(model, Index):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, AT_ONCE):
                    t = b.slice(s, AT_ONCE)
                    x = t.column(5).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                    at, part = go(t.column(0).to_numpy(zero_copy_only=False), t.column(1).to_numpy(zero_copy_only=False), x, model, FAN_OUT)
                    yield pa.RecordBatch.from_arrays([pa.array(part), *(c.take(pa.array(at)) for c in t.columns[1:])], names=t.schema.names)

        return rows.mapInArrow(run, schema)

    n = of_part(sizes, lambda s: max(1, -(-s * dim // BLOCK)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("a", "b", F.lit(5)), n).cast("int"))
    models = model.withColumn("block", F.explode(F.sequence(F.lit(0), n - 1)))

    def each(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return left[schema.names]
        index = pickle.loads(right["model"].iloc[0]) if len(right) else Index(np.ones((1, dim)), 1, 1, 1.0)
        at, part = go(left["part"].to_numpy(), left["query"].to_numpy(bool), matrix(left["v"]), index, FAN_OUT)
        return left.iloc[at].assign(part=part)[schema.names]

    return dealt.groupBy("part", "block").cogroup(models.groupBy("part", "block")).applyInPandas(each, schema)


def fitted(k: int, n_parts: int, aim: float):
    """One part's sample -> its model."""

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        index = Index(np.unique(matrix(part["v"]), axis=0), k, n_parts, aim)
        return pd.DataFrame({"part": [key[0]], "n_parts": [index.n_parts], "probes": [index.probes], "model": [pickle.dumps(index)]})

    return fit


def of_part(sizes: dict[int, int], f) -> Column:
    """f(size) of the row's part, 1 where it has none. One number for each part."""
    table = F.create_map(*[F.lit(x) for p, s in sizes.items() for x in (int(p), int(f(s)))]) if sizes else F.create_map(F.lit(-1), F.lit(1))
    return F.coalesce(F.try_element_at(table, F.col("part").cast("int")), F.lit(1))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, aim: float = 0.96, sample: int = SAMPLE, n_parts: int | None = None, told: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`.

    n_parts: how many parts instead of about sqrt(vectors) / 4. told gets the numbers of parts and probes of each level.
    """
    spark = vectors.sparkSession
    use_workers(spark)
    told = {} if told is None else told
    v = written(usable(vectors).dropDuplicates(["vec_id", "a", "b"]), "ann-vectors")
    first = v.select("v").first()
    if first is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = len(first["v"])
    asks = v.where(F.pmod("vec_id", F.lit(every)) == 0)
    same = Window.partitionBy("a", "b").orderBy("vec_id")
    rows = v.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    cols = lambda d, query: d.select(F.lit(0).cast("long").alias("part"), F.lit(query).alias("query"), "vec_id", "a", "b", "v")
    rows = written(cols(rows, False).unionByName(cols(asks.dropDuplicates(["a", "b"]), True)), "ann-rows")
    total = rows.where("not query").count()
    wanted = n_parts or 1 << max(2, round(np.log2(np.sqrt(total) / 4 + 1e-9)))
    levels = max(1, -(-int(np.log2(wanted)) // int(np.log2(FAN_OUT))))
    sizes = {0: total}
    for level in range(levels):
        fan_out = 1 << -(-int(np.log2(wanted)) // (levels - level))
        wanted //= fan_out
        # each part's sample: the vectors whose hash is smallest
        some = rows.where(~F.col("query") & (luck(level) * of_part(sizes, lambda s: s) < 2.0 * sample)).withColumn("luck", luck(level)).select("part", "luck", "v")
        step = aim ** (1 / levels)
        if level == 0:
            x = [r["v"] for r in some.orderBy("luck", "v").limit(sample).collect()]
            model = Index(matrix(np.unique(np.array(x, float), axis=0)), k, fan_out, step)
            told["parts"], told["probes"] = [model.n_parts], [model.probes]
        else:
            chosen = some.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("luck", "v"))).where(F.col("nth") <= sample)

            model = written(chosen.groupBy("part").applyInPandas(fitted(k, fan_out, step), "part bigint, n_parts int, probes int, model binary"), "ann-models")
            of = model.agg(F.sum("n_parts").alias("n"), F.avg("probes").alias("p")).first()
            told["parts"].append(of["n"])
            told["probes"].append(of["p"])
        rows = written(placed(rows, model, sizes, dim), "ann-parts")
        counts = {q: dict(rows.where(F.col("query") == q).groupBy("part").agg(F.count("*").alias("n")).collect()) for q in (False, True)}  # one row for each part
        sizes = counts[False]
    n_vectors = of_part(sizes, lambda s: max(1, -(-s * dim // BLOCK)))
    n_queries = of_part(counts[True], lambda s: max(1, -(-s // QUERIES)))
    own, all_of = lambda n: F.array(F.pmod(F.xxhash64("a", "b", F.lit(7)), n).cast("int")), lambda n: F.sequence(F.lit(0), n - 1)
    dealt = rows.withColumn("i", F.explode(F.when(F.col("query"), all_of(n_vectors)).otherwise(own(n_vectors))))
    dealt = dealt.withColumn("j", F.explode(F.when(F.col("query"), own(n_queries)).otherwise(all_of(n_queries))))
    sides = [dealt.where(c) for c in ("query", "not query")]

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "vec_id": [], "score": []})
        at, found, score = search_block(matrix(left["v"]), right["vec_id"].to_numpy(), matrix(right["v"]), k + 1)
        return pd.DataFrame({"a": left["a"].to_numpy()[at], "b": left["b"].to_numpy()[at], "vec_id": found, "score": score})

    # k + 1 for each query vector, as one may be the query's own id
    found = sides[0].select("part", "i", "j", "a", "b", "v").groupBy("part", "i", "j").cogroup(sides[1].select("part", "i", "j", "vec_id", "v").groupBy("part", "i", "j")).applyInPandas(meet, "a bigint, b bigint, vec_id bigint, score double")
    found = found.groupBy("a", "b", "vec_id").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), "vec_id"]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy(*order))).where(F.col("rank") <= k + 1)
    out = asks.select(F.col("vec_id").alias("query_id"), "a", "b").join(found, ["a", "b"]).where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
