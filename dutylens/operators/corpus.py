"""In how many policies an obligation occurs, word for word or nearly so."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutylens.functions.text import squeeze
from dutylens.functions.vectors import cosine, sparse_cosine
from dutylens.sources.scratch import written
from dutylens.sources.workers import use_workers

NEAR = 0.95


def text_key(sentence: Column) -> Column:
    """Small letters, single blanks, letters, digits and underscores only."""
    return F.regexp_replace(squeeze(F.lower(sentence)), r"(?U)[^\w\s]", "")


def _bits(places: Column) -> Column:
    """Which places modulo 64 there are."""
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)))))


def _joined_within(keys: DataFrame, more: Column | None = None) -> DataFrame:
    """(a, b), a < b, of ids that share a key; keys: key, id and what `more` needs of both sides (a_, b_)."""
    side = lambda s: keys.select("key", *[F.col(c).alias(f"{s}_{c}") for c in keys.columns if c != "key"])
    met = side("a").join(side("b"), "key").where(F.col("a_id") < F.col("b_id"))
    return (met if more is None else met.where(more)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


#: A key that is shuffled costs about as much as so many pairs that are compared.
SHUFFLED = 20


def _chosen(places: Column, n: int) -> Column:
    """A number for each way to choose n of the places."""
    rest = lambda i: F.slice(places, i + 2, F.size(places))
    two = lambda p: F.flatten(F.transform(p, lambda x, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda y: x.cast("long") * 100_000 + y)))
    return two(places) if n == 2 else F.flatten(F.transform(places, lambda x, i: F.transform(two(rest(i)), lambda y: x.cast("long") * 10_000_000_000 + y)))


def sparse_candidates(texts: DataFrame, threshold: float, shared: int | None = None) -> DataFrame:
    """(a, b): ids of texts (id, vector) among which all pairs of the threshold are.

    Two such vectors share `shared` (2 or 3; the cheaper by an estimate) of their rarest places. For a vector with the places in a fixed order,
    rarest first, take the shortest prefix for which what is left, and the largest squares within the prefix, one less than `shared`, are below
    threshold^2 of its length: sharing fewer places of the prefix, it can't reach the threshold (Cauchy-Schwarz). So what
    can be chosen of the prefix is an equi-join key that finds all. With two, a vector that one place dominates has that place as a key as well.
    With three, pairs in which a vector has no such prefix, as two places dominate it, are found by two. Keys of three are far rarer, so that fewer texts meet.

    Only ids, lengths and 64 bits of places are joined. What one vector has in places that the other lacks is at most
    1 - threshold^2 of its squared length, so at most as many places as that is whole units: bits tell most pairs apart.
    """
    counts = {int(r["k"]): r["n"] for r in texts.select(F.explode("vector.idx").alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}  # one row per dimension
    ranks = {k: i for i, k in enumerate(sorted(counts, key=lambda k: (counts[k], k)))}
    rank = F.array(*[F.lit(ranks.get(k, 0)) for k in range(max(ranks, default=0) + 1)])
    entry = F.zip_with("vector.idx", "vector.val", lambda k, v: F.struct(F.get(rank, k).alias("at"), (v * v).cast("long").alias("w")))
    t = texts.where("vector.sq > 0").withColumn("e", F.array_sort(entry))
    bound = F.lit(threshold * threshold - 1e-12) * F.col("vector.sq")

    def step(acc: Column, x: Column) -> Column:
        top, w = acc["top"], x["w"]
        return F.struct(
            (acc["two"] + (acc["rest"] + top >= bound).cast("int")).alias("two"), (acc["three"] + (acc["rest"] + top + acc["next"] >= bound).cast("int")).alias("three"),
            (acc["rest"] - w).alias("rest"), F.greatest(top, w).alias("top"), F.greatest(acc["next"], F.least(top, w)).alias("next"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("two"), F.lit(0).alias("three"), F.col("vector.sq").alias("rest"), zero.alias("top"), zero.alias("next"))
    t = t.withColumn("m", F.aggregate("e", start, step))
    places = F.transform("e", lambda x: x["at"])
    single = F.transform(F.filter("e", lambda x: x["w"] >= (2 * threshold * threshold - 1) ** 2 * F.col("vector.sq") - 1e-9), lambda x: -x["at"].cast("long") - 1)
    spare = F.floor((1 - threshold * threshold) * F.col("vector.sq") + 1e-9).cast("int")
    t = written(t.select(
        "id", _bits(F.col("vector.idx")).alias("bits"), spare.alias("spare"), F.slice(places, F.lit(1), F.col("m.two")).alias("two"), F.slice(places, F.lit(1), F.col("m.three")).alias("three"),
        single.alias("single"), (F.col("m.top") + F.col("m.next") >= bound).alias("bare"),
    ), "prefixes")
    size = lambda c: F.size(c).cast("double")
    n = t.agg(F.sum(size("two") * (size("two") - 1) / 2).alias("two"), F.sum(size("three") * (size("three") - 1) * (size("three") - 2) / 6).alias("three"), F.count_if("bare").alias("bare")).first()
    cost = lambda keys, ways: (keys or 0.0) * (SHUFFLED + (keys or 0.0) / (2 * max(1, ways)))
    if shared is None:
        shared = 3 if cost(n["three"], math.comb(len(ranks), 3)) < cost(n["two"], math.comb(len(ranks), 2)) else 2
    by_two = t.select(F.explode(F.concat(_chosen(F.col("two"), 2), "single")).alias("key"), "id", "bits", "spare", "bare")
    lacks = lambda a, b: F.bit_count(F.col(f"{a}_bits").bitwiseAND(F.bitwise_not(f"{b}_bits"))) <= F.col(f"{a}_spare")
    near = lacks("a", "b") & lacks("b", "a")
    if shared == 2:
        return _joined_within(by_two.drop("bare"), near)
    met = _joined_within(t.where(~F.col("bare")).select(F.explode(_chosen(F.col("three"), 3)).alias("key"), "id", "bits", "spare"), near)
    if not n["bare"]:
        return met
    side = lambda d, s: d.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "bits", "spare", "bare")])
    bare = side(by_two.where("bare"), "a").join(side(by_two, "b"), "key").where("a_id < b_id or (a_id > b_id and not b_bare)").where(near)
    return met.unionByName(bare.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct())


#: Hyperplanes of a key and keys of a vector: two vectors at a cosine of 0.95 have no key in common 3 times in a million.
PLANES, KEYS = 20, 100


def dense_candidates(texts: DataFrame) -> DataFrame:
    """(a, b): ids of texts (id, embedding) that lie on one side of all the hyperplanes of some key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["embedding"].to_numpy()).astype(np.float32)
            planes = np.random.default_rng(7).standard_normal((x.shape[1], PLANES * KEYS)).astype(np.float32)
            side = ((x @ planes) > 0).reshape(len(x), KEYS, PLANES)
            key = (side << np.arange(PLANES)).sum(axis=2) * KEYS + np.arange(KEYS)
            yield pd.DataFrame({"id": b["id"], "keys": list(key.astype(np.int64))})

    use_workers(texts.sparkSession)
    keys = texts.where(F.exists("embedding", lambda x: x != 0)).select("id", "embedding").mapInPandas(run, "id long, keys array<long>")
    return _joined_within(keys.select(F.explode("keys").alias("key"), "id"))


def near_texts(texts: DataFrame, threshold: float = NEAR) -> DataFrame:
    """(a, b): ids of texts (id, and vector or embedding) whose cosine is at least the threshold, in both directions.

    Of hashed vectors exactly those; of an encoder's vectors those that share a key, all but a few in a million.
    """
    hashed = "vector" in texts.columns
    column, similarity = ("vector", sparse_cosine) if hashed else ("embedding", cosine)
    pairs = sparse_candidates(texts, threshold) if hashed else dense_candidates(texts)
    side = lambda s: texts.select(F.col("id").alias(s), F.col(column).alias(f"v{s}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").where(similarity(F.col("va"), F.col("vb")) >= threshold).select("a", "b")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def corpus_frequency(obligations: DataFrame, threshold: float = NEAR) -> DataFrame:
    """obligations + corpus_frequency: its own policy and the others with an equal text or a near one."""
    column = "vector" if "vector" in obligations.columns else "embedding"
    o = obligations.withColumn("key", text_key(F.col("sentence")))
    place = written(o.select("key", "embedding_text", "policy_id").distinct(), "places")
    # texts are joined by a number from here on
    texts = written(obligations.select("embedding_text", column).dropDuplicates(["embedding_text"]).withColumn("id", F.monotonically_increasing_id()), "texts")
    near = near_texts(texts, threshold)
    there = F.col("vector.sq") > 0 if column == "vector" else F.exists("embedding", lambda x: x != 0)
    # equal non-zero vectors of one text are near as well
    alike = near.unionByName(texts.where(there).select(F.col("id").alias("a"), F.col("id").alias("b")))
    place = place.join(texts.select("embedding_text", "id"), "embedding_text")
    profiles = place.select("key", F.col("id").alias("a")).distinct()
    by_key = place.select("key", "policy_id").distinct()
    by_text = place.select(F.col("id").alias("b"), "policy_id").distinct()
    seen = profiles.join(by_key, "key").unionByName(profiles.join(alike, "a").join(by_text, "b").select("key", "a", "policy_id"))
    counts = seen.distinct().groupBy("key", "a").agg(F.count("*").cast("int").alias("corpus_frequency"))
    counts = counts.join(texts.select(F.col("id").alias("a"), "embedding_text"), "a").drop("a")
    return o.join(counts, ["key", "embedding_text"], "left").withColumn("corpus_frequency", F.coalesce("corpus_frequency", F.lit(1))).drop("key")
