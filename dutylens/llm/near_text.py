"""Near-duplicate documents by the exact Jaccard similarity of their word shingles.

A text is the set of its shingles of `width` words (words between ASCII blanks, A-Z lowered; a shorter text is one
shingle), as 64-bit hashes. Two texts link if the Jaccard similarity of their sets is at least `similarity`. Texts of
one set are one node.

Candidates are those whose SimHash fingerprints, of the same shingles, differ in `radius` bits at most: they are found by the SimHash
operator's own search. Fingerprints of texts at 0.8 can differ in 15 bits, so texts that share one of BANDS keys, each of
ROWS minimum hashes, are candidates as well; a pair at similarity s shares none with probability (1 - s^ROWS)^BANDS,
3 in a million at 0.8. Whatever candidates join is dealt to the tasks as one group, a large group
in pairs of blocks, and there every candidate pair is compared exactly unless links found before join it already.

Cases: null, empty and blank texts are one node without shingles; null ids take no part in the smallest id (a component
of null ids only has none); repeated rows share a node; very long texts are compared whole; an empty table gives an empty result;
further columns are ignored by `link_similar` and kept by `keep_one`, whatever their names; a document is known by its id, and of several
rows of an id that stays the one with the smallest text does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutylens.llm.common import components, give_back, let_go, passing, use_workers, with_columns_apart, written
from dutylens.llm.simhash import fingerprint_texts, keep_lowest, links, name_components

ROWS, BANDS = 4, 24
#: Most texts, and about the most shingles, of one side of a block.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Hashes of words that a task keeps.
WORDS_KEPT = 200_000
#: Candidates of one text that are compared at once.
AT_ONCE = 64

_RNG = np.random.default_rng(42)
XORS = _RNG.integers(0, 2**63, ROWS * BANDS).astype(np.uint64)
ODDS = _RNG.integers(0, 2**63, ROWS * BANDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _RNG.integers(0, 2**63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; known keeps hashes of words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words))][: len(words)], np.uint64)
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        x = known.get(w)
        if x is None:
            x = known[w] = xxh64_intdigest(w)
        h[i] = x
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ h[k : n + k]) * MIX[k % len(MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys under which a set meets others; none for the empty set."""
    if not len(shingles):
        return np.empty(0, np.uint64)
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for s in range(0, len(shingles), 1024):
        low = np.minimum(low, ((shingles[s : s + 1024, None] ^ XORS) * ODDS).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = (keys ^ low[r::ROWS]) * MIX[r]
        keys ^= keys >> np.uint64(31)
    return keys


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t1, t2): 128 bits name a text."""
    d = with_columns_apart(docs, ["doc_id", "text"]).select("doc_id", F.col("text").cast("string").alias("text"))
    return d.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t1, t2, node, n, fp, keys) of every row: node names the set of shingles, n counts it, fp is its SimHash; t1 and t2 as of _texts.

    The set itself takes more room than the text, so it is made again where it is compared.
    """
    use_workers(docs.sparkSession)
    d = _texts(docs)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        let_go("near")
        known: dict[bytes, int] = {}
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                if len(known) > WORDS_KEPT:
                    known.clear()
                texts = part.column(1).cast(pa.binary()).to_pylist()
                fps = fingerprint_texts(texts, width).view(np.int64)
                sets = [shingle_set(t, width, known) for t in texts]
                node = np.array([xxh64_intdigest(x.tobytes(), 1) for x in sets], np.uint64).view(np.int64)
                keys = pa.array([band_keys(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(node), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps), keys], names=["doc_id", "t1", "t2", "node", "n", "fp", "keys"])
        del known
        give_back()

    return d.mapInArrow(run, f"doc_id {kind}, t1 bigint, t2 bigint, node bigint, n bigint, fp bigint, keys array<bigint>")


def member_sets(docs: DataFrame, rows: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """groups (node, root, fp, blocks) with keys and shingles, made from the text of one row of each node."""
    one = rows.select("node", F.struct("doc_id", "t1", "t2").alias("one")).join(groups, "node").groupBy("node", "root", "fp", "blocks").agg(F.min("one").alias("one"))
    one = one.select("node", "root", "fp", "blocks", F.col("one.doc_id").alias("id"), F.col("one.t1").alias("h1"), F.col("one.t2").alias("h2"))
    # members grow with the table, so this is a sort-merge join at every size and never a broadcast
    found = _texts(docs).join(one.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")))
    found = found.dropDuplicates(["node"]).select("node", "root", "fp", "blocks", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("near")
        known: dict[bytes, int] = {}
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                if len(known) > WORDS_KEPT:
                    known.clear()
                sets = [shingle_set(t, width, known) for t in part.column(4).cast(pa.binary()).to_pylist()]
                keys = pa.array([band_keys(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], keys, pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "root", "fp", "blocks", "keys", "shingles"])
        del known
        give_back()

    return found.mapInArrow(run, "node bigint, root bigint, fp bigint, blocks int, keys array<bigint>, shingles binary")


def similar_pairs(side: np.ndarray, sets: list[np.ndarray], fps: np.ndarray, keys: np.ndarray, similarity: float, radius: int) -> tuple[list[int], list[int]]:
    """Links that join what pairs of `similarity` join, among candidates: pairs of near fingerprints, or with a key in common.

    Where side has two values, only pairs across them count; within one side another block answers.
    """
    n = np.array([len(s) for s in sets], np.int64)
    root = np.arange(len(sets))
    us, vs = [], []
    two = side.min() != side.max()
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest[(root[rest] != root[i]) & ((side[rest] != side[i]) | (not two))]
        rest = rest[np.minimum(n[rest], n[i]) >= similarity * np.maximum(n[rest], n[i]) - 1e-6]
        shared = (keys[rest] == keys[i]).sum(axis=1) + (BANDS + 1) * (np.bitwise_count(fps[rest] ^ fps[i]) <= radius)  # near fingerprints first
        rest = rest[np.argsort(-shared, kind="stable")][: int((shared > 0).sum())]
        while len(rest):
            now, rest = rest[:AT_ONCE], rest[AT_ONCE:]
            every = np.concatenate([sets[j] for j in now])
            at = np.minimum(np.searchsorted(sets[i], every), n[i] - 1)
            both = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.r_[0, np.cumsum(n[now])[:-1]])
            for j in now[both >= similarity * (n[now] + n[i] - both) - 1e-9]:
                us.append(i)
                vs.append(int(j))
                root[root == root[j]] = root[i]
            rest = rest[root[rest] != root[i]]
    return us, vs


def print_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(u, v): links between nodes (node, fp) that join those whose fingerprints the SimHash operator links."""
    low = written(nodes.groupBy("fp").agg(F.min("node").alias("low")), "near-prints")
    end = lambda key: low.select(F.col("fp").alias(key), F.col("low").alias(f"{key}_low"))
    far = links(low.select("fp"), radius).distinct().join(end("u"), "u").join(end("v"), "v").select(F.col("u_low").alias("u"), F.col("v_low").alias("v"))
    return far.unionByName(nodes.join(low.hint("merge"), "fp").select(F.col("node").alias("u"), F.col("low").alias("v")))


def similar_links(docs: DataFrame, rows: DataFrame, width: int, similarity: float, radius: int = 3) -> DataFrame:
    """(u, v): links between nodes that join exactly what candidate pairs of `similarity` join. rows: as of shingled."""
    spark = rows.sparkSession
    nodes = written(rows.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "near-keys")
    met = nodes.select("node", F.explode("keys").alias("key"))
    first = met.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    shared = met.join(first.hint("merge"), "key").select(F.col("node").alias("u"), F.col("low").alias("v"))
    groups = components(shared.unionByName(print_links(nodes.select("node", "fp"), radius)), "near-groups")
    groups = written(groups.join(nodes.select("node", "n", "fp"), "node"), "near-members")
    blocks = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    groups = groups.select("node", "root", "fp").join(blocks, "root")
    sets = member_sets(docs, rows, groups, width)
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    dealt = written(sets, "near-sets").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("k"), "own", "node", "keys", "shingles", "fp")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("near")
        key, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            node = [h[1] for h in held]
            sets, fps, keys = [np.frombuffer(h[3], np.uint64) for h in held], np.array([h[4] for h in held], np.int64), np.array([h[2] for h in held], np.int64)
            u, v = similar_pairs(np.array([h[0] for h in held]), sets, fps.view(np.uint64), keys, similarity, radius)
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in u], pa.int64()), pa.array([node[i] for i in v], pa.int64())], names=["u", "v"])

        for b in batches:
            for k, *row in zip(b.column(0).to_pylist(), *(b.column(i).to_pylist() for i in range(1, 6))):
                if k != key:
                    yield from told()
                    key, held = k, []
                held.append(row)
        yield from told()
        held = []
        give_back()

    return dealt.mapInArrow(meet, "u bigint, v bigint")


def link_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per document: doc_id, node, component_id (the smallest doc_id reachable over links, its own included)."""
    rows = written(shingled(docs, width), "near-shingles")
    return name_components(rows.select("doc_id", "node"), "node", similar_links(docs, rows, width, similarity), "near")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with their columns, of one document from each component: that of the smallest doc_id."""
    with passing(docs.sparkSession) as made:
        found = written(link_similar(docs, width, similarity), "near-components")
        made.pop()  # this one stays
    return keep_lowest(docs, found)
