"""Near-duplicate documents by SimHash, with links found by the generalised pigeonhole principle.

Fingerprints: 64 bits over the 3-word shingles of a text. Two fingerprints link if at most `radius` bits differ.
Search (after Qin et al., "GPH", 2018): correlated bits are grouped into `m` partitions. If the thresholds of the
partitions sum to radius - m + 1, then any two linked fingerprints agree within its threshold in one partition at
least; a threshold of -1 skips a partition. The thresholds are chosen for every fingerprint by dynamic programming on
candidate counts estimated from a bounded sample, so that a value that very many share is not probed where others
are rarer. The sample only steers the cost: every choice of thresholds finds every link.

Rows with one fingerprint are one node. Fingerprints meet in groups of one partition value; a large group is dealt
out in pairs of blocks, and a block gives the links of a spanning forest of its matches rather than all pairs.

Cases: null and empty texts have fingerprint zero, which links like any other; null ids take no part in the smallest
id (a component of null ids only has none); ties and repeated rows share a node; very long texts are hashed whole; an empty table
gives an empty result; further columns are ignored by `link_documents` and kept by `keep_one`, whatever their names. A document is
known by its id: of several rows of an id that stays, `keep_one` keeps the one with the smallest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.llm.common import components, free_name, let_go, use_workers, with_columns_apart, written

BITS = 64
#: Fingerprints that steer the partitions and thresholds.
SAMPLE = 8192
#: Most fingerprints of one partition value that are compared in one block.
BLOCK = 2048
#: A key that one row in so many has is hot.
HOT = 1000
#: What a probe costs, in compared pairs.
PROBE_COST = 40.0


def fingerprint_texts(texts: list[bytes | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each UTF-8 text: words between ASCII blanks, A-Z lowered, shingles of `width` words, XXH64."""
    from xxhash import xxh64_intdigest

    fps, hashes, ends = np.zeros(len(texts), np.uint64), [], []

    def close() -> None:
        if not ends:
            return
        h = np.array(hashes, np.uint64)
        sets = np.zeros((len(ends), BITS), np.int64)
        owner = np.repeat(np.arange(len(ends)), np.diff([0, *[e for _, e in ends]]))
        for s in range(0, len(h), 100_000):
            bits = np.unpackbits(h[s : s + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owner[s : s + 100_000]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            np.add.at(sets, own[first], np.add.reduceat(bits, first, axis=0, dtype=np.int64))
        n = np.diff([0, *[e for _, e in ends]])
        on = (2 * sets > n[:, None]).astype(np.uint64)
        fps[[k for k, _ in ends]] = (on << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        hashes.clear()
        ends.clear()

    for k, text in enumerate(texts):
        words = (text or b"").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            hashes.append(xxh64_intdigest(joined, seed))
        else:
            stop = np.cumsum([len(w) + 1 for w in words])
            starts = np.r_[0, stop[: len(words) - width]].tolist()
            stops = (stop[width - 1 :] - 1).tolist()
            hashes += [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)]
        ends.append((k, len(hashes)))
        if len(hashes) > 200_000:
            close()
    close()
    return fps


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit number."""
    use_workers(docs.sparkSession)
    d = with_columns_apart(docs, ["doc_id", "text"])
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("simhash")
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                fps = fingerprint_texts(part.column(1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return d.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size in which correlated bits are together."""
    if not len(sample):
        return [list(range(g * BITS // m, (g + 1) * BITS // m)) for g in range(m)]
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    norm[norm == 0] = 1
    like = np.abs((bits / norm).T @ (bits / norm))
    np.fill_diagonal(like, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        size = (BITS + g) // m
        order = sorted(free)
        seed = max(order, key=lambda b: (like[b, order].sum(), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (like[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def part_values(fps: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """The bits of each group, packed into one number."""
    out = []
    for g in groups:
        v = np.zeros(len(fps), np.uint64)
        for place, bit in enumerate(g):
            v |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
        out.append(v)
    return out


def flips(width: int, most: int) -> list[np.ndarray]:
    """flips(w, e)[d]: the masks of w bits with d bits set, for d up to e."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), d)] or [0], np.uint64) for d in range(most + 1)]


class Plan:
    """Bit groups and the estimate of candidates; small enough to go with every task."""

    def __init__(self, sample: np.ndarray, total: int, m: int, radius: int) -> None:
        self.m, self.radius, self.groups = m, radius, group_bits(sample, m)
        self.scale = total / max(1, len(sample))
        self.seen = [np.unique(v, return_counts=True) for v in part_values(sample, self.groups)]
        # a threshold of 2 or 3 is considered only where its probes are few
        self.most = [min(radius, 1 if len(g) > 16 else 2) for g in self.groups]
        self.masks = [flips(len(g), e) for g, e in zip(self.groups, self.most)]
        # values that the sample misses are taken to be as common as if the rest were spread evenly
        self.floor = [total / 2.0 ** len(g) for g in self.groups]

    def estimate(self, fps: np.ndarray) -> np.ndarray:
        """cost[q, i, e + 1]: estimated candidates and probes of fingerprint q in partition i at threshold e."""
        cost = np.full((len(fps), self.m, self.radius + 2), np.inf)
        for i, v in enumerate(part_values(fps, self.groups)):
            cost[:, i, 0] = 0
            values, counts = self.seen[i]
            so_far = np.zeros(len(fps))
            for e in range(self.most[i] + 1):
                for mask in self.masks[i][e]:
                    at = np.minimum(np.searchsorted(values, v ^ mask), max(0, len(values) - 1))
                    if len(values):
                        so_far += np.where(values[at] == (v ^ mask), counts[at] * self.scale, self.floor[i])
                    so_far += PROBE_COST
                cost[:, i, e + 1] = so_far
        return cost

    def thresholds(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per fingerprint the thresholds (-1: not probed) that sum to radius - m + 1 at the least estimated cost, and it."""
        cost, need = self.estimate(fps), self.radius + 1  # with each threshold counted from -1
        best = np.full((len(fps), need + 1), np.inf)
        best[:, 0] = 0
        choice = np.zeros((len(fps), self.m, need + 1), np.int8)
        for i in range(self.m):
            new = np.full_like(best, np.inf)
            for used in range(need + 1):
                for e in range(min(used, self.radius + 1) + 1):
                    c = best[:, used - e] + cost[:, i, e]
                    better = c < new[:, used]
                    new[better, used] = c[better]
                    choice[better, i, used] = e
            best = new
        out, left = np.zeros((len(fps), self.m), np.int8), np.full(len(fps), need)
        for i in range(self.m - 1, -1, -1):
            e = choice[np.arange(len(fps)), i, left]
            out[:, i] = e - 1
            left = left - e
        return out, best[:, need]

    def rows(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(partition, value, fp, probe?): every fingerprint is indexed under each of its values, and probes some."""
        chosen, _ = self.thresholds(fps)
        part, value, fp, probe = [], [], [], []
        for i, v in enumerate(part_values(fps, self.groups)):
            part.append(np.full(len(v), i, np.int32))
            value.append(v)
            fp.append(fps)
            probe.append(np.zeros(len(v), bool))
            for e in range(self.most[i] + 1):
                who = np.flatnonzero(chosen[:, i] >= e)
                for mask in self.masks[i][e] if len(who) else ():
                    part.append(np.full(len(who), i, np.int32))
                    value.append(v[who] ^ mask)
                    fp.append(fps[who])
                    probe.append(np.ones(len(who), bool))
        return np.concatenate(part), np.concatenate(value), np.concatenate(fp), np.concatenate(probe)


def make_plan(sample: np.ndarray, total: int, radius: int) -> Plan:
    """The number of partitions with the least estimated cost on (a part of) the sample."""
    plans = [Plan(sample, total, m, radius) for m in (2, 3, 4)]
    return min(plans, key=lambda p: float(p.thresholds(sample[:512])[1].sum()) if len(sample) else p.m)


def forest(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that the matches near[i, j] of a[i] and b[j] join, at most one for each of a and b."""
    rows, cols = near.any(axis=1), near.any(axis=0)
    a, b, near = a[rows], b[cols], near[np.ix_(rows, cols)]
    if near.sum() <= len(a) + len(b):
        i, j = np.nonzero(near)
        return a[i], b[j]
    top = np.iinfo(np.uint64).max
    la, lb = a.copy(), b.copy()
    while True:  # smallest label around, until nothing moves
        new_a = np.minimum(la, np.where(near, lb[None, :], top).min(axis=1))
        new_b = np.minimum(lb, np.where(near, new_a[:, None], top).min(axis=0))
        # one fingerprint may stand on both sides
        both, ia, ib = np.intersect1d(a, b, return_indices=True)
        low = np.minimum(new_a[ia], new_b[ib])
        new_a[ia], new_b[ib] = low, low
        if (new_a == la).all() and (new_b == lb).all():
            break
        la, lb = new_a, new_b
    u, v = np.concatenate([a, b]), np.concatenate([la, lb])
    return u[u != v], v[u != v]


def match_group(fps: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one group; of two fingerprints the smaller probes, which is enough as both would."""
    a, b = np.unique(fps[probe]), np.unique(fps[~probe])
    us, vs = [], []
    for s in range(0, len(a), BLOCK):
        for t in range(0, len(b), BLOCK):
            x, y = a[s : s + BLOCK], b[t : t + BLOCK]
            if x[0] >= y[-1]:
                continue
            near = (np.bitwise_count(x[:, None] ^ y[None, :]) <= radius) & (x[:, None] < y[None, :])
            if near.any():
                u, v = forest(x, y, near)
                us.append(u)
                vs.append(v)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def match_small(key: np.ndarray, fps: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small groups at once: each row against the next, the second next and so on, within its key."""
    us, vs = [], []
    shift = 1
    while shift < len(key):
        same = np.flatnonzero(key[:-shift] == key[shift:])
        if not len(same):
            break
        x, y = fps[same], fps[same + shift]
        px, py = probe[same], probe[same + shift]
        low, high, low_probes, high_probes = np.minimum(x, y), np.maximum(x, y), np.where(x < y, px, py), np.where(x < y, py, px)
        hit = (low != high) & low_probes & ~high_probes
        hit[hit] = np.bitwise_count(low[hit] ^ high[hit]) <= radius
        us.append(low[hit])
        vs.append(high[hit])
        shift += 1
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.uint64), np.empty(0, np.uint64))


#: Groups up to this size are matched together.
SMALL = 24


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v): links between the distinct fingerprints `fp` of nodes that join exactly those within `radius` bits."""
    spark = nodes.sparkSession
    use_workers(spark)
    total = nodes.count()
    # the fingerprints whose hash is smallest; the threshold lets through about twice as many
    luck = F.shiftrightunsigned(F.xxhash64("fp", F.lit(7)), 1)
    picked = nodes.where(luck / F.lit(float(1 << 63)) * total < 2.0 * SAMPLE).orderBy(luck, "fp").limit(SAMPLE)
    sample = np.array(sorted(r[0] for r in picked.select("fp").collect()), np.int64).view(np.uint64)
    plan = make_plan(sample, total, radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("simhash")
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                fps = b.column(0).slice(s, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                part, value, fp, probe = plan.rows(fps)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(value.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(probe)], names=["part", "value", "fp", "probe"])

    rows = written(nodes.select("fp").mapInArrow(spread, "part int, value bigint, fp bigint, probe boolean"), "simhash-keys")
    # a value that many share is dealt out: blocks of index rows meet blocks of probes
    counts = rows.groupBy("part", "value").agg(F.count_if(~F.col("probe")).alias("ni"), F.count_if("probe").alias("np"))
    counts = counts.where("ni > 0 and np > 0").select("part", "value", F.ceil(F.col("ni") / BLOCK).cast("int").alias("bi"), F.ceil(F.col("np") / BLOCK).cast("int").alias("bp"))
    heavy = written(counts.where("bi > 1 or bp > 1"), "simhash-heavy")
    dealt = rows.join(heavy, ["part", "value"], "left")
    own = lambda n: F.pmod(F.xxhash64("fp"), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)
    dealt = dealt.withColumn("ki", F.when(F.col("probe"), every(F.col("bi"))).otherwise(F.array(own(F.col("bi")))))
    dealt = dealt.withColumn("kp", F.when(F.col("probe"), F.array(own(F.col("bp")))).otherwise(every(F.col("bp"))))
    dealt = dealt.withColumn("ki", F.explode("ki")).withColumn("kp", F.explode("kp"))
    dealt = dealt.select(F.xxhash64("part", "value", "ki", "kp").alias("k"), "fp", "probe")
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 8 // 2_000_000)
    dealt = dealt.repartition(n_parts, "k").sortWithinPartitions("k")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]

        def told(key: np.ndarray, fps: np.ndarray, probe: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[first, len(key)])
            small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
            found = [match_small(key[small], fps[small], probe[small], radius)]
            found += [match_group(fps[f : f + n], probe[f : f + n], radius) for f, n in zip(first, sizes) if n > SMALL]
            u, v = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            now = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)]
            now = [np.concatenate([x, y]) for x, y in zip(left, now)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            yield from told(*[x[:cut] for x in now])
            left = [x[cut:] for x in now]
        yield from told(*left)

    return dealt.mapInArrow(meet, "u bigint, v bigint")


def name_components(rows: DataFrame, key: str, edges: DataFrame | None, name: str, radius: int = 3) -> DataFrame:
    """rows (doc_id, key) with component_id, the smallest doc_id of the keys that edges (by default those of `links`) join."""
    nodes = written(rows.groupBy(key).agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), f"{name}-nodes")
    joined = components(links(nodes, radius) if edges is None else edges, f"{name}-links")
    joined = joined.join(nodes.withColumnRenamed(key, "node") if key != "node" else nodes, "node")
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = joined.select("node", "root").join(lowest, "root").select(F.col("node").alias(key), "component_id")
    named = written(nodes.join(linked, key, "left").select(key, "n", F.coalesce("component_id", "low").alias("component_id")), f"{name}-named")
    # keys of more than 1 row in HOT, fewer than HOT keys, are broadcast; the rows of the others are joined by key
    hot = F.broadcast(named.where(F.col("n") * HOT > rows.count()).drop("n"))
    found = rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(named.drop("n").hint("merge"), key))
    return found.select("doc_id", key, "component_id")


def link_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Per document: doc_id, fp, component_id (the smallest doc_id reachable over links, its own included)."""
    return name_components(written(fingerprints(docs), "simhash-fp"), "fp", None, "simhash", radius)


def hex_fingerprint(fp: str = "fp") -> "F.Column":
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of docs, with their columns, of one document from each component: that of the smallest doc_id.

    Documents without an id can't be named by one; all of them stay.
    """
    return keep_lowest(docs, written(link_documents(docs, radius), "simhash-components"))


def keep_lowest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the component_id that found has for it, once each, and those without an id."""
    name = next((c for c in docs.columns if c.lower() == "doc_id"), None)
    if name is None:
        return docs
    doc_id = F.col(f"`{name}`")
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    first, own = written(kept, "simhash-kept"), free_name(docs, "kept")
    # the ids that stay grow with the table, so this is a sort-merge join at every size and never a broadcast
    out = docs.join(first.select(F.col("doc_id").alias(own)).hint("merge"), doc_id == F.col(own), "left_semi")
    if first.where("n > 1").limit(1).count():  # an id that stands for several rows
        text = next((F.col(f"`{c}`") for c in docs.columns if c.lower() == "text"), F.lit(None))
        nth = F.row_number().over(Window.partitionBy(doc_id).orderBy(text, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
        out = out.withColumn(own, nth).where(F.col(own) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.unionByName(docs.where(doc_id.isNull()))
