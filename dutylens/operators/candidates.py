"""Candidate pairs of obligations: blocked self-join, similarity, flags, priority, and a cap per obligation.

Obligations need ord (a unique number in the order of the input). An obligation pairs with one of its own topic that
shares its action, its object or a technology. Hashed vectors are compared by blocks (blocks.py), under a cap those of large groups in bands. For an encoder's vectors that OR
is a union of three equi-joins, so no join is a cross product; their equi-keys let adaptive execution split a frequent action.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.functions.vectors import cosine
from dutylens.operators import blocks
from dutylens.sources.scratch import written
from dutylens.sources.workers import use_workers

THRESHOLD, TOP_K = 0.55, 20
#: Pairs that one task goes through in order, and of how many the bounds between them are chosen.
BAND, SAMPLE = 4_000_000, 20_000
#: Of how many pairs a band's size is estimated where pairs are not listed.
DRAWN = 400
CARRIED = ["ord", "policy_id", "section_id", "obligation_id", "sentence", "subject", "action", "object", "scope", "frequency", "technology", "modality", "negated", "confidence"]


def anchored(obligations: DataFrame, include_same_policy: bool = True) -> DataFrame:
    """(src_ord, tgt_ord), src before tgt, of pairs with an anchor in common, each once."""
    place = ("policy_id", "section_id", "sentence")
    ends = obligations.select(
        "ord", F.xxhash64("policy_id").alias("policy"), F.xxhash64(*place).alias("h"), F.xxhash64(F.lit(1), *place).alias("h2"),  # 128 bits say that two are the same sentence
        F.coalesce(F.concat(F.lit("t"), "topic"), F.lit("")).alias("topic"), "action", "object", "technology",
    )

    def joined(key: str) -> DataFrame:
        side = lambda s: ends.withColumn("anchor", F.explode("technology") if key == "technology" else F.col(key)).where("anchor is not null").select(
            "topic", "anchor", *[F.col(c).alias(f"{s}_{c}") for c in ("ord", "policy", "h", "h2")])
        pairs = side("src").join(side("tgt"), ["topic", "anchor"]).where("src_ord < tgt_ord and not (src_h = tgt_h and src_h2 = tgt_h2)")
        return (pairs if include_same_policy else pairs.where("src_policy <> tgt_policy")).select("src_ord", "tgt_ord")

    return joined("action").unionByName(joined("object")).unionByName(joined("technology")).distinct()


def flags() -> dict[str, Column]:
    eq = lambda c: F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    out = {f"same_{c}": eq(c) for c in ("subject", "action", "object", "scope", "frequency")}
    return {"same_policy": eq("policy_id")} | out | {"modality_mismatch": ~eq("modality"), "negation_mismatch": ~eq("negated")}


def with_ends(pairs: DataFrame, obligations: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with struct columns s and t: those columns of both obligations."""
    side = lambda s, key: obligations.select(F.col("ord").alias(key), F.struct(*columns).alias(s))
    return pairs.join(side("s", "src_ord"), "src_ord").join(side("t", "tgt_ord"), "tgt_ord")


def candidates(
    obligations: DataFrame, threshold: float = THRESHOLD, top_k: int | None = TOP_K, include_same_policy: bool = True, alike: Sequence[str] = (),
) -> DataFrame:
    """src_ord, tgt_ord, cosine, the flags and n_same of each candidate pair that is left under the cap.

    alike: columns of action and object that a pair must have in common (or both lack), for callers that need no others.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be positive or None")
    if "vector" in obligations.columns:
        if not top_k:
            return blocks.pairs(obligations, threshold, include_same_policy, alike)
        large = blocks.Large(obligations, threshold, include_same_policy, alike)
        if not large.any:
            return capped(blocks.pairs(obligations, threshold, include_same_policy, alike), top_k)
        return capped(blocks.pairs(obligations, threshold, include_same_policy, alike, without=large.keys), top_k, large)
    columns = [c for c in CARRIED if c in obligations.columns and c not in ("sentence", "section_id", "technology", "confidence")] + ["embedding"]
    pairs = with_ends(anchored(obligations, include_same_policy), obligations, columns)
    pairs = pairs.withColumn("cosine", cosine(F.col("s.embedding"), F.col("t.embedding"))).where(F.col("cosine") >= threshold)
    pairs = pairs.withColumns(flags())
    for c in alike:
        pairs = pairs.where(f"same_{c}")
    pairs = pairs.withColumn("n_same", sum((F.col(f"same_{c}").cast("int") for c in ("subject", "action", "object", "scope", "frequency")), F.lit(0)))
    low, high = F.least("s.obligation_id", "t.obligation_id"), F.greatest("s.obligation_id", "t.obligation_id")
    pairs = pairs.select("src_ord", "tgt_ord", low.alias("id_low"), high.alias("id_high"), "cosine", *flags(), "n_same")
    return capped(pairs, top_k) if top_k else pairs


def priority() -> list[Column]:
    """Most urgent first; ties fall to the larger key, then to the order of the input."""
    return [F.col(c).desc() for c in ("modality_mismatch", "negation_mismatch", "cosine", "n_same", "id_low", "id_high")] + [F.col("src_ord").asc(), F.col("tgt_ord").asc()]


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """nodes with their places from 0 on (column at), and how many there are."""
    d = written(nodes.withColumn("n", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("n", 33)
    sizes = {int(r["part"]): int(r["size"]) for r in d.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()}  # one row per partition
    before = np.cumsum([0] + [sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]).tolist()
    start = F.get(F.array(*[F.lit(x) for x in before]), part.cast("int"))
    return d.withColumn("at", (start + F.col("n").bitwiseAND(F.lit(2**33 - 1))).cast("int")).drop("n"), before[-1]


def _through(undecided: DataFrame, count: int) -> Column:
    """Which pairs are not after a place of the order that about BAND pairs are before; the sample only chooses that place."""
    keys = (*blocks.URGENCY, "id_high")
    some = undecided.select(*keys).sample(min(1.0, SAMPLE / count), seed=7).collect()
    some = sorted((tuple(r) for r in some or [undecided.select(*keys).first()]), reverse=True)
    return _not_after(keys, some[min(len(some) - 1, len(some) * BAND // count)])


def _not_after(keys: Sequence[str], bound: tuple) -> Column:
    out = F.lit(True)
    for c, v in reversed(list(zip(keys, bound))):
        out = (F.col(c) > F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
    return out


def _bound(undecided: DataFrame, large: blocks.Large, after: blocks.Bound | None) -> blocks.Bound | None:
    """The place of the order that about BAND pairs after `after` are before; None if there are not so many."""
    rate = min(1.0, DRAWN / BAND)
    drawn = large.sample(rate, after).unionByName(undecided.select(*blocks.URGENCY).sample(rate, seed=7))
    some = drawn.orderBy(*[F.desc(c) for c in blocks.URGENCY]).limit(max(2, int(BAND * rate))).collect()
    return tuple(some[-1]) if len(some) == max(2, int(BAND * rate)) else None


def _passed(band: DataFrame, used: DataFrame | None, busy: int, top_k: int) -> DataFrame:
    """The pairs of a band that a pass in order keeps; sb and tb number the ends that are bound, used (at, used) says what bands before took."""
    rows = band.withColumn("used", F.lit(None).cast("long"))
    if used is not None:
        rows = rows.unionByName(used.select(F.col("at").alias("sb"), "used"), allowMissingColumns=True)
    schema = band.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = array("q", [top_k]) * (busy + 1)  # one by one it is read faster than numpy's
        room = np.frombuffer(left, np.int64)
        for b in batches:
            get = lambda name: b.column(b.schema.get_field_index(name))
            s, t = (get(c).fill_null(busy).to_numpy(zero_copy_only=False) for c in ("sb", "tb"))
            state = get("used").is_valid().to_numpy(zero_copy_only=False)
            room[s[state]] -= get("used").drop_null().to_numpy(zero_copy_only=False)
            room[busy] = np.iinfo(np.int64).max  # an end that is not bound
            kept = []
            at = np.flatnonzero(~state & (room[s] > 0) & (room[t] > 0))
            for i, a, z in zip(at.tolist(), s[at].tolist(), t[at].tolist()):
                if left[a] > 0 and left[z] > 0:
                    left[a] -= 1
                    left[z] -= 1
                    kept.append(i)
            if kept:
                yield b.take(pa.array(kept)).select(schema.names)

    use_workers(band.sparkSession)
    return rows.repartition(1).sortWithinPartitions(F.col("used").isNull(), *priority()).mapInArrow(run, schema)


def capped(pairs: DataFrame, top_k: int, large: blocks.Large | None = None) -> DataFrame:
    """The pairs that a pass in order of priority keeps if an obligation may be in top_k pairs at most.

    Obligations with top_k pairs or fewer are no constraint, and pairs of two such are kept at once. The rest goes through in bands of
    about BAND pairs, the most urgent first: one task goes through a band in order, knowing only how many pairs each bound obligation has,
    and pairs of obligations that are full by then leave the rest. So there are as many passes as there are bands among
    the pairs at most, however pairs depend on one another, and far fewer where obligations fill up. Bands and what they leave are
    written to the shared folder, so a plan never grows with them; the driver sees counts and a sample for the bounds of the bands.

    large: groups whose pairs are not among the given ones, as they grow with the square of a group. They are made band by band, and
    only of obligations that are not full by then; all obligations in such groups count as bound.
    """
    ends = lambda p, s, t, name: p.select(F.col(s).alias(name)).unionByName(p.select(F.col(t).alias(name)))
    columns = pairs.columns
    pairs = written(pairs, "pairs")
    degree = ends(pairs, "src_ord", "tgt_ord", "ord").groupBy("ord").agg(F.count("*").alias("n"))
    bound = degree.where(F.col("n") > top_k).select("ord")
    busy, n_busy = _numbered(bound if large is None else bound.unionByName(large.rows.select("ord")).distinct())
    if not n_busy:
        return pairs
    if large is not None:
        large.number(busy)
    mark = lambda p, key, name: p.join(busy.select(F.col("ord").alias(key), F.col("at").alias(name)), key, "left")
    marked = written(mark(mark(pairs, "src_ord", "sb"), "tgt_ord", "tb").select(*columns, "sb", "tb"), "marked")
    free = F.col("sb").isNull() & F.col("tb").isNull()
    out, undecided, used, after = marked.where(free).select(columns), marked.where(~free), None, None
    while True:
        if large is None:
            count = undecided.count()
            if not count:
                return out
            last = count <= BAND
            now = F.lit(True) if last else _through(undecided, count)
            band = undecided.where(now)
        else:
            until = _bound(undecided, large, after)
            last = until is None
            now = F.lit(True) if last else _not_after(blocks.URGENCY, until)
            band = undecided.where(now).unionByName(large.band(after, until).withColumnsRenamed({"s_at": "sb", "t_at": "tb"}))
            after = until
        kept = written(_passed(band, used, n_busy, top_k), "kept")
        out = out.unionByName(kept.select(columns))
        if last:
            return out
        more = ends(kept, "sb", "tb", "at").where("at is not null").groupBy("at").agg(F.count("*").alias("used"))
        used = written(more if used is None else more.unionByName(used).groupBy("at").agg(F.sum("used").alias("used")), "used")
        full = used.where(F.col("used") >= top_k)
        rest = undecided.where(~now)
        for key in ("sb", "tb"):
            rest = rest.join(full.select(F.col("at").alias(key)), key, "left_anti")
        undecided = written(rest.select(*columns, "sb", "tb"), "undecided")
        if large is not None:
            large.drop(full)


def ordered(pairs: DataFrame) -> DataFrame:
    """Output order: most similar first, then by key."""
    return pairs.orderBy(F.desc("cosine"), "id_low", "id_high", "src_ord", "tgt_ord")
