"""Pairs of obligations by blocks: what shares an anchor is dealt to one task, and there the whole numbers of its vectors are multiplied as matrices.

An obligation goes, with its vector, to the group of its action, of its object and of each technology, all within its topic. A pair that
shares several anchors counts in the first of them only. A group of more than BLOCK rows is dealt out in pairs of blocks. Products
of whole numbers are exact, and cosines are the columns' own formula in double precision.

Large gives the pairs of the large groups in the order of their urgency, a band at a time, so that they need never be listed all at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutylens.sources.scratch import written
from dutylens.sources.workers import use_workers

#: Most rows, on average, of one side of a block; groups up to SMALL are matched many at once; pairs that are multiplied or given out at once.
BLOCK, SMALL, PIECE = 2048, 48, 16_384
#: Most rows of a group whose pairs are listed under a cap.
LISTED = 512
EQUAL = ("subject", "action", "object", "scope", "frequency")
CODED = ("topic", "policy", "place", "place2", *EQUAL, "modality", "negated")
NULL = 42  # the hash of null
#: What orders pairs by urgency, the larger the more urgent; a bound of a band is a tuple of these.
URGENCY = ("modality_mismatch", "negation_mismatch", "cosine", "n_same", "id_low")
Bound = tuple[bool, bool, float, int, str]


def _keyed(obligations: DataFrame, ids: bool, ends: Sequence[str], alike: Sequence[str]) -> DataFrame:
    """A row for each group of each obligation: key, kind, anchor, ord, codes that are equal where values are, the vector."""
    place = ("policy_id", "section_id", "sentence")
    code = {c: F.xxhash64(c) for c in (*EQUAL, "modality", "negated", "topic")} | {"policy": F.xxhash64("policy_id"), "place": F.xxhash64(*place), "place2": F.xxhash64(F.lit(1), *place)}
    none = F.array().cast("array<struct<kind: int, anchor: bigint>>")
    given = lambda ok, kind, anchors: F.when(ok, F.transform(anchors, lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("anchor")))).otherwise(none)
    no_action = F.col("action").isNull() if "action" in alike else F.lit(True)  # what must be alike is found in its own group
    no_object = F.col("object").isNull() if "object" in alike else F.lit(True)
    techs = F.array_sort(F.array_distinct(F.transform(F.coalesce("technology", F.array().cast("array<string>")), lambda x: F.xxhash64(x))))
    anchors = F.concat(given(F.col("action").isNotNull(), 0, F.array(F.xxhash64("action"))), given(F.col("object").isNotNull() & no_action, 1, F.array(F.xxhash64("object"))), given(no_action & no_object, 2, techs))
    d = obligations.select(
        "ord", *[c.alias(f"c_{k}") for k, c in code.items()], techs.alias("techs"), F.col("vector.idx").alias("idx"), F.col("vector.val").alias("val"), F.col("vector.sq").alias("sq"),
        *(["obligation_id"] if ids else []), *[F.col(c).alias(f"e_{c}") for c in ends], F.explode(anchors).alias("a"), F.coalesce(F.concat(F.lit("t"), "topic"), F.lit("")).alias("tp"),
    )
    return d.withColumns({"kind": F.col("a.kind"), "anchor": F.col("a.anchor"), "key": F.xxhash64("tp", "a.kind", "a.anchor")}).drop("a", "tp")


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return first, np.diff(np.r_[first, len(key)])


class Chunk:
    """Rows of whole groups, in the order of key and ord."""

    def __init__(self, b: pa.RecordBatch, threshold: float, across: bool, alike: Sequence[str]) -> None:
        get = lambda name: b.column(b.schema.get_field_index(name))
        self.threshold, self.across, self.alike, self.get, self.n = threshold, across, alike, get, b.num_rows
        self.key, self.own, self.cross, self.kind, self.anchor = (get(c).to_numpy(zero_copy_only=False) for c in ("k", "own", "cross", "kind", "anchor"))
        self.code = {c: get(f"c_{c}").to_numpy(zero_copy_only=False) for c in CODED}
        self.techs, self.sq = get("techs"), get("sq").to_numpy(zero_copy_only=False).astype(np.float64)
        self.several = np.diff(self.techs.offsets.to_numpy()) > 1
        idx, val = get("idx"), get("val")
        flat = idx.flatten().to_numpy(zero_copy_only=False)
        # whole numbers below 2^24 are exact in single precision, and so is every partial sum, which the squared lengths bound
        self.x = np.zeros((self.n, int(flat.max(initial=0)) + 1), np.float32 if self.sq.max(initial=0) < 2**24 else np.float64)
        self.x[np.repeat(np.arange(self.n), np.diff(idx.offsets.to_numpy())), flat] = val.flatten().to_numpy(zero_copy_only=False)
        self.length = np.sqrt(self.sq)

    @cached_property
    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ids in order, and the place of each row's id among them."""
        return np.unique(np.array(self.get("obligation_id").to_pylist(), object), return_inverse=True)

    def allowed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs count here: not one sentence with itself, and not a pair that an anchor before has."""
        same = lambda c: self.code[c][i] == self.code[c][j]
        both = lambda c: same(c) & (self.code[c][i] != NULL)
        kind = self.kind[i]
        ok = same("topic") & (kind == self.kind[j]) & (self.anchor[i] == self.anchor[j]) & ~(same("place") & same("place2"))
        ok &= ~((kind > 0) & both("action")) & ~((kind > 1) & both("object"))
        if not self.across:
            ok &= ~same("policy")
        for c in self.alike:
            ok &= same(c)
        for p in np.flatnonzero(ok & (kind == 2) & self.several[i] & self.several[j]):
            ok[p] = min(set(self.techs[i[p]].as_py()) & set(self.techs[j[p]].as_py())) == self.anchor[i[p]]
        return ok

    def exact(self, i: np.ndarray, j: np.ndarray, dot: np.ndarray) -> np.ndarray:
        length = np.sqrt(self.sq[i] * self.sq[j])
        return np.where(length == 0, 0.0, np.clip(dot.astype(np.float64) / np.where(length == 0, 1.0, length), -1.0, 1.0))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, cosine) of rows, i before j."""
        first, sizes = _groups(self.key)
        small = np.repeat(sizes <= SMALL, sizes)
        for shift in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
            every = np.flatnonzero((self.key[:-shift] == self.key[shift:]) & small[:-shift])
            for s in range(0, len(every), PIECE):
                i = every[s : s + PIECE]
                i = i[~self.cross[i] | (self.own[i] != self.own[i + shift])]
                i = i[self.allowed(i, i + shift)]
                cosine = self.exact(i, i + shift, np.einsum("ij,ij->i", self.x[i], self.x[i + shift]))
                at = cosine >= self.threshold
                yield i[at], i[at] + shift, cosine[at]
        for f, n in zip(first[sizes > SMALL], sizes[sizes > SMALL]):
            own, two = self.own[f : f + n], self.cross[f]  # of two blocks, only pairs across them count
            for s in range(0, n, 512):
                a = np.arange(f + s, min(f + s + 512, f + n))
                dots = self.x[a] @ self.x[f + s : f + n].T
                near = dots >= ((self.threshold - 1e-4) * self.length[a, None] * self.length[None, f + s : f + n]).astype(dots.dtype) - 1e-3
                near &= np.arange(n - s)[None, :] > np.arange(len(a))[:, None]
                if two:
                    near &= own[s : s + len(a), None] != own[None, s:]
                u, v = np.nonzero(near)
                for t in range(0, len(u), 1 << 18):
                    i, j = a[u[t : t + (1 << 18)]], f + s + v[t : t + (1 << 18)]
                    cosine = self.exact(i, j, dots[u[t : t + (1 << 18)], v[t : t + (1 << 18)]])
                    at = (cosine >= self.threshold) & self.allowed(i, j)
                    yield i[at], j[at], cosine[at]

    def urgency(self, i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> list[np.ndarray]:
        """The columns of URGENCY; of ids their places here, as ids() has them."""
        same = lambda c: self.code[c][i] == self.code[c][j]
        rank = self.ids[1]
        return [~same("modality"), ~same("negated"), cosine, np.sum([same(c) for c in EQUAL], axis=0, dtype=np.int32), np.minimum(rank[i], rank[j])]

    def below(self, urgency: list[np.ndarray], bound: Bound) -> np.ndarray:
        """Which pairs are less urgent than a bound."""
        names = self.ids[0]
        at = int(np.searchsorted(names, bound[4]))
        known = at < len(names) and names[at] == bound[4]
        less, equal = np.zeros(len(urgency[0]), bool), np.ones(len(urgency[0]), bool)
        for have, value in zip(urgency, (*bound[:4], at if known else at - 0.5)):
            less |= equal & (have < value)
            equal &= have == value
        return less

    def within(self, after: Bound | None, until: Bound | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, cosine) of rows, i before j, less urgent than `after` and not less than `until`.

        Rows of one modality and negation are multiplied together, so what such a product can't have in the band is not computed.
        """
        for f, n in zip(*_groups(self.key)):
            if n < 2:  # a chunk may be empty
                continue
            kinds = np.unique(np.stack([self.code["modality"][f : f + n], self.code["negated"][f : f + n]]), axis=1, return_inverse=True)[1].ravel()
            side = self.own[f : f + n] != self.own[f]
            rows = [[f + np.flatnonzero((kinds == k) & (side == s)) for k in range(int(kinds.max()) + 1)] for s in (False, True)]
            both = product(rows[0], rows[1]) if self.cross[f] else combinations_with_replacement(rows[0], 2)  # of two blocks, only pairs across them count
            for a, b in both:
                if not len(a) or not len(b):
                    continue
                kind = tuple(bool(self.code[c][a[0]] != self.code[c][b[0]]) for c in ("modality", "negated"))
                if (after is not None and kind > after[:2]) or (until is not None and kind < until[:2]):
                    continue
                low = until[2] if until is not None and kind == until[:2] else self.threshold
                high = after[2] if after is not None and kind == after[:2] else None
                for s in range(0, len(a), 512):
                    u, v = a[s : s + 512], (b[s:] if b is a else b)
                    dots = self.x[u] @ self.x[v].T
                    scale = (self.length[u, None] * self.length[None, v]).astype(dots.dtype)
                    near = dots >= dots.dtype.type(low - 1e-4) * scale - dots.dtype.type(1e-3)
                    if high is not None:
                        near &= dots <= dots.dtype.type(high + 1e-4) * scale + dots.dtype.type(1e-3)
                    if b is a:
                        near &= np.arange(len(v))[None, :] > np.arange(len(u))[:, None]
                    y, z = np.nonzero(near)
                    for t in range(0, len(y), 1 << 18):
                        y2, z2 = y[t : t + (1 << 18)], z[t : t + (1 << 18)]
                        i, j = np.minimum(u[y2], v[z2]), np.maximum(u[y2], v[z2])
                        yield self.banded(i, j, self.exact(i, j, dots[y2, z2]), after, until)

    def banded(self, i: np.ndarray, j: np.ndarray, cosine: np.ndarray, after: Bound | None, until: Bound | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = (cosine >= self.threshold) & self.allowed(i, j)
        i, j, cosine = i[ok], j[ok], cosine[ok]
        urgency = self.urgency(i, j, cosine)
        ok = np.ones(len(i), bool) if after is None else self.below(urgency, after)
        if until is not None:
            ok &= ~self.below(urgency, until)
        return i[ok], j[ok], cosine[ok]

    def sampled(self, rate: float, after: Bound | None) -> Iterator[pa.RecordBatch]:
        """The columns of URGENCY of pairs less urgent than `after`, drawn at that rate."""
        parts = self.get("parts").to_numpy(zero_copy_only=False)
        for f, n in zip(*_groups(self.key)):
            if n < 2:
                continue
            rng = np.random.default_rng(int(self.key[f]) & (2**63 - 1))
            wanted = int(rng.binomial(int(n) * (int(n) - 1) // 2, min(1.0, rate * int(parts[f]))))
            for s in range(0, wanted, PIECE):
                a = rng.integers(0, n, min(PIECE, wanted - s))
                b = (a + 1 + rng.integers(0, n - 1, len(a))) % n
                i, j = f + np.minimum(a, b), f + np.maximum(a, b)
                i, j, cosine = self.banded(i, j, self.exact(i, j, np.einsum("ij,ij->i", self.x[i], self.x[j])), after, None)
                *most, low = self.urgency(i, j, cosine)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in most] + [pa.array(self.ids[0][low], pa.string())], names=list(URGENCY))

    def told(self, ids: bool, ends: Sequence[str], found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rank = self.ids[1] if ids else None
        for i, j, cosine in found:
            if not len(i):
                continue
            same = lambda c: self.code[c][i] == self.code[c][j]
            equal = [same(c) for c in EQUAL]
            out = {"src_ord": self.get("ord").take(pa.array(i)), "tgt_ord": self.get("ord").take(pa.array(j))}
            if ids:
                name = self.get("obligation_id")
                before = rank[i] <= rank[j]
                out |= {"id_low": name.take(pa.array(np.where(before, i, j))), "id_high": name.take(pa.array(np.where(before, j, i)))}
            out |= {"cosine": pa.array(cosine), "same_policy": pa.array(same("policy"))} | {f"same_{c}": pa.array(e) for c, e in zip(EQUAL, equal)}
            out |= {"modality_mismatch": pa.array(~same("modality")), "negation_mismatch": pa.array(~same("negated")), "n_same": pa.array(np.sum(equal, axis=0, dtype=np.int32))}
            for c in ends:
                out |= {f"s_{c}": self.get(f"e_{c}").take(pa.array(i)), f"t_{c}": self.get(f"e_{c}").take(pa.array(j))}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def large(rows: DataFrame, size: int) -> DataFrame:
    """key, n of the groups of more than that many rows; fewer than rows / size."""
    return written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > size), "pair-heavy")


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """Each row to the pairs of blocks that it is in, for which k stands; `cross` says of two blocks."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("ord", F.lit(3)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("k", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).withColumn("cross", F.col("own") != F.col("other")).drop("key", "blocks", "other")


def _met(dealt: DataFrame, chunk: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """chunk() of batches of whole groups k."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(b.schema.get_field_index("k")).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])  # the last key may go on in the next batch
            if left and cut == 0 and key[0] == left[-1].column(left[-1].schema.get_field_index("k"))[-1].as_py():
                left.append(b)
                continue
            yield from chunk(pa.concat_batches([*left, b.slice(0, cut)]))
            left = [b.slice(cut)]
        if left:
            yield from chunk(pa.concat_batches(left))

    return dealt.repartition("k").sortWithinPartitions("k", "ord").mapInArrow(meet, schema)


def _schema(kind: str, ids: bool, more: str) -> str:
    names = (", id_low string, id_high string" if ids else "") + ", cosine double, same_policy boolean, " + ", ".join(f"same_{c} boolean" for c in EQUAL)
    return f"src_ord {kind}, tgt_ord {kind}{names}, modality_mismatch boolean, negation_mismatch boolean, n_same int{more}"


def pairs(obligations: DataFrame, threshold: float, across: bool = True, alike: Sequence[str] = (), ids: bool = True, ends: Sequence[str] = (), without: DataFrame | None = None) -> DataFrame:
    """src_ord, tgt_ord, id_low and id_high (ids), cosine, the flags, n_same, and s_ and t_ of the columns `ends`.

    across: pairs within a policy too; alike: columns of action and object that both must have in common; without: keys of groups to leave out.
    """
    use_workers(obligations.sparkSession)
    rows = _keyed(obligations, ids, ends, alike)
    if without is None:
        heavy = large(rows, BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        rows = rows.join(heavy, "key", "left")
    else:
        rows = rows.join(without.select("key"), "key", "left_anti").withColumn("blocks", F.lit(1))
    more = "".join(f", {s}_{c} {obligations.schema[c].dataType.simpleString()}" for c in ends for s in "st")

    def chunk(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = Chunk(b, threshold, across, alike)
        return c.told(ids, ends, c.pairs())

    return _met(_dealt(rows, F.coalesce("blocks", F.lit(1))), chunk, _schema(obligations.schema["ord"].dataType.simpleString(), ids, more))


class Large:
    """The pairs of the groups of more than LISTED rows, by bands of urgency.

    Each band is multiplied anew, of the obligations that are still there.
    """

    def __init__(self, obligations: DataFrame, threshold: float, across: bool, alike: Sequence[str]) -> None:
        use_workers(obligations.sparkSession)
        self.threshold, self.across, self.alike = threshold, across, alike
        rows = _keyed(obligations, True, (), alike)
        self.keys = large(rows, LISTED)
        self.any = self.keys.count() > 0
        if self.any:
            self.rows = written(rows.join(self.keys.select("key"), "key", "left_semi"), "large")

    def number(self, at: DataFrame) -> None:
        """at: ord, at of every obligation in these groups."""
        self.rows = written(self.rows.join(at.select("ord", F.col("at").alias("e_at")), "ord"), "large")

    def drop(self, at: DataFrame) -> None:
        self.rows = written(self.rows.join(at.select(F.col("at").alias("e_at")), "e_at", "left_anti"), "large")

    def _sized(self) -> DataFrame:
        sizes = self.rows.groupBy("key").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("blocks"))
        return self.rows.join(sizes, "key")

    def sample(self, rate: float, after: Bound | None) -> DataFrame:
        """The columns of URGENCY of a share of the pairs less urgent than `after`."""
        threshold, across, alike = self.threshold, self.across, self.alike
        rows = self._sized().withColumn("own", F.lit(0)).withColumn("cross", F.lit(False)).withColumn("parts", F.col("blocks"))
        # pairs within random parts stand for all
        rows = rows.withColumn("k", F.xxhash64("key", F.pmod(F.xxhash64("ord", F.lit(5)), "blocks"))).drop("key", "blocks")
        return _met(rows, lambda b: Chunk(b, threshold, across, alike).sampled(rate, after), "modality_mismatch boolean, negation_mismatch boolean, cosine double, n_same int, id_low string")

    def band(self, after: Bound | None, until: Bound | None) -> DataFrame:
        """The pairs less urgent than `after` and not less than `until`, as pairs() has them, with s_at and t_at."""
        threshold, across, alike = self.threshold, self.across, self.alike

        def chunk(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            c = Chunk(b, threshold, across, alike)
            return c.told(True, ["at"], c.within(after, until))

        return _met(_dealt(self._sized(), F.col("blocks")), chunk, _schema(self.rows.schema["ord"].dataType.simpleString(), True, ", s_at int, t_at int"))


def array_pairs(rows: DataFrame, by: str, name: str, column: str, threshold: float) -> DataFrame:
    """(a, b, c): ids (`name`) a < b of rows with one value of `by`, whose arrays have a cosine c of at least threshold > 0.

    A product of matrices leaves out what is clearly below; the rest is summed in the order, and by the formula, of vectors.cosine.
    """
    use_workers(rows.sparkSession)
    d = rows.where(F.col(by).isNotNull() & (F.size(column) > 0)).select(F.col(by).alias("by"), F.col(name).alias("id"), F.col(column).cast("array<double>").alias("x"))
    sizes = d.groupBy("by").agg(F.count("*").alias("n"))
    d = d.join(sizes, "by").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    d = d.withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("by", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "x")
    kind = d.schema["id"].dataType.simpleString()

    def meet(t: pa.Table) -> pa.Table:
        ids, own, x, two = t["id"].to_numpy(), t["own"].to_numpy(), t["x"].combine_chunks(), t["low"][0] != t["high"][0]
        length = np.diff(x.offsets.to_numpy())
        if len(set(length)) > 1:
            raise ValueError("vectors of different dimension")
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        summed = lambda u, v: np.cumsum(u * v, axis=1)[:, -1]  # noqa: E731  in order
        norm = np.sqrt(summed(x, x))
        out = []
        for s in range(0, len(ids), 512):
            near = ~(x[s : s + 512] @ x.T < (threshold - 1e-6) * norm[s : s + 512, None] * norm[None, :]) & (ids[s : s + 512, None] < ids[None, :])
            if two:
                near &= own[s : s + 512, None] != own[None, :]
            u, v = np.nonzero(near)
            for k in range(0, len(u), PIECE):
                i, j = s + u[k : k + PIECE], v[k : k + PIECE]
                both = norm[i] * norm[j]
                c = np.where(both == 0, 0.0, summed(x[i], x[j]) / np.where(both == 0, 1.0, both))
                c = np.where(np.isnan(c), 1.0, np.clip(c, -1.0, 1.0))  # as least() and greatest() have it
                out.append((ids[i][c >= threshold], ids[j][c >= threshold], c[c >= threshold]))
        parts = [np.concatenate(p) for p in zip(*out)] if out else [ids[:0], ids[:0], np.empty(0)]
        return pa.table({"a": pa.array(parts[0], t["id"].type), "b": pa.array(parts[1], t["id"].type), "c": parts[2]})

    return d.groupBy("by", "low", "high").applyInArrow(meet, f"a {kind}, b {kind}, c double")
