"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries, records are range-partitioned by them, and ranges that turn
out overfull are subdivided by a finer sample of their own, all of them in one pass, until none is. The key is (hash of
the text, hash of the id, hash of the row's place): the ranges are even whatever the ids look like, and equal texts are
neighbours. Ranges are much finer than shards; running sums over the ranges (a few numbers each) and within them give
every record its exact place in the order of keys, from which its shard (near equal bytes) and slot follow. The sample
only decides what a task holds: the place of a record is the same for every sample and layout of the table, as rows that
only their place tells apart are equal in all.

Equal texts share a shard unless they have together more bytes or rows than a range's share (1/64 of a shard), which is
found by an exact count; such a text is cut within.

Cases: a null text has no bytes, size 1 and the CRC of no bytes; null ids and rows repeated whole get places of their own;
a record larger than a range is a range of its own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.llm.common import use_workers, with_columns_apart, written

#: Expected size of the first sample, and rows of a range in a table of very many.
SAMPLE = 16_384
RANGE_ROWS = 1_000_000
LOW = -(2**63)


def _bytes(key: tuple[int, ...]) -> bytes:
    """A key in an order that compares like the signed numbers."""
    return struct.pack(">QQQ", *((x + 2**63) % 2**64 for x in key))


def _sample(rows: DataFrame, chance: Column, seed: int) -> list:
    """(part, hi, lo, tie, weight): each record with its chance; the weight says what a picked record stands for."""
    luck = F.shiftrightunsigned(F.xxhash64("hi", "lo", "tie", F.lit(seed)), 1) / F.lit(float(1 << 63))
    return rows.withColumn("chance", chance).where(luck < F.col("chance")).select("part", "hi", "lo", "tie", F.greatest(F.lit(1.0), F.col("chance")).alias("w")).collect()


def _quantiles(sample: list, n: int, large: set[int]) -> list[tuple[int, int, int]]:
    """n - 1 boundaries (first key of the next range). Only a large text is cut within."""
    keys = sorted((r["hi"], r["lo"], r["tie"], r["w"]) for r in sample)
    if not keys:
        return []
    upto = np.cumsum([k[3] for k in keys])
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, n) / n))
    cuts = [keys[i][:3] for i in at if i < len(keys)]
    return [(h, a, t) if h in large else (h, LOW, LOW) for h, a, t in cuts]


def _placed(rows: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    keys = np.array([_bytes(c) for c in cuts], "S24") if cuts else np.empty(0, "S24")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.stack([b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(2**63) for i in (1, 2, 3)], axis=1).astype(">u8")
            at = np.searchsorted(keys, np.frombuffer(own.tobytes(), "S24"), side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "part"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "hi", "lo", "tie", "size", "text_crc32").mapInArrow(run, f"doc_id {kind}, hi bigint, lo bigint, tie bigint, size bigint, text_crc32 bigint, part int")


def shard(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    use_workers(spark)
    d = with_columns_apart(docs, ["doc_id", "text"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = d.select(
        "doc_id", F.xxhash64(text).alias("hi"), F.xxhash64("doc_id").alias("lo"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = written(rows, "shard-keys")
    sums = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    n, total = max(1, sums["n"]), sums["size"] or 1
    n_ranges = max(64 * n_shards, n // RANGE_ROWS)
    of_text = rows.groupBy("hi").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    large = {r["hi"] for r in of_text.where((F.col("s") * n_ranges > total) | (F.col("n") * n_ranges > n)).collect()}  # at most 2 * n_ranges
    size = max(SAMPLE, 8 * n_ranges)
    share = F.col("size") / F.lit(float(total)) + F.lit(1.0 / n)
    cuts = sorted(set(_quantiles(_sample(rows.withColumn("part", F.lit(0)), share * size / 2, 0), n_ranges, large)))
    seed = 0
    while True:
        parts, seed = _placed(rows, cuts), seed + 1
        # a record counts as a range at most: it can't be subdivided
        full = parts.groupBy("part").agg(F.sum(F.least(F.col("size"), F.lit(-(-total // n_ranges)))).alias("s"), F.count("*").alias("n"))
        full = full.select("part", (F.col("s") * n_ranges / F.lit(float(total))).alias("s"), (F.col("n") * n_ranges / F.lit(float(n))).alias("n")).where((F.col("s") > 4) | (F.col("n") > 4))
        over = {r["part"]: int(np.ceil(max(r["s"], r["n"]))) for r in full.collect()}  # at most n_ranges / 2
        if not over:
            break
        finer = F.broadcast(spark.createDataFrame(list(over.items()), "part int, pieces int"))
        found: dict[int, list] = {p: [] for p in over}
        for r in _sample(parts.join(finer, "part"), share * n_ranges * 32, seed):
            found[r["part"]].append(r)
        more = sorted({*cuts, *(c for p, rs in found.items() for c in _quantiles(rs, over[p], large))})
        if len(more) == len(cuts):
            break  # nothing to cut between
        cuts = more
    parts = written(_placed(rows, cuts), "shard-ranges")
    totals = {r["part"]: (r["s"], r["n"]) for r in parts.groupBy("part").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    starts, size_before, rows_before = [], 0, 0
    for p in sorted(totals):
        starts.append((p, size_before, rows_before))
        size_before, rows_before = size_before + totals[p][0], rows_before + totals[p][1]
    begun = spark.createDataFrame(starts, "part int, size_before bigint, rows_before bigint")
    cut = spark.createDataFrame([(h,) for h in sorted(large)], "hi bigint").withColumn("cut", F.lit(True))
    order = Window.partitionBy("part").orderBy("hi", "lo", "tie")
    group = Window.partitionBy("part", "hi")
    # both tables have a few rows for each range at most
    out = parts.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order))
    out = out.join(F.broadcast(begun), "part").join(F.broadcast(cut), "hi", "left")
    first, last = F.min(F.col("upto") - F.col("size")).over(group), F.max("upto").over(group)
    middle = F.when(F.col("cut"), F.col("upto") - F.col("size") / 2).otherwise((first + last) / 2) + F.col("size_before")
    out = out.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(float(total)))).cast("int"))
    out = out.select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("nth") - 1).alias("place"))
    out = written(out, "shard-places")
    first_of = {r["shard"]: r["p"] for r in out.groupBy("shard").agg(F.min("place").alias("p")).collect()}  # n_shards rows
    start = F.element_at(F.array(*[F.lit(int(first_of.get(k, 0))) for k in range(n_shards)]), F.col("shard") + 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
