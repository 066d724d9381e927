"""Helpers that the corpus operators share: word counts, columns apart, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutylens.sources.scratch import new_folder, passing, written
from dutylens.sources.workers import use_workers

__all__ = ["WORD", "components", "free_name", "give_back", "keep_for", "let_go", "n_words", "new_folder", "passing", "use_workers", "with_columns_apart", "written"]

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: What gives back the caches that outlast a task in a worker, by operator, and whose task came last.
_held: dict[str, Callable[[], object]] = {}
_last: list[str] = []


def keep_for(operator: str, clear: Callable[[], object]) -> None:
    """Say that this worker keeps something for the operator's next tasks; clear() gives it back."""
    _held[operator] = clear


def let_go(operator: str) -> None:
    """Called first in a task: workers are used again, so what another operator left in this one is given back."""
    if _last == [operator]:
        return
    _last[:] = [operator]
    for k in [k for k in _held if k != operator]:
        _held.pop(k)()
    give_back()


def give_back() -> None:
    """Called last in a task as well: a worker that waits for its next task holds no memory that nothing uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def with_columns_apart(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, so that nothing else in a caller's table can clash with ours; a missing one is null."""
    there = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{there[n.lower()]}`") if n.lower() in there else F.lit(None).cast("string")).alias(n) for n in names])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node in `edges` (u, v): root is the smallest node that is reachable.

    Alternating large and small stars (Kiveris et al. 2014). Each round is written to the shared folder; only two
    numbers of a round reach the driver. Minima of a node's neighbours are partial aggregates and come back by an
    equi-join, which adaptive execution can split, so that a node with very many neighbours is not one task's work.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        # large star: every larger neighbour of a node moves to the smallest node around
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of a node and the node itself move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = written(small, name)
        roots = e.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.countDistinct("u").alias("d")).first()
        now = (roots["n"], roots["s"], roots["d"])
        if now == before or roots["n"] == 0:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
