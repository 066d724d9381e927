"""Token counts of documents in flat token files that have no index.

A token file is nothing but token ids of a fixed width, with an end-of-document id after each document. A file is cut
into blocks of equal size, every block is searched for the end id at once with numpy, and what a document has in
several blocks is put together by a prefix scan over three numbers per block: separators, tokens before the first
one, tokens after the last one. The scan is two-level (groups of blocks, then groups), so that a file of any length
is no single task.

Files are read and written in ranges of bytes, which Spark's readers don't offer, so pyarrow does it, on the store that
Hadoop resolves the folder to (a path without a scheme is on Hadoop's default file system). A store that pyarrow doesn't know
raises ValueError before anything is written, and `count_tokens` raises RuntimeError if the scan doesn't find as many documents in a
file as were written to it.

Cases: a document without tokens has count 0; tokens after the last end id are an unfinished document and reported
with ended = false; an empty file has no documents; a file whose length is no multiple of the width raises ValueError;
a folder that is not there, FileNotFoundError. `write_token_files` writes null texts as documents without tokens, repeated rows as often as they
come, and very long texts whole, across as many blocks as they take; an empty table makes no files and an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.llm.common import new_folder, use_workers, with_columns_apart, written

BLOCK_TOKENS = 1 << 19
#: Blocks that the first level of the scan takes together.
GROUP = 1024


def resolved(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme by which Hadoop knows it; ValueError if pyarrow doesn't know that store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    open_store(uri)
    return uri


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's view of a resolved folder."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    try:
        return fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", uri), safe=":/@"))
    except (pa.ArrowException, OSError, NotImplementedError) as e:
        raise ValueError(f"token files need a store that pyarrow can open: {uri}") from e


def byte_coder(path: str):
    """encode(text) of a byte-level BPE file of ranks; ids are below the free id that marks the end of a document."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, dtype: str = "<u2", folder: str | None = None, file_tokens: int = 16_000_000) -> tuple[DataFrame, str]:
    """Encode every text and append it to flat token files in a shared folder; returns (file, nth, doc_id) and the folder.

    A task writes its files under a name of its attempt and renames each when it is complete, so a task that runs
    again replaces them by the same. The manifest is written once beside them.
    """
    spark = docs.sparkSession
    use_workers(spark)
    d = with_columns_apart(docs, ["doc_id", "text"])
    kind = d.schema["doc_id"].dataType.simpleString()
    folder = resolved(spark, folder or new_folder(spark, "token-files"))
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (store, root), task = byte_coder(tokenizer_path), open_store(folder), TaskContext.get()
        store.create_dir(root, recursive=True)
        out, name, temp, tokens, nth, n_file = None, "", "", 0, 0, 0
        for b in batches:
            files, places = [], []
            for text in b.column(1).to_pylist():
                if out is None or tokens >= file_tokens:
                    if out is not None:
                        out.close()
                        store.move(temp, f"{root}/{name}")
                    name = f"part-{task.partitionId():06d}-{n_file:04d}.tok"
                    temp = f"{root}/.{name}.{task.taskAttemptId()}"
                    out, tokens, nth, n_file = store.open_output_stream(temp), 0, 0, n_file + 1
                ids = encode(text or "")
                ids.append(end_id)
                out.write(np.array(ids, dtype).tobytes())
                tokens += len(ids)
                files.append(name)
                places.append(nth)
                nth += 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), b.column(0)], names=["file", "nth", "doc_id"])
        if out is not None:
            out.close()
            store.move(temp, f"{root}/{name}")

    manifest = written(d.mapInArrow(run, f"file string, nth bigint, doc_id {kind}"), "token-manifest")
    return manifest, folder


def token_files(folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of each token file of a folder. The driver lists them; a list of files, not of documents."""
    store, root = open_store(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=False))
    return sorted((f.base_name, f.size) for f in found if f.is_file and not f.base_name.startswith("."))


def scan_tokens(spark: SparkSession, folder: str, end_id: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, nth, start, n_tokens, ended) of every document in the token files of a folder."""
    return stitched(scan_blocks(spark, folder, end_id, dtype, block_tokens))


def scan_blocks(spark: SparkSession, folder: str, end_id: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per block: tokens (n), separators (ends), tokens before the first (head), after the last (tail) and between them (inner)."""
    use_workers(spark)
    width, folder = np.dtype(dtype).itemsize, resolved(spark, folder)
    files = token_files(folder)
    if odd := [f for f, size in files if size % width]:
        raise ValueError(f"not a whole number of {width}-byte tokens: {odd[:3]}")
    n_blocks = sum(-(-size // (width * block_tokens)) for _, size in files)
    table = spark.createDataFrame([(f, size // width) for f, size in files], "file string, size bigint")
    blocks = table.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_tokens).cast("long"))).alias("block"))
    blocks = blocks.repartition(max(1, min(n_blocks, 100_000)))  # by nobody's key: one block after the other

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for b in batches:
            for file, size, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                first = block * block_tokens
                with store.open_input_file(f"{root}/{file}") as f:
                    raw = f.read_at((min(size, first + block_tokens) - first) * width, first * width)
                ends = np.flatnonzero(np.frombuffer(raw, dtype) == end_id).astype(np.int64)
                n = len(raw) // width
                inner = np.diff(ends) - 1
                head, tail = (ends[0], n - 1 - ends[-1]) if len(ends) else (n, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block]), pa.array([n], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(head)], pa.int64()), pa.array([int(tail)], pa.int64()), pa.array([inner.astype(np.int32)], pa.list_(pa.int32()))],
                    names=["file", "block", "n", "ends", "head", "tail", "inner"],
                )

    return written(blocks.mapInArrow(search, "file string, block bigint, n bigint, ends bigint, head bigint, tail bigint, inner array<int>"), "token-blocks")


def stitched(found: DataFrame) -> DataFrame:
    """The documents of scanned blocks."""
    # prefix scan of (separators so far, open tokens): within groups of blocks, over groups, and back
    sums = found.select("file", "block", "n", "ends", "tail", F.floor(F.col("block") / GROUP).alias("group"))
    order = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_group = _carried(sums, order)
    whole = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = _carried(sums, whole).groupBy("file", "group").agg(F.max_by(F.struct("c_ends", "c_open", "c_any"), "block").alias("s"))
    groups = groups.select("file", "group", F.col("s.c_ends").alias("ends"), F.col("s.c_open").alias("tail"), F.col("s.c_any").alias("any")).withColumn("n", F.col("tail")).withColumn("block", F.col("group"))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = _carried(groups, over).select("file", "group", F.col("c_ends").alias("g_ends"), F.col("c_open").alias("g_open"))
    state = in_group.join(before, ["file", "group"]).select("file", "block", (F.col("c_ends") + F.col("g_ends")).alias("nth"), (F.col("c_open") + F.when(F.col("c_any"), 0).otherwise(F.col("g_open"))).alias("open"))
    joined = found.join(state, ["file", "block"])
    first = F.struct(F.lit(0).alias("i"), (F.col("head") + F.col("open")).alias("k"))
    rest = F.transform("inner", lambda k, i: F.struct((i + 1).cast("int").alias("i"), k.cast("long").alias("k")))
    docs = joined.where("ends > 0").select("file", "nth", F.explode(F.concat(F.array(first), rest)).alias("x")).select("file", (F.col("nth") + F.col("x.i")).alias("nth"), F.col("x.k").alias("n_tokens"), F.lit(True).alias("ended"))
    last = joined.groupBy("file").agg(F.max_by(F.struct(F.col("nth") + F.col("ends"), F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("open"))), "block").alias("s"))
    last = last.select("file", F.col("s.col1").alias("nth"), F.col("s.col2").alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return docs.unionByName(last)


def _carried(rows: DataFrame, window) -> DataFrame:
    """rows with what the rows of the window before them leave: separators, tokens since the last one, whether there was one.

    Tokens since the last separator are the tokens so far less those up to it, which is a running maximum.
    """
    total = F.coalesce(F.sum("n").over(window), F.lit(0))
    upto = F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    has = F.col("ends") > 0
    mark = rows.withColumn("__end", F.when(has, upto - F.col("tail")))
    return mark.withColumn("c_ends", F.coalesce(F.sum("ends").over(window), F.lit(0))).withColumn("c_any", F.max("__end").over(window).isNotNull()).withColumn("c_open", total - F.coalesce(F.max("__end").over(window), F.lit(0))).drop("__end")


def count_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write docs as flat token files, then count what a scan of the files finds: doc_id, file, nth, n_tokens."""
    manifest, folder = write_token_files(docs, tokenizer_path, end_id, dtype)
    blocks = scan_blocks(docs.sparkSession, folder, end_id, dtype, block_tokens)
    wrote, scanned = manifest.groupBy("file").agg(F.count("*").alias("wrote")), blocks.groupBy("file").agg(F.sum("ends").alias("scanned"))
    lost = wrote.join(scanned, "file", "full").where(~F.col("wrote").eqNullSafe(F.col("scanned"))).first()
    if lost:
        raise RuntimeError(f"token file {lost['file']}: {lost['wrote']} documents were written, {lost['scanned']} are there")
    return manifest.join(stitched(blocks), ["file", "nth"]).select("doc_id", "file", "nth", "n_tokens")
