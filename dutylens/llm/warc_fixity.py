"""Merkle fixity audit of stored WARC replicas, with DataFrame functions only.

`write_warc` stores pages as WARC files and `read_warc` finds the records of stored files again: where they start, how
long they are, and the SHA-256 of their bytes. Both go through Spark's own readers and writers, so any store that Spark
knows will do; a reader's row is what lies between two record starts, and a large file is read in splits.

The records of a file, in the order of their offsets, are cut into ranges: a range ends before a record whose hash is
divisible by LEAF. The hashes of a range make a leaf; leaves are cut into nodes in the same way, up to the root of a
file, and files are put together by the digits of their names' hashes up to the root of the replica. As contents and not
offsets decide where ranges end, a record that is cut short, lost or added changes its own range only, though all after
it have moved. Two replicas with equal roots are equal. Otherwise only children of mismatching nodes are compared, level
by level, and only the records of mismatching leaves are looked at. There records are aligned by their id and address.

Cases: null columns of a page are empty in its record, and come back as a null id and an empty address; records of equal
id, address and content are copies, counted together; a file or record that only one replica has is reported; a record
whose damage hides its id is missing and another one extra; one whose first line is damaged belongs to the record before
it; a payload that holds "\\r\\n\\r\\nWARC/1.1\\r\\n" is cut there, in all replicas alike; long payloads are hashed whole; an
empty table makes no files and no differences; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutylens.llm.common import new_folder, with_columns_apart, written

#: Records in a leaf and nodes in a node above, on average; and at most, in case all are alike.
LEAF, FAN_OUT, MOST = 64, 16, 1024
#: Bytes of a file whose records, or nodes, are put in order together.
BUCKET = 1 << 26
FIRST, GAP = "WARC/1.1\r\n", "\r\n\r\n"
START = GAP + FIRST


def record(page_id: Column, url: Column, declared: Column, payload: Column) -> Column:
    """A response record without the gap after it; the length in its header is that of `declared`."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit(FIRST + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:"), text(page_id), F.lit(">\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nContent-Length: "), F.octet_length(text(declared)).cast("string"), F.lit(GAP), text(payload),
    )


def write_replicas(pages: DataFrame, n_files: int, payloads: dict[str, Column], also: tuple[str, ...] = (), folder: str | None = None, compression: str = "gzip") -> dict[str, str]:
    """Store pages as WARC files, once for each replica; returns the folder of each.

    payloads: what each replica holds in place of html, made of html and the columns in `also`; null: it has no such record. Pages are
    dealt to files by a hash of their key and lie there in the order of their key. They are dealt once for all replicas. With gzip, a
    file is one stream and is read by one task; with "none", large files are read in splits.
    """
    p = with_columns_apart(pages, ["page_id", "url", "html", *also])
    key = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url"), F.lit("")))
    file = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(n_files)).cast("int")
    dealt = p.withColumn("file", file).repartition(max(1, n_files), "file")
    every = F.array(*[F.struct(F.lit(name).alias("replica"), payload.alias("payload")) for name, payload in payloads.items()])
    rows = dealt.withColumn("x", F.explode(every)).where("x.payload is not null")
    rows = rows.select("x.replica", "file", "page_id", "url", record(F.col("page_id"), F.col("url"), F.col("html"), F.col("x.payload")).alias("value"))
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows.sortWithinPartitions("replica", "file", "page_id", "url", "value").select("replica", "file", "value").write.partitionBy("replica", "file").option("lineSep", GAP).option("compression", compression).text(folder)
    out = {name: f"{folder}/replica={name}" for name in payloads}
    for path in out.values():  # one without records has no files
        where = pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return out


def write_warc(pages: DataFrame, n_files: int, stored: str | None = None, **options) -> str:
    """One replica. `stored` names a column that stands in place of html; a null one is an empty payload."""
    payload = F.coalesce(F.col(stored or "html").cast("string"), F.lit(""))
    return write_replicas(pages, n_files, {"only": payload}, (stored,) if stored else (), **options)["only"]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(file, at, length, page_id, url, sha) of every record in a folder's files; at is the offset in the (unpacked) file.

    A file's name is its path in the folder, or the folder that Spark wrote it in alone.
    """
    rows = spark.read.schema("value string").option("lineSep", START).option("recursiveFileLookup", "true").text(folder)
    path = F.substring_index("_metadata.file_path", "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    rows = rows.select(F.regexp_replace(path, "/part-[^/]*$", "").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    # a reader's buffer may end in a start of a record: such a row holds two
    parts = F.when(F.col("value").contains(START), F.split("value", "\\Q" + START + "\\E")).otherwise(F.array("value"))
    rows = rows.select("file", "split", "row", F.posexplode(parts).alias("piece", "value"))
    whole = F.when(F.col("value").startswith(FIRST), F.col("value")).otherwise(F.concat(F.lit(FIRST), F.col("value")))
    head = F.substring_index("value", GAP, 1)
    told = lambda pattern: F.regexp_extract(head, pattern, 1)
    found = written(rows.select(
        "file", "split", "row", "piece", F.octet_length("value").cast("long").alias("own"), F.col("value").startswith(FIRST).alias("first"), F.nullif(told(r"(?m)^WARC-Record-ID: <urn:page:(-?\d{1,18})>"), F.lit("")).cast("long").alias("page_id"),
        told(r"(?m)^WARC-Target-URI: ([^\r\n]*)").alias("url"), F.sha2(F.concat(whole, F.lit(GAP)).cast("binary"), 256).alias("sha"), F.sha2(whole.cast("binary"), 256).alias("sha_last"),
    ), "warc-rows")
    # where a row starts: what is before it in its split, and the splits before that
    step = F.col("own") + len(START)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = found.groupBy("file", "split").agg(F.sum(step).alias("bytes"))
    splits = splits.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("total", F.sum("bytes").over(Window.partitionBy("file")) - len(START)).drop("bytes")
    order = Window.partitionBy("file", "split").orderBy("row", "piece").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("start", F.coalesce(F.sum(step).over(order), F.lit(0))).join(splits, ["file", "split"]).withColumn("start", F.col("start") + F.col("base"))
    last = F.col("start") + F.col("own") >= F.col("total")
    lead = F.when(F.col("first") | (F.col("start") == 0), 0).otherwise(len(FIRST))
    return found.select("file", (F.col("start") - lead).alias("at"), (F.col("own") + lead + F.when(last, 0).otherwise(len(GAP))).alias("length"), "page_id", "url", F.when(last, F.col("sha_last")).otherwise(F.col("sha")).alias("sha"))


def _hash(children: Column) -> Column:
    """The hash of ordered children: structs of a place (at) and a hash (sha)."""
    return F.sha2(F.concat_ws("|", F.transform(F.array_sort(children), lambda c: c["sha"])), 256)


def _grouped(nodes: DataFrame, size: int) -> DataFrame:
    """nodes (side, file, at, sha, ...) with (up, slice), the node above: how many edges were so far, and how many MOST nodes.

    Counted in buckets of a file first and then over the buckets, so that no task orders a whole file.
    """
    edge = (F.conv(F.substring("sha", 1, 8), 16, 10).cast("long") % size == 0).cast("long")
    n = nodes.withColumn("bucket", F.floor(F.col("at") / BUCKET)).withColumn("edge", edge)
    key = ["side", "file"]
    inside, over = Window.partitionBy(*key, "bucket").orderBy("at"), Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = n.groupBy(*key, "bucket").agg(F.sum("edge").alias("e"), F.count("*").alias("r"))
    sums = sums.select(*key, "bucket", F.coalesce(F.sum("e").over(over), F.lit(0)).alias("e"), F.coalesce(F.sum("r").over(over), F.lit(0)).alias("r"))
    out = n.withColumn("up", F.sum("edge").over(inside)).withColumn("slice", F.row_number().over(inside)).join(sums, [*key, "bucket"])
    return out.withColumn("up", F.col("up") + F.col("e")).withColumn("slice", F.floor((F.col("slice") + F.col("r")) / MOST)).drop("bucket", "edge", "e", "r")


def file_trees(records: DataFrame) -> list[DataFrame]:
    """The levels of the trees of all files (side, file), from the records to one node (node, part, at, sha) per file.

    (node, part) are the (up, slice) of a node's children.
    """
    levels = [written(_grouped(records, LEAF), "merkle")]
    while True:
        above = levels[-1].groupBy("side", "file", F.col("up").alias("node"), F.col("slice").alias("part")).agg(F.min("at").alias("at"), _hash(F.collect_list(F.struct("at", "sha"))).alias("sha"))
        levels.append(written(_grouped(above, FAN_OUT), "merkle"))
        if not levels[-1].groupBy("side", "file").count().where("count > 1").limit(1).count():
            return levels


def _unequal(nodes: DataFrame, by: list[str]) -> DataFrame:
    """What of `by` and sha the two sides don't have equally often."""
    return nodes.groupBy(*by, "sha").agg(F.sum(F.when(F.col("side") == "a", 1).otherwise(-1)).alias("more")).where("more <> 0").drop("more")


def mismatching_records(a: DataFrame, b: DataFrame) -> DataFrame | None:
    """The records (side, file, ...) whose leaves differ; None where the roots agree. Children of agreeing nodes are not compared."""
    levels = file_trees(a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))))
    roots = levels[-1].select("side", "file", "sha", F.md5("file").alias("name"))
    # over the files: digits of the hash of a file's name, as many as there are files for
    files = roots.select("file").distinct().count()
    digits = max(0, (files.bit_length() + 3) // 4)
    folders = [roots.select("side", "name", F.struct(F.col("file").alias("at"), F.concat("file", F.lit(":"), "sha").alias("sha")).alias("child"))]
    for d in range(digits, -1, -1):
        up = folders[-1].groupBy("side", F.substring("name", 1, d).alias("name") if d else F.lit("").alias("name")).agg(_hash(F.collect_list("child")).alias("sha"))
        folders.append(written(up.withColumn("child", F.struct(F.col("name").alias("at"), "sha")), "merkle"))
    bad = written(_unequal(folders[-1], ["name"]).select("name"), "merkle-bad")
    if bad.isEmpty():
        return None
    for d in range(1, digits + 1):
        above = F.substring("name", 1, d - 1) if d > 1 else F.lit("")
        under = folders[digits + 1 - d].withColumn("above", above).join(bad.select(F.col("name").alias("above")).distinct(), "above", "left_semi")
        bad = written(_unequal(under, ["name"]).select("name"), "merkle-bad")
    nodes = levels[-1].withColumn("name", F.substring(F.md5("file"), 1, digits) if digits else F.lit("")).join(bad.distinct(), "name", "left_semi")
    for level in range(len(levels) - 1, 0, -1):
        under = written(nodes.join(_unequal(nodes, ["file"]), ["file", "sha"], "left_semi").select("side", "file", F.col("node").alias("up"), F.col("part").alias("slice")), "merkle-bad")
        nodes = levels[level - 1].join(under, ["side", "file", "up", "slice"], "left_semi")
    return nodes


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in which replica b differs from a: file, page_id, url, offset, length, copies, fault, expected, found.

    fault: altered (other content under the same id and address), missing (only in a), extra (only in b). Offset and length
    are those in a, and those in b for what only b has. One row for each damaged record (or run of copies).
    """
    found = mismatching_records(a, b)
    x, y = (a.where(F.lit(False)), b.where(F.lit(False))) if found is None else (found.where(F.col("side") == s) for s in "ab")
    key = ["file", "page_id", "url"]

    def side(t: DataFrame, s: str) -> DataFrame:
        return t.groupBy(*key, "sha").agg(F.count("*").alias(f"n_{s}"), F.min("at").alias(f"at_{s}"), F.min("length").alias(f"length_{s}")).select(*[F.col(c).alias(f"{c}_{s}") for c in [*key, "sha"]], f"n_{s}", f"at_{s}", f"length_{s}")

    def same(names: list[str]) -> Column:
        out = F.lit(True)
        for c in names:
            out = out & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
        return out

    both = written(side(x, "a").join(side(y, "b"), same([*key, "sha"]), "full").withColumn("more", F.coalesce("n_a", F.lit(0)) - F.coalesce("n_b", F.lit(0))).where("more <> 0"), "warc-unequal")
    # what is left of an id and address on both sides is one altered record each, in the order of the offsets
    nth = lambda s: F.row_number().over(Window.partitionBy(*[f"{c}_{s}" for c in key]).orderBy(f"at_{s}", f"sha_{s}")).alias(f"nth_{s}")
    left = lambda s, d: both.where(d).select(*[f"{c}_{s}" for c in [*key, "sha", "at", "length"]], F.abs("more").alias(f"n_{s}"), nth(s))
    out = left("a", "more > 0").join(left("b", "more < 0"), same([*key, "nth"]), "full")
    either = lambda c, name=None: F.when(F.col("sha_a").isNull(), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(name or c)
    fault = F.when(F.col("sha_b").isNull(), "missing").when(F.col("sha_a").isNull(), "extra").otherwise("altered")
    return out.select(either("file"), either("page_id"), either("url"), either("at", "offset"), either("length"), either("n", "copies"), fault.alias("fault"), F.col("sha_a").alias("expected"), F.col("sha_b").alias("found"))
