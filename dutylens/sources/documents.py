"""Documents in, results out. What can't be read becomes a row with an error."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutylens.functions import lexicon as L
from dutylens.operators.ingest import suffix
from dutylens.sources.workers import use_workers

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paths_of(documents: object) -> list[str]:
    """One path or an iterable of paths; TypeError for anything else."""
    if isinstance(documents, str | os.PathLike):
        return [os.fspath(documents)]
    if not isinstance(documents, Iterable):
        raise TypeError("documents must be a path or an iterable of paths")
    out = list(documents)
    if bad := [d for d in out if not isinstance(d, str | os.PathLike)]:
        raise TypeError(f"not a path: {bad[0]!r}")
    return [os.fspath(d) for d in out]


def docx_text(content: bytes) -> str:
    """The paragraphs of the body, one per line; tables and headers are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
    marks = {W + "t": lambda e: e.text or "", W + "tab": lambda e: "\t", W + "br": lambda e: "\n", W + "cr": lambda e: "\n"}
    return "\n".join("".join(marks[e.tag](e) for e in p.iter() if e.tag in marks) for p in body.findall(W + "p"))


def pdf_text(content: bytes) -> str:
    """The text of each page, one after the other; needs the optional pypdf."""
    from pypdf import PdfReader

    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


def _binary(batches):
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"]):
            try:
                rows.append(((docx_text if path.lower().endswith(".docx") else pdf_text)(bytes(content)), None))
            except Exception as e:  # noqa: BLE001  one unreadable document must not end the job
                rows.append((None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame({"path": b["path"].tolist(), "raw": [r[0] for r in rows], "error": [r[1] for r in rows]})


def read_documents(spark: SparkSession, documents: object) -> DataFrame:
    """doc (place in the input), path, raw, error. Text is decoded as UTF-8, what is malformed becomes U+FFFD.

    Local paths are looked up first, so that a missing file, a folder or an unsupported suffix is an error row;
    paths with a scheme go to Spark as they are.
    """
    wanted = []
    for i, p in enumerate(paths_of(documents)):
        local, error = "://" not in p, None
        if local and not os.path.exists(p):
            error = f"FileNotFoundError: no such document: {p}"
        elif local and not os.path.isfile(p):
            error = f"ValueError: not a file: {p}"
        elif os.path.splitext(p)[1].lower() not in L.EXTENSIONS:
            error = f"UnsupportedDocumentType: {os.path.splitext(p)[1] or 'none'}"
        wanted.append((i, p, "file:" + os.path.abspath(p) if local else p, error))
    listed = spark.createDataFrame(wanted, "doc int, path string, uri string, error string")
    good = sorted({w[2] for w in wanted if not w[3]})
    if not good:
        return listed.select("doc", "path", F.lit(None).cast("string").alias("raw"), "error")
    files = spark.read.format("binaryFile").load(good).select("path", "content")
    is_text = suffix(F.col("path")).isin(".txt", ".md")
    text = files.where(is_text).select("path", F.col("content").cast("string").alias("raw"), F.lit(None).cast("string").alias("error"))
    use_workers(spark)
    other = files.where(~is_text).mapInPandas(_binary, "path string, raw string, error string")
    key = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")), "^file:/+", "/")
    read = text.unionByName(other).withColumnRenamed("error", "failed").withColumn("key", key(F.col("path"))).drop("path")
    both = listed.withColumn("key", F.regexp_replace("uri", "^file:/+", "/")).join(read, "key", "left")
    error = F.coalesce("error", "failed", F.when(F.col("raw").isNull(), F.lit("DocumentIngestionError: could not be read")))
    return both.select("doc", "path", F.when(error.isNull(), F.col("raw")).alias("raw"), error.alias("error"))


def warnings_of(documents: DataFrame) -> DataFrame:
    return documents.where("error is not null").select(F.format_string("[ingestion] document='%s': %s", "path", "error").alias("warning"))


def read_labels(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, all columns strings, a byte-order mark allowed."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), quote='"', escape='"', multiLine=True, encoding="UTF-8", enforceSchema=True)


def write_result(result, folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """The tables of a result as Parquet or JSON."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"results are written as parquet or json, not {fmt}")
    for name in ("policies", "obligations", "findings", "warnings", "statistics"):
        getattr(result, name).write.mode(mode).format(fmt).save(f"{folder}/{name}")


def check_upload(name: str, size: int) -> tuple[int, str] | None:
    """What an upload form answers before the engine runs: (HTTP status, message), or None if the file may go in."""
    base = os.path.basename(name.replace("\\", "/"))
    if os.path.splitext(base)[1].lower() not in L.EXTENSIONS:
        return 415, f"unsupported document type: {base}"
    if size == 0:
        return 422, f"empty document: {base}"
    return None


def staged_name(index: int, name: str) -> str:
    """The name under which an upload is put aside: without its folders, after its place."""
    return f"{index}-{os.path.basename(name.replace(chr(92), '/'))}"


def stage_uploads(uploads: Iterable[tuple[str, Iterable[bytes]]], folder: str) -> list[str]:
    """Put uploads (name, chunks of bytes) aside as files of a folder, whose paths are returned; ValueError says what a form would answer."""
    out = []
    for i, (name, chunks) in enumerate(uploads):
        if refused := check_upload(name, 1):
            raise ValueError(f"{refused[0]} {refused[1]}")
        os.makedirs(folder, exist_ok=True)
        path, size = os.path.join(folder, staged_name(i, name)), 0
        with open(path, "wb") as f:
            for chunk in chunks:
                size += f.write(chunk)
        if refused := check_upload(name, size):
            os.remove(path)
            raise ValueError(f"{refused[0]} {refused[1]}")
        out.append(path)
    if not out:
        raise ValueError("422 no documents")
    return out
