"""Python workers import this package from the folder it stands in, or from an archive that Spark sends where that is not mounted."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from dutylens.sources.scratch import new_folder


def archive(package: str) -> bytes:
    """The package's Python files as a ZIP archive."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    return out.getvalue()


def use_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed."""
    sc = spark.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    had = sc.environment.get("PYTHONPATH", "")
    if root in had.split(os.pathsep):
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, had) if x)
    if not sc.master.startswith("local["):
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{new_folder(spark, 'package')}/dutylens.zip")
        store = path.getFileSystem(sc._jsc.hadoopConfiguration())
        stream = store.create(path)
        stream.write(archive(package))
        stream.close()
        sc.addPyFile(store.makeQualified(path).toString())
