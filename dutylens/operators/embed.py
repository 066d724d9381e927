"""Texts as vectors: signed feature hashing in columns by default, any encoder as a plug-in.

Feature hashing gives whole numbers, so a vector is kept as (places, counts, squared length) and cosines are exact up
to one division and one root. `dense` turns it into the unit vector.
"""

from __future__ import annotations

import hashlib
import re
import threading
from array import array
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutylens.functions.text import none_if_empty, strip
from dutylens.sources.scratch import written
from dutylens.sources.workers import use_workers

DIMENSION = 384
BATCH = 32
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Features whose place a worker keeps.
KNOWN = 100_000
VECTOR = "struct<idx: array<int>, val: array<int>, sq: bigint>"


def embedding_text(d: DataFrame | None = None) -> Column:
    """The parts of an obligation that say what it is about; modality and negation are left out on purpose."""
    parts = ["subject", "action", "object", "scope", "frequency", F.array_join("technology", " "), "condition", "exception"]
    return F.concat_ws(" | ", *[none_if_empty(strip(F.col(p) if isinstance(p, str) else p)) for p in parts])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def features(text: Column) -> Column:
    """Tokens and pairs of neighbours."""
    t = tokens(text)
    return _once(t, lambda t: F.concat(t, F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("::"), b))))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def hashed(feature: Column, dimension: int = DIMENSION) -> Column:
    """struct(place, sign) of one feature, from its SHA-256: 8 bytes for the place, the 9th for the sign."""
    def parts(h: Column) -> Column:
        place = F.pmod(F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(dimension)).cast("int")
        return F.struct(place.alias("place"), F.when(F.conv(F.substring(h, 17, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1).alias("sign"))

    return _once(F.sha2(feature, 256), parts)


def hash_vector(text: Column, dimension: int = DIMENSION) -> Column:
    """struct(idx, val, sq): places in order, summed signs, squared length."""
    total = lambda fs, k: F.aggregate(fs, F.lit(0), lambda a, x: a + F.when(x["place"] == k, x["sign"]).otherwise(0))

    def built(fs: Column) -> Column:
        idx = F.array_sort(F.array_distinct(F.transform(fs, lambda x: x["place"])))
        entries = F.filter(F.transform(idx, lambda k: F.struct(k.alias("k"), total(fs, k).alias("v"))), lambda e: e["v"] != 0)
        return _once(entries, lambda e: F.struct(
            F.transform(e, lambda x: x["k"]).alias("idx"), F.transform(e, lambda x: x["v"]).alias("val"),
            F.aggregate(e, F.lit(0).cast("long"), lambda a, x: a + x["v"] * x["v"]).alias("sq"),
        ))

    return _once(F.transform(features(text), lambda f: hashed(f, dimension)), built)


def with_hash_vectors(d: DataFrame, text: str, dimension: int = DIMENSION) -> DataFrame:
    """d with the column vector: hash_vector of a text column that has no nulls, in Arrow batches.

    Features that many texts share are hashed once per worker, where columns hash every one, and add up signs in the square of their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, places = re.compile(TOKEN).findall, {}
        for b in batches:
            at, idx, val, sq = array("i", [0]), array("i"), array("i"), array("q")
            for low in b.column(b.num_columns - 1).to_pylist():
                t, sums = find(low), {}
                for f in t + [f"{x}::{y}" for x, y in zip(t, t[1:])]:
                    p = places.get(f)
                    if p is None:
                        h = hashlib.sha256(f.encode()).digest()
                        p = places[f] = (int.from_bytes(h[:8], "big") % dimension, 1 - 2 * (h[8] % 2))
                    sums[p[0]] = sums.get(p[0], 0) + p[1]
                found = sorted((k, v) for k, v in sums.items() if v)
                idx.extend([k for k, _ in found])
                val.extend([v for _, v in found])
                sq.append(sum([v * v for _, v in found]))
                at.append(len(idx))
                if len(places) > KNOWN:
                    places.clear()
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (idx, val)]
            vector = pa.StructArray.from_arrays([*lists, pa.array(sq, pa.int64())], names=["idx", "val", "sq"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vector], names=[*b.schema.names[:-1], "vector"])

    use_workers(d.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    return d.withColumn("__low", F.lower(text)).mapInArrow(run, f"{kinds}, vector {VECTOR}")


def dense(v: Column, dimension: int = DIMENSION) -> Column:
    """The unit vector as array<float>; zeros for a text without tokens."""
    entries = F.map_from_arrays(v["idx"], v["val"])
    length = F.sqrt(v["sq"].cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.when(v["sq"] == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_element_at(entries, i), F.lit(0)) / length).cast("float"))


Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def devices() -> list[str]:
    """Where a model may be loaded, the best first."""
    try:
        import torch

        return ["cuda", "cpu"] if torch.cuda.is_available() else ["cpu"]
    except ImportError:
        return ["cpu"]


class ModelEncoder:
    """An encoder whose model is loaded by load(device) when it is first needed, once per process, on the first device that takes it.

    If none does, the process doesn't try again: every batch fails at once, and hashing takes over.
    """

    _lock = threading.Lock()
    _loaded: dict[str, Encoder | None] = {}
    _device: dict[str, str] = {}

    def __init__(self, name: str, load: Callable[[str], Encoder]) -> None:
        self.name, self.load = name, load

    def model(self) -> Encoder | None:
        with ModelEncoder._lock:
            if self.name not in ModelEncoder._loaded:
                ModelEncoder._loaded[self.name] = None
                for device in devices():
                    try:
                        ModelEncoder._loaded[self.name], ModelEncoder._device[self.name] = self.load(device), device
                        break
                    except Exception:  # noqa: BLE001  the next device may do
                        continue
            return ModelEncoder._loaded[self.name]

    def device(self) -> str:
        """The device of this process, or not-loaded."""
        return ModelEncoder._device.get(self.name, "not-loaded")

    def forget(self) -> None:
        """Let this process try again."""
        with ModelEncoder._lock:
            ModelEncoder._loaded.pop(self.name, None)
            ModelEncoder._device.pop(self.name, None)

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        model = self.model()
        if model is None:
            raise RuntimeError(f"model {self.name} can't be loaded")
        return model(texts)


def embed(obligations: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """obligations with embedding_text, backend, and vector (hashing) or embedding and embedding_error (an encoder).

    Hashing is done row by row, as a shuffle to hash each distinct text once costs more than to hash.
    encoder: each distinct text is encoded once, written, and joined back. It maps a batch of texts to vectors; it runs in Arrow batches on
    the executors, and where it fails the hashing takes over for that batch, in the encoder's dimension (column `backend` says which one
    made a vector, embedding_error why).
    """
    d = obligations.withColumn("embedding_text", embedding_text())
    if encoder is None:
        return with_hash_vectors(d, "embedding_text").withColumn("backend", F.lit("hashing"))
    texts = d.select("embedding_text").distinct()

    def run(batches):
        for b in batches:
            for s in range(0, len(b), BATCH):
                part, error = b["embedding_text"].iloc[s : s + BATCH].tolist(), None
                try:
                    found = [list(map(float, x)) for x in encoder(part)]
                    if len(found) != len(part):
                        raise ValueError(f"{len(found)} vectors for {len(part)} texts")
                except Exception as e:  # noqa: BLE001  a batch that can't be encoded is hashed
                    found, error = [None] * len(part), str(e).strip() or type(e).__name__
                yield pd.DataFrame({"embedding_text": part, "given": found, "embedding_error": [error] * len(part)})

    use_workers(d.sparkSession)
    given = written(texts.mapInPandas(run, "embedding_text string, given array<double>, embedding_error string"), "encoded")
    size = given.agg(F.max(F.size("given")).alias("n")).first()["n"] or 0
    made = given.withColumn("backend", F.when(F.col("given").isNull(), "hashing").otherwise("encoder"))
    length = F.sqrt(F.aggregate("given", F.lit(0.0), lambda a, x: a + x * x))
    dimension = size if size > 0 else DIMENSION
    made = made.withColumn("embedding", F.when(F.col("given").isNull(), dense(hash_vector(F.col("embedding_text"), dimension), dimension)).otherwise(F.transform("given", lambda x: F.when(length > 0, x / length).otherwise(0.0).cast("float"))))
    return d.join(made.drop("given"), "embedding_text")
