"""Vector expressions and the offline embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import ANALYZERS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where lengths differ or a vector has no length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def closeness(a: Column, b: Column) -> Column:
    """1 / (1 + Euclidean distance)."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.sqrt(d))


METRICS = {"cosine": cosine, "dot_product": dot, "euclidean": closeness}


def hash_embed(df: DataFrame, text_col: str, out_col: str = "content_vector", dim: int = 64, analyzer: str = "bigrams") -> DataFrame:
    """Deterministic embedding without a model: counts of term hashes, unit length. Empty or NULL text gives NULL.

    Terms and their hashes are made in the JVM; batches of term hashes are turned into vectors by NumPy.
    """

    slots = F.transform(ANALYZERS[analyzer](F.col(text_col)), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    kept = [c for c in df.columns if c != out_col]
    src = df.select(*kept, slots.alias("__slots"))
    schema = T.StructType([*[f for f in df.schema if f.name != out_col], T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = b.column(b.num_columns - 1)
            n = pc.fill_null(pc.list_value_length(slots), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            flat = pc.list_flatten(slots).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.bincount(row * dim + flat, minlength=len(n) * dim).reshape(len(n), dim)[n > 0].astype(np.float64)
            unit = (counts / np.linalg.norm(counts, axis=1, keepdims=True)).astype(np.float32)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, dim, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()), mask=pa.array(n == 0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*kept, out_col])

    return src.mapInArrow(embed, schema)


def embed_with(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], out_col: str = "content_vector", batch: int = 32, normalize: bool = True, retries: int = 3) -> DataFrame:
    """df with vectors of a model that is called on the workers, batch texts at a time.

    A vector stays with its row; blank and NULL texts aren't sent and give NULL. A failed call is tried again
    and raised at last. The last, smaller batch is sent as well.
    """
    kept = [c for c in df.columns if c != out_col]
    schema = T.StructType([*[f for f in df.schema if f.name != out_col], T.StructField(out_col, T.ArrayType(T.FloatType()))])
    src = df.select(*kept, F.col(text_col).alias("__text"))

    def call(texts: list[str]) -> list[list[float]]:
        for i in range(retries):
            try:
                got = model(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                return got
            except Exception:
                if i == retries - 1:
                    raise
        raise AssertionError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            out: list[list[float] | None] = [None] * len(texts)
            full = [i for i, t in enumerate(texts) if t and t.strip()]
            for at in range(0, len(full), batch):
                rows = full[at : at + batch]
                for i, v in zip(rows, call([texts[i] for i in rows])):
                    x = np.asarray(v, dtype=np.float64)
                    size = float(np.linalg.norm(x))
                    out[i] = (x / size if normalize and size else x).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.float32()))], [*kept, out_col])

    return src.mapInArrow(run, schema)
