"""Approximate vector search: vectors filed under the nearest of a few thousand centroids, queries look into the nearest files."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.retrieve import ranked
from marlstone.session import materialize

#: Vectors the centroids are fitted on, at most; files, at most; rows of a file that one task compares.
SAMPLE, MOST_FILES, BLOCK = 40_000, 2_000, 65_536


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    flat = pc.list_flatten(values).to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _centroids(x: np.ndarray, n: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means; empty cells are dropped."""
    c = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        cell = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        c = _unit(sums[np.linalg.norm(sums, axis=1) > 1e-12])
    return c


@dataclass
class VectorIndex:
    """filed (id, vector, file, block), centroids, rows per file. A file of any size is compared in blocks."""

    filed: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", dim: int = 64, files: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> VectorIndex:
        """Fit on a bounded sample, file every usable vector (not NULL, of dim finite numbers, not all zero).

        files is about the square root of the rows by default. The driver gets the sample and a count per file.
        """
        v = F.col(vector_col)
        usable = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e300)) & F.exists(v, lambda x: x != 0)
        src = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(usable).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("vector"))
        n = src.count()
        if not n:
            return cls(src.withColumns({"file": F.lit(0), "block": F.lit(0)}), np.empty((0, dim)), np.empty(0, dtype=np.int64))
        few = src.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.95 * sample / n))) if n > sample else src
        x = _unit(_matrix(few.select("vector").limit(sample).toArrow().column("vector")))
        c = _centroids(x, max(1, min(files or math.isqrt(n), MOST_FILES, len(x))))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell = np.argmax(_unit(_matrix(b.column("vector"))) @ c.T, axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "file"])

        at = src.mapInArrow(assign, f"id {src.schema['id'].dataType.simpleString()}, vector array<double>, file int")
        filed = materialize(at.withColumn("salt", F.xxhash64("id")))
        sizes = np.zeros(len(c), dtype=np.int64)
        for r in filed.groupBy("file").count().collect():
            sizes[r["file"]] = r["count"]
        blocks = F.element_at(F.array(*[F.lit(int(-(-s // block)) or 1) for s in sizes]), F.col("file") + 1)
        return cls(filed.withColumn("block", F.pmod("salt", blocks).cast("int")).drop("salt"), c, sizes)

    def save(self, path: str) -> None:
        """The files as partitions, so a search reads only those it looks into, and the centroids."""
        self.filed.write.mode("overwrite").partitionBy("file").parquet(f"{path}/filed")
        spark = self.filed.sparkSession
        spark.createDataFrame([(i, c.tolist(), int(s)) for i, (c, s) in enumerate(zip(self.centroids, self.sizes))], "file int, centroid array<double>, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("file").collect()
        return cls(spark.read.parquet(f"{path}/filed"), np.array([r["centroid"] for r in rows]), np.array([r["rows"] for r in rows], dtype=np.int64))

    def search(self, queries: DataFrame, k: int, num_candidates: int | None = None, qid: str = "qid", query_vector: str = "vector", exclude_self: bool = False) -> DataFrame:
        """(qid, id, score, rank): the k best by cosine, score (1 + cosine) / 2, among the files that hold num_candidates (4k by default) vectors.

        A query looks into the nearest files until they hold that many; with as many candidates as vectors the result is
        exact. Each block of a file meets its queries in one task, which keeps the k best of each.
        """
        c, sizes, wanted = self.centroids, self.sizes, num_candidates or 4 * k
        id_type, q_type = self.filed.schema["id"].dataType.simpleString(), queries.schema[qid].dataType.simpleString()
        asked = queries.where(F.col(query_vector).isNotNull() & (F.size(query_vector) == (c.shape[1] or -1))).select(F.col(qid).alias("qid"), F.col(query_vector).cast("array<double>").alias("q"))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                order = np.argsort(-(_unit(_matrix(b.column("q"))) @ c.T), axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                row, at = np.nonzero(before < wanted)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("qid").take(take), b.column("q").take(take), pa.array(order[row, at].astype(np.int32))], ["qid", "q", "file"])

        looks = asked.mapInArrow(probe, f"qid {q_type}, q array<double>, file int") if len(c) else asked.withColumn("file", F.lit(0)).limit(0)
        places = self.filed.select(F.col("file").alias("f"), F.col("block").alias("p")).distinct()
        looks = looks.join(F.broadcast(places), F.col("file") == F.col("f")).select("qid", "q", "f", "p")  # at most MOST_FILES files and a block per BLOCK rows
        schema = f"qid {q_type}, id {id_type}, score double"

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if left.num_rows and right.num_rows:
                x, q = _unit(_matrix(left.column("vector"))), _unit(_matrix(right.column("q")))
                ids, names = left.column("id").combine_chunks(), right.column("qid").combine_chunks()
                for a in range(0, len(q), 512):
                    s = np.round((1 + q[a : a + 512] @ x.T) / 2, 6)
                    least = np.partition(s, -min(k + 1, len(x)), axis=1)[:, -min(k + 1, len(x))]
                    i, j = np.nonzero(s >= least[:, None])  # ties stay, so that the id decides
                    parts.append((i + a, j, s[i, j]))
                i, j, s = (np.concatenate(p) for p in zip(*parts))
                return pa.table({"qid": names.take(pa.array(i)), "id": ids.take(pa.array(j)), "score": pa.array(s)})
            return pa.table({"qid": right.column("qid").slice(0, 0), "id": left.column("id").slice(0, 0), "score": pa.array([], pa.float64())})

        found = self.filed.groupBy("file", "block").cogroup(looks.groupBy("f", "p")).applyInArrow(compare, schema)
        if exclude_self:
            found = found.where(F.col("qid") != F.col("id"))
        return ranked(found, k, ["qid"], "score", "id")
