"""Most similar vectors by a hierarchical k-means tree with best-bin-first search (problem 2).

The tree is fitted on a bounded sample; every vector is then sent to the leaf its own best-bin-first descent
meets first. A query descends with a priority queue of nodes by distance to their centroids and visits
leaves in that order, as long as they are hardly farther than the first; how much farther is calibrated: sample
queries are answered by brute force over all vectors, and visits are widened until the leaves seen hold the
wanted share of the true neighbours. A leaf of any size is compared in cells of bounded numbers of rows and
queries, all of them, so nothing changes with its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import materialize

#: Vectors the tree is fitted on: at least SAMPLE (or all there are), LEAF_SAMPLE for every leaf of LEAF_ROWS rows, MAX_SAMPLE
#: at most. Large leaves keep the shuffle small: a query is sent to every leaf it visits, and comparing is a matrix product.
SAMPLE, MAX_SAMPLE, LEAF_ROWS, BRANCH, LEAF_SAMPLE = 40_000, 400_000, 8192, 24, 16
#: Queries of the calibration; rows and queries of a cell, about.
CALIBRATION, CELL_ROWS, CELL_QUERIES = 4000, 32_768, 131_072
#: Copies of one vector above which its ids are spread over several tasks.
HOT = 100_000


@dataclass
class Tree:
    """Nodes of a k-means tree: centroids, first child and number of children (0: leaf), leaf number or -1."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cell of each row) of unit vectors; empty cells are dropped."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        cell = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        size = np.linalg.norm(sums, axis=1)
        centres = (sums / np.maximum(size, 1e-12)[:, None])[size > 1e-12].astype(np.float32)
    cell = np.argmax(x @ centres.T, axis=1)
    used, cell = np.unique(cell, return_inverse=True)
    return centres[used], cell


def fit_tree(x: np.ndarray, leaf_size: int, seed: int = 5) -> Tree:
    """Hierarchical k-means over the rows of x until a node holds at most leaf_size of them."""
    rng = np.random.default_rng(seed)
    centres, first, count = [np.zeros(x.shape[1], dtype=np.float32)], [0], [0]
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop(0)
        if len(rows) <= leaf_size:
            continue
        k = min(BRANCH, max(2, math.ceil(len(rows) / leaf_size)))
        c, cell = kmeans(x[rows], k, rng)
        if len(c) < 2:
            continue
        first[node], count[node] = len(centres), len(c)
        for j in range(len(c)):
            todo.append((len(centres), rows[cell == j]))
            centres.append(c[j])
            first.append(0)
            count.append(0)
    counts = np.array(count)
    leaf = np.full(len(counts), -1)
    leaf[counts == 0] = np.arange(int((counts == 0).sum()))
    return Tree(np.array(centres, dtype=np.float32), np.array(first), counts, leaf)


def visit(tree: Tree, q: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """The first leaves each row of q meets, best bin first, and its squared distances to their centroids.

    There is one priority queue per row; the rows go in step.
    """
    leaves = min(leaves, tree.leaves)
    out = np.full((len(q), leaves), -1, dtype=np.int32)
    far = np.zeros((len(q), leaves), dtype=np.float32)
    for a in range(0, len(q), 512):
        part = q[a : a + 512]
        queue = np.full((len(part), len(tree.centres)), np.inf, dtype=np.float32)
        queue[:, 0] = 0
        seen = np.zeros(len(part), dtype=np.int64)
        rows = np.arange(len(part))
        while len(rows):
            node = np.argmin(queue[rows], axis=1)
            value = queue[rows, node]
            queue[rows, node] = np.inf
            is_leaf = tree.leaf[node] >= 0
            r, n = rows[is_leaf], node[is_leaf]
            out[a + r, seen[r]] = tree.leaf[n]
            far[a + r, seen[r]] = value[is_leaf]
            seen[r] += 1
            r, n = rows[~is_leaf], node[~is_leaf]
            for i in np.unique(n):
                at = r[n == i]
                kids = slice(tree.first[i], tree.first[i] + tree.count[i])
                queue[at, kids] = 2 - 2 * (part[at] @ tree.centres[kids].T)
            rows = rows[seen[rows] < leaves]
    return out, far


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as a binary column."""
    x = np.ascontiguousarray(x, dtype=np.float32)
    step = x.shape[1] * 4
    offsets = np.arange(0, (len(x) + 1) * step, step, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    return np.frombuffer(b"".join(values.to_pylist()), dtype=np.float32).reshape(len(values), dim)


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, vec): ids and their unit vectors, of the rows whose vector is usable.

    NULL vectors, vectors of another length, with NULL or non-finite numbers or of zero length are left out.
    """
    src = df.where(F.col(id_col).isNotNull() & (F.size(vector_col) == dim)).select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").cast("array<float>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = pc.list_flatten(b.column("v"))
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
            with np.errstate(all="ignore"):
                size = np.sqrt((x * x).sum(axis=1))
                good = np.isfinite(size) & (size > 0)
            x = x[good] / size[good][:, None]
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(good)), _binary(x)], ["id", "vec"])

    return src.mapInArrow(pack, "id string, vec binary")


def encode(x: np.ndarray) -> np.ndarray:
    """Vectors as 16-bit numbers relative to their largest component; cosines of codes are exact to about 1e-5."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.rint(x / np.maximum(top, 1e-30) * 32767).astype(np.int16)


def decode(codes: np.ndarray) -> np.ndarray:
    """Unit vectors of codes."""
    x = codes.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Index:
    """The usable vectors of a table and their tree.

    units has (id, vid, vec): vid numbers a vector, so copies share it. Copies are reduced to one per batch
    before anything is shuffled and to one per leaf after; ids come back at the end. cells has the numbers of row blocks and
    query blocks of each leaf, from the sample's shares.
    """

    def __init__(self, df: DataFrame, id_col: str = "chunk_id", vector_col: str = "content_vector", dim: int = 64, k: int = 5, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES) -> None:
        self.dim, self.k, self.id_col = dim, k, id_col
        self.units = materialize(unit_vectors(df, id_col, vector_col, dim).select("id", F.xxhash64("vec").alias("vid"), "vec"))
        self.n = self.units.count()
        self.sampled = self._sample(11, min(MAX_SAMPLE, max(sample, self.n // leaf_rows * LEAF_SAMPLE)))[1]
        leaf_size = max(LEAF_SAMPLE, int(leaf_rows * len(self.sampled) / self.n)) if self.n else 1
        self.tree = fit_tree(self.sampled, leaf_size)
        self.cell_rows, self.cell_queries = cell_rows, cell_queries

    def _sample(self, seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """vid and vector of rows of small id hash, at most size, on the driver."""
        bits = 1 << 30
        few = self.units.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(bits)) < int(bits * min(1.0, 0.95 * size / max(1, self.n)))) if self.n > size else self.units
        got = few.limit(size).select("vid", "vec").toArrow()
        order = np.argsort(got.column("vid").to_numpy(), kind="stable")
        return got.column("vid").to_numpy()[order], _matrix(got.column("vec"), self.dim)[order]

    def blocks(self, asked: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The queries (vid, vec) in blocks of at most about size, on the driver one after the other."""
        asked = materialize(asked.select("vid", "vec"))
        n = max(1, math.ceil(asked.count() / size * 1.2))
        for i in range(n):
            got = asked.where(F.pmod(F.xxhash64("vid"), F.lit(n)) == i).toArrow()
            yield got.column("vid").to_numpy(), _matrix(got.column("vec"), self.dim)

    def asked(self, queries: DataFrame) -> DataFrame:
        """(vid, vec) of the rows whose ids are in queries."""
        ids = queries.select(F.col(self.id_col).cast("string").alias("id")).distinct()
        return self.units.join(ids, "id", "left_semi").select("vid", "vec").dropDuplicates(["vid"])

    def _cells(self, leaves: int, gap: float, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of row blocks and of query blocks of each leaf; share is that of the vectors that are queries."""
        seen, far = visit(self.tree, self.sampled, leaves)
        scale = self.n / max(1, len(self.sampled))
        held = np.bincount(seen[:, 0], minlength=self.tree.leaves) * scale
        asks = np.bincount(seen[far - far[:, :1] <= gap], minlength=self.tree.leaves) * scale * share
        return (np.maximum(1, np.ceil(n / most)).astype(np.int64) for n, most in ((held, self.cell_rows), (asks, self.cell_queries)))

    def _packed(self, vectors: DataFrame, leaves: int, gap: float, base: bool, asks: bool, row_blocks: np.ndarray, query_blocks: np.ndarray) -> DataFrame:
        """(leaf, cell, role, vids, codes): the vectors of a batch that go to a cell, as two runs of bytes; role 1: queries, 2: rows, 3: both."""
        tree, dim = self.tree, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                vids, first = np.unique(b.column("vid").to_numpy(), return_index=True)
                x = _matrix(b.column("vec"), dim)[first]
                seen, far = visit(tree, x, leaves if asks else 1)
                codes = encode(x)
                row, turn = np.nonzero(far - far[:, :1] <= gap)
                leaf = seen[row, turn].astype(np.int64)
                kb, kq = row_blocks[leaf], query_blocks[leaf]
                own_b, own_q = vids[row] % kb, (vids[row] >> 17) % kq
                parts = []
                if asks:  # a query goes to its block of queries, against each block of rows
                    r = np.repeat(np.arange(len(row)), kb)
                    at = np.arange(len(r)) - np.repeat(np.cumsum(kb) - kb, kb)
                    both = base & (turn[r] == 0) & (at == own_b[r])
                    parts.append((row[r], leaf[r], at * kq[r] + own_q[r], np.where(both, 3, 1)))
                if base:  # a row goes to its block of rows, against each block of queries
                    home = np.flatnonzero(turn == 0)
                    r = np.repeat(home, kq[home])
                    at = np.arange(len(r)) - np.repeat(np.cumsum(kq[home]) - kq[home], kq[home])
                    new = ~((at == own_q[r]) & asks)
                    parts.append((row[r][new], leaf[r][new], (own_b[r] * kq[r] + at)[new], np.full(int(new.sum()), 2)))
                row, leaf, cell, role = (np.concatenate(p) for p in zip(*parts))
                order = np.lexsort((role, cell, leaf))
                row, leaf, cell, role = row[order], leaf[order], cell[order], role[order]
                ends = np.flatnonzero(np.diff(leaf) | np.diff(cell) | np.diff(role)) + 1
                starts = np.concatenate([[0], ends])
                runs = np.split(row, ends)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[starts].astype(np.int32)), pa.array(cell[starts]), pa.array(role[starts].astype(np.int32)), pa.array([vids[r].tobytes() for r in runs], pa.binary()), pa.array([codes[r].tobytes() for r in runs], pa.binary())], ["leaf", "cell", "role", "vids", "codes"])

        return vectors.select("vid", "vec").mapInArrow(run, "leaf int, cell long, role int, vids binary, codes binary")

    def brute_force(self, qid: np.ndarray, q: np.ndarray, min_cosine: float = -2.0, limit: int = 5000) -> DataFrame:
        """(q, b, cosine, leaf): the k most similar distinct vectors of each query, by full comparison.

        The queries (vids and vectors), at most limit, are sent to every task; larger sets go in blocks.
        """
        if len(q) > limit:
            raise ValueError(f"more than {limit} queries")
        tree, k, dim = self.tree, self.k, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and len(q):
                    ids, first = np.unique(b.column("vid").to_numpy(), return_index=True)
                    x = _matrix(b.column("vec"), dim)[first]
                    i, j, c = _best(q, qid, x, ids, k, min_cosine)
                    hit, at = np.unique(j, return_inverse=True)
                    leaf = visit(tree, x[hit], 1)[0][:, 0][at] if len(hit) else np.empty(0, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(ids[j]), pa.array(c.astype(np.float64)), pa.array(leaf.astype(np.int32))], ["q", "b", "cosine", "leaf"])

        found = self.units.select("vid", "vec").mapInArrow(run, "q long, b long, cosine double, leaf int")
        return self._top(found.groupBy("q", "b").agg(F.max("cosine").alias("cosine"), F.max("leaf").alias("leaf")))

    def _top(self, found: DataFrame, k: int | None = None) -> DataFrame:
        """The k best of each query."""
        w = Window.partitionBy("q").orderBy(F.desc("cosine"), "b")
        return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= (k or self.k)).drop("r")

    def calibrate(self, recall: float, min_cosine: float = -2.0, queries: int = CALIBRATION) -> tuple[int, float]:
        """(leaves, gap): how far to widen visits so that the given share of true neighbours of sample queries is met.

        gap is how much farther than the first leaf's centroid a leaf may be, leaves bounds the number of visits.
        """
        qid, q = self._sample(12, queries)
        qid, first = np.unique(qid, return_index=True)
        q = q[first]
        true = self.brute_force(qid, q, min_cosine).select("q", "leaf").toPandas()
        if true.empty:
            return min(4, self.tree.leaves), 4.0
        order, far = visit(self.tree, q, self.tree.leaves)
        turn, gap = np.empty_like(order), np.empty_like(far)
        np.put_along_axis(turn, order, np.arange(order.shape[1], dtype=order.dtype)[None, :].repeat(len(order), 0), axis=1)
        np.put_along_axis(gap, order, far - far[:, :1], axis=1)
        at = np.searchsorted(qid, true["q"].to_numpy()), true["leaf"].to_numpy()
        turns, gaps = turn[at], gap[at]
        widest = float(np.sort(gaps)[math.ceil(recall * len(gaps)) - 1]) + 1e-6
        return int(turns[gaps <= widest].max()) + 1, widest

    def search(self, leaves: int, gap: float, min_cosine: float = -2.0, queries: DataFrame | None = None, slack: int = 0) -> DataFrame:
        """(q, b, cosine): the most similar distinct vectors found for every query (all vectors by default), k + slack each.

        Cosines are those of the codes. Every pair is met in one cell only.
        """
        k, dim = self.k + slack, self.dim
        share = 1.0 if queries is None else queries.count() / max(1, self.n)
        blocks = tuple(self._cells(leaves, gap, share))
        rows = self._packed(self.units, leaves, gap, True, queries is None, *blocks)
        if queries is not None:
            rows = rows.unionByName(self._packed(queries, leaves, gap, False, True, *blocks))

        def run(table: pa.Table) -> pa.Table:
            role = table.column("role").to_numpy()
            vids, codes = table.column("vids").to_pylist(), table.column("codes").to_pylist()

            def read(kinds: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
                at = [i for i, r in enumerate(role) if r in kinds]
                ids, first = np.unique(np.frombuffer(b"".join(vids[i] for i in at), dtype=np.int64), return_index=True)
                return ids, decode(np.frombuffer(b"".join(codes[i] for i in at), dtype=np.int16).reshape(-1, dim)[first])

            (asks, q), (held, x) = read((1, 3)), read((2, 3))
            i, j, c = _best(q, asks, x, held, k, min_cosine)
            return pa.table({"q": pa.array(asks[i], pa.int64()), "b": pa.array(held[j], pa.int64()), "cosine": pa.array(c.astype(np.float64))})

        return self._top(rows.groupBy("leaf", "cell").applyInArrow(run, "q long, b long, cosine double"), k)

    def exact(self, found: DataFrame, queries: DataFrame) -> DataFrame:
        """found with cosines of the vectors themselves, the k best of each query; only the vectors named are shuffled."""
        one = queries.select(F.col("vid").alias("q"), F.col("vec").alias("qv"))
        other = self.units.select(F.col("vid").alias("b"), F.col("vec").alias("bv")).join(found.select("b").distinct(), "b", "left_semi").dropDuplicates(["b"])
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    c = (_matrix(b.column("qv"), dim).astype(np.float64) * _matrix(b.column("bv"), dim)).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("q"), b.column("b"), pa.array(c)], ["q", "b", "cosine"])

        both = found.select("q", "b").join(one, "q").join(other, "b").select("q", "b", "qv", "bv")
        return self._top(both.mapInArrow(run, "q long, b long, cosine double").withColumn("cosine", F.round("cosine", 7)))

    def neighbours(self, found: DataFrame, queries: DataFrame | None = None) -> DataFrame:
        """(id, neighbour, cosine, position): found vectors as ids; copies come first, ties by id.

        A vector stands for its k + 1 smallest ids; those of a vector with very many copies are spread over tasks.
        """
        limit = self.k + 1
        own_ids = self.units.select("vid", "id")
        w = Window.partitionBy("vid").orderBy("id")
        heads = own_ids.dropDuplicates() if queries is None else own_ids.join(queries.select("vid").union(found.select("b")).distinct(), "vid", "left_semi").dropDuplicates()
        heads = heads.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
        ids = materialize(heads.groupBy("vid").agg(F.sort_array(F.collect_list("id")).alias("ids")))
        copies = ids.where(F.size("ids") > 1)
        if queries is not None:
            copies = copies.join(queries.select("vid"), "vid", "left_semi")
        own = copies.select("vid", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cosine"))
        far = found.join(ids.withColumnRenamed("vid", "b"), "b").select(F.col("q").alias("vid"), F.explode("ids").alias("neighbour"), "cosine")
        w = Window.partitionBy("vid").orderBy(F.desc("cosine"), "neighbour")
        lists = own.unionByName(far).withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * limit).drop("r")
        # at most one row per HOT rows of the table
        hot = self.units.groupBy("vid").count().where(F.col("count") > HOT).select("vid", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
        salted = lists.join(F.broadcast(hot), "vid", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
        members = own_ids if queries is None else own_ids.join(queries.select("vid"), "vid", "left_semi")
        members = members.join(F.broadcast(hot), "vid", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        both = members.join(salted, ["vid", "salt"]).where("id <> neighbour").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
        w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
        return both.withColumn("position", F.row_number().over(w)).where(F.col("position") <= self.k)


def _best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of x and cosine of the k best rows of x for each row of q, itself excluded."""
    out = []
    for a in range(0, len(q), 512):
        for c in range(0, len(x), 8192):
            s = q[a : a + 512] @ x[c : c + 8192].T
            flat = np.flatnonzero(s >= least) if least > -1 else None
            if flat is not None and len(flat) <= 8 * len(s) * k:
                i, j = flat // s.shape[1], flat % s.shape[1]
            elif s.shape[1] > k + 1:
                j = np.argpartition(s, -k - 1, axis=1)[:, -k - 1 :]
                i, j = np.repeat(np.arange(len(s)), k + 1), j.ravel()
            else:
                i, j = (v.ravel() for v in np.indices(s.shape))
            v = s[i, j]
            good = (v >= least) & (qid[a + i] != ids[c + j])
            out.append((i[good] + a, j[good] + c, v[good]))
    if not out:
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.float32),)
    i, j, v = (np.concatenate(p) for p in zip(*out))
    order = np.lexsort((ids[j], -v, i))
    i, j, v = i[order], j[order], v[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
    return i[keep], j[keep], v[keep]


def similar_pairs(df: DataFrame, id_col: str = "chunk_id", vector_col: str = "content_vector", dim: int = 64, k: int = 5, min_cosine: float = 0.9, recall: float = 0.995) -> DataFrame:
    """(id_a, id_b): pairs of which at least one is among the other's k most similar and whose cosine is min_cosine or more.

    NULL, zero, non-finite vectors and those of another length take no part; repeated rows count once per id.
    Equal vectors rank by id, so of many copies each is paired with the k of smallest id. An empty table gives none.
    """
    index = Index(df, id_col, vector_col, dim, k)
    if not index.n:
        return df.sparkSession.createDataFrame([], "id_a string, id_b string")
    near = index.neighbours(index.search(*index.calibrate(recall, min_cosine), min_cosine))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "chunk_id", vector_col: str = "content_vector", dim: int = 64, k: int = 5, recall: float = 0.97) -> DataFrame:
    """(id, neighbour, cosine, position): k most similar vectors for the ids in queries, against all vectors.

    Ids without a usable vector give no rows; copies of a vector come first, ties by id; an empty table gives none.
    """
    index = Index(df, id_col, vector_col, dim, k)
    if not index.n:
        return df.sparkSession.createDataFrame([], "id string, neighbour string, cosine double, position int")
    asked = materialize(index.asked(queries))
    found = index.search(*index.calibrate(recall), queries=asked, slack=index.k)
    near = index.neighbours(index.exact(found, asked), queries=asked)
    return near.join(queries.select(F.col(id_col).cast("string").alias("id")).distinct(), "id", "left_semi").select("id", "neighbour", "cosine", "position")
