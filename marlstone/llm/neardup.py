"""Near-duplicate texts by HyperMinHash (problem 4).

A text is the set of its character windows. Each of BUCKETS registers keeps, for the windows that fall into
it, the smallest hash as a count of leading zeros and a few mantissa bits. Bands of registers give candidate
pairs; their Jaccard index is estimated from the registers with a correction for chance collisions, and what
may reach the threshold is verified on the 64-bit hashes of all windows of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.lookalike import MAX_GROWTH, ODD, ScriptModel, consistent, digest, fit_scripts
from marlstone.operators.components import connected_components
from marlstone.operators.skew import hot_keys, salted_join
from marlstone.session import materialize

#: Registers of a sketch (four hash functions of 64 buckets), mantissa bits of a register.
HASHES, SLOTS, MANTISSA = 4, 64, 10
BUCKETS = HASHES * SLOTS
#: Registers of a band. A pair of similarity s misses all 42 bands with probability (1 - s**6)**42: 0.0003 at 0.75.
BAND = 6
EMPTY = np.uint16(0xFFFF)
#: Pairs are verified if their estimate is less than this far below the threshold (about 4.5 standard deviations at 0.75).
MARGIN = 0.12
#: Buckets larger than this are compared block by block on their sketches, in many tasks, instead of by a join.
JOIN_BUCKET, BLOCK = 64, 1024
#: Hashes of windows that a task keeps while it verifies pairs.
CACHED_WINDOWS = 2_000_000
# Fixed value: collision constant of the HyperMinHash paper (Yu and Weber, 2017).
COLLISION = 0.169919487159739093975


def normal(text: str, model: ScriptModel) -> str:
    """Consistent form in lower case, every run of white space one space."""
    return " ".join(consistent(text, model).lower().split())


def window_hashes(text: str, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the windows of width characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - width + 1
    if n <= 0:
        codes, n, width = codes, 1, len(codes)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        h = h * np.uint64(0x100000001B3) + codes[j : j + n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    return np.unique(h)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers (uint16): leading zeros above MANTISSA bits of the smallest hash of each bucket."""
    least = np.full(BUCKETS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(HASHES):
        h = hashes * np.uint64((0x94D049BB133111EB + 2 * k * 0x9FB21C651E98DF25) % 2**64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        np.minimum.at(least, (h >> np.uint64(58)).astype(np.int64) + k * SLOTS, h & np.uint64(0x03FFFFFFFFFFFFFF))
    filled = least != np.uint64(0xFFFFFFFFFFFFFFFF)
    v = np.maximum(least, np.uint64(1))
    top = np.floor(np.log2(v.astype(np.float64))).astype(np.int64)
    top -= (np.uint64(1) << top.astype(np.uint64)) > v  # the logarithm may round up
    zeros = np.minimum(57 - top, 62)
    shift = top - MANTISSA
    body = np.where(shift >= 0, v >> np.maximum(shift, 0).astype(np.uint64), v << np.maximum(-shift, 0).astype(np.uint64))
    reg = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (body & np.uint64((1 << MANTISSA) - 1))
    return np.where(filled, reg.astype(np.uint16), EMPTY)


def bands(registers: np.ndarray) -> np.ndarray:
    """64-bit key of each band; registers of one band come from all hash functions."""
    n = BUCKETS // BAND
    order = np.arange(BUCKETS).reshape(HASHES, SLOTS).T.ravel()[: n * BAND].reshape(n, BAND)
    key = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(BAND):
        key = (key ^ registers[order[:, j]].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(30)
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, less the expected chance collisions."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(axis=-1)
    n = np.maximum(1, used.sum(axis=-1))
    chance = COLLISION / (1 << MANTISSA) * n
    return (same - chance) / (n - chance)


def sketched_texts(df: DataFrame, id_col: str, text_col: str, width: int, min_chars: int, model: ScriptModel) -> DataFrame:
    """(id, text_id, text, windows, registers, keys) of the texts with min_chars characters in normal form, written once."""
    src = df.where(F.col(id_col).isNotNull() & (F.length(text_col) * MAX_GROWTH >= min_chars)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, raw in zip(pdf["id"], pdf["text"]):
                if len(raw) < min_chars and not ODD.search(raw):
                    continue
                t = normal(raw, model)
                if len(t) >= max(1, min_chars):
                    hashes = window_hashes(t, width)
                    regs = sketch(hashes)
                    rows.append((i, int.from_bytes(digest(t)[:8], "little", signed=True), t, len(hashes), regs.tobytes(), bands(regs)))
            yield pd.DataFrame(rows, columns=["id", "text_id", "text", "windows", "registers", "keys"])

    id_type = src.schema["id"].dataType.simpleString()
    return materialize(src.mapInPandas(run, f"id {id_type}, text_id long, text string, windows int, registers binary, keys array<bigint>"))


def _estimated(pairs: DataFrame, regs: DataFrame, least: float) -> DataFrame:
    """Pairs whose estimate is at least `least`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = np.frombuffer(b"".join(pdf["ra"]), dtype=np.uint16).reshape(len(pdf), BUCKETS)
            b = np.frombuffer(b"".join(pdf["rb"]), dtype=np.uint16).reshape(len(pdf), BUCKETS)
            yield pdf.loc[estimate(a, b) >= least, ["a", "b"]]

    one = pairs.join(regs.select(F.col("text_id").alias("a"), F.col("registers").alias("ra")), "a")
    both = one.join(regs.select(F.col("text_id").alias("b"), F.col("registers").alias("rb")), "b")
    return both.select("a", "b", "ra", "rb").mapInPandas(run, "a long, b long")


def _blocks(members: DataFrame, regs: DataFrame, least: float, threshold: float) -> DataFrame:
    """Pairs of large buckets, by blocks that many tasks compare.

    A block holds texts of one class of sizes: a pair of index `threshold` has sizes within that ratio, so only
    blocks of the same and of neighbouring classes meet.
    """
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    size_class = F.floor(F.log(F.col("windows").cast("double")) / float(-np.log(threshold)) + 1e-9).cast("long")
    own = F.struct(size_class.alias("c"), F.pmod(F.xxhash64("text_id", F.lit(3)), n_blocks).cast("int").alias("s"))
    cut = members.select("bucket", "text_id", n_blocks.alias("n"), own.alias("own"))
    cut = cut.select("*", F.explode(F.array(*[F.col("own.c") + d for d in (-1, 0, 1)])).alias("c"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s")).withColumn("other", F.struct("c", "s"))
    cut = cut.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("first"), "text_id").join(regs, "text_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["text_id"].to_numpy()
        regs = np.frombuffer(b"".join(pdf["registers"]), dtype=np.uint16).reshape(len(pdf), BUCKETS)
        alone = pdf["x"].iloc[0] == pdf["y"].iloc[0]
        side = pdf["first"].to_numpy()
        left, right = (np.arange(len(pdf)),) * 2 if alone else (np.flatnonzero(side), np.flatnonzero(~side))
        out = []
        for i in left:
            others = right[ids[right] > ids[i]] if alone else right
            good = others[estimate(regs[i], regs[others]) >= least]
            out.append(np.column_stack([np.minimum(ids[i], ids[good]), np.maximum(ids[i], ids[good])]))
        found = np.vstack(out) if out else np.empty((0, 2), dtype=np.int64)
        return pd.DataFrame(found, columns=["a", "b"])

    return cut.groupBy("bucket", "x", "y").applyInPandas(run, "a long, b long")


def similar_texts(texts: DataFrame, width: int, threshold: float, strict: bool) -> DataFrame:
    """(a, b, jaccard): verified pairs of different texts, by text_id, a < b; texts from sketched_texts."""
    regs = texts.select("text_id", "registers").dropDuplicates(["text_id"])
    keyed = texts.select("text_id", "windows", F.explode("keys").alias("bucket")).distinct()
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(keyed.join(sizes, "bucket"))
    least = threshold - MARGIN
    small = members.where(F.col("size") <= JOIN_BUCKET)
    a, b = (small.select("bucket", F.col("text_id").alias(n), F.col("windows").alias(f"w{n}")) for n in "ab")
    # the index is at most the ratio of the sizes
    pairs = a.join(b, "bucket").where((F.col("a") < F.col("b")) & (F.least("wa", "wb") >= threshold * F.greatest("wa", "wb"))).select("a", "b").distinct()
    candidates = _estimated(pairs, regs, least)
    large = members.where(F.col("size") > JOIN_BUCKET)
    if not large.isEmpty():
        candidates = candidates.unionByName(_blocks(large, regs, least, threshold)).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, cache, held = [], {}, 0
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                sets = []
                for key, t in ((a, ta), (b, tb)):
                    s = cache.get(key)
                    if s is None:
                        s = window_hashes(t, width)
                        if held + len(s) > CACHED_WINDOWS:
                            cache, held = {}, 0
                        cache[key] = s
                        held += len(s)
                    sets.append(s)
                both = len(np.intersect1d(*sets, assume_unique=True))
                j = both / (len(sets[0]) + len(sets[1]) - both)
                if j > threshold or not strict and j == threshold:
                    rows.append((a, b, j))
            yield pd.DataFrame(rows, columns=["a", "b", "jaccard"])

    full = texts.select("text_id", "text").dropDuplicates(["text_id"])
    with_a = candidates.join(full.select(F.col("text_id").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(full.select(F.col("text_id").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.select("a", "b", "ta", "tb").mapInPandas(verify, "a long, b long, jaccard double")


def near_duplicate_pairs(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", width: int = 7, threshold: float = 0.75, min_chars: int = 300, strict: bool = True, model: ScriptModel | None = None) -> DataFrame:
    """(id_a, id_b): all pairs of rows whose texts are equal or similar in normal form, the smaller id first.

    Texts are compared by their distinct windows of width characters: Jaccard index above threshold (or equal
    to it unless strict). NULL and short texts take no part; repeated rows count once per id. Equal texts are
    one text until the end; buckets of any size are compared whole.
    """
    texts = sketched_texts(df, id_col, text_col, width, min_chars, model or fit_scripts(df, [text_col]))
    links = similar_texts(texts, width, threshold, strict).select("a", "b")
    own = texts.select("id", "text_id").distinct()
    hot = hot_keys(own.groupBy("text_id").agg(F.count("*").alias("n")), ["text_id"], "n", 2000)
    # the rows of a text of many copies are spread, its links and the other side of its pairs repeated
    one = salted_join(own.withColumnRenamed("id", "x"), links.select(F.col("a").alias("text_id"), "b"), ["text_id"], hot, F.col("x"))
    far = salted_join(own.withColumnRenamed("id", "y"), one.select("x", F.col("b").alias("text_id")), ["text_id"], hot, F.col("y")).select("x", "y")
    same = salted_join(own.withColumnRenamed("id", "x"), own.withColumnRenamed("id", "y"), ["text_id"], hot, F.col("x")).where("x < y").select("x", "y")
    return far.unionByName(same).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", width: int = 7, threshold: float = 0.75, min_chars: int = 300, strict: bool = True, model: ScriptModel | None = None) -> DataFrame:
    """(id, text_id, links, group_id): every row that takes part, with its text, the text's links and its group.

    Groups are connected components of the links between different texts; copies share text and group. A text
    without links is a group of its own. group_id is the smallest text_id of the group.
    """
    texts = sketched_texts(df, id_col, text_col, width, min_chars, model or fit_scripts(df, [text_col]))
    links = materialize(similar_texts(texts, width, threshold, strict).select("a", "b"))
    groups = connected_components(links).select(F.col("node").alias("text_id"), F.col("component").alias("g"))
    counts = links.select(F.col("a").alias("text_id")).union(links.select("b")).groupBy("text_id").agg(F.count("*").alias("n"))
    own = texts.select(F.col("id").alias(id_col), "text_id").distinct()
    out = own.join(groups, "text_id", "left").join(counts, "text_id", "left")
    return out.select(id_col, "text_id", F.coalesce("n", F.lit(0)).alias("links"), F.coalesce("g", "text_id").alias("group_id"))
