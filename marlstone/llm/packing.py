"""Filling fixed-capacity containers by sum-of-squares online packing (problem 7)."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.tokens import byte_tokens
from marlstone.session import materialize

#: Windows the fill levels of a container are counted in.
WINDOWS = 256
#: Work of one task: at most about this many tokens and items.
SHARD_TOKENS, SHARD_ITEMS = 1 << 26, 100_000
#: Containers filled less than this after the first round are offered to each other once more.
REOPEN_BELOW = 0.97
#: Most rows the table of specs may have; it is read on the driver.
MAX_SPECS = 1000


def sum_of_squares(sizes: np.ndarray, capacity: int, windows: int = WINDOWS) -> np.ndarray:
    """Container number of each item, placed in the given order; every size is between 1 and capacity.

    Each item goes where the sum of squared counts of partially filled containers per fill window becomes
    smallest; among equals into the fullest. A level array holds the counts, and per window a heap the fills.
    """
    windows = min(windows, capacity)
    width = capacity / windows
    last = windows - 1
    counts = np.zeros(windows + 1, dtype=np.int64)  # the last window and full containers weigh nothing
    least = np.full(windows + 1, np.inf)
    heaps: list[list[tuple[int, int]]] = [[] for _ in range(windows + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    opened, weight = 0, np.ones(windows + 1, dtype=np.int64)
    weight[last:] = 0
    for i, s in enumerate(sizes.tolist()):
        new_at = min(int(s / width), windows)
        best_cost, best = (2 * counts[new_at] + 1) * weight[new_at], -1
        fits = np.flatnonzero(least + s <= capacity)
        if len(fits):
            to = np.minimum(((least[fits] + s) / width).astype(np.int64), windows)
            cost = (1 - 2 * counts[fits]) * weight[fits] + (2 * counts[to] + 1) * weight[to]
            cost[to == fits] = 0
            k = len(fits) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= best_cost:
                best, target = int(fits[k]), int(to[k])
        if best < 0:
            fill, box, target = s, opened, new_at
            opened += 1
        else:
            fill, box = heapq.heappop(heaps[best])
            fill += s
            counts[best] -= 1
            least[best] = heaps[best][0][0] if heaps[best] else np.inf
        out[i] = box
        if fill < capacity:
            heapq.heappush(heaps[target], (fill, box))
            counts[target] += 1
            least[target] = heaps[target][0][0]
    return out


def _pack(items: DataFrame, shards: DataFrame) -> DataFrame:
    """items (capacity key, size, item) with a shard each -> box per item, by one task per spec and shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mixed", "item"], kind="stable")
        pdf["box"] = sum_of_squares(pdf["size"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pdf[["spec_id", "capacity", "shard", "item", "size", "box"]]

    placed = items.withColumn("mixed", F.xxhash64("item", F.lit(7))).join(shards, ["spec_id"])
    placed = placed.withColumn("shard", F.pmod("mixed", F.col("n_shards")).cast("int")).drop("n_shards")
    return placed.groupBy("spec_id", "shard").applyInPandas(run, "spec_id int, capacity int, shard int, item string, size int, box long")


def _shards(items: DataFrame, shard_tokens: int, shard_items: int) -> DataFrame:
    n = F.ceil(F.greatest(F.sum("size") / shard_tokens, F.count("*") / shard_items))
    return items.groupBy("spec_id").agg(F.greatest(n, F.lit(1)).cast("int").alias("n_shards"))


def pack(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Callable[[Column], Column] = byte_tokens, shard_tokens: int = SHARD_TOKENS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(spec_id, doc id, piece_no, n_pieces, token_start, token_count, capacity, container) for every document.

    Only ids and sizes are shuffled. Documents are spread over shards by hash, each shard is packed online by
    itself, and what stays below REOPEN_BELOW is packed once more as whole containers, in fewer shards. A document larger
    than the capacity is cut: whole capacities fill a container each, the rest is placed like any document. The
    shard count follows the data and every spec has its own. NULL text counts as empty (one token); specs with
    NULL or non-positive capacity, and documents without id, give no rows; repeated rows are placed each.
    """
    # the number is stored with the row, so that repeated rows are told apart the same way each time they are read
    sized = materialize(docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("n")).where("doc IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    repeated = sized.groupBy("doc").agg(F.count("*").alias("times")).where("times > 1").select("doc", F.lit("#").alias("mark"))
    sized = materialize(sized.join(repeated, "doc", "left").select("doc", "n", F.concat("mark", F.col("row").cast("string")).alias("copy")))
    spec = specs.select("spec_id", "capacity").where("capacity > 0 AND spec_id IS NOT NULL").dropDuplicates(["spec_id"]).orderBy("spec_id").take(MAX_SPECS + 1)
    if len(spec) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    kinds = F.array(*[F.struct(F.lit(r["spec_id"]).cast("int").alias("spec_id"), F.lit(r["capacity"]).cast("int").alias("capacity")) for r in spec])
    kinds = kinds if spec else F.array().cast("array<struct<spec_id:int,capacity:int>>")
    all_docs = sized.select("doc", "n", "copy", F.inline(kinds))
    pieces = all_docs.withColumn("n_pieces", F.ceil(F.col("n") / F.col("capacity")).cast("int")).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    pieces = pieces.withColumn("token_start", F.col("piece_no").cast("long") * F.col("capacity"))
    pieces = pieces.withColumn("size", F.least(F.col("capacity").cast("long"), F.col("n") - F.col("token_start")).cast("int"))
    pieces = pieces.withColumn("item", F.concat(F.concat_ws("/", F.col("doc").cast("string"), F.col("piece_no").cast("string")), F.coalesce("copy", F.lit(""))))
    full = pieces.where(F.col("size") == F.col("capacity")).withColumn("container", F.concat(F.lit("d"), F.col("item")))
    rest = pieces.where(F.col("size") < F.col("capacity"))

    first = materialize(_pack(rest.select("spec_id", "capacity", "item", "size"), _shards(rest, shard_tokens, shard_items)))
    first = first.withColumn("container", F.concat_ws("-", F.lit("c"), F.col("shard").cast("string"), F.col("box").cast("string")))
    boxes = first.groupBy("spec_id", "capacity", F.col("container").alias("item")).agg(F.sum("size").cast("int").alias("size"))
    open_ = boxes.where(F.col("size") < F.col("capacity") * REOPEN_BELOW)
    again = _pack(open_, _shards(open_, shard_tokens, shard_items))
    again = again.select("spec_id", F.col("item").alias("container"), F.concat_ws("-", F.lit("r"), F.col("shard").cast("string"), F.col("box").cast("string")).alias("joined"))
    placed = first.join(again, ["spec_id", "container"], "left").select("spec_id", "item", F.coalesce("joined", "container").alias("container"))
    numbered = rest.join(placed, ["spec_id", "item"])
    cols = ["spec_id", F.col("doc").alias(id_col), "piece_no", "n_pieces", "token_start", F.col("size").alias("token_count"), "capacity", "container"]
    return full.select(*cols).unionByName(numbered.select(*cols))


def fill_report(packed: DataFrame) -> DataFrame:
    """(spec_id, capacity, containers, tokens, fill): how full the containers of each spec are."""
    box = packed.groupBy("spec_id", "capacity", "container").agg(F.sum("token_count").alias("t"))
    return box.groupBy("spec_id", "capacity").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count("*") * F.first("capacity")), 6).alias("fill"))
