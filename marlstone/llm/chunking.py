"""Splitting oversized texts by content-defined chunking (problem 3).

Landmarks come from a rolling hash of the text itself: inside the window of allowed cut positions the
position of the smallest hash is taken, then moved to the nearest natural boundary of the strongest class
present near it. A cut thus depends on nearby characters and the previous cut only, so an edit changes the
pieces around it and the sequence falls into step again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_CHARS = 16
#: Cuts are sought between this share of the largest step (limit less overlap) and the largest step; the last piece adds that much too.
MIN_SHARE = 0.5
#: Natural boundaries, strongest first: paragraph, line, sentence, clause, blank.
BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?](?=\s)\s?|[。！？；…]+[”’」』）]?"),
    re.compile(r"[,;:](?=\s)\s?|[，、：]"),
    re.compile(r"\s+"),
]
#: A weaker boundary is taken when the stronger one is this many times farther from the landmark.
PULL = 4


def rolling_hash(text: str) -> np.ndarray:
    """Hash of the HASH_CHARS characters before each position 0..len."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    factor = 1
    for j in range(HASH_CHARS):
        n = len(codes) - j
        if n <= 0:
            break
        out[j + 1 :] += codes[:n] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces; each at most limit characters, neighbours share overlap characters."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    least = max(1, int((limit - overlap) * MIN_SHARE))
    marks = rolling_hash(text)
    bounds = [np.fromiter((m.end() for m in b.finditer(text)), dtype=np.int64) for b in BOUNDARIES]
    out, start, fresh = [], 0, 0
    while n - start > limit:
        # fresh: first character that no earlier piece holds
        low = max(fresh + 1, start + overlap + least)
        # the rest is not left shorter than the smallest step where this cut can avoid it
        high = min(start + limit, max(low, n - least))
        low = min(low, high)
        at = low + int(np.argmin(marks[low : high + 1]))
        best, best_cost = at, None
        for weight, ends in enumerate(bounds):
            a, b = np.searchsorted(ends, (low, high + 1))
            if a == b:
                continue
            k = a + int(np.argmin(np.abs(ends[a:b] - at)))
            cost = (abs(int(ends[k]) - at) + 1) * PULL**weight
            if best_cost is None or cost < best_cost:
                best, best_cost = int(ends[k]), cost
        out.append((start, best))
        fresh, start = best, best - overlap
    out.append((start, n))
    return out


def size_limit(sizes: Column, level: Column) -> Column:
    """The limit that holds at a level: first size without level, last beyond the end, NULL without sizes."""
    n = F.size(sizes)
    at = F.when(level.isNull() | (level < 0), F.lit(1)).when(level >= n, n).otherwise(level + 1)
    return F.when(sizes.isNotNull() & (n > 0), F.element_at(sizes, F.greatest(at, F.lit(1)).cast("int")))


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", sizes_col: str = "chunk_size", level_col: str = "chunk_level", overlap_col: str = "chunk_overlap") -> DataFrame:
    """Pieces (id, piece_no, n_pieces, start, end, size_limit, overlap, piece) of texts above their limit.

    Only oversized rows leave the JVM; they are split where they are, without a shuffle. NULL or empty texts
    and rows without a limit (no sizes, NULL or non-positive element) give no rows; a NULL or negative overlap
    is 0 and one of the limit or more counts as the limit less 1, else neighbours share exactly as many characters. Repeated rows are split once per row. Positions count
    code points; joining each piece without its leading shared characters gives the text again.
    """
    limit = size_limit(F.col(sizes_col), F.col(level_col))
    over = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), limit.alias("size_limit"), F.coalesce(F.col(overlap_col), F.lit(0)).cast("int").alias("overlap"))
    over = over.where((F.col("size_limit") > 0) & (F.length("text") > F.col("size_limit")))
    id_type = over.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, limit, overlap in zip(pdf["id"], pdf["text"], pdf["size_limit"], pdf["overlap"]):
                spans = cut_points(text, int(limit), int(overlap))
                last = 0
                for k, (a, b) in enumerate(spans):
                    rows.append((i, k, len(spans), a, b, limit, max(0, last - a), text[a:b]))
                    last = b
            yield pd.DataFrame(rows, columns=["id", "piece_no", "n_pieces", "start", "end", "size_limit", "overlap", "piece"])

    out = over.mapInPandas(cut, f"id {id_type}, piece_no int, n_pieces int, start int, end int, size_limit int, overlap int, piece string")
    return out.withColumnRenamed("id", id_col)
