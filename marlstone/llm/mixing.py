"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (problem 8)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.tokens import byte_tokens
from marlstone.operators.prefix import running_totals
from marlstone.session import materialize

#: Tokens in a block (the unit that is dealt to output shards) and blocks in an output shard, about.
BLOCK_TOKENS, SHARD_BLOCKS = 1 << 16, 64
#: Most blocks of a mixture (a limit of the hypergeometric generator); larger mixtures are dealt in larger blocks.
MAX_BLOCKS = 500_000_000
#: Most rows the table of targets may have; it is read on the driver.
MAX_TARGETS = 100_000


@dataclass
class Mixture:
    """rows: the drawn documents by output shard; report: what each source was to give and gives."""

    rows: DataFrame
    report: DataFrame


def halve(counts: np.ndarray, a: int, b: int, seed: int) -> np.ndarray:
    """Blocks of each source that go to the left half of the shards a to b: a draw without replacement, the same whenever it is made."""
    left = int(counts.sum() * ((a + b) // 2 - a) // (b - a))
    return np.random.default_rng([seed, a, b]).multivariate_hypergeometric(counts, left, method="marginals")


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each output shard (shards x sources), exact in both directions.

    The vector of quotas is halved again and again; the left half is a multivariate-hypergeometric draw, so
    every arrangement of all blocks over the shards is equally likely. Each node has its own seed.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(np.asarray(quotas, dtype=np.int64), 0, shards)]
    while todo:
        counts, a, b = todo.pop()
        if b - a == 1:
            out[a] = counts
            continue
        draw = halve(counts, a, b, seed)
        todo += [(draw, a, (a + b) // 2), (counts - draw, (a + b) // 2, b)]
    return out


def shards_of(source: np.ndarray, at: np.ndarray, quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Output shard of each block (its source and its number in the source's permuted order).

    The tree of split_quotas is descended for the given blocks only; every node makes its draw from its own
    seed, so tasks agree without a table of the whole deal. Blocks that are near each other share nodes.
    """
    out = np.zeros(len(at), dtype=np.int64)
    none = np.zeros(len(quotas), dtype=np.int64)
    todo = [(np.asarray(quotas, dtype=np.int64), none, 0, shards, np.arange(len(at)))]
    while todo:
        counts, before, a, b, rows = todo.pop()
        if b - a == 1:
            out[rows] = a
            continue
        draw = halve(counts, a, b, seed)
        left = at[rows] < (before + draw)[source[rows]]
        for c, off, x, y, own in ((draw, before, a, (a + b) // 2, rows[left]), (counts - draw, before + draw, (a + b) // 2, b, rows[~left])):
            if len(own):
                todo.append((c, off, x, y, own))
    return out


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Callable[[Column], Column] = byte_tokens, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = 17) -> Mixture:
    """Draw documents so that each source gives target_share of total_tokens, each used max_repeat times at most.

    Documents of a source are put in a random order (a hash), numbered by running token totals and cut into
    blocks; whole passes over the source and one partial pass give its quota, up to one document. The blocks
    are dealt to output shards by split_quotas and the documents of a shard are shuffled by a hash. A source
    that holds too little gives all it may: it is short when every document was drawn max_repeat times and its
    tokens still don't reach the target. A document longer than a block leaves the blocks after it empty, so the
    tokens of a shard vary by the longest document. rows has mix_id, shard, position_key, source, id,
    repeat_no, n_tokens; report has one row per row of targets. Sources not in targets and documents without
    source take no part; NULL text counts as empty; NULL or negative shares and repeats count as 0. Sources of
    any size are ordered over many tasks; tasks find the shard of a document themselves, and the driver sees one
    row per mix and source only.
    """
    spark = docs.sparkSession
    wanted = targets.select("mix_id", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).alias("max_repeat"), F.greatest(F.coalesce("total_tokens", F.lit(0)), F.lit(0)).cast("long").alias("total_tokens"))
    wanted = wanted.where("mix_id IS NOT NULL AND source IS NOT NULL").dropDuplicates(["mix_id", "source"])
    plan = wanted.orderBy("mix_id", "source").take(MAX_TARGETS + 1)
    if len(plan) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    sized = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), tokens(F.col(text_col)).alias("n"))
    sized = sized.join(wanted.select("source").distinct(), "source", "left_semi")
    totals = running_totals(sized.withColumn("mixed", F.xxhash64("doc", F.lit(seed))), ["source"], ["mixed", "doc", F.monotonically_increasing_id()], {"upto": "n"})
    drawn_most = sum(r["target_share"] * r["total_tokens"] for r in plan)
    block_tokens = max(block_tokens, math.ceil(drawn_most / MAX_BLOCKS))
    ordered = materialize(totals.withColumn("block", F.floor((F.col("upto") - F.col("n")) / block_tokens)))
    have = {r["source"]: (r["tokens"], r["blocks"], r["docs"]) for r in ordered.groupBy("source").agg(F.sum("n").alias("tokens"), (F.max("block") + 1).alias("blocks"), F.count("*").alias("docs")).collect()}

    quotas = []
    for r in plan:
        avail, blocks, n_docs = have.get(r["source"], (0, 0, 0))
        want = r["target_share"] * r["total_tokens"]
        draw = min(want, float(avail * r["max_repeat"]))
        passes = int(draw // avail) if avail else 0
        part = draw - passes * avail if passes < r["max_repeat"] else 0.0
        quotas.append((r["mix_id"], r["source"], r["target_share"], r["max_repeat"], r["total_tokens"], want, avail, n_docs, blocks, passes, float(part)))
    schema = "mix_id int, source string, target_share double, max_repeat int, total_tokens long, target_tokens double, available_tokens long, available_docs long, blocks long, passes int, part double"
    quota = spark.createDataFrame(quotas, schema)

    taken = ordered.join(quota.select("mix_id", "source", "blocks", "passes", "part"), "source")
    partial = (F.col("upto") - F.col("n") / 2) < F.col("part")
    taken = taken.withColumn("times", F.col("passes") + partial.cast("int")).where("times > 0")
    taken = taken.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("times")))).withColumn("at", (F.col("repeat_no") - 1) * F.col("blocks") + F.col("block"))

    last = {(r["mix_id"], r["source"]): r["last"] for r in taken.groupBy("mix_id", "source").agg(F.max("at").alias("last")).collect()}
    deals = {}
    for m in sorted({r["mix_id"] for r in plan}):
        sources = [r["source"] for r in plan if r["mix_id"] == m]
        counts = np.array([last.get((m, s), -1) + 1 for s in sources], dtype=np.int64)
        deals[m] = (pa.array(sources, pa.string()), counts, max(1, math.ceil(counts.sum() / shard_blocks)), seed + m)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mixes, at = b.column("mix_id").to_numpy(), b.column("at").to_numpy()
            shard = np.zeros(len(at), dtype=np.int64)
            for m in np.unique(mixes):
                own = np.flatnonzero(mixes == m)
                sources, counts, shards, mix_seed = deals[int(m)]
                which = pc.index_in(b.column("source").take(pa.array(own)), value_set=sources).to_numpy()
                shard[own] = shards_of(which, at[own], counts, shards, mix_seed)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shard)], [*b.schema.names[:-1], "shard"])

    doc_type = taken.schema["doc"].dataType.simpleString()
    rows = taken.select("mix_id", "source", "doc", "repeat_no", "n", F.col("at").cast("long").alias("at")).mapInArrow(deal, f"mix_id int, source string, doc {doc_type}, repeat_no int, n long, shard long")
    rows = rows.select("mix_id", "shard", F.xxhash64("mix_id", "shard", "doc", "repeat_no", F.lit(seed)).alias("position_key"), "source", F.col("doc").alias(id_col), "repeat_no", F.col("n").alias("n_tokens"))

    drawn = rows.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.max("repeat_no").alias("most_repeats"), F.count("*").alias("drawn_docs"))
    all_drawn = drawn.groupBy("mix_id").agg(F.sum("drawn_tokens").alias("mix_tokens"))
    report = quota.select("mix_id", "source", "target_share", "max_repeat", "total_tokens", "target_tokens", "available_tokens", "available_docs").join(drawn, ["mix_id", "source"], "left").join(all_drawn, "mix_id", "left")
    report = report.withColumns({"drawn_tokens": F.coalesce("drawn_tokens", F.lit(0)), "most_repeats": F.coalesce("most_repeats", F.lit(0)), "drawn_docs": F.coalesce("drawn_docs", F.lit(0))})
    report = report.withColumn("actual_share", F.coalesce(F.round(F.col("drawn_tokens") / F.col("mix_tokens"), 9), F.lit(0.0))).drop("mix_tokens")
    spent = F.col("drawn_docs") == F.col("available_docs") * F.col("max_repeat")
    return Mixture(rows, report.withColumn("shortfall", spent & (F.col("drawn_tokens") < F.col("target_tokens"))))
