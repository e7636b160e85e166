"""Reranking of hits by vectors, models or model answers."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import first_number, rank_list
from marlstone.functions.vectors import METRICS


def keep_top(df: DataFrame, k: int, threshold: float | None = 0.0, score: str = "rerank_score") -> DataFrame:
    """Rows at or above the threshold, the k best per query with their rank."""
    good = df.where(F.col(score) >= threshold) if threshold is not None else df
    w = Window.partitionBy("qid").orderBy(F.desc(score), "id")
    return good.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_embedding(hits: DataFrame, query_vector: str, vector: str, k: int = 10, metric: str = "cosine", threshold: float | None = 0.0) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return keep_top(hits.withColumn("rerank_score", F.round(METRICS[metric](F.col(query_vector), F.col(vector)), 6)), k, threshold)


def by_list(hits: DataFrame, answers: DataFrame, k: int = 10) -> DataFrame:
    """Order of a model's list (qid, answer); hits it leaves out follow in their order; no list keeps the order."""
    at = hits.join(answers.select("qid", rank_list(F.col("answer")).alias("order")), "qid", "left")
    place = F.array_position("order", (F.col("rank") - 1).cast("int"))
    place = F.when(place > 0, place).otherwise(F.lit(1_000_000) + F.col("rank"))
    w = Window.partitionBy("qid").orderBy("place", "id")
    return at.withColumn("place", place).withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).drop("order", "place")


def by_position(hits: DataFrame, answers: DataFrame, k: int = 10) -> DataFrame:
    """Score 1 - 0.1 * place in a model's list, 0.1 for hits it leaves out."""
    at = hits.join(answers.select("qid", rank_list(F.col("answer")).alias("order")), "qid", "left")
    place = F.array_position("order", (F.col("rank") - 1).cast("int"))
    return keep_top(at.withColumn("rerank_score", F.round(F.when(place > 0, 1 - 0.1 * (place - 1)).otherwise(0.1), 6)).drop("order"), k, None)


def by_score_answer(hits: DataFrame, answer: str, k: int = 10, threshold: float | None = 0.0) -> DataFrame:
    """Score is the first number of a model's answer per hit."""
    return keep_top(hits.withColumn("rerank_score", first_number(F.col(answer))), k, threshold)


def by_comparison(hits: DataFrame, better: Callable[[str, str, str], bool], k: int = 10, query: str = "query", content: str = "content") -> DataFrame:
    """Pairwise: better(query, a, b) says whether a beats b. One query's hits (top k of a search) are one group."""
    schema = f"qid {hits.schema['qid'].dataType.simpleString()}, id {hits.schema['id'].dataType.simpleString()}, new_rank int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("rank").itertuples(index=False))
        rows.sort(key=cmp_to_key(lambda a, b: -1 if better(getattr(a, query), getattr(a, content), getattr(b, content)) else 1 if better(getattr(a, query), getattr(b, content), getattr(a, content)) else 0))
        return pd.DataFrame([(r.qid, r.id, i + 1) for i, r in enumerate(rows[:k])], columns=["qid", "id", "new_rank"])

    order = hits.select("qid", "id", "rank", query, content).groupBy("qid").applyInPandas(run, schema)
    return hits.join(order, ["qid", "id"])


def by_service(hits: DataFrame, answers: DataFrame, k: int = 10, pad: bool = True) -> DataFrame:
    """Order and scores of a rerank service's JSON answer per query: results or data with index and relevance_score or score, or rankings.

    The answer's order holds. Hits it leaves out follow in theirs, up to k, unless pad is off; without an answer that can be
    read the hits stay as they are. Indexes beyond the hits are passed over.
    """
    item = "array<struct<index:int,relevance_score:double,score:double>>"
    parsed = answers.select("qid", F.from_json("answer", f"struct<results:{item},data:{item},rankings:array<int>>").alias("j"))
    given = F.coalesce(F.when(F.size("j.results") > 0, F.col("j.results")), F.when(F.size("j.data") > 0, F.col("j.data")))
    scored = F.transform(given, lambda x, n: F.struct(n.alias("p"), x["index"].alias("i"), F.coalesce(x["relevance_score"], x["score"]).alias("s")))
    places = F.transform(F.col("j.rankings"), lambda x, n: F.struct(n.alias("p"), x.alias("i"), (1 - 0.1 * n).alias("s")))
    lists = parsed.select("qid", F.coalesce(scored, places).alias("list"))
    each = lists.select(F.col("qid").alias("__q"), F.inline("list")).groupBy("__q", "i").agg(F.min("p").alias("p"), F.min_by("s", "p").alias("s"))
    at = hits.join(each, (F.col("qid") == F.col("__q")) & (F.col("rank") - 1 == F.col("i")), "left").drop("__q", "i").withColumnRenamed("s", "rerank_score")
    if not pad:
        read = lists.where(F.size("list") > 0).select("qid", F.lit(True).alias("__read"))
        at = at.join(read, "qid", "left").where(F.col("__read").isNull() | F.col("p").isNotNull()).drop("__read")
    w = Window.partitionBy("qid").orderBy(F.asc_nulls_last("p"), "rank")
    return at.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).drop("p")


def rerank_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, documents_before, documents_after) of a reranking; queries that lost all hits have 0 after."""
    count = lambda df, name: df.groupBy("qid").agg(F.count("*").alias(name))
    both = count(before, "documents_before").join(count(after, "documents_after"), "qid", "left")
    return both.select("qid", "documents_before", F.coalesce("documents_after", F.lit(0)).alias("documents_after"))


class RateLimit:
    """At most n calls in any `seconds` seconds of one task; more wait."""

    def __init__(self, n: int, seconds: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.n, self.seconds, self.clock, self.sleep = n, seconds, clock, sleep
        self.times: deque[float] = deque()

    def wait(self) -> None:
        now = self.clock()
        while self.times and now - self.times[0] >= self.seconds:
            self.times.popleft()
        if len(self.times) >= self.n:
            self.sleep(self.seconds - (now - self.times[0]))
            self.times.popleft()
            now = self.clock()
        self.times.append(now)


def ask(df: DataFrame, prompt: str, model: Callable[[str], str], out: str = "answer", retries: int = 3, fail_open: bool = False, per_second: int | None = None) -> DataFrame:
    """df with a model's answer per row; model runs on the workers.

    A failed call is tried again and raised at last, or gives NULL with fail_open, so that what follows keeps its
    input. per_second limits the calls of each task.
    """

    @F.pandas_udf("string")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        limit = RateLimit(per_second) if per_second else None

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            for i in range(retries):
                try:
                    if limit:
                        limit.wait()
                    return model(text)
                except Exception:
                    if i == retries - 1 and not fail_open:
                        raise
            return None

        for s in parts:
            yield s.map(one)

    return df.withColumn(out, call(F.col(prompt)))
