"""Statistics of an index, of hits and of ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def docs_per_value(df: DataFrame, col: str, top: int | None = 10) -> DataFrame:
    """(col, docs): rows per value, most first; NULL is a value of its own."""
    out = df.groupBy(col).agg(F.count("*").alias("docs"))
    return out.orderBy(F.desc("docs"), F.asc_nulls_first(col)).limit(top) if top else out


def distinct_values(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(col) if approximate else F.countDistinct(col)).cast("long").alias("n"))


def index_stats(df: DataFrame, vector_col: str = "content_vector", text_col: str = "content") -> DataFrame:
    """One row: rows, rows with and without vector, characters and megabytes (of 2**20 bytes) of text."""
    has = F.col(vector_col).isNotNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(has).alias("with_vector"), F.count_if(~has).alias("without_vector"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("characters"), F.round(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)) / (1 << 20), 4).alias("megabytes"))


def describe_columns(df: DataFrame) -> DataFrame:
    """(position, name, type, is_vector) of the columns."""
    rows = [(i, f.name, f.dataType.simpleString(), f.dataType.simpleString() in ("array<float>", "array<double>")) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, is_vector boolean")


def length_stats(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    n = F.length(col)
    return df.groupBy(*(by or [])).agg(F.count(col).alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 4).alias("mean"))


def score_stats(hits: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Largest, smallest and mean score and how many hits came from each branch."""
    came = lambda s: F.count_if(F.col("recall_source") == s)
    return hits.groupBy(*by).agg(F.count("*").alias("hits"), F.round(F.max(score), 6).alias("max_score"), F.round(F.min(score), 6).alias("min_score"), F.round(F.avg(score), 6).alias("avg_score"), came("text").alias("from_text"), came("vector").alias("from_vector"), came("hybrid").alias("from_hybrid"))


def ingest_throughput(runs: DataFrame) -> DataFrame:
    """(status, runs, files, read, produced, consumed, lost, seconds, mean, longest, shortest, tps) by cleaned status.

    lost is what was produced and not consumed; runs without time count no seconds.
    """
    status = F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("unknown"))
    out = runs.groupBy(status.alias("status")).agg(F.count("*").alias("runs"), F.sum("total_files_read").alias("files"), F.sum("total_data_read").alias("read"), F.sum("total_data_produced").alias("produced"), F.sum("total_data_consumed").alias("consumed"), F.sum(F.greatest(F.col("total_data_produced") - F.col("total_data_consumed"), F.lit(0))).alias("lost"), F.round(F.sum("total_time"), 3).alias("seconds"), F.round(F.avg("total_time"), 3).alias("mean"), F.max("total_time").alias("longest"), F.min("total_time").alias("shortest"), F.sum(F.when(F.col("total_time") > 0, F.col("total_data_consumed"))).alias("timed"))
    return out.withColumn("tps", F.round(F.col("timed") / F.nullif(F.col("seconds"), F.lit(0.0)), 3)).drop("timed")


def counted(df: DataFrame, name: str = "documents") -> tuple[DataFrame, Observation]:
    """df and an observation of its rows, read from .get after the table was written; no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("document_count")), seen


def requests_in_window(events: DataFrame, ts: str, by: list[str], seconds: float = 1.0, limit: int | None = None) -> DataFrame:
    """events with in_window: rows of the same group in the seconds up to and including this one; over_limit if limit is given.

    Time is cut into spans, so a group of any size is counted by many tasks; a row near the end of a span is
    seen by the next span too, but counted there only for others. Rows without time are counted among themselves.
    """
    reach = int(seconds * 1_000_000)
    span = 64 * reach
    at = events.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__span", F.floor(F.col("__us") / span))
    late = F.col("__us") - F.col("__span") * span >= span - reach
    both = at.withColumn("__own", F.lit(True)).unionByName(at.where(late).withColumns({"__span": F.col("__span") + 1, "__own": F.lit(False)}))
    w = Window.partitionBy(*by, "__span").orderBy("__us").rangeBetween(-reach + 1, 0)
    out = both.withColumn("in_window", F.count("*").over(w)).where("__own").drop("__us", "__span", "__own")
    return out.withColumn("over_limit", F.col("in_window") > limit) if limit is not None else out


def synthetic_documents(spark, n: int, dim: int = 1024, seed: int = 42) -> DataFrame:
    """n load-test documents: content of 10 to 66 words, a vector of numbers from 0 to 1, category, priority, timestamp; the same for a seed."""
    # Our own vocabulary of 22 words and the categories.
    words = "index query shard vector ranking parser token corpus cluster replica segment cache schema filter batch stream latency recall metric planner window merge".split()
    categories = ["guide", "report", "note", "manual"]
    pick = lambda values, r: F.element_at(F.array(*map(F.lit, values)), (r % len(values)).cast("int") + 1)
    # a linear congruence per place: plain integers, so any engine gives the same
    draw = lambda i, salt: ((F.col("id") * 48271 + i * 16807 + salt * 69621 + 12345) % 2147483647) * 16807 % 2147483647
    size = (draw(F.lit(0), seed) % 57 + 10).cast("int")
    return spark.range(n).select(
        F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("doc_id"),
        F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: pick(words, draw(i, seed + 1))), " ").alias("content"),
        F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (draw(i, seed + 2) / 2147483647.0).cast("float")).alias("content_vector"),
        pick(categories, draw(F.lit(1), seed + 3)).alias("category"),
        (draw(F.lit(2), seed + 4) % 5 + 1).cast("int").alias("priority"),
        F.current_timestamp().alias("timestamp"),
    )
