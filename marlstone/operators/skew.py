"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key above which they are spread over several tasks.
HOT = 100_000


def hot_keys(counts: DataFrame, keys: list[str], count: str, limit: int | None = None) -> DataFrame:
    """(keys, __parts) of the keys of more than limit rows; at most one row per limit rows of the table, so it is broadcast."""
    limit = limit or HOT
    return F.broadcast(counts.where(F.col(count) > limit).select(*keys, F.ceil(F.col(count) / limit).cast("int").alias("__parts")))


def spread_rows(rows: DataFrame, hot: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """rows with __salt: the part of its key that a row falls into; 0 for keys that aren't hot."""
    at = rows.join(hot, keys, "left")
    return at.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")


def repeat_rows(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """rows once for every part of their key."""
    at = rows.join(hot, keys, "left")
    return at.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0))))).drop("__parts")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, by: Column, how: str = "inner", extra: list[str] | None = None) -> DataFrame:
    """Equi-join on keys (and extra columns) that aren't NULL; the rows of hot keys of big are spread by a column, those of small repeated."""
    return spread_rows(big, hot, keys, by).join(repeat_rows(small, hot, keys), [*keys, *(extra or []), "__salt"], how).drop("__salt")
