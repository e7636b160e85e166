"""Running totals of groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import materialize, task_count


def running_totals(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, str | Column], parts: int | None = None) -> DataFrame:
    """df with one column per entry of sums: the group's running total up to and including the row.

    Rows are range-partitioned by group and order, so a group of any size is spread over many tasks; each
    task totals its own run, and the totals of earlier runs (at most one row per group and task) are added.
    order must be unique inside a group. Null groups form one group; null summands count as 0.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = parts or task_count(df)
    ranged = df.withColumns({f"__o{i}": k for i, k in enumerate(keys)} | {f"__s{i}": F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit(0)) for i, s in enumerate(sums.values())})
    names = [f"__o{i}" for i in range(len(keys))]
    ranged = materialize(ranged.repartitionByRange(parts, *group, *names).withColumn("__run", F.spark_partition_id()))
    local = Window.partitionBy(*group, "__run").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.withColumns({f"__t{i}": F.sum(f"__s{i}").over(local) for i in range(len(sums))})
    before = Window.partitionBy(*[f"__g{i}" for i in range(len(group))]).orderBy("__grun").rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__run").alias("__grun")).agg(*[F.sum(f"__s{i}").alias(f"__r{i}") for i in range(len(sums))])
    runs = runs.withColumns({f"__b{i}": F.coalesce(F.sum(f"__r{i}").over(before), F.lit(0)) for i in range(len(sums))})
    on = F.col("__run") == F.col("__grun")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = inner.join(runs, on, "left")
    return out.select(*df.columns, *[(F.col(f"__t{i}") + F.col(f"__b{i}")).alias(n) for i, n in enumerate(sums)])
