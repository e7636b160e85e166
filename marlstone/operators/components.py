"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.skew import hot_keys, salted_join
from marlstone.session import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node of each connected component, for every node of a link.

    Alternating large-star and small-star steps: each round links nodes to the smallest neighbour known, so the
    number of rounds grows with the logarithm of the longest path. A node's neighbours are reduced by a
    pre-aggregating minimum and never gathered, and those of a node of very many are spread over tasks. Each round is written to the shared folder, so the lineage
    stays short; nothing but a count comes to the driver.
    """
    edges = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        large = salted_join(both, least.select("u", "m"), ["u"], hot_keys(least, ["u"], "n"), F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = large.where("u <> v").distinct()
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = salted_join(down, least.select("u", "m"), ["u"], hot_keys(least, ["u"], "n"), F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m"))
        edges = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
