"""One ranking from scores of different scales by outranking net flow (problem 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.prefix import running_totals

LOWEST = float("-inf")
#: Rows of a group up to which one task sorts it; larger groups are spread by range. Both ways give the same flows.
LARGE = 200_000
#: Items of one large group that share a value, above which they are spread over several tasks.
HOT = 100_000


def percentiles(counts: DataFrame, group: list[str]) -> DataFrame:
    """counts (group, value, cnt) with upto, n and pct: the mid-rank percentile of every distinct value."""
    upto = running_totals(counts, group, ["value"], {"upto": "cnt"})
    total = counts.groupBy(*[F.col(g).alias(f"__t{i}") for i, g in enumerate(group)]).agg(F.sum("cnt").alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__t{i}")) for i, g in enumerate(group)])
    out = upto.join(total, same).drop(*[f"__t{i}" for i in range(len(group))])
    return out.withColumn("pct", (2 * F.col("upto") - F.col("cnt")) / (2.0 * F.col("n")))


def net_flow(pcts: DataFrame, group: list[str], indifference: float, preference: float) -> DataFrame:
    """(group, value, flow, cnt): mean over the other items of preference for minus preference against.

    A percentile lead d counts 0 up to indifference, rises linearly and counts 1 from preference on. All pairs
    of a group are covered by prefix sums over its sorted percentiles: a value asks for the number and the sum of
    the percentiles up to the four places where the preference bends; no pair is formed.
    """
    x, n, c = F.col("pct"), F.col("n"), F.col
    q, p = float(indifference), float(preference)
    data = pcts.select(*group, x.alias("at"), F.lit(0).alias("kind"), F.lit(LOWEST).alias("value"), "cnt", (c("cnt") * x).alias("mass"), x.alias("own"), n.alias("n"), F.lit(0).cast("long").alias("held"))
    places = {1: -p, 2: -q, 3: q, 4: p} if q else {1: -p, 2: 0.0, 4: p}  # without indifference two places are one
    probes = [pcts.select(*group, (x + d).alias("at"), F.lit(k).alias("kind"), "value", F.lit(0).cast("long").alias("cnt"), F.lit(0.0).alias("mass"), x.alias("own"), n.alias("n"), c("cnt").alias("held")) for k, d in places.items()]
    events = reduce(DataFrame.unionByName, probes, data)
    summed = running_totals(events, group, ["at", "kind", "own"], {"a": "cnt", "b": "mass"}).where("kind > 0")
    pick = lambda col, k: F.max(F.when(c("kind") == (k if k in places else 2), c(col)))
    at = summed.groupBy(*group, "value", "own", "n", "held").agg(*[pick(col, k).alias(f"{col}{k}") for col in "ab" for k in (1, 2, 3, 4)])
    plus = c("a1") + ((c("own") - q) * (c("a2") - c("a1")) - (c("b2") - c("b1"))) / (p - q)
    minus = (c("n") - c("a4")) + ((c("b4") - c("b3")) - (c("own") + q) * (c("a4") - c("a3"))) / (p - q)
    return at.select(*group, "value", F.when(c("n") > 1, (plus - minus) / (c("n") - 1)).otherwise(F.lit(0.0)).alias("flow"), c("held").alias("cnt"))


def _windowed(best: DataFrame, weights: list[float], indifference: float, preference: float) -> DataFrame:
    """best (__g, __item, __s0, ...) with flow: the prefix sums as ranges of sorted windows, one exchange for all scores."""
    out, flow = best, F.lit(0.0)
    n = F.count("*").over(Window.partitionBy("__g")).alias("n")
    out = out.select("*", n, *[F.coalesce(F.col(f"__s{i}"), F.lit(LOWEST)).alias(f"v{i}") for i in range(len(weights))])
    for i in range(len(weights)):
        by_value = Window.partitionBy("__g").orderBy(f"v{i}")
        upto = F.count("*").over(by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        ties = F.count("*").over(by_value.rangeBetween(Window.currentRow, Window.currentRow))
        out = out.withColumn(f"p{i}", (2 * upto - ties) / (2.0 * F.col("n")))
    q, p = float(indifference), float(preference)
    for i, w in enumerate(weights):
        over = lambda what, frm, to: F.expr(f"coalesce(sum({what}) OVER (PARTITION BY __g ORDER BY p{i} RANGE BETWEEN {frm} AND {to}), 0)")  # noqa: E731, B023
        x = F.col(f"p{i}")
        # ahead of x by more than q and up to p: the slope; beyond p: 1 each
        far_below, far_above = over("1D", "UNBOUNDED PRECEDING", f"{p!r}D PRECEDING"), over("1D", f"{p!r}D FOLLOWING", "UNBOUNDED FOLLOWING")
        below, above = over("1D", "UNBOUNDED PRECEDING", f"{q!r}D PRECEDING") - far_below, over("1D", f"{q!r}D FOLLOWING", "UNBOUNDED FOLLOWING") - far_above
        mass_below = over(f"p{i}", "UNBOUNDED PRECEDING", f"{q!r}D PRECEDING") - over(f"p{i}", "UNBOUNDED PRECEDING", f"{p!r}D PRECEDING")
        mass_above = over(f"p{i}", f"{q!r}D FOLLOWING", "UNBOUNDED FOLLOWING") - over(f"p{i}", f"{p!r}D FOLLOWING", "UNBOUNDED FOLLOWING")
        plus = far_below + ((x - q) * below - mass_below) / (p - q)
        minus = far_above + (mass_above - (x + q) * above) / (p - q)
        out = out.withColumn(f"f{i}", F.when(F.col("n") > 1, (plus - minus) / (F.col("n") - 1)).otherwise(F.lit(0.0)))
        flow = flow + F.col(f"f{i}") * w
    return out.withColumn("flow", flow).select(*best.columns, "flow")


def _ranged(best: DataFrame, weights: list[float], indifference: float, preference: float) -> DataFrame:
    """The same for groups of any size: values are counted, prefix sums spread by range, items that share a value by their hash."""
    kinds = [F.struct(F.lit(i).alias("crit"), F.col(f"__s{i}").alias("raw"), F.coalesce(F.col(f"__s{i}"), F.lit(LOWEST)).alias("value"), F.lit(w).alias("weight")) for i, w in enumerate(weights)]
    each = best.select("__g", "__item", F.inline(F.array(*kinds)))
    counts = each.groupBy("__g", "crit", "value").agg(F.count("*").alias("cnt"))
    flows = net_flow(percentiles(counts, ["__g", "crit"]), ["__g", "crit"], indifference, preference)
    parts = F.ceil(F.col("cnt") / HOT).cast("int")
    # at most one row per HOT rows of the table
    hot = F.broadcast(counts.where(F.col("cnt") > HOT).select(F.col("__g").alias("hg"), F.col("crit").alias("hc"), F.col("value").alias("hv"), parts.alias("parts")))
    each = each.join(hot, F.col("__g").eqNullSafe(F.col("hg")) & (F.col("crit") == F.col("hc")) & (F.col("value") == F.col("hv")), "left")
    each = each.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("__item"), F.col("parts")), F.lit(0)).cast("int")).drop("hg", "hc", "hv", "parts")
    flows = flows.select(F.col("__g").alias("fg"), F.col("crit").alias("fc"), F.col("value").alias("fv"), "flow", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))).alias("fs"))
    met = each.join(flows, F.col("__g").eqNullSafe(F.col("fg")) & (F.col("crit") == F.col("fc")) & (F.col("value") == F.col("fv")) & (F.col("salt") == F.col("fs")))
    raw = [F.max(F.when(F.col("crit") == i, F.col("raw"))).alias(f"__s{i}") for i in range(len(weights))]
    # summed in the order of the scores, so that equal items get equal flows
    flow = reduce(lambda a, b: a + b, [F.max(F.when(F.col("crit") == i, F.col("flow") * F.col("weight"))) for i in range(len(weights))])
    return met.groupBy("__g", "__item").agg(*raw, flow.alias("flow"))


def outrank(df: DataFrame, group: str = "query_id", item: str = "id", scores: dict[str, float] | None = None, indifference: float = 0.0, preference: float = 1.0, large: int | None = None) -> DataFrame:
    """(group, item, one column per score, flow): each item once, with its weighted net flow in [-1, 1].

    scores maps score columns to weights (default score and rerank_score, equal). An item met more than once in
    a group counts with its best value per score; NULL or NaN counts as the worst. Rows without item are left
    out; a NULL group is a group of its own; an item alone in its group has flow 0. Values change with ranks
    only, so no score weighs more for its unit. Groups of up to `large` rows are sorted by one task each, with one
    exchange for all scores; larger ones are spread over tasks by range.
    """
    scores, large = scores or {"score": 1.0, "rerank_score": 1.0}, LARGE if large is None else large
    if not 0 <= indifference < preference:
        raise ValueError("0 <= indifference < preference is required")
    total = sum(scores.values())
    if total <= 0 or min(scores.values()) < 0:
        raise ValueError("weights must not be negative and must sum to more than 0")
    clean = df.where(F.col(item).isNotNull()).select(F.col(group).alias("__g"), F.col(item).alias("__item"), *[F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(f"__s{i}") for i, s in enumerate(scores)])
    best = clean.groupBy("__g", "__item").agg(*[F.max(f"__s{i}").alias(f"__s{i}") for i in range(len(scores))])
    how = ([w / total for w in scores.values()], indifference, preference)
    big = clean.groupBy(F.col("__g").alias("hg")).count().where(F.col("count") > large).select("hg")
    if big.isEmpty():
        out = _windowed(best, *how)
    else:  # at most one row per `large` rows of the table
        same = F.col("__g").eqNullSafe(F.col("hg"))
        out = _windowed(best.join(F.broadcast(big), same, "left_anti"), *how).unionByName(_ranged(best.join(F.broadcast(big), same, "left_semi"), *how))
    out = out.withColumn("flow", F.round("flow", 12) + 0.0)  # no negative zero
    return out.withColumnsRenamed({"__g": group, "__item": item} | {f"__s{i}": s for i, s in enumerate(scores)})


def top_items(ranked: DataFrame, k: int, group: str = "query_id", item: str = "id") -> DataFrame:
    """The k items of highest flow per group with their position; ties by item. Pre-limited before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc("flow"), F.asc(item))
    return ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def full_ranking(ranked: DataFrame, group: str = "query_id", item: str = "id") -> DataFrame:
    """Every item with its position in its group; a group of any size is numbered by range."""
    return running_totals(ranked, [group], [-F.col("flow"), F.col(item)], {"position": F.lit(1)})
