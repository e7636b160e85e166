"""Heuristics on query texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import strip, words

# Signs of a query that asks several things.
DECOMPOSITION_SIGNS = ["和", "以及", "还有", "另外", "同时", "并且", "and", "also", "additionally", "furthermore", "？", "?", "如何", "how", "什么", "what", "为什么", "why"]
# Pronouns, vague terms and words of several meanings.
PRONOUNS = ["它", "他", "她", "这", "那", "这个", "那个", "it", "this", "that", "they"]
VAGUE = ["东西", "事情", "问题", "方面", "情况", "thing", "stuff", "issue", "aspect"]
POLYSEMOUS = ["银行", "苹果", "橙子", "bank", "apple", "orange", "python"]
# Patterns and nouns of specific queries.
SPECIFIC = [r"\d{4}", r"\d+月", r"\d+日", r"\d+年", r"[A-Z][a-z]+\s[A-Z][a-z]+", r"[A-Z]{2,}"]
PROPER = ["公司", "大学", "学院", "医院", "银行", "Company", "University", "Hospital"]
# Words and their general forms.
GENERAL = {"购买": "获取", "销售": "提供", "学习": "了解", "研究": "分析", "开发": "创建", "设计": "规划"}


def count_held(c: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(t)).cast("int") for t in terms])


def needs_decomposition(q: Column) -> Column:
    return (F.length(q) >= 10) & ((count_held(F.lower(q), DECOMPOSITION_SIGNS) >= 2) | (F.size(words(q)) > 15))


def filter_subqueries(subs: Column, q: Column, most: int = 5, least: int = 2) -> Column:
    """Sub-queries of 5 to 200 characters that differ from the query, distinct; the query first where too few remain."""
    same = F.lower(strip(q))
    kept = F.slice(F.array_distinct(F.filter(subs, lambda s: F.length(s).between(5, 200) & (F.lower(strip(s)) != same))), 1, most)
    return F.when(F.size(kept) < least, F.array_prepend(kept, q)).otherwise(kept)


def subqueries(q: Column, answer: Column) -> Column:
    """The decomposition of a query, given a model's answer of one sub-query per line."""
    lines = F.filter(F.transform(F.split(answer, "\n"), strip), lambda s: s != "")
    return F.when(needs_decomposition(q) & answer.isNotNull(), filter_subqueries(lines, q)).otherwise(F.array(q))


def ambiguity(q: Column) -> Column:
    """Score from 0 to 1; a query without words scores as one of fewer than three."""
    low, n = F.lower(q), F.size(words(q))
    per_word = lambda terms: F.when(n > 0, count_held(low, terms) / n).otherwise(F.lit(0.0))
    short = F.when(n < 3, 0.3).when(n < 5, 0.1).otherwise(0.0)
    return F.least(per_word(PRONOUNS) * 0.4 + per_word(VAGUE) * 0.3 + per_word(POLYSEMOUS) * 0.2 + short, F.lit(1.0))


def disambiguated(q: Column, answer: Column, threshold: float = 0.7) -> Column:
    """The model's answer where the query is ambiguous and the answer isn't less than half as long."""
    return F.when((ambiguity(q) >= threshold) & (F.length(answer) >= F.length(q) * 0.5), answer).otherwise(q)


def needs_abstraction(q: Column) -> Column:
    specific = reduce(lambda a, b: a | b, [q.rlike(p) for p in SPECIFIC])
    return specific | (count_held(q, PROPER) > 0) | (F.size(words(q)) > 10)


# Fixed value: how the words that were lost are named after an answer.
INVOLVED = " (涉及: "


def adjust_abstraction(q: Column, answer: Column, level: str = "medium") -> Column:
    if level == "low":
        keys = F.slice(F.filter(words(q), lambda w: F.length(w) > 3), 1, 2)
        more = F.concat(answer, F.lit(INVOLVED), F.array_join(keys, ", "), F.lit(")"))
        return F.when((F.size(words(answer)) < F.size(words(q)) * 0.7) & (F.size(keys) > 0), more).otherwise(answer)
    if level == "high":
        return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), GENERAL.items(), answer)
    return answer


def valid_abstraction(q: Column, answer: Column) -> Column:
    a, b = F.array_distinct(words(F.lower(q))), F.array_distinct(words(F.lower(answer)))
    return F.coalesce((F.length(answer) >= 5) & (F.size(words(answer)) >= 3) & ((F.size(F.array_intersect(a, b)) > 0) | (F.size(b) >= F.size(a) * 0.3)), F.lit(False))


def abstracted(q: Column, answer: Column, level: str = "medium") -> Column:
    """The adjusted answer of a model where the query needs it and the answer is valid, else the query."""
    new = adjust_abstraction(q, answer, level)
    return F.when(needs_abstraction(q) & valid_abstraction(q, new), new).otherwise(q)


def expand(q: Column, answer: Column, kind: str = "multi_query") -> Column:
    """expanded_queries: the query first, then a model's lines (multi_query) or its answer (hyde, rewrite)."""
    if kind == "multi_query":
        lines = F.filter(F.transform(F.split(answer, "\n"), strip), lambda s: s != "")
        return F.when(F.size(lines) > 0, F.when(F.array_contains(lines, q), lines).otherwise(F.array_prepend(lines, q))).otherwise(F.array(q))
    if kind in ("hyde", "rewrite"):
        return F.when(answer.isNotNull(), F.array(q, answer)).otherwise(F.array(q))
    return F.array(q)
