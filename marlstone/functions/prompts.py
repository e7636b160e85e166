"""Prompt templates: fill, check, register; prompts and contexts as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = re.compile(r"\{([^}]+)\}")

# Template names and their slots; the wording is our own.
TEMPLATES: dict[str, str] = {
    "question_answer": "问题：{question}\n答案：{answer}",
    "context_question": "背景：{context}\n\n问题：{question}\n\n请依据背景作答。",
    "system_user": "系统：{system}\n\n用户：{user}",
    "retrieval_prompt": "请只依据下面的资料回答问题；资料里没有答案时请说明不知道。\n资料：\n{documents}\n问题：{question}\n回答：",
    "rerank_prompt": "按照与问题的相关程度给片段排序，只输出序号列表。\n问题：{question}\n片段：\n{documents}",
    "summary_prompt": "请概括下面的内容。\n{content}\n要求：{requirements}",
    "rewrite": "请把查询改写得更便于检索，写在 <output> 标签中。\n查询：{query}",
    "hyde": "请写一段可能回答查询的文字，写在 <output> 标签中。\n查询：{query}",
    "multi_query": "请给出{n}个与查询相关的不同说法，每行一个，写在 <output> 标签中。\n查询：{query}",
    "decompose": "请把查询拆成几个简单的子查询，每行一个，写在 <output> 标签中。\n查询：{query}",
    "disambiguate": "请补充查询的语境以消除歧义，写在 <output> 标签中。\n查询：{query}",
    "abstract": "请把具体的查询改成更一般的问题，写在 <output> 标签中。\n查询：{query}",
    "relevance_score": "请给答案与问题的相关程度打分（0 到 10）。\n问题：{question}\n答案：{answer}\n标准：{criteria}",
    "quality_assessment": "请评价下面内容的质量。\n内容：{content}\n方面：{dimensions}",
}
NO_DOCUMENTS = "暂无相关文档。"


def slots(template: str) -> list[str]:
    return list(dict.fromkeys(SLOT.findall(template)))


def fill(template: str, values: Mapping[str, Column], partial: bool = False) -> Column:
    """The template with its slots replaced; a slot without value is an error unless partial."""
    missing = [s for s in slots(template) if s not in values]
    if missing and not partial:
        raise KeyError(f"missing values: {missing}")
    parts, at = [], 0
    for m in SLOT.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit("")) if m[1] in values else F.lit(m[0])]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


class TemplateManager:
    """Named templates."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES) -> None:
        self.templates = dict(templates)

    def register(self, name: str, template: str) -> None:
        self.templates[name] = template

    def get(self, name: str) -> str:
        if name not in self.templates:
            raise KeyError(f"no template {name!r}")
        return self.templates[name]

    def names(self) -> list[str]:
        return sorted(self.templates)

    def fill(self, name: str, partial: bool = False, **values: Column) -> Column:
        return fill(self.get(name), values, partial)

    def remove(self, name: str) -> bool:
        return self.templates.pop(name, None) is not None


def template_slots(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{([^}]+)\}"), 1))


def context(hits: DataFrame, title: str = "title", content: str = "content", separator: str = "\n\n") -> DataFrame:
    """(qid, context): a query's hits in rank order under numbered titles."""
    entry = F.concat(F.lit("文档"), F.col("rank").cast("string"), F.lit(" - "), F.col(title), F.lit(":\n"), F.coalesce(content, F.lit("")))
    got = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("a"))
    return got.select("qid", F.array_join(F.transform("a", lambda x: x["e"]), separator).alias("context"))


def budgeted_context(hits: DataFrame, budget: int = 2000, title: str = "title", content: str = "content") -> DataFrame:
    """(qid, context, used): entries in rank order while they fit; the first that doesn't is cut if over 100 characters remain."""
    entry = F.concat(F.lit("文档"), F.col("rank").cast("string"), F.lit(" - "), F.coalesce(F.col(title), F.concat(F.lit("文档"), F.col("rank").cast("string"))), F.lit(":\n"), F.coalesce(content, F.lit("")))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = hits.select("qid", "rank", entry.alias("e")).withColumn("upto", F.sum(F.length("e")).over(w)).withColumn("left", budget - (F.col("upto") - F.length("e")))
    first_over = F.min(F.when(F.col("upto") > budget, F.col("rank"))).over(Window.partitionBy("qid"))
    at = at.withColumn("stop", first_over).where(F.col("stop").isNull() | (F.col("rank") < F.col("stop")) | ((F.col("rank") == F.col("stop")) & (F.col("left") > 100)))
    cut = F.when(F.col("rank") == F.col("stop"), F.concat(F.substring("e", F.lit(1), F.col("left").cast("int")), F.lit("..."))).otherwise(F.col("e"))
    got = at.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", cut.alias("e")))).alias("a"))
    return got.select("qid", F.array_join(F.transform("a", lambda x: x["e"]), "\n\n").alias("context"), F.size("a").alias("used"))


def conversation(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "content") -> DataFrame:
    """(conv, turns, history): a line `role: text` per distinct turn in order; roles in lower case, turns without text left out."""
    clean = turns.where(F.col(text).isNotNull()).select(F.col(conv), F.col(turn).alias("t"), F.lower(F.trim(role)).alias("r"), F.col(text).alias("x")).distinct()
    got = clean.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("t", "r", "x"))).alias("a"))
    return got.select(conv, F.size("a").cast("long").alias("turns"), F.array_join(F.transform("a", lambda x: F.concat(x["r"], F.lit(": "), x["x"])), "\n").alias("history"))
