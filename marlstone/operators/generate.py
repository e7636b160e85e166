"""Answers from retrieved contexts, with a template or a model, whole or in pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import prompts
from marlstone.functions.text import marked_terms, preview, title
from marlstone.operators.rerank import ask


def template_answers(queries: DataFrame, hits: DataFrame, template: str = "retrieval_prompt", budget: int = 2000, manager: prompts.TemplateManager | None = None) -> DataFrame:
    """(qid, query, answer, context_used) without a model: the template filled with the budgeted context."""
    ctx = prompts.budgeted_context(hits, budget)
    at = queries.select("qid", "query").join(ctx, "qid", "left")
    text = F.coalesce("context", F.lit(prompts.NO_DOCUMENTS))
    m = manager or prompts.TemplateManager()
    answer = m.fill(template, documents=text, context=text, question=F.col("query"), query=F.col("query"), partial=True)
    return at.select("qid", "query", answer.alias("answer"), F.coalesce("used", F.lit(0)).alias("context_used"))


def model_answers(queries: DataFrame, hits: DataFrame, model: Callable[[str], str], template: str = "retrieval_prompt", retries: int = 3) -> DataFrame:
    """(qid, query, prompt, answer): a model's answers; it runs on the workers."""
    ctx = prompts.context(hits)
    at = queries.select("qid", "query").join(ctx, "qid", "left")
    text = F.coalesce("context", F.lit(prompts.NO_DOCUMENTS))
    prompt = prompts.TemplateManager().fill(template, documents=text, context=text, question=F.col("query"), partial=True)
    return ask(at.select("qid", "query", prompt.alias("prompt")), "prompt", model, retries=retries)


def answer_pieces(answers: DataFrame, size: int = 10) -> DataFrame:
    """(qid, piece_no, piece, so_far, is_final): the answer as it would be streamed."""
    n = F.ceil(F.length("answer") / size).cast("int")
    each = answers.where(F.length("answer") > 0).select("qid", "answer", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no"), n.alias("n"))
    return each.select("qid", "piece_no", F.substring("answer", F.col("piece_no") * size + 1, F.lit(size)).alias("piece"), F.substring("answer", F.lit(1), (F.col("piece_no") + 1) * size).alias("so_far"), (F.col("piece_no") == F.col("n") - 1).alias("is_final"))


def stream_answers(answers: DataFrame, size: int = 10) -> Iterator[dict]:
    """Pieces on the driver, one at a time."""
    for r in answer_pieces(answers, size).orderBy("qid", "piece_no").toLocalIterator():
        yield r.asDict()


def source_cards(hits: DataFrame, n: int = 3, filename: str = "filename", source: str = "source", content: str = "content") -> DataFrame:
    """(qid, rank, title, content, score, recall_source, keywords) of the first n hits."""
    marked: Column = F.replace(F.replace(F.substring(content, 1, 200), F.lit("<mark>"), F.lit("**")), F.lit("</mark>"), F.lit("**"))
    at = hits.where(F.col("rank") <= n)
    return at.select("qid", "rank", title(F.col(filename), F.col(source), F.col("id")).alias("title"), F.concat(F.coalesce(marked, F.lit("")), F.lit("...")).alias("content"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("recall_source", F.lit("unknown")).alias("recall_source"), marked_terms(F.coalesce(content, F.lit(""))).alias("keywords"))


__all__ = ["answer_pieces", "model_answers", "preview", "source_cards", "stream_answers", "template_answers"]
