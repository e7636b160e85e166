"""Components, configured pipelines and their execution."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
Component = Callable[[Tables], Tables]
Factory = Callable[[dict[str, Any]], Component]

KINDS = ("loader", "splitter", "embedding", "indexer", "retriever", "reranker", "generator", "query")


class Registry:
    """Factories by kind and name."""

    def __init__(self) -> None:
        self.items: dict[tuple[str, str], Factory] = {}

    def register(self, kind: str, name: str) -> Callable[[Factory], Factory]:
        def add(f: Factory) -> Factory:
            self.items[kind, name] = f
            return f

        return add

    def get(self, kind: str, name: str) -> Factory:
        if (kind, name) not in self.items:
            raise KeyError(f"no {kind} {name!r}; there are {self.names(kind)}")
        return self.items[kind, name]

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(n if kind else f"{k}.{n}" for k, n in self.items if kind in (None, k))


registry = Registry()


def validate(config: dict[str, Any]) -> None:
    """Raise ValueError unless components have type and name and flow and entry points name components."""
    parts = config.get("components")
    if not parts:
        raise ValueError("components are missing")
    for name, c in parts.items():
        for key in ("type", "name"):
            if not c.get(key):
                raise ValueError(f"component {name}: {key} is missing")
    for a, targets in (config.get("flow") or {}).items():
        for b in [a, *_targets(targets)]:
            if b not in parts:
                raise ValueError(f"flow names an unknown component: {b}")
    for entry, target in _entries(config).items():
        if target not in parts:
            raise ValueError(f"entry point {entry} names an unknown component: {target}")


def _targets(t: Any) -> list[str]:
    if t is None:
        return []
    if isinstance(t, str):
        return [t]
    if isinstance(t, list):
        return t
    raise ValueError(f"a flow target must be a name or a list: {t!r}")


def _entries(config: dict[str, Any]) -> dict[str, str]:
    e = config.get("entry_points") or config.get("entry_point") or {}
    return {"default": e} if isinstance(e, str) else dict(e)


class Step(dict):
    """What one component added: its tables by name, with the component's type, the names it was given and the time."""

    def __init__(self, tables: Tables, kind: str, given: list[str]) -> None:
        super().__init__(tables)
        self.kind, self.given, self.timestamp = kind, given, time.time()


@dataclass
class Pipeline:
    """Components in order of their flow. Running composes lazy tables; nothing is computed until they are used."""

    components: dict[str, Component]
    flow: dict[str, list[str]]
    entries: dict[str, str]
    mode: str = "batch"
    settings: dict[str, Any] = field(default_factory=dict)

    def get_component(self, name: str) -> Component | None:
        return self.components.get(name)

    def list_components(self) -> list[str]:
        return list(self.components)

    def get_entry_points(self) -> dict[str, str]:
        return dict(self.entries)

    def chain(self, entry: str | None = None) -> list[str]:
        """Names from the entry point on; an unknown entry point is the default one. Of several successors the first is taken."""
        at = self.entries.get(entry or "", next(iter(self.entries.values()), next(iter(self.components))))
        out: list[str] = []
        while at:
            if at in out:
                raise ValueError(f"the flow is a circle at {at}")
            out.append(at)
            after = self.flow.get(at, [])
            at = after[0] if after else ""
        return out

    def run(self, tables: Tables, entry: str | None = None) -> Tables:
        for name in self.chain(entry):
            tables = tables | self.components[name](tables)
        return tables

    def run_steps(self, tables: Tables, entry: str | None = None) -> dict[str, Step]:
        """What each step adds, by name."""
        steps: dict[str, Step] = {}
        for name in self.chain(entry):
            parts = self.settings.get("components", {}).get(name, {})
            steps[name] = Step(self.components[name](tables), f"{parts.get('type', '')}.{parts.get('name', '')}", sorted(tables))
            tables = tables | steps[name]
        return steps

    def run_branches(self, tables: Tables, entry: str | None = None) -> dict[str, Tables]:
        """All successors instead of the first: the tables at the end of each branch, by the names of its components joined by /."""
        out: dict[str, Tables] = {}
        todo = [(self.chain(entry)[0], tables, "")]
        while todo:
            name, given, path = todo.pop()
            if name in path.split("/"):
                raise ValueError(f"the flow is a circle at {name}")
            made, path = given | self.components[name](given), f"{path}/{name}".lstrip("/")
            after = self.flow.get(name, [])
            if not after:
                out[path] = made
            todo += [(n, made, path) for n in reversed(after)]
        return out

    def run_stream(self, source: DataFrame, name: str, output: str, sink: Any, checkpoint: str, tables: Tables | None = None, entry: str | None = None) -> Any:
        """Each batch of a streaming table goes through the components as the table of that name; the output table is written to sink.

        Returns the running query; it ends when all that is there is processed. Errors end it, too.
        """
        step = lambda df, n: sink.write(self.run((tables or {}) | {name: df}, entry)[output], n)
        return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def execute(self, tables: Tables, entry: str | None = None, **stream: Any) -> Any:
        """run or run_stream, as the configuration's mode says."""
        if self.mode == "batch":
            return self.run(tables, entry)
        return self.run_stream(stream.pop("source"), tables=tables, entry=entry, **stream)


def detect_mode(config: dict[str, Any]) -> str:
    """streaming where the architecture says so or there are sections of producers and consumers, else batch."""
    kind = (config.get("architecture") or {}).get("type")
    if kind:
        return "batch" if kind in ("standard", "batch") else "streaming"
    return "streaming" if {"producer", "consumer"} <= set(config) else "batch"


def build(config: dict[str, Any], using: Registry = registry) -> Pipeline:
    validate(config)
    parts = {n: using.get(c["type"], c["name"])(c.get("config") or {}) for n, c in config["components"].items()}
    flow = {a: _targets(t) for a, t in (config.get("flow") or {}).items()}
    pipeline = Pipeline(parts, flow, _entries(config) or {"default": next(iter(parts))}, detect_mode(config), config)
    for entry in pipeline.entries:
        pipeline.chain(entry)
    return pipeline


def load_config(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_configs(folder: str) -> dict[str, dict[str, Any]]:
    """Every YAML file of a folder by its stem."""
    from pathlib import Path

    return {p.stem: load_config(str(p)) for p in sorted(Path(folder).iterdir()) if p.suffix in (".yaml", ".yml")}


@functools.lru_cache(maxsize=64)
def cached_pipeline(path: str) -> Pipeline:
    """The pipeline of a config file, built once; cached_pipeline.cache_clear() forgets all."""
    return build(load_config(path))


# The components ------------------------------------------------------------------------------------------------


@registry.register("loader", "file")
def _file_loader(c: dict[str, Any]) -> Component:
    from marlstone.sources import loaders

    def run(t: Tables) -> Tables:
        if "documents" in t:
            return {}
        spark, path, types = _session(t), c.get("path", "./data"), c.get("file_types")
        docs = loaders.load(spark, path, types, c.get("enable_markdown_parsing", True), c.get("pdf_parser"))
        return {"documents": loaders.with_loader_columns(docs, path, loaders.count_files(spark, path, types), c.get("batch_size"))}

    return run


@registry.register("loader", "web")
def _web_loader(c: dict[str, Any]) -> Component:
    from marlstone.sources import loaders

    return lambda t: {} if "documents" in t else {"documents": loaders.load_pages(t["pages"])}


Cut = Callable[[DataFrame, list[str]], DataFrame]


def _splitter(name: str, make: Callable[[dict[str, Any]], Cut]) -> None:
    @registry.register("splitter", name)
    def factory(c: dict[str, Any]) -> Component:
        cut = make(c)

        def run(t: Tables) -> Tables:
            docs = t["documents"]
            chunks = cut(docs, [x for x in docs.columns if x != "content"] if c.get("include_metadata", True) else [])
            return {"chunks": chunks.withColumnRenamed("chunk", "content") if "chunk" in chunks.columns else chunks}

        return run


def _named(docs: DataFrame) -> str:
    return next(c for c in ("source", "id", "doc_id") if c in docs.columns)


def _text_splitter(c: dict[str, Any]) -> Cut:
    from marlstone.operators import split

    size, overlap = c["chunk_size"], c.get("chunk_overlap", 0)
    split.check_sizes(size, overlap)
    how = c.get("split_method", "character")
    if how == "character":
        return lambda d, keep: split.split_characters(d, _named(d), "content", size, overlap, keep)
    if how == "word":
        return lambda d, keep: split.split_words(d, _named(d), "content", size, overlap, keep)
    if how == "sentence":
        return lambda d, keep: split.split_sentences(d, _named(d), "content", size, keep)
    raise ValueError(f"unknown split_method {how!r}")


def _semantic_splitter(c: dict[str, Any]) -> Cut:
    """With embed, a callable from a text to its vector, sentences are compared by cosine; else by their words."""
    from marlstone.operators import split

    how = {"similar": split.embedding_similarity(c["embed"])} if c.get("embed") else {}
    return lambda d, keep: split.split_semantic(d, _named(d), "content", c["chunk_size"], c.get("similarity_threshold", 0.5), c.get("chunk_overlap", 0), c.get("min_chunk_size", 1), c.get("max_chunk_size"), keep=keep, **how).withColumn("split_method", F.lit("semantic"))


def _hierarchical_splitter(c: dict[str, Any]) -> Cut:
    """fallback_config names the splitter of oversized chunks and, under secondary, a second one."""
    from marlstone.operators import split

    def pick(own: dict[str, Any] | None) -> Callable[[str], list[str]] | None:
        if not own:
            return None
        size, overlap = own.get("chunk_size", c.get("max_chunk_size") or 2 * max(c.get("chunk_sizes", [512, 256]))), own.get("chunk_overlap", 0)
        kinds = {"character": lambda t: split.character_chunks(t, size, overlap), "sentence": lambda t: split.sentence_chunks(t, size), "recursive": lambda t: split.recursive_chunks(t, size, overlap), "token": lambda t: split.token_chunks(t, size, overlap)}
        return kinds[own.get("type", "character")]

    first, second = pick(c.get("fallback_config")), pick((c.get("fallback_config") or {}).get("secondary"))
    return lambda d, keep: split.split_hierarchy(d, _named(d), "content", c.get("chunk_sizes", [512, 256]), c.get("chunk_overlap", 50), c.get("max_chunk_size"), first, second, keep)


def _make_splitters() -> None:
    from marlstone.operators import split

    _splitter("text", _text_splitter)
    _splitter("recursive", lambda c: lambda d, keep: split.split_recursive(d, _named(d), "content", c["chunk_size"], c.get("chunk_overlap", 0), tuple(c.get("separators", split.SEPARATORS)), c.get("keep_separator", True), keep))
    _splitter("semantic", _semantic_splitter)
    _splitter("sentence", lambda c: lambda d, keep: split.split_tokens(d, _named(d), "content", c.get("chunk_size", 1024), c.get("chunk_overlap", 200), keep))
    _splitter("hierarchical", _hierarchical_splitter)
    _splitter("hierarchical_doc", lambda c: lambda d, keep: split.parse_hierarchy(d, _named(d), "content", c.get("chunk_sizes", [512, 256]), c.get("chunk_overlap", 20), keep))


_make_splitters()


@registry.register("embedding", "hash")
def _embedding(c: dict[str, Any]) -> Component:
    from marlstone.functions.vectors import hash_embed

    return lambda t: {"chunks": hash_embed(t["chunks"], c.get("text", "content"), c.get("field_name", "content_vector"), c.get("dimensions", 64))}


@registry.register("indexer", "bm25")
def _indexer(c: dict[str, Any]) -> Component:
    from marlstone.operators.index import build_index

    def run(t: Tables) -> Tables:
        ix = build_index(t["chunks"], c.get("id", "chunk_id"), {c.get("field", "content"): c.get("analyzer", "bigrams")})
        return {"postings": ix.postings, "lengths": ix.lengths, "corpus": ix.corpus}

    return run


def _asked(t: Tables) -> DataFrame:
    """The texts to search for each query: its expansions where there are several, else the query itself."""
    from marlstone.operators import retrieve

    q = t["queries"]
    parts = F.array("query")
    if "expanded_queries" in q.columns:
        several = (F.size("expanded_queries") > 1) & F.exists("expanded_queries", lambda x: x.isNotNull())
        parts = F.when(several, F.col("expanded_queries")).otherwise(parts)
    return retrieve.sub_queries(q, "qid", parts)


@registry.register("retriever", "bm25")
def _bm25_retriever(c: dict[str, Any]) -> Component:
    from marlstone.operators import retrieve
    from marlstone.operators.index import InvertedIndex

    def run(t: Tables) -> Tables:
        ix = InvertedIndex(t["postings"], t["lengths"], t["corpus"])
        each, k = _asked(t), c.get("top_k", 10)
        terms = retrieve.query_terms(each, "sub", "source_query", c.get("analyzer", "bigrams"))
        top = retrieve.text_search(ix, terms, k, c.get("similarity_threshold"), strict=True, k1=c.get("k1", 1.5), b=c.get("b", 0.75))
        return _found(retrieve.merge_sub_queries(top, each, k), t, "text", k)

    return run


@registry.register("retriever", "hybrid")
def _hybrid_retriever(c: dict[str, Any]) -> Component:
    from marlstone.functions.vectors import hash_embed
    from marlstone.operators import retrieve
    from marlstone.operators.index import InvertedIndex
    from marlstone.session import materialize

    def run(t: Tables) -> Tables:
        kind, k = c.get("search_type", "hybrid"), c.get("top_k", 10)
        if kind not in ("text", "vector", "hybrid"):
            raise ValueError(f"unknown search_type {kind!r}")
        chunks, each = t["chunks"], _asked(t)
        levels = c.get("small2big_config", {}) if c.get("enable_small2big") else {}
        text = vector = None
        wanted = levels.get("small_chunk_top_k", 20) if levels else k
        if kind in ("text", "hybrid"):
            ix = InvertedIndex(t["postings"], t["lengths"], t["corpus"])
            terms = retrieve.query_terms(each, "sub", "source_query", c.get("analyzer", "bigrams"))
            allowed = chunks.where(F.col("chunk_level") == levels.get("text_chunk_level", 0)).select(F.col("chunk_id").alias("id")) if levels else None
            text = retrieve.text_search(ix, terms, 2 * wanted if kind == "hybrid" else wanted, allowed=allowed)
        if kind in ("vector", "hybrid"):
            dim = c.get("dimensions", 64)
            held = chunks.where(F.col("chunk_level") == levels.get("vector_chunk_level", 2)) if levels else chunks
            asked = hash_embed(each, "source_query", "vector", dim)
            stored = materialize(held.select(F.col("chunk_id").alias("id"), F.col("content_vector").alias("vector")))  # read for every block of queries
            vector = retrieve.vector_search(stored, asked, 2 * wanted if kind == "hybrid" else wanted, qid="sub")
        if kind == "hybrid":
            hits = retrieve.fuse(text, vector, c.get("fusion_method", "rrf"), wanted, c.get("rrf_k", 60), c.get("text_weight", 1.0), c.get("vector_weight", 1.2))
        else:
            hits = (text if kind == "text" else vector).withColumn("recall_source", F.lit(kind))
        if levels:
            big = retrieve.expand_parents(hits, chunks, "parent", levels.get("score_fusion_method", "max"), k)
            return {"small_hits": retrieve.merge_sub_queries(hits, each, wanted), "hits": retrieve.merge_sub_queries(big, each, k)}
        return _found(retrieve.merge_sub_queries(hits, each, k), t, kind, k)

    return run


def _found(hits: DataFrame, t: Tables, kind: str, k: int) -> Tables:
    """hits with their texts, and retrieval: how many each query has, and how they were searched."""
    from marlstone.session import materialize

    hits = materialize(hits)  # read for the texts and for the counts
    counts = t["queries"].select("qid", "query").join(hits.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left")
    return {"hits": _with_text(hits, t), "retrieval": counts.select("qid", "query", F.coalesce("n", F.lit(0)).alias("result_count"), F.lit(kind).alias("search_type"), F.lit(k).alias("top_k"))}


def _with_text(hits: DataFrame, t: Tables) -> DataFrame:
    """Texts are joined to the few ranked hits, which are stored, at the end."""
    from marlstone.operators.retrieve import lookup

    return hits.join(lookup(t["chunks"], hits.select("id")).select(F.col("chunk_id").alias("id"), "content"), "id", "left")


@registry.register("reranker", "embedding")
def _embedding_reranker(c: dict[str, Any]) -> Component:
    from marlstone.functions.vectors import hash_embed
    from marlstone.operators.rerank import by_embedding, rerank_report

    def run(t: Tables) -> Tables:
        q = hash_embed(t["queries"].select("qid", "query"), "query", "query_vector")
        at = hash_embed(t["hits"], "content", "hit_vector").join(q, "qid")
        out = by_embedding(at.drop("rank"), "query_vector", "hit_vector", c.get("top_k", 10), c.get("similarity_metric", "cosine"), c.get("score_threshold", 0.0))
        return {"hits": out.drop("query_vector", "hit_vector", "query"), "rerank_metadata": rerank_report(t["hits"], out)}

    return run


def _with_queries(t: Tables) -> DataFrame:
    return t["hits"].join(t["queries"].select("qid", "query"), "qid")


@registry.register("embedding", "model")
def _model_embedding(c: dict[str, Any]) -> Component:
    from marlstone.functions.vectors import embed_with

    return lambda t: {"chunks": embed_with(t["chunks"], c.get("text", "content"), c["model"], c.get("field_name", "content_vector"), c.get("batch_size", 32), c.get("normalize", True))}


@registry.register("reranker", "llm")
def _llm_reranker(c: dict[str, Any]) -> Component:
    """method listwise asks for a list per query, pointwise for a score per hit, pairwise for the better of two."""
    from marlstone.functions import prompts
    from marlstone.operators import rerank

    method, k = c.get("method", "pairwise"), c.get("top_k", 10)

    def run(t: Tables) -> Tables:
        hits, model = t["hits"], c["model"]
        if method == "pairwise":
            ranked = rerank.by_comparison(_with_queries(t), model, k)
            return {"hits": ranked.drop("query", "rank").withColumnRenamed("new_rank", "rank")}
        if method == "pointwise":
            prompt = prompts.TemplateManager().fill("relevance_score", question=F.col("query"), answer=F.col("content"), criteria=F.lit("0-10"))
            asked = rerank.ask(_with_queries(t).withColumn("prompt", prompt), "prompt", model)
            return {"hits": rerank.by_score_answer(asked.drop("rank"), "answer", k, c.get("score_threshold", 0.0)).drop("query", "prompt", "answer")}
        if method != "listwise":
            raise ValueError(f"unknown method {method!r}")
        ctx = prompts.context(hits.withColumn("title", F.col("id"))).join(t["queries"].select("qid", "query"), "qid")
        prompt = prompts.TemplateManager().fill("rerank_prompt", question=F.col("query"), documents=F.col("context"))
        answers = rerank.ask(ctx.withColumn("prompt", prompt), "prompt", model)
        return {"hits": rerank.by_list(hits, answers, k).drop("rank").withColumnRenamed("new_rank", "rank")}

    return run


@registry.register("reranker", "service")
def _service_reranker(c: dict[str, Any]) -> Component:
    """model takes a query and its texts as JSON and answers with a rerank service's JSON."""
    from marlstone.operators import rerank

    def run(t: Tables) -> Tables:
        texts = t["hits"].groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("documents"))
        asked = texts.join(t["queries"].select("qid", "query"), "qid").withColumn("prompt", F.to_json(F.struct("query", "documents")))
        # a service that fails keeps the first hits as they are
        out = rerank.by_service(t["hits"], rerank.ask(asked, "prompt", c["model"], retries=c.get("max_retries", 3), fail_open=True, per_second=c.get("rate_limit_per_second")), c.get("top_k", 10))
        return {"hits": out.drop("rank").withColumnRenamed("new_rank", "rank")}

    return run


@registry.register("generator", "llm")
def _llm_generator(c: dict[str, Any]) -> Component:
    from marlstone.operators.generate import model_answers

    def run(t: Tables) -> Tables:
        hits = t["hits"] if "title" in t["hits"].columns else t["hits"].withColumn("title", F.col("id"))
        return {"answers": model_answers(t["queries"], hits, c["model"], c.get("prompt_template", "retrieval_prompt"), c.get("max_retries", 3))}

    return run


@registry.register("generator", "template")
def _template_generator(c: dict[str, Any]) -> Component:
    from marlstone.operators.generate import template_answers

    def run(t: Tables) -> Tables:
        hits = t["hits"] if "title" in t["hits"].columns else t["hits"].withColumn("title", F.col("id"))
        return {"answers": template_answers(t["queries"], hits, c.get("template_name", "retrieval_prompt"), c.get("max_context_length", 2000))}

    return run


@registry.register("query", "expansion")
def _expansion(c: dict[str, Any]) -> Component:
    from marlstone.functions.understanding import expand

    def run(t: Tables) -> Tables:
        q = t["queries"]
        answer = F.col("answer") if "answer" in q.columns else F.lit(None).cast("string")
        made = expand(F.col("query"), answer, c.get("expansion_type", "multi_query"))
        if "expanded_queries" in q.columns:  # those of the table hold where no model answered
            given = F.col("expanded_queries")
            named = F.when(F.exists(given, lambda x: x.eqNullSafe(F.col("query"))), given).otherwise(F.array_prepend(given, F.col("query")))
            made = F.when(answer.isNull() & (F.size(given) > 0), named).otherwise(made)
        return {"queries": q.withColumn("expanded_queries", made)}

    return run


def _heuristic(name: str, column: str, make: Callable) -> None:
    @registry.register("query", name)
    def factory(c: dict[str, Any]) -> Component:
        def run(t: Tables) -> Tables:
            q = t["queries"]
            answer = F.col("answer") if "answer" in q.columns else F.lit(None).cast("string")
            return {"queries": q.withColumn(column, make(F.col("query"), answer, c))}

        return run


def _make_heuristics() -> None:
    from marlstone.functions import understanding as u

    _heuristic("decomposition", "subqueries", lambda q, a, c: u.subqueries(q, a))
    _heuristic("disambiguation", "disambiguated_query", lambda q, a, c: u.disambiguated(q, a, c.get("ambiguity_threshold", 0.7)))
    _heuristic("abstraction", "abstracted_query", lambda q, a, c: u.abstracted(q, a, c.get("abstraction_level", "medium")))


_make_heuristics()


def _session(tables: Tables) -> SparkSession:
    return next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
