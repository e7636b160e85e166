"""Queries of query understanding, analyzers, reranking, generation and retrieval drivers, with their SQL.

Where the operator takes a model's answer, the answer is made from the row, so that SQL can make it as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import prompts, text, understanding, vectors
from marlstone.operators import generate, index, rerank, retrieve
from marlstone.plans.catalog import CARD_HITS, LATEST_CHUNKS, TOKENS, WORDS, _card_hits, _filled, _held, _terms, bm25_sql, latest_chunks, query
from marlstone.session import materialize, table, texts

BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def stripped(c: str) -> str:
    return rf"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


# Answers -------------------------------------------------------------------------------------------------------


@query(f"WITH a AS (SELECT query_id, CASE WHEN length(query) % 2 = 0 THEN 'x <output> ' || query || ' </output> y' ELSE '  ' || query || ' ' END AS a FROM queries) SELECT query_id, CASE WHEN regexp_matches(a, '(?s)<output>.*?</output>') THEN {stripped(chr(10).join(['regexp_extract(a, ' + repr('(?s)<output>(.*?)</output>') + ', 1)']))} ELSE {stripped('a')} END AS answer FROM a")
def tagged_output(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.length("query") % 2 == 0, F.concat(F.lit("x <output> "), F.col("query"), F.lit(" </output> y"))).otherwise(F.concat(F.lit("  "), F.col("query"), F.lit(" ")))
    return table(spark, d, "queries").select("query_id", text.tagged_output(a).alias("answer"))


@query(rf"WITH c AS ({LATEST_CHUNKS}) SELECT chunk_id, coalesce(try_cast(nullif(regexp_extract(content, '\d+(\.\d+)?'), '') AS DOUBLE), 0) AS number FROM c")
def first_number(spark: SparkSession, d: str) -> DataFrame:
    return latest_chunks(spark, d, "content").select("chunk_id", text.first_number(F.col("content")).alias("number"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}')" for n, t in prompts.TEMPLATES.items() for s in prompts.slots(t)) + ") AS t(template, slot)")
def template_slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots of every template, read from its text."""
    rows = spark.createDataFrame(list(prompts.TEMPLATES.items()), "template string, body string")
    return rows.select("template", F.explode(prompts.template_slots(F.col("body"))).alias("slot"))


@query("WITH v AS (SELECT query_id, ['q', 'k'] AS given, list_distinct(regexp_extract_all('{q} and {k} and {x}' || coalesce(query, ''), '\\{([^}]+)\\}', 1)) AS slots FROM queries) SELECT query_id, array_to_string(list_sort(list_filter(slots, lambda s: NOT list_contains(given, s))), ',') AS missing FROM v")
def template_missing(spark: SparkSession, d: str) -> DataFrame:
    """Slots of a template that no value is given for."""
    slots = prompts.template_slots(F.concat(F.lit("{q} and {k} and {x}"), F.coalesce("query", F.lit(""))))
    return table(spark, d, "queries").select("query_id", F.array_join(F.array_sort(F.array_except(slots, F.array(F.lit("q"), F.lit("k")))), ",").alias("missing"))


# Understanding -------------------------------------------------------------------------------------------------

LINES = f"list_filter(list_transform(string_split(answer, chr(10)), lambda x: {stripped('x')}), lambda x: x <> '')"
ANSWERED = "a AS (SELECT query_id, query, array_to_string(list_filter(expanded_queries, lambda x: x IS NOT NULL), chr(10)) AS answer FROM queries)"


def _answered(spark: SparkSession, d: str) -> DataFrame:
    """queries with the expansions as a model's answer, one per line; NULL where there are none."""
    return table(spark, d, "queries").select("query_id", "query", F.when(F.col("expanded_queries").isNotNull(), F.array_join("expanded_queries", "\n")).alias("answer"))


@query(
    f"""WITH {ANSWERED}, l AS (SELECT *, {LINES} AS lines FROM a)
SELECT query_id, array_to_string(CASE WHEN len(lines) > 0 THEN CASE WHEN list_contains(lines, query) THEN lines ELSE list_prepend(query, lines) END ELSE [query] END, ' | ') AS multi_query,
  array_to_string(CASE WHEN answer IS NOT NULL THEN [query, answer] ELSE [query] END, ' | ') AS hyde, array_to_string(CASE WHEN answer IS NOT NULL THEN [query, answer] ELSE [query] END, ' | ') AS rewrite, query AS unknown FROM l"""
)
def expand_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of expansion; an unknown kind keeps the query."""
    made = lambda kind: F.array_join(understanding.expand(F.col("query"), F.col("answer"), kind), " | ").alias(kind)
    return _answered(spark, d).select("query_id", made("multi_query"), made("hyde"), made("rewrite"), made("unknown"))


NEEDED = f"length(query) >= 10 AND (({_held('lower(query)', understanding.DECOMPOSITION_SIGNS)}) >= 2 OR {WORDS} > 15)"


@query(
    f"""WITH {ANSWERED}, l AS (SELECT *, {NEEDED} AS needed, {LINES} AS lines, lower({stripped('query')}) AS same FROM a), i AS (SELECT query_id, same, lines, unnest(range(1, len(lines) + 1)) AS i FROM l),
k AS (SELECT query_id, lines[i] AS s, min(i) AS i FROM i WHERE length(lines[i]) BETWEEN 5 AND 200 AND lower({stripped('lines[i]')}) <> same GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM k QUALIFY n <= 5), g AS (SELECT query_id, count(*) AS n, string_agg(s, ' / ' ORDER BY i) AS subs FROM r GROUP BY query_id)
SELECT query_id, CASE WHEN NOT needed OR answer IS NULL THEN query WHEN coalesce(n, 0) < 2 THEN concat_ws(' / ', query, subs) ELSE subs END AS subqueries FROM l LEFT JOIN g USING (query_id)"""
)
def decompose_queries(spark: SparkSession, d: str) -> DataFrame:
    """Where a query needs it, the model's lines as sub-queries; else the query."""
    return _answered(spark, d).select("query_id", F.array_join(understanding.subqueries(F.col("query"), F.col("answer")), " / ").alias("subqueries"))


AMBIGUITY = f"""least(CASE WHEN n > 0 THEN ({_held('q', understanding.PRONOUNS)}) / n * 0.4 + ({_held('q', understanding.VAGUE)}) / n * 0.3 + ({_held('q', understanding.POLYSEMOUS)}) / n * 0.2 ELSE 0 END + CASE WHEN n < 3 THEN 0.3 WHEN n < 5 THEN 0.1 ELSE 0 END, 1.0)"""


@query(f"WITH {ANSWERED}, w AS (SELECT *, lower(query) AS q, {WORDS} AS n FROM a) SELECT query_id, CASE WHEN {AMBIGUITY} >= 0.25 AND length(answer) >= length(query) * 0.5 THEN answer ELSE query END AS clear FROM w")
def disambiguate_queries(spark: SparkSession, d: str) -> DataFrame:
    """The model's answer where a query is ambiguous and the answer isn't much shorter."""
    return _answered(spark, d).select("query_id", understanding.disambiguated(F.col("query"), F.col("answer"), 0.25).alias("clear"))


SPECIFIC = " OR ".join(f"regexp_matches(query, '{p}')" for p in understanding.SPECIFIC) + f" OR ({_held('query', understanding.PROPER)}) > 0 OR {WORDS} > 10"


def _words_of(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '{BLANK}+'), lambda x: x <> '')"


def _abstract_sql(level: str) -> str:
    new = "answer"
    if level == "high":
        for a, b in understanding.GENERAL.items():
            new = f"replace({new}, '{a}', '{b}')"
    if level == "low":
        keys = f"list_filter({_words_of('query')}, lambda x: length(x) > 3)[1:2]"
        new = f"CASE WHEN len({_words_of('answer')}) < len({_words_of('query')}) * 0.7 AND len({keys}) > 0 THEN answer || ' (涉及: ' || array_to_string({keys}, ', ') || ')' ELSE answer END"
    return f"""(SELECT query_id, CASE WHEN ({SPECIFIC}) AND coalesce(length(new) >= 5 AND len({_words_of('new')}) >= 3 AND (len(list_intersect(x, y)) > 0 OR len(y) >= len(x) * 0.3), FALSE) THEN new ELSE query END AS {level} FROM
  (SELECT *, list_distinct({_words_of('lower(query)')}) AS x, list_distinct({_words_of('lower(new)')}) AS y FROM (SELECT query_id, query, {new} AS new FROM b)))"""


@query(f"WITH b AS (SELECT query_id, query, '一般的问题 how to 学习 and 设计 ' || query AS answer FROM queries) SELECT * FROM {_abstract_sql('low')} JOIN {_abstract_sql('medium')} USING (query_id) JOIN {_abstract_sql('high')} USING (query_id)")
def abstract_queries(spark: SparkSession, d: str) -> DataFrame:
    """The model's general form of a specific query at every level, where it is valid."""
    q = table(spark, d, "queries").withColumn("answer", F.concat(F.lit("一般的问题 how to 学习 and 设计 "), F.col("query")))
    return q.select("query_id", *[understanding.abstracted(F.col("query"), F.col("answer"), level).alias(level) for level in ("low", "medium", "high")])


# Analyzers -----------------------------------------------------------------------------------------------------

DICTIONARY = "d AS (SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) AS words, list(word) AS held FROM (SELECT DISTINCT word FROM common_words WHERE lang = 'zh' AND length(word) > 1))"


def _dictionary(spark: SparkSession, d: str) -> list[str]:
    """Words of a fixed table; dictionary_analyzer checks their number."""
    return [r["word"] for r in table(spark, d, "common_words").where("lang = 'zh' AND word IS NOT NULL").select("word").distinct().take(20_001)]


@query(
    rf"""WITH {DICTIONARY}, s AS (SELECT query_id, list_filter(regexp_extract_all(query, '(' || words || '|[\p{{Latin}}\p{{Greek}}\p{{N}}_]+|\p{{Han}})'), lambda x: length(x) > 1) AS smart, query, held FROM queries, d WHERE query IS NOT NULL),
w AS (SELECT query_id, i, n, substring(query, i, n) AS w, held FROM (SELECT *, unnest(range(1, length(query) + 1)) AS i FROM s), (SELECT DISTINCT length(word) AS n FROM common_words WHERE lang = 'zh' AND length(word) > 1)),
m AS (SELECT query_id, list(w ORDER BY i, n) AS found FROM w WHERE list_contains(held, w) GROUP BY query_id)
SELECT query_id, array_to_string(smart, ' ') AS smart, array_to_string(list_concat(coalesce(found, []), list_filter(regexp_extract_all(query, '[\p{{Latin}}\p{{Greek}}\p{{N}}_]+'), lambda x: length(x) > 1)), ' ') AS max_word FROM s LEFT JOIN m USING (query_id)"""
)
def analyze_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by a word list: the longest word at each place, and all words."""
    known = _dictionary(spark, d)
    smart, every = text.dictionary_analyzer(known), text.dictionary_analyzer(known, "max_word")
    return table(spark, d, "queries").where("query IS NOT NULL").select("query_id", F.array_join(smart(F.col("query")), " ").alias("smart"), F.array_join(every(F.col("query")), " ").alias("max_word"))


@query(f"SELECT doc_id, CASE WHEN length({stripped('text')}) > 0 THEN round(length(text) / sqrt(length(text)::DOUBLE * length(text) + 1), 5) END AS x FROM documents")
def embed_model(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a model called on the workers, in batches, each with its own row; no vector for blank texts."""
    out = vectors.embed_with(texts(spark, d, "documents").select("doc_id", "text"), "text", lambda batch: [[float(len(t)), 1.0] for t in batch], batch=32)
    return out.select("doc_id", F.round(F.col("content_vector")[0].cast("double"), 5).alias("x"))


# Retrieval drivers ---------------------------------------------------------------------------------------------


@query("WITH " + bm25_sql(LATEST_CHUNKS, {"content": 1}, "chunk_id", k1=1.2) + " SELECT qid AS query_id, id AS chunk_id, score, rank::BIGINT AS rank FROM top")
def match_field(spark: SparkSession, d: str) -> DataFrame:
    """A match on one field only."""
    ix = index.build_index(latest_chunks(spark, d, "content"), "chunk_id", ["content"])
    return retrieve.text_search(ix, _terms(spark, d), 5, k1=1.2).select(F.col("qid").alias("query_id"), F.col("id").alias("chunk_id"), "score", F.col("rank").cast("long").alias("rank"))


@query("WITH " + bm25_sql("SELECT doc_id, text FROM documents", {"text": 1}, "doc_id") + " SELECT qid AS query_id, id AS doc_id, score FROM top WHERE score > 12")
def bm25_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Hits above a threshold, after the best five were taken."""
    ix = index.build_index(texts(spark, d, "documents"), "doc_id", ["text"])
    return retrieve.text_search(ix, _terms(spark, d), 5, 12.0, strict=True).select(F.col("qid").alias("query_id"), F.col("id").alias("doc_id"), "score")


USABLE = "content_vector IS NOT NULL AND len(content_vector) = 64 AND list_inner_product(content_vector::DOUBLE[], content_vector::DOUBLE[]) > 0"
#: A query's vector is that of its best hit that has one.
QUERY_VECTORS = f"qv AS (SELECT query_id AS qid, content_vector::DOUBLE[] AS v FROM hits JOIN docs ON hits.id = chunk_id WHERE {USABLE} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hits.id) = 1)"


def _vector_sql(k: int, where: str = "TRUE") -> str:
    return f"""{QUERY_VECTORS}, vs AS (SELECT qid, chunk_id AS id, round((1 + list_cosine_similarity(v, content_vector::DOUBLE[])) / 2, 6) AS score FROM qv, docs WHERE {USABLE} AND {where}),
vt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs QUALIFY rank <= {k})"""


RRF = "f AS (SELECT qid, id, round(coalesce(1.0 / (60 + top.rank), 0) + coalesce(1.0 / (60 + vt.rank), 0), 8) AS score, CASE WHEN top.rank IS NOT NULL AND vt.rank IS NOT NULL THEN 'hybrid' WHEN top.rank IS NOT NULL THEN 'text' ELSE 'vector' END AS recall_source FROM top FULL JOIN vt USING (qid, id))"


def _query_vectors(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """(qid, vector): a query's vector is that of its best hit that has one."""
    v = F.col("content_vector")
    usable = chunks.where(v.isNotNull() & (F.size(v) == 64) & (vectors.norm(v) > 0)).select(F.col("chunk_id").alias("id"), v.alias("vector"))
    h = table(spark, d, "hits").where("id IS NOT NULL").select(F.col("query_id").alias("qid"), "id", "score").join(usable, "id")
    return h.groupBy("qid").agg(F.min_by("vector", F.struct(-F.col("score"), "id")).alias("vector"))


def _parts(spark: SparkSession, d: str, *more: str) -> tuple[DataFrame, index.InvertedIndex, DataFrame]:
    """Latest chunks, the index of their texts, and the queries' vectors, each stored once."""
    chunks = materialize(latest_chunks(spark, d, "content", "content_vector", *more))
    return chunks, index.build_index(chunks, "chunk_id", ["content"]), materialize(_query_vectors(spark, d, chunks))


@query("WITH " + bm25_sql(LATEST_CHUNKS, {"content": 1}, "chunk_id", k=20) + ", " + _vector_sql(20) + ", " + RRF + " SELECT qid AS query_id, id, score, recall_source, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::BIGINT AS rank FROM f QUALIFY rank <= 10")
def hybrid_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Text and vector search over all chunks, fused by reciprocal ranks."""
    chunks, ix, asked = _parts(spark, d)
    held = chunks.select(F.col("chunk_id").alias("id"), F.col("content_vector").alias("vector"))
    got = retrieve.hybrid_search(ix, held, asked, _terms(spark, d), 10)
    return got.select(F.col("qid").alias("query_id"), "id", "score", "recall_source", F.col("rank").cast("long").alias("rank"))


@query(
    "WITH "
    + bm25_sql(LATEST_CHUNKS, {"content": 1}, "chunk_id", allowed="id IN (SELECT chunk_id FROM docs WHERE chunk_level = 0)", k=40)
    + ", "
    + _vector_sql(40, "chunk_level = (SELECT max(chunk_level) FROM docs)")
    + ", "
    + RRF
    + """, s AS (SELECT qid, id, score FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 20),
k AS (SELECT s.*, content, coalesce(chunk_level, 0) = 0 AS top_, parent_id FROM s JOIN docs ON id = chunk_id),
g AS (SELECT qid, CASE WHEN top_ THEN id WHEN parent_id IS NOT NULL THEN parent_id ELSE 'fallback_' || id END AS key, NOT top_ AND parent_id IS NOT NULL AS from_parent, score FROM k),
b AS (SELECT qid, key, from_parent, round(max(score), 8) AS score, count(*) AS small_chunks FROM g GROUP BY ALL)
SELECT qid AS query_id, key AS id, score, small_chunks, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key)::BIGINT AS rank FROM b WHERE NOT from_parent OR key IN (SELECT chunk_id FROM docs WHERE content IS NOT NULL) QUALIFY rank <= 5"""
)
def small_to_big(spark: SparkSession, d: str) -> DataFrame:
    """Text search over the top level and vector search over the deepest, expanded to the chunks that enclose the hits."""
    chunks, ix, asked = _parts(spark, d, "parent_id", "root_id", "chunk_level", "chunk_index")
    got = retrieve.small_to_big(ix, chunks, _terms(spark, d), asked, 5, 20)
    return got.select(F.col("qid").alias("query_id"), "id", "score", F.col("source_small_chunks_count").alias("small_chunks"), F.col("rank").cast("long").alias("rank"))


@query(
    "WITH "
    + bm25_sql(LATEST_CHUNKS, {"content": 1}, "chunk_id", k=200)
    + ", "
    + _vector_sql(200)
    + """, want AS (SELECT query_id AS qid, coalesce(search_type, 'hybrid') AS kind, least(coalesce(top_k, 10), 100) AS k FROM queries WHERE query_id IN (SELECT qid FROM qv)),
tt AS (SELECT top.*, kind, k FROM top JOIN want USING (qid) WHERE rank <= k * CASE kind WHEN 'hybrid' THEN 2 ELSE 1 END AND kind <> 'vector'), vv AS (SELECT vt.*, kind, k FROM vt JOIN want USING (qid) WHERE rank <= k * CASE kind WHEN 'hybrid' THEN 2 ELSE 1 END AND kind <> 'text'),
f AS (SELECT qid, id, round(coalesce(1.0 / (60 + t.rank), 0) + coalesce(1.0 / (60 + v.rank), 0), 8) AS score, CASE WHEN t.rank IS NOT NULL AND v.rank IS NOT NULL THEN 'hybrid' WHEN t.rank IS NOT NULL THEN 'text' ELSE 'vector' END AS recall_source FROM (SELECT * FROM tt WHERE kind = 'hybrid') t FULL JOIN (SELECT * FROM vv WHERE kind = 'hybrid') v USING (qid, id)),
o AS (SELECT f.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, k FROM f JOIN want USING (qid) QUALIFY rank <= k),
u AS (SELECT qid, id, score, recall_source, rank FROM o UNION ALL SELECT qid, id, score, 'text', rank FROM tt WHERE kind = 'text' UNION ALL SELECT qid, id, score, 'vector', rank FROM vv WHERE kind = 'vector')
SELECT qid AS query_id, id, score, recall_source, rank::BIGINT AS rank, count(*) OVER (PARTITION BY qid) AS result_count FROM u"""
)
def search_by_request(spark: SparkSession, d: str) -> DataFrame:
    """Each query by its own search type and for as many hits as it asks for; queries without a vector are left out."""
    chunks, ix, vectors_ = _parts(spark, d)
    held = chunks.select(F.col("chunk_id").alias("id"), F.col("content_vector").alias("vector"))
    asked = table(spark, d, "queries").select(F.col("query_id").alias("qid"), "search_type", "top_k").join(vectors_, "qid")
    got = retrieve.search(ix, held, asked, _terms(spark, d).join(asked.select("qid"), "qid", "left_semi"))
    return got.select(F.col("qid").alias("query_id"), "id", "score", "recall_source", F.col("rank").cast("long").alias("rank"), "result_count")


# Reranking -----------------------------------------------------------------------------------------------------

FIVE = CARD_HITS.replace("<= 3", "<= 5")


def _five(spark: SparkSession, d: str) -> DataFrame:
    """(qid, id, score, rank, content): the five best hits of every query, with their texts."""
    h = table(spark, d, "hits").where("id IS NOT NULL").groupBy(F.col("query_id").alias("qid"), "id").agg(F.max("score").alias("score"))
    c = latest_chunks(spark, d, "content").select(F.col("chunk_id").alias("id"), "content")
    return retrieve.ranked(h, 5, ["qid"], "score", "id").join(c, "id", "left")


@query(f"WITH {FIVE}, s AS (SELECT query_id, id, (length(coalesce(content, '')) % 11)::DOUBLE AS rerank_score FROM j) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id)::BIGINT AS rank FROM s WHERE rerank_score >= 2 QUALIFY rank <= 3")
def rerank_pointwise(spark: SparkSession, d: str) -> DataFrame:
    """A score per hit, read from a model's answer."""
    asked = rerank.ask(_five(spark, d).withColumn("prompt", F.coalesce("content", F.lit(""))), "prompt", lambda t: f"Score: {len(t) % 11}")
    return rerank.by_score_answer(asked.drop("rank"), "answer", 3, 2.0).select(F.col("qid").alias("query_id"), "id", "rerank_score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FIVE} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY length(coalesce(content, '')) DESC, rank)::BIGINT AS new_rank FROM j QUALIFY new_rank <= 4")
def rerank_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Hits in the order of a comparator: the longer text wins, equal ones keep their order."""
    h = _five(spark, d).withColumns({"content": F.coalesce("content", F.lit("")), "query": F.lit("")})
    return rerank.by_comparison(h, lambda q, a, b: len(a) > len(b), 4).select(F.col("qid").alias("query_id"), "id", F.col("new_rank").cast("long").alias("new_rank"))


def _service_answers(hits: DataFrame) -> DataFrame:
    """A service's JSON per query: the hits of odd rank, last first."""
    odd = hits.where("rank % 2 = 1").groupBy("qid").agg(F.reverse(F.array_sort(F.collect_list(F.struct((F.col("rank") - 1).alias("index"), F.round(1 / F.col("rank"), 3).alias("relevance_score"))))).alias("results"))
    return odd.select("qid", F.to_json(F.struct("results")).alias("answer"))


SERVED = f"WITH {FIVE}, s AS (SELECT query_id, id, rank, CASE WHEN rank % 2 = 1 THEN round(1 / rank, 3) END AS rerank_score, CASE WHEN rank % 2 = 1 THEN 10 - rank END AS p FROM r)"


@query(SERVED + " SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY p NULLS LAST, rank)::BIGINT AS new_rank FROM s QUALIFY new_rank <= 4")
def rerank_service(spark: SparkSession, d: str) -> DataFrame:
    """The order of a service's answer, then the hits it left out."""
    h = _five(spark, d)
    return rerank.by_service(h, _service_answers(h), 4).select(F.col("qid").alias("query_id"), "id", "rerank_score", F.col("new_rank").cast("long").alias("new_rank"))


@query(SERVED + " SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY p)::BIGINT AS new_rank FROM s WHERE p IS NOT NULL")
def rerank_service_alone(spark: SparkSession, d: str) -> DataFrame:
    """The order of a service's answer only."""
    h = _five(spark, d)
    return rerank.by_service(h, _service_answers(h), 5, pad=False).select(F.col("qid").alias("query_id"), "id", "rerank_score", F.col("new_rank").cast("long").alias("new_rank"))


@query("WITH b AS (SELECT query_id, id, max(rerank_score) AS s FROM hits WHERE id IS NOT NULL GROUP BY ALL) SELECT query_id, count(*) AS documents_before, least(count_if(s >= 0.5), 10)::BIGINT AS documents_after FROM b GROUP BY query_id")
def rerank_report(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each query before and after a reranking with a threshold."""
    h = table(spark, d, "hits").where("id IS NOT NULL").groupBy(F.col("query_id").alias("qid"), "id").agg(F.max("rerank_score").alias("rerank_score"))
    return rerank.rerank_report(h, rerank.keep_top(h, 10, 0.5)).withColumnRenamed("qid", "query_id")


@query("SELECT query_id, CASE WHEN length(query) % 3 > 0 THEN 'answer ' || length(query) END AS answer FROM queries")
def ask_fail_open(spark: SparkSession, d: str) -> DataFrame:
    """A model that fails for some rows: those get no answer, the others keep theirs."""

    def model(t: str) -> str:
        if len(t) % 3 == 0:
            raise OSError("down")
        return f"answer {len(t)}"

    return rerank.ask(table(spark, d, "queries").select("query_id", "query"), "query", model, retries=2, fail_open=True).select("query_id", "answer")


# Generation ----------------------------------------------------------------------------------------------------


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return _card_hits(spark, d).withColumn("title", text.title(F.col("filename"), F.col("source"), F.col("id")))


CONTEXT = f"WITH {CARD_HITS}, x AS (SELECT query_id, string_agg('文档' || rank || ' - ' || title || ':' || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM j GROUP BY query_id)"


@query(CONTEXT + " SELECT query_id, context FROM x")
def full_context(spark: SparkSession, d: str) -> DataFrame:
    return prompts.context(_titled(spark, d)).select(F.col("qid").alias("query_id"), "context")


@query(CONTEXT + f", p AS (SELECT query_id, {_filled(prompts.TEMPLATES['retrieval_prompt'], documents='coalesce(context, ' + repr(prompts.NO_DOCUMENTS) + ')', question='coalesce(query, ' + repr('') + ')')} AS prompt FROM queries LEFT JOIN x USING (query_id)) SELECT query_id, prompt, 'read ' || length(prompt) || ': ' || substring(prompt, 1, 20) AS answer FROM p")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model to the prompt of each query with its hits."""
    q = table(spark, d, "queries").select(F.col("query_id").alias("qid"), "query")
    got = generate.model_answers(q, _titled(spark, d), lambda p: f"read {len(p)}: {p[:20]}")
    return got.select(F.col("qid").alias("query_id"), "prompt", "answer")
