"""Named queries over a data folder, each with the DuckDB SQL of the same result where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import prompts, text, understanding
from marlstone.operators import generate, index, ivf, newwords, rerank, retrieve, split, stats
from marlstone.session import shared_dir, table, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Shared SQL ----------------------------------------------------------------------------------------------------

TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1)"
SEGMENTED = r"list_filter(string_split_regex(lower({c}), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+'), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[[:punct:]]+'))"
LATEST_CHUNKS = "SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST) = 1"


def bm25_sql(docs: str, fields: dict[str, float], id_: str, k1: float = 1.5, okapi: bool = False, allowed: str = "TRUE", queries: str = "SELECT query_id AS qid, query AS t FROM queries", tokens: str = TOKENS, k: int = 5) -> str:
    """(qid, id, score, rank) of the k best."""
    per_field = " UNION ALL ".join(f"SELECT '{f}' AS field, {float(w)} AS boost, {id_} AS id, {tokens.format(c=f)} AS toks FROM docs WHERE {f} IS NOT NULL" for f, w in fields.items())
    idf = "CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY field) ELSE raw END" if okapi else "ln((n - df + 0.5) / (df + 0.5) + 1)"
    return f"""
docs AS ({docs}), toks AS ({per_field}),
lens AS (SELECT field, boost, id, len(toks) AS dl FROM toks WHERE len(toks) > 0),
stat AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY field),
post AS (SELECT field, id, term, count(*) AS tf FROM (SELECT field, id, unnest(toks) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT field, term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT field, term, count(*) AS df FROM post GROUP BY ALL) JOIN stat USING (field)),
idfs AS (SELECT field, term, avgdl, {idf} AS idf FROM dfs),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens.format(c='t')}) AS term FROM ({queries})) GROUP BY ALL),
scored AS (
  SELECT qid, id, round(sum(boost * qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))), 4) AS score
  FROM qt JOIN idfs USING (term) JOIN post USING (field, term) JOIN lens USING (field, id) WHERE {allowed} GROUP BY ALL {'HAVING sum(boost * qtf * idf * tf * (%s + 1) / (tf + %s * (1 - 0.75 + 0.75 * dl / avgdl))) > 0' % (k1, k1) if okapi else ''}
), top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= {k})"""


TOP = " SELECT qid AS query_id, id AS doc_id, score, rank::BIGINT AS rank FROM top"


def _named(hits: DataFrame, id_col: str) -> DataFrame:
    return hits.select(F.col("qid").alias("query_id"), F.col("id").alias(id_col), "score", F.col("rank").cast("long").alias("rank"))


def _terms(spark: SparkSession, d: str, analyzer: str = "plain") -> DataFrame:
    return retrieve.query_terms(table(spark, d, "queries"), "query_id", "query", analyzer)


def latest_chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """The last row of each chunk; only the named columns are read, for a reduced row is shuffled whole."""
    rows = table(spark, d, "chunks").where("chunk_id IS NOT NULL")
    return index.latest(rows.select("chunk_id", *cols, "indexed_at"), ["chunk_id"], ["indexed_at"])


# Text retrieval ------------------------------------------------------------------------------------------------


@query("WITH " + bm25_sql("SELECT doc_id, text FROM documents", {"text": 1}, "doc_id") + TOP)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    ix = index.build_index(texts(spark, d, "documents"), "doc_id", ["text"])
    return _named(retrieve.text_search(ix, _terms(spark, d), 5), "doc_id")


@query("WITH " + bm25_sql("SELECT doc_id, text FROM documents", {"text": 1}, "doc_id", k1=1.2, okapi=True) + TOP)
def bm25_okapi_topk(spark: SparkSession, d: str) -> DataFrame:
    ix = index.build_index(texts(spark, d, "documents"), "doc_id", ["text"])
    return _named(retrieve.text_search(ix, _terms(spark, d), 5, k1=1.2, variant="okapi"), "doc_id")


FIELDS = {"text": 2.0, "filename": 1.5, "source": 1.0}


@query("WITH " + bm25_sql("SELECT doc_id, text, filename, source FROM documents", FIELDS, "doc_id", k1=1.2) + TOP)
def bm25_multifield(spark: SparkSession, d: str) -> DataFrame:
    ix = index.build_index(texts(spark, d, "documents"), "doc_id", list(FIELDS))
    return _named(retrieve.text_search(ix, _terms(spark, d), 5, k1=1.2, boosts=FIELDS), "doc_id")


@query("WITH " + bm25_sql("SELECT doc_id, text FROM documents", {"text": 1}, "doc_id", allowed="id IN (SELECT doc_id FROM documents WHERE lang = 'en')") + TOP)
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d, "documents")
    ix = index.build_index(docs, "doc_id", ["text"])
    return _named(retrieve.text_search(ix, _terms(spark, d), 5, allowed=docs.where("lang = 'en'").select(F.col("doc_id").alias("id"))), "doc_id")


@query("WITH " + bm25_sql(LATEST_CHUNKS, {"content_jieba": 1}, "chunk_id", queries="SELECT query_id AS qid, query AS t FROM queries", tokens=SEGMENTED) + TOP.replace("doc_id", "chunk_id"))
def bm25_segmented(spark: SparkSession, d: str) -> DataFrame:
    ix = index.build_index(latest_chunks(spark, d, "content_jieba"), "chunk_id", {"content_jieba": "segmented"})
    return _named(retrieve.text_search(ix, _terms(spark, d, "segmented"), 5), "chunk_id")


EXPANSIONS = "SELECT query_id || '/' || (i - 1) AS qid, parts[i] AS t FROM (SELECT query_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT query_id, CASE WHEN len(expanded_queries) > 0 THEN expanded_queries ELSE [query] END AS parts FROM queries)) WHERE parts[i] IS NOT NULL"


@query(
    "WITH "
    + bm25_sql("SELECT doc_id, text FROM documents", {"text": 1}, "doc_id", queries=EXPANSIONS, k=10)
    + """, best AS (SELECT split_part(qid, '/', 1) AS q, id, score, split_part(qid, '/', 2)::INT AS no FROM top QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY score DESC, no) = 1)
SELECT q AS query_id, id AS doc_id, score, 'query_' || no AS query_source, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::BIGINT AS rank FROM best QUALIFY rank <= 10"""
)
def multi_query_dedup(spark: SparkSession, d: str) -> DataFrame:
    ix = index.build_index(texts(spark, d, "documents"), "doc_id", ["text"])
    got = retrieve.multi_query(ix, table(spark, d, "queries"), "query_id", "query", "expanded_queries", 10)
    return got.select(F.col("qid").alias("query_id"), F.col("id").alias("doc_id"), "score", "query_source", F.col("rank").cast("long").alias("rank"))


# Vector retrieval ----------------------------------------------------------------------------------------------


def _knn(spark: SparkSession, d: str, metric: str, where: str = "TRUE") -> DataFrame:
    e = table(spark, d, "embeddings")
    got = retrieve.vector_search(e.where(where), e.where("vec_id % 100 = 0"), 5, "vec_id", "embedding", "vec_id", "embedding", metric, exclude_self=True)
    return got.select(F.col("qid").alias("query_id"), F.col("id").alias("vec_id"), (F.col("score") + 0.0).alias("score"), F.col("rank").cast("long").alias("rank"))


def _knn_sql(score: str, where: str = "TRUE") -> str:
    return f"""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round({score}, 6) + 0.0 AS score FROM v q JOIN (SELECT * FROM v WHERE {where}) v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank FROM s QUALIFY rank <= 5"""


for _name, _args, _score, _where in (
    ("knn_cosine_topk", ("cosine",), "list_cosine_similarity(q.e, v.e)", "TRUE"),
    ("knn_dot", ("dot_product",), "list_inner_product(q.e, v.e)", "TRUE"),
    ("knn_euclid", ("euclidean",), "1 / (1 + list_distance(q.e, v.e))", "TRUE"),
    ("knn_filtered", ("cosine", "label < 5"), "list_cosine_similarity(q.e, v.e)", "label < 5"),
):
    QUERIES[_name] = partial(lambda spark, d, args: _knn(spark, d, *args), args=_args)
    SQL[_name] = _knn_sql(_score, _where)


@query(_knn_sql("(1 + list_cosine_similarity(q.e, v.e)) / 2"))
def knn_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Search in a saved and loaded index of files by centroid, with as many candidates as there are vectors: exact."""
    e, path = table(spark, d, "embeddings"), f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    ivf.VectorIndex.build(e, "vec_id", "embedding").save(path)
    got = ivf.VectorIndex.load(spark, path).search(e.where("vec_id % 100 = 0"), 5, e.count(), "vec_id", "embedding", exclude_self=True)
    return got.select(F.col("qid").alias("query_id"), F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(_knn_sql("list_inner_product(q.e, v.e)").replace("FROM v q JOIN", "FROM (SELECT -1 AS vec_id, list_transform(range(64), lambda i: 0.1::DOUBLE) AS e) q JOIN").replace("WHERE q.vec_id % 100 = 0", ""))
def knn_constant(spark: SparkSession, d: str) -> DataFrame:
    """Smoke search with a constant vector."""
    e = table(spark, d, "embeddings")
    q = spark.range(1).select(F.lit(-1).cast("long").alias("vec_id"), F.array_repeat(F.lit(0.1), 64).alias("embedding"))
    got = retrieve.vector_search(e, q, 5, "vec_id", "embedding", "vec_id", "embedding", "dot_product")
    return got.select(F.col("qid").cast("int").alias("query_id"), F.col("id").alias("vec_id"), (F.col("score") + 0.0).alias("score"), F.col("rank").cast("long").alias("rank"))


# Fusion and expansion ------------------------------------------------------------------------------------------

HITS = "SELECT query_id AS qid, id, max(text_score) AS text_score, max(vector_score) AS vector_score, min(text_rank) AS text_rank, min(vector_rank) AS vector_rank FROM hits WHERE id IS NOT NULL GROUP BY ALL"
SOURCE = "CASE WHEN text_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'hybrid' WHEN text_rank IS NOT NULL THEN 'text' ELSE 'vector' END"


def _merged_hits(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hits").where("id IS NOT NULL")
    return h.groupBy(F.col("query_id").alias("qid"), "id").agg(F.max("text_score").alias("text_score"), F.max("vector_score").alias("vector_score"), F.min("text_rank").alias("text_rank"), F.min("vector_rank").alias("vector_rank"))


def _fused(df: DataFrame) -> DataFrame:
    return df.select(F.col("qid").alias("query_id"), "id", "score", "recall_source", F.col("rank").cast("long").alias("rank"))


def _fusion_sql(score: str, where: str = "TRUE") -> str:
    return f"""WITH h AS ({HITS}), s AS (SELECT qid AS query_id, id, round({score}, 8) AS score, {SOURCE} AS recall_source FROM h)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM s WHERE {where} QUALIFY rank <= 10"""


@query(_fusion_sql("coalesce(1.0 / (60 + text_rank), 0) + coalesce(1.0 / (60 + vector_rank), 0)"))
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(retrieve.fuse_scores(_merged_hits(spark, d), "rrf", 10))


@query(_fusion_sql("coalesce(text_score, 0) * 1.0 + coalesce(vector_score, 0) * 1.2", "score >= 0.8 * 0.75"))
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(retrieve.fuse_scores(_merged_hits(spark, d), "weighted", 10, threshold=0.75))


@query(
    "WITH "
    + bm25_sql(LATEST_CHUNKS, {"content": 1}, "chunk_id", allowed="id IN (SELECT chunk_id FROM docs WHERE chunk_level = 0)", k=20)
    + """, v AS (SELECT query_id AS qid, id, max(vector_score) AS score FROM hits JOIN docs ON id = chunk_id WHERE chunk_level = 2 AND vector_score IS NOT NULL GROUP BY ALL),
vt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM v QUALIFY rank <= 20),
f AS (SELECT qid, id, round(coalesce(1.0 / (60 + top.rank), 0) + coalesce(1.0 / (60 + vt.rank), 0), 8) AS score FROM top FULL JOIN vt USING (qid, id))
SELECT qid AS query_id, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::BIGINT AS rank FROM f QUALIFY rank <= 10"""
)
def hybrid_differential(spark: SparkSession, d: str) -> DataFrame:
    """Text search over level-0 chunks fused with the vector hits on level-2 chunks."""
    chunks = latest_chunks(spark, d, "content", "chunk_level")
    ix = index.build_index(chunks, "chunk_id", ["content"])
    level = lambda n: chunks.where(F.col("chunk_level") == n).select(F.col("chunk_id").alias("id"))
    words = retrieve.text_search(ix, _terms(spark, d), 20, allowed=level(0))
    vec = table(spark, d, "hits").where("vector_score IS NOT NULL").join(level(2), "id", "left_semi").groupBy(F.col("query_id").alias("qid"), "id").agg(F.max("vector_score").alias("score"))
    return _fused(retrieve.fuse(words, retrieve.ranked(vec, 20, ["qid"], "score", "id"), "rrf", 10)).drop("recall_source")


def _small_hits(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hits").where("id IS NOT NULL")
    return h.groupBy(F.col("query_id").alias("qid"), "id").agg(F.max("score").alias("score"))


def _small2big(spark: SparkSession, d: str, fusion: str) -> DataFrame:
    got = retrieve.expand_parents(_small_hits(spark, d), latest_chunks(spark, d, "parent_id", "root_id", "chunk_level", "chunk_index", "content"), "parent", fusion, 5)
    return got.select(F.col("qid").alias("query_id"), "id", "score", F.col("source_small_chunks_count").alias("small_chunks"), "max_small_score", "avg_small_score", "is_fallback", F.length("content").cast("long").alias("characters"), F.col("rank").cast("long").alias("rank"))


def _small2big_sql(score: str) -> str:
    return f"""
WITH c AS ({LATEST_CHUNKS}), h AS (SELECT query_id, id, max(score) AS score FROM hits WHERE id IS NOT NULL GROUP BY ALL),
k AS (SELECT h.*, content, coalesce(chunk_level, 0) = 0 AS top, parent_id FROM h JOIN c ON id = chunk_id),
g AS (SELECT query_id, CASE WHEN top THEN id WHEN parent_id IS NOT NULL THEN parent_id ELSE 'fallback_' || id END AS key, NOT top AND parent_id IS NULL AS is_fallback, NOT top AND parent_id IS NOT NULL AS from_parent, score, CASE WHEN top OR parent_id IS NULL THEN content END AS own FROM k),
s AS (SELECT query_id, key, is_fallback, from_parent, round({score}, 8) AS score, count(*) AS small_chunks, round(max(score), 8) AS max_small_score, round(avg(score), 8) AS avg_small_score, max(own) AS own FROM g GROUP BY ALL)
SELECT query_id, key AS id, score, small_chunks, max_small_score, avg_small_score, is_fallback, length(coalesce(content, own)) AS characters,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::BIGINT AS rank
FROM (SELECT s.*, content FROM s LEFT JOIN c ON key = chunk_id WHERE NOT from_parent OR content IS NOT NULL) QUALIFY rank <= 5"""


for _how, _sql in (("max", "max(score)"), ("avg", "avg(score)"), ("weighted_avg", "sum(score * score) / sum(score)")):
    QUERIES[f"small2big_{_how}"] = partial(lambda spark, d, how: _small2big(spark, d, how), how=_how)
    SQL[f"small2big_{_how}"] = _small2big_sql(_sql)


@query(
    f"""
WITH c AS ({LATEST_CHUNKS}), h AS (SELECT query_id, id, max(score) AS score FROM hits WHERE id IS NOT NULL GROUP BY ALL),
p AS (SELECT h.query_id, h.id, h.score, b.chunk_id AS key FROM h JOIN c ON h.id = c.chunk_id JOIN c b ON b.root_id = c.root_id AND b.chunk_level = 0
  QUALIFY row_number() OVER (PARTITION BY h.query_id, h.id ORDER BY NOT coalesce(contains(b.content, c.content), FALSE), b.chunk_index NULLS FIRST, b.chunk_id) = 1)
SELECT query_id, key AS id, round(max(score), 8) AS score, count(*) AS small_chunks, row_number() OVER (PARTITION BY query_id ORDER BY round(max(score), 8) DESC, key)::BIGINT AS rank
FROM p WHERE key IN (SELECT chunk_id FROM c WHERE content IS NOT NULL) GROUP BY query_id, key QUALIFY rank <= 5"""
)
def root_expansion(spark: SparkSession, d: str) -> DataFrame:
    got = retrieve.expand_parents(_small_hits(spark, d), latest_chunks(spark, d, "parent_id", "root_id", "chunk_level", "chunk_index", "content"), "root", "max", 5)
    return got.select(F.col("qid").alias("query_id"), "id", "score", F.col("source_small_chunks_count").alias("small_chunks"), F.col("rank").cast("long").alias("rank"))


@query("SELECT 'chunk_level' AS field_path, coalesce(max(chunk_level), 2) AS small_level, array_to_string(list_sort(list(DISTINCT chunk_level) FILTER (chunk_level IS NOT NULL)), ',') AS levels FROM chunks")
def small_level(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.detect_small_level(table(spark, d, "chunks")).select("field_path", "small_level", F.array_join("available_levels", ",").alias("levels"))


@query("SELECT query_id, id, score, rerank_score FROM hits WHERE score >= 0.1 AND recall_source = 'vector' OR score >= 20 AND recall_source = 'text'")
def score_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits").where("(score >= 0.1 AND recall_source = 'vector') OR (score >= 20 AND recall_source = 'text')").select("query_id", "id", "score", "rerank_score")


# Splitting -----------------------------------------------------------------------------------------------------


@query(
    r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS pos FROM w WHERE len(w) > 0)
SELECT doc_id, (pos / 80)::INT AS chunk_index, array_to_string(w[pos + 1:pos + 100], ' ') AS chunk FROM s"""
)
def split_word(spark: SparkSession, d: str) -> DataFrame:
    return split.split_words(texts(spark, d, "documents"), "doc_id", "text", 100, 20)


@query(
    r"""
WITH RECURSIVE s AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?。！？]+'), lambda x: regexp_replace(x, '^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS s FROM documents
), f AS (
  SELECT doc_id, s, 1 AS i, length(s[1]) AS n, 0 AS no FROM s WHERE len(s) > 0
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN n + length(s[i + 1]) > 500 THEN length(s[i + 1]) ELSE n + 1 + length(s[i + 1]) END, CASE WHEN n + length(s[i + 1]) > 500 THEN no + 1 ELSE no END FROM f WHERE i < len(s)
)
SELECT doc_id, no AS chunk_index, string_agg(s[i], ' ' ORDER BY i) AS chunk FROM f GROUP BY doc_id, no"""
)
def split_sentence(spark: SparkSession, d: str) -> DataFrame:
    return split.split_sentences(texts(spark, d, "documents"), "doc_id", "text", 500)


@query()
def split_char(spark: SparkSession, d: str) -> DataFrame:
    return split.split_characters(texts(spark, d, "documents"), "doc_id", "text", 500, 50)


@query()
def split_recursive(spark: SparkSession, d: str) -> DataFrame:
    return split.split_recursive(texts(spark, d, "documents"), "doc_id", "text", 500, 50)


@query()
def split_semantic(spark: SparkSession, d: str) -> DataFrame:
    return split.split_semantic(texts(spark, d, "documents"), "doc_id", "text", 500, 0.1)


@query()
def split_token_sentence(spark: SparkSession, d: str) -> DataFrame:
    return split.split_tokens(texts(spark, d, "documents"), "doc_id", "text", 256, 32)


@query()
def split_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return split.split_hierarchy(texts(spark, d, "documents"), "doc_id", "text", [1536, 512, 128], 50)


@query(
    f"""
WITH c AS ({LATEST_CHUNKS}), l AS (SELECT chunk_id, root_id, chunk_index, (CASE WHEN length(content) >= 1536 * 0.8 THEN 0 WHEN length(content) >= 512 * 0.8 THEN 1 ELSE 2 END)::INT AS level FROM c)
SELECT chunk_id, level, row_number() OVER (PARTITION BY root_id, level ORDER BY chunk_index NULLS FIRST, chunk_id) - 1 AS position FROM l"""
)
def hierarchy_levels(spark: SparkSession, d: str) -> DataFrame:
    got = split.assign_levels(latest_chunks(spark, d, "root_id", "chunk_index", "content"), [1536, 512, 128])
    return got.select("chunk_id", "level", F.col("position").cast("long").alias("position"))


@query(
    f"""
WITH c AS ({LATEST_CHUNKS})
SELECT a.chunk_id, first(b.chunk_id ORDER BY b.chunk_index, b.chunk_id) AS found_parent
FROM c a JOIN c b ON a.root_id = b.root_id AND b.chunk_level = a.chunk_level - 1 AND contains(b.content, a.content) GROUP BY a.chunk_id"""
)
def hierarchy_parent(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of the level above, in the same root, whose text contains the chunk."""
    return split.find_parents(latest_chunks(spark, d, "root_id", "chunk_level", "chunk_index", "content"))


@query(f"WITH c AS ({LATEST_CHUNKS}) SELECT chunk_id FROM c WHERE chunk_id NOT IN (SELECT parent_id FROM c WHERE parent_id IS NOT NULL)")
def hierarchy_leaves(spark: SparkSession, d: str) -> DataFrame:
    return split.leaves(latest_chunks(spark, d, "parent_id")).select("chunk_id")


@query(f"WITH c AS ({LATEST_CHUNKS}) SELECT chunk_id, root_id FROM c WHERE parent_id IS NULL")
def hierarchy_roots(spark: SparkSession, d: str) -> DataFrame:
    return split.roots(latest_chunks(spark, d, "parent_id", "root_id")).select("chunk_id", "root_id")


@query(f"WITH c AS ({LATEST_CHUNKS}), d1 AS (SELECT chunk_id FROM c WHERE parent_id IN (SELECT chunk_id FROM c WHERE parent_id IS NULL)) SELECT chunk_id, parent_id FROM c WHERE parent_id IN (SELECT chunk_id FROM d1)")
def hierarchy_depth(spark: SparkSession, d: str) -> DataFrame:
    return split.at_depth(latest_chunks(spark, d, "parent_id"), 2).select("chunk_id", "parent_id")


@query(f"WITH c AS ({LATEST_CHUNKS}) SELECT parent_id, string_agg(chunk_id, ',' ORDER BY chunk_id) AS child_ids FROM c WHERE parent_id IS NOT NULL GROUP BY parent_id")
def hierarchy_children(spark: SparkSession, d: str) -> DataFrame:
    return index.children(latest_chunks(spark, d, "parent_id")).select("parent_id", F.array_join("child_ids", ",").alias("child_ids"))


@query(f"WITH c AS ({LATEST_CHUNKS}) SELECT chunk_id, CASE WHEN starts_with(content, '#') THEN 'header' ELSE 'text' END AS node_type, CASE WHEN starts_with(content, '#') THEN regexp_replace(regexp_replace(split_part(content, chr(10), 1), '^#+', ''), '^\\s+|\\s+$', '', 'g') END AS header_text FROM c")
def node_headers(spark: SparkSession, d: str) -> DataFrame:
    return split.node_headers(latest_chunks(spark, d, "content"), "chunk_id", "content").select("chunk_id", F.coalesce("node_type", F.lit("text")).alias("node_type"), "header_text")


# Statistics ----------------------------------------------------------------------------------------------------


@query(f"WITH t AS (SELECT doc_id, {TOKENS.format(c='text')} AS toks FROM documents), p AS (SELECT unnest(toks) AS term, doc_id FROM t) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM p GROUP BY term")
def posting_stats(spark: SparkSession, d: str) -> DataFrame:
    ix = index.build_index(texts(spark, d, "documents"), "doc_id", ["text"])
    return ix.postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@query(f"WITH t AS (SELECT len({TOKENS.format(c='text')}) AS dl FROM documents) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM t WHERE dl > 0")
def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.build_index(texts(spark, d, "documents"), "doc_id", ["text"]).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("SELECT source, count(*) AS docs FROM documents GROUP BY source ORDER BY docs DESC, source NULLS FIRST LIMIT 10")
def terms_agg_source(spark: SparkSession, d: str) -> DataFrame:
    return stats.docs_per_value(table(spark, d, "documents"), "source")


@query("SELECT count(DISTINCT source) AS n FROM chunks")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return stats.distinct_values(table(spark, d, "chunks"), "source")


@query("SELECT chunk_level, count(*) AS docs FROM chunks GROUP BY chunk_level")
def terms_agg_level(spark: SparkSession, d: str) -> DataFrame:
    return stats.docs_per_value(table(spark, d, "chunks"), "chunk_level", None)


@query('SELECT count(*) AS "rows", count(content_vector) AS with_vector, count(*) - count(content_vector) AS without_vector, coalesce(sum(length(content)), 0)::BIGINT AS characters, round(coalesce(sum(octet_length(encode(content))), 0) / 1048576, 4) AS megabytes FROM chunks')
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.index_stats(table(spark, d, "chunks"))


@query("SELECT split_method, count(content) AS n, min(length(content))::INT AS shortest, max(length(content))::INT AS longest, round(avg(length(content)), 4) AS mean FROM chunks GROUP BY split_method")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.length_stats(table(spark, d, "chunks"), "content", ["split_method"])


@query("SELECT query_id, count(*) AS hits, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score, round(avg(score), 6) AS avg_score, count_if(recall_source = 'text') AS from_text, count_if(recall_source = 'vector') AS from_vector, count_if(recall_source = 'hybrid') AS from_hybrid FROM hits GROUP BY query_id")
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.score_stats(table(spark, d, "hits"), ["query_id"])


@query(
    """
SELECT coalesce(nullif(lower(trim(status)), ''), 'unknown') AS status, count(*) AS runs, sum(total_files_read)::BIGINT AS files, sum(total_data_read)::BIGINT AS read, sum(total_data_produced)::BIGINT AS produced, sum(total_data_consumed)::BIGINT AS consumed,
  sum(greatest(total_data_produced - total_data_consumed, 0))::BIGINT AS lost, round(sum(total_time), 3) AS seconds, round(avg(total_time), 3) AS mean, max(total_time) AS longest, min(total_time) AS shortest, round(sum(CASE WHEN total_time > 0 THEN total_data_consumed END) / nullif(round(sum(total_time), 3), 0), 3) AS tps FROM ingest_stats GROUP BY 1"""
)
def ingest_throughput(spark: SparkSession, d: str) -> DataFrame:
    return stats.ingest_throughput(table(spark, d, "ingest_stats"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a type in the minute up to each request."""
    return stats.requests_in_window(table(spark, d, "events"), "ts", ["event_type"], 60).select("event_id", "in_window")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"WITH c AS ({LATEST_CHUNKS}) SELECT chunk_id, content, epoch_us(indexed_at) AS indexed_us FROM c")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table of the earlier half of the time, after the rows of the later half were upserted by chunk_id."""
    rows = table(spark, d, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", "content", "indexed_at")
    us = F.unix_micros(F.col("indexed_at").cast("timestamp"))
    first, last = rows.agg(F.min(us), F.max(us)).first()
    late = F.coalesce(us > ((first or 0) + (last or 0)) // 2, F.lit(False))
    base = index.upsert(rows.limit(0), rows.where(~late), ["chunk_id"], ["indexed_at"])
    return index.upsert(base, rows.where(late), ["chunk_id"], ["indexed_at"]).select("chunk_id", "content", us.alias("indexed_us"))


@query(f"WITH c AS ({LATEST_CHUNKS}) SELECT chunk_id FROM c WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT chunk_id FROM c)")
def parent_anti(spark: SparkSession, d: str) -> DataFrame:
    c = latest_chunks(spark, d, "parent_id")
    return c.where("parent_id IS NOT NULL").join(c.select(F.col("chunk_id").alias("parent_id")), "parent_id", "left_anti").select("chunk_id")


@query(f"WITH c AS ({LATEST_CHUNKS}) SELECT chunk_id FROM c WHERE parent_id IN (SELECT chunk_id FROM c)")
def parent_semi(spark: SparkSession, d: str) -> DataFrame:
    c = latest_chunks(spark, d, "parent_id")
    return c.join(c.select(F.col("chunk_id").alias("parent_id")), "parent_id", "left_semi").select("chunk_id")


# New words -----------------------------------------------------------------------------------------------------

NEW_WORDS = r"""
WITH clean AS (SELECT trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s一-鿿]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
total AS (SELECT sum(length(t)) + count(*) - 1 AS total FROM clean WHERE t <> ''),
w AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(t, ' ')) AS w FROM clean WHERE t <> '') WHERE w <> '' GROUP BY w),
pos AS (SELECT w, n, unnest(range(1, length(w))) AS i FROM w WHERE length(w) >= 2),
cut AS (SELECT w, n, i, unnest(range(2, least(6, length(w) - i + 1) + 1)) AS k FROM pos),
raw AS (SELECT substring(w, i, k) AS gram, CASE WHEN i > 1 THEN substring(w, i - 1, 1) ELSE ' ' END AS "left", CASE WHEN i + k <= length(w) THEN substring(w, i + k, 1) ELSE ' ' END AS "right", n FROM cut),
grams AS (SELECT gram, "left", "right", sum(n) AS n FROM raw WHERE NOT regexp_full_match(gram, '\p{Nd}+') AND regexp_matches(gram, '[一-鿿]') GROUP BY ALL),
counts AS (SELECT gram, sum(n) AS freq FROM grams GROUP BY gram),
frequent AS (SELECT * FROM counts WHERE freq >= 5),
lasts AS (SELECT substring(gram, -1, 1) AS ch, sum(freq) AS cf FROM counts GROUP BY 1), firsts AS (SELECT substring(gram, 1, 1) AS ch, sum(freq) AS cf FROM counts GROUP BY 1),
lp AS (SELECT f.gram, coalesce(log2(f.freq * total::DOUBLE / (p.freq * l.cf)), 0) AS left_pmi FROM frequent f CROSS JOIN total LEFT JOIN counts p ON p.gram = substring(f.gram, 1, length(f.gram) - 1) LEFT JOIN lasts l ON l.ch = substring(f.gram, -1, 1)),
rp AS (SELECT f.gram, coalesce(log2(f.freq * total::DOUBLE / (p.freq * l.cf)), 0) AS right_pmi FROM frequent f CROSS JOIN total LEFT JOIN counts p ON p.gram = substring(f.gram, 2) LEFT JOIN firsts l ON l.ch = substring(f.gram, 1, 1)),
le AS (SELECT gram, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS left_entropy FROM (SELECT gram, "left", sum(n) AS c FROM grams GROUP BY ALL) GROUP BY gram),
re AS (SELECT gram, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS right_entropy FROM (SELECT gram, "right", sum(n) AS c FROM grams GROUP BY ALL) GROUP BY gram),
pts AS (SELECT gram, freq, unnest(range(1, length(gram))) AS i FROM frequent),
co AS (SELECT p.gram, min(log2(p.freq * total::DOUBLE / (a.freq * b.freq))) AS c FROM pts p CROSS JOIN total JOIN counts a ON a.gram = substring(p.gram, 1, p.i) JOIN counts b ON b.gram = substring(p.gram, p.i + 1) GROUP BY p.gram),
ws AS (SELECT f.gram AS word, freq, left_pmi, right_pmi, least(left_pmi, right_pmi) AS min_pmi, left_entropy, right_entropy, least(left_entropy, right_entropy) AS min_entropy, coalesce(c, 0) AS cohesion
  FROM frequent f JOIN lp USING (gram) JOIN rp USING (gram) JOIN le USING (gram) JOIN re USING (gram) LEFT JOIN co USING (gram))
"""


@query(NEW_WORDS + "SELECT gram, freq::BIGINT AS freq FROM frequent")
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    words, _ = newwords.corpus_words(texts(spark, d, "documents"), "text")
    return newwords.gram_counts(newwords.ngrams(words)).where("freq >= 5")


@query(NEW_WORDS + "SELECT gram, round(left_entropy, 6) + 0.0 AS left_entropy, round(right_entropy, 6) + 0.0 AS right_entropy FROM frequent JOIN le USING (gram) JOIN re USING (gram)")
def neighbor_entropy(spark: SparkSession, d: str) -> DataFrame:
    words, _ = newwords.corpus_words(texts(spark, d, "documents"), "text")
    grams = newwords.ngrams(words)
    frequent = newwords.gram_counts(grams).where("freq >= 5")
    left, right = (newwords.neighbour_entropy(grams, s).select("gram", (F.round("entropy", 6) + 0.0).alias(f"{s}_entropy")) for s in ("left", "right"))
    return frequent.select("gram").join(left, "gram").join(right, "gram")


@query(NEW_WORDS + "SELECT gram, round(left_pmi, 6) AS left_pmi, round(right_pmi, 6) AS right_pmi, round(coalesce(c, 0), 6) AS cohesion FROM lp JOIN rp USING (gram) LEFT JOIN co USING (gram)")
def pmi_cohesion(spark: SparkSession, d: str) -> DataFrame:
    words, total = newwords.corpus_words(texts(spark, d, "documents"), "text")
    counts = newwords.gram_counts(newwords.ngrams(words))
    frequent, n = counts.where("freq >= 5"), total.first()["total"]
    pmi, co = newwords.mutual_information(counts, frequent, n), newwords.cohesion(counts, frequent, n)
    return pmi.join(co, "gram").select("gram", *[F.round(c, 6).alias(c) for c in ("left_pmi", "right_pmi", "cohesion")])


@query(
    NEW_WORDS
    + """SELECT word, freq::BIGINT AS freq, round(left_pmi, 6) AS left_pmi, round(right_pmi, 6) AS right_pmi, round(min_pmi, 6) AS min_pmi, round(left_entropy, 6) AS left_entropy, round(right_entropy, 6) AS right_entropy, round(min_entropy, 6) AS min_entropy, round(cohesion, 6) AS cohesion, round(min_pmi * min_entropy * ln(freq), 6) AS score
FROM ws WHERE round(min_pmi, 9) >= 3 AND round(min_entropy, 9) >= 1 AND round(cohesion, 9) > 0 ORDER BY score DESC, word LIMIT 200"""
)
def new_words(spark: SparkSession, d: str) -> DataFrame:
    return newwords.new_words(texts(spark, d, "documents"), "text")


# Query texts ---------------------------------------------------------------------------------------------------


def _held(c: str, terms: list[str]) -> str:
    return " + ".join(f"contains({c}, '{t}')::INT" for t in terms)


WORDS = r"len(list_filter(string_split_regex(query, '[\s\x{0B}\x{85}\p{Z}]+'), lambda x: x <> ''))"


@query(f"SELECT query_id, length(query) >= 10 AND (({_held('lower(query)', understanding.DECOMPOSITION_SIGNS)}) >= 2 OR {WORDS} > 15) AS needed FROM queries")
def needs_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", understanding.needs_decomposition(F.col("query")).alias("needed"))


@query(
    f"""WITH q AS (SELECT query_id, lower(query) AS q, {WORDS} AS n FROM queries)
SELECT query_id, round(least(CASE WHEN n > 0 THEN ({_held('q', understanding.PRONOUNS)}) / n * 0.4 + ({_held('q', understanding.VAGUE)}) / n * 0.3 + ({_held('q', understanding.POLYSEMOUS)}) / n * 0.2 ELSE 0 END + CASE WHEN n < 3 THEN 0.3 WHEN n < 5 THEN 0.1 ELSE 0 END, 1.0), 6) AS ambiguity FROM q"""
)
def ambiguity_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", F.round(understanding.ambiguity(F.col("query")), 6).alias("ambiguity"))


@query("SELECT query_id, " + " OR ".join(f"regexp_matches(query, '{p}')" for p in understanding.SPECIFIC) + f" OR ({_held('query', understanding.PROPER)}) > 0 OR {WORDS} > 10 AS needed FROM queries")
def needs_abstraction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", understanding.needs_abstraction(F.col("query")).alias("needed"))


@query(
    r"""WITH e AS (SELECT query_id, query, unnest(expanded_queries) AS other FROM queries), s AS (
  SELECT query_id, other, list_distinct(list_filter(string_split_regex(lower(query), '[\s\p{Z}]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(other), '[\s\p{Z}]+'), lambda x: x <> '')) AS b FROM e)
SELECT query_id, other, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM s"""
)
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of a query with each of its expansions."""
    e = table(spark, d, "queries").select("query_id", "query", F.explode("expanded_queries").alias("other"))
    return e.select("query_id", "other", F.round(text.word_overlap(F.col("query"), F.col("other")), 6).alias("jaccard"))


@query("SELECT query_id, replace(replace('Question: {q}' || chr(10) || 'Kind: {k}', '{q}', coalesce(query, '')), '{k}', coalesce(search_type, '')) AS prompt FROM queries")
def template_fill(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries")
    return q.select("query_id", prompts.fill("Question: {q}\nKind: {k}", {"q": F.col("query"), "k": F.col("search_type")}).alias("prompt"))


@query("WITH t AS (SELECT DISTINCT conv_id, turn, lower(trim(role)) AS r, content FROM chat_turns WHERE content IS NOT NULL) SELECT conv_id, count(*) AS turns, string_agg(r || ': ' || content, chr(10) ORDER BY turn, r, content) AS history FROM t GROUP BY conv_id")
def multi_turn_prompt(spark: SparkSession, d: str) -> DataFrame:
    return prompts.conversation(table(spark, d, "chat_turns"))


CARD_HITS = f"""c AS ({LATEST_CHUNKS}), h AS (SELECT query_id, id, max(score) AS score, max(recall_source) AS recall_source FROM hits WHERE id IS NOT NULL GROUP BY ALL),
r AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= 3),
j AS (SELECT r.*, content, filename, source, coalesce(nullif(filename, ''), nullif(string_split(source, '/')[-1], ''), '文档-' || id) AS title FROM r LEFT JOIN c ON id = chunk_id)"""


def _card_hits(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hits").where("id IS NOT NULL").groupBy(F.col("query_id").alias("qid"), "id").agg(F.max("score").alias("score"), F.max("recall_source").alias("recall_source"))
    top = retrieve.ranked(h, 3, ["qid"], "score", "id")
    c = latest_chunks(spark, d, "content", "filename", "source").select(F.col("chunk_id").alias("id"), "content", "filename", "source")
    return top.join(c, "id", "left")


@query(f"WITH {CARD_HITS} SELECT query_id, rank::BIGINT AS rank, title, coalesce(replace(replace(substring(content, 1, 200), '<mark>', '**'), '</mark>', '**'), '') || '...' AS content, round(score, 6) AS score, recall_source FROM j")
def source_cards(spark: SparkSession, d: str) -> DataFrame:
    got = generate.source_cards(_card_hits(spark, d))
    return got.select(F.col("qid").alias("query_id"), F.col("rank").cast("long").alias("rank"), "title", "content", F.round("score", 6).alias("score"), "recall_source")


@query(
    f"""WITH {CARD_HITS}, e AS (SELECT query_id, rank, '文档' || rank || ' - ' || title || ':' || chr(10) || coalesce(content, '') AS e FROM j),
u AS (SELECT *, sum(length(e)) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM e),
s AS (SELECT *, min(CASE WHEN upto > 600 THEN rank END) OVER (PARTITION BY query_id) AS stop, 600 - (upto - length(e)) AS room FROM u),
k AS (SELECT query_id, rank, CASE WHEN rank = stop THEN substring(e, 1, room::INT) || '...' ELSE e END AS e FROM s WHERE stop IS NULL OR rank < stop OR (rank = stop AND room > 100))
SELECT query_id, string_agg(e, chr(10) || chr(10) ORDER BY rank) AS context, count(*)::INT AS used FROM k GROUP BY query_id"""
)
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    hits = _card_hits(spark, d).withColumn("title", text.title(F.col("filename"), F.col("source"), F.col("id")))
    return prompts.budgeted_context(hits, 600).select(F.col("qid").alias("query_id"), "context", "used")


def _budget_sql(budget: int) -> str:
    return f"""WITH {CARD_HITS}, e AS (SELECT query_id, rank, '文档' || rank || ' - ' || title || ':' || chr(10) || coalesce(content, '') AS e FROM j),
u AS (SELECT *, sum(length(e)) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM e),
s AS (SELECT *, min(CASE WHEN upto > {budget} THEN rank END) OVER (PARTITION BY query_id) AS stop, {budget} - (upto - length(e)) AS room FROM u),
k AS (SELECT query_id, rank, CASE WHEN rank = stop THEN substring(e, 1, room::INT) || '...' ELSE e END AS e FROM s WHERE stop IS NULL OR rank < stop OR (rank = stop AND room > 100)),
b AS (SELECT query_id, string_agg(e, chr(10) || chr(10) ORDER BY rank) AS context, count(*)::INT AS used FROM k GROUP BY query_id)"""


def _filled(template: str, **values: str) -> str:
    """SQL of a template of ours with its slots replaced."""
    parts = prompts.SLOT.split(template)
    return " || ".join(values[p] if i % 2 else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for i, p in enumerate(parts))


@query(_budget_sql(2000) + f" SELECT query_id AS qid, query, {_filled(prompts.TEMPLATES['retrieval_prompt'], documents=chr(40) + 'coalesce(context, ' + repr(prompts.NO_DOCUMENTS) + '))', question='coalesce(query, ' + repr('') + ')')} AS answer, coalesce(used, 0) AS context_used FROM queries LEFT JOIN b USING (query_id)")
def template_answers(spark: SparkSession, d: str) -> DataFrame:
    hits = _card_hits(spark, d).withColumn("title", text.title(F.col("filename"), F.col("source"), F.col("id")))
    return generate.template_answers(table(spark, d, "queries").select(F.col("query_id").alias("qid"), "query"), hits)


MARKED_CTE = f"""t AS (SELECT query_id AS q, list_distinct({TOKENS.format(c='query')}) AS terms FROM queries),
p AS (SELECT j.*, terms, '(?i)(' || array_to_string(list_transform(list_sort(list_transform(terms, lambda x: {{'n': -length(x), 'x': x}})), lambda z: z.x), '|') || ')' AS pat FROM j JOIN t ON query_id = q WHERE content IS NOT NULL),
f AS (SELECT query_id, id, terms, list_distinct(list_transform(CASE WHEN len(terms) > 0 THEN regexp_extract_all(content, pat) ELSE [] END, lambda x: lower(x))) AS found FROM p)"""


@query(
    f"""WITH {CARD_HITS}, {MARKED_CTE}
SELECT query_id, id, array_to_string(list_sort(list_filter(found, lambda x: len(list_filter(terms, lambda t: contains(x, t) OR contains(t, x))) > 0)), ' ') AS found FROM f"""
)
def highlight_terms(spark: SparkSession, d: str) -> DataFrame:
    """Query terms that are found in a hit: marked, then read from the marks and matched with the query."""
    at = _card_hits(spark, d).where("content IS NOT NULL").join(_query_word_lists(spark, d), "qid")
    found = text.relevant_terms(text.marked_terms(text.mark_terms(F.col("content"), F.col("terms"))), F.col("terms"))
    return at.select(F.col("qid").alias("query_id"), "id", F.array_join(F.array_sort(found), " ").alias("found"))


def _query_word_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select(F.col("query_id").alias("qid"), F.array_distinct(text.analyze_plain(F.col("query"))).alias("terms"))


@query(
    f"""WITH {CARD_HITS}, {MARKED_CTE.replace('f AS', 'g AS')},
x AS (SELECT query_id, id, CASE WHEN len(terms) > 0 THEN regexp_replace(content, pat, '<mark>\\1</mark>', 'g') ELSE content END AS m, CASE WHEN len(terms) > 0 THEN regexp_replace(coalesce(title, ''), pat, '[\\1]', 'g') ELSE coalesce(title, '') END AS t FROM p)
SELECT query_id, id, array_to_string(list_filter(regexp_extract_all(m, '(?s)(?:<mark>.*?</mark>|.){{1,60}}'), lambda z: contains(z, '<mark>'))[1:2], ' ~ ') AS content, t AS title FROM x"""
)
def highlight_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of the text and the whole title of each hit, each field with its own settings."""
    at = _card_hits(spark, d).where("content IS NOT NULL").withColumn("title", text.title(F.col("filename"), F.col("source"), F.col("id"))).join(_query_word_lists(spark, d), "qid")
    marks = text.highlight({"content": {"fragment_size": 60, "number_of_fragments": 2}, "title": {"number_of_fragments": 0, "pre_tags": ["["], "post_tags": ["]"]}}, F.col("terms"))
    return at.withColumn("m", marks).select(F.col("qid").alias("query_id"), "id", F.array_join(F.coalesce(F.col("m")["content"], F.array().cast("array<string>")), " ~ ").alias("content"), F.col("m")["title"][0].alias("title"))


@query(
    r"""WITH t AS (SELECT chunk_id, regexp_replace(content, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g') AS t FROM (WITH c AS ("""
    + LATEST_CHUNKS
    + r""") SELECT chunk_id, content FROM c WHERE content IS NOT NULL)),
u AS (SELECT chunk_id, regexp_replace(regexp_replace(t, '(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/section|/article)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM t),
e AS (SELECT chunk_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM u)
SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '[\s\x{0B}]*\n[\s\x{0B}]*', chr(10), 'g'), '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g') AS plain FROM e"""
)
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return latest_chunks(spark, d, "content").where("content IS NOT NULL").select("chunk_id", text.html_to_text(F.col("content")).alias("plain"))


@query(f"WITH c AS ({LATEST_CHUNKS}) SELECT chunk_id, substring(content, 1, 200) || '...' AS preview, coalesce(nullif(filename, ''), nullif(string_split(source, '/')[-1], ''), '文档-' || chunk_id) AS title, substring(md5(content), 1, 16) AS text_id FROM c")
def chunk_previews(spark: SparkSession, d: str) -> DataFrame:
    return latest_chunks(spark, d, "content", "filename", "source").select("chunk_id", text.preview(F.col("content")).alias("preview"), text.title(F.col("filename"), F.col("source"), F.col("chunk_id")).alias("title"), text.md5_id(F.col("content")).alias("text_id"))


# Analysis of texts ---------------------------------------------------------------------------------------------


@query(f"WITH t AS (SELECT query_id, {TOKENS.format(c='query')} AS toks FROM queries), i AS (SELECT query_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM t) SELECT query_id, (i - 1)::INT AS pos, toks[i] AS token FROM i")
def analyze_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", F.posexplode(text.analyze_plain(F.col("query"))).alias("pos", "token"))


@query(f"SELECT query_id, array_to_string({TOKENS.format(c='query')}, ' ') AS prepared FROM queries")
def preprocess_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", text.preprocess(F.col("query")).alias("prepared"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s一-鿿]', '', 'g'), '\s+', ' ', 'g')) AS cleaned FROM documents WHERE text IS NOT NULL")
def clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.clean_corpus(F.col("text")).alias("cleaned"))


@query("SELECT chunk_id, file_type FROM chunks WHERE content_vector IS NULL AND chunk_level = 2")
def level_filter(spark: SparkSession, d: str) -> DataFrame:
    """Term filter on the level and a test for a missing vector; both reach the scan."""
    return table(spark, d, "chunks").where("content_vector IS NULL AND chunk_level = 2").select("chunk_id", "file_type")


@query(
    """WITH a AS (SELECT query_id, 'Answer to: ' || query AS a FROM queries WHERE query IS NOT NULL), i AS (SELECT *, unnest(range(0, ceil(length(a) / 10.0)::BIGINT)) AS i FROM a)
SELECT query_id, i::INT AS piece_no, substring(a, i * 10 + 1, 10) AS piece, substring(a, 1, (i + 1) * 10) AS so_far, i = ceil(length(a) / 10.0)::BIGINT - 1 AS is_final FROM i"""
)
def answer_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Answers as they would be streamed, ten characters at a time."""
    a = table(spark, d, "queries").where("query IS NOT NULL").select(F.col("query_id").alias("qid"), F.concat(F.lit("Answer to: "), F.col("query")).alias("answer"))
    return generate.answer_pieces(a).withColumnRenamed("qid", "query_id")


@query(
    r"""WITH q AS (SELECT query_id, query, expanded_queries AS e, lower(regexp_replace(query, '^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$', '', 'g')) AS same FROM queries),
e AS (SELECT query_id, query, same, i, e[i] AS s FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM q)),
k AS (SELECT query_id, s, min(i) AS i FROM e WHERE length(s) BETWEEN 5 AND 200 AND lower(regexp_replace(s, '^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$', '', 'g')) <> same GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM k QUALIFY n <= 5),
g AS (SELECT query_id, count(*) AS n, string_agg(s, ' / ' ORDER BY i) AS subs FROM r GROUP BY query_id)
SELECT query_id, CASE WHEN coalesce(n, 0) < 2 THEN concat_ws(' / ', query, subs) ELSE subs END AS subqueries FROM q LEFT JOIN g USING (query_id) WHERE e IS NOT NULL"""
)
def filter_subqueries(spark: SparkSession, d: str) -> DataFrame:
    """Expansions taken as sub-queries: length, difference from the query, distinct, five at most, two at least."""
    q = table(spark, d, "queries").where("expanded_queries IS NOT NULL")
    return q.select("query_id", F.array_join(understanding.filter_subqueries(F.col("expanded_queries"), F.col("query")), " / ").alias("subqueries"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e), 6) + 0.0 AS score, q.e AS qe, v.e AS ve FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20), r AS (SELECT query_id, vec_id, round(1 / (1 + list_distance(qe, ve)), 6) AS rerank_score FROM t)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, vec_id)::BIGINT AS rank FROM r WHERE rerank_score >= 0 QUALIFY rank <= 5"""
)
def rerank_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Twenty hits by dot product, put in order of Euclidean closeness."""
    e = table(spark, d, "embeddings")
    hits = retrieve.vector_search(e, e.where("vec_id % 100 = 0"), 20, "vec_id", "embedding", "vec_id", "embedding", "dot_product", exclude_self=True)
    both = hits.drop("rank").join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("hv")), "id").join(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), "qid")
    got = rerank.by_embedding(both, "qv", "hv", 5, "euclidean")
    return got.select(F.col("qid").alias("query_id"), F.col("id").alias("vec_id"), "rerank_score", F.col("rank").cast("long").alias("rank"))


# Reranking -----------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model's answers: a list that depends on the query."""
    first = F.length(F.coalesce("query", F.lit(""))) % 5
    place = lambda n: ((first + n) % 5 + 1).cast("string")
    return table(spark, d, "queries").select(F.col("query_id").alias("qid"), F.concat(F.lit("The order is ["), place(0), F.lit(", "), place(2), F.lit(", 9]; score 8.5")).alias("answer"))


LISTED = f"""WITH {CARD_HITS.replace('<= 3', '<= 5')}, l AS (SELECT query_id AS q, length(coalesce(query, '')) % 5 AS f FROM queries),
o AS (SELECT query_id, id, rank, CASE rank WHEN f % 5 + 1 THEN 1 WHEN (f + 2) % 5 + 1 THEN 2 END AS place FROM r LEFT JOIN l ON query_id = q)"""


@query(LISTED + " SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(place, 1000000 + rank), id)::BIGINT AS new_rank FROM o")
def rerank_list(spark: SparkSession, d: str) -> DataFrame:
    h = retrieve.ranked(_small_hits(spark, d), 5, ["qid"], "score", "id")
    return rerank.by_list(h, _answers(spark, d), 5).select(F.col("qid").alias("query_id"), "id", F.col("new_rank").cast("long").alias("new_rank"))


@query(LISTED + ", s AS (SELECT query_id, id, round(CASE place WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 ELSE 0.1 END, 6)::DOUBLE AS rerank_score FROM o) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id)::BIGINT AS rank FROM s")
def rerank_position_score(spark: SparkSession, d: str) -> DataFrame:
    h = retrieve.ranked(_small_hits(spark, d), 5, ["qid"], "score", "id")
    return rerank.by_position(h, _answers(spark, d), 5).select(F.col("qid").alias("query_id"), "id", "rerank_score", F.col("rank").cast("long").alias("rank"))


@query("WITH b AS (SELECT query_id, id, max(rerank_score) AS rerank_score FROM hits WHERE id IS NOT NULL GROUP BY ALL) SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id)::BIGINT AS rank FROM b WHERE rerank_score >= 0.5 QUALIFY rank <= 10")
def rerank_threshold(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hits").where("id IS NOT NULL").groupBy(F.col("query_id").alias("qid"), "id").agg(F.max("rerank_score").alias("rerank_score"))
    return rerank.keep_top(h, 10, 0.5).select(F.col("qid").alias("query_id"), "id", "rerank_score", F.col("rank").cast("long").alias("rank"))


# Pipelines and streams -----------------------------------------------------------------------------------------


@query()
def pipeline_search(spark: SparkSession, d: str) -> DataFrame:
    """A configured pipeline: expansion, index, hybrid retrieval with parent expansion, template answers."""
    from marlstone.plans import pipeline

    config = {
        "components": {
            "expand": {"type": "query", "name": "expansion"},
            "embed": {"type": "embedding", "name": "hash"},
            "index": {"type": "indexer", "name": "bm25"},
            "search": {"type": "retriever", "name": "hybrid", "config": {"top_k": 5, "enable_small2big": True, "small2big_config": {"text_chunk_level": 0, "vector_chunk_level": 2}}},
            "answer": {"type": "generator", "name": "template"},
        },
        "flow": {"expand": ["embed"], "embed": "index", "index": ["search"], "search": ["answer"], "answer": []},
        "entry_points": {"search": "expand"},
    }
    tables = {"queries": table(spark, d, "queries").select(F.col("query_id").alias("qid"), "query", "expanded_queries"), "chunks": latest_chunks(spark, d, "parent_id", "root_id", "chunk_level", "chunk_index", "content")}
    return pipeline.build(config).run(tables, "search")["answers"]


@query()
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents ingested as a stream of files in several batches into an upserted table: the chunks of split_hierarchy, once per chunk_id."""
    from marlstone.streaming import ingest

    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("content"))
    docs.repartition(8, "source").write.parquet(f"{root}/files")
    sink = ingest.TableSink(f"{root}/table")
    ingest.ingest_table(spark, f"{root}/files", docs.schema, sink, f"{root}/checkpoint", ingest.chunk_and_embed, per_trigger=3).awaitTermination()
    return sink.read(spark).select("chunk_id", "parent_id", "chunk_index", "total_chunks", "chunk_level", "text_length")
