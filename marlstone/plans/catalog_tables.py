"""Queries of loaders, splitters, table maintenance, streaming and pipelines, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import index, newwords, sinks, split, stats
from marlstone.plans import pipeline
from marlstone.plans.catalog import LATEST_CHUNKS, NEW_WORDS, QUERIES, SEGMENTED, SQL, TOKENS, bm25_sql, latest_chunks, query
from marlstone.plans.catalog_models import BLANK, stripped
from marlstone.session import shared_dir, table, texts
from marlstone.sources import loaders
from marlstone.streaming import ingest


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _document_files(spark: SparkSession, d: str) -> str:
    """The documents as text files, one each."""
    path = _folder(spark, "files")
    sinks.write_text_files(texts(spark, d, "documents"), path, "doc_id", "text")
    return path


def _doc_id() -> Column:
    return F.regexp_extract("source", r"doc_id=(\d+)", 1).cast("long").alias("doc_id")


# Loaders -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text || chr(10)) AS text_hash, 'txt' AS file_type, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS total_files FROM documents WHERE text IS NOT NULL")
def load_files(spark: SparkSession, d: str) -> DataFrame:
    """Every document written as a file, then loaded from its folder, with the number of files."""
    path = _document_files(spark, d)
    run = pipeline.registry.get("loader", "file")({"path": path, "file_types": [".txt"]})
    docs = run({})["documents"]
    return docs.select(_doc_id(), F.md5("content").alias("text_hash"), "file_type", F.col("total_files").cast("long").alias("total_files"))


@query(f"SELECT md5({stripped('text')}) AS text_hash, count(*) AS files FROM documents WHERE text IS NOT NULL AND {stripped('text')} <> '' GROUP BY 1")
def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """Text files of folders as a corpus: stripped, blank ones left out."""
    return loaders.read_corpus(spark, f"{_document_files(spark, d)}/*").groupBy(F.md5("content").alias("text_hash")).agg(F.count("*").alias("files"))


@query("SELECT doc_id, md5(text || chr(10)) AS text_hash FROM documents WHERE text IS NOT NULL")
def stream_files(spark: SparkSession, d: str) -> DataFrame:
    """The same files as a stream, collected in a table batch by batch."""
    path = _document_files(spark, d)
    sink = ingest.TableSink(_folder(spark, "table"), "source", merge_after=3)
    files = loaders.read_files(spark, path, [".txt"], stream=True, per_trigger=300)
    files.writeStream.foreachBatch(lambda df, n: sink.write(df, n)).option("checkpointLocation", _folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return sink.read(spark).select(_doc_id(), F.md5("content").alias("text_hash"))


@query(SQL["html_to_text"].replace("SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+'", "SELECT chunk_id AS source, 'html' AS file_type, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+'").replace("AS plain FROM e", "AS content FROM e"))
def web_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as fetched pages: their text by URL."""
    pages = latest_chunks(spark, d, "content").select(F.col("chunk_id").alias("url"), F.col("content").alias("html"))
    run = pipeline.registry.get("loader", "web")({})
    return run({"pages": pages})["documents"].select("source", "file_type", "content")


@query(
    rf"""WITH RECURSIVE c AS ({LATEST_CHUNKS}), l AS (SELECT chunk_id, i, ls[i] AS line FROM (SELECT chunk_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT chunk_id, string_split(content, chr(10)) AS ls FROM c WHERE length(content) > 0))),
m AS (SELECT chunk_id, i, regexp_extract(line, '^\s{{0,3}}(```|~~~)', 1) AS mark, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '^\s{{0,3}}(```|~~~)')),
st AS (SELECT chunk_id, k, i, mark AS fence FROM m WHERE k = 1 UNION ALL SELECT m.chunk_id, m.k, m.i, CASE WHEN st.fence = m.mark THEN '' WHEN st.fence <> '' THEN st.fence ELSE m.mark END FROM st JOIN m ON m.chunk_id = st.chunk_id AND m.k = st.k + 1),
f AS (SELECT l.*, coalesce(st.fence, '') AS fence FROM l ASOF LEFT JOIN st ON l.chunk_id = st.chunk_id AND l.i >= st.i),
h AS (SELECT *, CASE WHEN fence = '' AND regexp_matches(line, '^#{{1,6}}{BLANK}+') THEN length(regexp_extract(line, '^#+')) ELSE 0 END AS level, regexp_extract(line, '^#{{1,6}}{BLANK}+(.*?){BLANK}*#*{BLANK}*$', 1) AS heading FROM f),
s AS (SELECT *, count(*) FILTER (level > 0) OVER (PARTITION BY chunk_id ORDER BY i) AS sec FROM h),
g AS (SELECT chunk_id, sec, max(level) AS level, max(CASE WHEN level > 0 THEN heading END) AS heading, {stripped("string_agg(line, chr(10) ORDER BY i)")} AS content FROM s GROUP BY chunk_id, sec),
n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY sec) - 1 AS pos FROM g WHERE content <> ''),
p AS (SELECT b.chunk_id, b.pos, string_agg(a.heading, ' > ' ORDER BY a.pos) AS path, arg_max(a.heading, a.pos) AS last FROM n b JOIN n a ON a.chunk_id = b.chunk_id AND a.pos <= b.pos AND a.level > 0
  WHERE NOT EXISTS (SELECT 1 FROM n z WHERE z.chunk_id = b.chunk_id AND z.pos > a.pos AND z.pos <= b.pos AND z.level > 0 AND z.level <= a.level) GROUP BY b.chunk_id, b.pos)
SELECT n.chunk_id, n.pos::INT AS pos, n.level::INT AS heading_level, n.level > 0 AS is_heading, coalesce(n.heading, p.last) AS current_heading, coalesce(p.path, '') AS heading_path, n.content FROM n LEFT JOIN p USING (chunk_id, pos)"""
)
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of chunks by their Markdown headings, with the headings above them."""
    got = loaders.markdown_nodes(latest_chunks(spark, d, "content"), "chunk_id", "content")
    return got.select("chunk_id", "pos", "heading_level", "is_heading", "current_heading", F.array_join("heading_path", " > ").alias("heading_path"), "content")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch_index, (row_number() OVER (ORDER BY doc_id) - 1) // 50 = (count(*) OVER () - 1) // 50 AS is_last_batch FROM documents")
def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return loaders.batch_numbers(docs, ["doc_id"], 50).withColumn("batch_index", F.col("batch_index").cast("long"))


_WORDS = "['index','query','shard','vector','ranking','parser','token','corpus','cluster','replica','segment','cache','schema','filter','batch','stream','latency','recall','metric','planner','window','merge']"


def _draw(i: str, salt: int) -> str:
    return f"((id * 48271 + {i} * 16807 + {salt} * 69621 + 12345) % 2147483647) * 16807 % 2147483647"


@query(
    f"""SELECT 'doc_' || id AS doc_id, array_to_string(list_transform(range(1, ({_draw('0', 42)}) % 57 + 11), lambda i: ({_WORDS})[({_draw('i', 43)}) % 22 + 1]), ' ') AS content,
  round((({_draw('3', 44)}) / 2147483647.0)::FLOAT::DOUBLE, 6) AS third, (['guide','report','note','manual'])[({_draw('1', 45)}) % 4 + 1] AS category, (({_draw('2', 46)}) % 5 + 1)::INT AS priority FROM range(10000) AS t(id)"""
)
def synthetic_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a load test."""
    return stats.synthetic_documents(spark, 10_000, 8).select("doc_id", "content", F.round(F.col("content_vector")[2].cast("double"), 6).alias("third"), "category", "priority")


# Splitters -----------------------------------------------------------------------------------------------------

#: The cut inside a window that is not the last: after its last line break, else after its last blank.
CUT = "CASE WHEN beg + {n} >= size THEN beg + {n} WHEN contains(win, chr(10)) THEN beg + length(win) - position(chr(10) IN reverse(win)) + 1 WHEN contains(win, ' ') THEN beg + length(win) - position(' ' IN reverse(win)) + 1 ELSE beg + {n} END"


def _windows_sql(rows: str, n: int, overlap: int) -> str:
    """(doc_id, k, piece): character windows of the texts in rows (doc_id, t)."""
    cut = CUT.format(n=n)
    return f"""w0 AS (SELECT doc_id, t, length(t) AS size, 0 AS beg, substring(t, 1, {n}) AS win, 0 AS k FROM {rows} WHERE length(t) > 0),
walk AS (SELECT *, {cut} AS stop FROM w0 UNION ALL SELECT doc_id, t, size, beg, win, k, {cut} AS stop FROM (SELECT doc_id, t, size, greatest(beg + 1, stop - {overlap}) AS beg, substring(t, greatest(beg + 1, stop - {overlap})::BIGINT + 1, {n}) AS win, k + 1 AS k FROM walk WHERE greatest(beg + 1, stop - {overlap}) < size)),
cuts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS k, piece FROM (SELECT doc_id, k, {stripped('substring(t, beg::BIGINT + 1, (stop - beg)::BIGINT)')} AS piece FROM walk) WHERE piece <> '')"""


SQL["split_char"] = f"WITH RECURSIVE docs AS (SELECT doc_id, text AS t FROM documents), {_windows_sql('docs', 500, 50)} SELECT doc_id, k::INT AS chunk_index, piece AS chunk FROM cuts"

SENTENCES = f"list_filter(list_transform(string_split_regex(text, '[.!?。！？]+'), lambda x: {stripped('x')}), lambda x: x <> '')"


def _set(c: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({c}), '{BLANK}+'), lambda z: z <> ''))"


def _near(a: str, b: str) -> str:
    both = f"len(list_intersect({_set(a)}, {_set(b)}))"
    return f"(CASE WHEN len({_set(a)}) + len({_set(b)}) = 0 THEN 1 ELSE {both} / (len({_set(a)}) + len({_set(b)}) - {both}) END)"


SQL["split_semantic"] = f"""
WITH RECURSIVE s AS (SELECT doc_id, text, {SENTENCES} AS s FROM documents WHERE length(text) > 0),
kind AS (SELECT *, CASE WHEN coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) <= 500 THEN 'whole' WHEN len(s) > 1000 OR list_max(list_transform(s, lambda x: length(x))) > 1000 THEN 'windows' WHEN len(s) <= 1 THEN 'whole' ELSE 'fold' END AS kind FROM s),
fold AS (SELECT doc_id, s, 1 AS i, s[1] AS cur, 0 AS no FROM kind WHERE kind = 'fold'
  UNION ALL SELECT doc_id, s, i + 1, CASE WHEN join_ THEN cur || ' ' || s[i + 1] ELSE s[i + 1] END, CASE WHEN join_ THEN no ELSE no + 1 END FROM (SELECT *, length(cur) + 1 + length(s[i + 1]) <= 500 AND {_near('cur', 's[i + 1]')} >= 0.1 AS join_ FROM fold WHERE i < len(s))),
win AS (SELECT doc_id, text AS t FROM kind WHERE kind = 'windows'), {_windows_sql('win', 500, 0)}
SELECT doc_id, 0 AS chunk_index, text AS chunk FROM kind WHERE kind = 'whole' UNION ALL SELECT doc_id, no, arg_max(cur, i) FROM fold GROUP BY doc_id, no UNION ALL SELECT doc_id, k::INT, piece FROM cuts"""


@query(SQL["split_sentence"].replace("SELECT doc_id, no AS chunk_index, string_agg(s[i], ' ' ORDER BY i) AS chunk FROM f GROUP BY doc_id, no", "SELECT f.doc_id, no AS chunk_index, md5(string_agg(s[i], ' ' ORDER BY i)) AS chunk_hash, any_value(lang) AS lang, any_value(source) AS source, any_value(filename) AS filename, 'sentence' AS split_method FROM f JOIN documents USING (doc_id) GROUP BY f.doc_id, no"))
def split_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that carry the columns of their document."""
    got = split.split_with(texts(spark, d, "documents"), "doc_id", "text", lambda t: split.sentence_chunks(t, 500), ["lang", "source", "filename"], "sentence")
    return got.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_hash"), "lang", "source", "filename", "split_method")


@query(f"SELECT doc_id, md5(text)[1:16] AS root_id, TRUE AS ids_differ, TRUE AS numbered, TRUE AS lengths_fit, TRUE AS levels_fit, TRUE AS parents_hold FROM documents WHERE {stripped('text')} <> ''")
def hierarchy_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of the hierarchical chunks of every document: ids differ, the numbers run through, lengths and levels fit, whole chunks lie in their parents."""
    sizes = [1536, 512, 128]
    c = split.split_hierarchy(texts(spark, d, "documents"), "doc_id", "text", sizes, 50)
    above = c.select("doc_id", F.col("chunk_id").alias("parent_id"), F.col("content").alias("big"))
    at = c.join(above, ["doc_id", "parent_id"], "left")
    whole = (F.col("split_method") != "hierarchical") | F.col("parent_id").isNull() | F.contains("big", F.col("content")) | F.col("parent_id").contains("_p")
    level = (F.col("split_method") != "hierarchical") | (F.col("chunk_level") == text.chunk_level(F.length("content"), sizes))
    return at.groupBy("doc_id", "root_id").agg(
        (F.countDistinct("chunk_id") == F.count("*")).alias("ids_differ"),
        ((F.countDistinct("chunk_index") == F.max("total_chunks")) & (F.max("chunk_index") + 1 == F.count("*"))).alias("numbered"),
        F.every((F.col("text_length") == F.length("content")) & (F.col("text_length") <= 2 * max(sizes))).alias("lengths_fit"),
        F.every(level).alias("levels_fit"),
        F.every(F.coalesce(whole, F.lit(False))).alias("parents_hold"),
    )


# Table maintenance ---------------------------------------------------------------------------------------------


@query(SQL["posting_stats"])
def index_append_reload(spark: SparkSession, d: str) -> DataFrame:
    """An index of half the documents, saved, loaded, and extended by the other half and some of the first again."""
    docs, path = texts(spark, d, "documents"), _folder(spark, "index")
    index.build_index(docs.where("doc_id % 2 = 0"), "doc_id", ["text"]).save(path)
    both = index.InvertedIndex.load(spark, path).append(index.build_index(docs.where("doc_id % 2 = 1 OR doc_id % 10 = 0"), "doc_id", ["text"]))
    return both.postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@query("SELECT doc_id, text, source FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def document_by_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return index.get_document(docs.select("doc_id", "text", "source"), "doc_id", docs.agg(F.max("doc_id")).first()[0])


@query(f"WITH c AS ({LATEST_CHUNKS}) SELECT chunk_id, coalesce(content_jieba, array_to_string({SEGMENTED.format(c='content')}, ' ')) AS content_jieba FROM c")
def segmented_field(spark: SparkSession, d: str) -> DataFrame:
    """The pre-segmented field, filled where it is missing."""
    return index.add_segmented(latest_chunks(spark, d, "content", "content_jieba"), "content", "content_jieba").select("chunk_id", "content_jieba")


@query("SELECT query_id, id, score, upper(recall_source) AS recall_source FROM hits")
def table_copies(spark: SparkSession, d: str) -> DataFrame:
    """A table created twice, dropped and created again, filled, copied with a change, and read through an alias."""
    name, path = f"t_{uuid.uuid4().hex}", _folder(spark, "tables")
    hits = table(spark, d, "hits").select("query_id", "id", "score", "recall_source")
    for _ in range(2):
        sinks.create_table(spark, f"{name}_a", hits.schema, None, f"{path}/a")
    sinks.recreate_table(spark, f"{name}_a", hits.schema, None, f"{path}/b")
    hits.write.mode("append").insertInto(f"{name}_a")
    sinks.copy_table(spark, f"{name}_a", f"{name}_b", lambda df: df.withColumn("recall_source", F.upper("recall_source")), f"{path}/c")
    index.swap_alias(spark, f"{name}_v", f"{name}_a")
    index.swap_alias(spark, f"{name}_v", f"{name}_b")
    return spark.table(f"{name}_v")


@query(rf"WITH w AS (SELECT query_id, list_filter(string_split_regex(query, '{BLANK}+'), lambda x: x <> '') AS w FROM queries), s AS (SELECT query_id, w, unnest(range(0, len(w), 4)) AS pos FROM w WHERE len(w) > 0) SELECT query_id, (pos / 4)::INT AS chunk_index, array_to_string(w[pos + 1:pos + 4], ' ') AS chunk FROM s")
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as one file each, then read again."""
    path = _folder(spark, "chunks")
    sinks.write_chunk_files(split.split_words(table(spark, d, "queries"), "query_id", "query", 4), path, "query_id")
    got = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("source", F.col("_metadata.file_path"))
    return got.select(F.regexp_extract("source", "doc=([^/]+)", 1).alias("query_id"), F.regexp_extract("source", r"chunk_index=(\d+)", 1).cast("int").alias("chunk_index"), F.regexp_replace("value", "\n$", "").alias("chunk"))


@query("SELECT TRUE AS indexed, count(*) AS document_count, 'documents' AS index_name FROM documents")
def index_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows counted while a table is written, without another pass."""
    docs, seen = stats.counted(table(spark, d, "documents").select("doc_id", "text"))
    docs.write.parquet(_folder(spark, "documents"))
    return spark.createDataFrame([(True, seen.get["document_count"], "documents")], "indexed boolean, document_count long, index_name string")


@query("SELECT (row_number() OVER () - 1)::INT AS position, column_name AS name, column_type IN ('FLOAT[]', 'DOUBLE[]') AS is_vector FROM (DESCRIBE chunks)")
def schema_listing(spark: SparkSession, d: str) -> DataFrame:
    return stats.describe_columns(table(spark, d, "chunks")).select("position", "name", "is_vector")


@query(f"WITH c AS ({LATEST_CHUNKS}) SELECT chunk_id FROM c WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.id = chunk_id)")
def never_hit(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that no query found."""
    return latest_chunks(spark, d).select("chunk_id").join(table(spark, d, "hits").select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


@query("SELECT source, count(*) AS n, count(doc_id) AS documents, count(chunk_id) AS chunks FROM (SELECT source, doc_id, NULL AS chunk_id FROM documents UNION ALL SELECT source, NULL, chunk_id FROM chunks) GROUP BY source")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two tables of other columns as one, repeated rows kept."""
    both = table(spark, d, "documents").select("source", "doc_id").unionByName(table(spark, d, "chunks").select("source", "chunk_id"), allowMissingColumns=True)
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("doc_id").alias("documents"), F.count("chunk_id").alias("chunks"))


# New words -----------------------------------------------------------------------------------------------------


@query(NEW_WORDS + r"SELECT gram, freq::BIGINT AS freq FROM frequent WHERE NOT regexp_full_match(gram, '\p{L}+')")
def ngram_counts_strict(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that are not made of letters only."""
    words, _ = newwords.corpus_words(texts(spark, d, "documents"), "text")
    return newwords.gram_counts(newwords.ngrams(words), strict_alpha=True).where("freq >= 5")


# Streams -------------------------------------------------------------------------------------------------------


@query(SQL["split_word"].replace("SELECT doc_id, (pos / 80)::INT AS chunk_index,", "SELECT doc_id || '-' || (pos / 80)::INT AS chunk_id,"))
def stream_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Half the documents ingested as a stream, stopped; the rest added, and the stream started again from its checkpoint."""
    root, docs = _folder(spark, "stream"), texts(spark, d, "documents").select("doc_id", "text")
    sink = ingest.TableSink(f"{root}/table", merge_after=3)
    step = lambda df: split.split_words(df, "doc_id", "text", 100, 20).select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "chunk")
    for half in range(2):
        docs.where(F.col("doc_id") % 2 == half).repartition(4, "doc_id").write.mode("append").parquet(f"{root}/docs")
        ingest.ingest_table(spark, f"{root}/docs", docs.schema, sink, f"{root}/checkpoint", step, per_trigger=2).awaitTermination()
    return sink.read(spark)


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN 'ingested' ELSE 'set aside' END AS status FROM documents")
def ingest_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rows without text are set aside in a table of errors."""
    root, docs = _folder(spark, "checked"), texts(spark, d, "documents").select("doc_id", "text")
    good, bad = ingest.TableSink(f"{root}/good", "doc_id"), ingest.TableSink(f"{root}/bad", "doc_id")
    ingest.ingest_checked(docs, good, bad, "length(text) > 0", lambda df: df)
    named = lambda sink, status: sink.read(spark).select("doc_id", F.lit(status).alias("status"))
    return named(good, "ingested").unionByName(named(bad, "set aside"))


@query("SELECT 'completed' AS status, count(*) AS total_data_read, 4::BIGINT AS batches FROM documents")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    """Rows and batches that a stream counted."""
    root, docs = _folder(spark, "counted"), texts(spark, d, "documents").select("doc_id", "text")
    docs.repartition(8, "doc_id").write.option("maxRecordsPerFile", 0).parquet(f"{root}/docs")
    q = ingest.ingest_table(spark, f"{root}/docs", docs.schema, ingest.TableSink(f"{root}/table", "doc_id"), f"{root}/checkpoint", lambda df: df, per_trigger=2)
    q.awaitTermination()
    seen = ingest.Progress()
    for p in q.recentProgress:
        seen.batches.append({"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": 0.0, "ms": p["durationMs"]["triggerExecution"]})
    totals = seen.totals(docs.count())
    return spark.createDataFrame([(totals["status"], totals["total_data_read"], sum(b["rows"] > 0 for b in seen.batches))], "status string, total_data_read long, batches long")


# Pipelines -----------------------------------------------------------------------------------------------------

FIND = {"components": {"index": {"type": "indexer", "name": "bm25", "config": {"analyzer": "plain"}}, "find": {"type": "retriever", "name": "bm25", "config": {"analyzer": "plain", "top_k": 7}}}, "flow": {"index": ["find"]}, "entry_point": "index"}
FOUND = "WITH " + bm25_sql(LATEST_CHUNKS, {"content": 1}, "chunk_id", k=7)


def _search_tables(spark: SparkSession, d: str) -> pipeline.Tables:
    return {"queries": table(spark, d, "queries").select(F.col("query_id").alias("qid"), "query"), "chunks": latest_chunks(spark, d, "content")}


@query(FOUND + " SELECT qid AS query_id, id, score, rank::BIGINT AS rank, length(content) AS characters FROM top JOIN docs ON id = chunk_id")
def pipeline_hits(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline of an indexer and a retriever."""
    hits = pipeline.build(FIND).run(_search_tables(spark, d))["hits"]
    return hits.select(F.col("qid").alias("query_id"), "id", "score", F.col("rank").cast("long").alias("rank"), F.length("content").cast("long").alias("characters"))


@query(FOUND + " SELECT query_id, query, coalesce(n, 0) AS result_count, 'text' AS search_type FROM queries LEFT JOIN (SELECT qid, count(*) AS n FROM top GROUP BY qid) ON qid = query_id")
def pipeline_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many hits each query has, as the retriever reports it."""
    steps = pipeline.build(FIND).run_steps(_search_tables(spark, d))
    return steps["find"]["retrieval"].select(F.col("qid").alias("query_id"), "query", "result_count", "search_type")


@query("SELECT * FROM (VALUES ('index', 'indexer.bm25', 'chunks,queries', 'corpus,lengths,postings'), ('find', 'retriever.bm25', 'chunks,corpus,lengths,postings,queries', 'hits,retrieval')) AS t(step, kind, given, made)")
def pipeline_steps(spark: SparkSession, d: str) -> DataFrame:
    """What each step of a pipeline was given and made; tables stay lazy."""
    steps = pipeline.build(FIND).run_steps(_search_tables(spark, d))
    return spark.createDataFrame([(n, s.kind, ",".join(s.given), ",".join(sorted(s))) for n, s in steps.items()], "step string, kind string, given string, made string")


@query("SELECT b AS branch, query_id, CASE b WHEN 'expand/clear' THEN 'clear' ELSE 'abstract' END AS made FROM queries, (VALUES ('expand/clear'), ('expand/abstract')) AS t(b)")
def pipeline_branches(spark: SparkSession, d: str) -> DataFrame:
    """Both successors of a component, each to its end."""
    config = {"components": {"expand": {"type": "query", "name": "expansion"}, "clear": {"type": "query", "name": "disambiguation"}, "abstract": {"type": "query", "name": "abstraction"}}, "flow": {"expand": ["clear", "abstract"]}}
    ends = pipeline.build(config).run_branches({"queries": table(spark, d, "queries").select("query_id", "query")})
    made = {"disambiguated_query": "clear", "abstracted_query": "abstract"}
    parts = [t["queries"].select(F.lit(path).alias("branch"), "query_id", F.lit(next(v for k, v in made.items() if k in t["queries"].columns)).alias("made")) for path, t in ends.items()]
    return parts[0].unionByName(parts[1])


@query(SQL["split_sentence"].replace("SELECT doc_id, no AS chunk_index, string_agg(s[i], ' ' ORDER BY i) AS chunk FROM", "SELECT doc_id, no AS chunk_index, md5(string_agg(s[i], ' ' ORDER BY i)) AS chunk_hash FROM"))
def pipeline_stream(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline that is run on a stream: batches of documents through its splitter into a table."""
    config = {"components": {"cut": {"type": "splitter", "name": "text", "config": {"chunk_size": 500, "split_method": "sentence"}}}, "architecture": {"type": "streaming"}}
    root, docs = _folder(spark, "flow"), texts(spark, d, "documents").select(F.col("doc_id"), F.col("text").alias("content"))
    docs.repartition(4, "doc_id").write.parquet(f"{root}/docs")
    keyed = ingest.TableSink(f"{root}/table", "key")

    class Keyed:
        def write(self, df: DataFrame, n: int) -> None:
            keyed.write(df.withColumn("key", F.concat_ws("-", "doc_id", "chunk_index")), n)

    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/docs")
    pipeline.build(config).execute({}, source=source, name="documents", output="chunks", sink=Keyed(), checkpoint=f"{root}/checkpoint").awaitTermination()
    return keyed.read(spark).select("doc_id", "chunk_index", F.md5("content").alias("chunk_hash"))


@query("SELECT unnest(['embedding.hash', 'embedding.model', 'generator.llm', 'generator.template', 'indexer.bm25', 'loader.file', 'loader.web', 'query.abstraction', 'query.decomposition', 'query.disambiguation', 'query.expansion', 'reranker.embedding', 'reranker.llm', 'reranker.service', 'retriever.bm25', 'retriever.hybrid', 'splitter.hierarchical', 'splitter.hierarchical_doc', 'splitter.recursive', 'splitter.semantic', 'splitter.sentence', 'splitter.text']) AS component")
def registered_components(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in pipeline.registry.names()], "component string")


__all__ = ["QUERIES", "SQL", "TOKENS", "text"]
