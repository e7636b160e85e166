"""Loaders, pipelines and streaming."""

import pytest
from pyspark.sql import functions as F

from marlstone.plans import pipeline
from marlstone.sources import loaders
from marlstone.streaming import ingest

MARKDOWN = """intro
# One
text
```
# not a heading
```
## Two
more
### Three
deep
# Four
end"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("plain words\n\nsecond paragraph. " * 30, encoding="utf-8")
    (tmp_path / "in" / "sub" / "b.MD").write_text(MARKDOWN, encoding="utf-8")
    (tmp_path / "in" / "c.html").write_text("<html><head><title>x</title></head><body><h1>Head</h1><p>A &amp; B</p></body></html>", encoding="utf-8")
    (tmp_path / "in" / "d.bin").write_text("no", encoding="utf-8")
    return tmp_path


def test_loading(spark, folder):
    docs = loaders.load(spark, str(folder / "in")).collect()
    assert {d["filename"] for d in docs} == {"a.txt", "b.MD", "c.html"}
    assert next(d for d in docs if d["filename"] == "c.html")["content"] == "Head\nA & B"
    assert loaders.count_files(spark, str(folder / "in")) == 3
    with pytest.raises(Exception):
        loaders.load(spark, str(folder / "missing")).collect()
    nodes = loaders.markdown_nodes(loaders.read_files(spark, str(folder / "in"), [".md"])).orderBy("pos").collect()
    assert [(n["heading_level"], n["current_heading"], n["heading_path"]) for n in nodes] == [(0, None, []), (1, "One", ["One"]), (2, "Two", ["One", "Two"]), (3, "Three", ["One", "Two", "Three"]), (1, "Four", ["Four"])]
    assert loaders.read_corpus(spark, str(folder / "in")).count() == 1
    numbered = loaders.batch_numbers(spark.range(5).withColumn("o", F.col("id")), ["o"], 2).orderBy("id").collect()
    assert [(r["batch_index"], r["is_last_batch"]) for r in numbered] == [(0, False), (0, False), (1, False), (1, False), (2, True)]


def test_pages(spark):
    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")

    def fetch(u):
        if u == "u2":
            raise OSError("down")
        return "<p>hello</p>"

    got = {r["url"]: (r["html"], r["error"]) for r in loaders.fetch_pages(urls, fetch).collect()}
    assert got["u1"][0] == "<p>hello</p>" and "down" in got["u2"][1]
    assert loaders.load_pages(loaders.fetch_pages(urls, fetch)).first()["content"] == "hello"


@pytest.mark.parametrize("per_trigger", [1, 10])
def test_stream_equals_batch(spark, folder, per_trigger):
    sink = ingest.TableSink(str(folder / "table"), merge_after=3)
    run = lambda: ingest.ingest(spark, str(folder / "in"), sink, str(folder / "check"), per_trigger=per_trigger).awaitTermination()
    run()
    batch = ingest.TableSink(str(folder / "batch"), merge_after=3)
    ingest.ingest_batch(loaders.read_files(spark, str(folder / "in")), batch)
    cols = ["chunk_id", "content", "chunk_level"]
    want = sorted(map(tuple, batch.read(spark).select(*cols).collect()))
    assert sorted(map(tuple, sink.read(spark).select(*cols).collect())) == want and want
    run()  # nothing new: the checkpoint knows all files
    assert sink.read(spark).count() == len(want)
    (folder / "in" / "e.txt").write_text("a new file", encoding="utf-8")
    run()
    assert sink.read(spark).count() == len(want) + 3 or sink.read(spark).count() > len(want)


def test_ingest_keeps_all_pieces(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text(" ".join(f"word{i}of{k}" for i in range(2000)), encoding="utf-8")
    sink = ingest.TableSink(str(tmp_path / "table"), merge_after=3)
    ingest.ingest(spark, str(tmp_path / "in"), sink, str(tmp_path / "check")).awaitTermination()
    files = loaders.read_files(spark, str(tmp_path / "in"))
    cols = ["chunk_id", "parent_id", "content"]
    got = sorted(map(repr, sink.read(spark).select(*cols).collect()))
    want = sorted(map(repr, ingest.chunk_and_embed(files).select(*cols).collect()))
    assert any("_p1" in r for r in want) and got == want


def test_sink_repeats_and_updates(spark, tmp_path):
    sink = ingest.TableSink(str(tmp_path / "t"), "k", 2)
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    assert sink.read(spark) is None
    sink.write(rows(("a", 1), ("b", 1)), 0)
    sink.write(rows(("a", 2), ("c", 2)), 1)
    sink.write(rows(("a", 2), ("c", 2)), 1)  # the same batch again
    sink.write(rows(("a", 9)), 0)  # and one that is part of the base by now
    sink.write(spark.createDataFrame([], "k string, v int"), 2)
    assert {r["k"]: r["v"] for r in sink.read(spark).collect()} == {"a": 2, "b": 1, "c": 2}


def test_pipeline_checks():
    ok = {"components": {"a": {"type": "query", "name": "expansion"}}, "flow": {"a": []}}
    assert pipeline.build(ok).chain() == ["a"]
    for bad in ({}, {"components": {"a": {"type": "query"}}}, ok | {"flow": {"a": ["b"]}}, ok | {"entry_points": {"x": "y"}}, ok | {"flow": {"a": 3}}):
        with pytest.raises(ValueError):
            pipeline.build(bad)
    with pytest.raises(KeyError):
        pipeline.build({"components": {"a": {"type": "query", "name": "none"}}})
    forked = pipeline.build({"components": {n: {"type": "query", "name": "expansion"} for n in "abc"}, "flow": {"a": ["b", "c"]}})
    assert forked.chain() == ["a", "b"] and forked.list_components() == ["a", "b", "c"] and forked.get_entry_points() == {"default": "a"}
    with pytest.raises(ValueError):
        pipeline.build({"components": {n: {"type": "query", "name": "expansion"} for n in "ab"}, "flow": {"a": ["b"], "b": ["a"]}})
    assert pipeline.detect_mode({"producer": {}, "consumer": {}}) == "streaming" and pipeline.detect_mode({"architecture": {"type": "standard"}}) == "batch"
    assert set(pipeline.registry.names("splitter")) == {"text", "recursive", "semantic", "sentence", "hierarchical", "hierarchical_doc"}


def test_pipeline_runs(spark):
    config = {"components": {"split": {"type": "splitter", "name": "hierarchical", "config": {"chunk_sizes": [40, 10], "chunk_overlap": 2}}, "embed": {"type": "embedding", "name": "hash"}, "index": {"type": "indexer", "name": "bm25"}, "find": {"type": "retriever", "name": "hybrid", "config": {"top_k": 3}}, "order": {"type": "reranker", "name": "embedding"}, "answer": {"type": "generator", "name": "template"}}, "flow": {"split": "embed", "embed": "index", "index": "find", "find": "order", "order": "answer"}}
    docs = spark.createDataFrame([("d1", "The red fox sleeps. " * 6), ("d2", "Blue waves at sea. " * 6)], "source string, content string")
    queries = spark.createDataFrame([("q", "fox sleeps")], "qid string, query string")
    p = pipeline.build(config)
    steps = p.run_steps({"documents": docs, "queries": queries})
    assert list(steps) == ["split", "embed", "index", "find", "order", "answer"]
    row = steps["answer"]["answers"].first()
    assert "fox" in row["answer"] and row["context_used"] > 0


def test_retrievers_search_expansions(spark):
    from marlstone.functions.vectors import hash_embed

    chunks = hash_embed(spark.createDataFrame([("a", "red fox sleeps", 0), ("b", "blue waves roll", 0), ("c", "green hills", 0)], "chunk_id string, content string, chunk_level int"), "content", "content_vector", 64)
    rows = [("q", "fox sleeps", ["fox sleeps", None, "blue waves"]), ("r", "green hills", None), ("s", "green hills", ["blue waves"])]
    queries = spark.createDataFrame(rows, "qid string, query string, expanded_queries array<string>")
    tables = {"chunks": chunks} | pipeline.registry.get("indexer", "bm25")({})({"chunks": chunks})
    expand = pipeline.registry.get("query", "expansion")({})
    assert {r["qid"]: r["expanded_queries"] for r in expand({"queries": queries})["queries"].collect()} == {"q": rows[0][2], "r": ["green hills"], "s": ["green hills", "blue waves"]}
    for name, config in (("bm25", {}), ("hybrid", {"search_type": "text"}), ("hybrid", {"search_type": "vector", "top_k": 2}), ("hybrid", {"top_k": 2})):
        hits = pipeline.registry.get("retriever", name)(config)(tables | {"queries": queries})["hits"].collect()
        best = {r["id"]: (r["query_source"], r["source_query"]) for r in hits if r["qid"] == "q"}
        assert best == {"a": ("query_0", "fox sleeps"), "b": ("query_2", "blue waves")}
        assert {r["qid"]: (r["id"], r["source_query"]) for r in hits if r["rank"] == 1 and r["qid"] != "q"} == {"r": ("c", "green hills"), "s": ("c", "green hills")}


def test_config_file(tmp_path):
    (tmp_path / "p.yaml").write_text("components:\n  a: {type: query, name: decomposition}\nentry_point: a\n", encoding="utf-8")
    assert pipeline.cached_pipeline(str(tmp_path / "p.yaml")) is pipeline.cached_pipeline(str(tmp_path / "p.yaml"))


def test_models_in_pipelines(spark):
    chunks = spark.createDataFrame([(c, c * 5, None) for c in ("fox ", "sea ", "hill ")] + [("none", None, None), ("blank", " ", None)], "chunk_id string, content string, content_vector array<float>")
    queries = spark.createDataFrame([("q", "fox sea hill")], "qid string, query string")
    seen = lambda texts: [[float(len(t)), 1.0] for t in texts]
    out = pipeline.registry.get("embedding", "model")({"model": seen, "batch_size": 2})({"chunks": chunks})["chunks"]
    assert {r["chunk_id"]: r["content_vector"] is None for r in out.collect()} == {"fox ": False, "sea ": False, "hill ": False, "none": True, "blank": True}
    hits = spark.createDataFrame([("q", c, float(9 - i), i + 1, c * 5) for i, c in enumerate(("fox ", "sea ", "hill "))], "qid string, id string, score double, rank int, content string")
    tables = {"hits": hits, "queries": queries}
    order = lambda name, config: [r["id"] for r in pipeline.registry.get("reranker", name)(config)(tables)["hits"].orderBy("rank").collect()]
    assert order("llm", {"method": "listwise", "model": lambda p: "[3, 1]"}) == ["hill ", "fox ", "sea "]
    assert order("llm", {"method": "pointwise", "model": lambda p: str(p.count("sea"))}) == ["sea ", "fox ", "hill "]
    assert order("llm", {"method": "pairwise", "model": lambda q, a, b: len(a) > len(b) or len(a) == len(b) and a < b}) == ["hill ", "fox ", "sea "]
    assert order("service", {"model": lambda p: '{"rankings": [2, 1]}', "top_k": 2}) == ["hill ", "sea "]
    answers = pipeline.registry.get("generator", "llm")({"model": lambda p: p[-30:]})(tables)["answers"]
    assert answers.count() == 1


def test_sinks_and_cli(spark, tmp_path):
    from marlstone.operators import sinks
    from marlstone.plans import cli

    spark.sql("DROP TABLE IF EXISTS small")
    schema = spark.createDataFrame([(1, "a")], "k int, v string").schema
    sinks.create_table(spark, "small", schema, None)
    sinks.create_table(spark, "small", schema, None)
    spark.sql("INSERT INTO small VALUES (1, 'a')")
    sinks.copy_table(spark, "small", "smaller", lambda d: d.withColumn("w", F.lit(1)))
    assert spark.table("smaller").count() == 1
    sinks.recreate_table(spark, "small", schema, None)
    assert spark.table("small").count() == 0
    sinks.write_chunk_files(spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "id int, chunk_index int, chunk string"), str(tmp_path / "out"), "id")
    assert len(list((tmp_path / "out").rglob("*.txt"))) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("新词发现 甲新词发现乙 " * 20, encoding="utf-8")
    cli.main(["--input_dir", str(tmp_path / "in"), "--output_file", str(tmp_path / "words"), "--min_pmi", "0", "--min_entropy", "0"])
    assert next((tmp_path / "words").glob("*.csv")).read_text(encoding="utf-8").startswith("word\tfreq")
    with pytest.raises(SystemExit):
        cli.main([])


def test_text_files_without_folders_of_their_own(spark, tmp_path):
    from marlstone.operators import sinks
    from marlstone.sources import loaders

    rows = [(i, None if i == 3 else f"text {i}\nline é" * (i % 4)) for i in range(40)]
    sinks.write_text_files(spark.createDataFrame(rows, "doc_id int, text string"), f"file://{tmp_path}/files", "doc_id", "text")
    assert sum(p.is_file() for p in (tmp_path / "files").rglob("*")) == 39  # no checksums
    got = {int(r["filename"][7:-4]): r["content"] for r in loaders.read_files(spark, f"{tmp_path}/files", [".txt"]).collect()}
    assert got == {i: t + "\n" for i, t in rows if t is not None} and loaders.count_files(spark, f"{tmp_path}/files") == 39


def test_small_files_share_tasks(spark, tmp_path):
    from marlstone.sources import loaders

    for i in range(300):
        (tmp_path / f"{i}.txt").write_text("x")
    for value, most in (("4m", 300), ("200m", 16 * 4)):
        spark.conf.set("spark.sql.files.openCostInBytes", value)
        assert loaders.read_files(spark, str(tmp_path)).rdd.getNumPartitions() <= most
    spark.conf.unset("spark.sql.files.openCostInBytes")
