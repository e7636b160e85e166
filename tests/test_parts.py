"""Parts that no registered query reaches: similarities, linked nodes, fallbacks, limits, streams of pipelines."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import index, rerank, retrieve, split
from marlstone.plans import pipeline
from marlstone.sources import loaders
from marlstone.streaming import ingest

WORDS = " ".join(f"word{i}. " for i in range(60))


def test_embedding_similarity():
    near = split.embedding_similarity(lambda t: [float(len(t)), 1.0])
    assert near("abc", "abd") == pytest.approx(1.0)
    assert split.embedding_similarity(lambda t: [0.0] * len(t))("ab", "cd") == 0.0
    assert split.embedding_similarity(lambda t: [1.0] * len(t))("ab", "abc") == 0.0

    def down(t):
        raise OSError

    assert split.embedding_similarity(down)("a b", "a c") == pytest.approx(1 / 3)
    one = split.semantic_chunks("a b c. d e f. g h i.", 8, 0.5, similar=split.embedding_similarity(lambda t: [1.0, 0.0]))
    assert one == ["a b c", "d e f", "g h i"] and split.semantic_chunks("a b c. d e f. g h i.", 12, 0.5, similar=lambda a, b: 1.0) == ["a b c d e f", "g h i"]


def test_linked_nodes(spark):
    df = spark.createDataFrame([(1, WORDS, "src"), (2, "", "x"), (3, None, "y")], "id int, content string, source string")
    nodes = {r["node_id"]: r for r in split.parse_hierarchy(df, "id", "content", [60, 20, 8], 2, ["source"]).collect()}
    assert {r["depth"] for r in nodes.values()} == {0, 1, 2} and {r["source"] for r in nodes.values()} == {"src"}
    for r in nodes.values():
        assert (r["parent_id"] is None) == (r["depth"] == 0)
        if r["parent_id"]:
            assert r["content"] in nodes[r["parent_id"]]["content"] and nodes[r["parent_id"]]["depth"] == r["depth"] - 1
        if r["next_id"]:
            assert nodes[r["next_id"]]["prev_id"] == r["node_id"] and nodes[r["next_id"]]["depth"] == r["depth"]
    with pytest.raises(ValueError):
        split.parse_hierarchy(df, "id", "content", [8], 8)


def test_second_fallback_and_kept_columns(spark):
    long = "x" * 2000 + " " + "y " * 700
    df = spark.createDataFrame([(1, long, "s", [1, 2])], "id int, content string, source string, tags array<int>")
    second = lambda t: [t[i : i + 50] for i in range(0, min(len(t), 1000), 50)] + ([t[1000:]] if len(t) > 1000 else [])
    rows = split.split_hierarchy(df, "id", "content", [500, 50], 5, 600, fallback=lambda t: [t], second=second, keep=["source", "tags"]).collect()
    methods = {r["split_method"] for r in rows}
    assert {"hierarchical+second", "hierarchical+emergency_truncation"} <= methods
    assert all(r["text_length"] == len(r["content"]) <= 600 and r["source"] == "s" and r["tags"] == [1, 2] for r in rows)
    assert sorted(r["chunk_index"] for r in rows) == list(range(len(rows))) and {r["total_chunks"] for r in rows} == {len(rows)}
    assert len({r["chunk_id"] for r in rows}) == len(rows)


def test_first_holders_are_the_first():
    above = ["abcdefghijklmnop qrst", "xx abcdefghijklmnop", "short"]
    assert split.first_holders(["abcdefghijklmno", "abcdefghijklmnop", "xx abcdefghijkl", "short", "nowhere at all now", "ort"], above) == [0, 0, 1, 2, None, 2]


def test_rate_limit():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limit = rerank.RateLimit(3, 1.0, lambda: now[0], sleep)
    begun = []
    for _ in range(10):
        limit.wait()
        begun.append(now[0])
        now[0] += 0.1
    assert all(b[3] - b[0] >= 1.0 - 1e-9 for b in zip(begun, begun[1:], begun[2:], begun[3:])) and slept


def test_progress():
    p = ingest.Progress([{"batch": 0, "rows": 30, "rows_per_second": 1.0, "ms": 1000}, {"batch": 1, "rows": 10, "rows_per_second": 1.0, "ms": 3000}])
    t = p.totals(60)
    assert t["status"] == "running" and t["tps"] == 10 and t["seconds_left"] == 2 and (t["min_batch_time"], t["max_batch_time"], t["avg_batch_time"]) == (1, 3, 2)
    assert p.totals()["status"] == "completed" and ingest.Progress().totals()["tps"] == 0


def test_levels_by_path(spark):
    flat = spark.createDataFrame([(0,), (3,), (None,)], "chunk_level int")
    nested = flat.select(F.lit(None).cast("int").alias("chunk_level"), F.struct("chunk_level").alias("metadata"))
    got = [tuple(retrieve.detect_small_level(d).first()) for d in (flat, nested, flat.limit(0), flat.select(F.lit(1).alias("x")))]
    assert got == [("chunk_level", 3, [0, 3]), ("metadata.chunk_level", 3, [0, 3]), (None, 2, []), (None, 2, [])]


def test_latest_with_many_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "n"), (None, 2, "m"), ("b", None, "z")], "k string, t int, v string")
    for few in (10, 0):
        assert sorted(map(repr, index.latest(df, ["k"], ["t"], few).collect())) == sorted(map(repr, [r for r in df.collect() if r["v"] in "ymz"]))


def test_search_rejects_unknown_types(spark):
    ix = index.build_index(spark.createDataFrame([("a", "sea")], "id string, text string"), "id", ["text"])
    vec = spark.createDataFrame([("a", [1.0])], "id string, vector array<double>")
    q = spark.createDataFrame([("q", [1.0], "other", 1)], "qid string, vector array<double>, search_type string, top_k int")
    with pytest.raises(ValueError):
        retrieve.search(ix, vec, q, retrieve.query_terms(spark.createDataFrame([("q", "sea")], "qid string, t string"), "qid", "t"))


def test_services_that_answer_oddly(spark):
    hits = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate("abc")], "qid string, id string, rank int")
    order = lambda a, **how: [r["id"] for r in rerank.by_service(hits, spark.createDataFrame([("q", a)], "qid string, answer string"), 3, **how).orderBy("new_rank").collect()]
    assert order('{"results": [{"index": 2, "score": 0.1}, {"index": 9, "score": 0.9}, {"index": 2, "score": 0.2}]}') == ["c", "a", "b"]
    assert order('{"results": []}', pad=False) == order("broken", pad=False) == order(None) == ["a", "b", "c"]
    assert order('{"data": [{"index": 1, "relevance_score": 0.4}]}', pad=False) == ["b"]


def test_dictionary_analyzer_edges(spark):
    q = spark.createDataFrame([("搜索引擎 Abc x",), ("",), (None,)], "q string")
    smart, every = text.dictionary_analyzer(["搜索", "搜索引擎", "引擎", "a.b"]), text.dictionary_analyzer(["搜索", "搜索引擎", "引擎"], "max_word")
    assert [r[0] for r in q.select(smart(F.col("q"))).collect()] == [["搜索引擎", "Abc"], [], None]
    assert q.select(every(F.col("q"))).first()[0] == ["搜索", "搜索引擎", "引擎", "Abc"]
    assert q.select(text.dictionary_analyzer([])(F.col("q"))).first()[0] == ["Abc"]
    with pytest.raises(ValueError):
        text.dictionary_analyzer(["ab"], "other")


def test_pipeline_modes_and_metadata(spark, tmp_path):
    config = {"components": {"cut": {"type": "splitter", "name": "semantic", "config": {"chunk_size": 40, "similarity_threshold": 0.1, "embed": lambda t: [1.0, float(len(t))]}}}}
    docs = spark.createDataFrame([("d", "One two. Three four. Five six seven eight nine.", "en")], "source string, content string, lang string")
    steps = pipeline.build(config).run_steps({"documents": docs})
    row = steps["cut"]["chunks"].first()
    assert row["lang"] == "en" and row["split_method"] == "semantic" and steps["cut"].kind == "splitter.semantic" and steps["cut"].timestamp > 0
    for name, extra in (("hierarchical", {"chunk_sizes": [40, 10], "chunk_overlap": 2, "fallback_config": {"type": "recursive", "chunk_size": 30, "secondary": {"type": "sentence", "chunk_size": 20}}}), ("hierarchical_doc", {"chunk_sizes": [40, 10]}), ("sentence", {"chunk_size": 20, "chunk_overlap": 2}), ("recursive", {"chunk_size": 20}), ("text", {"chunk_size": 20, "split_method": "word"})):
        p = pipeline.build({"components": {"cut": {"type": "splitter", "name": name, "config": extra | ({"chunk_overlap": 1} if name == "hierarchical_doc" else {})}}})
        assert p.run({"documents": docs})["chunks"].first()["lang"] == "en"
    (tmp_path / "a.yaml").write_text("x: 1\n", encoding="utf-8")
    (tmp_path / "b.yml").write_text("y: 2\n", encoding="utf-8")
    assert pipeline.load_configs(str(tmp_path)) == {"a": {"x": 1}, "b": {"y": 2}}


def test_pdf_files_need_a_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.txt").write_text("text", encoding="utf-8")
    with pytest.raises(ValueError):
        loaders.load(spark, str(tmp_path))
    assert loaders.load(spark, str(tmp_path), [".txt"]).count() == 1
    pages = loaders.load(spark, str(tmp_path), pdf=lambda b: b.decode().split("|")).where("file_type = 'pdf'").collect()
    assert sorted(r["content"] for r in pages) == ["one", "two"]


def test_vector_files(spark, tmp_path):
    import numpy as np

    from marlstone.operators.ivf import VectorIndex

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16)) * 0.4
    rows = [(f"v{i:04}", v.tolist()) for i, v in enumerate(x)] + [("n", None), ("z", [0.0] * 16), ("s", [1.0]), ("nan", [float("nan")] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((1 + u @ u.T) / 2, 6)
    want = {f"v{i:04}": sorted(range(1500), key=lambda j: (-s[i, j], j))[:5] for i in range(0, 1500, 30)}
    asked = df.where(F.substring("id", 2, 4).try_cast("int") % 30 == 0).withColumnRenamed("id", "qid")
    ix = VectorIndex.build(df, dim=16, block=20)
    assert ix.sizes.sum() == 1500 and ix.filed.select("block").distinct().count() > 1
    ix.save(str(tmp_path / "ix"))
    for candidates, least in ((1500, 1.0), (400, 0.9)):
        got = {}
        for r in VectorIndex.load(spark, str(tmp_path / "ix")).search(asked, 5, candidates).collect():
            got.setdefault(r["qid"], []).append(int(r["id"][1:]))
        assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= least * 5 * len(want)
    empty = VectorIndex.build(df.where("vector IS NULL"), dim=16)
    assert empty.search(asked, 5).count() == 0
