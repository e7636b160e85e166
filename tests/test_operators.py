"""Operators of the core on small fixtures."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.functions import prompts, text, understanding
from marlstone.functions.vectors import hash_embed
from marlstone.operators import index, newwords, rerank, retrieve, stats
from marlstone.operators.components import connected_components
from marlstone.operators.prefix import running_totals


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.2 else "g" if rng.random() < 0.6 else "h", i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r["g"], r["o"]): r["t"] for r in running_totals(df, ["g"], ["o"], {"t": "v"}, parts=7).collect()}
    sums = defaultdict(int)
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        sums[g] += v
        assert got[g, o] == sums[g]
    assert running_totals(df.limit(0), ["g"], ["o"], {"t": "v"}).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    least = {}
    for x in parent:
        least[find(x)] = min(least.get(find(x), x), x)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: least[find(x)] for x in got}
    assert set(got) == {x for a, b in edges if a is not None and a != b for x in (a, b)}


def test_bm25_against_loops(spark):
    docs = [(1, "red fox red"), (2, "blue sea"), (3, "fox sea sea storm"), (4, ""), (5, None)]
    ix = index.build_index(spark.createDataFrame(docs, "id int, text string"), "id", ["text"])
    terms = retrieve.query_terms(spark.createDataFrame([("q", "Fox fox sea")], "qid string, query string"), "qid", "query")
    held = {i: t.split() for i, t in docs if t}
    n, avg = len(held), sum(map(len, held.values())) / len(held)
    want = {}
    for i, words in held.items():
        s = 0.0
        for t in ["fox", "fox", "sea"]:
            df = sum(t in w for w in held.values())
            tf = words.count(t)
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
        if s:
            want[i] = round(s, 4)
    got = {r["id"]: r["score"] for r in retrieve.text_search(ix, terms, 10).collect()}
    assert got == want


def test_index_save_append(spark, tmp_path):
    a = index.build_index(spark.createDataFrame([(1, "red fox"), (2, "blue sea")], "id int, text string"), "id", ["text"])
    a.save(str(tmp_path / "ix"))
    loaded = index.InvertedIndex.load(spark, str(tmp_path / "ix"))
    b = index.build_index(spark.createDataFrame([(2, "green green hill"), (3, "sea")], "id int, text string"), "id", ["text"])
    both = loaded.append(b)
    fresh = index.build_index(spark.createDataFrame([(1, "red fox"), (2, "green green hill"), (3, "sea")], "id int, text string"), "id", ["text"])
    for name in ("postings", "lengths", "corpus"):
        assert sorted(map(tuple, getattr(both, name).collect())) == sorted(map(tuple, getattr(fresh, name).collect()))


def test_vector_search_blocks_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 2)
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", None), ("f", [1.0]), ("g", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    q = df.withColumnRenamed("id", "qid").where("qid in ('a', 'b', 'c')")
    got = [(r["qid"], r["id"]) for r in retrieve.vector_search(df, q, 2, exclude_self=True).orderBy("qid", "rank").collect()]
    assert got == [("a", "g"), ("a", "b"), ("b", "a"), ("b", "g"), ("c", "b"), ("c", "a")]
    assert retrieve.vector_search(df, q.limit(0), 2).count() == 0


def test_fusion_branches(spark):
    schema = "qid string, id string, score double, rank int"
    one = spark.createDataFrame([("q", "a", 3.0, 1), ("q", "b", 2.0, 2)], schema)
    two = spark.createDataFrame([("q", "b", 0.9, 1), ("q", "c", 0.8, 2)], schema)
    none = one.limit(0)
    got = {r["id"]: r["recall_source"] for r in retrieve.fuse(one, two).collect()}
    assert got == {"a": "text", "b": "hybrid", "c": "vector"}
    swapped = {r["id"]: r["score"] for r in retrieve.fuse(two, one).collect()}
    assert swapped == {r["id"]: r["score"] for r in retrieve.fuse(one, two).collect()}
    assert retrieve.fuse(none, none).count() == 0 and retrieve.fuse(one, none).count() == 2
    with pytest.raises(ValueError):
        retrieve.fuse(one, two, "other")


def test_upsert_and_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", None, None)], "k string, t int, v string")
    assert sorted(map(tuple, index.latest(df, ["k"], ["t"]).collect())) == [("a", 3, "y"), ("b", None, None)]
    old = spark.createDataFrame([("a", 0, "old"), ("c", 0, "keep")], "k string, t int, v string")
    got = {r["k"]: r["v"] for r in index.upsert(old, df, ["k"], ["t"]).collect()}
    assert got == {"a": "y", "b": None, "c": "keep"}


def test_text_functions(spark):
    df = spark.createDataFrame([("say <output> a\nb </output> x",), ("  plain ",), ("Order [3, 1,2] and 7.5",), (None,)], "c string")
    got = df.select(text.tagged_output(F.col("c")), text.rank_list(F.col("c")), text.first_number(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("a\nb", None, 0.0), ("plain", None, 0.0), ("Order [3, 1,2] and 7.5", [2, 0, 1], 3.0), (None, None, 0.0)]
    m = spark.createDataFrame([("a Fox and foxes (x)", ["fox", "(x)"])], "c string, t array<string>")
    row = m.select(text.mark_terms(F.col("c"), F.col("t")).alias("m")).select("m", text.marked_terms(F.col("m")).alias("t"), text.fragments(F.col("m"), 20, 1).alias("f")).first()
    assert row["m"] == "a <mark>Fox</mark> and <mark>fox</mark>es <mark>(x)</mark>"
    assert row["t"] == ["fox", "x"] and len(row["f"]) == 1
    bi = spark.createDataFrame([("搜索引擎 AB x",)], "c string").select(text.analyze_bigrams(F.col("c")).alias("t")).first()["t"]
    assert bi == ["搜索", "索引", "引擎", "ab"]


def test_understanding(spark):
    q = spark.createDataFrame([("如何配置缓存，以及什么是索引？",), ("it",), ("",), ("Ask about 2024 in New York",)], "q string")
    got = [tuple(r) for r in q.select(understanding.needs_decomposition(F.col("q")), F.round(understanding.ambiguity(F.col("q")), 3), understanding.needs_abstraction(F.col("q"))).collect()]
    assert got == [(True, 0.3, False), (False, 0.7, False), (False, 0.3, False), (False, 0.0, True)]
    s = spark.createDataFrame([("what is it", ["what is it ", "abc", "first one", "first one", "second one"])], "q string, s array<string>")
    assert s.select(understanding.filter_subqueries(F.col("s"), F.col("q")).alias("x")).first()["x"] == ["first one", "second one"]


def test_prompts(spark):
    m = prompts.TemplateManager()
    assert len(m.names()) == 14 and prompts.slots("{a} {b} {a}") == ["a", "b"]
    with pytest.raises(KeyError):
        m.fill("summary_prompt", content=F.lit("x"))
    with pytest.raises(KeyError):
        m.get("none")
    m.register("t", "{a}!")
    assert spark.range(1).select(m.fill("t", a=F.lit("{b}")).alias("x")).first()["x"] == "{b}!"
    hits = spark.createDataFrame([("q", 1, "T", "x" * 50), ("q", 2, "U", "y" * 300), ("q", 3, "V", "z")], "qid string, rank int, title string, content string")
    row = prompts.budgeted_context(hits, 250).first()
    assert row["used"] == 2 and row["context"].endswith("...") and "文档1 - T:" in row["context"]
    assert prompts.budgeted_context(hits, 120).first()["used"] == 1


def test_rerank(spark):
    hits = spark.createDataFrame([("q", c, float(-i), i + 1, c * 3, "ask") for i, c in enumerate("abcd")], "qid string, id string, score double, rank int, content string, query string")
    answers = spark.createDataFrame([("q", "[3, 1]")], "qid string, answer string")
    assert [r["id"] for r in rerank.by_list(hits, answers).orderBy("new_rank").collect()] == ["c", "a", "b", "d"]
    nothing = spark.createDataFrame([("q", "no list")], "qid string, answer string")
    assert [r["id"] for r in rerank.by_list(hits, nothing).orderBy("new_rank").collect()] == ["a", "b", "c", "d"]
    assert [r["id"] for r in rerank.by_comparison(hits, lambda q, a, b: a > b).orderBy("new_rank").collect()] == ["d", "c", "b", "a"]
    service = spark.createDataFrame([("q", '{"results": [{"index": 2, "relevance_score": 0.9}, {"index": 0, "score": 0.5}]}')], "qid string, answer string")
    assert [r["id"] for r in rerank.by_service(hits, service, 3).orderBy("new_rank").collect()] == ["c", "a", "b"]
    calls = rerank.ask(hits, "content", lambda t: t.upper()).orderBy("rank").collect()
    assert [r["answer"] for r in calls] == ["AAA", "BBB", "CCC", "DDD"]


def test_hash_embed(spark):
    df = spark.createDataFrame([(1, "fox fox sea"), (2, ""), (3, None), (4, "fox sea fox")], "id int, text string")
    got = {r["id"]: r["content_vector"] for r in hash_embed(df, "text", dim=16).collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-6


def test_new_words_edges(spark):
    docs = spark.createDataFrame([(t,) for t in ["", None, "abc", *["新词发现 甲新词发现乙", "丙新词发现丁"] * 6]], "text string")
    words, total = newwords.corpus_words(docs, "text")
    assert total.first()["total"] > 0
    assert newwords.new_words(docs.limit(2), "text").count() == 0
    got = [r["word"] for r in newwords.new_words(docs, "text", min_pmi=0.0, min_entropy=0.0).collect()]
    known = spark.createDataFrame([(got[0],)], "word string")
    assert got[0] not in [r["word"] for r in newwords.new_words(docs, "text", min_pmi=0.0, min_entropy=0.0, known=known).collect()]


def test_stats(spark):
    assert stats.synthetic_documents(spark, 5, dim=8).collect()[0]["content_vector"].__len__() == 8
    ev = spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.4), (3, "a", 1.2), (4, "b", 1.3)], "id int, k string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    got = {r["id"]: (r["in_window"], r["over_limit"]) for r in stats.requests_in_window(ev, "ts", ["k"], 1.0, 1).collect()}
    assert got == {1: (1, False), 2: (2, True), 3: (2, True), 4: (1, False)}
    assert stats.describe_columns(ev).count() == 4


def test_counted_and_release(spark, tmp_path):
    from marlstone.session import materialize, release

    df, seen = stats.counted(spark.range(7))
    df.write.parquet(str(tmp_path / "t"))
    assert seen.get == {"document_count": 7}
    kept = materialize(spark.range(3))
    assert kept.count() == 3 and release(spark) > 0
    with pytest.raises(Exception):
        kept.count()
