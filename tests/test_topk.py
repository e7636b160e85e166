"""Searches whose tasks keep their own best: equal to scoring every pair, and no more rows leave a task than are asked for."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marlstone.operators import index, retrieve, topk


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [[words[min(int(rng.paretovariate(0.7)) - 1, 59)] for _ in range(rng.randrange(1, 30))] for _ in range(n)]


@pytest.mark.parametrize("k", [1, 3, 20])
@pytest.mark.parametrize("low", [0.05, -0.4])
def test_best_documents_against_all_pairs(monkeypatch, k, low):
    for name, value in (("FIRST_ROWS", 4), ("MOST_ROWS", 32), ("PAIRS", 40)):
        monkeypatch.setattr(topk, name, value)
    docs, queries = corpus(300, 1), corpus(25, 2)
    rng = random.Random(3)
    idf = np.array([rng.uniform(low, 3) for _ in range(60)])
    number = {f"w{i}": i for i in range(60)}
    asked = pa.table([pa.array(x) for x in zip(*[(f"q{i:02}", t, n) for i, words in enumerate(queries) for t, n in Counter(words).items()])], names=["qid", "term", "qtf"])
    names, terms, q, t, qtf = topk.numbered(asked)
    idf_of = idf[[number[x] for x in terms.to_pylist()]]
    held = [Counter(d) for d in docs]
    avg = sum(map(len, docs)) / len(docs)
    want = {}
    for i, words in enumerate(queries):
        found = []
        for j, c in enumerate(held):
            s = sum(n * idf[number[x]] * c[x] * 2.5 / (c[x] + 1.5 * (0.25 + 0.75 * len(docs[j]) / avg)) for x, n in Counter(words).items() if x in c)
            if any(x in c for x in words) and (low > 0 or s > 0):
                found.append((-round(s, 4), f"d{j:03}"))
        want[f"q{i:02}"] = sorted(found)[:k]
    table = pa.RecordBatch.from_arrays([pa.array([f"d{j:03}" for j in range(300)]), pa.array([[" ".join(d).split()] for d in docs])], ["id", "tokens"])
    coded = list(topk.count_terms(terms, [0], 1)(iter([table.slice(0, 170), table.slice(170)])))
    got = defaultdict(list)
    for b in topk.best_documents(names, q, t, qtf, idf_of, np.array([avg]), k, 1.5, 0.75, low < 0)(iter(coded)):
        for r in b.to_pylist():
            got[r["qid"]].append((-r["score"], r["id"]))
    assert {i: sorted(x)[:k] for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert sum(map(len, got.values())) <= 2 * k * len(queries)


def test_many_ties_do_not_pile_up():
    best = topk.Best(1, 2)
    for at in range(20):
        best.add(np.zeros(10_000, int), pa.array(range(at * 10_000, (at + 1) * 10_000)), np.ones(10_000))
    assert [r for b in best.result(pa.array(["q"])) for r in b.column("id").to_pylist()] == [0, 1]


def test_search_passes_on_the_best_of_each_task(spark):
    docs = spark.createDataFrame([(i, "sea " * (i % 7 + 1) + f"no{i}") for i in range(200)], "id int, text string").repartition(4)
    ix = index.build_index(docs, "id", ["text"])
    terms = retrieve.query_terms(spark.createDataFrame([(f"q{i}", "sea") for i in range(50)], "qid string, query string"), "qid", "query")
    assert retrieve.best_texts(ix, terms, 2).count() <= 50 * 2 * 4
    kept = ix.stored()
    for how in ({}, {"variant": "okapi"}, {"boosts": {"text": 2.0}}, {"allowed": docs.where("id % 3 = 0")}):
        of = [sorted(map(tuple, retrieve.text_search(x, terms, 2, **how).collect())) for x in (ix, kept)]
        assert of[0] == of[1]
    assert retrieve.best_texts(ix, terms.limit(0), 2).count() == 0


def test_queries_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"sea w{i % 5} w{i % 3}") for i in range(40)], "id int, text string")
    ix = index.build_index(docs, "id", ["text"])
    terms = retrieve.query_terms(spark.createDataFrame([(f"q{i}", f"sea w{i % 5}") for i in range(9)], "qid string, query string"), "qid", "query")
    found = []
    for few in (500_000, 4):
        monkeypatch.setattr(retrieve, "FEW_TERMS", few)
        monkeypatch.setattr(topk, "ROWS", few)
        found.append(sorted(map(tuple, retrieve.text_search(ix, terms, 3).collect())))
    assert found[0] == found[1] and len(found[0]) == 27


@pytest.mark.parametrize("metric", ["cosine", "unit_cosine", "dot_product", "euclidean"])
def test_vector_tasks_keep_their_best(metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x[7] = 0
    q = rng.normal(size=(5, 8))
    asked = pa.table({"qid": [f"q{i}" for i in range(5)], "v": list(q)})
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(list(x[a:b]))], ["id", "v"])
    got = [r for b in retrieve._scan(asked, 4, metric, False)(iter([batch(0, 400), batch(400, 402), batch(402, 900)])) for r in b.to_pylist()]
    with np.errstate(all="ignore"):
        cos = q @ x.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    s = {"cosine": cos, "unit_cosine": (1 + cos) / 2, "dot_product": q @ x.T, "euclidean": 1 / (1 + np.linalg.norm(q[:, None] - x[None], axis=2))}[metric]
    want = sorted((f"q{i}", int(j), round(float(s[i, j]), 6)) for i in range(5) for j in np.argsort(-np.nan_to_num(s[i], nan=-9))[:4])
    assert sorted((r["qid"], r["id"], round(r["score"], 6)) for r in got) == want


@pytest.mark.parametrize("name", ["hybrid_vectors", "search_by_request", "bm25_threshold", "bm25_multifield", "multi_query_dedup", "hybrid_differential", "bm25_segmented", "bm25_filtered", "match_field", "bm25_topk", "bm25_okapi_topk", "small_to_big"])
def test_queries_write_no_postings(spark, monkeypatch, name):
    from marlstone.plans import catalog, catalog_models  # noqa: F401

    def stored(self):
        raise AssertionError("an index that is searched once needs no postings")

    monkeypatch.setattr(index.InvertedIndex, "stored", stored)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_pipelines_search_the_texts_of_their_index(spark, capsys):
    from marlstone.plans import pipeline

    chunks = spark.createDataFrame([("a", "red fox"), ("b", "blue sea")], "chunk_id string, content string")
    made = pipeline.registry.get("indexer", "bm25")({"analyzer": "plain"})({"chunks": chunks})
    ix = index.InvertedIndex(made["postings"], made["lengths"], made["corpus"])
    ix.holdings(pa.array(["fox"]), ["content"]).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_hits_of_a_retriever_are_stored_once(spark):
    from marlstone.plans import pipeline

    chunks = spark.createDataFrame([("a", "red fox"), ("b", "blue sea")], "chunk_id string, content string")
    queries = spark.createDataFrame([("q", "fox"), ("r", "hill")], "qid string, query string")
    tables = {"chunks": chunks, "queries": queries} | pipeline.registry.get("indexer", "bm25")({})({"chunks": chunks})
    found = pipeline.registry.get("retriever", "bm25")({})(tables)
    scans = found["retrieval"]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in scans  # counted from the stored hits, not searched again
    assert {r["qid"]: r["result_count"] for r in found["retrieval"].collect()} == {"q": 1, "r": 0}


@pytest.mark.parametrize("name", ["pipeline_steps"])
def test_pipelines_join_no_postings(spark, monkeypatch, name):
    from marlstone.plans import catalog, catalog_tables  # noqa: F401

    def joined(*_, **__):
        raise AssertionError("postings are not joined to queries")

    monkeypatch.setattr(retrieve, "salted_join", joined)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()
