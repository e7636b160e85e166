"""Joins with hot keys."""

from pyspark.sql import functions as F

from marlstone.operators import index, retrieve, skew


def test_salted_join_equals_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2), ("z", 3)], "k string, v int")
    small = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("a", "x"), ("c", "x")], "k string, w string")
    hot = skew.hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", 7)
    for how in ("inner", "left"):
        want = sorted(map(repr, big.join(small, "k", how).collect()))
        assert sorted(map(repr, skew.salted_join(big, small, ["k"], hot, F.col("v"), how).collect())) == want
    assert skew.spread_rows(big, hot, ["k"], F.col("v")).where("k = 'hot'").select("__salt").distinct().count() > 4


def test_search_with_frequent_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "sea " * (i % 3 + 1) + ("fox" if i % 5 == 0 else "hill")) for i in range(40)], "id int, text string")
    ix = index.build_index(docs, "id", ["text"])
    terms = retrieve.query_terms(spark.createDataFrame([("q", "sea fox"), ("r", "sea sea")], "qid string, query string"), "qid", "query")
    found = []
    for limit in (10**6, 2):
        monkeypatch.setattr(skew, "HOT", limit)
        found.append(sorted(map(tuple, retrieve.text_search(ix, terms, 40).collect())))
    assert found[0] == found[1] and len(found[0]) == 80
    assert {r[1] for r in found[0] if r[0] == "q" and r[3] <= 8} == set(range(0, 40, 5))


def test_parents_of_large_roots(spark, monkeypatch):
    from marlstone.operators import split

    rows = [(f"p{i}", "r", 0, i, f"text {i} and {i + 1} end") for i in range(9)] + [(f"c{i}", "r", 1, i, f"{i} and {i + 1}") for i in range(9)] + [("x", "s", 1, 0, "0 and 1"), ("n", None, 1, 0, "0 and 1"), ("e", "r", 1, 0, None)]
    df = spark.createDataFrame(rows, "chunk_id string, root_id string, chunk_level int, chunk_index int, content string")
    want = [(f"c{i}", f"p{i}") for i in range(9)]
    for most in (2000, 2):
        monkeypatch.setattr(split, "LARGE_ROOT", most)
        assert sorted(map(tuple, split.find_parents(df).collect())) == want
