"""Splitters against independent restatements and by their properties."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.operators import split

LETTERS = st.text(alphabet="ab .\n。！一二中　", max_size=300)


@settings(max_examples=60, deadline=None)
@given(LETTERS, st.integers(1, 40), st.integers(0, 10))
def test_character_windows(text, size, overlap):
    overlap = min(overlap, size - 1)
    want, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            window = text[start:end]
            for sign in "\n", " ":
                if sign in window:
                    end = start + window.rindex(sign) + 1
                    break
        if text[start:end].strip():
            want.append(text[start:end].strip())
        start = max(start + 1, end - overlap)
    assert split.character_chunks(text, size, overlap) == want
    assert all(len(c) <= size for c in want)


@settings(max_examples=60, deadline=None)
@given(LETTERS, st.integers(4, 60))
def test_token_chunks_fit_and_come_from_the_text(text, size):
    for c in split.token_chunks(text, size, size // 4):
        assert c in text
        assert split.token_count(c) <= size + size // 4 + 1


@settings(max_examples=60, deadline=None)
@given(LETTERS, st.integers(1, 40))
def test_recursive_chunks_fit(text, size):
    got = split.recursive_chunks(text, size)
    assert all(0 < len(c) <= size for c in got)
    assert "".join("".join(got).split()) == "".join(text.split())


def test_native_splitters(spark):
    text = "One two. Three!! 四五六。 " * 9
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "lonely"), (5, " 　 ")], "id int, text string")
    got = [r["chunk"] for r in split.split_sentences(df, "id", "text", 20).where("id = 1").orderBy("chunk_index").collect()]
    want, cur = [], ""
    for s in filter(None, map(str.strip, re.split(r"[.!?。！？]+", text))):
        if cur and len(cur) + len(s) > 20:
            want.append(cur)
            cur = s
        else:
            cur = f"{cur} {s}" if cur else s
    assert got == [*want, cur]
    words = text.split()
    got = [r["chunk"] for r in split.split_words(df, "id", "text", 5, 2).where("id = 1").orderBy("chunk_index").collect()]
    assert got == [" ".join(words[i : i + 5]) for i in range(0, len(words), 3)]
    assert {r["id"] for r in split.split_sentences(df, "id", "text", 20).collect()} == {1, 4}


def test_semantic():
    text = "red fox runs. red fox sleeps. blue sea waves."
    assert split.semantic_chunks(text, 1000, 0.5) == [text]
    assert split.semantic_chunks(text, 30, 0.5) == ["red fox runs red fox sleeps", "blue sea waves"]
    assert split.semantic_chunks(text, 39, 0.5, max_size=5) == split.character_chunks(text, 39)


def test_hierarchy(spark):
    text = "\n".join(f"Sentence number {i} stands here." for i in range(80)) + "\n" + "x" * 5000
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "id string, text string")
    rows = split.split_hierarchy(df, "id", "text", [200, 40], 5, max_size=900).collect()
    assert {r["id"] for r in rows} == {"a"}
    by_id = {r["chunk_id"]: r for r in rows if r["split_method"] == "hierarchical"}
    for r in rows:
        assert len(r["content"]) <= 900
        if r["split_method"] == "hierarchical":
            assert r["text_length"] == len(r["content"])
            if r["parent_id"] in by_id:
                assert r["content"] in by_id[r["parent_id"]]["content"]
    assert any(r["split_method"] != "hierarchical" for r in rows)


def test_pieces_of_oversized_chunks_have_ids_and_children(spark):
    text = " ".join(f"word{i}" for i in range(1200)) + "\n" + "x" * 5000
    df = spark.createDataFrame([("a", text)], "id string, text string")
    rows = split.split_hierarchy(df, "id", "text", [300, 40], 5, max_size=900).collect()
    by_id = {r["chunk_id"]: r for r in rows}
    assert len(by_id) == len(rows)
    pieces = [r for r in rows if r["split_method"] != "hierarchical"]
    assert any(r["truncated"] for r in rows) or len(pieces) > 3
    below = [r for r in rows if r["parent_id"]]
    assert {r["parent_id"] for r in below} <= set(by_id)
    assert any("_p" in r["parent_id"] and not r["parent_id"].endswith("_p0") and r["content"] in by_id[r["parent_id"]]["content"] for r in below)


def test_piece_of():
    pieces = [("p0", 0, "abcdef"), ("p1", 5, "fghijk"), ("p2", 11, "lmn")]
    assert split.piece_of(pieces, 6, "ghi") == "p1"
    assert split.piece_of(pieces, 4, "efghi") == "p1" and split.piece_of(pieces, 1, "bcdefgh") == "p0"
    assert split.piece_of([("p0", -1, "other")], 3, "text") == "p0"


def test_arguments(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    for call in (lambda: split.split_words(df, "id", "text", 0), lambda: split.split_words(df, "id", "text", 5, 5), lambda: split.split_semantic(df, "id", "text", 10, 2.0), lambda: split.split_hierarchy(df, "id", "text", [10, 5], 5), lambda: split.at_depth(df, -1)):
        with pytest.raises(ValueError):
            call()
