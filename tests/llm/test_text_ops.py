"""Markup, look-alikes, near duplicates and the vector tree: brute force, round trips and edge cases."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import knntree, lookalike, markup, neardup

# Markup --------------------------------------------------------------------------------------------------------

MARKED = {
    "# Title\n\nText": ["heading"],
    "Title\n=====\n\nText": ["heading"],
    "== Part ==\ntext": ["heading"],
    "<h2 id=x>Part</h2><p>text</p>": ["heading"],
    r"\section{Part} text": ["heading"],
    "text\n\n- [x] one\n- [ ] two": ["list"],
    "text\n- one\n- two": ["list"],
    "text\n+ one\n+ two": ["list"],
    "1.\tone\n2.\ttwo": ["list"],
    "- one\n\n- two\n  goes on\n- three": ["list"],
    "$$" + "a_1 + " * 2000 + "b$$": ["formula"],
    r"\(" + "a_1 + " * 2000 + r"b\)": ["formula"],
    "$" + "x_1 + " * 200 + "y$": ["formula"],
    "Long title " * 40 + "\n=====\n\ntext": ["heading"],
    "[[" + "x" * 310 + "]]": [],
    "{{" + "a|" * 400 + "}}": [],
    "__NOTOC__ text": [],
    "end of it</h2> text": ["heading"],
    "1. one\n2. two": ["list"],
    "* ''one'' [[A]]\n** ''two'' [[B]]": ["list"],
    "<OL>\n<LI>one\n<LI>two\n</OL>": ["list"],
    "\\begin{itemize}\n\\item one\n\\end{itemize}": ["list"],
    "text\n```py\nx = 1\n```": ["code"],
    "text\n~~~\nx < 1\n~~~": ["code"],
    "<pre><code>a &lt; b</code></pre>": ["code"],
    "\\begin{verbatim}\n# not a heading\n\\end{verbatim}": ["code"],
    "where $x_k$ is": ["formula"],
    r"\[ a = \frac{1}{2} \] and": ["formula"],
    r"so \(y_i\) is": ["formula"],
    "<math>a^2</math>": ["formula"],
    "a **bold** word": [],
    "see [there](#x) now": [],
    "A &amp; B": [],
    "| a | b |\n|---|:--:|\n| 1 | 2 |": [],
    "> said\n> more": [],
    "{{note|x=1}}": [],
    "<b>bold": [],
    "end.</div>": [],
}
PLAIN = [
    "Map<String, Integer> and List<Chunk> are both accepted here.",
    "The plan costs $483, or $54 for a year.",
    "Ticket #3 and issue #467 describe the C# client.",
    "67 * 89 * 948 gives the pool size.",
    r"C:\data\SNAPSHOT_MAX\79.log",
    "cat job.txt | sort | uniq -c | head -47",
    "if session_54 == 92 && !FLAG_MAX[0] then stop",
    "~76% of requests -> cache; R&D uses a 16:9 screen & a -19 offset",
    "flatten_MAX_83 is set to {executor_annotate} by default; see [3].",
    "batch (95): α = 0.33, µ = 36, Δ > 0",
    "47. One sentence only. It goes on.",
    "Call __init__ and __main__ before __name__ is set; __FILE__ too.",
    r"C:\Title{abc} and C:\title{abc}",
    "Price $5 and $6 = x$ ok",
    "def f(a, limit=73):\n    return a[b] + 1\nx = y * 2  # note",
    "",
]


@pytest.mark.parametrize("text", MARKED)
def test_structures(text):
    clean, found, marked, _ = markup.clean_markup(text)
    assert marked and found == MARKED[text]
    assert not any(s in clean for s in ("**", "</", "\\begin", "[[", "{{", "&amp;"))


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_stays(text):
    assert markup.clean_markup(text) == (text, [], False, [])


def test_clean_text_keeps_structure():
    clean = markup.clean_markup("<h2>Head</h2><p>Some <b>bold</b> text.</p><ul><li>one</li><li>two</li></ul><pre>x &lt; 1</pre><p>$a_1$</p>")[0]
    assert clean.split("\n") == ["## Head", "", "Some bold text.", "", "- one", "- two", "", "```", "x < 1", "```", "", "$a_1$"]


def test_boilerplate_goes():
    nav = "<div><ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(12)) + "</ul></div>"
    page = f"<html><body>{nav}<div><p>{'The main text is long and has no links at all. ' * 12}</p><p>{'More of it. ' * 20}</p></div></body></html>"
    clean, found, _, gone = markup.clean_markup(page)
    assert "Link 3 - Link 4" in gone[0] and "Link 3" not in clean and "main text" in clean
    assert found == []  # the only list was left out
    two = "<ul><li><a href='/'>Home</a></li><li><a href='/about'>About us</a></li></ul><h2>Head</h2><p>" + "The body paragraph tells all there is to tell. " * 5 + "</p><ul><li>one item</li><li>two</li></ul>"
    clean, found, _, gone = markup.clean_markup(two)
    assert "Home" not in clean and gone == ["- Home - About us"] and "- one item" in clean and found == ["heading", "list"]


@pytest.mark.parametrize("unit", ["<b>", "</b>", "<ul><li>", "<b></i>", "**a", "[[a", "{{a", "\\[", "\\(", "$a ", "$$a\n\n", "[^", "[http://", "\\section[", "\\section{", "''a", "<a href='", " | ", "- a\n", "# a\n", "== a", " ", "\n- a\n\n", "<td>", "`a", "[a](", "&amp", "![a]("])
def test_markup_scans_are_linear(unit):
    import time

    took = []
    for n in (20_000, 80_000):
        text = unit * (n // len(unit)) + "x"
        begin = time.process_time()
        markup.clean_markup(text)
        took.append(time.process_time() - begin)
    assert took[1] < 8 * took[0] + 0.2


def test_extract_text(spark):
    rows = [("a", "# T\ntext"), ("b", None), ("c", ""), ("d", "plain words"), ("a", "# T\ntext"), ("e", "<b>" * 3000 + "deep"), ("f", "long " * 50_000 + "**x**")]
    df = spark.createDataFrame(rows, "chunk_id string, content string").withColumn("clean_text", F.lit(1)).withColumn("structures", F.lit(2)).withColumn("dropped", F.lit(3))
    got = {r["chunk_id"]: r for r in markup.extract_text(df).collect()}
    assert got["b"]["clean_text"] is None and not got["b"]["has_markup"] and got["c"]["clean_text"] == ""
    assert got["d"]["clean_text"] == "plain words" and got["e"]["clean_text"] == "deep" and got["f"]["has_markup"]
    found = sorted(map(tuple, markup.found_structures(markup.extract_text(df)).collect()))
    assert found == [("a", "heading"), ("e", "other"), ("f", "other")]
    assert markup.extract_text(df.limit(0)).count() == 0


# Look-alikes ---------------------------------------------------------------------------------------------------

CLEAN = ["The naïve façade of an open cache copies every page once.", "一个稠密分片通常需要64GB内存，再重启工作线程。", "Über größere Tabellen läuft der Prüflauf nie."]


def disguise(text, rng):
    out = []
    for c in text:
        rows = [r for r in lookalike.ROWS if c in r]
        kind = rng.random()
        if rows and kind < 0.3 and ord(c) < 128:
            out.append(rng.choice(rows[0]))
        elif c == " " and kind < 0.3:
            out.append(rng.choice("\u00a0\u2003\u3000\u2009"))
        elif c.isascii() and c.isalnum() and kind < 0.5:
            out.append(chr(ord(c) + 0xFEE0))
        elif kind < 0.6:
            out.append(unicodedata.normalize("NFD", c) + rng.choice(["", "\u200b", "\u00ad", "\ufeff"]))
        else:
            out.append({"一": "⼀", "度": "\ufa01", "，": ","}.get(c, c))
    return "".join(out)


def model_of(texts):
    from collections import Counter

    tokens = Counter(t for x in texts for t in lookalike.ALPHA.findall(x))
    return lookalike.ScriptModel.of(lookalike.count_bigrams(tokens))


def test_disguised_text_comes_back():
    model, rng = model_of(CLEAN * 50 + ["Привет мир сорока рука нос"]), random.Random(9)
    for text in CLEAN:
        want = lookalike.consistent(text, model)
        for _ in range(40):
            assert lookalike.consistent(disguise(text, rng), model) == want
        assert lookalike.consistent(want, model) == want


@pytest.mark.parametrize("a,b", [("Москва", "Mocквa"), ("ニュース", "二ュース"), ("工", "エ"), ("口", "ロ"), ("卜", "ト"), ("index", "ındex"), ("Page", "Ꮲage"), ("cache", "cacհe"), ("List", "ꓡist"), ("token", "toκen"), ("データ", "デ一タ"), ("人工智能", "人エ智能"), ("HTTP", "НТТР"), ("ΑΒΓ", "ABΓ")])
def test_named_look_alikes(spark, a, b):
    from collections import Counter

    tokens = Counter(t for x in [*CLEAN * 50, "Москва и ква рука", "ΑΒΓ ΑΔΕ"] for t in lookalike.ALPHA.findall(x))
    model = lookalike.ScriptModel.of(lookalike.count_bigrams(tokens), lookalike.confusables(spark))
    assert lookalike.consistent(a, model) == lookalike.consistent(b, model)
    text = " ".join(CLEAN)
    assert lookalike.consistent(f"{text} {a}", model) == lookalike.consistent(f"{text} {b}", model)
    assert lookalike.consistent(text, model) == text.replace("，", ",") and lookalike.consistent("List of pages", model) == "List of pages"


@pytest.mark.parametrize("failing", ["no JVM", "no ICU", "list fails", "list is short"])
def test_unread_confusables_are_an_error(spark, failing):
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    jvm = MagicMock()
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder.return_value.build.return_value
    if failing == "no JVM":
        jvm = None
    elif failing == "no ICU":
        jvm = SimpleNamespace(com=spark._jvm.com.absent)
    elif failing == "list fails":
        checker.getSkeleton.side_effect = OSError("gateway lost")
    else:
        checker.getSkeleton.side_effect = lambda text: "\n".join(text.split("\n")[:-1])
    with pytest.raises(RuntimeError, match="confusables"):
        lookalike.confusables(SimpleNamespace(_jvm=jvm))


def test_visible_differences_stay():
    model = model_of(CLEAN)
    for a, b in (("Cafe", "café"), ("abc", "ABC"), ("a b", "a\nb"), ("x2", "x²"), ("a b", "a  b"), ("日", "目")):
        assert lookalike.consistent(a, model) != lookalike.consistent(b, model)
    russian = "Привет мир, сорока нос руку"
    assert lookalike.consistent(russian, model_of(CLEAN * 3 + [russian] * 60)) == russian


def test_viterbi_equals_all_readings():
    import itertools

    model = model_of(CLEAN * 5 + ["рука мир нос"])
    for token in ("cope", "Ехо", "нос"):
        def cost(path):
            return sum(model.cost(a, b) for a, b in zip("^" + "".join(path), "".join(path) + "$"))

        best = min(itertools.product(*[lookalike.CLASS.get(c, [c]) for c in token]), key=cost)
        assert cost(model.decode(token)) == pytest.approx(cost(best))


def test_lookalike_pairs(spark):
    rng, long = random.Random(4), " ".join(CLEAN) * 3
    odd = [long.replace("a", "а", 3), long.replace(" ", "\u3000", 2)]
    rows = [("a", long, "x"), ("b", odd[0], "x"), ("c", odd[1], None), ("c", odd[1], None), ("d", long, "х"), ("e", "short", "х"), ("f", None, "x"), ("g", "", ""), (None, long, "x"), ("h", long + "!", "y")]
    df = spark.createDataFrame(rows, "chunk_id string, content string, content_jieba string").withColumn("form", F.lit(1)).withColumn("raw", F.lit(1))
    groups = lookalike.lookalike_groups(df, "chunk_id", ["content", "content_jieba"], "content", 300)
    got = sorted(map(tuple, lookalike.lookalike_pairs(groups).collect()))
    assert got == [("content", "a", "b"), ("content", "a", "c"), ("content", "b", "c"), ("content", "b", "d"), ("content", "c", "d"), ("content_jieba", "a", "d"), ("content_jieba", "b", "d")]
    forms = lookalike.unify(df.select("chunk_id", "content"), ["content"]).collect()
    assert {r["content_form"] for r in forms if r["chunk_id"] == "f"} == {None}
    with pytest.raises(ValueError):
        lookalike.unify(df.withColumn("content_form", F.lit(1)), ["content"])
    assert lookalike.lookalike_groups(df.limit(0), "chunk_id", ["content"], "content", 300).count() == 0
    assert rng


# Near duplicates -----------------------------------------------------------------------------------------------


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        base = rng.choices(words, k=rng.randint(60, 120))
        rows.append((f"r{i:03}", " ".join(base)))
        for k in range(rng.choice([0, 0, 1, 3])):
            edited = list(base)
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(edited))
                edited[at : at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
            rows.append((f"r{i:03}_{k}", ("  " if k else "") + " ".join(edited).replace("a", "А" if k == 2 else "a", 1)))
    return rows


def exact(rows, model, width=7, least=300, threshold=0.75):
    sets = {}
    for i, t in rows:
        t = neardup.normal(t, model)
        if len(t) >= least:
            sets[i] = {t[k : k + width] for k in range(len(t) - width + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > threshold}


@pytest.mark.parametrize("bucket", [64, 1])
def test_pairs_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(neardup, "JOIN_BUCKET", bucket)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rows = corpus(1, 50)
    df = spark.createDataFrame([*rows, rows[0], ("n", None), ("e", ""), (None, rows[0][1])], "chunk_id string, content string").withColumn("text_id", F.lit(1)).withColumn("keys", F.lit(1))
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()}
    assert got == exact(rows, model_of([t for _, t in rows]))
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0


def test_groups(spark):
    rows = corpus(2, 30)
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    pairs = exact(rows, model_of([t for _, t in rows]))
    group = {r["chunk_id"]: r["group_id"] for r in neardup.near_duplicate_groups(df).collect()}
    assert all(group[a] == group[b] for a, b in pairs)
    assert len(set(group.values())) > 20


def test_registers():
    rng = np.random.default_rng(3)
    errors = []
    for j in (0.2, 0.5, 0.75, 0.95):
        for _ in range(10):
            h = rng.integers(0, 2**63, 2000, dtype=np.uint64)
            both = int(2000 * 2 * j / (1 + j))
            a, b = h[:2000], np.concatenate([h[:both], rng.integers(0, 2**63, 2000 - both, dtype=np.uint64)])
            errors.append(float(neardup.estimate(neardup.sketch(a), neardup.sketch(b))) - j)
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.12
    assert neardup.sketch(np.arange(1, dtype=np.uint64)).shape == (neardup.BUCKETS,)


# Vectors -------------------------------------------------------------------------------------------------------


def vectors(n, dim=64, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    return (centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.1, 0.3, 0.9], (n, 1))) * rng.uniform(0.2, 9, (n, 1))


def test_similar_pairs_against_brute_force(spark):
    x = vectors(1500)
    rows = [(f"v{i:04}", v.tolist()) for i, v in enumerate(x)] + [("w1", x[0].tolist()), ("w2", x[0].tolist()), ("v0001", None), ("z0", [0.0] * 64), ("z1", [1.0] * 63), ("z2", [float("nan")] * 64), ("z3", None), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "chunk_id string, content_vector array<double>").withColumn("vec", F.lit(1)).withColumn("leaf", F.lit(1))
    ids = [r[0] for r in rows[:1502]]
    u = np.array([r[1] for r in rows[:1502]], dtype=np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    want = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:5]:
            if s[i, j] >= 0.9:
                want.add(tuple(sorted((ids[i], ids[j]))))
    got = {tuple(r) for r in knntree.similar_pairs(df).collect()}
    assert len(want) > 500
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)
    assert knntree.similar_pairs(df.where("content_vector is null")).count() == 0


@pytest.mark.parametrize("n,leaf_rows,cells", [(10_000, 17, (10**6, 10**6)), (2500, 900, (70, 110))])
def test_recall_of_a_deep_tree_and_of_cut_leaves(spark, n, leaf_rows, cells):
    x = vectors(n, 16, 6)
    df = spark.createDataFrame([(f"v{i:05}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, content_vector array<double>")
    ix = knntree.Index(df, dim=16, leaf_rows=leaf_rows, cell_rows=cells[0], cell_queries=cells[1])
    assert ix.tree.leaves >= (500 if n > 2500 else 3)
    vids, q = ix._sample(3, 200)
    true = {(r["q"], r["b"]) for r in ix.brute_force(vids, q).collect()}
    asked = ix.units.where(F.col("vid").isin([int(v) for v in vids]))
    how = ix.calibrate(0.97)
    found = {(r["q"], r["b"]) for r in ix.search(*how, queries=asked).collect()}
    assert len(true & found) / len(true) >= 0.95
    if n > 2500:
        return
    every = ix.search(*how).where(F.col("q").isin([int(v) for v in vids])).collect()
    assert len(true & {(r["q"], r["b"]) for r in every}) / len(true) >= 0.95
    assert len(every) == len({(r["q"], r["b"]) for r in every}) == 5 * len(vids)


def test_nearest_is_exact_in_one_leaf(spark):
    x = vectors(400, 64, 8)
    x[7] = x[3]
    df = spark.createDataFrame([(f"v{i:03}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, content_vector array<double>")
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    got = {(r["id"], r["position"]): (r["neighbour"], round(r["cosine"], 5)) for r in knntree.nearest(df, df.where("chunk_id < 'v020'")).collect()}
    for i in range(20):
        order = [j for j in sorted(range(400), key=lambda j: (-s[i, j], j)) if j != i][:5]
        assert [got[f"v{i:03}", p + 1][0] for p in range(5)] == [f"v{j:03}" for j in order]
    assert len(got) == 100


def test_hot_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(knntree, "HOT", 3)
    x = vectors(60, 64, 9)
    rows = [(f"c{i:02}", x[0].tolist()) for i in range(20)] + [(f"v{i:02}", v.tolist()) for i, v in enumerate(x[1:])]
    got = {tuple(r) for r in knntree.similar_pairs(spark.createDataFrame(rows, "chunk_id string, content_vector array<double>")).collect()}
    for i in range(20):
        first = [j for j in range(20) if j != i][:5]
        assert {tuple(sorted((f"c{i:02}", f"c{j:02}"))) for j in first} <= got


def test_tree_visits_every_leaf_once():
    x = vectors(600, 8, 7).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = knntree.fit_tree(x, 20)
    order, far = knntree.visit(tree, x[:50], tree.leaves)
    assert (np.sort(order, axis=1) == np.arange(tree.leaves)).all() and (far >= -1e-5).all()
    assert (knntree.visit(tree, x[:50], 3)[0] == order[:, :3]).all()
