"""Analyzers and scalar text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode-aware white space at both ends, as Python's strip removes it.
EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def words(c: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def analyze_plain(c: Column) -> Column:
    """Lower case, signs to blanks, tokens of two characters or more."""
    flat = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(flat, r"\s+"), lambda x: F.length(x) > 1)


def analyze_bigrams(c: Column) -> Column:
    """As analyze_plain, with every CJK run in overlapping pairs, so unspaced text can be searched."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(c), r"([㐀-鿿]+)", " $1 "), r"[^\p{L}\p{N}_\s]", " ")
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    tokens = F.filter(F.split(spaced, r"\s+"), lambda x: F.length(x) > 1)
    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike(r"^[㐀-鿿]{3,}$"), pairs(t)).otherwise(F.array(t))))


def analyze_segmented(c: Column) -> Column:
    """Tokens of text that is segmented already: lower case, two characters or more, no bare punctuation."""
    return F.filter(words(F.lower(c)), lambda x: (F.length(x) > 1) & ~x.rlike(r"^\p{Punct}+$"))


ANALYZERS: dict[str, Callable[[Column], Column]] = {"plain": analyze_plain, "bigrams": analyze_bigrams, "segmented": analyze_segmented}


def dictionary_analyzer(words: list[str], mode: str = "smart", most: int = 20_000) -> Callable[[Column], Column]:
    """An analyzer that knows words of unspaced text; other text is read as analyze_plain reads it.

    smart takes the longest word at each place and goes on after it; max_word gives every word at every place.
    Neither lower-cases nor keeps single characters. The words (at most `most`) become one pattern.
    """
    known = sorted({w for w in words if len(w) > 1}, key=lambda w: (-len(w), w))
    if len(known) > most:
        raise ValueError(f"more than {most} words")
    if mode not in ("smart", "max_word"):
        raise ValueError(f"unknown mode {mode!r}")
    listed = "|".join(re.escape(w) for w in known) or r"(?!)"
    rest = r"[\p{L}\p{N}_&&[^一-鿿]]+|[一-鿿]"
    sizes = sorted({len(w) for w in known})

    def smart(c: Column) -> Column:
        return F.filter(F.regexp_extract_all(c, F.lit(f"({listed}|{rest})"), 1), lambda t: F.length(t) > 1)

    def every(c: Column) -> Column:
        held = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
        at = lambda i, n: F.substring(c, i, F.lit(n))
        found = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.filter(F.array(*[at(i, n) for n in sizes]), lambda w: F.array_contains(held, w))))
        other = F.filter(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_&&[^一-鿿]]+)"), 1), lambda t: F.length(t) > 1)
        return F.concat(found if known else F.array().cast("array<string>"), other)

    return smart if mode == "smart" else every


def register_analyzer(name: str, analyzer: Callable[[Column], Column]) -> None:
    """Make an analyzer known by name to indexes, queries and pipelines."""
    ANALYZERS[name] = analyzer


def preprocess(c: Column, analyzer: str = "plain") -> Column:
    """Tokens joined by spaces, for a pre-segmented field."""
    return F.array_join(ANALYZERS[analyzer](c), " ")


def clean_corpus(c: Column) -> Column:
    """Letters, digits, underscores and CJK only; runs of white space one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s一-鿿]", ""), r"\s+", " "))


def tagged_output(c: Column) -> Column:
    """What stands between <output> tags; the stripped text where there are none."""
    return F.when(c.rlike(r"(?s)<output>.*?</output>"), strip(F.regexp_extract(c, r"(?s)<output>(.*?)</output>", 1))).otherwise(strip(c))


def rank_list(c: Column) -> Column:
    """0-based positions of a list such as [1, 3, 2]; NULL without one."""
    body = F.regexp_extract(c, r"\[([\d,\s]+)\]", 1)
    return F.when(body != "", F.transform(F.filter(F.split(body, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("int") - 1))


def first_number(c: Column) -> Column:
    """The first number in a text, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\d+(\.\d+)?", 0), F.lit("")).try_cast("double"), F.lit(0.0))


def mark_terms(content: Column, terms: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """content with every occurrence of a term (array of plain terms) between <mark> tags, longest first."""
    quoted = F.transform(F.array_sort(F.array_distinct(terms), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)), lambda t: F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    return F.when(F.size(terms) > 0, F.regexp_replace(content, F.concat(F.lit("(?iu)("), F.array_join(quoted, "|"), F.lit(")")), F.lit(f"{before}$1{after}"))).otherwise(content)


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard index of the lower-case words of two texts; 1 without words."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    either = F.size(F.array_union(x, y))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / either)


def marked_terms(c: Column) -> Column:
    """Distinct lower-case terms between <mark> tags, in order of the alphabet."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<mark>(.*?)</mark>"), 1), lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_]", ""))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: t != "")))


def relevant_terms(found: Column, query_terms: Column) -> Column:
    """Found terms that hold a query term or are held by one."""
    return F.filter(found, lambda t: F.exists(query_terms, lambda q: F.contains(q, t) | F.contains(t, q)))


def fragments(marked: Column, size: int = 150, number: int = 3, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The first windows of size signs that hold a mark; a marked term counts as one sign and stays whole."""
    parts = F.regexp_extract_all(marked, F.lit(rf"(?s)(?:{re.escape(before)}.*?{re.escape(after)}|.){{1,{size}}}"), 0)
    return F.slice(F.filter(parts, lambda p: F.contains(p, F.lit(before))), 1, number)


# How fields are highlighted unless they say otherwise.
HIGHLIGHT = {"fragment_size": 150, "number_of_fragments": 3, "pre_tags": ["<mark>"], "post_tags": ["</mark>"]}


def highlight(fields: dict[str, dict], terms: Column, defaults: dict | None = None) -> Column:
    """A map from each field to its fragments; a field's settings go over the defaults. number_of_fragments 0 gives the whole field."""
    parts: list[Column] = []
    for name, own in fields.items():
        how = HIGHLIGHT | (defaults or {}) | own
        tags = how["pre_tags"][0], how["post_tags"][0]
        marked = mark_terms(F.coalesce(F.col(name), F.lit("")), terms, *tags)
        parts += [F.lit(name), fragments(marked, how["fragment_size"], how["number_of_fragments"], *tags) if how["number_of_fragments"] else F.array(marked)]
    return F.map_filter(F.create_map(*parts), lambda _, v: F.size(v) > 0)


def preview(c: Column, size: int = 200) -> Column:
    return F.concat(F.substring(c, 1, size), F.lit("..."))


def title(filename: Column, source: Column, id_: Column) -> Column:
    """File name, else the last part of the source, else a name made of the id."""
    return F.coalesce(F.nullif(filename, F.lit("")), F.nullif(F.element_at(F.split(source, "/"), -1), F.lit("")), F.concat(F.lit("文档-"), F.coalesce(id_.cast("string"), F.lit("N/A"))))


def md5_id(c: Column, size: int = 16) -> Column:
    return F.substring(F.md5(c), 1, size)


def chunk_level(length: Column, sizes: list[int]) -> Column:
    """Level by length: the first size of which the text has 80 percent, else the last level."""
    ordered = sorted(sizes, reverse=True)
    out = F.lit(len(ordered) - 1)
    for level in range(len(ordered) - 2, -1, -1):
        out = F.when(length >= ordered[level] * 0.8, F.lit(level)).otherwise(out)
    return out.cast("int")


def html_to_text(c: Column) -> Column:
    """Text of an HTML page by expressions only: scripts and tags removed, blocks on lines, entities resolved."""
    t = F.regexp_replace(c, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/section|/article)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))
