"""Text splitters: one document gives n chunks."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import chunk_level, md5_id, strip, words
from marlstone.operators.prefix import running_totals
from marlstone.operators.skew import hot_keys, salted_join

SENTENCE_END = r"[.!?。！？]+"
CLAUSE = re.compile(r"[^,.;。？！]+[,.;。？！]?")
SEPARATORS = ("\n\n", "\n", " ", "")


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("chunk_overlap must be at least 0 and less than chunk_size")


def split_words(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0, keep: list[str] | None = None) -> DataFrame:
    """(id, chunk_index, chunk): windows of size words, each starting size - overlap words later. In the JVM."""
    check_sizes(size, overlap)
    kept = [c for c in keep or [] if c not in (id_col, "chunk_index", "chunk")]
    src = df.select(F.col(id_col), words(F.col(text_col)).alias("__w"), *kept).where(F.size("__w") > 0)
    starts = F.sequence(F.lit(0), F.size("__w") - 1, F.lit(size - overlap))
    each = src.select(id_col, "__w", *kept, F.posexplode(starts).alias("chunk_index", "__at"))
    return each.select(id_col, "chunk_index", F.array_join(F.slice("__w", F.col("__at") + 1, F.lit(size)), " ").alias("chunk"), *kept)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


def sentence_chunks(text: str, size: int) -> list[str]:
    """Sentences packed until the next would pass size, joined by one space; the spaces aren't counted for the next."""
    out: list[str] = []
    run: list[str] = []
    total = 0
    for x in sentence_list(text):
        if run and total + len(x) > size:
            out.append(" ".join(run))
            run, total = [], 0
        total += len(x) + (1 if run else 0)
        run.append(x)
    return [*out, " ".join(run)] if run else out


def split_sentences(df: DataFrame, id_col: str, text_col: str, size: int, keep: list[str] | None = None) -> DataFrame:
    """(id, chunk_index, chunk, keep): sentences packed until the next would pass size, joined by one space.

    Each text is packed in one pass where it is; no shuffle, and documents that share an id stay apart.
    """
    check_sizes(size, 0)
    return split_with(df, id_col, text_col, lambda t: sentence_chunks(t, size), keep)


def character_chunks(text: str, size: int, overlap: int = 0) -> list[str]:
    """Windows of size characters that end after their last line break, else after their last space."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = text.rfind("\n", at, end)
            if cut < 0:
                cut = text.rfind(" ", at, end)
            end = cut + 1 if cut >= 0 else end
        piece = text[at:end].strip()
        if piece:
            out.append(piece)
        at = max(at + 1, end - overlap)
    return out


def recursive_chunks(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS, keep_separator: bool = True) -> list[str]:
    """Cut at the first separator the text holds, again inside pieces that are too long, and merge up to size."""
    sep = next((s for s in separators if s == "" or s in text), "")
    later = separators[separators.index(sep) + 1 :] if sep in separators else ()
    if sep == "":
        parts = list(text)
    elif keep_separator:
        first, *more = text.split(sep)
        parts = [p for p in [first, *(sep + m for m in more)] if p]
    else:
        parts = [p for p in text.split(sep) if p]
    glue = "" if keep_separator or not sep else sep
    out: list[str] = []
    run: list[str] = []
    total = 0

    def flush() -> None:
        if run and (joined := glue.join(run).strip()):
            out.append(joined)

    for p in parts:
        if len(p) > size and later:
            flush()
            run, total = [], 0
            out += recursive_chunks(p, size, overlap, later, keep_separator)
            continue
        if run and total + len(p) + len(glue) > size:
            flush()
            while run and (total > overlap or total + len(p) + len(glue) > size):
                total -= len(run.pop(0)) + len(glue)
            total = max(total, 0)
        run.append(p)
        total += len(p) + len(glue)
    flush()
    return out


def sentence_list(text: str) -> list[str]:
    return [s for s in map(str.strip, re.split(SENTENCE_END, text)) if s]


def overlap_share(a: str, b: str) -> float:
    """Jaccard index of the lower-case words of two texts; 1 without words."""
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 1.0


def semantic_chunks(text: str, size: int, threshold: float, overlap: int = 0, max_size: int | None = None, similar: Callable[[str, str], float] = overlap_share, most_sentences: int = 1000) -> list[str]:
    """Sentences joined while the chunk stays within size and the next sentence is similar to it."""
    max_size = max_size or 2 * size
    s = sentence_list(text)
    if sum(map(len, s)) <= size:
        return [text]
    if len(s) > most_sentences or max(map(len, s)) > max_size:
        return character_chunks(text, size, overlap)
    if len(s) <= 1:
        return [text]
    out, run = [], s[0]
    for x in s[1:]:
        if len(run) + 1 + len(x) <= size and similar(run, x) >= threshold:
            run += " " + x
        else:
            out.append(run)
            run = x
    return [*out, run]


def token_count(text: str) -> int:
    """Default tokenizer of the sentence splitter: words of spaced scripts, single CJK characters, signs."""
    return len(TOKENS.findall(text))


TOKENS = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]+|[^\w\s]")
SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？\n]+\s*|[^.!?。！？\n]+$")


def _pieces(text: str, size: int, separator: str, paragraph: str, tokens: Callable[[str], int]) -> list[tuple[str, bool, int]]:
    n = tokens(text)
    if n <= size:
        return [(text, True, n)]
    keep = lambda sep: [p for p in re.split(f"(?<={re.escape(sep)})", text) if p] if sep in text else [text]
    for whole, cut in ((True, lambda: keep(paragraph)), (True, lambda: SENTENCE.findall(text)), (False, lambda: CLAUSE.findall(text)), (False, lambda: keep(separator)), (False, lambda: list(text))):
        parts = cut()
        if len(parts) > 1:
            break
    out: list[tuple[str, bool, int]] = []
    for p in parts:
        m = tokens(p)
        if m <= size:
            out.append((p, whole, m))
        elif len(p) > 1:
            out += _pieces(p, size, separator, paragraph, tokens)
        else:
            raise ValueError("a single character has more tokens than chunk_size")
    return out


def token_chunks(text: str, size: int = 1024, overlap: int = 200, separator: str = " ", paragraph: str = "\n\n\n", tokens: Callable[[str], int] = token_count) -> list[str]:
    """Sentences packed up to size tokens; a chunk begins with the last pieces of the one before within overlap."""
    if overlap > size:
        raise ValueError("chunk_overlap must not exceed chunk_size")
    out: list[str] = []
    run: list[tuple[str, int]] = []
    total, fresh = 0, True
    todo = _pieces(text, size, separator, paragraph, tokens) if text else []
    i = 0
    while i < len(todo):
        piece, _, n = todo[i]
        if not fresh and total + n > size:
            out.append("".join(p for p, _ in run))
            tail: list[tuple[str, int]] = []
            total = 0
            for p in reversed(run):
                if total + p[1] > overlap:
                    break
                tail.insert(0, p)
                total += p[1]
            run, fresh = tail, True
            continue
        run.append((piece, n))
        total += n
        fresh = False
        i += 1
    if not fresh:
        out.append("".join(p for p, _ in run))
    return [c for c in map(str.strip, out) if c]


def embedding_similarity(embed: Callable[[str], list[float]], fallback: Callable[[str, str], float] = overlap_share) -> Callable[[str, str], float]:
    """Similarity for split_semantic: cosine of two texts' vectors; 0 for vectors of different or no length, the fallback where embed fails."""

    def similar(a: str, b: str) -> float:
        try:
            x, y = embed(a), embed(b)
        except Exception:
            return fallback(a, b)
        if len(x) != len(y):
            return 0.0
        size = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
        return sum(p * q for p, q in zip(x, y)) / size if size else 0.0

    return similar


def split_with(df: DataFrame, id_col: str, text_col: str, cut: Callable[[str], list[str]], keep: list[str] | None = None, method: str | None = None) -> DataFrame:
    """(id, chunk_index, chunk, keep) by a Python splitter, where the rows are; empty and NULL texts give no rows.

    keep names columns of df that every chunk of a row carries, as they are; method adds a column split_method.
    """
    kept = [c for c in keep or [] if c not in (id_col, "chunk_index", "chunk")]
    src = df.where(F.length(text_col) > 0).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, nos, chunks = [], [], []
            for r, t in enumerate(b.column("__text").to_pylist()):
                for k, c in enumerate(cut(t)):
                    rows.append(r)
                    nos.append(k)
                    chunks.append(c)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("__id").take(at), pa.array(nos, pa.int32()), pa.array(chunks, pa.string()), *[b.column(c).take(at) for c in kept]], ["__id", "chunk_index", "chunk", *kept])

    schema = T.StructType([src.schema["__id"], T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk", T.StringType()), *[src.schema[c] for c in kept]])
    out = src.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
    return out.withColumn("split_method", F.lit(method)) if method else out


def split_characters(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0, keep: list[str] | None = None) -> DataFrame:
    check_sizes(size, overlap)
    return split_with(df, id_col, text_col, lambda t: character_chunks(t, size, overlap), keep)


def split_recursive(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS, keep_separator: bool = True, keep: list[str] | None = None) -> DataFrame:
    check_sizes(size, overlap)
    return split_with(df, id_col, text_col, lambda t: recursive_chunks(t, size, overlap, separators, keep_separator), keep)


def split_semantic(df: DataFrame, id_col: str, text_col: str, size: int, threshold: float = 0.5, overlap: int = 0, min_size: int = 1, max_size: int | None = None, similar: Callable[[str, str], float] = overlap_share, keep: list[str] | None = None, most_sentences: int = 1000) -> DataFrame:
    """Texts of more than most_sentences sentences, or with one above max_size, are cut into character windows."""
    check_sizes(size, overlap)
    if not 0 <= threshold <= 1:
        raise ValueError("similarity_threshold must be between 0 and 1")
    if not 0 < min_size < size:
        raise ValueError("min_chunk_size must be positive and less than chunk_size")
    return split_with(df, id_col, text_col, lambda t: semantic_chunks(t, size, threshold, overlap, max_size, similar, most_sentences), keep)


def split_tokens(df: DataFrame, id_col: str, text_col: str, size: int = 1024, overlap: int = 200, keep: list[str] | None = None, **how: object) -> DataFrame:
    """Columns in keep go along and don't count into size: the metadata-aware form has the same chunks."""
    check_sizes(size, overlap)
    return split_with(df, id_col, text_col, lambda t: token_chunks(t, size, overlap, **how), keep)


def hierarchy_tree(text: str, sizes: list[int], overlap: int) -> list[tuple[int, int | None, str]]:
    """(depth, number of the parent, text) of all nodes in breadth-first order; each level cuts the nodes of the level before."""
    out: list[tuple[int, int | None, str]] = []
    level: list[tuple[int | None, str]] = [(None, text)]
    for depth, s in enumerate(sizes):
        below = []
        for parent, t in level:
            for c in token_chunks(t, s, overlap):
                below.append((len(out), c))
                out.append((depth, parent, c))
        level = below
    return out


def hierarchy_nodes(text: str, sizes: list[int], overlap: int) -> list[str]:
    """Texts of all levels in breadth-first order."""
    return [t for _, _, t in hierarchy_tree(text, sizes, overlap)]


def parse_hierarchy(df: DataFrame, id_col: str, text_col: str, sizes: list[int] | None = None, overlap: int = 20, keep: list[str] | None = None) -> DataFrame:
    """(id, node_id, parent_id, prev_id, next_id, depth, content, keep): nodes of all levels with their links.

    node_id is made of the text's hash and the node's number; prev and next are neighbours of the same depth. A
    node of depth 0 has no parent. Empty and NULL texts give no rows.
    """
    sizes = sizes or [2048, 512, 128]
    if min(sizes) <= 0 or not 0 <= overlap < min(sizes):
        raise ValueError("chunk_sizes must be positive and overlap at least 0 and less than the smallest")

    def cut(text: str) -> list[str]:
        nodes = hierarchy_tree(text, sizes, overlap)
        last: dict[int, int] = {}
        near: list[list[int | None]] = [[None, None] for _ in nodes]
        for i, (d, _, _) in enumerate(nodes):
            if d in last:
                near[i][0], near[last[d]][1] = last[d], i
            last[d] = i
        return [json.dumps([d, p, *near[i], t]) for i, (d, p, t) in enumerate(nodes)]

    at = split_with(df.withColumn("__root", md5_id(F.col(text_col))), id_col, text_col, cut, ["__root", *(keep or [])])
    got = F.from_json("chunk", "array<string>")
    name = lambda n: F.when(n.isNotNull(), F.concat(F.col("__root"), F.lit("_n"), n))
    return at.withColumn("__n", got).select(id_col, name(F.col("chunk_index").cast("string")).alias("node_id"), *[name(F.col("__n")[i]).alias(c) for i, c in ((1, "parent_id"), (2, "prev_id"), (3, "next_id"))], F.col("__n")[0].cast("int").alias("depth"), F.col("__n")[4].alias("content"), *(keep or []))


def piece_of(pieces: list[tuple[str, int, str]], at: int, text: str) -> str:
    """Id of the first piece (id, start, text) that contains the text, else of the one that shares most with it at its place."""
    whole = next((i for i, _, p in pieces if text in p), None)
    shared = lambda x: -1 if at < 0 or x[1] < 0 else min(at + len(text), x[1] + len(x[2])) - max(at, x[1])
    return whole or max(pieces, key=shared)[0]


#: Characters by which the places of a text in the texts of the level above are looked up.
ANCHOR = 12


def first_holders(texts: list[str], above: list[str]) -> list[int | None]:
    """For each text the number of the first of above that contains it.

    One pass over above notes where the first characters of the texts stand; only those places are compared.
    """
    starts: dict[str, list[tuple[int, int]]] = {t[:ANCHOR]: [] for t in texts if len(t) >= ANCHOR}
    if starts:
        for j, p in enumerate(above):
            for i in range(len(p) - ANCHOR + 1):
                places = starts.get(p[i : i + ANCHOR])
                if places is not None:
                    places.append((j, i))
    return [next((j for j, i in starts[t[:ANCHOR]] if above[j].startswith(t, i)), None) if len(t) >= ANCHOR else next((j for j, p in enumerate(above) if t in p), None) for t in texts]


def split_hierarchy(df: DataFrame, id_col: str, text_col: str, sizes: list[int] | None = None, overlap: int = 50, max_size: int | None = None, fallback: Callable[[str], list[str]] | None = None, second: Callable[[str], list[str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Chunks of all levels with chunk_id, parent_id, root_id, chunk_index, total_chunks, chunk_size, split_method, chunk_level, text_length, truncated, content.

    Level by length of the text, ids by position inside the level, the parent the first chunk of the level
    above whose text contains the chunk. Chunks above max_size are cut again by the fallback (character
    windows of max_size by default), what is still too long by the second splitter if there is one, and what is
    too long even then by fixed windows of min(300, max_size // 2). The pieces of chunk x are x_p0, x_p1 and so on, with lengths
    of their own, after the other chunks; a chunk below x has the piece that holds it, or most of it, as parent. chunk_index numbers
    the rows of a document, total_chunks is their number. keep names columns that every chunk carries.
    A document is handled by one task where it is; documents are not shuffled.
    """
    sizes = sizes or [512, 256]
    if not sizes or min(sizes) <= 0 or not 0 <= overlap < min(sizes):
        raise ValueError("chunk_sizes must be positive and overlap at least 0 and less than the smallest")
    ordered, limit = sorted(sizes, reverse=True), max_size or 2 * max(sizes)
    primary = fallback or (lambda t: character_chunks(t, limit, overlap))

    def level_of(n: int) -> int:
        return next((k for k, s in enumerate(ordered[:-1]) if n >= s * 0.8), len(ordered) - 1)

    def cut_again(t: str) -> Iterator[tuple[str, str, bool]]:
        step = max(1, min(300, limit // 2))
        for c in primary(t):
            for d, method in [(c, "hierarchical+text")] if len(c) <= limit or second is None else [(x, "hierarchical+second") for x in second(c)]:
                if len(d) <= limit:
                    yield d, method, False
                else:
                    yield from ((d[k : k + step], "hierarchical+emergency_truncation", True) for k in range(0, len(d), step))

    def chunks(root: str, text: str) -> list[tuple]:
        levels: dict[int, list[str]] = {}
        for t in hierarchy_nodes(text, ordered, overlap):
            levels.setdefault(level_of(len(t)), []).append(t)
        rows, late = [], []
        pieces: dict[tuple[int, int], list[tuple[str, int, str]]] = {}
        for lv in sorted(levels):
            above = levels.get(lv - 1, []) if lv else []

            def parent_id(j: int | None, t: str, lv: int = lv, above: list[str] = above) -> str | None:
                if j is None:
                    return None
                if not pieces.get((lv - 1, j)):
                    return f"{root}_L{lv - 1}_{j}"
                return piece_of(pieces[lv - 1, j], above[j].find(t), t)

            for i, (t, parent) in enumerate(zip(levels[lv], first_holders(levels[lv], above))):
                name = f"{root}_L{lv}_{i}"
                if len(t) <= limit:
                    rows.append((name, parent_id(parent, t), "hierarchical", lv, False, t))
                    continue
                own, at = pieces.setdefault((lv, i), []), 0
                for c, method, truncated in cut_again(t):
                    found = t.find(c, at)
                    at = max(at, found)
                    own.append((f"{name}_p{len(own)}", found, c))
                    late.append((own[-1][0], parent_id(parent, c), method, lv, truncated, c))
        rows += late
        return [(n, p, root, k, len(rows), sizes, m, lv, len(t), cut, t) for k, (n, p, m, lv, cut, t) in enumerate(rows)]

    kept = [c for c in keep or [] if c not in (id_col, *CHUNK_COLUMNS)]
    src = df.where(F.length(text_col) > 0).select(F.col(id_col).alias("__id"), md5_id(F.col(text_col)).alias("__root"), F.col(text_col).alias("__text"), *kept)
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for r, (root, text) in enumerate(zip(b.column("__root").to_pylist(), b.column("__text").to_pylist())):
                own = chunks(root, text)
                at += [r] * len(own)
                rows += own
            take = pa.array(at, pa.int64())
            columns = [pa.array([x[i] for x in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("__id").take(take), *columns, *[b.column(c).take(take) for c in kept]], ["__id", *CHUNK_COLUMNS, *kept])

    string, integer = T.StringType(), T.IntegerType()
    kinds = [string, string, string, integer, integer, T.ArrayType(integer), string, integer, integer, T.BooleanType(), string]
    schema = T.StructType([src.schema["__id"], *[T.StructField(c, t) for c, t in zip(CHUNK_COLUMNS, kinds)], *[src.schema[c] for c in kept]])
    return src.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


CHUNK_COLUMNS = ["chunk_id", "parent_id", "root_id", "chunk_index", "total_chunks", "chunk_size", "split_method", "chunk_level", "text_length", "truncated", "content"]


def assign_levels(chunks: DataFrame, sizes: list[int], doc: str = "root_id", order: str = "chunk_index", text: str = "content") -> DataFrame:
    """chunks without their text, with level (by its length) and position (inside document and level).

    Positions are numbered by range, so a document of any number of chunks is spread over tasks.
    """
    out = chunks.withColumn("level", chunk_level(F.length(text), sizes)).drop(text)
    return running_totals(out, [doc, "level"], [order, "chunk_id"], {"position": F.lit(1)}).withColumn("position", F.col("position") - 1)


#: Chunks of one root above which they are spread over several tasks.
LARGE_ROOT = 2000


def find_parents(chunks: DataFrame, root: str = "root_id", level: str = "chunk_level", order: str = "chunk_index", id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(id, found_parent): the first chunk of the level above, in the same root, whose text contains the chunk.

    Chunks without such a parent, root, level or text give no row. The chunks of a large root are spread over
    tasks, each of which meets the chunks above them.
    """
    c = chunks.where(F.col(root).isNotNull() & F.col(level).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(root).alias("__r"), F.col(level).alias("__l"), F.col(order).alias("__o"), F.col(text_col).alias("__t"))
    above = c.select("__r", (F.col("__l") + 1).alias("__l"), F.col("__id").alias("__p"), F.col("__o").alias("__po"), F.col("__t").alias("__big"))
    hot = hot_keys(c.groupBy("__r", "__l").agg(F.count("*").alias("n")), ["__r", "__l"], "n", LARGE_ROOT)
    pairs = salted_join(c.drop("__o"), above, ["__r", "__l"], hot, F.col("__id")).where(F.contains("__big", F.col("__t")))
    best = F.min_by("__p", F.struct(F.coalesce("__po", F.lit(2**31 - 1)), "__p"))
    return pairs.groupBy("__id").agg(best.alias("found_parent")).withColumnRenamed("__id", id_col)


def node_headers(df: DataFrame, id_col: str, text_col: str, headers: str = "heading_path") -> DataFrame:
    """(id, node_type, header_text, parent_headers): header nodes are those whose text begins with #."""
    head = F.startswith(F.col(text_col), F.lit("#"))
    path = F.col(headers) if headers in df.columns else F.array().cast("array<string>")
    return df.select(id_col, F.when(head, "header").otherwise("text").alias("node_type"), F.when(head, strip(F.regexp_replace(F.split(text_col, "\n")[0], r"^#+", ""))).alias("header_text"), path.alias("parent_headers"))


def leaves(nodes: DataFrame, id_col: str = "chunk_id", parent: str = "parent_id") -> DataFrame:
    """Nodes that are nobody's parent."""
    return nodes.join(nodes.select(F.col(parent).alias("__p")).where("__p IS NOT NULL").distinct(), F.col(id_col) == F.col("__p"), "left_anti")


def roots(nodes: DataFrame, parent: str = "parent_id") -> DataFrame:
    return nodes.where(F.col(parent).isNull())


def children_of(nodes: DataFrame, of: DataFrame, id_col: str = "chunk_id", parent: str = "parent_id") -> DataFrame:
    return nodes.join(of.select(F.col(id_col).alias("__p")).distinct(), F.col(parent) == F.col("__p"), "left_semi")


def at_depth(nodes: DataFrame, depth: int, id_col: str = "chunk_id", parent: str = "parent_id") -> DataFrame:
    """Nodes depth steps below a root; one join per step, at most as many as there are sizes."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    out = roots(nodes, parent)
    for _ in range(depth):
        out = children_of(nodes, out, id_col, parent)
    return out
