"""Text quality statistics and line labels by a hidden Markov model (problem 9)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import materialize, spread

KINDS = ["prose", "list", "table", "junk"]
#: Shapes a line can have: garbled, fields, item, sentences, running text without end, short fragment.
SHAPES = ["garbled", "fields", "item", "sentences", "running", "fragment"]

# The model before training: for each statistic of a line, rows by KINDS, columns by its steps.
PRIORS: dict[str, list[list[float]]] = {
    # SHAPES
    "shape": [[0.01, 0.01, 0.06, 0.58, 0.22, 0.12], [0.01, 0.02, 0.60, 0.02, 0.03, 0.32], [0.01, 0.80, 0.05, 0.01, 0.01, 0.12], [0.82, 0.05, 0.02, 0.04, 0.04, 0.03]],
    # share of common words: none, below 0.1, below 0.25, more; the last is a short fragment, of which it tells nothing
    "common": [[0.10, 0.25, 0.35, 0.25, 0.05], [0.55, 0.25, 0.10, 0.05, 0.05], [0.72, 0.18, 0.04, 0.01, 0.05], [0.65, 0.18, 0.08, 0.04, 0.05]],
    # signs and digits inside words, per word: below 0.05, below 0.2, more
    "damage": [[0.969, 0.03, 0.001], [0.95, 0.045, 0.005], [0.85, 0.12, 0.03], [0.35, 0.15, 0.50]],
    # digits among the characters: none, below 0.1, below 0.3, more
    "digits": [[0.50, 0.40, 0.08, 0.02], [0.45, 0.38, 0.14, 0.03], [0.08, 0.24, 0.32, 0.36], [0.40, 0.20, 0.20, 0.20]],
    # other signs among the characters: below 0.06, below 0.15, below 0.35, more
    "signs": [[0.48, 0.45, 0.06, 0.01], [0.28, 0.48, 0.20, 0.04], [0.17, 0.45, 0.30, 0.08], [0.25, 0.20, 0.20, 0.35]],
    # ends like a sentence: no, yes
    "ended": [[0.30, 0.70], [0.92, 0.08], [0.94, 0.06], [0.75, 0.25]],
}
FEATURES = list(PRIORS)
STAY = 0.88
#: Lines the prior counts as in training, at least, and rounds of training.
PRIOR_LINES, TRAIN_ROUNDS = 2000, 2
#: A document is natural prose when prose lines hold at least this share of its characters.
PROSE_SHARE = 0.2

ITEM = re.compile(r"\s*(?:[-*•+·▪◦–]\s+|\[[ xX]?\]\s|\(?\d{1,4}[.)]\s+|\d{1,4}、|\d+(?:\.\d+)+\.?\s|[a-zA-Z][.)]\s)")
LEADERS = re.compile(r"[.·…]{4,}\s*\d+\s*$")
ENTRY = re.compile(r"\s*[^\s:—–]{1,40}(?: [^\s:—–]{1,30}){0,3}\s+[:—–]\s+\S")
PAIR = re.compile(r"\S=\S")
GAPS = re.compile(r"\S {2,}(?=\S)")
JOINED = re.compile(r"[^\s,;][,;](?=[^\s,;])")
RULED = re.compile(r"\s*[|+]")
SEPARATORS = ("; ", " | ", " / ", "、", ", ", " • ", " · ")
STOP = re.compile(r"[.!?](?=\s|$)|[。！？]")
END = re.compile(r"[.!?。！？…:：][\"'”’」』）)\]]*\s*$")
WORD = re.compile(r"[^\W\d_㐀-鿿]+")
CJK = re.compile(r"[㐀-鿿]+")
DIGITS = re.compile(r"\d+")
HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}")
MACHINE = re.compile(r"(?<!\S)(?:null|undefined|nan|none|http|%|&&|0x[0-9a-f]+|id=\d*)(?!\S)")
HEX = re.compile(r"\s*(?:[0-9a-fA-F]{2}[\s:]){6}")
BLOB = re.compile(r"[A-Za-z0-9+/=_-]{36,}")
BROKEN = re.compile(r"�|ï¿½|Ã.|â€|Â.|Ð.|Ñ.|å.|[\x00-\x08\x0e-\x1f]")
# Signs and digits between letters, and stray signs and single letters between ideographs, as damaged scans have. The character
# itself comes first, what stands before it is looked up after it: so lines are skipped through fast.
LETTER, IDEOGRAPH = r"[^\W\d_㐀-鿿]", "[㐀-鿿，。]"
DAMAGE = re.compile(rf"[0-9#~^|@\\$%](?:(?<={LETTER}.)[0-9#~^|@\\$%]*(?={LETTER})|(?<=\s[#~^|])[#~^|]*(?={LETTER}))")
DAMAGE_DENSE = re.compile(rf"[A-Za-z0-9#~^|@\\$%_](?:(?<=[㐀-鿿][A-Za-z0])(?=[㐀-鿿])|(?<={IDEOGRAPH}[#~^|@\\$_])[#~^|@\\$_]*|(?<=[#~^|@\\$_])(?={IDEOGRAPH})|(?<={LETTER}[0-9#~^|@\\$%])[0-9#~^|@\\$%]*(?={LETTER}))")
#: Contents that stand for nothing.
NOTHING = {"null", "none", "nan", "n/a", "undefined", "...", "…", "-", "?"}


@dataclass(frozen=True)
class LineModel:
    """Log probabilities: start (kinds), step (kinds x kinds), and for each statistic (kinds x its steps)."""

    start: np.ndarray
    step: np.ndarray
    emit: tuple[np.ndarray, ...]


def _normal(counts: np.ndarray) -> np.ndarray:
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def prior_model() -> LineModel:
    k = len(KINDS)
    step = np.full((k, k), (1 - STAY) / (k - 1))
    np.fill_diagonal(step, STAY)
    return LineModel(np.log(np.full(k, 1 / k)), np.log(step), tuple(_normal(np.array(PRIORS[f])) for f in FEATURES))


class WordList:
    """Common words: single words of spaced scripts, and words of unspaced scripts as one pattern."""

    def __init__(self, words: list[str]) -> None:
        self.spaced = {w.lower() for w in words if not CJK.search(w)}
        dense = sorted({w for w in words if CJK.search(w)}, key=lambda w: (-len(w), w))
        self.dense = re.compile("|".join(map(re.escape, dense))) if dense else None

    def hits(self, text: str, tokens: list[str], cjk: int) -> int:
        n = sum(t in self.spaced for t in tokens) if tokens else 0
        return n + (sum(map(len, self.dense.findall(text))) if cjk and self.dense else 0)


def line_shape(line: str, tokens: list[str], letters: int, cjk: int, digits: int, common: float) -> int:
    """Index into SHAPES. tokens: words in lower case; letters includes the cjk ones."""
    n = len(line)
    solid = n - line.count(" ")
    stops = len(STOP.findall(line))
    ended = bool(END.search(line))
    size = n + cjk
    ruled = RULED.match(line)
    if letters + digits == 0 or letters + digits < 0.4 * solid and not ruled and not LEADERS.search(line[-200:]):
        return 1 if ruled and letters + digits == 0 and line.count("+") + line.count("|") > 1 else 0
    item = ITEM.match(line)
    if common >= 0.1 and ended and size > 24 and not item and not ruled and "\t" not in line:
        return 3
    if HEX.match(line) or not cjk and BLOB.search(line) and len(line.split()) * 30 < n:
        return 0
    if not line.isascii() and len(BROKEN.findall(line)) * 8 > n:
        return 0
    if not common and not cjk and len(tokens) > 2 and (len(HARD.findall(line)) * 5 > len(tokens) or len(MACHINE.findall(line.lower())) * 4 > len(line.split())):
        return 0
    if ruled and line.count("|") > 2 or "\t" in line.strip() or common < 0.1 and len(PAIR.findall(line)) > 1 or digits * 5 > letters and line.count(" | ") > 1:
        return 1
    if item or LEADERS.search(line[-200:]):
        return 2
    if len(GAPS.findall(line)) > 1:
        return 1
    joined = len(JOINED.findall(line))
    if joined > 2 and stops < 2 or joined > 1 and not stops and not ended and common < 0.1:
        return 1
    if n < 160 and common < 0.3 and stops < 2 and ENTRY.match(line):
        return 2
    parts = max(map(line.count, SEPARATORS))
    if parts > 3 and stops < 2 and n / (parts + 1) < 60 and common < 0.2:
        return 2
    if ended and (size > 24 or common >= 0.15) or stops and size > 60:
        return 3
    return 4 if size > 48 else 5


def delimiters(line: str) -> int:
    """Commas and semicolons without a blank after them."""
    return line.count(",") - line.count(", ") + line.count(";") - line.count("; ")


def row_columns(lines: list[str]) -> int:
    """The count of delimiters that most lines share, as rows of separated values do; 0 where they don't."""
    if len(lines) < 3:
        return 0
    n, lines_with = Counter(map(delimiters, lines)).most_common(1)[0]
    return n if n > 1 and lines_with >= 0.7 * len(lines) else 0


def read_lines(text: str, words: WordList) -> tuple[list[tuple[int, ...]], list[int], dict[str, float]]:
    """(steps of FEATURES of each line that isn't blank, its characters, the statistics of the text)."""
    seen = []
    n_words = letters_all = hits_all = ended = symbols = solid = 0
    parts: list[str] = []
    for x in text.splitlines():
        if not x or x.isspace():
            continue
        tokens = WORD.findall(x.lower())
        cjk = 0 if x.isascii() else sum(map(len, CJK.findall(x)))
        letters = sum(map(len, tokens)) + cjk
        digits = sum(map(len, DIGITS.findall(x)))
        hits = words.hits(x, tokens, cjk)
        count = len(tokens) + cjk
        ends, filled = int(bool(END.search(x))), len(x) - x.count(" ")
        seen.append((x, tokens, letters, cjk, digits, hits / count if count else 0.0, ends, filled))
        if letters:
            parts += [p.strip() for p in STOP.split(x) if len(p) > 3]
        n_words += count
        letters_all += letters
        hits_all += hits
        ended += ends
        solid += filled
        symbols += filled - letters - digits
    distinct = len(set(parts)) / len(parts) if parts else 0.0
    repeated = len(parts) > 3 and distinct < 0.34
    bare = text.strip()
    nothing = len(seen) == 1 and (bare.lower() in NOTHING or len(bare) < 4 and not any(map(str.isalpha, bare)))
    columns = row_columns([x[0] for x in seen])
    out = []
    for x, tokens, letters, cjk, digits, common, ends, filled in seen:
        if repeated or nothing:  # what says nothing new is garbled, whatever its lines look like
            out.append((0, 0, 2, 0, 3, 0))
            continue
        shape = 1 if columns and delimiters(x) == columns else line_shape(x, tokens, letters, cjk, digits, common)
        damage = len((DAMAGE_DENSE if cjk else DAMAGE).findall(x)) / max(1.0, len(tokens) + cjk / 3) if letters else 0.0
        told = 4 if shape == 5 else (common > 0) + (common >= 0.1) + (common >= 0.25)
        some, signs = digits / filled, (filled - letters - digits) / filled
        out.append((shape, told, (damage >= 0.05) + (damage >= 0.2), (some > 0) + (some >= 0.1) + (some >= 0.3), (signs >= 0.06) + (signs >= 0.15) + (signs >= 0.35), ends))
    return out, [len(x[0]) for x in seen], {
        "n_lines": len(seen),
        "n_words": n_words,
        "mean_word_length": letters_all / n_words if n_words else 0.0,
        "symbol_ratio": max(0, symbols) / solid if solid else 0.0,
        "ended_line_share": ended / len(seen) if seen else 0.0,
        "common_word_share": hits_all / n_words if n_words else 0.0,
        "distinct_part_share": distinct,
    }


def best_paths(docs: list[np.ndarray], model: LineModel) -> list[np.ndarray]:
    """Most likely kinds of the lines (lines x FEATURES) of each document (Viterbi), many documents in step."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(docs)
    order = sorted((i for i, d in enumerate(docs) if len(d)), key=lambda i: len(docs[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(docs[order[end]]) <= 100_000:
            end += 1
        part = order[at:end]
        at = end
        sizes = np.array([len(docs[i]) for i in part])
        longest = int(sizes[-1])
        lines = np.concatenate([docs[i] for i in part]).astype(np.int64)
        told = sum(e.T[lines[:, f]] for f, e in enumerate(model.emit))
        obs = np.zeros((len(part), longest, len(KINDS)))
        obs[np.arange(longest)[None, :] < sizes[:, None]] = told
        back = np.zeros((len(part), longest, len(KINDS)), dtype=np.int8)
        score = model.start + obs[:, 0]
        final = score.copy()
        for t in range(1, longest):
            live = int(np.searchsorted(sizes, t, side="right"))
            via = score[live:, :, None] + model.step
            back[live:, t] = via.argmax(axis=1)
            score[live:] = via.max(axis=1) + obs[live:, t]
            final[live:] = score[live:]
        state = final.argmax(axis=1)
        path = np.zeros((len(part), longest), dtype=np.int64)
        rows = np.arange(len(part))
        for t in range(longest - 1, -1, -1):
            live = sizes > t
            path[live, t] = state[live]
            if t:
                state = np.where(live, back[rows, t, state], state)
        for r, i in enumerate(part):
            out[i] = path[r, : sizes[r]]
    return out


def count_paths(docs: list[np.ndarray], model: LineModel) -> list[np.ndarray]:
    """Counts of the steps between kinds and of each statistic by kind on the best paths."""
    k, paths = len(KINDS), best_paths(docs, model)
    if not any(map(len, docs)):
        return [np.zeros((k, k)), *[np.zeros_like(e) for e in model.emit]]
    lines, path = np.concatenate(docs), np.concatenate(paths)
    inside = np.ones(len(path) - 1, dtype=bool)  # steps from one document to the next don't count
    ends = np.cumsum([len(p) for p in paths])[:-1] - 1
    inside[ends[(ends >= 0) & (ends < len(path) - 1)]] = False
    out = [np.bincount((path[:-1] * k + path[1:])[inside], minlength=k * k).reshape(k, k).astype(float)]
    for f, e in enumerate(model.emit):
        out.append(np.bincount(path * e.shape[1] + lines[:, f], minlength=e.size).reshape(e.shape).astype(float))
    return out


def refit(base: LineModel, counts: list[np.ndarray]) -> LineModel:
    """The mean of the prior and of what was counted, kind by kind; the prior holds however many lines there are."""
    tables = [base.step, *base.emit]
    new = [_normal(c + np.exp(t) * np.maximum(PRIOR_LINES, c.sum(axis=1, keepdims=True))) for c, t in zip(counts, tables)]
    return LineModel(base.start, new[0], tuple(new[1:]))


def train(docs: list[np.ndarray], rounds: int = TRAIN_ROUNDS) -> LineModel:
    """Fit the model to unlabelled documents by Viterbi training, held by the prior."""
    base = model = prior_model()
    for _ in range(rounds):
        model = refit(base, count_paths(docs, model))
    return model


def common_words(words: DataFrame) -> WordList:
    """The word list on the driver; a fixed table, at most 100,000 words."""
    got = [r[0] for r in words.where("word IS NOT NULL").select("word").distinct().orderBy("word").take(100_001)]
    if len(got) > 100_000:
        raise ValueError("more than 100,000 common words")
    return WordList(got)


STATS = ["n_lines", "n_words", "mean_word_length", "symbol_ratio", "ended_line_share", "common_word_share", "distinct_part_share"]


def line_table(docs: DataFrame, listed: WordList, id_col: str, text_col: str) -> DataFrame:
    """(id, n_chars, STATS, codes, sizes): what is read from every text, once; codes and sizes of lines as bytes."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [read_lines(t, listed) for t in pdf["text"]]
            out = {"id": pdf["id"], "n_chars": pdf["text"].str.len()} | {s: [x[2][s] for x in got] for s in STATS}
            out |= {"codes": [np.array(x[0], dtype=np.uint8).tobytes() for x in got], "sizes": [np.array(x[1], dtype=np.int32).tobytes() for x in got]}
            yield pd.DataFrame(out)

    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(read, f"id {id_type}, n_chars long, n_lines long, n_words long, mean_word_length double, symbol_ratio double, ended_line_share double, common_word_share double, distinct_part_share double, codes binary, sizes binary")


def _codes(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(c, dtype=np.uint8).reshape(-1, len(FEATURES)) for c in column]


def fit_line_model(lines: DataFrame, rounds: int = TRAIN_ROUNDS) -> LineModel:
    """Viterbi training over the lines of all documents: each round, tasks count along their best paths and the driver gets the sums."""
    base = model = prior_model()
    shapes = [base.step.shape, *[e.shape for e in base.emit]]
    ends = np.cumsum([a * b for a, b in shapes])
    for _ in range(rounds):

        def count(batches: Iterator[pd.DataFrame], model: LineModel = model) -> Iterator[pd.DataFrame]:
            total = np.zeros(ends[-1])
            for pdf in batches:
                total += np.concatenate([c.ravel() for c in count_paths(_codes(pdf["codes"]), model)])
            yield pd.DataFrame({"place": np.arange(len(total)), "n": total})

        got = lines.select("codes").mapInPandas(count, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).collect()
        flat = np.zeros(ends[-1])
        for r in got:
            flat[r["place"]] = r["n"]
        model = refit(base, [c.reshape(s) for c, s in zip(np.split(flat, ends[:-1]), shapes)])
    return model


def text_quality(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LineModel | None = None, prose_share: float = PROSE_SHARE) -> DataFrame:
    """One row per document: statistics, share of characters in lines of each kind, and the document's kind.

    Whole texts are read once, where they are (no shuffle); the steps of their lines are written, the model is
    trained on those of all documents (unless given) and labels them. A document is prose when prose lines hold
    prose_share of its characters, else of the kind that holds most; NULL, empty and blank texts are junk with
    zero statistics. Repeated rows give repeated rows. An empty table gives none.
    """
    lines = line_table(docs, common_words(words), id_col, text_col)
    if model is None:
        lines = spread(materialize(lines))
        model = fit_line_model(lines)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shares = np.zeros((len(pdf), len(KINDS)))
            for i, (p, n) in enumerate(zip(best_paths(_codes(pdf["codes"]), model), pdf["sizes"])):
                if len(p):
                    shares[i] = np.bincount(p, np.frombuffer(n, dtype=np.int32), len(KINDS))
                    shares[i] /= shares[i].sum()
            other = shares[:, 1:].argmax(axis=1) + 1
            kind = np.where(shares[:, 0] >= prose_share, 0, np.where(shares.sum(axis=1) > 0, other, 3))
            out = pdf.drop(columns=["codes", "sizes"]).round({s: 6 for s in STATS})
            yield out.assign(**{f"{k}_share": shares[:, j].round(6) for j, k in enumerate(KINDS)}, kind=[KINDS[k] for k in kind])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema if f.name not in ("codes", "sizes"))
    return lines.mapInPandas(label, f"{kept}, " + ", ".join(f"{k}_share double" for k in KINDS) + ", kind string").withColumnRenamed("id", id_col)
