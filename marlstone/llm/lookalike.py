"""One consistent form for equal-looking text by Viterbi search of look-alike lattices (problem 6).

A text is brought to compatibility form where that keeps its look (width, blanks, compatibility
ideographs), stripped of ignorable characters, and composed. Then each token is a lattice: every letter
may be any of its look-alikes of other scripts, whichever of them is stored. The best path under character
bigrams of single-script tokens of the whole corpus, with a price on leaving a script, replaces the token.
Every token goes through the search, plain ones too (its result is kept per distinct token), and the lattice is the
same for all spellings that look alike, so they end in the same form. Case, accents and line breaks are kept.
Look-alikes are those of the table below and the letters of Greek, Cyrillic, Armenian, Cherokee, Coptic and Lisu that the
Unicode confusables of the session's JVM (ICU) call confusable with one Latin letter of the same case; without them it is an error.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.skew import hot_keys, repeat_rows, salted_join, spread_rows
from marlstone.session import materialize

# Letters and signs that look the same; the first of a row is the Latin or the common one.
LOOKALIKES = """
A А Α
B В Β
C С Ϲ
D Ꭰ
E Е Ε
G Ԍ
H Н Η
I І Ι Ӏ
J Ј Ϳ
K К Κ
M М Μ Ϻ
N Ν
O О Ο
P Р Ρ
Q Ԛ
S Ѕ
T Т Τ
V Ѵ
W Ԝ
X Х Χ
Y Υ Ү
Z Ζ
a а
c с ϲ
d ԁ
e е
g ɡ
h һ
i і ι ı
j ј ϳ
k κ
l ӏ
o о ο
p р
q ԛ
s ѕ
u υ
v ν ѵ
w ԝ
x х
y у ү
工 エ
口 ロ
力 カ
二 ニ
八 ハ
夕 タ
卜 ト
一 ー
へ ヘ
""".split("\n")
# Radicals without a compatibility mapping, each before its ideograph.
RADICALS = "⺁厂 ⺄乙 ⺆冂 ⺇几 ⺈刀 ⺊卜 ⺌小 ⺎兀 ⺐尢 ⺓幺 ⺕彐 ⺝月 ⺠民 ⺡水 ⺣火 ⺤爪 ⺩王 ⺫目 ⺬示 ⺮竹 ⺰纟 ⺳网 ⺶羊 ⺷羊 ⺼肉 ⺾艹 ⺿艹 ⻁虎 ⻂衣 ⻃西 ⻄西 ⻅见 ⻆角 ⻉贝 ⻋车 ⻌辶 ⻍辶 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻖阝 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻬齐 ⻰龙 ⻲龟".split()
# Signs that look like a common one: hyphens, quotation dots, primes.
SIGNS = {"‐": "-", "‑": "-", "−": "-", "‧": "·", "・": "·", "∙": "·", "⋅": "·", "׀": "|", "∣": "|", "∶": ":", "ː": ":", "꞉": ":", "；": ";", ";": ";", "⁄": "/", "∕": "/", "‚": ",", "ꓹ": ","}
#: Kinds of compatibility mapping that keep the look.
KEPT_KINDS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>")
#: Characters without a look of their own, besides all format characters.
IGNORABLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0} | set(range(0xFE00, 0xFE10)) | set(range(0xE0000, 0xE1000)) | set(range(0x180B, 0x1810))
#: Price of a step to another script inside a token; weight of a letter never seen, and of single letters against bigrams.
SWITCH, UNSEEN, SINGLE = 12.0, 0.5, 50.0


# Letters that are confusable by the Unicode list but told apart easily.
DISTINCT = set("αγσϱгᴦⲅґազգռքҽѡղ")
#: Scripts whose letters are looked up in the Unicode list: first and last code point.
LISTED = ((0x370, 0x3FF), (0x400, 0x52F), (0x531, 0x58F), (0x13A0, 0x13FF), (0xAB70, 0xABBF), (0x2C80, 0x2CFF), (0xA4D0, 0xA4FF))

ROWS = [r.split() for r in LOOKALIKES if r]
CLASS = {c: r for r in ROWS for c in r}


def confusables(spark: SparkSession) -> dict[str, list[str]]:
    """Letter -> its row of look-alikes: the table's and the Unicode list's. Read on the driver; some hundred letters.

    A list that cannot be read whole is an error: the table alone would lose look-alikes without a sign of it.
    """
    rows = {r[0]: list(r) for r in ROWS}
    letters = [c for a, b in LISTED for c in map(chr, range(a, b + 1)) if unicodedata.category(c)[0] == "L" and c not in CLASS and c not in DISTINCT and not unicodedata.decomposition(c)]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeletons = list(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True))
    except Exception as e:
        raise RuntimeError("the Unicode confusables (ICU) of the session's JVM could not be read") from e
    for c, s in skeletons:
        head = "I" if s == "l" and unicodedata.category(c) != "Ll" else s
        if head.isascii() and len(head) == 1 and head.isalpha() and unicodedata.category(c) in ("Lo", "Ll" if head.islower() else "Lu"):
            rows.setdefault(head, [head]).append(c)
    return {c: r for r in rows.values() for c in r}


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for cp in [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)]:
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cf" or cp in IGNORABLE:
            out[cp] = None
        elif kind == "Zs":
            out[cp] = " "
        elif (d := unicodedata.decomposition(c)) and (not d.startswith("<") or d.split()[0] in KEPT_KINDS):
            new = unicodedata.normalize("NFKC", c)
            # look-alikes are for the lattice; marks that stand alone are no blanks
            if new != c and c not in CLASS and not (len(new) > 1 and new[0] == " "):
                out[cp] = new
    out |= {cp: None for cp in IGNORABLE}
    out |= {ord(r[0]): r[1] for r in RADICALS}
    return out | {ord(a): b for a, b in SIGNS.items()}


TABLE = _table()
#: A form has at most this many times the characters of its text.
MAX_GROWTH = max(len(v) for v in TABLE.values() if v)


# Blocks of the scripts that look-alikes come from.
SCRIPTS = [(0x0, 0x24F, "latin"), (0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"), (0x531, 0x58F, "armenian"), (0x13A0, 0x13FF, "cherokee"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x2C80, 0x2CFF, "coptic"), (0x3040, 0x309F, "hiragana"), (0x30A0, 0x30FF, "katakana"), (0x3400, 0x9FFF, "han"), (0xA4D0, 0xA4FF, "lisu"), (0xAB70, 0xABBF, "cherokee"), (0x20000, 0x2FFFF, "han")]
ALPHABETS = {"latin", "greek", "cyrillic", "armenian", "cherokee", "coptic", "lisu"}


@functools.lru_cache(maxsize=100_000)
def script(c: str) -> str:
    """Script of a letter, as far as look-alikes need it."""
    o = ord(c)
    return next((name for a, b, name in SCRIPTS if a <= o <= b), f"other{o >> 8}")


DENSE = "".join(sorted({c for r in ROWS for c in r if script(c) not in ALPHABETS}))
#: Tokens: runs of letters and marks; of unspaced scripts the look-alikes with a neighbour on each side.
TOKEN = re.compile(f"(?:[^\\W\\d_㐀-鿿぀-ヿ]|[̀-ͯ])+|[㐀-鿿぀-ヿ]?[{DENSE}]+[㐀-鿿぀-ヿ]?")
#: Texts with one of these are read in decomposed form, so that letters are told from their marks.
MARKED = re.compile("[À-ɏ̀-԰-֏Ꭰ-᏿Ḁ-῿Ⲁ-⳿ꓐ-꓿ꭰ-ꮿ]")
ODD = re.compile(r"[^\x00-\x7f㐀-鿿。、]")
MARKS = re.compile(r"[̀-ͯ]")


@dataclass
class ScriptModel:
    """Bigram counts of single-script tokens; ^ and $ are the ends."""

    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    firsts: dict[str, float] = field(default_factory=dict)
    scripts: dict[str, float] = field(default_factory=dict)
    classes: dict[str, list[str]] = field(default_factory=lambda: CLASS)
    cache: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.heads = str.maketrans({c: r[0] for c, r in self.classes.items() if c != r[0]})
        self.total = sum(self.scripts.values())
        self.letters = Counter()
        for (_, b), n in self.pairs.items():
            self.letters[b] += n

    @classmethod
    def of(cls, counts: dict[tuple[str, str], int], classes: dict[str, list[str]] = CLASS) -> ScriptModel:
        firsts: Counter = Counter()
        scripts: Counter = Counter()
        for (a, b), n in counts.items():
            firsts[a] += n
            if b != "$":
                scripts[script(b)] += n
        return cls(dict(counts), dict(firsts), dict(scripts), classes)

    def cost(self, a: str, b: str) -> float:
        alone = (self.letters.get(b, 0) + UNSEEN) / (self.total + UNSEEN * 1000)
        p = (self.pairs.get((a, b), 0) + SINGLE * alone) / (self.firsts.get(a, 0) + SINGLE)
        step = -math.log(p)
        if b in self.classes and script(b) in ALPHABETS:  # letters of a script that is rare in the corpus are unlikely
            step += math.log((self.total + 3) / (self.scripts.get(script(b), 0) + 1))
        if a not in "^$" and b not in "^$" and a.isalpha() and b.isalpha() and script(a) != script(b):
            step += SWITCH
        return step

    def decode(self, token: str) -> str:
        """Best reading of a token: a Viterbi search of its lattice; equal for all spellings that look alike."""
        key = token.translate(self.heads)
        got = self.cache.get(key)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[key] = self._search(key)
        return got

    def _search(self, key: str) -> str:
        best, steps = {"^": 0.0}, []
        for c in key:
            if MARKS.match(c):
                steps.append(c)
                continue
            came = {o: min((w + self.cost(s, o), s) for s, w in best.items()) for o in self.classes.get(c, [c])}
            best = {o: w for o, (w, _) in came.items()}
            steps.append({o: s for o, (_, s) in came.items()})
        at = min((w + self.cost(s, "$"), s) for s, w in best.items())[1]
        out = []
        for step in reversed(steps):
            out.append(step if isinstance(step, str) else at)
            at = at if isinstance(step, str) else step[at]
        return "".join(reversed(out))


def looks(text: str) -> str:
    """Compatibility form that keeps the look, without ignorables, composed."""
    if text.isascii():
        return text
    if ODD.search(text):
        text = text.translate(TABLE)
    return unicodedata.normalize("NFC", text)


def consistent(text: str, model: ScriptModel) -> str:
    """The consistent form."""
    text = looks(text)
    marked = not text.isascii() and MARKED.search(text)
    if marked:
        text = unicodedata.normalize("NFD", text)
    changed = {t: new for t in set(TOKEN.findall(text)) if (new := model.decode(t)) != t}
    if changed:
        text = TOKEN.sub(lambda m: changed.get(m[0], m[0]), text)
    return unicodedata.normalize("NFC", text) if marked else text


def count_bigrams(tokens: Counter) -> Counter:
    """Bigram counts of the tokens whose letters are of one script that has look-alikes."""
    out: Counter = Counter()
    for t, n in tokens.items():
        bare = MARKS.sub("", unicodedata.normalize("NFD", t))
        kinds = {script(c) for c in bare if c.isalpha()}
        if len(kinds) == 1 and kinds <= ALPHABETS:
            prev = "^"
            for c in bare:
                out[prev, c] += n
                prev = c
            out[prev, "$"] += n
    return out


def fit_scripts(df: DataFrame, text_cols: list[str]) -> ScriptModel:
    """Bigrams of all tokens of all rows; the driver gets one row per pair of letters."""
    src = df.select(*[F.col(c).alias(f"t{i}") for i, c in enumerate(text_cols)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: Counter = Counter()
        for pdf in batches:
            tokens: Counter = Counter()
            for c in pdf.columns:
                for t in pdf[c]:
                    if t:
                        tokens.update(ALPHA.findall(t))
            out.update(count_bigrams(tokens))
        yield pd.DataFrame([(a, b, n) for (a, b), n in out.items()], columns=["a", "b", "n"])

    rows = src.mapInPandas(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return ScriptModel.of({(r["a"], r["b"]): r["n"] for r in rows}, confusables(df.sparkSession))


ALPHA = re.compile("[A-Za-zÀ-ɏ̀-԰-֏Ꭰ-᏿Ḁ-῿Ⲁ-⳿ꓐ-꓿ꭰ-ꮿ]+")


def digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def unify(df: DataFrame, text_cols: list[str], model: ScriptModel | None = None) -> DataFrame:
    """df with <column>_form for each text column. NULL gives NULL, empty stays empty; rows stay where they are.

    A column of that name must not exist. The script model is counted over all rows of df unless given.
    """
    clash = {f"{c}_form" for c in text_cols} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    model = model or fit_scripts(df, text_cols)

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else consistent(t, model))

    return df.withColumns({f"{c}_form": form(F.col(c)) for c in text_cols})


def lookalike_groups(df: DataFrame, id_col: str, fields: list[str], gate: str, min_chars: int, model: ScriptModel | None = None) -> DataFrame:
    """(field, form, raw, id, spellings, members): values that share their form with a value of other characters.

    form and raw are digests. Only rows whose gate field has min_chars characters in its form count. Repeated
    rows count once per id. Texts are read once and not shuffled; only digests are. A form with any number of
    values is never gathered: values are compared through the count of distinct raw digests per form.
    """
    model = model or fit_scripts(df, fields)
    src = df.where((F.col(id_col).isNotNull()) & (F.length(gate) * MAX_GROWTH >= min_chars)).select(F.col(id_col).alias("id"), F.col(gate).alias("gate"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if len(r.gate) < min_chars and not ODD.search(r.gate) or len(consistent(r.gate, model)) < min_chars:
                    continue
                for i, c in enumerate(fields):
                    t = getattr(r, f"f{i}")
                    if t:
                        rows.append((c, r.id, digest(consistent(t, model)), digest(t)))
            yield pd.DataFrame(rows, columns=["field", "id", "form", "raw"])

    id_type = src.schema["id"].dataType.simpleString()
    keyed = materialize(src.mapInPandas(forms, f"field string, id {id_type}, form binary, raw binary").distinct())
    spellings = keyed.groupBy("field", "form", "raw").agg(F.count("*").alias("n"))
    classes = materialize(spellings.groupBy("field", "form").agg(F.count("*").alias("spellings"), F.sum("n").alias("members")).where("spellings > 1"))
    hot = hot_keys(classes, ["field", "form"], "members")
    return salted_join(keyed, classes, ["field", "form"], hot, F.col("id"))


def lookalike_classes(groups: DataFrame) -> DataFrame:
    """(field, id, class_id, members, spellings, links): a row per value that has look-alikes; links: members spelled differently.

    It grows with the rows, not with the pairs.
    """
    own = groups.groupBy("field", "form", "raw").agg(F.count("*").alias("same"))
    at = salted_join(groups, own, ["field", "form", "raw"], hot_keys(own, ["field", "form", "raw"], "same"), F.col("id"))
    return at.select("field", "id", F.hex("form").alias("class_id"), "members", "spellings", (F.col("members") - F.col("same")).alias("links"))


def lookalike_pairs(groups: DataFrame, hot: int = 2000) -> DataFrame:
    """(field, id_a, id_b): pairs of one form and different characters, the smaller id first.

    A form of more than `hot` values is compared by several tasks: one side is spread over them, the other repeated.
    """
    keys = ["field", "form"]
    large = hot_keys(groups.select(*keys, "members").distinct(), keys, "members", hot)
    a = spread_rows(groups.select(*keys, F.col("id").alias("id_a"), F.col("raw").alias("raw_a")), large, keys, F.col("id_a"))
    b = repeat_rows(groups.select(*keys, F.col("id").alias("id_b"), F.col("raw").alias("raw_b")), large, keys)
    return a.join(b, [*keys, "__salt"]).where("raw_a <> raw_b AND id_a < id_b").select("field", "id_a", "id_b").distinct()
