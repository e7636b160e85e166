"""New-word discovery: n-gram counts, pointwise mutual information, neighbour entropy, cohesion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import clean_corpus
from marlstone.session import materialize, spread

CJK = "[一-鿿]"
#: Characters of a word whose grams are cut from one piece of it.
BLOCK = 64


def corpus_words(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((word, n) of the cleaned corpus, one row with its length in characters).

    N-grams never hold a blank, so texts are cut into words first and each distinct word is expanded once,
    however often it occurs. Documents are joined by one blank in the length.
    """
    clean = docs.where(F.col(text_col).isNotNull()).select(clean_corpus(F.col(text_col)).alias("t")).where("t <> ''")
    words = clean.select(F.explode(F.split("t", " ")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    total = clean.agg((F.sum(F.length("t")) + F.count("*") - 1).alias("total"))
    return words, total


def ngrams(words: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """(gram, left, right, n): every place of a gram of least to most characters in a distinct word.

    A neighbour outside the word is a blank. gram_counts tells which grams are candidates.
    """
    # unspaced text makes long words: they are cut into blocks first, for a substring is found from its start on
    size, start, i, k = F.length("w"), F.col("start"), F.col("i"), F.col("k")
    blocks = words.where(size >= least).select("w", "n", size.alias("size"), F.explode(F.sequence(F.lit(1), size - (least - 1), F.lit(BLOCK))).alias("start"))
    blocks = blocks.select("n", "size", "start", F.greatest(start - 1, F.lit(1)).alias("first"), F.substring("w", F.greatest(start - 1, F.lit(1)), F.lit(BLOCK + most + 1)).alias("w"))
    at = blocks.select("*", F.explode(F.sequence(start, F.least(start + (BLOCK - 1), F.col("size") - (least - 1)))).alias("i"))
    cut = at.select("w", "n", "i", "size", (i - F.col("first") + 1).alias("at"), F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.col("size") - i + 1))).alias("k"))
    gram = F.substring("w", F.col("at"), k)
    left = F.when(i > 1, F.substring("w", F.col("at") - 1, F.lit(1))).otherwise(F.lit(" "))
    right = F.when(i + k <= F.col("size"), F.substring("w", F.col("at") + k, F.lit(1))).otherwise(F.lit(" "))
    return cut.select(gram.alias("gram"), left.alias("left"), right.alias("right"), "n")


def gram_counts(grams: DataFrame, require: str = CJK, strict_alpha: bool = False) -> DataFrame:
    """(gram, freq) of the candidates: not digits only, matching require; with strict_alpha not letters only either.

    Grams are tested after counting, once each.
    """
    good = ~F.col("gram").rlike(r"^\p{Nd}+$") & F.col("gram").rlike(require)
    if strict_alpha:
        good = good & ~F.col("gram").rlike(r"^\p{L}+$")
    return grams.groupBy("gram").agg(F.sum("n").alias("freq")).where(good)


def neighbour_entropy(grams: DataFrame, side: str) -> DataFrame:
    """(gram, entropy) in bits of the neighbours on one side."""
    each = grams.groupBy("gram", side).agg(F.sum("n").alias("c"))
    # H = log2(T) - sum(c log2 c) / T, so no second pass over the neighbours is needed
    return each.groupBy("gram").agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def mutual_information(counts: DataFrame, frequent: DataFrame, total: int, parts: DataFrame | None = None) -> DataFrame:
    """(gram, left_pmi, right_pmi): of the gram without its last, and its first, character; 0 where a part is missing.

    A part is at least as frequent as its gram, so parts may be given without the rare grams.
    """
    all_ = (counts if parts is None else parts).select(F.col("gram").alias("part"), F.col("freq").alias("part_freq"))
    last = counts.groupBy(F.substring("gram", -1, 1).alias("ch")).agg(F.sum("freq").alias("ch_freq"))
    first = counts.groupBy(F.substring("gram", 1, 1).alias("ch")).agg(F.sum("freq").alias("ch_freq"))
    size = F.length("gram")
    pmi = F.coalesce(F.log2(F.col("freq") * F.lit(float(total)) / (F.col("part_freq") * F.col("ch_freq"))), F.lit(0.0))
    left = frequent.withColumn("part", F.substring("gram", F.lit(1), size - 1)).withColumn("ch", F.substring("gram", -1, 1)).join(all_, "part", "left").join(last, "ch", "left").select("gram", pmi.alias("left_pmi"))
    right = frequent.withColumn("part", F.substring("gram", F.lit(2), size - 1)).withColumn("ch", F.substring("gram", 1, 1)).join(all_, "part", "left").join(first, "ch", "left").select("gram", pmi.alias("right_pmi"))
    return left.join(right, "gram")


def cohesion(counts: DataFrame, frequent: DataFrame, total: int) -> DataFrame:
    """(gram, cohesion): least mutual information over the points where both parts are counted grams, else 0."""
    part = counts.select(F.col("gram").alias("p"), F.col("freq").alias("pf"))
    cuts = frequent.select("gram", "freq", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("i"))
    cuts = cuts.withColumn("l", F.substring("gram", F.lit(1), F.col("i"))).withColumn("r", F.substring("gram", F.col("i") + 1, F.length("gram")))
    both = cuts.join(part.withColumnsRenamed({"p": "l", "pf": "lf"}), "l").join(part.withColumnsRenamed({"p": "r", "pf": "rf"}), "r")
    value = F.log2(F.col("freq") * F.lit(float(total)) / (F.col("lf") * F.col("rf")))
    found = both.groupBy("gram").agg(F.min(value).alias("c"))
    return frequent.join(found, "gram", "left").select("gram", F.coalesce("c", F.lit(0.0)).alias("cohesion"))


def new_words(docs: DataFrame, text_col: str, min_freq: int = 5, least: int = 2, most: int = 6, min_pmi: float = 3.0, min_entropy: float = 1.0, top_k: int = 200, require: str = CJK, strict_alpha: bool = False, known: DataFrame | None = None) -> DataFrame:
    """The top_k new words by score with all measures; known (word) holds words to leave out."""
    words, total_row = corpus_words(docs, text_col)
    total = total_row.first()["total"] or 0
    # a word without a CJK character has no gram with one
    words = spread(materialize(words.where(F.col("w").rlike(require)) if require == CJK else words))
    grams = ngrams(words, least, most)
    counts = spread(materialize(gram_counts(grams, require, strict_alpha)))
    common = spread(materialize(counts.where(F.col("freq") >= min_freq)))
    frequent = common
    if known is not None:
        frequent = frequent.join(known.select(F.col("word").alias("gram")).distinct(), "gram", "left_anti")
    measured = frequent.join(mutual_information(counts, frequent, total, common), "gram").join(cohesion(common, frequent, total), "gram")
    # neighbours are counted only for grams that can still qualify
    out = materialize(measured.where((F.round(F.least("left_pmi", "right_pmi"), 9) >= min_pmi) & (F.round("cohesion", 9) > 0)))
    held = grams.join(out.select("gram"), "gram", "left_semi")
    for side in ("left", "right"):
        out = out.join(neighbour_entropy(held, side).withColumnRenamed("entropy", f"{side}_entropy"), "gram")
    out = out.withColumns({"min_pmi": F.least("left_pmi", "right_pmi"), "min_entropy": F.least("left_entropy", "right_entropy")})
    out = out.withColumn("score", F.round(F.col("min_pmi") * F.col("min_entropy") * F.log("freq"), 6))
    out = out.where(F.round("min_entropy", 9) >= min_entropy)
    measures = ["left_pmi", "right_pmi", "min_pmi", "left_entropy", "right_entropy", "min_entropy", "cohesion"]
    return out.select(F.col("gram").alias("word"), "freq", *[F.round(m, 6).alias(m) for m in measures], "score").orderBy(F.desc("score"), "word").limit(top_k)
