"""Queries of the training-data problems over a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import chunking, knntree, lookalike, markup, mixing, neardup, packing, quality, ranking
from marlstone.llm.tokens import byte_tokens
from marlstone.session import materialize, table, texts

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found_structures(markup.extract_text(texts(spark, d, "chunks").where("chunk_id IS NOT NULL")))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.extract_text(texts(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = knntree.similar_pairs(table(spark, d, "chunks"))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def _every_hundredth(chunks: DataFrame) -> DataFrame:
    """Chunks whose id, read as a number (its first 15 hexadecimal digits), is divisible by 100."""
    return chunks.where(F.conv(F.substring("chunk_id", 1, 15), 16, 10).cast("long") % 100 == 0)


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("chunk_id", "content_vector")
    near = knntree.nearest(chunks, _every_hundredth(chunks))
    return near.select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 4).alias("cosine"), F.col("position").cast("long").alias("position"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the true neighbours that the tree finds, for every hundredth chunk, against brute force in blocks."""
    chunks = table(spark, d, "chunks").select("chunk_id", "content_vector")
    index = knntree.Index(chunks)
    asked = materialize(index.asked(_every_hundredth(chunks)))
    found = index.search(*index.calibrate(0.97), queries=asked).select("q", "b", F.lit(1).alias("hit"))
    true = None
    for vids, vectors in index.blocks(asked, 4000):
        part = index.brute_force(vids, vectors).select("q", "b")
        true = part if true is None else true.unionByName(part)
    both = true.join(found, ["q", "b"], "left")
    return both.agg(F.countDistinct("q").alias("queries"), F.count("*").alias("true_neighbours"), F.count("hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("true_neighbours"), 4))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "chunks").where("chunk_id IS NOT NULL")).where("n_pieces > 1").select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "chunks"))


def p3_checked(spark: SparkSession, d: str) -> DataFrame:
    """Do the pieces of each oversized chunk give its text again, each within the limit, neighbours sharing what is asked for?"""
    chunks = table(spark, d, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", "content", "chunk_size", "chunk_level", "chunk_overlap").distinct()
    limit = chunking.size_limit(F.col("chunk_size"), F.col("chunk_level"))
    keyed = chunks.withColumn("row_id", F.to_json(F.struct("chunk_id", "chunk_size", "chunk_level", "chunk_overlap")))
    asked = keyed.select("row_id", "chunk_id", "content", F.least(F.greatest(F.coalesce("chunk_overlap", F.lit(0)), F.lit(0)), limit - 1).alias("asked"))
    tail = F.substring("piece", F.col("overlap") + 1, F.length("piece"))
    pieces = chunking.split_oversized(keyed, "row_id").join(asked.select("row_id", "asked"), "row_id")
    joined = pieces.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", tail.alias("t")))), lambda x: x["t"]), "").alias("again"), F.every(F.length("piece") <= F.col("size_limit")).alias("within"), F.every((F.col("piece_no") == 0) | (F.col("overlap") == F.col("asked"))).alias("shared"))
    return joined.join(asked, "row_id").select("chunk_id", F.length("content").cast("long").alias("characters"), (F.col("again") == F.col("content")).alias("joined"), "within", "shared").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(texts(spark, d, "chunks"))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(texts(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_items(ranking.outrank(table(spark, d, "hits")), 3).select("query_id", "id")


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.full_ranking(ranking.outrank(table(spark, d, "hits")))
    return ranked.select("query_id", "id", (F.round("flow", 6) + 0.0).alias("flow"), F.col("position").cast("long").alias("position"))


def p5_threshold_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Leads of 5 percentiles or less are no preference, those of 50 or more a full one."""
    ranked = ranking.full_ranking(ranking.outrank(table(spark, d, "hits"), indifference=0.05, preference=0.5))
    return ranked.select("query_id", "id", (F.round("flow", 6) + 0.0).alias("flow"), F.col("position").cast("long").alias("position"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    groups = lookalike.lookalike_groups(texts(spark, d, "chunks"), "chunk_id", ["content", "content_jieba"], "content", 300)
    return lookalike.lookalike_pairs(groups).select("field", F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    groups = lookalike.lookalike_groups(texts(spark, d, "chunks"), "chunk_id", ["content", "content_jieba"], "content", 300)
    return lookalike.lookalike_classes(groups).withColumnRenamed("id", "chunk_id")


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    forms = lookalike.unify(texts(spark, d, "chunks").select("chunk_id", "content", "content_jieba"), ["content", "content_jieba"])
    return forms.select("chunk_id", "content_form", "content_jieba_form")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))
    return packed.where("n_pieces > 1").select("spec_id", "doc_id").distinct()


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs")))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Do the containers of each spec hold all tokens, none more than it may, 95 percent full or more in all?"""
    packed = materialize(packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs")))
    most = packed.groupBy("spec_id", "container").agg(F.sum("token_count").alias("t")).groupBy("spec_id").agg(F.max("t").alias("most"))
    report = packing.fill_report(packed).join(most, "spec_id")
    return report.select("spec_id", "capacity", F.col("tokens").cast("long").alias("tokens"), (F.col("fill") >= 0.95).alias("dense"), (F.col("most") <= F.col("capacity")).alias("within"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report
    return report.where("shortfall").select("mix_id", "source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).rows


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Does each source give its target up to half its longest document, or all it may?"""
    docs = table(spark, d, "documents")
    report = mixing.mix(docs, table(spark, d, "mix_targets")).report
    longest = docs.groupBy("source").agg(F.max(byte_tokens(F.col("text"))).alias("longest"))
    off = F.abs(F.col("drawn_tokens") - F.least(F.col("target_tokens"), F.col("available_tokens") * F.col("max_repeat").cast("double")))
    at = report.join(longest, "source", "left").withColumn("met", off <= F.coalesce(F.col("longest") / 2, F.lit(0.0)) + 1)
    return at.select("mix_id", "source", "available_tokens", "shortfall", "met", (F.col("most_repeats") <= F.col("max_repeat")).alias("within"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    labelled = quality.text_quality(texts(spark, d, "documents"), table(spark, d, "common_words"))
    return labelled.where("kind <> 'prose'").select("doc_id", "kind")


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(texts(spark, d, "documents"), table(spark, d, "common_words"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_nearest, p2_recall, p3_found, p3_pieces, p3_checked, p4_found, p4_groups, p5_found, p5_ranking, p5_threshold_ranking, p6_found, p6_classes, p6_forms, p7_found, p7_packing, p7_fill, p7_checked, p8_found, p8_mixture, p8_shares, p8_checked, p9_found, p9_quality)}
