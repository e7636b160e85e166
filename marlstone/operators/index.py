"""Inverted index and index tables: build, save, load, append, upsert, read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import ANALYZERS
from marlstone.operators import topk
from marlstone.session import materialize


#: What postings were counted from, by their table.
_counted_from: WeakKeyDictionary[DataFrame, tuple[DataFrame, tuple[str, ...]]] = WeakKeyDictionary()


@dataclass
class InvertedIndex:
    """postings (field, term, id, tf), lengths (field, id, dl), corpus (field, n, avgdl); kept: are they tables that were written?

    analysed (id, tokens: an array for each of fields) is there for an index that is counted from texts: a search that
    uses it once needs no postings. An index made of the postings of another one has it as well.
    """

    postings: DataFrame
    lengths: DataFrame
    corpus: DataFrame
    kept: bool = False
    analysed: DataFrame | None = None
    fields: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.analysed is not None:
            _counted_from[self.postings] = (self.analysed, self.fields)
        else:
            self.analysed, self.fields = _counted_from.get(self.postings, (None, self.fields))

    def holdings(self, terms: pa.Array, fields: list[str]) -> DataFrame:
        """(id, codes, ns): how often a document holds each of the terms, and its length, coded as in topk.count_terms; all documents for texts, for tables those that hold one or are counted."""
        if self.analysed is not None:
            known = [self.fields.index(f) for f in fields if f in self.fields]
            texts = self.analysed if known else self.analysed.limit(0)
            return texts.mapInArrow(topk.count_terms(terms, known, len(self.fields)), f"id {self.analysed.schema['id'].dataType.simpleString()}, codes array<int>, ns array<int>")
        numbers = self.postings.sparkSession.createDataFrame(pa.table({"term": terms, "__t": pa.array(range(len(terms)), pa.int32())}))
        at = F.array_position(F.lit(fields), F.col("field")).cast("int") - 1
        rows = self.postings.where(F.col("field").isin(fields)).join(F.broadcast(numbers), "term").select("id", (F.col("__t") * len(fields) + at).alias("codes"), F.col("tf").cast("int").alias("ns"))
        rows = rows.unionByName(self.lengths.where(F.col("field").isin(fields)).select("id", (-1 - at).alias("codes"), F.col("dl").cast("int").alias("ns")))
        return rows.groupBy("id").agg(F.collect_list(F.struct("codes", "ns")).alias("x")).select("id", F.col("x.codes").alias("codes"), F.col("x.ns").alias("ns"))

    def vocabulary(self, fields: list[str]) -> DataFrame:
        """(field, term, df) of every term of the fields; a term is counted once per document before anything is shuffled."""
        if self.analysed is None:
            return self.postings.where(F.col("field").isin(fields)).groupBy("field", "term").agg(F.count("*").alias("df"))
        each = self.analysed.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(F.col("tokens")[self.fields.index(f)]).alias("terms")) for f in fields])))
        return each.select("field", F.explode("terms").alias("term")).groupBy("field", "term").agg(F.count("*").alias("df"))

    def stored(self) -> InvertedIndex:
        """The same index written once to the shared folder, so that searches don't analyse the texts again."""
        lengths = materialize(self.lengths)
        return InvertedIndex(materialize(self.postings), lengths, corpus_stats(lengths), True)

    def save(self, path: str) -> None:
        """Three tables; postings are laid out by term, so a query reads few files' row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.corpus.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedIndex:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "corpus")), True)

    def append(self, other: InvertedIndex) -> InvertedIndex:
        """Both indexes as one; ids that the other holds replace those of this one."""
        new = other.lengths.select("id").distinct()
        postings = self.postings.join(new, "id", "left_anti").select("field", "term", "id", "tf").unionByName(other.postings)
        lengths = self.lengths.join(new, "id", "left_anti").select("field", "id", "dl").unionByName(other.lengths)
        return InvertedIndex(postings, lengths, corpus_stats(lengths))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def build_index(docs: DataFrame, id_col: str, fields: list[str] | dict[str, str], analyzer: str = "plain") -> InvertedIndex:
    """Index of text fields; fields is a list, or a map from field to its analyzer.

    Each text is analysed once; documents without a token in a field are not in that field's index. Terms are
    counted inside the document before anything is shuffled, so a document is one row however long; ids must be unique.
    """
    kinds = fields if isinstance(fields, dict) else dict.fromkeys(fields, analyzer)
    analysed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.array(*[ANALYZERS[a](F.col(f)) for f, a in kinds.items()]).alias("tokens"))
    tokens = F.array(*[F.struct(F.lit(f).alias("field"), ANALYZERS[a](F.col(f)).alias("tokens")) for f, a in kinds.items()])
    per_doc = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.inline(tokens)).where(F.size("tokens") > 0)
    lengths = per_doc.select("field", "id", F.size("tokens").cast("long").alias("dl"))
    postings = per_doc.select("field", "id", F.explode("tokens").alias("term")).groupBy("field", "term", "id").agg(F.count("*").alias("tf"))
    return InvertedIndex(postings, lengths, corpus_stats(lengths), analysed=analysed, fields=tuple(kinds))


#: Keys with several rows up to which their set is sent to every task.
FEW_KEYS = 500_000


def latest(df: DataFrame, keys: list[str], order: list[str], few: int = FEW_KEYS) -> DataFrame:
    """One row per key: the last by order columns (NULLs first). A hot key is pre-reduced before the shuffle.

    Keys are counted first. Where few of them have several rows, the others stay where they are and only rows of
    those keys are shuffled; else all rows are.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    reduced = lambda d: d.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*df.columns)
    several = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    several = materialize(several)
    if several.count() > few:
        return reduced(df)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    several = F.broadcast(several)  # at most `few` keys
    return df.join(several, same, "left_anti").unionByName(reduced(df.join(several, same, "left_semi")))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """table with rows replacing those of the same keys; rows are first reduced to the last per key."""
    new = latest(rows, keys, order) if order else rows.dropDuplicates(keys)
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new, allowMissingColumns=True)


def get_document(table: DataFrame, id_col: str, value: object) -> DataFrame:
    """The row of one id, or none; the filter reaches the scan."""
    return table.where(F.col(id_col) == F.lit(value)).limit(1)


def swap_alias(spark: SparkSession, alias: str, table: DataFrame | str) -> None:
    """Point a view name at another table: a view of the catalog for a table's name, one of the session for a plan."""
    if isinstance(table, str):
        spark.sql(f"CREATE OR REPLACE VIEW {alias} AS SELECT * FROM {table}")
    else:
        table.createOrReplaceTempView(alias)


def add_segmented(table: DataFrame, text_col: str, out_col: str, analyzer: str = "segmented") -> DataFrame:
    """Fill a pre-segmented field where it is missing."""
    have = F.col(out_col) if out_col in table.columns else F.lit(None).cast("string")
    return table.withColumn(out_col, F.coalesce(have, F.array_join(ANALYZERS[analyzer](F.col(text_col)), " ")))


def children(chunks: DataFrame) -> DataFrame:
    """(parent_id, child_ids): ids of a chunk's children in order."""
    w = Window.partitionBy("parent_id").orderBy("chunk_id")
    kids = chunks.where("parent_id IS NOT NULL").select("parent_id", "chunk_id").distinct().withColumn("r", F.row_number().over(w))
    return kids.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_id"))), lambda x: x["chunk_id"]).alias("child_ids"))
