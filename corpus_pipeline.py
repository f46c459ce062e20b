"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkredact.llm import language_id, mixing, ngram_join, packing, pii
from sparkredact.llm.common import materialize, shrink_heaps, small, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without text or without a letter go.

    With nothing to learn from, only texts without a letter go.
    """
    model = language_id.train_on_folds(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # names of its own, as documents may have columns of the usual ones
    found = language_id.identify(docs, model, docs.columns, pred_col="__lang_pred", score_col="__lang_score")
    return found.filter(F.col("__lang_pred") != language_id.UND).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, of equal ids one text, of repeated rows one.

    Texts without words stay. An id that is null comes after all others. An empty table stays empty.
    """
    shrink_heaps(spark)
    found, _ = ngram_join.near_duplicates(docs)
    found = materialize(found.filter("n_shingles > 0").select("group", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("row")), "found")
    many = found.groupBy("group").agg(F.min("row").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    many = materialize(many, "groups")
    members = found.join(small(many), "group")
    gone = materialize(members.filter("row <> first").select("row.*").distinct(), "gone").withColumnsRenamed({"doc_id": "gone_id", "text_hash": "gone_hash"})
    same = members.filter("row = first").groupBy("row").agg(F.count("*").alias("rows")).filter("rows > 1")
    same = materialize(same.select("row.*"), "repeated").withColumnsRenamed({"doc_id": "same_id", "text_hash": "same_hash"})
    # names of its own, as documents may have columns of the usual ones
    key = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    kept = key.join(small(gone.select("gone_id", "gone_hash")), key["doc_id"].eqNullSafe(F.col("gone_id")) & (F.col("__hash") == F.col("gone_hash")), "left_anti")
    if same.isEmpty():
        return kept.select(*docs.columns)
    repeats = kept["doc_id"].eqNullSafe(F.col("same_id")) & (F.col("__hash") == F.col("same_hash"))
    same = small(same.select("same_id", "same_hash"))
    once = kept.join(same, repeats, "left_semi").dropDuplicates(["doc_id", "__hash"])
    return kept.join(same, repeats, "left_anti").union(once).select(*docs.columns)


def _sized(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced."""
    return _sized(pii.sanitise(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, whole, in shards in their shuffled order.

    Texts without words are in no mix; an empty table stays empty; repeated rows are drawn each.
    """
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's tokens goes."""
    shrink_heaps(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", remove_personal_data),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
