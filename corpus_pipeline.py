"""From raw documents to training batches: quality, language, near-duplicates, mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import lookup, table
from lantern.llm.langid import UNDETERMINED, fit_languages, predictor
from lantern.llm.lengths import token_counter
from lantern.llm.mixing import mix
from lantern.llm.ngram_join import jaccard_rows
from lantern.llm.packing import pack
from lantern.llm.quality import fit_quality, score_quality
from lantern.runtime import cut, ensure_checkpoint_dir

#: Least probability of its language with which a document stays.
LANGUAGE_SCORE = 0.4


def _as_row(docs: DataFrame) -> DataFrame:
    """Each row as struct ``row``, so that columns of any name stay apart from those that a stage adds."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality by text, source and language section is more likely good than not; blank and null texts go.

    Null sources and sections are keys of their own; repeated rows are scored alike and all stay or go;
    an empty table gives no rows, and one without labels is judged by the global prior.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, F.col("source"), F.col("lang")).where("quality_keep").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the byte network knows, with a probability of ``LANGUAGE_SCORE`` or more; texts without a letter, and null ones, go.

    Repeated rows are predicted alike and all stay or go; an empty table gives no rows, and where there
    is nothing to learn from none stay.
    """
    predict = predictor(docs, fit_languages(docs))
    found = _as_row(docs).withColumn("found", predict(F.col("row.text")))
    return found.where((F.col("found.lang") != UNDETERMINED) & (F.col("found.score") >= LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id, and of an id's texts that of the least hash.

    Rows are documents by id and text: rows of one id with unlike texts all stay, and of rows equal in
    both the least one does. Rows without an id, and texts that are null or without words, have no
    copies; equal rows of the latter with an id count once too. An empty table gives no rows.
    """
    rows = cut(jaccard_rows(docs).where("doc_id is not null"))
    least = cut(rows.where("component is not null").groupBy(F.col("component").alias("__c")).agg(F.min(F.struct("doc_id", "text_key")).alias("stays")))
    copies = lookup(rows.where("component is not null"), least, "component = __c", how="inner").where(F.struct("doc_id", "text_key") != F.col("stays"))
    gone = cut(copies.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct())
    twice = rows.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).count().where("count > 1").drop("count")
    twice = cut(twice.join(gone, ["id", "key"], "left_anti"))
    same = "row.doc_id <=> id and xxhash64(row.text) = key"
    kept = lookup(_as_row(docs), gone, same, how="left_anti")
    if twice.isEmpty():
        return kept.select("row.*")
    again = lookup(kept, twice, same, how="left_semi")
    once = again.groupBy(F.col("row.doc_id").alias("id"), F.col("row.text").alias("key")).agg(F.min("row").alias("row")).select("row")
    return lookup(kept, twice, same, how="left_anti").unionByName(once).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets: weights 1, 2, 3 in turn, at most 3 times their words.

    A null source is a source of its own; texts that are null or without words have no weight, and
    their copies follow their source's rate; rows equal in id and words are drawn alike; an empty
    table gives no rows.
    """
    return mix(docs, weights=(1, 2, 3), most=3.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in length buckets of least padding, and their batches; lengths are tokens of the vocabulary that ``lengths`` names.

    Null and empty texts are one piece of length 0; repeated rows, which the mixture makes, are rows of
    their own; an empty table gives no rows.
    """
    return pack(docs, length=token_counter(docs)(F.col("text")))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packing),
]

#: Learnt models and hashed draws have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    Rows with nulls, ties and repeats fare as the stages say; an empty table gives no rows.
    """
    from uuid import uuid4

    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
