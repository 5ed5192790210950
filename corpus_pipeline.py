"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the columns of ``documents``; the
last one returns the packed pieces.  ``run`` applies them in order.  Intermediate tables go under the shared
checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.llm import decontaminate, jaccard_join, language_id, packing, substring_dedup
from textpairs.llm.exchange import small_batches, without
from textpairs.session import materialize

#: what stages read by name; other columns of the caller are carried under names of their own
READ = ("doc_id", "text", "lang")


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with private names for all columns that no stage reads, so that none clashes with a stage's own."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"__column_{i}") for i, c in enumerate(docs.columns)])


def _back(got: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``got`` (made from ``_aside(docs)``) with the columns of ``docs``."""
    return got.select(*[F.col(c if c in READ else f"__column_{i}").alias(c) for i, c in enumerate(docs.columns)])


#: a document stays if the network gives its language at least this probability
LANGUAGE_LEAST = 0.4


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that read as none of the learned languages.

    Null and empty texts have no letter and go; a null language is not learned from; equal texts go or stay alike; a null
    id stays null; without a learned language all documents go; an empty table stays empty.
    """
    small_batches(spark)
    mine = _aside(docs)
    got = language_id.predict(mine, language_id.train(mine))
    return _back(got.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= LANGUAGE_LEAST)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document id of each group of alike documents.

    Null and empty texts are like nothing and stay; a null id counts as larger than every id; rows that repeat in id and
    text stay once, whatever their other columns; an empty table stays empty.
    """
    small_batches(spark)
    return _back(jaccard_join.one_of_each(_aside(docs)), docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; documents of which nothing is left go.

    Null and empty texts lose nothing and stay as they are; a null id counts as larger than every id; rows that share an id
    cut nothing from one another; ``n_chars``, where there is one, follows the text; an empty table stays empty.
    """
    small_batches(spark)
    got = substring_dedup.remove_repeats(_aside(docs))
    got = got.filter((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    # a text that loses nothing stays as it was, blanks and all
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    got = _back(got.withColumn("text", text), docs)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; of rows that share an id those with the text go; without benchmark
    items all documents stay; an empty table stays empty.
    """
    small_batches(spark)
    mine = _aside(docs)
    hit = decontaminate.contamination(mine, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0")
    return _back(without(mine, hit.select(F.col("doc_id").alias("id"), "tkey"), "doc_id", "text"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their place in a sequence.

    A null or empty text is the end token alone; rows that repeat are packed each for itself; a null id stays null; an
    empty table gives no pieces; other columns are not read.
    """
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: a trained network and a tokenizer decide, which SQL cannot state
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
