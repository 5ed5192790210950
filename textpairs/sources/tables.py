"""The driver's parquet tables seen as question/answer corpora.

* ``qa_docs`` - each ``documents`` row stands for one module file: folder = ``lang``,
  module = ``source``, file = ``doc_id``; its text lines alternate question / answer.
* ``qa_conv`` - ``conversations``: a user turn is a question, the following turn is
  its answer when that turn is the assistant's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.operators.pairing import pairs_in_rows, unpaired_in_rows
from textpairs.session import read_table, spread

DOC_KEYS = ["doc_id", "folder", "module"]
QA_COLUMNS = ["question", "answer", "folder", "module"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("folder"), F.col("source").alias("module"), "text"
    )
    return spread(docs, "doc_id")


def qa_docs(spark: SparkSession, sf_dir: str, cap: int | None = None, on_unpaired: str = "quarantine") -> DataFrame:
    """(doc_id, folder, module, pair_idx, question, answer)."""
    return pairs_in_rows(documents(spark, sf_dir), "text", DOC_KEYS, cap=cap, on_unpaired=on_unpaired)


def qa_docs_unpaired(spark: SparkSession, sf_dir: str, cap: int | None = None) -> DataFrame:
    """(doc_id, folder, module, ln, text) - the quarantined odd tails."""
    return unpaired_in_rows(documents(spark, sf_dir), "text", DOC_KEYS, cap=cap)


def _turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").filter(F.col("role") == role).select("conv_id", "turn", "text")


def qa_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer) - user turn joined to the assistant turn right after it.

    An equi-join on ``(conv_id, turn + 1)`` instead of ``lead`` over a window by
    ``conv_id``: the shuffle key includes the turn, so one enormous conversation is
    spread over all tasks rather than sorted in one.
    """
    u = _turns(spark, sf_dir, "user").alias("u")
    a = _turns(spark, sf_dir, "assistant").alias("a")
    return u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("u.turn") + 1 == F.col("a.turn"))).select(
        F.col("u.conv_id").alias("conv_id"),
        F.col("u.turn").alias("turn"),
        F.col("u.text").alias("question"),
        F.col("a.text").alias("answer"),
    )


def qa_conv_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question) - user turns with no assistant turn right after."""
    u = _turns(spark, sf_dir, "user").alias("u")
    a = _turns(spark, sf_dir, "assistant").alias("a")
    return u.join(
        a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("u.turn") + 1 == F.col("a.turn")), "left_anti"
    ).select("conv_id", "turn", F.col("text").alias("question"))
