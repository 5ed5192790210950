"""Strict checks seen by the write of ``prepare``: the same errors, and no job of their own."""

import pytest
from pyspark.sql import functions as F

from textpairs.operators import clean
from textpairs.plans import flows
from textpairs.session import materialize, scratch_path

SCHEMA = "k long, question string, answer string"


def _prepare(spark, train, test=None, **more):
    return flows.prepare(train, test, ["k"], save_path=scratch_path(spark, "prep"), **more)


def test_errors(spark):
    good = spark.createDataFrame([(i, "q", "a") for i in range(10)], SCHEMA)
    bad = spark.createDataFrame([(0, "q", "a"), (1, None, "a"), (2, None, None)], SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    for frame in (empty, good.limit(0), good.filter("k > 99")):
        with pytest.raises(ValueError, match="training"):
            _prepare(spark, frame)
        with pytest.raises(ValueError, match="test"):
            _prepare(spark, good, frame)
    with pytest.raises(TypeError, match="'question': 2, 'answer': 1"):
        _prepare(spark, bad)
    with pytest.raises(TypeError, match="nulls"):
        _prepare(spark, good, bad)


def test_rows_that_a_limit_drops_are_checked_too(spark):
    rows = spark.createDataFrame([(i, "q" * i, "a") for i in range(9)] + [(9, "q" * 50, None)], SCHEMA)
    with pytest.raises(TypeError):
        _prepare(spark, rows, question_limit=8)


def test_the_write_is_the_only_read(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = spark.range(40).select(F.col("id").alias("k"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    df, seen = clean.observed(rows.mapInArrow(count, SCHEMA))
    assert materialize(df, "seen").count() == 40
    clean.require_observed(seen, "training")
    assert seen.get == {"n_rows": 40, "null_question": 0, "null_answer": 0} and reads.value == 40
