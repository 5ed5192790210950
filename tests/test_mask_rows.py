"""Masks of all training rows, one mask row at a time."""

from hashlib import md5

import __spark_entry__ as se
from textpairs.functions import arrays as A
from textpairs.operators.batching import mask_bits
from tests.conftest import SMALL


def test_mask_rows_and_digest_equal_the_matrix(spark):
    df = spark.createDataFrame([([2, 5, 6, 1, 3, 3],), ([2, 1],), ([3],), ([],)], "a array<int>")
    shifted = A.shift_mask(A.trg_mask("a"))
    for r in df.select(
        A.trg_mask_rows("a").alias("rows"), mask_bits(A.trg_mask("a")).alias("matrix"), A.trg_mask_digest("a").alias("digest"),
        A.trg_mask_rows(A.shift_input("a")).alias("s_rows"), mask_bits(shifted).alias("s_matrix"),
    ).collect():
        assert r.rows == r.matrix and r.s_rows == r.s_matrix
        assert r.digest == md5("".join(md5(x.encode()).hexdigest() for x in r.matrix).encode()).hexdigest()


def test_mask_queries_keep_every_training_row(spark):
    q = se.queries()
    n = q["shuffle_batches"](spark, SMALL).count()
    assert q["shifted_mask"](spark, SMALL).count() < n
    for name in ("trg_mask_digest", "shifted_mask_compact", "shifted_mask_digest"):
        assert q[name](spark, SMALL).count() == n
