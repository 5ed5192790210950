"""Digests of mask rows: shared by rows of one length, the same for any row."""

from hashlib import md5 as real_md5

from textpairs.functions import arrays as A
from textpairs.operators.batching import mask_bits


def test_odd_rows_equal_the_matrix(spark):
    rows = [[2, 3, 6, 1], [3, 3], [2, None, 3, 5], [2, None, 1, 3], [None], [], None, [2, 1], [2, 1, 3], [2, 5, 1], [3, 2, 3]]
    df = spark.createDataFrame([(r,) for r in rows], "a array<int>").coalesce(1)
    for r in df.select("a", mask_bits(A.trg_mask("a")).alias("m"), A.trg_mask_digest("a").alias("d")).collect():
        assert r.d == (None if r.m is None else real_md5("".join(real_md5(x.encode()).hexdigest() for x in r.m).encode()).hexdigest())


def test_rows_of_one_length_share_their_mask_rows(monkeypatch):
    made = []

    class Counted:
        def __init__(self, state=None):
            self.state = state or real_md5()

        def update(self, x):
            self.state.update(x)

        def copy(self):
            made.append(1)
            return Counted(self.state.copy())

        def hexdigest(self):
            return self.state.hexdigest()

    monkeypatch.setattr(A, "md5", Counted)
    monkeypatch.setattr(A, "_ROW_DIGESTS", A.OrderedDict())
    got = [A._mask_digest(300, v, None) for v in range(301)]
    assert len(made) == 301  # not 301 x 300
    monkeypatch.setattr(A, "DIGEST_CACHE_BYTES", 0)
    monkeypatch.setattr(A, "md5", real_md5)
    for v in (300, 7, 0):
        assert A._mask_digest(300, v, None) == A._mask_digest(300, v, "1" * v + "0" * (300 - v)) == got[v]
        A._mask_digest(5, 2, None)
        assert list(A._ROW_DIGESTS) == [5]
