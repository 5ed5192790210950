"""Ranks in an order: the size of the sort follows the rows, not the optimizer's guess at a join."""

from textpairs.operators import rank


def test_a_join_is_sorted_in_few_partitions(spark, monkeypatch):
    used = []
    real = rank._range_partitions
    monkeypatch.setattr(rank, "_range_partitions", lambda df: used.append(real(df)) or used[-1])
    a, b = (spark.range(200000).selectExpr("id AS k", f"id * 2 AS {c}") for c in "ab")
    got = rank.ordered_rank(a.join(b, "k").filter("k % 1000 = 7"), ["k"]).collect()
    assert used == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    assert [(r.k, r.a) for r in sorted(got, key=lambda r: r["rank"])] == [(k, 2 * k) for k in range(7, 200000, 1000)]
    assert sorted(r["rank"] for r in got) == list(range(200))
