"""Which texts need a join: told apart by groups of keys, without a shuffle of the texts."""

from pyspark.sql import functions as F

from textpairs.llm import exchange


def split(docs, keys, *on):
    maybe, rest = exchange.split_by_key(docs, keys, *on)
    assert maybe.columns == rest.columns == docs.columns
    return sorted(map(tuple, maybe.collect()), key=repr), sorted(map(tuple, rest.collect()), key=repr)


def test_many_keys_still_tell_texts_apart(spark):
    """The keys that meet a text's group by chance are few, so the texts that are shuffled are about those that have to be."""
    docs = spark.range(4000).select(F.col("id"), F.concat(F.lit("k"), "id").alias("k"))
    keys = spark.range(3600, 400000).select(F.concat(F.lit("k"), "id").alias("key"))
    maybe, rest = split(docs, keys, "k", "key")
    assert len(maybe) + len(rest) == 4000 and {(i, f"k{i}") for i in range(3600, 4000)} <= set(maybe)
    assert len(maybe) < 400 + 0.1 * 3600


def test_every_group_of_a_row_is_told(spark):
    """All bits of a broadcast row, the sign among them."""
    docs = spark.range(3000).select("id")
    maybe, rest = split(docs, docs.filter("id % 2 = 0").withColumnRenamed("id", "key"), "id", "key")
    assert {(i,) for i in range(0, 3000, 2)} <= set(maybe) and len(maybe) < 1510 and len(maybe) + len(rest) == 3000


def test_equal_texts_of_other_documents_are_no_candidates(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a"), (None, "b"), (3, None), (1, "a")], "id long, text string").withColumn("key", F.xxhash64("text"))
    gone = docs.filter("id = 2 or (id is null and text = 'a') or id = 3").select(F.col("id").alias("i"), F.col("key").alias("k"))
    maybe, rest = split(docs, gone, ["id", "key"], ["i", "k"])
    assert {r[:2] for r in maybe} == {(2, "a"), (None, "a"), (3, None)} and [r[:2] for r in rest] == [(1, "a"), (1, "a"), (None, "b")]
    left = exchange.without(docs.select("id", "text"), gone.select(F.col("i").alias("id"), F.col("k").alias("tkey")), "id", "text")
    assert left.columns == ["id", "text"] and sorted(map(tuple, left.collect()), key=repr) == [(1, "a"), (1, "a"), (None, "b")]
    assert [len(x) for x in split(docs, gone.limit(0), ["id", "key"], ["i", "k"])] == [0, 6]


def test_texts_that_go_are_not_shuffled(spark, monkeypatch):
    docs = spark.range(1200).selectExpr("nullif(id, 7) as id", "concat('text ', id % 900) as text")
    gone = docs.filter("id % 4 = 0 or id is null").select("id", F.xxhash64("text").alias("tkey"))
    want = sorted(map(tuple, docs.filter("id % 4 > 0").collect()))
    joined, real = [], exchange.split_by_key
    monkeypatch.setattr(exchange, "split_by_key", lambda *a, **k: joined.append(real(*a, **k)) or joined[-1])
    assert sorted(map(tuple, exchange.without(docs, gone, "id", "text").collect())) == want
    assert joined[-1][0].count() < 30
    monkeypatch.setattr(exchange, "GROUPS", 100)
    assert sorted(map(tuple, exchange.without(docs, gone, "id", "text").collect())) == want
    assert 300 < joined[-1][0].count() < 1200
