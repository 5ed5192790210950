"""Cached encoded rows (SRC10, SNK2, PIP2): no row depends on what the cache holds."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from textpairs.operators import vocab
from textpairs.plans import flows
from textpairs.sources import files

SCHEMA = "k long, question string, answer string"


def _rows(n, shift=0):
    return [(i, f"q{i}", f"a{i + shift}") for i in range(n)]


def test_prepare_keeps_rows_that_the_cache_lacks(spark, tmp_path):
    """Twenty cached rows, then 25 of which five are among them with other answers: 25 come out, with today's ids."""
    path = str(tmp_path / "run")
    old = spark.createDataFrame(_rows(20), SCHEMA)
    new = spark.createDataFrame([(i, f"q{i}", f"a{i + 1}") for i in range(15, 40)], SCHEMA)
    voc = vocab.build_vocab(old.unionByName(new))
    flows.prepare(old, None, keys=["k"], save_path=path, vocab_df=voc)
    got = flows.prepare(new, None, keys=["k"], load_path=path)
    want = flows.prepare(new, None, keys=["k"], vocab_df=voc)
    rows = lambda x: sorted((r["k"], r["batch_id"], r["questions"], r["answers"]) for r in x.collect())
    assert got["train"].count() + got["val"].count() == 25 and got["dropped"] == 0
    assert rows(got["train"]) == rows(want["train"]) and rows(got["val"]) == rows(want["val"])
    assert {(r["table"], r["state"]): r["rows"] for r in got["cache"].collect()} == {("train", "changed"): 5, ("train", "new"): 20, ("train", "gone"): 15}


def test_test_rows_from_the_cache_too(spark, tmp_path):
    path = str(tmp_path / "run")
    train, test = spark.createDataFrame(_rows(30), SCHEMA), spark.createDataFrame(_rows(9), SCHEMA)
    flows.prepare(train, test, keys=["k"], save_path=path)
    more = spark.createDataFrame(_rows(12), SCHEMA)
    got = flows.prepare(train, more, keys=["k"], load_path=path)
    assert sorted(r["k"] for r in got["test"].collect()) == list(range(12))
    report = {(r["table"], r["state"]): r["rows"] for r in got["cache"].collect()}
    assert report == {("train", "reused"): 30, ("test", "reused"): 9, ("test", "new"): 3}


def test_null_and_repeated_keys(spark):
    voc = vocab.Vocabulary(("<unk>", "<eos>", "<bos>", "<pad>", "a", "b"))
    old = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (None, "b", None), (2, "a", "a"), (2, "b", "b")], SCHEMA)
    cached = vocab.encode_columns(old, voc).withColumn(files.ROW_FP, files.row_fingerprint(("question", "answer"))).select("k", "question_ids", "answer_ids", files.ROW_FP)
    now = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (None, "b", None), (None, None, "b"), (2, "b", "b"), (3, "", None)], SCHEMA)
    got = files.reuse_encoded(now, cached, ["k"], voc)
    assert got.columns == ["k", "question", "answer", "question_ids", "answer_ids", "cached_state"]
    plain = lambda d: sorted(((r.k, r.question, r.answer, r.question_ids, r.answer_ids) for r in d.collect()), key=repr)
    assert plain(got) == plain(vocab.encode_columns(now, voc))
    states = sorted((repr(r.k), repr(r.question), r.cached_state) for r in got.collect())
    assert states == [("1", "'a'", "reused"), ("1", "'a'", "reused"), ("2", "'b'", "reused"), ("3", "''", "new"), ("None", "'b'", "reused"), ("None", "None", "changed")]
    assert {r.state: r.rows for r in files.cache_report(got, cached, ["k"]).collect()} == {"reused": 4, "changed": 1, "new": 1}
    empty = now.filter("false")
    assert files.reuse_encoded(empty, cached, ["k"], voc).count() == 0
    assert {r.state: r.rows for r in files.cache_report(files.reuse_encoded(now, cached.filter("false"), ["k"], voc), cached.filter("false"), ["k"]).collect()} == {"new": 6}


def test_cached_ids_are_read_not_made(spark, tmp_path):
    """A cached row's ids come from the cache: ids put there by hand come out."""
    voc = vocab.Vocabulary(("<unk>", "<eos>", "<bos>", "<pad>", "a", "b"))
    now = spark.createDataFrame([(1, "a", "b")], SCHEMA)
    marked = now.select("k", F.array(F.lit(7)).alias("question_ids"), F.array(F.lit(8)).alias("answer_ids"), files.row_fingerprint(("question", "answer")).alias(files.ROW_FP))
    r = files.reuse_encoded(now, marked, ["k"], voc).first()
    assert (r.question_ids, r.answer_ids) == ([7], [8])


def test_fingerprints_and_digest(spark):
    cells = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("ab", None), ("b", "a"), (None, None), ("", "")]
    df = spark.createDataFrame(cells, "question string, answer string")
    fps = [r[0] for r in df.select(files.row_fingerprint(("question", "answer"))).collect()]
    assert len(set(fps)) == len(cells)
    d = files.table_digest(df, ["question", "answer"])
    assert d == files.table_digest(df.orderBy(F.desc("answer")).repartition(5), ["question", "answer"]) and d[0] == 8
    assert d != files.table_digest(df.union(df.limit(1)), ["question", "answer"])
    assert files.table_digest(df.filter("false"), ["question", "answer"]) == (0, 0)


def test_each_side_of_the_reuse_is_exchanged_once(spark):
    """Ids cross one exchange on their way to the rows and are not gathered into sets."""
    voc = vocab.Vocabulary(("<unk>", "<eos>", "<bos>", "<pad>", "a", "b"))
    now = spark.createDataFrame([(1, "a", "b")], SCHEMA)
    cached = vocab.encode_columns(now, voc).withColumn(files.ROW_FP, files.row_fingerprint(("question", "answer"))).select("k", "question_ids", "answer_ids", files.ROW_FP)
    both = files.reuse_encoded(now, cached, ["k"], voc).drop("cached_state")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_texts_are_ranked_and_a_part_joins_its_part_of_the_cache(spark, tmp_path):
    df = spark.createDataFrame(_rows(60) + [(None, "n", "n"), (None, "n", "n"), (7, "other", None)], SCHEMA)
    path = str(tmp_path / "run")
    out = flows.prepare(df, None, keys=["k"], strict=False, save_path=path)
    plan = out["val"]._jdf.queryExecution().executedPlan().toString()
    ranked = plan[plan.index("Window [row_number()") :]
    assert "question_ids" not in ranked[: ranked.index("SortAggregate")]  # only texts are exchanged for the ranks
    assert ranked[ranked.index("SortAggregate") :].count("struct(__h")  # the cache is filtered by the split
    voc = out["vocabulary"]
    want = {(r.k, r.question): (r.question_ids, r.answer_ids) for r in vocab.encode_columns(df, voc).collect()}
    got = out["train"].unionByName(out["val"]).collect()
    assert len(got) == 63 and all((r.question_ids, r.answer_ids) == want[r.k, r.question] for r in got)
    assert {r.state: r.rows for r in out["cache"].collect()} == {"reused": 63}


def test_characters_are_counted_by_slices(spark, monkeypatch):
    texts = ["", None, "aé\U0001f600a", "b" * 9, "\x00́", "é"]
    df = spark.createDataFrame([(t, "b" if t is None else None) for t in texts], "question string, answer string")
    want = Counter("".join(t or "" for t in texts) + "b")
    assert {r.token: r.freq for r in vocab.char_freq(df.coalesce(1)).collect()} == want
    assert "Generate" not in vocab.char_freq(df)._jdf.queryExecution().executedPlan().toString()  # no row a character
    monkeypatch.setattr(vocab, "COUNT_BYTES", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["x", *texts]).slice(1)], names=["question"])
    (got,) = vocab._count_chars([batch, batch.slice(0, 0)])
    want["b"] -= 1
    assert dict(zip(got["token"].to_pylist(), got["freq"].to_pylist())) == want


def test_ids_are_exchanged_as_bytes(spark):
    for width, top in ((1, 255), (2, 65_535), (4, 1_114_115)):
        rows = [([0, top, 3],), ([],), (None,), ([1],), (list(range(200)),)]
        df = spark.createDataFrame(rows, "ids array<int>").coalesce(1)
        packed = df.select("ids", vocab.pack_ids(F.col("ids"), width).alias("p")).filter("ids is null or size(ids) <> 1")
        got = packed.select("ids", "p", vocab.unpack_ids(F.col("p"), width).alias("back")).collect()
        assert [(r.ids, r.back) for r in got] == [(x, x) for (x,) in rows if x != [1]]
        assert [r.p and len(r.p) for r in got] == [3 * width, b"", None, 200 * width]
    assert [vocab.id_bytes(n) for n in (4, 256, 257, 65_536, 65_537)] == [1, 1, 2, 2, 4]
    try:
        spark.createDataFrame([([256],)], "ids array<int>").select(vocab.pack_ids(F.col("ids"), 1)).collect()
    except Exception as e:
        assert "found 256" in str(e)
    else:
        raise AssertionError("an id was cut")


def test_batches_from_the_cache_are_made_behind_the_exchange(spark, tmp_path):
    df = spark.createDataFrame(_rows(60), SCHEMA)
    path = str(tmp_path / "run")
    out = flows.prepare(df, None, keys=["k"], strict=False, save_path=path, written=True)
    assert not any("prepare-train" in f for f in out["split"].inputFiles())
    plan = out["train"].select("k", "batch_id", "questions", "answers")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Window [max")]
    assert above.count("unpack") == 2 and "unpack" not in plan[len(above) :]
    want = flows.prepare(df, None, keys=["k"], strict=False, vocab_df=out["vocab"])
    assert out["train"].columns == want["train"].columns and out["train"].dtypes == want["train"].dtypes
    cells = lambda d: sorted(map(tuple, d.collect()))
    assert cells(out["train"]) == cells(want["train"])
