"""PIP2 (prepare) and PIP3 (evaluate_greedy) end to end on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpairs.functions import arrays as A
from textpairs.operators import batching, clean, rank, vocab
from textpairs.plans import flows
from textpairs.sources import files


def _frames(spark):
    train = spark.createDataFrame(
        [(i, f"{i}+{i}=", str(2 * i)) for i in range(150)] + [(999, "x" * 300, "too long")],
        "k long, question string, answer string",
    )
    test = spark.createDataFrame([(i, f"{i}*2=", str(2 * i)) for i in range(40)], "k long, question string, answer string")
    return train, test


def test_prepare_splits_batches_and_pads(spark, tmp_path):
    train, test = _frames(spark)
    whole = flows.prepare(train, test, keys=["k"], vocab_df=vocab.build_vocab(train))
    assert whole["dropped"] == 0 and whole["train"].count() + whole["val"].count() == 151  # nothing is cut unasked
    out = flows.prepare(train, test, keys=["k"], save_path=str(tmp_path / "p"), question_limit=200, answer_limit=201)
    assert out["dropped"] == 1
    tr, va, te = out["train"].collect(), out["val"].collect(), out["test"].collect()
    assert len(tr) == 150 * 4 // 5 and len(va) == 150 - 150 * 4 // 5
    assert not ({r["k"] for r in tr} & {r["k"] for r in va})
    assert 999 not in {r["k"] for r in tr + va}  # over the length budget
    assert sorted(r["k"] for r in te) == list(range(40))
    # test keeps key order
    assert [r["k"] for r in sorted(te, key=lambda r: (r["batch_id"], r["pos_in_batch"]))] == list(range(40))
    for rows in (tr, va, te):
        for r in rows:
            assert r["questions"][0] == A.BOS
    voc = out["vocabulary"]
    assert voc.itos[:4] == A.SPECIALS
    e1 = flows.epoch_batches(out, ["k"], epoch=1).collect()
    assert sorted(r["k"] for r in e1) == sorted(r["k"] for r in tr)
    order0 = [r["k"] for r in sorted(tr, key=lambda r: (r["batch_id"], r["pos_in_batch"]))]
    order1 = [r["k"] for r in sorted(e1, key=lambda r: (r["batch_id"], r["pos_in_batch"]))]
    assert order0 != order1
    with pytest.raises(ValueError):
        clean.require_columns(train.drop("answer"), ["question", "answer"])


def test_evaluate_greedy_with_a_caller_model(spark):
    train, test = _frames(spark)
    out = flows.prepare(train, test, keys=["k"], vocab_df=vocab.build_vocab(train))

    # a perfect model for answers: looks them up by question (small test table, built on the driver)
    pairs = {tuple(r["questions"]): r["answers"] for r in out["test"].select("questions", "answers").collect()}

    def make_oracle_model():
        def predict(questions, max_lens):
            return [np.asarray(pairs[tuple(q)])[: int(n)] for q, n in zip(questions, max_lens)]

        return predict

    res = flows.evaluate_greedy(out["test"], ["k"], make_oracle_model, fraction=1.0, voc=out["vocabulary"])
    acc = res["accuracy"].first()
    assert acc["n"] == 40 and acc["matches"] == 40 and acc["accuracy"] == 1.0
    assert res["n_batches"] == 2 and res["used_batches"] == 2
    ex = res["examples"].collect()
    assert len(ex) == 2 and all(e["predicted_text"].startswith("<bos>") for e in ex)
    half = flows.evaluate_greedy(out["test"], ["k"], make_oracle_model, fraction=0.5)
    assert half["accuracy"].first()["n"] == 32
    none = flows.evaluate_greedy(out["test"], ["k"], make_oracle_model, fraction=0.0)
    assert none["accuracy"].first()["accuracy"] is None


def test_prepare_strict_checks(spark):
    train, test = _frames(spark)
    with pytest.raises(ValueError):
        flows.prepare(train.limit(0), test, keys=["k"], vocab_df=vocab.build_vocab(train))
    with pytest.raises(ValueError, match="load_path"):
        flows.prepare(train, test, keys=["k"])
    with_null = train.union(spark.createDataFrame([(5000, "q", None)], train.schema))
    with pytest.raises(TypeError):
        flows.prepare(with_null, test, keys=["k"], vocab_df=vocab.build_vocab(train))


def test_collate_extra_columns(spark):
    df = spark.createDataFrame([(0, 0, [2, 5, 1], [2, 1])], "batch_id long, k long, question_ids array<int>, answer_ids array<int>")
    out = batching.make_batches(df, extra_cols=[F.size("question_ids").alias("q_len")]).first()
    assert out["q_len"] == 3 and out["questions"] == [2, 5, 1]


def test_prepare_saves_and_loads_vocabulary(spark, tmp_path):
    train, test = _frames(spark)
    saved = flows.prepare(train, None, keys=["k"], save_path=str(tmp_path / "run"))
    loaded = flows.prepare(train, None, keys=["k"], load_path=str(tmp_path / "run"))
    assert loaded["vocabulary"] == saved["vocabulary"]
    rows = lambda x: sorted((r["k"], r["batch_id"], r["questions"], r["answers"]) for r in x.collect())
    assert rows(loaded["train"]) == rows(saved["train"]) and rows(loaded["val"]) == rows(saved["val"])
    other = vocab.build_vocab(train.limit(3))
    files.write_vocab(other, str(tmp_path / "run" / "vocab"))
    with pytest.raises(ValueError, match="different vocabulary"):
        flows.prepare(train, None, keys=["k"], load_path=str(tmp_path / "run"))


def test_encoding_after_the_batch_shuffle(spark):
    train, _ = _frames(spark)
    voc = vocab.Vocabulary.from_df(vocab.build_vocab(train))
    ranked = rank.batch_ids(rank.hash_rank(train, ["k"]), batch_size=32)
    late = batching.encode_batches(ranked, voc)
    early = batching.make_batches(vocab.encode_columns(ranked, voc))
    rows = lambda x: sorted((r["k"], r["questions"], r["answers"]) for r in x.collect())
    assert rows(late) == rows(early)
    plan = batching.encode_batches(ranked, voc)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [max(") == 1  # both maxima in one pass
    below = plan[plan.index("hashpartitioning(batch_id") :]
    assert "_ids" not in below and "question" in below  # texts travel, ids are made after


def test_vocabulary_fit_on_train_rows_only(spark, tmp_path):
    rows = [(i, f"q{i}", "a") for i in range(100)] + [(1000 + i, "Z", "Z") for i in range(5)]
    df = spark.createDataFrame(rows, "k long, question string, answer string")
    split = {r["k"]: r["split"] for r in rank.exact_split(df, ["k"]).collect()}
    z_in_train = any(split[1000 + i] == "train" for i in range(5))
    out = flows.prepare(df, None, keys=["k"], fit_on="train", save_path=str(tmp_path / "a"))
    assert ("Z" in out["vocabulary"].itos) == z_in_train
    both = flows.prepare(df, None, keys=["k"], save_path=str(tmp_path / "b"))
    assert "Z" in both["vocabulary"].itos
