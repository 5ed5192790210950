"""What a Python worker holds at once: few ids for a model, and the memory of a question once."""

import numpy as np
from pyspark.sql import functions as F

from textpairs.operators import decode, evaluate, vocab


def test_a_model_gets_few_ids_at_a_time(spark):
    df = spark.range(0, 120, 1, 1).select("id", F.array_repeat(F.lit(5), 100_000).alias("questions"), F.lit(1).alias("max_len"))

    def make_predictor():
        return lambda ids, max_lens: [[sum(map(len, ids))] for _ in ids]

    got = evaluate.batch_predict(df, make_predictor, ["id"]).collect()
    assert sorted(r.id for r in got) == list(range(120))
    assert max(r.pred_ids[0] for r in got) <= evaluate.CELLS  # not 12,000,000


def test_slices_are_whole_and_bounded():
    sizes = np.array([3, 0, 9, 1, 1, 1, 0, 20, 0])
    cuts = list(evaluate.bounded_slices(sizes, 5, 3))
    assert [i for lo, hi in cuts for i in range(lo, hi)] == list(range(9))
    assert all(hi - lo <= 3 and (sizes[lo:hi].sum() <= 5 or hi - lo == 1) for lo, hi in cuts)
    assert list(evaluate.bounded_slices(np.array([], int), 5)) == []


def test_a_question_is_decoded_once(spark, monkeypatch):
    kept = []
    real = decode.materialize
    monkeypatch.setattr(decode, "materialize", lambda df, name: kept.append(real(df, name)) or kept[-1])
    train = spark.createDataFrame([(f"q{i % 2}", "abc" * (i + 1)) for i in range(4)], "question string, answer string")
    voc = vocab.Vocabulary.from_df(vocab.build_vocab(train))
    ask = spark.createDataFrame([(i, f"q{i % 2}" if i % 3 else None, i % 17) for i in range(300)], "k long, question string, max_len int")
    got = {r.k: r.pred_ids for r in decode.CountedModel(train, voc).decode(ask, ["k"]).collect()}
    assert len(got) == 300 and all(len(p) == k % 17 for k, p in got.items())
    assert all(got[k] == got[k + 6 * 17 * 1][: k % 17] for k in range(100))
    assert kept[0].count() == 3  # two questions and none; 300 rows
