"""Greedy decoding (PIP3, SRT7, UDF1): step by step, and with a model counted from training rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpairs.fixed import BOS, EOS
from textpairs.operators import decode, evaluate, vocab
from textpairs.plans import flows

SCHEMA = "k long, question string, answer string"


def brute(train, voc, question, max_len):
    """One answer by the plain rule: the most frequent follower in the first context that training has."""
    stoi = voc.stoi()
    memory, two, one = {}, {}, {}
    for q, a in train:
        if a is None:
            continue
        ids = [BOS, *[stoi.get(c, 0) for c in a], EOS]
        for i in range(1, len(ids)):
            memory.setdefault((q, i, ids[i - 1]), Counter())[ids[i]] += 1
            two.setdefault((ids[i - 2] if i > 1 else -1, ids[i - 1]), Counter())[ids[i]] += 1
            one.setdefault(ids[i - 1], Counter())[ids[i]] += 1
    out, before = [BOS], -1
    while len(out) < max_len:
        prev = out[-1]
        found = memory.get((question, len(out), prev)) if question is not None else None
        found = found or two.get((before, prev)) or one.get(prev)
        before = prev
        out.append(min(found, key=lambda x: (-found[x], x)) if found else EOS)
    return out[: max(0, max_len)]


def _pairs(n=60):
    rng = np.random.default_rng(3)
    words = ["ab", "abc", "b", "ca", "é", ""]
    return [(int(i), f"q{int(rng.integers(0, 9))}", " ".join(words[j] for j in rng.integers(0, 6, int(rng.integers(0, 7))))) for i in range(n)]


def test_counted_model_equals_brute_force(spark):
    rows = _pairs() + [(100, "q1", None), (101, None, "abc"), (102, "", "x")]
    train = spark.createDataFrame(rows, SCHEMA)
    voc = vocab.Vocabulary.from_df(vocab.build_vocab(train))
    ask = [(i, q, n) for i, (q, n) in enumerate([("q1", 12), ("q2", 1), ("q3", 40), ("new", 9), (None, 5), ("", 4), ("q1", 0), ("q4", None), ("q1", 12)])]
    got = decode.CountedModel(train, voc).decode(spark.createDataFrame(ask, "k long, question string, max_len int"), ["k"])
    plain = [(q, a) for _, q, a in rows]
    assert {r.k: r.pred_ids for r in got.collect()} == {k: brute(plain, voc, q, n or 0) for k, q, n in ask}


def test_a_known_question_gets_its_answer(spark):
    rows = [(i, f"{i}+{i}=", str(2 * i)) for i in range(50)]
    train = spark.createDataFrame(rows, SCHEMA)
    prep = flows.prepare(train, train, keys=["k"], vocab_df=vocab.build_vocab(train))
    out = flows.decode_batches(prep["test"], ["k"], decode.CountedModel(train, prep["vocabulary"]))
    assert evaluate.accuracy(out).first().accuracy == 1.0
    assert out.filter(F.size("pred_ids") != F.size("answers")).count() == 0


def test_few_rows_side_by_side_and_few_contexts(spark, monkeypatch):
    rows = _pairs()
    train = spark.createDataFrame(rows, SCHEMA)
    voc = vocab.Vocabulary.from_df(vocab.build_vocab(train))
    ask = spark.createDataFrame([(i, q, 15) for i, q, _ in rows], "k long, question string, max_len int")
    whole = sorted(map(tuple, decode.CountedModel(train, voc).decode(ask, ["k"]).collect()))
    monkeypatch.setattr(decode, "ROWS", 3)
    assert sorted(map(tuple, decode.CountedModel(train, voc).decode(ask, ["k"]).collect())) == whole
    monkeypatch.setattr(decode, "PAIR_CONTEXTS", 2)
    small = decode.CountedModel(train, voc)
    assert len(small.contexts["two"]) == 2 and small.decode(ask, ["k"]).count() == len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    voc = vocab.Vocabulary(("<unk>", "<eos>", "<bos>", "<pad>", "a"))
    model = decode.CountedModel(none, voc)
    ask = spark.createDataFrame([(1, "a", 3)], "k long, question string, max_len int")
    assert [r.pred_ids for r in model.decode(ask, ["k"]).collect()] == [[BOS, EOS, EOS]]
    assert model.decode(ask.filter("false"), ["k"]).count() == 0


def test_step_predictor_takes_max_len_minus_one_steps(spark):
    """A model of logits: the next id is the number of ids so far, ties to the smallest."""
    calls = []

    def make_step():
        def step(questions, prefixes):
            calls.append(prefixes.shape)
            logits = np.zeros((len(questions), 9))
            logits[:, prefixes.shape[1] + 1 : prefixes.shape[1] + 3] = 1.0
            return logits

        return step

    predict = decode.step_predictor(make_step)()
    assert predict([np.array([2, 1])] * 4, np.array([4, 1, 2, 0])) == [[BOS, 2, 3, 4], [BOS], [BOS, 2], []]
    assert calls == [(2, 1), (1, 2), (1, 3)]


@pytest.mark.parametrize("fraction", [0.5, 1.0])
def test_step_predictor_in_evaluate_greedy(spark, fraction):
    rows = [(i, "ab", "ab") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    prep = flows.prepare(df, df, keys=["k"], vocab_df=vocab.build_vocab(df))

    def make_step():
        def step(questions, prefixes):  # copies the question
            logits = np.zeros((len(questions), 10))
            for i, q in enumerate(questions):
                logits[i, q[min(prefixes.shape[1], len(q) - 1)]] = 1
            return logits

        return step

    res = flows.evaluate_greedy(prep["test"], ["k"], decode.step_predictor(make_step), fraction)
    assert res["accuracy"].first().accuracy == 1.0
