"""Property tests: encoding, splits, ranks, batches, masks, scores, attention."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpairs.functions import arrays as A
from textpairs.functions.text import WHITESPACE, chars, strip
from textpairs.operators import batching, clean, evaluate, rank, vectors, vocab

TEXTS = ["abc", "", "é", "é", "😀x", "a b\tc", "Zz"]


def _qa(spark, texts):
    return spark.createDataFrame([(i, t, None if t is None else t[::-1]) for i, t in enumerate(texts)], "k long, question string, answer string")


def test_chars_and_strip(spark):
    df = spark.createDataFrame([(t,) for t in ["é", "é", "😀", ""]], "t string")
    got = [(r["n"], r["c"]) for r in df.select(F.length("t").alias("n"), chars("t").alias("c")).collect()]
    assert got == [(1, ["é"]), (2, ["e", "́"]), (1, ["😀"]), (0, [])]
    s = WHITESPACE + "x y" + WHITESPACE
    assert spark.range(1).select(strip(F.lit(s))).first()[0] == s.strip() == "x y"
    assert len(WHITESPACE) == 29


def test_vocab_order_and_round_trip(spark):
    df = _qa(spark, TEXTS)
    v = vocab.build_vocab(df)
    rows = v.orderBy("id").collect()
    assert [r["token"] for r in rows[:4]] == list(A.SPECIALS)
    freqs = [(-r["freq"], r["token"]) for r in rows[4:]]
    assert freqs == sorted(freqs)
    voc = vocab.Vocabulary.from_df(v)
    assert vocab.Vocabulary.from_freq(vocab.char_freq(df)) == voc
    enc = vocab.encode_columns(df, voc)
    out = enc.select("question", voc.decode("question_ids").alias("d"), F.size("question_ids").alias("n"),
                     voc.decode("question_ids", strip_special=True).alias("s")).collect()
    for r in out:
        assert r["d"] == "<bos>" + r["question"] + "<eos>"
        assert r["n"] == len(r["question"]) + 2
        assert r["s"] == r["question"]


def test_oov_goes_to_unk_and_join_path_agrees(spark):
    train = _qa(spark, ["ab"])
    voc = vocab.Vocabulary.from_df(vocab.build_vocab(train))
    test = _qa(spark, ["abz😀", "", None])
    inline = {r["k"]: r["question_ids"] for r in vocab.encode_columns(test, voc).collect()}
    assert inline[0][0] == A.BOS and inline[0][-1] == A.EOS and inline[0][3:5] == [A.UNK, A.UNK]
    assert inline[1] == [A.BOS, A.EOS]
    assert inline[2] is None
    joined = vocab.encode_by_join(test, vocab.build_vocab(train), ["k"], "question", "question_ids")
    assert {r["k"]: r["question_ids"] for r in joined.collect()} == inline


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_exact_split_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    s = rank.exact_split(df, ["k"], seed=7, digits=2)
    got = {r["k"]: r["split"] for r in s.collect()}
    assert len(got) == n
    order = sorted(range(n), key=lambda k: (hashlib.md5(f"7|{k}".encode()).hexdigest(), k))
    k_train = n * 4 // 5
    assert {k for k, v in got.items() if v == "train"} == set(order[:k_train])


def test_split_independent_of_partitioning(spark):
    base = spark.range(500).withColumnRenamed("id", "k")
    results = []
    for parts in (1, 3, 17):
        s = rank.exact_split(base.repartition(parts), ["k"], seed=3)
        results.append(sorted((r["k"], r["split"]) for r in s.collect()))
    assert results[0] == results[1] == results[2]


def test_hash_rank_and_ordered_rank(spark):
    df = spark.range(300).withColumnRenamed("id", "k").repartition(5)
    hr = {r["k"]: r["rank"] for r in rank.hash_rank(df, ["k"], seed=1, epoch=2, digits=2).collect()}
    order = sorted(range(300), key=lambda k: (hashlib.md5(f"1|2|{k}".encode()).hexdigest(), k))
    assert hr == {k: i for i, k in enumerate(order)}
    two = spark.createDataFrame([(a, b) for a in range(20) for b in range(15)], "a long, b long").repartition(7)
    orr = rank.ordered_rank(two, ["a", "b"], partitions=4).collect()
    assert sorted((r["rank"], r["a"], r["b"]) for r in orr) == [(i, a, b) for i, (a, b) in enumerate((a, b) for a in range(20) for b in range(15))]


def test_batches_pad_and_masks(spark):
    texts = [("x" * (i % 9)) for i in range(70)]
    df = _qa(spark, texts)
    voc = vocab.Vocabulary.from_df(vocab.build_vocab(df))
    ranked = rank.batch_ids(rank.hash_rank(vocab.encode_columns(df, voc), ["k"]), batch_size=32)
    b = batching.make_batches(ranked, with_masks=True)
    rows = b.collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["batch_id"], []).append(r)
    assert sorted(len(v) for v in sizes.values()) == [6, 32, 32]
    for members in sizes.values():
        lens = {len(r["questions"]) for r in members}
        assert len(lens) == 1
        mx = max(len(r["question_ids"]) for r in members)
        for r in members:
            assert r["questions"].count(A.PAD) == mx - len(r["question_ids"])
            assert r["questions_mask"] == [x != A.PAD for x in r["questions"]]
            m = r["answers_mask"]
            L = len(r["answers"])
            assert len(m) == L and all(len(row) == L for row in m)
            assert all(not m[i][j] for i in range(L) for j in range(L) if j > i)
            assert all(m[i][j] == (r["answers"][j] != A.PAD) for i in range(L) for j in range(i + 1))
    tf = batching.teacher_forcing(b).first()
    assert tf["decoder_input"] == tf["answers"][:-1] and tf["target"] == tf["answers"][1:]
    assert tf["decoder_mask"] == [row[:-1] for row in tf["answers_mask"][:-1]]


def test_exact_match_rules(spark):
    df = spark.createDataFrame(
        [([2, 5, 1, 3], [2, 5, 1, 9]), ([2, 5, 1], [2, 6, 1]), ([2, 5], [2, 5, 1]), ([2, 4], [2, 4])],
        "t array<int>, p array<int>",
    )
    assert [r[0] for r in df.select(A.exact_match("t", "p")).collect()] == [True, False, False, True]


def test_argmax_softmax_xent(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -1.0], 2)], "l array<double>, t int")
    r = df.select(A.argmax("l").alias("a"), A.softmax("l").alias("s"), A.cross_entropy_at("l", "t").alias("x")).first()
    assert r["a"] == 1
    assert math.isclose(sum(r["s"]), 1.0, rel_tol=1e-12)
    lse = math.log(sum(math.exp(v) for v in [1.0, 3.0, 3.0, -1.0]))
    assert math.isclose(r["x"], lse - 3.0, rel_tol=1e-12)
    all_pad = spark.createDataFrame([([0.0, 1.0], 3)], "l array<double>, t int")
    assert evaluate.masked_cross_entropy(all_pad, "l", "t").first()["loss"] is None


def _emb(spark, n_groups=3, per=40, d=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(g, i, [float(x) for x in rng.normal(size=d)]) for g in range(n_groups) for i in range(per)]
    return spark.createDataFrame(rows, "g int, pos long, v array<float>"), rows


@pytest.mark.parametrize("causal", [True, False])
def test_attention_blocked_equals_single_block_and_numpy(spark, causal):
    df, rows = _emb(spark)
    one = {(r["g"], r["q_pos"]): r for r in vectors.attention(df, "g", "pos", "v", causal=causal, block_size=64).collect()}
    many = {(r["g"], r["q_pos"]): r for r in vectors.attention(df, "g", "pos", "v", causal=causal, block_size=7).collect()}
    assert one.keys() == many.keys() and len(one) == len(rows)
    for key, r in one.items():
        m = many[key]
        assert r["n_keys"] == m["n_keys"] and r["best_key"] == m["best_key"]
        assert math.isclose(r["log_norm"], m["log_norm"], rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r["entropy"], m["entropy"], rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r["max_weight"], m["max_weight"], rel_tol=1e-9, abs_tol=1e-12)
        assert np.allclose(r["pooled"], m["pooled"], rtol=1e-9, atol=1e-12)
    # brute force for one group
    g0 = [(p, np.array(v, dtype=np.float32).astype(np.float64)) for g, p, v in rows if g == 0]
    for qp, qv in g0:
        keys = [(kp, kv) for kp, kv in g0 if (kp <= qp or not causal)]
        s = np.array([qv @ kv / math.sqrt(len(qv)) for _, kv in keys])
        w = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        pooled = sum(wi * kv for wi, (_, kv) in zip(w, keys))
        assert np.allclose(one[(0, qp)]["pooled"], pooled, rtol=1e-9, atol=1e-12)
        assert one[(0, qp)]["n_keys"] == len(keys)
        assert math.isclose(one[(0, qp)]["entropy"], float(-(w * np.log(w)).sum()), rel_tol=1e-9, abs_tol=1e-12)


def test_batch_predict_runs_caller_model(spark):
    df = spark.createDataFrame([(1, [2, 5, 6, 1]), (2, [2, 1])], "k long, questions array<int>")
    out = evaluate.batch_predict(df, evaluate.reverse_predictor, ["k"], ids_col="questions", max_len_col=None)
    assert sorted((r["k"], r["pred_ids"]) for r in out.collect()) == [(1, [1, 6, 5, 2]), (2, [1, 2])]


def test_attention_rejects_positions_beyond_the_sequence(spark):
    df = spark.createDataFrame([(0, 9, [1.0])], "g int, pos long, v array<float>")
    with pytest.raises(Exception, match="position outside"):
        vectors.attention(df, "g", "pos", "v", max_len=9).collect()


def test_echo_model_keeps_the_contract():
    predict = evaluate.echo_predictor()
    got = predict([np.array([2, 5, 6, 1]), np.array([2, 1])], np.array([3, 4]))
    assert [x.tolist() for x in got] == [[2, 5, 6], [2, 1, 3, 3]]


def test_large_vocabulary_and_join_form_agree(spark):
    tokens = [chr(c) for c in range(0x20, 0x40000) if not 0xD800 <= c < 0xE000]
    voc = vocab.Vocabulary(A.SPECIALS + tuple(tokens))
    assert voc.size > 200_000
    table = spark.createDataFrame([(t, i) for i, t in enumerate(voc.itos)], "token string, id int")
    df = _qa(spark, ["a\U0002F800é", "\U0010FFFF", "", None, "\U0001F600 b"])
    inline = {r["k"]: r["question_ids"] for r in vocab.encode_columns(df, voc).collect()}
    joined = {r["k"]: r["question_ids"] for r in vocab.encode_by_join(df, table, ["k"], "question", "question_ids").collect()}
    assert inline == joined and inline[0][2] == voc.itos.index("\U0002F800") and inline[1] == [A.BOS, A.UNK, A.EOS]


def test_split_by_keeps_null_and_lookalike_keys(spark):
    df = spark.createDataFrame([("7", 1), ("07", 2), ("", 3), (None, 4), ("7", 5)], "key string, v int")
    parts = {k: sorted(r["v"] for r in x.collect()) for k, x in clean.split_by(df, "key").items()}
    assert parts == {"7": [1, 5], "07": [2], "": [3], None: [4]}
    assert clean.split_by(df.limit(0), "key") == {}
    with pytest.raises(ValueError, match="distinct"):
        clean.distinct_keys(df, "key", max_keys=2)


def test_ranks_with_large_scale_settings(spark):
    df = spark.range(400).withColumnRenamed("id", "k")
    five = {r["k"]: r["rank"] for r in rank.hash_rank(df, ["k"], seed=9, digits=5).collect()}
    four = {r["k"]: r["rank"] for r in rank.hash_rank(df, ["k"], seed=9, digits=4).collect()}
    assert five == four and sorted(five.values()) == list(range(400))
    s5 = sorted((r["k"], r["split"]) for r in rank.exact_split(df, ["k"], seed=9, digits=5).collect())
    s2 = sorted((r["k"], r["split"]) for r in rank.exact_split(df, ["k"], seed=9, digits=2).collect())
    assert s5 == s2
    many = rank.ordered_rank(df.repartition(3), ["k"], partitions=64).collect()
    assert sorted((r["rank"], r["k"]) for r in many) == [(i, i) for i in range(400)]


def test_package_functions_ship_by_value(tmp_path):
    """Workers need not import this package: its functions are pickled by value."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from textpairs.operators.evaluate import reverse_predictor

    blob = tmp_path / "f.pkl"
    blob.write_bytes(cloudpickle.dumps(reverse_predictor))
    code = (
        "import pickle, sys, numpy as np; "
        "assert not any('textpairs' in (p or '') for p in sys.path); "
        f"f = pickle.load(open({str(blob)!r}, 'rb')); print(f()([np.array([1, 2])], None)[0].tolist())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "[2, 1]"


def test_loaded_vocabulary_is_validated(spark):
    import pytest

    good = [("<unk>", 0, 0), ("<eos>", 0, 1), ("<bos>", 0, 2), ("<pad>", 0, 3), ("a", 5, 4)]
    assert vocab.Vocabulary.from_df(spark.createDataFrame(good, "token string, freq long, id int")).size == 5
    for rows in (good[:4] + [("ab", 1, 4)], good[:3] + [("a", 5, 3)], good[:4] + [("a", 5, 6)]):
        with pytest.raises(ValueError):
            vocab.Vocabulary.from_df(spark.createDataFrame(rows, "token string, freq long, id int"))
