"""Epochs over the bucketed table: the batches of every epoch, and plans without an exchange."""

import hashlib

import pytest

from textpairs.operators import batching, rank, shards, vocab
from textpairs.plans import catalogue
from textpairs.session import scratch_path
from tests.conftest import SMALL


def _rows(spark, n):
    return spark.createDataFrame([(i, "q" * (i % 7), "a" * (i % 5)) for i in range(n)], "k long, question string, answer string")


def _stored(spark, n, **sizes):
    rows = _rows(spark, n)
    voc = vocab.Vocabulary.from_df(vocab.build_vocab(rows))
    return rows, voc, shards.write_shards(rows, ["k"], voc, scratch_path(spark, "shards"), buckets=3, **sizes)


def _brute(n, epoch, batch, per):
    md5 = lambda e, i: hashlib.md5(f"42|{e}|{i}".encode()).hexdigest()
    first, out = sorted(range(n), key=lambda i: (md5(0, i), i)), {}
    for s in range(0, n, batch * per):
        for at, i in enumerate(sorted(first[s : s + batch * per], key=lambda i: (md5(epoch, i), i))):
            out[i] = (s // batch + at // batch, at % batch)
    return out


@pytest.mark.parametrize("n", [0, 1, 12, 100])
@pytest.mark.parametrize("epoch", [0, 1, 5])
def test_epochs_against_brute_force(spark, n, epoch):
    if n == 0:
        rows = _rows(spark, 1)
        voc = vocab.Vocabulary.from_df(vocab.build_vocab(rows))
        table = shards.write_shards(rows.limit(0), ["k"], voc, scratch_path(spark, "shards"), buckets=3, batch_size=4, shard_batches=3)
    else:
        _, _, table = _stored(spark, n, batch_size=4, shard_batches=3)
    got = shards.epoch_padded(table, ["k"], epoch, batch_size=4, shard_batches=3).collect()
    assert {r.k: (r.batch_id, r.pos_in_batch) for r in got} == _brute(n, epoch, 4, 3) and len(got) == n
    for b in {r.batch_id for r in got}:
        mine = [r for r in got if r.batch_id == b]
        assert {len(r.questions) for r in mine} == {max(len(r.question_ids) for r in mine)}
        assert {len(r.answers) for r in mine} == {max(len(r.answer_ids) for r in mine)}


def test_first_epoch_has_the_batches_of_the_hash_rank(spark):
    rows, voc, table = _stored(spark, 150, batch_size=8, shard_batches=2)
    want = batching.encode_batches(rank.batch_ids(rank.hash_rank(rows, ["k"], epoch=0), batch_size=8), voc)
    cols = ["k", "batch_id", "pos_in_batch", "questions", "answers"]
    got = shards.epoch_padded(table, ["k"], 0, batch_size=8, shard_batches=2)
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_an_epoch_has_no_exchange(spark):
    df = catalogue.q_epoch_bucketed(spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert plan.count("Window ") == 2


def test_shards_need_whole_batches(spark):
    rows = _rows(spark, 3)
    with pytest.raises(ValueError):
        shards.write_shards(rows, ["k"], None, "/unused", shard_batches=0)
