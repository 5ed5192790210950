import hashlib
import random

import numpy as np
import pytest

from tests.llm.fixtures import collect, edge_docs, edge_rows, empty_docs, write_tables
from textpairs.llm import suffix_dedup as sd


def brute(docs, width):
    """(id, bytes, removed, spans, what is left) of (id, text) rows."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    times = {}
    for _, b in raw:
        for j in range(len(b) - width + 1):
            times[b[j : j + width]] = times.get(b[j : j + width], 0) + 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if times[b[j : j + width]] > 1:
                gone[j : j + width] = b"\1" * width
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def got_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=repr)


def short_rows():
    """The awkward rows, the long texts cut, with texts that repeat a few bytes or a passage."""
    rng = random.Random(5)
    r = [x if not x[1] or len(x[1]) < 5000 else (x[0], x[1][:3000], *x[2:]) for x in edge_rows()]
    passage = "".join(rng.choice("abcd é") for _ in range(400))
    more = ["x" * 900, "x" * 250 + "y", "ab" * 300, passage, "Z" + passage + "é", passage[7:330] + "!", "ö" * 150, passage[:90] + passage[:90] + passage[:90]]
    return r + [(1000 + i, t, "en", "s", 1, 1, "", "", "", "", "") for i, t in enumerate(more)]


@pytest.mark.parametrize("width", [200, 40, 3])
def test_edge_table(spark, width):
    docs = spark.createDataFrame(short_rows(), edge_docs(spark).schema).repartition(5)
    assert got_of(sd.remove_repeated_bytes(docs, width=width)) == brute([r[:2] for r in short_rows()], width)


def test_small_chunks_buckets_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 300)
    monkeypatch.setattr(sd, "SORTED", 50)
    monkeypatch.setattr(sd.exchange, "CHUNK_BYTES", 700)
    monkeypatch.setattr(sd.exchange, "BUCKET_BYTES", 2000)
    docs = spark.createDataFrame(short_rows(), edge_docs(spark).schema).repartition(7)
    assert got_of(sd.remove_repeated_bytes(docs, width=60)) == brute([r[:2] for r in short_rows()], 60)


def test_columns_and_empty_table(spark):
    docs = edge_docs(spark).withColumnRenamed("n_chars", "n_bytes").withColumnRenamed("sid", "kept")
    got = sd.remove_repeated_bytes(docs)
    assert got.columns == [c for c in docs.columns if c not in ("n_bytes", "kept")] + ["n_bytes", "n_removed", "n_spans", "kept"]
    assert got.count() == len(edge_rows())
    assert got_of(sd.remove_repeated_bytes(empty_docs(spark))) == []


def test_query(spark, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(((i, n, g, s, hashlib.sha256(t).hexdigest()) for i, n, g, s, t in brute(docs, 200)), key=repr)
    assert collect(sd.op12_suffix_dedup(spark, "/root/testdata/sf0.001")) == want
    assert collect(sd.op12_suffix_dedup(spark, write_tables(spark, tmp_path, empty_docs(spark)))) == []


@pytest.mark.parametrize("width,shallow", [(20, 8), (40, 32), (9, 32), (5, 8)])
def test_suffix_order(width, shallow):
    rng = random.Random(width)
    text = bytes(rng.choice(b"ab") for _ in range(600)) + b"abab" * 40
    places = np.arange(len(text) - width + 1)
    order, new = sd.deep_shallow(text + bytes(8), places, width, shallow)
    key = [text[p : p + width] for p in order.tolist()]
    assert key == sorted(key) and sorted(order.tolist()) == places.tolist()
    assert new.tolist() == [i == 0 or key[i] != key[i - 1] for i in range(len(key))]


def test_blind_trie():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc") for _ in range(6)) for _ in range(300)]
    trie = sd.BlindTrie()
    for i, t in enumerate(texts):
        trie.add(t, i)
    leaves = [sorted(x) for x in trie.leaves()]
    assert leaves == [[i for i, t in enumerate(texts) if t == u] for u in sorted(set(texts))]
    assert list(sd.BlindTrie().leaves()) == []


def test_equal_strings_have_one_name():
    rng = np.random.default_rng(4)
    part = rng.integers(0, 256, 260).astype(np.uint8)
    a = np.concatenate([rng.integers(0, 256, 1000).astype(np.uint8), part])
    b = np.concatenate([part, rng.integers(0, 256, 50).astype(np.uint8)])
    name = {}
    for buf, places in ((a, range(1000, 1061)), (b, range(61))):
        doc, size, names = sd.runs(buf, np.array([0, len(buf)]), 200, 64)
        assert size.sum() == len(buf) - 199
        every = np.repeat(names, size)
        name[len(buf)] = every[list(places)].tolist()
    assert name[len(a)] == name[len(b)]
