import hashlib

import numpy as np
import pytest

from tests.llm.fixtures import collect, edge_docs, edge_rows, empty_docs, words_of, write_tables
from textpairs.llm import exchange
from textpairs.llm import substring_dedup as sd


def brute(docs, k=13):
    """(id, n_words, n_removed, kept text) of (id, text) rows."""
    least = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in docs:
        w = words_of(t)
        for j in range(len(w) - k + 1):
            x = tuple(w[j : j + k])
            least[x] = min(least.get(x, float("inf")), key(i))
    out = []
    for i, t in docs:
        w = words_of(t)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if least[tuple(w[j : j + k])] < key(i):
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [2, 5, 13])
def test_edge_table(spark, k):
    got = sd.remove_repeats(edge_docs(spark), k=k).select("doc_id", "n_words", "n_removed", "kept_text")
    assert collect(got) == brute([r[:2] for r in edge_rows()], k)


def test_small_chunks_and_sketch(spark, monkeypatch):
    monkeypatch.setattr(sd, "MAX_SLOTS", 1 << 16)
    monkeypatch.setattr(sd, "FLUSH_WINDOWS", 50)
    monkeypatch.setattr(sd.exchange, "CHUNK_BYTES", 200)
    monkeypatch.setattr(sd.exchange, "BUCKET_BYTES", 100)
    got = sd.remove_repeats(edge_docs(spark), k=4).select("doc_id", "n_words", "n_removed", "kept_text")
    assert collect(got) == brute([r[:2] for r in edge_rows()], 4)


def test_query(spark, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(docs)), key=repr)
    assert collect(sd.op10_substring_dedup(spark, "/root/testdata/sf0.001")) == want
    path = write_tables(spark, tmp_path, empty_docs(spark))
    assert collect(sd.op10_substring_dedup(spark, path)) == []


def test_other_columns_stay(spark):
    got = sd.remove_repeats(edge_docs(spark))
    assert got.columns == [c for c in edge_docs(spark).columns if c != "n_words"] + ["n_words", "n_removed", "kept_text"]
    assert got.count() == len(edge_rows())


def test_gaps_round_trip():
    rng = np.random.default_rng(2)
    for top in (1, 300, 1 << 20):
        x = np.unique(rng.integers(0, top, 200))
        assert (sd.unpack_gaps(sd.pack_gaps(x)) == x).all()
    assert len(sd.unpack_gaps(sd.pack_gaps(np.zeros(0, np.int64)))) == 0


def test_sketch_never_loses_a_repeat():
    from textpairs.llm.words import mix

    h = mix(np.arange(3000, dtype=np.uint64))
    twice = np.concatenate([h, h[::3]])
    rows = []
    for r in range(2):
        at = sd.estimated_repeated(twice, rows, 1 << 10)
        n = np.bincount(sd._slots(twice[at], r, 1 << 10), minlength=1 << 10)
        rows.append(np.packbits(n >= 2).tobytes())
    assert set(h[::3].tolist()) <= set(h[sd.estimated_repeated(h, rows, 1 << 10)].tolist())


def _ranges_of_edge_docs(spark, monkeypatch, slots):
    monkeypatch.setattr(sd, "MAX_SLOTS", slots)
    monkeypatch.setattr(sd, "SLICE_SLOTS", 1 << 10)
    monkeypatch.setattr(sd, "FLUSH_WINDOWS", 50)
    monkeypatch.setattr(sd.exchange, "CHUNK_BYTES", 200)
    monkeypatch.setattr(sd.exchange, "BUCKET_BYTES", 100)
    assert sd.sketch_shape(exchange.total_bytes(edge_docs(spark), "text"))[1] > 1


def test_many_ranges_of_hashes(spark, monkeypatch):
    _ranges_of_edge_docs(spark, monkeypatch, 1 << 14)
    got = sd.remove_repeats(edge_docs(spark), k=4).select("doc_id", "n_words", "n_removed", "kept_text")
    assert collect(got) == brute([r[:2] for r in edge_rows()], 4)


def test_sketch_grows_but_not_what_a_worker_holds(spark, monkeypatch):
    for size in (0, 1, 10**6, 10**9, 10**10, 10**12):
        slots, ranges = sd.sketch_shape(size)
        assert slots * ranges * 4 >= size and sd.ROWS * slots // 8 <= 64 << 20
    _ranges_of_edge_docs(spark, monkeypatch, 1 << 14)
    held = []
    for r, bits in sd.merged_sketches(edge_docs(spark), "text", 4, *sd.sketch_shape(1 << 18)):
        held.append((r, [len(x) for x in bits.value]))
        bits.destroy()
    assert held == [(r, [1 << 11] * sd.ROWS) for r in range(4)]


def test_spans_of_several_ranges_are_joined():
    part = lambda *x: np.array(x, np.int32).tobytes()
    assert sd._joined_spans([part((7, 20), (30, 43)), part((0, 5), (9, 12), (20, 22))]) == [[0, 5], [7, 22], [30, 43]]
    assert sd._joined_spans([part((3, 16))]) == [[3, 16]]
