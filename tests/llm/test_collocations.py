import random
import re

import numpy as np
import pytest

from tests.llm.fixtures import collect, edge_docs, edge_rows, empty_docs, lower, write_tables
from textpairs.llm import collocations as co


def brute(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    f, n = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            if w:
                n[lang] = n.get(lang, 0) + len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    x = (lang, *w[i : i + k])
                    f[x] = f.get(x, 0) + 1
    cand = {x: c for x, c in f.items() if len(x) > 2 and c >= least}
    inside = {}
    for x, c in cand.items():
        for k in range(2, len(x) - 1):
            for i in range(1, len(x) - k + 1):
                p = (x[0], *x[i : i + k])
                inside[p] = max(inside.get(p, 0), c)
    out = []
    for lang in sorted(n):
        mine = []
        for x, a in cand.items():
            if x[0] == lang and inside.get(x, 0) < a:
                cuts = [(1000 * a * n[lang] // (f[x[: k + 1]] * f[(lang, *x[k + 1 :])]), k) for k in range(1, len(x) - 1)]
                score, k = min(cuts)
                mine.append((-score, -a, " ".join(x[1:]).encode(), f[x[: k + 1]], f[(lang, *x[k + 1 :])]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(mine)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,top", [(2, 10**6), (5, 40), (40, 10**6)])
def test_edge_table(spark, least, top):
    got = co.collocations(edge_docs(spark), least=least, top=top)
    assert collect(got) == brute([(r[1], r[2]) for r in edge_rows()], least, top)


def test_split_pairs_small_chunks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(co, "SPLIT", 3)
    monkeypatch.setattr(co.exchange, "CHUNK_BYTES", 500)
    monkeypatch.setattr(co.exchange, "BUCKET_BYTES", 3000)
    got = co.collocations(edge_docs(spark), least=4)
    assert collect(got) == brute([(r[1], r[2]) for r in edge_rows()], 4, co.TOP)


def test_languages_and_pieces(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["New", "york", "a.b", "ç,", "\x0b", "c;", "new\tyork", "\xa0"]) for _ in range(60)), rng.choice(["en", "two words", None, "und", ""])) for _ in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert collect(co.collocations(docs, least=3)) == brute(rows, 3, co.TOP)


def test_query(spark, tmp_path):
    rows = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert collect(co.op13_collocations(spark, "/root/testdata/sf0.001")) == brute(rows, 100, 2000)
    assert collect(co.op13_collocations(spark, write_tables(spark, tmp_path, empty_docs(spark)))) == []


def test_phrase_counts():
    rng = np.random.default_rng(8)
    m = rng.integers(1, 4, (300, 5)).astype(np.uint64)
    ends = rng.integers(2, 6, 300)
    m[np.arange(5) >= ends[:, None]] = 0
    times = rng.integers(1, 6, 300)
    want = {}
    for row, e, t in zip(m.tolist(), ends.tolist(), times.tolist()):
        for d in range(2, e + 1):
            want[tuple(row[:d])] = want.get(tuple(row[:d]), 0) + t
    for least in (1, 20, 200):
        rows, size, a = co.phrase_counts(m, times, least)
        assert {tuple(m[i, :d].tolist()): n for i, d, n in zip(rows, size.tolist(), a.tolist())} == {x: c for x, c in want.items() if c >= least}
