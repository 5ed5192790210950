import math
import re

import numpy as np
import pytest

from tests.llm.fixtures import collect, edge_docs, edge_rows, empty_docs, lower, write_tables
from textpairs.llm import ranked_search as rs


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute(docs, items, top=10):
    """(item, rank, doc_id, score); an item and its ranks once for each of its rows."""
    bags = [(i, terms_of(t)) for i, t in docs]
    bags = [(i, w) for i, w in bags if w]
    n_docs, length = len(bags), sum(len(w) for _, w in bags)
    df = {}
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, w in bags:
            m = 100 - 75 + (75 * len(w) * n_docs) // length
            score = 0
            for t in terms_of(text):
                tf = w.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:top])]
    return sorted(out, key=repr)


ITEMS = [(1, "bb été3 a1 a1 A1 dd"), (2, None), (3, ""), (4, "nowhere at all"), (5, "W1x1 w2x2 über7 ff"), (5, "one"), (None, "c3 bb7"), (7, "x" * 40 + " über1 Öl öl e5 bb bb bb"), (8, "!!! ...")]


def fixture(spark):
    items = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, score string")
    return edge_docs(spark), items


@pytest.mark.parametrize("top", [10, 1, 100])
def test_edge_tables(spark, top):
    docs, items = fixture(spark)
    assert collect(rs.search(docs, items, top=top)) == brute([r[:2] for r in edge_rows()], ITEMS, top)


def test_small_blocks_and_matrices(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_TERMS", 6)
    monkeypatch.setattr(rs, "SCORES", 8)
    monkeypatch.setattr(rs, "PRODUCTS", 3)
    docs, items = fixture(spark)
    assert collect(rs.search(docs, items)) == brute([r[:2] for r in edge_rows()], ITEMS)


def test_many_equal_documents(spark):
    """Copies in several partitions and ties between classes go by ascending id."""
    rows = [(i, ["Rare word here", "here word rare", "rare word other", "unrelated text"][i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    items = [(1, "rare word"), (2, "here"), (3, "other rare")]
    got = rs.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert collect(got) == brute(rows, items)


def test_empty_tables(spark, tmp_path):
    docs, items = fixture(spark)
    no_items = items.filter("false")
    assert collect(rs.search(docs, no_items)) == []
    path = write_tables(spark, tmp_path, empty_docs(spark), benchmark=items)
    got = rs.op11_ranked_search(spark, path)
    assert collect(got) == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_query(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert collect(rs.op11_ranked_search(spark, "/root/testdata/sf0.001")) == want


def test_class_scores():
    rng = np.random.default_rng(6)
    items, rows, terms = 7, 9, 12
    a, b = rng.integers(0, 3, (items, terms)), rng.integers(0, 4, (rows, terms))
    weight, m = rng.integers(0, 9000, terms), rng.integers(25, 300, rows)
    of, at = np.nonzero(a.T)[1], np.nonzero(a.T)[0]
    row, term = np.nonzero(b)
    got = rs.class_scores(row, term, b[row, term], m, weight, of, np.searchsorted(at, np.arange(terms + 1)), a.T[at, of], items, rows)
    want = [[sum(int(a[i, t]) * int(weight[t]) * (10**9 * int(b[r, t]) // (1000 * int(b[r, t]) + 8 * int(m[r]))) for t in range(terms) if b[r, t]) for r in range(rows)] for i in range(items)]
    assert got.tolist() == want
