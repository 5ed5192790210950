import hashlib
from collections import defaultdict

import pytest

from tests.llm.fixtures import alnum_words, collect, edge_docs, edge_rows, empty_docs, write_tables
from textpairs.llm import decontaminate as dc

ITEMS = "item_id long, text string, doc_id string"


def brute(docs, items, size):
    win = defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            win[tuple(w[j : j + size])].add("" if i is None else str(i))
    lens = {len(x) for x in win}
    out = []
    for i, t in docs:
        w = alnum_words(t)
        hit, names = [0] * len(w), set()
        for n in lens:
            for j in range(len(w) - n + 1):
                if got := win.get(tuple(w[j : j + n])):
                    hit[j : j + n] = [1] * n
                    names |= got
        out.append((i, len(w), sum(hit), sorted(names)))
    return sorted(out, key=repr)


def items_of(texts):
    w = [alnum_words(t) for t in texts]
    return [(0, " ".join(w[6][:12])), (1, "  "), (2, None), (3, "one"), (10, " ".join(w[8]).upper()), (10, " ".join(w[9][3:30])), (None, " ".join(w[11][:10])), (4, " ".join(w[3][40:70])), (5, "no such words here at all"), (9, "!!! ..")]


def near_brute(docs, items, size, slop):
    """Items a window of which has a start from which all its words are within ``slop`` places."""
    out = []
    for i, t in docs:
        w = alnum_words(t)
        at = defaultdict(list)
        for p, x in enumerate(w):
            at[x].append(p)
        names = set()
        for k, text in items:
            v = alnum_words(text)
            for j in range(max(1, len(v) - size + 1) if v else 0):
                x = v[j : j + size]
                if any(all(any(abs(p - s - q) <= slop for p in at[y]) for q, y in enumerate(x)) for s in range(-slop, len(w) + slop)):
                    names.add("" if k is None else str(k))
        out.append((i, sorted(names)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [3, 10])
def test_edge_table(spark, size):
    docs = [r[:2] for r in edge_rows()]
    items = items_of([t for _, t in docs])
    table = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    got = dc.contamination(edge_docs(spark), table, size=size, slop=0)
    assert collect(got.select("doc_id", "n_words", "n_hit", "items")) == brute(docs, items, size)
    assert got.filter("items <> near_items").count() == 0


def test_many_blocks_and_shards(spark, monkeypatch):
    docs = [r[:2] for r in edge_rows()]
    items = items_of([t for _, t in docs])
    table = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    want = brute(docs, items, 4)
    monkeypatch.setattr(dc, "BLOCK_WINDOWS", 5)
    monkeypatch.setattr(dc, "SHARD_BYTES", 300)
    assert collect(dc.contamination(edge_docs(spark), table, size=4).select("doc_id", "n_words", "n_hit", "items")) == want
    monkeypatch.setattr(dc, "MAX_TERMS", 3)  # all terms are stored then
    assert collect(dc.contamination(edge_docs(spark), table, size=4).select("doc_id", "n_words", "n_hit", "items")) == want


def test_proximity(spark):
    docs = [(1, "alpha beta gamma delta epsilon"), (2, "alpha x beta gamma delta y epsilon"), (3, "alpha x x x beta gamma delta epsilon"), (4, "epsilon delta gamma beta alpha"), (5, "beta alpha gamma epsilon delta")]
    items = [(7, "Alpha beta GAMMA delta epsilon")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame([(*x, "") for x in items], ITEMS)
    got = dc.contamination(df, table, size=5, slop=1)
    assert collect(got.select("doc_id", "items")) == [(1, ["7"]), (2, []), (3, []), (4, []), (5, [])]
    near = {r.doc_id: r.near_items for r in got.collect()}
    assert near[1] == near[2] == near[5] == ["7"] and near[3] == near[4] == []
    assert collect(got.select("doc_id", "near_items")) == near_brute(docs, items, 5, 1)
    short = [r[:2] for r in edge_rows() if len(r[1] or "") < 2000]
    items = items_of([t for _, t in [r[:2] for r in edge_rows()]])
    df, table = spark.createDataFrame(short, "doc_id long, text string").repartition(3), spark.createDataFrame([(*x, "") for x in items], ITEMS)
    assert collect(dc.contamination(df, table, size=4, slop=2).select("doc_id", "near_items")) == near_brute(short, items, 4, 2)


def test_query(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(((i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in brute(docs, items, 10)), key=repr)
    assert collect(dc.op2_decontaminate(spark, sf).drop("n_near_items")) == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert collect(dc.op2_decontaminate(spark, write_tables(spark, tmp_path / "a", empty_docs(spark), benchmark=none))) == []
    got = dc.op2_decontaminate(spark, write_tables(spark, tmp_path / "b", edge_docs(spark), benchmark=none))
    assert got.count() == len(edge_rows()) and got.filter("contaminated").count() == 0
