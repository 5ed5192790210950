import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import collect, edge_docs, edge_rows, empty_docs, lower, words_of, write_tables
from textpairs import session
from textpairs.llm import jaccard_join as jj
from textpairs.llm.components import connected


def shingles(t, k=5):
    w = words_of(lower(t))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    inv = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in inv[x]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
        for x in s:
            inv[x].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, np.inf), np.inf if d is None else d)
    return sorted(((d, len(sets[i]), None if least[find(i)] == np.inf else least[find(i)]) for i, (d, _) in enumerate(docs)), key=repr)


def family(n, seed=4):
    """Copies of a text with single words changed here and there, some chained, some too far off."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 400, 90)]
    out = []
    for i in range(n):
        w = list(base)
        for p in rng.integers(0, 90, int(rng.integers(0, 5))):
            w[p] = f"v{i}"
        out.append(" ".join(w))
        if i % 6 == 0:
            base[int(rng.integers(0, 90))] = f"d{i}"
    return out


@pytest.mark.parametrize("small", [False, True])
def test_edge_table_and_families(spark, monkeypatch, small):
    if small:  # many chunks, buckets and blocks
        for name, n in (("CHUNK_BYTES", 300), ("FLUSH", 200), ("BLOCK_SHINGLES", 150), ("BUCKET_SHINGLES", 500), ("HOT_LEAST", 1), ("HOT", 50)):
            monkeypatch.setattr(jj, name, n)
        monkeypatch.setattr(jj.exchange, "BUCKET_BYTES", 500)
    more = [(1000 + i, t) for i, t in enumerate(family(80) + family(30, 9))]
    docs = [r[:2] for r in edge_rows()] + more
    df = edge_docs(spark).select("doc_id", "text", "sid", "tkey").unionByName(spark.createDataFrame([(*x, "", "") for x in more], "doc_id long, text string, sid string, tkey string"))
    got = jj.jaccard_components(df).select("id", "n_shingles", "component_id")
    assert collect(got) == brute(docs)


def test_links_are_exact_at_the_threshold():
    assert jj.linked(8, 8, 10) and not jj.linked(7, 8, 10)
    for n in range(1, 300):
        p = int(jj.prefix_length(np.array([n]))[0])
        least = next(o for o in range(n + 1) if 100 * o >= 80 * n)  # a link shares at least 0.8 n
        assert p == min(n, n - least + 1 + -(-n // 20))


def test_linked_sets_share_enough_of_their_prefixes():
    rng = np.random.default_rng(7)
    seen = 0
    for _ in range(4000):
        a = set(rng.choice(400, int(rng.integers(1, 60)), replace=False).tolist())
        b = set(a)
        for x in rng.choice(400, int(rng.integers(0, max(1, len(a) // 5) + 1))).tolist():
            b ^= {x}
        if b and jj.linked(len(a & b), len(a), len(b)):
            pre = [set(sorted(x)[: int(jj.prefix_length(np.array(len(x))))]) for x in (a, b)]
            assert len(pre[0] & pre[1]) >= jj.shared_least(len(a), len(b)) >= 1
            step = int(jj.size_class(np.array([len(b)]))[0]) - int(jj.size_class(np.array([len(a)]))[0])
            assert len(pre[0] & pre[1]) >= jj.least_by_class(np.array([len(a)]))[0, step + jj._REACH]
            seen += 1
    assert seen > 1000
    for n in (1, 2, 4, 5, 9, 100, 1234, 10**6):  # every size that can be linked is in reach
        c = int(jj.size_class(np.array([n]))[0])
        for m in range(-(-4 * n // 5), 5 * n // 4 + 1, max(1, n // 300)):
            d = int(jj.size_class(np.array([m]))[0]) - c
            assert abs(d) <= jj._REACH and jj.least_by_class(np.array([n]))[0, d + jj._REACH] <= jj.shared_least(n, m)


def test_trie_finds_what_all_pairs_find():
    rng = np.random.default_rng(0)
    for _ in range(30):
        base = rng.choice(60, 30, replace=False)
        sets = []
        for _ in range(25):
            s = set(base.tolist()) if rng.random() < 0.7 else set(rng.choice(60, 20, replace=False).tolist())
            for x in rng.choice(60, int(rng.integers(0, 6))):
                s ^= {int(x)}
            sets.append(np.array(sorted(s), np.uint64))
        sids = np.arange(1, len(sets) + 1)
        every = np.ones(len(sets), bool)
        links = jj.block_links(sids, sets, every, every)
        trie = jj.Trie([s.astype(np.int64) for s in sets], np.array([len(s) for s in sets]))
        mask = np.zeros(60, bool)
        for s in sets:
            want = [i for i, x in enumerate(sets) if jj.linked(len(set(s) & set(x)), len(s), len(x))]
            assert sorted(trie.alike(s.astype(np.int64), len(s), mask).tolist()) == want
        assert not mask.any() and len(links) < len(sets)


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (10, 3), (7, 8), (8, 7), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(collect(connected(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {2: 1, 3: 1, 10: 1, 8: 7, **{101 + i: 100 for i in range(40)}}
    assert collect(connected(spark.createDataFrame([], "a long, b long"))) == []


def test_one_of_each(spark):
    docs = [r[:2] for r in edge_rows()]
    got = collect(jj.one_of_each(edge_docs(spark)).select("doc_id", "text"))
    assert collect(jj.one_of_each(edge_docs(spark)).select(*edge_docs(spark).columns)) is not None
    parts = brute(docs)
    full = {c for _, n, c in parts if n}
    assert Counter(i for i, t in got if shingles(t)) == Counter(full)
    assert sum(not shingles(t) for _, t in got) == sum(not shingles(t) for _, t in docs)


def test_query(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert collect(jj.op3_jaccard_join(spark, sf)) == brute(docs)
    assert collect(jj.op3_jaccard_join(spark, write_tables(spark, tmp_path, empty_docs(spark)))) == []


def test_tables_behind_the_links_are_deleted(spark, monkeypatch):
    """Of what the search writes only the named documents and their components stay on disk."""
    written = []
    real = session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, name: written.append(real(s, name)) or written[-1])
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 3, 30))) for i in range(12)], "doc_id long, text string")
    got = jj.jaccard_components(docs).select("id", "component_id")
    there = lambda p: os.path.exists(p.removeprefix("file:"))
    left = sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in written if there(p))
    assert len(written) > 6 and left == ["op3-least", "op3-named"]
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(12)]
