import numpy as np
import pytest

from textpairs.llm.multikey import ranges, three_way


def test_ranges():
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert ranges(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
@pytest.mark.parametrize("depth", [1, 3])
def test_sorted_with_equal_partitions(n, depth):
    rng = np.random.default_rng(n)
    m = rng.integers(0, 4, (n, depth)).astype(np.uint64)
    ptr = np.arange(n)
    start, size = three_way(ptr, lambda p, d: m[p, d], depth)
    got = [tuple(x) for x in m[ptr].tolist()]
    assert got == sorted(got) and sorted(ptr.tolist()) == list(range(n))
    covered = {i for s, k in zip(start, size) for i in range(s, s + k)}
    for s, k in zip(start.tolist(), size.tolist()):
        assert len(set(got[s : s + k])) == 1
        assert got.count(got[s]) == k
    assert all(got.count(got[i]) == 1 for i in range(n) if i not in covered)


def test_abandoned_partitions_and_weights():
    rng = np.random.default_rng(3)
    m = rng.integers(0, 5, (400, 4)).astype(np.uint64)  # 0 ends a row
    m[:, 0] += m[:, 0] == 0
    w = rng.integers(1, 5, 400)
    want = {}
    for row, x in zip(m.tolist(), w.tolist()):
        for d in range(1, 5):
            if row[d - 1] == 0:
                break
            want[tuple(row[:d])] = want.get(tuple(row[:d]), 0) + x
    heard = {}

    def on_equal(first, depth, total):
        for p, d, t in zip(first.tolist(), depth.tolist(), total.tolist()):
            assert tuple(m[p, :d].tolist()) not in heard
            heard[tuple(m[p, :d].tolist())] = t

    for least in (1, 9, 60):
        heard.clear()
        three_way(np.arange(400), lambda p, d: m[p, d], 4, least, w, on_equal, end=0)
        assert heard == {k: v for k, v in want.items() if v >= least}
