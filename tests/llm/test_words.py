import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import alnum_words, edge_rows, lower, words_of
from textpairs.llm import words

TEXTS = [r[1] for r in edge_rows()]


@pytest.mark.parametrize("size", [1, 50, 4000, 1 << 21])
@pytest.mark.parametrize("table,low,plain", [(words.SPACED, False, words_of), (words.SPACED, True, lambda t: words_of(lower(t))), (words.ALNUM, True, alnum_words)])
def test_words_are_those_of_the_regex(size, table, low, plain):
    got, hashes = [], {}
    for s in words.slices(pa.array(TEXTS, pa.string()), table, low, size):
        h = words.word_hashes(s)
        for d in range(s.hi - s.lo):
            w = [s.buf[a:b].tobytes().decode() for a, b in zip(s.starts[s.off[d] : s.off[d + 1]], s.ends[s.off[d] : s.off[d + 1]])]
            got.append(w)
            for x, y in zip(w, h[s.off[d] : s.off[d + 1]].tolist()):
                assert hashes.setdefault(x, y) == y
    assert got == [plain(t) for t in TEXTS]
    assert len(set(hashes.values())) == len(hashes)


def test_sliced_and_chunked_columns():
    col = pa.chunked_array([pa.array(TEXTS[:10], pa.string()), pa.array(TEXTS[10:], pa.string())])
    whole = [s.counts.tolist() for s in words.slices(col, words.SPACED, False)]
    part = [s.counts.tolist() for s in words.slices(pa.array(TEXTS, pa.string())[4:], words.SPACED, False)]
    assert sum(whole, [])[4:] == sum(part, [])


def test_window_hashes_agree_with_tuples():
    rng = np.random.default_rng(3)
    h = words.mix(rng.integers(0, 4, 500).astype(np.uint64))
    got = words.window_hashes(h, 3)
    plain = [tuple(h[i : i + 3].tolist()) for i in range(498)]
    assert len(set(plain)) == len(set(got.tolist())) == len(set(zip(plain, got.tolist())))
    assert len(words.window_hashes(h[:2], 3)) == 0


def test_a_word_longer_than_a_piece():
    long = "y" * (3 << 19)
    s = next(words.slices(pa.array([f"a {long} b", long]), words.SPACED, False, 1 << 24))
    h = words.word_hashes(s)
    assert len(h) == 4 and h[1] == h[3] and len(set(h.tolist())) == 3
