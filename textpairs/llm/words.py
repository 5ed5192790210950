"""Words, word hashes and word windows of whole Arrow text columns, without a Python loop per word.

Every function works on the bytes of a text column as they lie in Arrow.  A *slice* is a run of
whole documents of about ``SLICE_BYTES`` (one longer document is a slice of its own), so memory
is bounded by that size or by the longest single document.

Hashes are 64 bit: a word's bytes under a random table and a power series, mixed; a window's word
hashes in order, mixed again.  Two different windows get one hash with a chance of 2**-64.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: bytes that are part of a word, for ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: bytes that are part of a word, for ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of the base and of its inverse; not sent to workers, which make their own."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return (_Powers, ())

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _PIECE + 1)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if size > 4 * _PIECE:  # one huge word: not kept
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Slice:
    """Documents ``lo:hi`` of a batch; word w is ``buf[starts[w]:ends[w]]``, document d's words are ``off[d]:off[d+1]``."""

    lo: int
    hi: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    off: np.ndarray
    byte_off: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its int64 offsets; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(col, is_word: np.ndarray, lower: bool, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    data, off = text_bytes(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        buf = data[off[lo] : off[hi]]
        if lower:
            buf = LOWER[buf]
        at = off[lo : hi + 1] - off[lo]
        word = is_word[buf]
        border = np.zeros(len(buf) + 1, bool)
        border[at] = True
        before = np.empty_like(word)
        if len(word):
            before[0] = False
            before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | border[:-1]))
        after = np.empty_like(word)
        if len(word):
            after[-1] = False
            after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | border[1:])) + 1
        yield Slice(lo, hi, buf, starts, ends, np.searchsorted(starts, at).astype(np.int64), at)
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hash of each word ``buf[start:end]``; starts rise and words do not overlap."""
    out = np.empty(len(starts), np.uint64)
    w = 0
    while w < len(starts):
        base = int(starts[w])
        x = max(w + 1, int(np.searchsorted(ends, base + _PIECE, "right")))
        last = int(ends[x - 1])
        up, down = _POWERS.upto(last - base + 1)
        total = np.zeros(last - base + 1, np.uint64)
        np.cumsum(_BYTE[buf[base:last]] * up[: last - base], out=total[1:])
        s, e = starts[w:x] - base, ends[w:x] - base
        out[w:x] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        w = x
    return mix(out)


def word_hashes(s: Slice) -> np.ndarray:
    return hash_words(s.buf, s.starts, s.ends)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring word hashes (``len(h) - k + 1`` of them, at least 0)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:m].copy()
    for j in range(1, k):
        acc *= _STEP
        acc += h[j : j + m]
    return mix(acc)


def window_starts(off: np.ndarray, k: int) -> np.ndarray:
    """Word indices at which a window of ``k`` words fits in its document."""
    total = int(off[-1])
    if total < k:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return np.flatnonzero(doc[: total - k + 1] == doc[k - 1 :])


def revive(kind: type, state: dict):
    """An object from its broadcast attributes (plain arrays, so workers need not import its class by name)."""
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


def id_crc(doc_id) -> int:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def ints(col: pa.Array, null: int) -> np.ndarray:
    """An integer column as int64 with ``null`` for null."""
    return col.fill_null(null).cast(pa.int64()).to_numpy(zero_copy_only=False) if col.null_count else col.cast(pa.int64()).to_numpy(zero_copy_only=False)
