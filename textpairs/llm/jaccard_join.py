"""N-gram Jaccard join by prefix trees: which documents' shingle sets are 0.8 alike, as components.

1. Every text becomes its set of distinct word shingles (64-bit hashes).  Equal sets are one *set* from here on.
2. All shingles stand in one global order: those found often (counted over all texts, the most frequent
   ``HOT`` kept) last by their count, the others before them by hash.  Two sets that are alike share a
   shingle among the first ``n - ceil(0.8 n) + 1`` of each; the prefix has a twentieth more, so that they share many.
3. Chunks of texts ask the hash buckets in which size classes other sets have their prefix shingles (one
   entry a chunk, shingle and class, however many sets share it).  Linked sets of sizes a and b share at least
   ``shared_least(a, b)`` prefix shingles; sets that share fewer with every class are done.
4. Each remaining set's *home* is its most shared prefix shingle, and it visits every home with whose residents
   it shares enough prefix shingles.  At a home the resident sets stand in a trie of globally ordered shingles,
   the most frequent first, so that partial overlaps are shared; each visitor walks it level by level and
   drops subtrees whose best possible overlap (found so far, plus the shorter rest) is too small.  A home with
   more than ``BLOCK_SHINGLES`` shingles is cut into blocks of residents by blocks of visitors.  Only links that join
   two parts of a block go on, never all pairs of a group.
5. Connected components of the links give each document its component.

Defined cases: a null or empty text has the empty set and is linked with nothing; a text of fewer words
than a shingle has one shingle, its whole sequence; rows that share an id are documents of their own; a null
id counts as larger than every id; equal sets are linked; clashing columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.llm import exchange, words
from textpairs.llm.components import connected
from textpairs.session import materialize, materialize_alone

SHINGLE = 5
HOT = 1 << 16
HOT_LEAST = 8
CHUNK_BYTES = 4 << 20
FLUSH = 1 << 20
BLOCK_SHINGLES = 1 << 20
BUCKET_SHINGLES = 2 << 20


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, n - (4 * n + 4) // 5 + 1 + (n + 19) // 20)


def linked(overlap, a, b):
    """100 * intersection >= 80 * union, from the sizes and the intersection."""
    return 9 * overlap >= 4 * (a + b)


def shared_least(a, b):
    """Prefix shingles that linked sets of these sizes share at least.

    The k-th common shingle stands in a set behind k - 1 common ones and at most all its uncommon ones, so the
    first ``overlap - size + prefix_length(size)`` common ones stand in its prefix, for either set.
    """
    overlap = -(-4 * (a + b) // 9)
    return np.maximum(1, overlap + np.minimum(prefix_length(a) - a, prefix_length(b) - b))


def shingle_sets(s: words.Slice, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): each document's distinct shingles, rising within a document."""
    h = words.word_hashes(s)
    n = s.hi - s.lo
    at = words.window_starts(s.off, k)
    w = words.window_hashes(h, k)[at]
    doc = s.doc_of_word()[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((s.counts > 0) & (s.counts < k))
    if len(short):
        one = [words.mix(words.window_hashes(h[s.off[d] : s.off[d + 1]], int(s.counts[d])) + np.uint64(s.counts[d])) for d in short.tolist()]
        doc, w = np.concatenate([doc, short]), np.concatenate([w, *one])
    order = np.lexsort((w, doc))
    doc, w = doc[order], w[order]
    if len(w):
        new = np.append(True, (doc[1:] != doc[:-1]) | (w[1:] != w[:-1]))
        doc, w = doc[new], w[new]
    return np.searchsorted(doc, np.arange(n + 1)), w


def set_ids(off: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set (0 for the empty one)."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(w ^ np.uint64(0xA5A5A5A55A5A5A5A)))))
    n = np.diff(off)
    out = words.mix(total[off[1:]] - total[off[:-1]] + n.astype(np.uint64)) | np.uint64(1)
    return np.where(n > 0, out, np.uint64(0)).view(np.int64)


def _members(batches):
    for batch in batches:
        n, sid = [], []
        for s in words.slices(batch.column(2), words.SPACED, True):
            off, w = shingle_sets(s)
            n.append(np.diff(off))
            sid.append(set_ids(off, w))
        if n:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(sid))], names=["id", "tkey", "n", "sid"])


def _new_sets(batches, column: int):
    """(sid, n, shingles) slice by slice of sets that this partition has not met before."""
    met: set[int] = set()
    for batch in batches:
        for s in words.slices(batch.column(column), words.SPACED, True):
            off, w = shingle_sets(s)
            sid, n = set_ids(off, w), np.diff(off)
            take = []
            for d, x in enumerate(sid.tolist()):
                if n[d] and x not in met:
                    met.add(x)
                    take.append(d)
            take = np.array(take, np.int64)
            yield sid[take], n[take], w[np.repeat(off[take], n[take]) + _within(n[take])] if len(take) else w[:0], len(s.buf)


def _within(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _often(batches):
    """Shingles that several sets of a run of texts have, with their number."""

    def counted(found):
        h, c = np.unique(np.concatenate(found), return_counts=True)
        some = c >= 4
        return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(c[some].astype(np.int64))], names=["h", "c"])

    found, size = [], 0
    for _, _, w, _ in _new_sets(batches, 0):
        found.append(w)
        size += len(w)
        if size >= FLUSH:
            yield counted(found)
            found, size = [], 0
    if found:
        yield counted(found)


class Order:
    """The global order: ``rank`` of a shingle is 0, or its place among the hot ones from 1."""

    def __init__(self, hot: np.ndarray):
        """``hot``: the frequent shingles by rising count."""
        order = np.argsort(hot)
        self.keys, self.place = hot[order], (order + 1).astype(np.int64)

    def rank(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.place[at], 0)


_WIDTH = 1.04
_CLASS_BITS = 10
_CLASS = np.uint64((1 << _CLASS_BITS) - 1)
_REACH = 7  # classes between sizes that can be linked (a ratio of 1.25 at most): log 1.25 / log 1.04 and rounding


def size_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log(np.maximum(n, 1)) / np.log(_WIDTH), int(_CLASS)).astype(np.uint64)


def least_by_class(n: np.ndarray) -> np.ndarray:
    """``[set, step + _REACH]``: the prefix shingles that a set of size n shares at least with a linked one so many classes on."""
    c = size_class(n).astype(np.int64)[:, None] + np.arange(-_REACH, _REACH + 1)
    n = n[:, None]
    low = np.maximum(np.floor(_WIDTH ** np.maximum(c, 0)).astype(np.int64) - 1, -(-4 * n // 5))
    high = np.minimum(np.ceil(_WIDTH ** (np.maximum(c, 0) + 1)).astype(np.int64) + 1, 5 * n // 4)
    high = np.where(c >= int(_CLASS), 5 * n // 4, high)
    # over an interval of sizes the least is at one of its ends, give or take one for rounding
    least = np.maximum(1, np.minimum(shared_least(n, low), shared_least(n, high)) - 1)
    return np.where((c >= 0) & (low <= high), least, 1 << 40)


def _entries(sid: np.ndarray, n: np.ndarray, p: np.ndarray, w: np.ndarray):
    """(shingles, values, entry of each prefix shingle): one entry for each shingle and size class, in their order.

    A value is the set's name with the class in its last six bits, or the class alone if several sets share the entry.
    """
    c, owner = np.repeat(size_class(n), p), np.repeat(sid, p)
    order = np.lexsort((c, w))
    w, c, owner = w[order], c[order], owner[order]
    new = np.append(True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])) if len(w) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    index = np.empty(len(w), np.int64)
    index[order] = np.cumsum(new) - 1
    low, high = (f.reduceat(owner, first) if len(first) else owner for f in (np.minimum, np.maximum))
    return w[first], np.where(low == high, low.view(np.uint64) & ~_CLASS, np.uint64(0)) | c[first], index


def _prefixes(order):
    """Chunk rows: names, sizes and prefixes of the sets that the task meets first."""

    def row(number, found):
        cols = dict(zip(("sids", "ns", "ps", "prefix"), (np.concatenate(x) for x in zip(*found))))
        return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in cols.items()})

    def run(batches):
        ranked = words.revive(Order, order.value)
        task, seq, size, found = TaskContext.get().partitionId(), 0, 0, []
        for sid, n, w, read in _new_sets(batches, 0):
            if len(sid):
                place = np.lexsort((w, ranked.rank(w), np.repeat(np.arange(len(n)), n)))
                p = prefix_length(n)
                first = np.cumsum(n) - n
                found.append((sid, n, p, w[place][np.repeat(first, p) + _within(p)]))
            size += read
            if size >= CHUNK_BYTES and found:
                yield row(exchange.chunk_number(task, seq), found)
                seq, size, found = seq + 1, 0, []
        if found:
            yield row(exchange.chunk_number(task, seq), found)

    return run


def _open(chunk, r: int):
    return [np.frombuffer(chunk[x][r].as_py(), t) for x, t in (("sids", np.int64), ("ns", np.int64), ("ps", np.int64), ("prefix", np.uint64))]


def _asks(buckets: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                keys, vals, _ = _entries(*_open(batch, r))
                cuts = exchange.bucket_cuts(keys, buckets)
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array(np.full(len(used), batch["chunk"][r].as_py())), "bucket": pa.array(used.astype(np.int64)),
                    "keys": pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()), "vals": pa.array([vals[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()),
                })

    return run


def _shared(keys, vals):
    """For each entry: bits of the classes (from ``-_REACH`` on) in which another set has its shingle, and about how many sets."""
    sizes = [len(x) for x in keys]
    val = np.frombuffer(b"".join(vals), np.uint64)
    c, owner = (val & _CLASS).astype(np.int64), val >> np.uint64(_CLASS_BITS)
    _, token = np.unique(np.concatenate(keys), return_inverse=True)
    cell = token * (int(_CLASS) + 1) + c
    order = np.lexsort((owner, cell))
    new = np.append(True, (cell[order][1:] != cell[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
    weight = np.zeros(len(cell), np.int64)
    weight[order[new]] = 1  # a set counts once, whichever chunks have it
    weight[owner == 0] = 2
    cells, at = np.unique(cell, return_inverse=True)
    number = np.bincount(at, weight, len(cells)).astype(np.int64)
    bits, many = np.zeros(len(cells), np.int32), np.zeros(len(cells), np.int64)
    of = cells & int(_CLASS)
    for step in range(-_REACH, _REACH + 1):
        i = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        there = (cells[i] == cells + step) & (of + step >= 0) & (of + step <= int(_CLASS))
        if step == 0:
            there &= number > 1
        bits |= there.astype(np.int32) << (step + _REACH)
        many += np.where(there, number[i], 0)
    out = np.stack([bits, np.minimum(many, 1 << 30).astype(np.int32)], 1)[at]
    return [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])], {}


def _live(_, chunk: pa.Table, got: pa.Table) -> pa.Table:
    """The sets that share enough prefix shingles with some class, those shingles, and the home among them."""
    sids, ns, tokens, homes = [], [], [], []
    if chunk.num_rows and got.num_rows:
        sid, n, p, w = _open(chunk, 0)
        answer = np.frombuffer(exchange.joined(got), np.int32).reshape(-1, 2)[_entries(sid, n, p, w)[2]]
        bits, many, w = answer[:, 0], answer[:, 1], w.view(np.int64)
        cuts = np.concatenate(([0], np.cumsum(p)))
        counts = np.stack([np.add.reduceat(bits >> k & 1, cuts[:-1]) for k in range(2 * _REACH + 1)], 1)
        enough = counts >= least_by_class(n)
        masks = (enough << np.arange(2 * _REACH + 1)).sum(1)
        for d in np.flatnonzero(masks).tolist():
            part = slice(cuts[d], cuts[d + 1])
            use = bits[part] & masks[d] != 0
            key = w[part][use]
            sids.append(int(sid[d]))
            ns.append(int(n[d]))
            tokens.append(key)
            homes.append(int(key[np.lexsort((key, -many[part][use]))[0]]))
    return pa.table({"sid": pa.array(sids, pa.int64()), "n": pa.array(ns, pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int64())), "home": pa.array(homes, pa.int64())})


class Trie:
    """Prefix tree of rank sequences; a node is a run of ranks, stored level by level."""

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
        common = []
        for a, b in zip(order, order[1:]):
            m = min(len(seqs[a]), len(seqs[b]))
            differ = np.flatnonzero(seqs[a][:m] != seqs[b][:m])
            common.append(int(differ[0]) if len(differ) else m)
        runs, parent, leaves, level, last, span = [], [], [], [], [], []
        todo = [(0, len(order), 0, -1, 0)]
        while todo:
            nxt = []
            for lo, hi, depth, up, lev in todo:
                one = seqs[order[lo]]
                end = min(common[lo : hi - 1], default=len(one))
                node = len(runs)
                runs.append(one[depth:end])
                parent.append(up)
                level.append(lev)
                last.append(int(one[end - 1]) if end else -1)
                span.append((lo, hi, end))
                x = lo
                here = []
                while x < hi and len(seqs[order[x]]) == end:  # sequences that end here sort first
                    here.append(order[x])
                    x += 1
                leaves.append(here)
                while x < hi:
                    y = x + 1
                    while y < hi and common[y - 1] > end:
                        y += 1
                    nxt.append((x, y, end, node, lev + 1))
                    x = y
            todo = nxt
        lens = np.array([len(r) for r in runs])
        self.tokens = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        self.cuts = np.concatenate(([0], np.cumsum(lens)))
        self.parent, self.level, self.last = np.array(parent), np.array(level), np.array(last)
        by = np.array([len(seqs[i]) for i in order])
        n = sizes[order]
        self.least = np.array([n[lo:hi].min() for lo, hi, _ in span])
        self.most = np.array([n[lo:hi].max() for lo, hi, _ in span])
        self.rest = np.array([by[lo:hi].max() - end for lo, hi, end in span])
        self.levels = [np.flatnonzero(self.level == v) for v in range(int(self.level.max()) + 1)] if len(runs) else []
        at = [(node, i) for node, here in enumerate(leaves) for i in here]
        self.leaf_node, self.leaf = (np.array(x) for x in zip(*at)) if at else (np.zeros(0, int), np.zeros(0, int))

    def alike(self, ranks: np.ndarray, size: int, mask: np.ndarray) -> np.ndarray:
        """Numbers of the sequences that are linked with the set of ``size`` whose ranks (rising) are given.

        ``mask`` is all False, as long as there are ranks, and is left so.
        """
        mask[ranks] = True
        total = np.concatenate(([0], np.cumsum(mask[self.tokens])))
        mask[ranks] = False
        own = total[self.cuts[1:]] - total[self.cuts[:-1]]
        left = len(ranks) - np.searchsorted(ranks, self.last, "right")
        fits = (5 * self.most >= 4 * size) & (4 * self.least <= 5 * size)
        overlap, alive = own.copy(), fits.copy()
        for v, nodes in enumerate(self.levels):
            if v:
                nodes = nodes[alive[self.parent[nodes]] & fits[nodes]]
                overlap[nodes] += overlap[self.parent[nodes]]
            else:
                nodes = nodes[fits[nodes]]
            ok = linked(overlap[nodes] + np.minimum(left[nodes], self.rest[nodes]), size, self.least[nodes])
            alive[self.levels[v]] = False
            alive[nodes[ok]] = True
            if not ok.any():
                break
        else:
            v = len(self.levels) - 1
        for deeper in self.levels[v + 1 :]:
            alive[deeper] = False
        hit = alive[self.leaf_node]
        i, node = self.leaf[hit], self.leaf_node[hit]
        return i[linked(overlap[node], size, self.sizes[i])]


def block_links(sids: np.ndarray, sets: list[np.ndarray], resident: np.ndarray, visitor: np.ndarray) -> list[tuple[int, int]]:
    """Links between residents and visitors of a block that join parts of it."""
    if not (resident.any() and visitor.any()):
        return []
    sizes = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    keys, index, times = np.unique(every, return_inverse=True, return_counts=True)
    # ranks: the most frequent first; a shingle of one set alone matches nothing and stays out of the sequences
    order = np.lexsort((keys, -times))
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    use = int((times > 1).sum())
    ranks = np.split(rank[index], np.cumsum(sizes)[:-1])
    seqs = [np.sort(r[r < use]) for r in ranks]
    home = np.flatnonzero(resident)
    trie = Trie([seqs[i] for i in home], sizes[home])
    up = list(range(len(sids)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out, mask = [], np.zeros(max(1, use), bool)
    for q in np.flatnonzero(visitor).tolist():
        for r in home[trie.alike(seqs[q], int(sizes[q]), mask)].tolist():
            a, b = find(q), find(r)
            if a != b:
                up[a] = b
                out.append((int(sids[q]), int(sids[r])))
    return out


def _block_links(table: pa.Table) -> pa.Table:
    table = table.sort_by([("home", "ascending"), ("block", "ascending"), ("sid", "ascending")])
    home, block = table["home"].to_numpy(), table["block"].to_numpy()
    sids, res, vis = table["sid"].to_numpy(), table["resident"].to_numpy(), table["visitor"].to_numpy()
    data = table["shingles"].combine_chunks()
    once = np.append(True, (home[1:] != home[:-1]) | (block[1:] != block[:-1]) | (sids[1:] != sids[:-1])) if len(home) else np.zeros(0, bool)
    if not once.all():  # a document that stands in the table twice
        return _block_links(table.filter(pa.array(once)))
    new = np.flatnonzero(np.append(True, (home[1:] != home[:-1]) | (block[1:] != block[:-1]))) if len(home) else np.zeros(0, int)
    links = []
    for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(home)]):
        if hi - lo > 1:
            links += block_links(sids[lo:hi], [np.frombuffer(data[i].as_py(), np.uint64) for i in range(lo, hi)], res[lo:hi], vis[lo:hi])
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _whole_sets(batches):
    """A row for each place of a text's set: (home, block, sid, resident, visitor, shingles)."""
    names = ["home", "block", "sid", "resident", "visitor", "shingles"]
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in names}
        places = batch.column("places").to_pylist()
        for s in words.slices(batch.column("text"), words.SPACED, True):
            off, w = shingle_sets(s)
            for d, sid in enumerate(set_ids(off, w).tolist()):
                data = w[off[d] : off[d + 1]].tobytes()
                for x in places[s.lo + d]:
                    for c, v in zip(names, (x["home"], x["block"], sid, x["resident"], x["visitor"], data)):
                        rows[c].append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=names)


def members_and_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``members(id, tkey, n, sid)`` of every document, and ``links(a, b)`` between sets."""
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text"))
    members = materialize(d.mapInArrow(_members, "id long, tkey long, n long, sid long"), "op3-members")
    buckets = exchange.bucket_count(exchange.total_bytes(d, "text"))

    often = d.select("text").mapInArrow(_often, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    hot = often.filter(F.col("c") >= HOT_LEAST).orderBy(F.desc("c"), "h").limit(HOT).collect()  # at most HOT rows
    order = sc.broadcast(vars(Order(np.array([r.h for r in reversed(hot)], np.int64).view(np.uint64))))

    def live_sets() -> DataFrame:
        chunks = materialize(d.select("text").mapInArrow(_prefixes(order), "chunk long, sids binary, ns binary, ps binary, prefix binary"), "op3-chunks")
        got = exchange.answers(chunks.mapInArrow(_asks(buckets), exchange.ASK), _shared)
        live = chunks.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(_live, "sid long, n long, tokens array<long>, home long")
        # a set that several chunks have: one of their rows, chosen alike each time
        return live.groupBy("sid").agg(F.min(F.struct("home", "n", "tokens")).alias("x")).select("sid", "x.*")

    live = materialize_alone(docs.sparkSession, live_sets, "op3-live")  # from here on no prefix is read

    shared = live.select("sid", "n", "home", F.explode("tokens").alias("token"))
    homes = shared.groupBy("token", "home").agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumnRenamed("home", "at")
    visits = shared.join(homes, "token").filter((F.col("n") * 4 <= F.col("most") * 5) & (F.col("n") * 5 >= F.col("least") * 4))
    visits = visits.groupBy("sid", "at").agg(
        F.first("n").alias("n"), F.first(F.col("home") == F.col("at")).alias("resident"), F.count("*").alias("common"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    # enough common shingles for some size between least and most (the least is at an end, give or take one)
    low, high = F.greatest("least", F.ceil(F.col("n") * 4 / 5)), F.least("most", F.floor(F.col("n") * 5 / 4))
    outside = lambda m: F.greatest(F.lit(0), F.ceil(m * 4 / 5) - 1 - F.ceil(m / 20))  # noqa: E731  size - prefix_length(size)
    need = F.least(*[F.ceil((F.col("n") + b) * 4 / 9) - F.greatest(outside(F.col("n")), outside(b)) - 1 for b in (low, high)])
    visits = materialize(visits.filter(F.col("resident") | (F.col("common") >= need)).drop("common", "least", "most"), "op3-visits")
    # a home that only one set visits has no link
    size = visits.groupBy("at").agg(F.count("*").alias("sets"), F.sum("n").alias("all_n"), F.sum(F.when(F.col("resident"), F.col("n")).otherwise(0)).alias("res_n")).filter("sets > 1")
    cut = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK_SHINGLES)).cast("int")
    size = size.select("at", cut("res_n").alias("rs"), cut("all_n").alias("vs"))
    placed = visits.join(size, "at").withColumn("block", F.explode(F.expr("sequence(0, rs * vs - 1)")))
    placed = placed.withColumn("visitor", F.col("block") % F.col("vs") == F.pmod(F.xxhash64("sid"), F.col("vs")))
    placed = placed.withColumn("resident", F.col("resident") & (F.floor(F.col("block") / F.col("vs")) == F.pmod(F.xxhash64("sid", F.lit(1)), F.col("rs"))))
    placed = placed.filter("visitor or resident").withColumn("block", F.col("block").cast("long"))
    total = int(placed.agg(F.sum("n")).first()[0] or 0)
    placed = placed.groupBy("sid").agg(F.collect_list(F.struct(F.col("at").alias("home"), "block", "resident", "visitor")).alias("places"))

    # the sets themselves, from one document of each; other texts are not shuffled
    one = members.filter("n > 0").groupBy("sid").agg(F.min(F.struct("id", "tkey")).alias("x"))
    one = materialize(one.join(placed, "sid").select(F.col("x.id").alias("rid"), F.col("x.tkey").alias("rkey"), "places"), "op3-places")
    maybe, _ = exchange.split_by_key(d, one, ["id", "tkey"], ["rid", "rkey"])
    texts = maybe.join(one, maybe["id"].eqNullSafe(F.col("rid")) & (maybe["tkey"] == F.col("rkey"))).select("text", "places")
    blocks = texts.mapInArrow(_whole_sets, "home long, block long, sid long, resident boolean, visitor boolean, shingles binary")
    parts = max(1, -(-total // BUCKET_SHINGLES)) * 8
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("home", "block"), F.lit(parts)))
    return members, blocks.groupBy("part").applyInArrow(_block_links, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tkey, n_shingles, root, component_id``: the smallest id that links reach (its own for an empty set).

    What the links were made from is deleted once every document has its root.
    """

    def names() -> DataFrame:
        members, links = members_and_links(docs, id_col, text_col)
        roots = connected(links)
        return members.join(roots, members["sid"] == roots["node"], "left").select("id", "tkey", "n", F.coalesce("root", "sid").alias("root"))

    named = materialize_alone(docs.sparkSession, names, "op3-named")
    least = materialize(named.filter("n > 0").groupBy("root").agg(F.min("id").alias("least")), "op3-least")
    out = named.join(least, "root", "left")
    return out.select("id", "tkey", F.col("n").alias("n_shingles"), "root", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component (the smallest id); those without words all stay."""
    c = jaccard_components(docs, id_col, text_col).filter("n_shingles > 0")
    c = c.groupBy("root", "id", "tkey").agg(F.count("*").alias("rows"))
    c = materialize(c.withColumn("rank", F.struct(F.col("id").isNull(), "id", "tkey")), "op3-rows")
    first = materialize(c.groupBy(F.col("root").alias("r")).agg(F.min("rank").alias("first")), "op3-first")
    named = c.join(first, F.col("root") == F.col("r"))
    stays = F.col("rank").eqNullSafe(F.col("first"))
    kept = exchange.without(docs, named.filter(~stays), id_col, text_col)
    # rows that repeat in every way but are to stay once
    again = materialize(named.filter(stays & (F.col("rows") > 1)).select(F.col("id").alias("__id"), F.col("tkey").alias("__key")), "op3-again")
    kept = kept.withColumn("__tid", F.col(id_col).cast("long")).withColumn("__tkey", F.xxhash64(text_col))
    maybe, rest = exchange.split_by_key(kept, again, ["__tid", "__tkey"], ["__id", "__key"])
    on = F.col("__tid").eqNullSafe(F.col("__id")) & (F.col("__tkey") == F.col("__key"))
    once = maybe.join(again, on, "left_semi").dropDuplicates([id_col, "__tkey"])
    return once.unionByName(maybe.join(again, on, "left_anti")).unionByName(rest).drop("__tid", "__tkey")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
