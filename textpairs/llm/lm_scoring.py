"""Language-model scores of whole texts: a log-bilinear model beside a smoothed unigram base.

*Counts.* Every distinct word of the training documents is counted over the whole corpus: each chunk
of documents asks the hash buckets for the counts of its own distinct words (one entry a chunk,
however frequent the word) and gets them back in order.

*Model.* Every training word has a *slot*: of each hash bucket's words the most frequent have one each, the
others share as many by their hash.  There are about ``2 * distinct words ** (2 / 3)`` slots, ``VOCAB`` at least,
so the model grows with the words of the corpus; while the words fit into ``VOCAB`` each has its own.  A slot has
vectors Q (as context), R (as target) and a bias; inside a shared slot a word has its smoothed unigram share.
Slots of neighbouring frequency form *groups*, about the square root of the slots in number and in size, with
vectors S.  After tokens u, v the context is ``c = Q[u] * A + Q[v] * B``, and a token of slot w in group g has
``P(g | c) * P(w | g, c)``: a softmax of ``c . S + d`` over all groups times one of ``c . R + b`` over the group's
slots, both normalised exactly for every token, by matrix products over the distinct contexts of a chunk.  Both are
trained by noise-contrastive estimation on all training documents, with noise that examples of one group share, so that
scores and gradients are matrix products too.  The model has these two levels at every size: every partition of chunks runs its own stochastic gradient from one common start; the groups'
parameters are averaged by tokens, a slot's by how often each partition met it, and a partition sends only the
slots it met.

Defined cases: a null or empty text is one end token; a null id hashes as the empty text and so is held
out; with nothing to train on every count is 0 and the model is the uniform one; equal rows get
equal scores; other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.llm import exchange, words
from textpairs.session import scratch_path

VOCAB = 1024
WIDTH = 16
NOISE = 24
#: examples of one group that share noise slots, and how many; each stands for NOISE / DRAWS
TILE = 32
DRAWS = 16
BATCH = 4096
RATE = 0.08
CHUNK_BYTES = 12 << 20
END = np.uint64(0x7E57E4D0C0FFEE11)
RARE = 0
#: slots whose parameters travel and are averaged together
BLOCK = 1 << 10

CHUNKS = "chunk long, ids array<long>, held array<boolean>, lens array<int>, index binary, asks array<struct<bucket:long,keys:binary,vals:binary>>"
_ASKS = pa.list_(pa.struct([("bucket", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())]))


def _chunks(folds: int, fold: int, buckets: int):
    def row(number, ids, tokens, lens):
        h, lens = np.concatenate(tokens), np.concatenate(lens)
        held = np.array([words.id_crc(i) % folds == fold for i in ids])
        distinct, index = np.unique(h, return_inverse=True)
        counts = np.bincount(index[~np.repeat(held, lens)], minlength=len(distinct)).astype(np.int32)
        cuts = exchange.bucket_cuts(distinct, buckets)
        asks = [{"bucket": int(b), "keys": distinct[cuts[b] : cuts[b + 1]].tobytes(), "vals": counts[cuts[b] : cuts[b + 1]].tobytes()} for b in np.flatnonzero(np.diff(cuts))]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([lens.astype(np.int32)], pa.list_(pa.int32())), pa.array([index.astype(np.int32).tobytes()], pa.binary()), pa.array([asks], _ASKS)],
            names=["chunk", "ids", "held", "lens", "index", "asks"],
        )

    def run(batches):
        task, seq, size = TaskContext.get().partitionId(), 0, 0
        ids, tokens, lens = [], [], []
        for batch in batches:
            all_ids = batch.column(0).to_pylist()
            for s in words.slices(batch.column(1), words.SPACED, True):
                ids += all_ids[s.lo : s.hi]
                tokens.append(np.insert(words.word_hashes(s), s.off[1:], END))
                lens.append(s.counts + 1)
                size += len(s.buf)
                if size >= CHUNK_BYTES:
                    yield row(exchange.chunk_number(task, seq), ids, tokens, lens)
                    seq, size, ids, tokens, lens = seq + 1, 0, [], [], []
        if ids:
            yield row(exchange.chunk_number(task, seq), ids, tokens, lens)

    return run


def own_slots(distinct: int, buckets: int) -> int:
    """Words of a bucket with ``distinct`` training words that get a slot each; the others share as many."""
    return max(math.ceil((distinct * buckets) ** (2 / 3) / buckets), math.ceil(VOCAB / buckets))


def shared_slot(h: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (words.mix(h ^ END) % np.asarray(m).astype(np.uint64)).astype(np.int64)


def _count(buckets: int):
    """Corpus counts of a bucket's words; its first row also has the bucket's totals and slots."""

    def answer(keys, vals):
        sizes = [len(x) for x in keys]
        distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        np.add.at(counts, index, np.frombuffer(b"".join(vals), np.int32))
        order = np.lexsort((distinct, -counts))
        order = order[(counts[order] > 0) & (distinct[order] != END)]
        size = own_slots(len(order), buckets)
        own, rest = order[:size], order[size:]
        m = min(size, len(rest))
        at = shared_slot(distinct[rest], m) if m else np.zeros(0, np.int64)
        first = lambda x: [x.tobytes(), *([b""] * (len(sizes) - 1))]
        more = [0] * (len(sizes) - 1)
        return [x.tobytes() for x in np.split(counts[index], np.cumsum(sizes)[:-1])], {
            "seen": pa.array([int((counts > 0).sum()), *more], pa.int64()),
            "tokens": pa.array([int(counts.sum()), *more], pa.int64()),
            "own": pa.array(first(distinct[own]), pa.binary()),
            "own_n": pa.array(first(counts[own]), pa.binary()),
            "shared_n": pa.array(first(np.bincount(at, counts[rest], m).astype(np.int64)), pa.binary()),
            "shared_words": pa.array(first(np.bincount(at, minlength=m).astype(np.int64)), pa.binary()),
        }

    return answer


class Vocabulary:
    """Slot numbers of token hashes: 0 is for words of buckets without shared slots, 1 the end token, then words, then shared slots.

    ``shared``: for each bucket the tokens and the distinct words of its shared slots.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ends: int, rare: int, shared: list[tuple[np.ndarray, np.ndarray]] = ()):
        self.keys = np.append(END, keys)
        self.buckets = max(1, len(shared))
        self.shared = np.array([len(n) for n, _ in shared] or [0], np.int64)
        self.offset = 1 + len(self.keys) + np.cumsum(self.shared) - self.shared
        self.counts = np.concatenate(([rare, ends], counts, *[n for n, _ in shared])).astype(float)
        #: words among which a slot's tokens are shared out; 0 is a word's own slot
        self.words = np.concatenate((np.zeros(len(self.keys) + 1), *[k for _, k in shared]))
        order = np.argsort(self.keys)
        self.sorted, self.number = self.keys[order], (order + 1).astype(np.int32)
        self.size = len(self.counts)

    def of(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        bucket = (h >> np.uint64(64 - self.buckets.bit_length() + 1)).astype(np.int64) if self.buckets > 1 else np.zeros(len(h), np.int64)
        m = self.shared[bucket]
        other = np.where(m > 0, self.offset[bucket] + shared_slot(h, np.maximum(m, 1)), RARE)
        return np.where(self.sorted[at] == h, self.number[at], other).astype(np.int32)

    def log_inside(self, slot: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 share of a word with corpus count c in its slot."""
        alone = (slot > RARE) & (self.words[slot] == 0)
        return np.where(alone, 0.0, np.log10((c + 0.1) / (self.counts[slot] + 0.1 * (self.words[slot] + 1))))


class LogBilinear:
    """Parameters and gradient steps, in float32; the last column of ``rb`` and ``sd`` is a bias."""

    def __init__(self, v: Vocabulary, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        share = (v.counts + 0.5) / (v.counts + 0.5).sum()
        self.width = math.isqrt(v.size - 1) + 1
        self.order = np.argsort(-share, kind="stable")  # group g is order[g * width : (g + 1) * width]
        self.group = np.empty(v.size, np.int32)
        self.group[self.order] = np.arange(v.size) // self.width
        self.total = np.concatenate(([0.0], np.cumsum(share[self.order])))
        self.noise = np.bincount(self.group, share)
        self.log_share = np.log(share / self.noise[self.group]).astype(np.float32)
        self.q = rng.normal(0, 0.1, (v.size, WIDTH)).astype(np.float32)
        self.rb = np.concatenate((rng.normal(0, 0.1, (v.size, WIDTH)).astype(np.float32), self.log_share[:, None]), 1)
        self.a, self.b = np.ones(WIDTH, np.float32), np.full(WIDTH, 0.5, np.float32)
        self.sd = np.zeros((len(self.noise), WIDTH + 1), np.float32)
        self.sd[:, WIDTH] = np.log(self.noise)

    def dense(self) -> list[np.ndarray]:
        return [self.a, self.b, self.sd]

    def sparse(self) -> list[np.ndarray]:
        return [self.q, self.rb]

    def context(self, qu: np.ndarray, qv: np.ndarray) -> np.ndarray:
        """Contexts of the vectors Q[u], Q[v], with a last column of ones, which meets the biases."""
        c = np.ones((len(qu), WIDTH + 1), np.float32)
        np.multiply(qu, self.a, out=c[:, :WIDTH])
        c[:, :WIDTH] += qv * self.b
        return c

    def log_prob(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Natural log of P(w | u, v); u is the token just before w, v the one before that.

        The groups' normaliser is made once for each distinct context, a group's once for each distinct (group, context).
        """
        shift = (len(self.q) - 1).bit_length()
        pairs, context = np.unique(u.astype(np.int64) << shift | v, return_inverse=True)
        contexts = lambda part: self.context(self.q.take(part >> shift, axis=0), self.q.take(part & ((1 << shift) - 1), axis=0))
        over_groups = np.empty(len(pairs), np.float32)
        for lo in range(0, len(pairs), BLOCK):
            part = pairs[lo : lo + BLOCK]
            over_groups[lo : lo + BLOCK] = _log_sum(contexts(part) @ self.sd.T)
        asked, at = np.unique(self.group[w].astype(np.int64) * len(pairs) + context, return_inverse=True)
        over_slots = np.empty(len(asked), np.float32)
        cuts = np.searchsorted(asked, np.arange(len(self.noise) + 1) * len(pairs))
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            rb = self.rb[self.order[g * self.width : (g + 1) * self.width]].T
            for lo in range(cuts[g], cuts[g + 1], BLOCK):
                hi = min(lo + BLOCK, cuts[g + 1])
                part = pairs[asked[lo:hi] - g * len(pairs)]
                over_slots[lo:hi] = _log_sum(contexts(part) @ rb)
        out = np.empty(len(w))
        for lo in range(0, len(w), 1 << 16):
            k = slice(lo, lo + (1 << 16))
            target = self.rb.take(w[k], axis=0)
            target += self.sd.take(self.group.take(w[k]), axis=0)
            out[k] = np.einsum("nw,nw->n", self.context(self.q.take(u[k], axis=0), self.q.take(v[k], axis=0)), target)
        return out - over_slots[at] - over_groups[context]

    def train(self, w: np.ndarray, u: np.ndarray, v: np.ndarray, seed: int) -> np.ndarray:
        """One pass of noise-contrastive estimation; returns how often each slot was met.

        A batch is cut into tiles of at most ``TILE`` examples of one group.  A tile shares ``DRAWS`` noise slots of its group,
        each standing for ``NOISE / DRAWS``; a batch shares ``NOISE`` noise groups.  So scores and gradients are matrix products.
        """
        rng = np.random.Generator(np.random.PCG64(seed))
        size, groups = len(self.q), len(self.noise)
        log_slots = self.log_share + np.float32(math.log(NOISE))
        log_groups = (np.log(self.noise) + math.log(NOISE)).astype(np.float32)
        group_total = np.cumsum(self.noise)
        dense, rows = self.dense(), self.sparse()
        power = [np.full_like(p, 1e-4) for p in dense]
        row_power = [np.full_like(p, 1e-4) for p in rows]
        met = np.bincount(w, minlength=size) + np.bincount(u, minlength=size) + np.bincount(v, minlength=size)
        order, number = rng.permutation(len(w)), np.empty(size, np.int64)
        narrow = np.uint16 if groups <= 1 << 16 else np.int32  # numpy sorts 16 bits by radix

        def step(p: np.ndarray, s: np.ndarray, g: np.ndarray) -> np.ndarray:
            """The new p; s is changed in place."""
            s += g * g
            g = np.float32(RATE) * g
            g /= np.sqrt(s)
            g += p
            return g

        def step_rows(j: int, at: np.ndarray, g: np.ndarray, n: int) -> None:
            number[at] = np.arange(len(at))  # one of a slot's places stays
            k = at[number[at] == np.arange(len(at))]
            number[k] = np.arange(len(k))
            index = number[at]
            sums = np.empty((g.shape[1], len(k)), np.float32)
            for x, out in zip(np.ascontiguousarray(g.T, float), sums):
                out[:] = np.bincount(index, x, len(k))
            s = row_power[j].take(k, axis=0)
            _put_rows(rows[j], k, step(rows[j].take(k, axis=0), s, np.ascontiguousarray(sums.T) / np.float32(n)))
            _put_rows(row_power[j], k, s)

        for lo in range(0, len(w), BATCH):
            i = order[lo : lo + BATCH]
            gi = self.group.take(w.take(i)).astype(narrow)
            sort = np.argsort(gi, kind="stable")
            i, gi = i[sort], gi[sort]
            n, wi, ui, vi = len(i), w.take(i), u.take(i), v.take(i)
            first = np.append(0, np.flatnonzero(gi[1:] != gi[:-1]) + 1)
            runs = np.diff(first, append=n)
            tiles = -(-runs // TILE)
            place = np.arange(n) + np.repeat((np.cumsum(tiles) - tiles) * TILE - first, runs)
            of_tile = np.repeat(gi[first].astype(np.int32), tiles)
            begin, end = of_tile * self.width, np.minimum((of_tile + 1) * self.width, size)
            draw = self.total[begin][:, None] + rng.random((len(of_tile), DRAWS)) * (self.total[end] - self.total[begin])[:, None]
            x = self.order[np.clip(np.searchsorted(self.total, draw.ravel(), "right").reshape(draw.shape) - 1, begin[:, None], end[:, None] - 1)]
            qu, qv, rw, sg, rx = (p.take(at, axis=0) for p, at in ((self.q, ui), (self.q, vi), (self.rb, wi), (self.sd, gi), (self.rb, x)))
            c = self.context(qu, qv)
            tiled = np.zeros((len(of_tile) * TILE, WIDTH + 1), np.float32)
            _put_rows(tiled, place, c)
            tiled = tiled.reshape(-1, TILE, WIDTH + 1)
            # an empty place has no column of ones, so its row is all zero and adds nothing below
            d = 1 / (1 + np.exp(np.einsum("nw,nw->n", c, rw) - log_slots[wi]))
            e = tiled @ rx.transpose(0, 2, 1)
            np.subtract(log_slots.take(x)[:, None, :], e, out=e)
            np.exp(e, out=e)
            e += 1
            np.divide(np.float32(-NOISE / DRAWS) * tiled[:, :, WIDTH:], e, out=e)
            gc = d[:, None] * rw
            gc += (e @ rx).reshape(-1, WIDTH + 1).take(place, axis=0)
            y = np.minimum(np.searchsorted(group_total, rng.random(NOISE) * group_total[-1]), groups - 1)
            dg = 1 / (1 + np.exp(np.einsum("nw,nw->n", c, sg) - log_groups[gi]))
            eg = c @ self.sd[y].T
            np.subtract(log_groups[y], eg, out=eg)
            np.exp(eg, out=eg)
            eg += 1
            np.divide(-1, eg, out=eg)
            gc += dg[:, None] * sg + eg @ self.sd[y]
            gs = np.zeros_like(self.sd)
            gs[gi[first]] = np.add.reduceat(dg[:, None] * c, first, axis=0)
            np.add.at(gs, y, eg.T @ c)
            gc = gc[:, :WIDTH]
            steps = [np.einsum("nw,nw->w", gc, qu), np.einsum("nw,nw->w", gc, qv), gs]
            met += np.bincount(x.ravel(), minlength=size)
            step_rows(1, np.concatenate((wi, x.ravel())), np.concatenate((d[:, None] * c, (e.transpose(0, 2, 1) @ tiled).reshape(-1, WIDTH + 1))), n)
            step_rows(0, np.concatenate((ui, vi)), np.concatenate((gc * self.a, gc * self.b)), n)
            for p, s, g in zip(dense, power, steps):
                p[:] = step(p, s, (g / n).astype(np.float32))
        return met


def _put_rows(p: np.ndarray, at: np.ndarray, new: np.ndarray) -> None:
    """``p[at] = new`` for rows of one type, each copied as a whole."""
    row = np.dtype((np.void, p.itemsize * p.shape[1]))
    p.view(row)[at, 0] = new.view(row)[:, 0]


def _log_sum(s: np.ndarray) -> np.ndarray:
    top = s.max(axis=1, keepdims=True)
    s -= top
    np.exp(s, out=s)
    return np.log(s.sum(axis=1)) + top[:, 0]


def _before(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two places before each, the end token where the document has none."""
    first = np.cumsum(lens) - lens
    u = np.concatenate(([1], ids[:-1])).astype(ids.dtype)
    v = np.concatenate(([1, 1], ids[:-2])).astype(ids.dtype)[: len(ids)]
    u[first] = v[first] = 1
    second = first[lens > 1] + 1
    v[second] = 1
    return u, v


def _chunk_arrays(batch, r: int):
    asks = batch.column("asks")[r].values
    keys = np.frombuffer(b"".join(x for x in asks.field("keys").to_pylist()), np.uint64)
    index = np.frombuffer(batch.column("index")[r].as_py(), np.int32)
    return keys, index, np.asarray(batch.column("lens")[r].values), np.asarray(batch.column("held")[r].values.to_numpy(zero_copy_only=False), bool)


STEPS = "block long, weight double, slots binary, met binary, steps binary"


def fit(chunks: DataFrame, v: Vocabulary) -> LogBilinear:
    """Every partition trains on all its training tokens from one start; its steps are averaged.

    Block -1 has the groups' parameters, weighted by tokens; the other blocks have the met slots, weighted by meetings.
    """
    held = chunks.sparkSession.sparkContext.broadcast(vars(v))
    names = [c.split()[0] for c in STEPS.split(", ")]

    def run(batches):
        vocab = words.revive(Vocabulary, held.value)
        model, seen, met = LogBilinear(vocab), 0, np.zeros(vocab.size)
        for batch in batches:
            for r in range(batch.num_rows):
                keys, index, lens, out = _chunk_arrays(batch, r)
                ids = vocab.of(keys)[index]
                u, w = _before(ids, lens)
                use = ~np.repeat(out, lens)
                met += model.train(ids[use], u[use], w[use], seed=11 + seen)
                seen += int(use.sum())
        if not seen:
            return
        start = LogBilinear(vocab)
        step = np.concatenate([(x - y).ravel() for x, y in zip(model.dense(), start.dense())]).astype(np.float32)
        rows = [(-1, b"", b"", step.tobytes())]
        for lo in range(0, vocab.size, BLOCK):
            k = lo + np.flatnonzero(met[lo : lo + BLOCK])
            if len(k):
                step = np.concatenate([x[k] - y[k] for x, y in zip(model.sparse(), start.sparse())], 1).astype(np.float16)
                rows.append((lo // BLOCK, (k - lo).astype(np.int32).tobytes(), met[k].astype(np.float32).tobytes(), step.tobytes()))
        for block, k, n, step in rows:
            cols = [pa.array([block], pa.int64()), pa.array([float(seen)]), *[pa.array([x], pa.binary()) for x in (k, n, step)]]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def average(table):
        block = table["block"][0].as_py()
        total, weight = 0.0, np.zeros(BLOCK)
        steps = np.zeros((BLOCK, 2 * WIDTH + 1)) if block >= 0 else 0.0
        for i in range(table.num_rows):
            n, k, met, step = (table[c][i].as_py() for c in names[1:])
            if block < 0:
                steps = steps + n * np.frombuffer(step, np.float32).astype(float)
                total += n
            else:
                k, met = np.frombuffer(k, np.int32), np.frombuffer(met, np.float32).astype(float)
                steps[k] += met[:, None] * np.frombuffer(step, np.float16).reshape(len(k), -1)
                weight[k] += met
        mean = steps / total if block < 0 else steps / np.maximum(weight, 1)[:, None]
        return pa.table({"block": pa.array([block], pa.int64()), "mean": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    got = chunks.select("index", "lens", "held", "asks").mapInArrow(run, STEPS)
    model = LogBilinear(v)
    for row in got.groupBy("block").applyInArrow(average, "block long, mean binary").toLocalIterator():  # slots / BLOCK rows
        mean, at = np.frombuffer(row.mean, np.float32), 0
        if row.block >= 0:
            mean, lo = mean.reshape(BLOCK, -1), row.block * BLOCK
            for p in model.sparse():
                n = len(p[lo : lo + BLOCK])
                p[lo : lo + BLOCK] += mean[:n, at : at + p.shape[1]]
                at += p.shape[1]
        else:
            for p in model.dense():
                p += mean[at : at + p.size].reshape(p.shape)
                at += p.size
    return model


def vocabulary(counts: DataFrame, buckets: int, ends: int) -> Vocabulary:
    """All slots, gathered from the buckets."""
    parts = {r.bucket: [np.frombuffer(x, t) for x, t in zip(r[1:], (np.uint64, np.int64, np.int64, np.int64))] for r in counts.filter("seen > 0").select("bucket", "own", "own_n", "shared_n", "shared_words").toLocalIterator()}
    none = [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]
    parts = [parts.get(b, none) for b in range(buckets)]
    return Vocabulary(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), ends, 0, [(x[2], x[3]) for x in parts])


SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(held, n: int, seen: int):
    def run(_, chunk: pa.Table, got: pa.Table) -> pa.Table:
        v, model = held.value
        v, model = words.revive(Vocabulary, v), words.revive(LogBilinear, model)
        if not chunk.num_rows:
            return pa.table({c.split()[0]: pa.array([], t) for c, t in zip(SCORES.split(", "), [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])})
        keys, index, lens, out = _chunk_arrays(chunk.combine_chunks().to_batches()[0], 0)
        c = np.frombuffer(exchange.joined(got), np.int64)
        base = np.log10((c + 0.1) / (n + 0.1 * (seen + 1)))
        number = v.of(keys)
        inside = v.log_inside(number, c)
        ids = number[index]
        u, w = _before(ids, lens)
        logp = model.log_prob(ids, u, w) / math.log(10) + inside[index]
        first = np.cumsum(lens) - lens
        add = lambda x: np.add.reduceat(x, first)
        return pa.table({
            "id": chunk["ids"].combine_chunks()[0].values, "held_out": pa.array(out), "n_tokens": pa.array(lens.astype(np.int64)),
            "n_known": pa.array(add((c > 0)[index].astype(np.int64))), "base_score": pa.array(add(base[index])), "score": pa.array(add(logp)),
        })

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, fold: int = 0) -> DataFrame:
    """Per document the contract's columns and ``score``, log10 of the text's probability.

    Documents whose ``crc32(id) % folds == fold`` are held out of all counts and of training.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = exchange.bucket_count(exchange.total_bytes(d, "text"))
    path = scratch_path(spark, "op9-chunks")
    d.mapInArrow(_chunks(folds, fold, buckets), CHUNKS).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.parquet(path)
    asks = chunks.select("chunk", F.explode("asks").alias("a")).select("chunk", "a.*")
    path = scratch_path(spark, "op9-counts")
    exchange.answers(asks, _count(buckets), "seen long, tokens long, own binary, own_n binary, shared_n binary, shared_words binary").write.option("compression", "zstd").parquet(path)
    counts = spark.read.parquet(path)
    seen, n = counts.agg(F.sum("seen"), F.sum("tokens")).first()
    seen, n = int(seen or 0), int(n or 0)
    ends = int(chunks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0)
    v = vocabulary(counts, buckets, ends)
    model = fit(chunks, v)
    held = spark.sparkContext.broadcast((vars(v), vars(model)))
    out = chunks.groupBy("chunk").cogroup(counts.select("chunk", "bucket", "answer").groupBy("chunk")).applyInArrow(_score(held, n, seen), SCORES)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
