"""Removal of repeated byte strings by suffix arrays, sorted deep and shallow.

A string of ``width`` bytes repeats if it starts at two places, in one text or in two.  Every place that starts one is
a suffix; suffixes that share their first ``width`` bytes stand side by side in a suffix array.

1. *Routing.* The name of a place is the least hash of the ``GRAM``-byte grams that its string holds, so equal strings have
   one name wherever they stand.  Neighbouring places named by the same gram make a *run*.  Chunks of documents ask the hash
   buckets which names stand for more than one run; a string with any other name cannot repeat, and is done.
2. *Texts of runs.* The bytes under each remaining run go to the bucket of its name, each distinct text of a chunk once
   with its number, so that a passage in a third of all documents costs one entry a chunk.
3. *Deep-shallow sorting.* A bucket sorts the suffixes of its distinct texts by multikey quicksort to ``SHALLOW`` bytes; the
   groups that are still equal there are ordered by blind tries, which compare branching bytes on the way down and one
   stored suffix in full.  Suffixes equal to ``width`` bytes that weigh two or more places repeat.
4. Each chunk gets a bit a place back, and the bytes under repeated strings are cut.

Strings are compared byte by byte; hashes only route.  Defined cases: a null text is empty; a text of fewer than ``width``
bytes keeps them all; rows that repeat, with or without an id, are texts of their own and repeat each other; what is
left need not be valid UTF-8, so it is binary; other columns stay, but for those named like the added ones, which are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpairs.llm import exchange, words
from textpairs.llm.multikey import ranges, three_way
from textpairs.session import materialize

WIDTH = 200
GRAM = 64
SHALLOW = 32
PIECE = 1 << 19
#: suffixes sorted at once, but for those of one name
SORTED = 1 << 18
_NULL_ID = np.iinfo(np.int64).max
_PLACE = np.uint64((1 << 20) - 1)


def _gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` neighbouring bytes, by its bytes alone."""
    up, down = words._POWERS.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(words._BYTE[buf] * up[: len(buf)], out=total[1:])
    return (total[k:] - total[:-k]) * down[: len(buf) - k + 1]


def _least_of(h: np.ndarray, k: int) -> np.ndarray:
    """The least of each ``k`` neighbours."""
    n, m = 1, h
    while 2 * n <= k:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    return np.minimum(m[: len(h) - k + 1], m[k - n :]) if k > n else m


def runs(buf: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, places, name) of the runs of texts ``buf[off[d]:off[d+1]]``; a document's runs cover all its places in order."""
    docs, sizes, names = [], [], []
    lo = 0
    places = np.maximum(np.diff(off) - width + 1, 0)
    while lo < len(buf):
        hi = min(len(buf), lo + PIECE)
        part = buf[lo : min(len(buf), hi + width - 1)]
        if len(part) >= width:
            h = _gram_hashes(part, gram)
            # the place in the low bits: of equal grams the first, so that a gram that occurs again makes a run again
            name = _least_of(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), width - gram + 1)
            a, b = int(np.searchsorted(off, lo, "right")) - 1, int(np.searchsorted(off, hi, "left"))
            first = np.maximum(off[a:b], lo)
            last = np.minimum(np.minimum(off[a:b] + places[a:b], hi), lo + len(name))
            size = np.maximum(last - first, 0)
            at = ranges(first - lo, size)
            if len(at):
                doc = np.repeat(np.arange(a, b), size)
                mine = name[at]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (mine[1:] != mine[:-1])))
                docs.append(doc[new])
                sizes.append(np.diff(np.append(new, len(at))))
                names.append(words.mix(h[(mine[new] & _PLACE).astype(np.int64)]))
        lo = hi
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(sizes), np.concatenate(names)


_CHUNK = "chunk long, ids binary, tkeys binary, counts binary, sizes binary, names binary"


def _chunks(width: int, gram: int):
    """Chunk rows: the runs of its documents (those that have any)."""

    def row(number, part):
        cols = dict(zip(("ids", "tkeys", "counts", "sizes", "names"), (np.concatenate(x) for x in zip(*part))))
        cols["sizes"] = cols["sizes"].astype(np.int32)
        return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in cols.items()})

    def run(batches):
        task, seq, size, part = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            ids, keys = words.ints(batch.column("id"), _NULL_ID), words.ints(batch.column("tkey"), 0)
            for lo, hi, buf, off in text_slices(batch.column("text")):
                doc, sizes, names = runs(buf, off, width, gram)
                counts = np.bincount(doc, minlength=hi - lo)
                some = counts > 0
                part.append((ids[lo:hi][some], keys[lo:hi][some], counts[some], sizes, names))
                size += len(buf)
                if size >= exchange.CHUNK_BYTES:
                    yield row(exchange.chunk_number(task, seq), part)
                    seq, size, part = seq + 1, 0, []
        if part:
            yield row(exchange.chunk_number(task, seq), part)

    return run


def text_slices(col, max_bytes: int | None = None):
    """(first document, end, bytes, offsets) of runs of whole texts of about ``max_bytes``."""
    data, off = words.text_bytes(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (max_bytes or words.SLICE_BYTES), "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def _asks(buckets: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                keys, times = np.unique(np.frombuffer(batch["names"][r].as_py(), np.uint64), return_counts=True)
                times = np.minimum(times, 2).astype(np.uint8)
                cuts = exchange.bucket_cuts(keys, buckets)
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array(np.full(len(used), batch["chunk"][r].as_py())), "bucket": pa.array(used.astype(np.int64)),
                    "keys": pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()), "vals": pa.array([times[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()),
                })

    return run


def _more_than_one(keys, vals):
    """For each name of a chunk 1 if it stands for two runs or more in all."""
    _, index = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(index, np.frombuffer(b"".join(vals), np.uint8))
    return [x.tobytes() for x in np.split((total > 1).astype(np.uint8)[index], np.cumsum([len(x) for x in keys])[:-1])], {}


def _open_runs(_, chunk: pa.Table, got: pa.Table) -> pa.Table:
    """``(id, tkey, runs)``: first place, places (int32) and name of the runs that may repeat."""
    ids, keys, out = [], [], []
    if chunk.num_rows and got.num_rows:
        c = {n: np.frombuffer(chunk[n][0].as_py(), t) for n, t in (("ids", np.int64), ("tkeys", np.int64), ("counts", np.int64), ("sizes", np.int32), ("names", np.uint64))}
        _, index = np.unique(c["names"], return_inverse=True)
        open_ = np.frombuffer(exchange.joined(got), np.uint8)[index] > 0
        ends = np.cumsum(c["counts"])
        before = np.cumsum(c["sizes"].astype(np.int64)) - c["sizes"]
        first = before - np.repeat(before[ends - c["counts"]], c["counts"])
        for d in np.flatnonzero(np.add.reduceat(open_.astype(np.int64), ends - c["counts"])).tolist():
            at = np.arange(ends[d] - c["counts"][d], ends[d])
            at = at[open_[at]]
            size, name = c["sizes"][at].astype(np.int64), c["names"][at]
            # neighbouring runs of one name (a text that repeats a few bytes) are one from here on
            new = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (first[at][1:] != (first[at] + size)[:-1])))
            size, name, begin = np.add.reduceat(size, new), name[new], first[at][new]
            ids.append(None if c["ids"][d] == _NULL_ID else int(c["ids"][d]))
            keys.append(int(c["tkeys"][d]))
            out.append(np.stack([begin.astype(np.uint64) << np.uint64(32) | size.astype(np.uint64), name], 1).tobytes())
    return pa.table({"id": pa.array(ids, pa.int64()), "tkey": pa.array(keys, pa.int64()), "runs": pa.array(out, pa.binary())})


_TEXTS = "chunk long, ids binary, tkeys binary, counts binary, firsts binary, sizes binary, which binary, names binary, lens binary, times binary, blob binary"


def _run_texts(width: int):
    """Chunk rows: runs of documents, and their distinct texts by name with their numbers."""

    def row(number, part):
        docs, every = [], []
        for doc, key, data, text in part:
            info = np.frombuffer(data, np.uint64).reshape(-1, 2)
            first, size = (info[:, 0] >> np.uint64(32)).astype(np.int64), (info[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            docs.append((doc, key, first, size))
            every += [(n, text[a : a + s + width - 1]) for n, a, s in zip(info[:, 1].tolist(), first.tolist(), size.tolist())]
        number_of: dict[tuple, int] = {}
        which = np.array([number_of.setdefault(x, len(number_of)) for x in every], np.int64)
        distinct = list(number_of)
        order = sorted(range(len(distinct)), key=distinct.__getitem__)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which = place[which]
        cols = {
            "ids": np.array([d[0] for d in docs], np.int64), "tkeys": np.array([d[1] for d in docs], np.int64), "counts": np.array([len(d[2]) for d in docs], np.int64),
            "firsts": np.concatenate([d[2] for d in docs]), "sizes": np.concatenate([d[3] for d in docs]), "which": which, "names": np.array([distinct[i][0] for i in order], np.uint64),
            "lens": np.array([len(distinct[i][1]) for i in order], np.int64), "times": np.bincount(which, minlength=len(order)).astype(np.int64),
        }
        values = {"chunk": pa.array([number], pa.int64())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in cols.items()}
        return pa.RecordBatch.from_pydict(values | {"blob": pa.array([b"".join(distinct[i][1] for i in order)], pa.binary())})

    def run(batches):
        task, seq, size, part = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            ids, keys = words.ints(batch.column("id"), _NULL_ID), words.ints(batch.column("tkey"), 0)
            for i, (data, text) in enumerate(zip(batch.column("runs"), batch.column("text").cast(pa.large_binary()))):
                part.append((int(ids[i]), int(keys[i]), data.as_py(), text.as_py()))
                info = np.frombuffer(part[-1][2], np.uint64)[::2] & np.uint64(0xFFFFFFFF)
                size += int(info.sum()) + len(info) * width  # the bytes of its runs' texts
                if size >= exchange.CHUNK_BYTES:
                    yield row(exchange.chunk_number(task, seq), part)
                    seq, size, part = seq + 1, 0, []
        if part:
            yield row(exchange.chunk_number(task, seq), part)

    return run


def _text_asks(buckets: int):
    """The distinct run texts of a chunk, cut by bucket."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                names, lens, times = (np.frombuffer(batch[c][r].as_py(), t) for c, t in (("names", np.uint64), ("lens", np.int64), ("times", np.int64)))
                blob = batch["blob"][r].as_py()
                cuts = exchange.bucket_cuts(names, buckets)
                at = np.concatenate(([0], np.cumsum(lens)))
                used = np.flatnonzero(np.diff(cuts)).tolist()
                out = {"chunk": pa.array(np.full(len(used), batch["chunk"][r].as_py())), "bucket": pa.array(used, pa.int64())}
                for c, x in (("names", names), ("lens", lens.astype(np.int32)), ("times", np.minimum(times, 2).astype(np.uint8))):
                    out[c] = pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary())
                yield pa.RecordBatch.from_pydict(out | {"blob": pa.array([blob[at[cuts[b]] : at[cuts[b + 1]]] for b in used], pa.binary())})

    return run


class BlindTrie:
    """A trie of strings of one length that keeps only branching places; equal strings share a leaf.

    An inner node is ``[place, {byte: node}]``, a leaf ``(string, members)``.
    """

    def __init__(self):
        self.root = None

    def add(self, text: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = (text, [member])
            return
        while isinstance(node, list):  # blindly: only the branching byte is looked at
            down = node[1].get(text[node[0]])
            if down is None:
                down = next(iter(node[1].values()))
            node = down
        other = node[0]
        if other == text:
            node[1].append(member)
            return
        n = len(text)
        differ = int.from_bytes(text, "big") ^ int.from_bytes(other, "big")
        common = n - (differ.bit_length() + 7) // 8
        up, node = None, self.root
        while isinstance(node, list) and node[0] < common:
            up, node = node, node[1][text[node[0]]]
        leaf = (text, [member])
        if isinstance(node, list) and node[0] == common:
            node[1][text[common]] = leaf
            return
        fork = [common, {other[common]: node, text[common]: leaf}]
        if up is None:
            self.root = fork
        else:
            up[1][text[up[0]]] = fork

    def leaves(self):
        """Members of the leaves in the order of their strings."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def deep_shallow(text: bytes, places: np.ndarray, width: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their suffixes' first ``width`` bytes, whether each differs from the one before).

    Every place has at least ``width`` bytes of ``text`` from it on, and ``text`` eight more at its end.
    """
    order = places.copy()
    new = np.ones(len(order), bool)
    eight = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    levels = min(shallow, width) // 8
    start, size = three_way(order, lambda p, d: eight[p + 8 * d].astype(np.uint64), levels)
    skip = 8 * levels
    if not levels and len(order):
        start, size = np.zeros(1, np.int64), np.array([len(order)])
    for s, n in zip(start.tolist(), size.tolist()):
        if n < 2:
            continue
        trie = BlindTrie()
        for p in order[s : s + n].tolist():
            trie.add(text[p + skip : p + width], p)
        at = s
        for members in trie.leaves():
            order[at : at + len(members)] = members
            new[at + 1 : at + len(members)] = False
            at += len(members)
    return order, new


def repeated_places(texts: list[bytes], times: np.ndarray, width: int) -> list[np.ndarray]:
    """For each distinct text and each place of it whether its string repeats; ``times``: how often each text occurs."""
    lens = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lens) - lens
    places = np.maximum(lens - width + 1, 0)
    order, new = deep_shallow(b"".join(texts) + bytes(8), ranges(begin, places), width)
    flag = np.zeros(int(lens.sum()), bool)
    if len(order):
        group = np.cumsum(new) - 1
        weight = np.bincount(group, times[np.searchsorted(begin, order, "right") - 1])
        flag[order] = weight[group] > 1
    return [flag[a : a + n] for a, n in zip(begin.tolist(), places.tolist())]


def _sorted_bucket(width: int):
    """Answers a bucket's chunks: a bit for each place of their run texts."""

    def one(table: pa.Table) -> pa.Table:
        names, lens, times = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table[c]]) for c, t in (("names", np.uint64), ("lens", np.int32), ("times", np.uint8)))
        cuts = np.cumsum([len(x.as_py()) // 8 for x in table["names"]])
        blob = b"".join(x.as_py() for x in table["blob"])
        at = np.concatenate(([0], np.cumsum(lens.astype(np.int64))))
        flags: list = [None] * len(names)
        order = np.argsort(names, kind="stable")
        first = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1]))
        sizes = np.add.reduceat((lens - width + 1)[order].astype(np.int64), first)
        group, held = [], 0

        def sort_them(members: list[int]) -> None:
            number: dict[bytes, int] = {}
            which = [number.setdefault(blob[at[i] : at[i + 1]], len(number)) for i in members]
            got = repeated_places(list(number), np.bincount(which, times[members]), width)
            for i, x in zip(members, which):
                flags[i] = got[x]

        for a, b, n in zip(first.tolist(), [*first[1:].tolist(), len(order)], sizes.tolist()):
            if group and held + n > SORTED:
                sort_them(group)
                group, held = [], 0
            group += order[a:b].tolist()
            held += n
        if group:
            sort_them(group)
        out, lo = [], 0
        for hi in cuts.tolist():
            out.append(np.packbits(np.concatenate(flags[lo:hi])).tobytes())
            lo = hi
        return pa.table({"chunk": table["chunk"].combine_chunks(), "bucket": table["bucket"].combine_chunks(), "answer": pa.array(out, pa.binary())})

    return one


def _spans(buckets: int, width: int):
    """``(id, tkey, spans)`` of documents that lose bytes: byte ranges as int64 pairs."""

    def run(_, chunk: pa.Table, got: pa.Table) -> pa.Table:
        ids, keys, out = [], [], []
        if chunk.num_rows and got.num_rows:
            c = {n: np.frombuffer(chunk[n][0].as_py(), np.uint64 if n == "names" else np.int64) for n in ("ids", "tkeys", "counts", "firsts", "sizes", "which", "names", "lens")}
            places = c["lens"] - width + 1
            cuts = exchange.bucket_cuts(c["names"], buckets)
            ends = np.concatenate(([0], np.cumsum(places)))
            order = np.argsort(got["bucket"].to_numpy())
            flags = np.concatenate([np.unpackbits(np.frombuffer(got["answer"][int(i)].as_py(), np.uint8), count=int(ends[cuts[b + 1]] - ends[cuts[b]])) for i, b in zip(order, got["bucket"].to_numpy()[order].tolist())])
            hi = np.cumsum(c["counts"])
            for d in range(len(hi)):
                r = np.arange(hi[d] - c["counts"][d], hi[d])
                size = c["sizes"][r]
                at = ranges(c["firsts"][r], size)[flags[ranges(ends[c["which"][r]], size)] > 0]
                if len(at):
                    first = np.append(True, at[1:] > at[:-1] + width)
                    last = np.append(first[1:], True)
                    ids.append(None if c["ids"][d] == _NULL_ID else int(c["ids"][d]))
                    keys.append(int(c["tkeys"][d]))
                    out.append(np.stack([at[first], at[last] + width], 1).tobytes())
        return pa.table({"id": pa.array(ids, pa.int64()), "tkey": pa.array(keys, pa.int64()), "spans": pa.array(out, pa.binary())})

    return run


def _with_texts(d: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """``id, tkey, text`` and ``column`` of the documents in ``found(id, tkey, column)``; other texts are not shuffled."""
    found = found.select(F.col("id").alias("__id"), F.col("tkey").alias("__key"), column)
    maybe, _ = exchange.split_by_key(d, found, "tkey", "__key")
    return maybe.join(found, maybe["id"].eqNullSafe(F.col("__id")) & (maybe["tkey"] == F.col("__key"))).drop("__id", "__key")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(id, tkey, spans)`` of the documents that lose bytes; tkey is the text's xxhash64."""
    gram = min(GRAM, max(1, width // 3))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text"))
    buckets = exchange.bucket_count(exchange.total_bytes(d, "text"))
    chunks = materialize(d.mapInArrow(_chunks(width, gram), _CHUNK), "op12-runs")
    got = exchange.answers(chunks.select("chunk", "names").mapInArrow(_asks(buckets), exchange.ASK), _more_than_one)
    open_ = chunks.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(_open_runs, "id long, tkey long, runs binary")
    # rows that repeat in id and text have the same runs
    open_ = materialize(open_.groupBy("id", "tkey").agg(F.first("runs").alias("runs")), "op12-open")
    texts = materialize(_with_texts(d, open_, "runs").mapInArrow(_run_texts(width), _TEXTS), "op12-texts")
    asks = texts.select("chunk", "names", "lens", "times", "blob").mapInArrow(_text_asks(buckets), "chunk long, bucket long, names binary, lens binary, times binary, blob binary")
    flags = asks.groupBy("bucket").applyInArrow(_sorted_bucket(width), "chunk long, bucket long, answer binary")
    spans = texts.drop("times", "blob").groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(_spans(buckets, width), "id long, tkey long, spans binary")
    return spans.groupBy("id", "tkey").agg(F.first("spans").alias("spans"))


def _cut(columns: list[str], text: str):
    def run(batches):
        for batch in batches:
            size, gone, number, kept = [], [], [], []
            for raw, data in zip(batch.column(text).cast(pa.large_binary()), batch.column("__spans")):
                raw, spans = raw.as_py() or b"", np.frombuffer(data.as_py(), np.int64).reshape(-1, 2)
                edges = [0, *spans.ravel().tolist(), len(raw)]
                size.append(len(raw))
                gone.append(int((spans[:, 1] - spans[:, 0]).sum()))
                number.append(len(spans))
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            added = [pa.array(x, pa.int64()) for x in (size, gone, number)] + [pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + added, names=[*columns, *_ADDED])

    return run


_ADDED = ["n_bytes", "n_removed", "n_spans", "kept"]


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed stretches) and ``kept`` (binary).

    ``keep_text=False`` leaves the original text column out of the result.
    """
    docs = docs.drop(*_ADDED)
    spans = materialize(repeated_spans(docs, id_col, text_col, width).select(F.col("id").alias("__id"), F.col("tkey").alias("__key"), F.col("spans").alias("__spans")), "op12-spans")
    columns = [c for c in docs.columns if keep_text or c != text_col]
    d = docs.withColumn("__tkey", F.xxhash64(text_col))
    maybe, rest = exchange.split_by_key(d, spans, "__tkey", "__key")
    maybe = maybe.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__tkey") == F.col("__key")), "left")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    whole = [F.length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), raw.alias("kept")]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in _ADDED[:3]] + [T.StructField("kept", T.BinaryType())])
    cut = maybe.filter("__spans is not null").select(*docs.columns, "__spans").mapInArrow(_cut(columns, text_col), schema)
    same = maybe.filter("__spans is null").select(*columns, *whole).unionByName(rest.select(*columns, *whole))
    return cut.unionByName(same)


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_bytes(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
with d as (select row_number() over () as row, doc_id, hex(encode(coalesce(text, ''))) as h, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n_bytes from documents),
b as (select row, unnest(range(0, n_bytes - 199, 256)) as lo, h, n_bytes from d where n_bytes >= 200),
c as (select row, lo, substr(h, 2 * lo + 1, 2 * (256 + 199)) as h, least(256, n_bytes - 199 - lo) as n from b),
s as (select row, lo, unnest(range(0, n)) as i, h from c),
w as (select row, lo + i as p, md5_number(substr(h, 2 * i + 1, 400)) as x from s),
twice as (select x from w group by x having count(*) > 1),
hit as (select row, p, lag(p) over (partition by row order by p) as before from w semi join twice using (x)),
marked as (select row, p, sum(case when before is null or p > before + 200 then 1 else 0 end) over (partition by row order by p) as span from hit),
spans as (select row, span, min(p) as a, max(p) + 200 as b from marked group by row, span),
left_over as (select row, a, b, coalesce(lag(b) over (partition by row order by a), 0) as from_, lead(a) over (partition by row order by a) as next from spans),
cut as (select row, cast(sum(b - a) as bigint) as n_removed, cast(count(*) as bigint) as n_spans,
               string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)) || case when next is null then substr(h, 2 * b + 1) else '' end, '' order by a) as kept
        from left_over join d using (row) group by row)
select doc_id, n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join cut using (row)
"""
