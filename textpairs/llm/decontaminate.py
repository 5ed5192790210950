"""Benchmark decontamination with a distributed positional inverted index.

*Index.* Documents are cut into shards of about ``SHARD_BYTES`` of text; each shard's row stores,
for its distinct terms, the rising positions at which they stand (positions of different documents lie
apart).  The index is a table in the shared checkpoint folder.  Only terms of the test items need
postings; with a vocabulary over ``MAX_TERMS`` all terms are stored instead.

*Search.* A window of a test item is looked up in every shard from its rarest term: that term's
postings, less its place in the window, are the candidates, and the other terms' lists, adjusted by
theirs, are intersected with them from rare to frequent.  With a tolerance the same intersection
gives proximity matches: there is a start from which every term is within ``slop`` places of where the
phrase has it.

Test windows go to the shards in blocks of at most ``BLOCK_WINDOWS``, so what is broadcast is bounded
at any size of the benchmark.  No document data is shuffled but the matches.

Defined cases: a null or empty text has no words, neither has a null item; an item of fewer words than
a window is one window; a repeated item id counts once; a null item id reads as the empty text; equal
rows get equal results; an empty benchmark leaves every document clean; clashing columns of the input
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.llm import exchange, words
from textpairs.session import materialize

SHARD_BYTES = 8 << 20
MAX_TERMS = 4 << 20
BLOCK_WINDOWS = 1 << 20
_APART = 64

INDEX = "shard long, ids array<long>, tkeys array<long>, n_words array<long>, terms binary, cuts binary, postings binary"
SCHEMA = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("tkeys", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("cuts", pa.binary()), ("postings", pa.binary())])


def build_index(docs: DataFrame, id_col: str, text_col: str, terms: np.ndarray | None) -> DataFrame:
    """The stored index; ``terms``: sorted word hashes to keep postings for, None for all."""
    held = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms)

    def row(number: int, ids: list, tkeys: list, counts: list, found: list) -> pa.RecordBatch:
        h, at = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        n = np.concatenate(counts).astype(np.int64)
        row = {"shard": number, "ids": ids, "tkeys": tkeys, "n_words": n, "terms": h[first].tobytes(), "cuts": np.append(first, len(h)).astype(np.int64).tobytes(), "postings": at.astype(np.int32).tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    def run(batches):
        keep = None if held is None else held.value
        task, seq, base, size = TaskContext.get().partitionId(), 0, 0, 0
        ids, tkeys, counts, found = [], [], [], []
        for batch in batches:
            all_ids, all_keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for s in words.slices(batch.column(1), words.ALNUM, True):
                h = words.word_hashes(s)
                at = np.arange(len(h)) + _APART * s.doc_of_word() + base
                base += len(h) + _APART * (s.hi - s.lo)
                if keep is not None:
                    some = np.zeros(len(h), bool) if not len(keep) else keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h
                    h, at = h[some], at[some]
                ids += all_ids[s.lo : s.hi]
                tkeys += all_keys[s.lo : s.hi]
                counts.append(s.counts)
                found.append((h, at))
                size += len(s.buf)
                if size >= SHARD_BYTES:
                    yield row(exchange.chunk_number(task, seq), ids, tkeys, counts, found)
                    seq, base, size = seq + 1, 0, 0
                    ids, tkeys, counts, found = [], [], [], []
        if ids:
            yield row(exchange.chunk_number(task, seq), ids, tkeys, counts, found)

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tkey"))
    return materialize(d.mapInArrow(run, INDEX), "op2-index")



class Windows:
    """Distinct windows of test items as word hashes, and the items that have each."""

    def __init__(self, size: int):
        self.size = size
        self.items: list[str] = []
        self.of: dict[bytes, list[int]] = {}

    def add(self, item: str, hashes: np.ndarray) -> None:
        number = len(self.items)
        self.items.append(item)
        for i in range(max(1, len(hashes) - self.size + 1) if len(hashes) else 0):
            have = self.of.setdefault(hashes[i : i + self.size].tobytes(), [])
            if not have or have[-1] != number:
                have.append(number)

    def arrays(self):
        """(hashes padded to ``size``, lengths, first item of each window, item numbers)."""
        keys = list(self.of)
        length = np.array([len(k) // 8 for k in keys], np.int64)
        h = np.zeros((len(keys), self.size), np.uint64)
        for i, k in enumerate(keys):
            h[i, : length[i]] = np.frombuffer(k, np.uint64)
        cuts = np.concatenate(([0], np.cumsum([len(v) for v in self.of.values()]))).astype(np.int64)
        return h, length, cuts, np.array([x for v in self.of.values() for x in v], np.int64)


def item_windows(items: DataFrame, item_col: str, text_col: str, size: int):
    """The items' windows in blocks of at most ``BLOCK_WINDOWS`` windows (or one longer item)."""
    block = Windows(size)
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).orderBy("i", "t")
    for i, t in rows.toLocalIterator():
        for s in words.slices(pa.array([t], pa.string()), words.ALNUM, True):
            block.add(i, words.word_hashes(s))
        if len(block.of) >= BLOCK_WINDOWS:
            yield block
            block = Windows(size)
    yield block


def _near(listed: np.ndarray, want: np.ndarray, slop: int) -> np.ndarray:
    at = np.searchsorted(listed, want - slop)
    at[at == len(listed)] = len(listed) - 1
    return np.abs(listed[at] - want) <= slop


def find(windows, terms, cuts, postings, slop: int):
    """(window, start, anchor, exact) of every match in a shard: where it starts, a place of its rarest term, whether it is the phrase."""
    h, length, _, _ = windows
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(h):
        return none, none, none, none.astype(bool)
    used = np.arange(h.shape[1]) < length[:, None]
    term = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    live = np.flatnonzero(((terms[term] == h) | ~used).all(axis=1))
    n = np.diff(cuts)
    out: list[tuple] = []
    for w in live.tolist():
        t = term[w, : length[w]]
        order = np.argsort(n[t], kind="stable")
        lead = int(order[0])
        anchor = np.repeat(postings[cuts[t[lead]] : cuts[t[lead] + 1]].astype(np.int64), 2 * slop + 1)
        start = anchor - lead + np.tile(np.arange(-slop, slop + 1), len(anchor) // (2 * slop + 1))
        exact = start + lead == anchor
        for j in order[1:].tolist():
            listed = postings[cuts[t[j]] : cuts[t[j] + 1]]
            ok = _near(listed, start + j, slop)
            if not ok.all():
                anchor, start, exact = anchor[ok], start[ok], exact[ok]
            if not len(anchor):
                break
            exact &= _near(listed, start + j, 0)
        if len(anchor):
            out.append((np.full(len(anchor), w), start, anchor, exact))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none, none.astype(bool))


MATCH = "shard long, row long, spans binary, items array<string>, near_items array<string>"


def search(index: DataFrame, block: Windows, slop: int = 0) -> DataFrame:
    """Documents with matches: exact word spans (int32 pairs), items matched exactly and within ``slop`` places."""
    held = index.sparkSession.sparkContext.broadcast((block.arrays(), block.items))

    def run(batches):
        windows, names = held.value
        _, length, of_cuts, of = windows
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r] for c in batch.schema.names}
                terms, cuts, postings = (np.frombuffer(x[c].as_py(), t) for c, t in (("terms", np.uint64), ("cuts", np.int64), ("postings", np.int32)))
                w, start, anchor, exact = find(windows, terms, cuts, postings, slop)
                if not len(w):
                    continue
                n = np.asarray(x["n_words"].values)
                begin = np.concatenate(([0], np.cumsum(n + _APART)))
                doc = np.searchsorted(begin, anchor, "right") - 1
                rows, spans, items, near = [], [], [], []
                order = np.argsort(doc, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                    d, e = int(doc[part[0]]), part[exact[part]]
                    pick = lambda p: [names[i] for i in np.unique(np.concatenate([of[of_cuts[i] : of_cuts[i + 1]] for i in np.unique(w[p])])).tolist()] if len(p) else []
                    rows.append(d)
                    items.append(pick(e))
                    near.append(pick(part))
                    at = start[e] - begin[d]
                    spans.append(np.stack([at, at + length[w[e]]], 1).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x["shard"].as_py()] * len(rows), pa.int64()), pa.array(rows, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))], names=["shard", "row", "spans", "items", "near_items"])

    return index.select("shard", "n_words", "terms", "cuts", "postings").mapInArrow(run, MATCH)


def _covered(batches):
    """n_hit: the words under any of the spans."""
    for batch in batches:
        hit = []
        for x in batch.column("spans"):
            s = np.frombuffer(b"".join(x.as_py()), np.int32).reshape(-1, 2)
            s = s[np.argsort(s[:, 0], kind="stable")]
            reach = np.concatenate(([0], np.maximum.accumulate(s[:, 1])))[: len(s)] if len(s) else s[:, 0]
            hit.append(int(np.maximum(0, s[:, 1] - np.maximum(s[:, 0], reach)).sum()) if len(s) else 0)
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != "spans"} | {"n_hit": pa.array(hit, pa.int64())})


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, slop: int = 0) -> DataFrame:
    """Per document: id, ``tkey`` (its text's xxhash64), ``n_words``, ``n_hit``, ``items`` and ``near_items`` (sorted as strings)."""
    terms: np.ndarray | None = np.zeros(0, np.uint64)
    for block in item_windows(items, item_col, item_text_col, size):
        if terms is not None:
            terms = np.union1d(terms, np.unique(block.arrays()[0]))
            terms = terms if len(terms) <= MAX_TERMS else None
    index = build_index(docs, id_col, text_col, terms)
    found = None
    for block in item_windows(items, item_col, item_text_col, size):
        got = search(index, block, slop)
        found = got if found is None else found.unionByName(got)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = found.groupBy("shard", "row").agg(F.collect_list("spans").alias("spans"), flat("items").alias("items"), flat("near_items").alias("near_items"))
    found = found.mapInArrow(_covered, "shard long, row long, items array<string>, near_items array<string>, n_hit long")
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "tkeys", "n_words")).alias("row", "x"))
    rows = rows.select("shard", F.col("row").cast("long").alias("row"), F.col("x.ids").alias(id_col), F.col("x.tkeys").alias("tkey"), F.col("x.n_words").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(found, ["shard", "row"], "left").select(
        id_col, "tkey", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")
    )


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=2)
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"),
    )
