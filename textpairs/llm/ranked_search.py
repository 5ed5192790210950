"""Ranked lexical search with bag deduplication: equal bags of words are scored once for all their documents.

1. Items become term numbers.  They are worked off in blocks of about ``BLOCK_TERMS`` terms (by hash of the
   item's number); a block's vocabulary is what is broadcast.
2. Every document is *restricted to the block's vocabulary*: its bag is a vector of (term, occurrences), beside its number
   of all terms.  N and L come from these numbers, and with them each document's m.
3. Documents of equal bag and m are a *class*.  Classes are found by hash and verified, as rows are grouped by
   hash, bag and m together; a class keeps its size and smallest document id.  Sizes added up by term are the df.
4. Each class is scored once against all items of the block, as a sparse product in numpy; a task keeps each item's ``top``
   classes by score and smallest id.  That is enough: a document among the first ``top`` has its class among
   the first ``top`` classes.
5. The classes that stay are *expanded* by ascending id: members are found by hash, bag and m, at most ``top`` of each class.

Defined cases: null and empty texts have no terms, count nowhere and are never found; an item without terms has no
rows; rows that share a document id are documents of their own; a null id comes after every other; items that share an id
are ranked each for itself; an empty table of either kind gives no rows; other columns are not read.  Terms are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpairs.llm import words
from textpairs.llm.multikey import ranges
from textpairs.session import materialize

TOP = 10
#: item terms of a block: bounds the vocabulary that is broadcast and the items' terms that are loaded at once
BLOCK_TERMS = 1 << 20
#: entries of a score matrix, and products laid out at once
SCORES = 1 << 20
PRODUCTS = 1 << 21
_NO_ID = np.iinfo(np.int64).max


def term_counts(s: words.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every term of the slice."""
    return s.doc_of_word(), words.word_hashes(s)


def _item_terms(batches):
    """Each item's distinct terms and their numbers."""
    for batch in batches:
        terms, times, size = [], [], []
        for s in words.slices(batch.column(1), words.ALNUM, True):
            doc, h = term_counts(s)
            for part in np.split(h, s.off[1:-1]):
                t, n = np.unique(part, return_counts=True)
                terms.append(t.tobytes())
                times.append(n.astype(np.int64).tobytes())
                size.append(len(t))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary()), pa.array(times, pa.binary()), pa.array(size, pa.int64())], names=["item", "terms", "times", "size"])


def _bags(vocab):
    """``(id, n, bag)``: number of all terms, and the bag of known ones as int32 pairs (null if there are none)."""

    def run(batches):
        known = np.frombuffer(vocab.value, np.uint64)
        for batch in batches:
            n, bags = [], []
            for s in words.slices(batch.column(1), words.ALNUM, True):
                doc, h = term_counts(s)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                some = known[at] == h
                cell, times = np.unique(doc[some] * len(known) + at[some], return_counts=True)
                pair = np.stack([cell % len(known), times], 1).astype(np.int32)
                cuts = np.searchsorted(cell // len(known), np.arange(s.hi - s.lo + 1))
                bags += [pair[a:b].tobytes() if b > a else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                n.append(s.counts)
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n).astype(np.int64)), pa.array(bags, pa.binary())], names=["id", "n", "bag"])

    return run


def _laid_out(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of a column of bags."""
    bags = [x.as_py() for x in col]
    pair = np.frombuffer(b"".join(bags), np.int32).reshape(-1, 2)
    return np.repeat(np.arange(len(bags)), [len(x) // 8 for x in bags]), pair[:, 0], pair[:, 1].astype(np.int64)


def _df_parts(terms: int):
    """A task's documents by term, from its classes and their sizes."""

    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            row, term, _ = _laid_out(batch.column("bag"))
            np.add.at(total, term, batch.column("members").to_numpy()[row])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return run


def class_scores(row, term, tf, m, weight, items_of, cuts, times, n_items: int, n_rows: int) -> np.ndarray:
    """``[item, row]`` scores; the items of a term are ``items_of[cuts[term]:cuts[term + 1]]``, ``times`` their occurrences."""
    part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
    out = np.zeros(n_items * n_rows, np.int64)
    size = np.diff(cuts)[term]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(term):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PRODUCTS, "right")))
        at = ranges(cuts[term[lo:hi]], size[lo:hi])
        r, p = np.repeat(row[lo:hi], size[lo:hi]), np.repeat(part[lo:hi], size[lo:hi])
        np.add.at(out, items_of[at] * n_rows + r, p * times[at])
        lo = hi
    return out.reshape(n_items, n_rows)


def _top_classes(held, top: int):
    """Each item's best classes of a task: (place, score, least, h, bag, m)."""

    def run(batches):
        b = held.value
        n_items = b["items"]
        place, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rest: list[tuple] = []  # (h, bag, m) of the classes kept, by ``who``
        who = np.zeros(0, np.int64)
        step = max(1, SCORES // max(1, n_items))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                row, term, tf = _laid_out(part.column("bag"))
                got = class_scores(row, term, tf, part.column("m").to_numpy(), b["weight"], b["items_of"], b["cuts"], b["times"], n_items, part.num_rows)
                kth = np.zeros(n_items, np.int64)  # the last score of the items that have enough
                some = np.bincount(place, minlength=n_items) >= top
                low = np.full(n_items, _NO_ID)
                np.minimum.at(low, place, score)
                kth[some] = low[some]
                i, r = np.nonzero(got >= np.maximum(kth, 1)[:, None])
                if not len(i):
                    continue
                used, at = np.unique(r, return_inverse=True)
                h, bag, m = part.column("h").to_numpy(), part.column("bag"), part.column("m").to_numpy()
                ids = words.ints(part.column("least"), _NO_ID)
                place, score, least = np.concatenate([place, i]), np.concatenate([score, got[i, r]]), np.concatenate([least, ids[r]])
                who = np.concatenate([who, len(rest) + at])
                rest += [(int(h[x]), bag[int(x)].as_py(), int(m[x])) for x in used]
                order = np.lexsort((least, -score, place))
                first = np.searchsorted(place[order], np.arange(n_items))
                order = order[np.arange(len(order)) - first[place[order]] < top]
                place, score, least, who = place[order], score[order], least[order], who[order]
                alive, who = np.unique(who, return_inverse=True)
                rest = [rest[x] for x in alive.tolist()]
        cols = [[rest[x][j] for x in who.tolist()] for j in range(3)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(score), pa.array(least, mask=least == _NO_ID), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())],
            names=["place", "score", "least", "h", "bag", "m"],
        )

    return run


def _search_block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """``item, rank, doc_id, score`` of a block's items ``(item, terms, times)``."""
    sc = docs.sparkSession.sparkContext
    terms = [np.frombuffer(r.terms, np.uint64) for r in rows]
    known, number = np.unique(np.concatenate(terms), return_inverse=True)
    of = np.repeat(np.arange(len(rows)), [len(t) for t in terms])
    times = np.concatenate([np.frombuffer(r.times, np.int64) for r in rows])
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(len(known) + 1))

    bags = materialize(docs.mapInArrow(_bags(sc.broadcast(known.tobytes())), "id long, n long, bag binary"), "op11-bags")
    n_docs, length = bags.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = bags.filter("bag is not null").withColumn("m", F.expr(f"25 + (75 * n * {int(n_docs)}L) div {max(1, int(length))}L")).withColumn("h", F.xxhash64("bag", "m"))
    classes = materialize(held.groupBy("h", "bag", "m").agg(F.count("*").alias("members"), F.min("id").alias("least")), "op11-classes")
    df = np.zeros(len(known), np.int64)
    for r in classes.select("bag", "members").mapInArrow(_df_parts(len(known)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the block's vocabulary
        df[r.term] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    model = sc.broadcast({"items": len(rows), "weight": weight, "items_of": of[order], "cuts": cuts, "times": times[order]})
    best = classes.mapInArrow(_top_classes(model, top), "place long, score long, least long, h long, bag binary, m long")
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("least")))).filter(F.col("at") <= top).drop("at", "least")
    best = materialize(best, "op11-best")
    # members of the classes that stay; at most ``top`` classes an item are broadcast
    chosen = best.select("h", "bag", "m").distinct()
    members = held.select("id", "h", "bag", "m").join(F.broadcast(chosen), ["h", "bag", "m"])
    members = members.withColumn("at", F.row_number().over(Window.partitionBy("h", "bag", "m").orderBy(F.asc_nulls_last("id")))).filter(F.col("at") <= top).drop("at")
    out = best.join(members, ["h", "bag", "m"]).select("place", "id", "score")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("id")))).filter(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame([(i, r.item) for i, r in enumerate(rows)], "place long, item long")
    return out.join(F.broadcast(names), "place").select("item", "rank", F.col("id").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """``item, rank, doc_id, score``: each item's ``top`` documents by score, then by id."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    terms = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).mapInArrow(_item_terms, "item long, terms binary, times binary, size long")
    terms = materialize(terms.filter("size > 0"), "op11-items")
    total = int(terms.agg(F.sum("size")).first()[0] or 0)
    blocks = -(-total // BLOCK_TERMS)
    out = None
    for b in range(blocks):
        mine = terms.filter(F.pmod(F.xxhash64("terms", "item"), F.lit(blocks)) == b).orderBy("item", "terms", "times").collect()  # about BLOCK_TERMS terms
        if mine:
            got = materialize(_search_block(d, mine, top), "op11-found")
            out = got if out is None else out.unionByName(got)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item long, rank int, doc_id long, score long")
    return out


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


ORACLE_SQL = """
with dt as (select row_number() over () as row, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
it as (select row_number() over () as item, item_id,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from benchmark),
size as (select cast(count(*) as bigint) as nn, cast(sum(len(w)) as bigint) as ll from dt where len(w) > 0),
item_terms as (select item, item_id, term, cast(count(*) as bigint) as times from (select item, item_id, unnest(w) as term from it) group by all),
postings as (select row, doc_id, n, term, cast(count(*) as bigint) as tf from (select row, doc_id, cast(len(w) as bigint) as n, unnest(w) as term from dt) group by all),
weights as (select term, cast(floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as weight from postings, size group by term),
scores as (select item, item_id, row, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) as bigint) as score
           from item_terms join postings using (term) join weights using (term), size group by item, item_id, row, doc_id),
ranked as (select *, cast(row_number() over (partition by item order by score desc, doc_id nulls last) as integer) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
