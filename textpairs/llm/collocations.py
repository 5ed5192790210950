"""Phrase collocations by a multikey three-way quicksort of suffix pointers, routed by their leading words.

Texts are cut into pieces, pieces into words; every language is counted for itself (a word's 64-bit name holds its
language).  A *suffix* is a place in a piece with the words from there on, at most ``LONGEST``.

1. Chunks of documents ask the hash buckets how often all texts have their words, and then, with the rare words
   gone, their pairs of neighbouring words.  A phrase with a rare word or pair is rare itself, so suffixes end there.
2. Suffixes are *routed globally by their two leading words*: each chunk sends its distinct suffixes with their numbers
   to the bucket of the pair, so that a line which a third of all documents share costs one entry a chunk.  A pair
   found more than ``SPLIT`` times is dealt over several buckets by the rest of the suffix.
3. Each bucket sorts its suffix pointers by multikey three-way quicksort to the greatest depth, words being the
   characters.  The weight of an equal partition is the phrase's count; partitions of less than ``least`` are
   abandoned, but for split pairs, whose counts are first added up over their buckets.
4. Counts are joined with those of their parts; the lowest-scoring cut gives the score, in exact decimals.  The words of
   the phrases that stay are read from the texts again.  A phrase that stands
   in a longer one as often found goes; it is enough to look one word further, as counts only fall with length.

Defined cases: a null or empty text has no words; a null language is ``und`` (and is the same as one that is called so);
repeated rows count each; equal scores and counts go by the phrase's bytes; ids and other columns are not read; an empty
table gives no rows.  Words, pairs and phrases are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpairs.llm import exchange, words
from textpairs.llm.multikey import three_way
from textpairs.session import materialize, scratch_path

LONGEST = 5
LEAST = 100
TOP = 2000
NO_LANG = "und"
#: occurrences of a leading pair from which its suffixes are dealt over more than one bucket
SPLIT = 1 << 21

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
#: bytes of words: ``[^\x20\x09]`` without what ends a piece
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def phrase_keys(w: np.ndarray) -> np.ndarray:
    """Names of phrases, one a row of word names; a word's name is its own."""
    acc = w[:, 0].copy()
    if w.shape[1] == 1:
        return acc
    for j in range(1, w.shape[1]):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + w[:, j]
    return words.mix(acc + np.uint64(w.shape[1]))


def _tokens(s: words.Slice, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names of the slice's words, whether each is the first of its piece); ``salt``: a number for each document's language."""
    doc = s.doc_of_word()
    names = words.mix(words.word_hashes(s) + salt[doc]) | np.uint64(1)
    breaks = np.concatenate(([0], np.cumsum(_BREAK[s.buf])))
    first = np.ones(len(names), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (breaks[s.starts[1:]] != breaks[s.ends[:-1]])
    return names, first


def _lang_salt(langs: list[str]) -> np.ndarray:
    """A number for each language name, made from its bytes."""
    raw = [x.encode() for x in langs]
    ends = np.cumsum([len(x) + 1 for x in raw])
    buf = np.frombuffer(b"".join(x + b" " for x in raw), np.uint8)
    starts = ends - [len(x) + 1 for x in raw]
    return words.hash_words(buf, starts.astype(np.int64), ends.astype(np.int64)) if len(raw) else np.zeros(0, np.uint64)


def _pack(run: np.ndarray) -> bytes:
    """Small numbers as two columns of 16 bits, so that the higher, mostly zero, takes no room when compressed."""
    return np.stack([run & 0xFFFF, run >> 16]).astype(np.uint16).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(data, np.uint16).reshape(2, -1).astype(np.int32)
    return low | high << 16


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A written table, packed more tightly than by default: chunks are the bulk of what this operator stores."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


_WORD_CHUNK = "chunk long, run binary, keys binary, counts binary, lang_of binary, langs array<string>, ns array<long>"


def _word_chunks(batches):
    """Chunk rows: its distinct words (the most frequent first) with their numbers and languages, its words in order (from 1; 0 before a piece)."""
    task, seq, size, part = TaskContext.get().partitionId(), 0, 0, []

    def row():
        names, first, lang = (np.concatenate(x) for x in zip(*part))
        keys, at, index, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        run = np.zeros(len(names) + int(first.sum()), np.int32)
        run[np.arange(len(names)) + np.cumsum(first)] = place[index] + 1
        cols = {"run": _pack(run), "keys": keys[order].tobytes(), "counts": counts[order].astype(np.int32).tobytes(), "lang_of": lang[at[order]].astype(np.int32).tobytes()}
        out = {"chunk": pa.array([exchange.chunk_number(task, seq)], pa.int64())} | {c: pa.array([x], pa.binary()) for c, x in cols.items()}
        total = np.bincount(lang, minlength=len(number_of))
        return pa.RecordBatch.from_pydict(out | {"langs": pa.array([list(number_of)], pa.list_(pa.string())), "ns": pa.array([total.tolist()], pa.list_(pa.int64()))})

    number_of: dict[str, int] = {}
    for batch in batches:
        said = [NO_LANG if x is None else x for x in batch.column("lang").to_pylist()]
        salt = _lang_salt(said)
        for s in words.slices(batch.column("text"), _WORD, True):
            if len(s.starts):
                names, first = _tokens(s, salt[s.lo : s.hi])
                lang = np.array([number_of.setdefault(x, len(number_of)) for x in said[s.lo : s.hi]])
                part.append((names, first, np.repeat(lang, s.counts)))
                size += len(s.buf)
                if size >= exchange.CHUNK_BYTES:
                    yield row()
                    part, size, seq = [], 0, seq + 1
                    number_of.clear()
    if part:
        yield row()


def _by_bucket(batch, r: int, keys: np.ndarray, buckets: int, vals: list[np.ndarray]):
    """(chunk, bucket, keys and the given values) rows of a chunk's keys, and the rows' cuts; keys need not be sorted."""
    order = np.argsort(keys)
    keys = keys[order]
    cuts = exchange.bucket_cuts(keys, buckets)
    used = np.flatnonzero(np.diff(cuts))
    cut = lambda x: pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary())
    return [pa.array(np.full(len(used), batch["chunk"][r].as_py())), pa.array(used.astype(np.int64)), cut(keys), *[cut(v[order]) for v in vals]]


def _word_asks(buckets: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                keys, counts, lang = (np.frombuffer(batch[c][r].as_py(), t) for c, t in (("keys", np.uint64), ("counts", np.int32), ("lang_of", np.int32)))
                cols = _by_bucket(batch, r, keys, buckets, [counts, lang])
                langs = batch["langs"][r].as_py()
                yield pa.RecordBatch.from_arrays([*cols, pa.array([langs] * len(cols[0]), pa.list_(pa.string()))], names=["chunk", "bucket", "keys", "vals", "lang_of", "langs"])

    return run


def _sums(keys: list[np.ndarray], vals: list[bytes]):
    """(distinct keys, each entry's number among them, sums) of a bucket's questions, and where a chunk's entries end."""
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, index, np.frombuffer(b"".join(vals), np.int32))
    return distinct, index, total, np.cumsum([len(x) for x in keys])[:-1]


def _frequent_words(least: int):
    """Answers a bucket's chunks (1 for a frequent word); the first row has the frequent words themselves."""

    def one(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in table["keys"]]
        distinct, index, total, cuts = _sums(keys, [x.as_py() for x in table["vals"]])
        often = total >= least
        some = np.flatnonzero(often)
        _, at = np.unique(index, return_index=True)  # an entry of each word
        at = at[some]
        of = np.frombuffer(b"".join(x.as_py() for x in table["lang_of"]), np.int32)[at]
        row = np.searchsorted(cuts, at, "right")
        langs = table["langs"].to_pylist()
        found = [{"key": k, "lang": langs[r][x], "f": f} for k, r, x, f in zip(distinct[some].view(np.int64).tolist(), row.tolist(), of.tolist(), total[some].tolist())]
        kind = pa.list_(pa.struct([("key", pa.int64()), ("lang", pa.string()), ("f", pa.int64())]))
        return pa.table({
            "chunk": table["chunk"].combine_chunks(), "bucket": table["bucket"].combine_chunks(),
            "answer": pa.array([x.tobytes() for x in np.split(often[index].astype(np.uint8), cuts)], pa.binary()),
            "words": pa.array([found] + [None] * (table.num_rows - 1), kind),
        })

    return one


def _frequent_chunks(_, chunk: pa.Table, got: pa.Table) -> pa.Table:
    """The chunk with its frequent words alone, 0 where others stood."""
    rows = {"chunk": [], "run": [], "keys": []}
    if chunk.num_rows and got.num_rows:
        keys = np.frombuffer(chunk["keys"][0].as_py(), np.uint64)
        often = np.zeros(len(keys), bool)
        often[np.argsort(keys)] = np.frombuffer(exchange.joined(got), np.uint8) > 0
        new = np.concatenate(([0], np.where(often, np.cumsum(often), 0))).astype(np.int32)
        run = new[_unpack(chunk["run"][0].as_py())]
        if len(run):  # zeros in a row are one
            run = run[np.append(True, (run[1:] != 0) | (run[:-1] != 0))]
        for c, x in zip(rows, (chunk["chunk"][0].as_py(), _pack(run), keys[often].tobytes())):
            rows[c].append(x)
    return pa.table({c: pa.array(v, pa.int64() if c == "chunk" else pa.binary()) for c, v in rows.items()})


def _pairs(run: np.ndarray, keys: np.ndarray):
    """(places of pairs of neighbouring words, distinct pairs, each place's number among them, their counts)."""
    at = np.flatnonzero((run[:-1] != 0) & (run[1:] != 0)) if len(run) else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros(0, np.uint64), at, at
    return at, *np.unique(phrase_keys(np.stack([keys[run[at] - 1], keys[run[at + 1] - 1]], 1)), return_inverse=True, return_counts=True)


def _pair_asks(buckets: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                _, pairs, _, counts = _pairs(_unpack(batch["run"][r].as_py()), np.frombuffer(batch["keys"][r].as_py(), np.uint64))
                yield pa.RecordBatch.from_arrays(_by_bucket(batch, r, pairs, buckets, [counts.astype(np.int32)]), names=["chunk", "bucket", "keys", "vals"])

    return run


def _pair_shares(least: int):
    """For each pair over how many buckets its suffixes go, 0 for a rare one."""

    def answer(keys, vals):
        _, index, total, cuts = _sums(keys, vals)
        share = np.where(total >= least, 1 + total // SPLIT, 0).astype(np.int32)
        return [x.tobytes() for x in np.split(share[index], cuts)], {}

    return answer


_SUFFIXES = "bucket long, whole boolean, keys binary, lens binary, at binary, times binary"


def _suffixes(buckets: int):
    """The chunk's distinct suffixes of frequent pairs with their numbers, one row a bucket, dealt by the leading pair."""

    def run(_, chunk: pa.Table, got: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "whole": [], "keys": [], "lens": [], "at": [], "times": []}
        if chunk.num_rows and got.num_rows:
            run, keys = _unpack(chunk["run"][0].as_py()), np.frombuffer(chunk["keys"][0].as_py(), np.uint64)
            place, pairs, index, _ = _pairs(run, keys)
            share = np.frombuffer(exchange.joined(got), np.int32)[index]
            good = np.zeros(len(run) + LONGEST, bool)  # a frequent pair begins here
            good[place[share > 0]] = True
            start = place[share > 0]
            index, share = index[share > 0], share[share > 0]
            suffix = np.zeros((len(start), LONGEST), np.int32)
            suffix[:, 0], suffix[:, 1] = run[start], run[start + 1] if len(start) else 0
            going = np.ones(len(start), bool)
            for j in range(2, LONGEST):
                going = going & good[start + j - 1]
                suffix[going, j] = run[start[going] + j]
            rest = words.window_hashes(np.ascontiguousarray(suffix).astype(np.uint64).ravel(), LONGEST)[::LONGEST] if len(start) else np.zeros(0, np.uint64)
            _, one, times = np.unique(rest, return_index=True, return_counts=True)
            suffix, share = suffix[one], share[one].astype(np.uint64)
            route = pairs[index[one]]
            # the rest by its words' own names, the same in every chunk
            name = np.concatenate((np.zeros(1, np.uint64), keys))[suffix]
            route = np.where(share > 1, words.mix(route + phrase_keys(name[:, 1:]) % np.maximum(share, np.uint64(1)) + np.uint64(1)), route)
            bucket = (route >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64)
            cell = bucket * 2 + (share == 1)
            order = np.argsort(cell, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                mine = suffix[part]
                lens = (mine > 0).sum(1).astype(np.uint8)
                used, at = np.unique(mine[mine > 0], return_inverse=True)
                out["bucket"].append(int(bucket[part[0]]))
                out["whole"].append(bool(share[part[0]] == 1))
                out["keys"].append(keys[used - 1].tobytes())
                out["lens"].append(lens.tobytes())
                out["at"].append(at.astype(np.uint16 if len(used) <= 1 << 16 else np.int32).tobytes())
                out["times"].append(times[part].astype(np.int32).tobytes())
        kinds = {"bucket": pa.int64(), "whole": pa.bool_()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()})

    return run


def phrase_counts(matrix: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, counts): phrases of 2 words and more found at least ``least`` times among suffixes ``matrix`` (0: ended).

    A phrase is the first ``length`` words of its row's suffix.
    """
    found: list[tuple] = []

    def equal(first, depth, total):
        some = depth > 1
        found.append((first[some], depth[some], total[some]))

    three_way(np.arange(len(matrix)), lambda p, d: matrix[p, d], matrix.shape[1], least, times, equal, end=0)
    rows, depth, total = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return rows, depth, total


def _sorted_phrases(least: int):
    """Phrases of a bucket with their counts and the names of all their beginnings and ends."""

    def one(table: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"key": [], "a": [], "size": [], "names": [], "lefts": [], "rights": []}
        whole = table["whole"].to_numpy(zero_copy_only=False)
        for kind in (True, False):
            rows = np.flatnonzero(whole == kind).tolist()
            if not rows:
                continue
            parts, times = [], []
            for r in rows:
                keys, lens = np.frombuffer(table["keys"][r].as_py(), np.uint64), np.frombuffer(table["lens"][r].as_py(), np.uint8)
                at = np.frombuffer(table["at"][r].as_py(), np.uint16 if len(keys) <= 1 << 16 else np.int32)
                m = np.zeros((len(lens), LONGEST), np.uint64)
                m[np.arange(LONGEST) < lens[:, None]] = keys[at]
                parts.append(m)
                times.append(np.frombuffer(table["times"][r].as_py(), np.int32))
            m = np.concatenate(parts)
            at, size, a = phrase_counts(m, np.concatenate(times).astype(np.int64), least if kind else 1)
            for d in range(2, LONGEST + 1):
                some = size == d
                w = m[at[some], :d]
                if not len(w):
                    continue
                left, right = [phrase_keys(w[:, :k]) for k in range(1, d)], [phrase_keys(w[:, k:]) for k in range(1, d)]
                cols["key"].append(phrase_keys(w).view(np.int64))
                cols["a"].append(a[some])
                cols["size"].append(np.full(len(w), d, np.int32))
                for c, x in (("names", w), ("lefts", np.stack(left, 1)), ("rights", np.stack(right, 1))):
                    cols[c] += np.ascontiguousarray(x).view(np.int64).tolist()
        flat = {c: pa.array(np.concatenate(cols[c]) if cols[c] else [], t) for c, t in (("key", pa.int64()), ("a", pa.int64()), ("size", pa.int32()))}
        return pa.table(flat | {c: pa.array(cols[c], pa.list_(pa.int64())) for c in ("names", "lefts", "rights")})

    return one


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``candidates(key, a, size, names, lefts, rights)``, ``words(key, lang, f)`` of frequent words, ``sizes(lang, n)``."""
    d = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    buckets = exchange.bucket_count(exchange.total_bytes(d, "text"))
    chunks = _kept(d.mapInArrow(_word_chunks, _WORD_CHUNK), "op13-words")
    sizes = chunks.select(F.explode(F.arrays_zip("langs", "ns")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.ns").alias("n"))
    asks = chunks.select("chunk", "keys", "counts", "lang_of", "langs").mapInArrow(_word_asks(buckets), exchange.ASK + ", lang_of binary, langs array<string>")
    got = asks.groupBy("bucket").applyInArrow(_frequent_words(least), "chunk long, bucket long, answer binary, words array<struct<key:long,lang:string,f:long>>")
    got = _kept(got, "op13-frequent")
    frequent = got.filter("words is not null").select(F.explode("words").alias("x")).select("x.*")
    few = chunks.select("chunk", "run", "keys").groupBy("chunk").cogroup(got.select("chunk", "bucket", "answer").groupBy("chunk"))
    few = _kept(few.applyInArrow(_frequent_chunks, "chunk long, run binary, keys binary"), "op13-frequent-chunks")
    share = exchange.answers(few.mapInArrow(_pair_asks(buckets), exchange.ASK), _pair_shares(least))
    routed = few.groupBy("chunk").cogroup(share.groupBy("chunk")).applyInArrow(_suffixes(buckets), _SUFFIXES)
    found = routed.groupBy("bucket").applyInArrow(_sorted_phrases(least), "key long, a long, size int, names array<long>, lefts array<long>, rights array<long>")
    found = found.groupBy("key").agg(F.sum("a").alias("a"), F.first("size").alias("size"), *[F.first(c).alias(c) for c in ("names", "lefts", "rights")])
    return materialize(found.filter(F.col("a") >= least), "op13-candidates"), frequent, sizes


def _texts_of(groups):
    """``(w, word)`` once a slice of words whose name is in one of the numbered groups."""

    def run(batches):
        wanted = np.zeros(exchange.GROUPS, bool)
        wanted[groups.value] = True
        met = np.zeros(0, np.uint64)
        for batch in batches:
            salt = _lang_salt([NO_LANG if x is None else x for x in batch.column("lang").to_pylist()])
            for s in words.slices(batch.column("text"), _WORD, True):
                if not len(s.starts):
                    continue
                names, _ = _tokens(s, salt[s.lo : s.hi])
                at = np.flatnonzero(wanted[(names % np.uint64(exchange.GROUPS)).astype(np.int64)])
                new, first = np.unique(names[at], return_index=True)
                fresh = ~np.isin(new, met)
                met = np.concatenate([met, new[fresh]])
                at = at[first[fresh]]
                said = [s.buf[a:b].tobytes() for a, b in zip(s.starts[at].tolist(), s.ends[at].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(new[fresh].view(np.int64)), pa.array(said, pa.binary()).cast(pa.string())], names=["w", "word"])

    return run


def word_texts(docs: DataFrame, names: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(w, word)`` of the word names ``names(w)``, from the texts; at most ``exchange.GROUPS`` numbers are broadcast."""
    names = materialize(names.distinct(), "op13-names")
    # names are unsigned: their low bits are those of the signed number
    groups = [r.g for r in names.select(F.col("w").bitwiseAND(F.lit(exchange.GROUPS - 1)).alias("g")).distinct().collect()]
    held = docs.sparkSession.sparkContext.broadcast(np.array(groups, np.int64))
    d = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return d.mapInArrow(_texts_of(held), "w long, word string").join(names, "w", "left_semi").groupBy("w").agg(F.min("word").alias("word"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    cand, frequent, sizes = count_phrases(docs, text_col, lang_col, least)
    # one word further is enough: counts only fall with length
    longer = cand.filter("size > 2").select(F.explode(F.array(F.element_at("lefts", -1), F.element_at("rights", 1))).alias("inside"), "a")
    longer = longer.groupBy("inside").agg(F.max("a").alias("most"))
    kept = cand.join(longer, F.col("key") == F.col("inside"), "left").filter(F.col("most").isNull() | (F.col("most") < F.col("a")))
    lang_of = frequent.select(F.col("key").alias("w"), "lang").join(sizes, "lang")
    kept = kept.select("key", "a", "names", F.element_at("names", 1).alias("w"), "lefts", "rights").join(lang_of, "w")
    cuts = kept.select("key", "a", "lang", "n", F.posexplode(F.arrays_zip("lefts", "rights")).alias("k", "cut")).select("key", "a", "lang", "n", "k", F.col("cut.lefts").alias("lk"), F.col("cut.rights").alias("rk"))
    of = cand.select("key", "a").unionByName(frequent.select("key", F.col("f").alias("a")))
    cuts = cuts.join(of.select(F.col("key").alias("lk"), F.col("a").alias("l")), "lk").join(of.select(F.col("key").alias("rk"), F.col("a").alias("r")), "rk")
    score = F.expr("cast(a as decimal(38,0)) * cast(n as decimal(38,0)) * 1000 div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    best = cuts.groupBy("key").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    best = best.select("key", "lang", "a", "n", "x.score", "x.l", "x.r")
    # words are put in for those that can be among the first, ties at the edge included
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = best.withColumn("place", F.rank().over(by)).filter(F.col("place") <= top)
    best = materialize(best.join(cand.select("key", "names"), "key"), "op13-best")
    places = best.select("key", F.posexplode("names").alias("at", "w"))
    said = places.join(word_texts(docs, places.select("w"), text_col, lang_col), "w")
    said = said.groupBy("key").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))
    out = best.join(said, "key")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


ORACLE_SQL = """
with d as (select row_number() over () as id, coalesce(lang, 'und') as lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select id, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
q as (select row_number() over () as pid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
sizes as (select lang, cast(sum(len(w)) as bigint) as n from q group by lang),
g as (select lang, k, unnest([list_slice(w, i, i + k - 1) for i in range(1, len(w) - k + 2)]) as x
      from q, (select unnest([1, 2, 3, 4, 5]) as k)),
f as (select lang, k, x, count(*) as f from g group by lang, k, x having count(*) >= 100),
cand as (select lang, k, x, f as a from f where k > 1),
gone as (select distinct c.lang, c.x from cand c
         join (select lang, k, a, unnest([x[:k - 1], x[2:]]) as part from cand where k > 2) q on q.lang = c.lang and q.part = c.x and q.a >= c.a),
cuts as (select lang, k, x, a, unnest(range(1, k)) as c from cand),
scored as (select t.lang, t.x, t.a, t.c, l.f as l, r.f as r, n,
                  cast((cast(1000 as hugeint) * t.a * n) // (cast(l.f as hugeint) * r.f) as bigint) as score
           from cuts t join f l on l.lang = t.lang and l.x = t.x[:t.c] join f r on r.lang = t.lang and r.x = t.x[t.c + 1:] join sizes s on s.lang = t.lang),
best as (select *, row_number() over (partition by lang, x order by score, c) as least from scored),
ranked as (select lang, array_to_string(x, ' ') as phrase, a, l, r, n, score,
                  row_number() over (partition by lang order by score desc, a desc, array_to_string(x, ' ')) as rank
           from best where least = 1 and (lang, x) not in (select lang, x from gone))
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""
