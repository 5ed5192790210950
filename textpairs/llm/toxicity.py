"""Toxicity scores: a character n-gram linear classifier on naive Bayes log-count ratios.

A text's features are its distinct character n-grams (of code points, A-Z lower-cased), hashed to
``2 ** BITS`` places.  From a sample of labelled training documents each place gets the ratio
r = log(share among toxic / share among clean); the ``FEATURES`` places with the most evidence carry
the value r, and a logistic regression on them gives the score.  Scoring covers every text whole.

The fit uses at most ``SAMPLE`` documents of each label, those with the smallest hash of their id (all
of them when there are fewer); the intercept is put right for the two labels' shares among all training rows.

Defined cases: a null or empty text has no n-grams and gets the intercept's score; with no toxic or no
clean training document every score is the share of toxic ones (0 without any training row); equal
texts get equal scores; rows without a label are scored all the same; of training rows that share an id the least text counts; clashing columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.llm import words
from textpairs.session import materialize

BITS = 20
SIZES = (4, 6)
SAMPLE = 3000
FEATURES = 16_384
LEAST = 4
RANGES = 64
ROUNDS = 300
RIDGE = 2e-3

_SALT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def char_ngrams(s: words.Slice, sizes=SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of every character n-gram of the slice, repeats included."""
    first = np.flatnonzero((s.buf & 0xC0) != 0x80)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.append(first[1:], len(s.buf))
    off = np.searchsorted(first, s.byte_off)
    doc = np.repeat(np.arange(s.hi - s.lo), np.diff(off))
    # one mixed value a character, from its up to four bytes
    code = s.buf[first].astype(np.uint64)
    for j in range(1, 4):
        at = np.minimum(first + j, len(s.buf) - 1)
        code = (code << np.uint64(8)) | np.where(first + j < ends, s.buf[at], 0).astype(np.uint64)
    h = words.mix(code)
    docs, places = [], []
    for n in sizes:
        m = len(h) - n + 1
        if m > 0:
            w = words.window_hashes(h, n)
            ok = doc[:m] == doc[n - 1 :]
            docs.append(doc[:m][ok])
            places.append((w[ok] >> np.uint64(64 - BITS)).astype(np.int64))
    return (np.concatenate(docs), np.concatenate(places)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class ToxicModel:
    """``weight`` of each place (most are 0) and the intercept; ``share`` is the score of all texts if only one label was learned."""

    weight: np.ndarray
    intercept: float
    share: float | None = None

    def score(self, s: words.Slice) -> np.ndarray:
        n = s.hi - s.lo
        if self.share is not None:
            return np.full(n, self.share)
        doc, place = char_ngrams(s)
        some = self.weight[place] != 0
        key = np.unique(doc[some] << BITS | place[some])
        z = self.intercept + np.bincount(key >> BITS, self.weight[key & ((1 << BITS) - 1)], n)
        return 1 / (1 + np.exp(-z))


def choose_places(place: np.ndarray, bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> tuple[np.ndarray, np.ndarray]:
    """(places with the most evidence, rising; their log-count ratios), from the documents of each label that have a place."""
    r = np.log(((bad + 1) / (n_bad + 2)) / ((good + 1) / (n_good + 2)))
    evidence = np.where(bad + good >= LEAST, np.abs(r) * np.sqrt(bad + good), 0)
    at = np.lexsort((place, -evidence))[:FEATURES]
    at = at[evidence[at] > 0]
    at = at[np.argsort(place[at])]
    return place[at], r[at]


def fit_toxic(cols: list[np.ndarray], toxic: np.ndarray, share: float, places: np.ndarray, ratios: np.ndarray) -> ToxicModel:
    """From each document's numbers among the chosen places; ``share``: of toxic documents among all training rows."""
    weight = np.zeros(1 << BITS, np.float32)
    y = toxic.astype(float)
    if not len(y) or y.min() == y.max():
        return ToxicModel(weight, 0.0, float(share))
    doc, col = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols).astype(np.int64)
    x = ratios[col]
    # Adam on the mean log loss with a ridge
    w, b = np.zeros(len(places)), float(np.log(y.mean() / (1 - y.mean())))
    mom, pow_, t = np.zeros(len(places) + 1), np.zeros(len(places) + 1), 0
    for t in range(1, ROUNDS + 1):
        z = b + np.bincount(doc, w[col] * x, len(y))
        e = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = np.append(np.bincount(col, e[doc] * x, len(places)) + RIDGE * w, e.sum())
        mom, pow_ = 0.9 * mom + 0.1 * g, 0.99 * pow_ + 0.01 * g * g
        step = 0.02 * (mom / (1 - 0.9**t)) / (np.sqrt(pow_ / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weight[places] = w * ratios
    b += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return ToxicModel(weight, float(b))


def _place_counts(batches):
    """A task's documents by place and label, a row for each range of places that it has."""
    count = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for s in words.slices(batch.column("text"), words.SPACED, True):
            doc, place = char_ngrams(s)
            key = np.unique(doc << BITS | place)
            for label in (0, 1):
                mine = toxic[s.lo + (key >> BITS)] == label
                count[label] += np.bincount(key[mine] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
    step = (1 << BITS) // RANGES
    for b in range(RANGES):
        part = count[:, b * step : (b + 1) * step]
        some = np.flatnonzero(part.any(0)).astype(np.int32)
        if len(some):
            yield pa.RecordBatch.from_pydict({"range": pa.array([b], pa.int32()), "place": pa.array([some.tobytes()]), "good": pa.array([part[0, some].tobytes()]), "bad": pa.array([part[1, some].tobytes()])})


def _range_counts(table: pa.Table) -> pa.Table:
    """The counts of a range of places, those with enough documents."""
    step = (1 << BITS) // RANGES
    good, bad = np.zeros(step, np.int64), np.zeros(step, np.int64)
    for r in range(table.num_rows):
        place = np.frombuffer(table["place"][r].as_py(), np.int32)
        good[place] += np.frombuffer(table["good"][r].as_py(), np.int32)
        bad[place] += np.frombuffer(table["bad"][r].as_py(), np.int32)
    some = np.flatnonzero(good + bad >= LEAST)
    first = table["range"][0].as_py() * step
    return pa.table({c: pa.array([x.astype(np.int32).tobytes()], pa.binary()) for c, x in (("place", some + first), ("good", good[some]), ("bad", bad[some]))})


def _chosen_columns(held):
    """Each document's numbers among the chosen places."""

    def run(batches):
        col = np.full(1 << BITS, -1, np.int32)
        col[held.value] = np.arange(len(held.value))
        for batch in batches:
            out = []
            for s in words.slices(batch.column("text"), words.SPACED, True):
                doc, place = char_ngrams(s)
                place = col[place]
                key = np.unique(doc[place >= 0] << BITS | place[place >= 0])
                out += [x.astype(np.int16).tobytes() for x in np.split(key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(1, s.hi - s.lo)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(out, pa.binary())], names=["id", "toxic", "cols"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, fold: int) -> ToxicModel:
    """Fits on labelled documents whose ``crc32(id) % folds != fold``.

    Places are counted and chosen by Spark; the driver holds at most ``2 ** BITS`` counts, and of each sampled document its
    numbers among the ``FEATURES`` chosen places (two bytes each), however long its text is.
    """
    spark = docs.sparkSession
    lab = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    lab = lab.filter(F.crc32(F.col("id").cast("string")) % folds != fold)
    known = lab.join(docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct(), "id", "left_semi")
    share = {t: n for t, n in known.groupBy("toxic").count().collect()}
    total = sum(share.values())
    picked = None
    for t in (0, 1):  # at most SAMPLE ids each
        part = known.filter(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        picked = part if picked is None else picked.unionByName(part)
    of = share.get(1, 0) / total if total else 0.0
    # the sampled texts, one of each id, apart: at most 2 * SAMPLE of them
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    sample = materialize(sample.groupBy("id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")), "op7-sample")
    n = {t: k for t, k in sample.groupBy("toxic").count().collect()}
    counts = sample.mapInArrow(_place_counts, "range int, place binary, good binary, bad binary").groupBy("range").applyInArrow(_range_counts, "place binary, good binary, bad binary")
    found = [[np.frombuffer(x, np.int32).astype(np.int64) for x in r] for r in counts.toLocalIterator()]  # at most 2 ** BITS places
    place, good, bad = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    places, ratios = choose_places(place, bad, good, n.get(1, 0), n.get(0, 0))
    cols = sample.mapInArrow(_chosen_columns(spark.sparkContext.broadcast(places)), "id long, toxic int, cols binary")
    rows = sorted(cols.toLocalIterator(), key=lambda x: x.id)
    return fit_toxic([np.frombuffer(x.cols, np.int16) for x in rows], np.array([x.toxic for x in rows]), of, places, ratios)


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of every text."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        m = words.revive(ToxicModel, held.value)
        for batch in batches:
            parts = [m.score(s) for s in words.slices(batch.column(1), words.SPACED, True)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", 4, 2)
    got = score_toxicity(docs, model)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
