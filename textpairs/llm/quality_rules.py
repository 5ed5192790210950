"""Quality by weak supervision: rules vote or abstain, and one posterior probability decides.

Each rule reads per-document statistics and votes good, bad or abstains.  Expectation-maximisation
over the counts of vote patterns (at most ``3 ** len(RULES)`` rows, counted over all documents)
estimates for each rule how often its good and its bad votes are right, and the share of good
documents.  Faults of different kinds seldom meet in one document, so the likelihood alone would call
only the commonest kind bad; each rule's ``floor`` (how seldom it wrongs a good document) keeps the others.  The posterior probability of *good* replaces an all-rules-must-pass filter.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; an empty
table gives no rows; equal rows get equal results; columns of the input other than the id are not
carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm import words
from textpairs.session import materialize

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = True  # a lead byte stands for a letter
_END = np.zeros(256, bool)
_END[list(b'.!?":;')] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
WINDOW = 5

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines", "n_ended", "n_distinct"]


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[off])


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each of ``n`` documents."""
    if not len(h):
        return np.zeros(n, np.int64)
    _, at = np.unique(words.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(doc[at], minlength=n)


def slice_stats(s: words.Slice) -> dict[str, np.ndarray]:
    n = s.hi - s.lo
    h = words.word_hashes(s)
    doc = s.doc_of_word()
    # lines: runs between \n, cut at document borders
    cut = s.buf == 10
    starts = np.union1d(s.byte_off[:-1], np.flatnonzero(cut) + 1)
    starts = starts[starts < len(s.buf)]
    ends = np.append(starts[1:], len(s.buf))
    ends = ends - ((ends > starts) & cut[ends - 1]) if len(ends) else ends
    first = np.searchsorted(s.starts, starts)
    last = np.searchsorted(s.starts, ends)
    some = last > first
    starts, ends, last = starts[some], ends[some], last[some]
    line_doc = np.searchsorted(s.byte_off, starts, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    ended = _END[s.buf[s.ends[last - 1] - 1]] if len(last) else np.zeros(0, bool)
    line_hash = words.hash_words(s.buf, starts, ends)
    # words under windows that occur twice or more in their document
    at = words.window_starts(s.off, WINDOW)
    repeat = np.zeros(n, np.int64)
    if len(at):
        w = words.mix(words.window_hashes(h, WINDOW)[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, index, times = np.unique(w, return_inverse=True, return_counts=True)
        at = at[times[index] > 1]
        cover = np.bincount(at, minlength=len(h) + 1) - np.bincount(at + WINDOW, minlength=len(h) + 1)
        repeat = _per_doc(np.cumsum(cover[: len(h)]) > 0, s.off)
    return {
        "n_words": s.counts,
        "word_chars": _per_doc(words.SPACED[s.buf] & _LEAD[s.buf], s.byte_off),
        "n_symbols": _per_doc(_SYMBOL[s.buf], s.byte_off),
        "n_dup_lines": n_lines - _distinct(line_doc, line_hash, n),
        "n_repeat_words": repeat,
        "n_upper": _per_doc(_UPPER[s.buf], s.byte_off),
        "n_letters": _per_doc(_LETTER[s.buf], s.byte_off),
        "n_lines": n_lines,
        "n_ended": np.bincount(line_doc[ended], minlength=n),
        "n_distinct": _distinct(doc, h, n),
    }


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the counts ``STATS`` of each whole text."""

    def run(batches):
        for batch in batches:
            parts = [slice_stats(s) for s in words.slices(batch.column(1), words.SPACED, False)]
            if parts:
                cols = {c: pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in STATS}
                yield pa.RecordBatch.from_pydict({"id": batch.column(0)} | cols)

    schema = "id long, " + ", ".join(f"{c} long" for c in STATS)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Rule:
    name: str
    good: Column
    bad: Column
    floor: float  # least share of right votes on good documents: what the rule's author vouches for


def rules() -> list[Rule]:
    """The voting rules; a document for which neither side holds makes the rule abstain."""
    c = F.col
    return [
        Rule("symbols", c("n_symbols") * 100 <= c("word_chars"), c("n_symbols") * 100 > c("word_chars") * 8, 0.999),
        Rule("dup_lines", (c("n_lines") >= 3) & (c("n_dup_lines") == 0), c("n_dup_lines") * 100 > c("n_lines") * 50, 0.97),
        Rule("repeats", (c("n_words") >= 20) & (c("n_repeat_words") * 100 <= c("n_words") * 2), c("n_repeat_words") * 100 > c("n_words") * 18, 0.97),
        Rule("word_length", (c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 9 * c("n_words")), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")), 0.99),
        Rule("size", c("n_words") >= 40, c("n_words") < 10, 0.9),
        Rule("capitals", c("n_upper") * 100 <= c("n_letters") * 10, c("n_upper") * 100 > c("n_letters") * 40, 0.999),
        Rule("line_ends", c("n_ended") * 100 >= c("n_lines") * 60, c("n_ended") * 100 < c("n_lines") * 15, 0.9),
        Rule("variety", c("n_distinct") * 100 >= c("n_words") * 30, (c("n_words") >= 20) & (c("n_distinct") * 100 < c("n_words") * 12), 0.97),
    ]


@dataclass
class VoteModel:
    """Share of good documents, and how often each rule's good vote (bad vote) falls on a good (bad) document's side."""

    prior: float
    on_good: np.ndarray  # P(vote good | good document, voted)
    on_bad: np.ndarray  # P(vote bad | bad document, voted)

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        up = np.log(self.on_good / (1 - self.on_bad))
        down = np.log((1 - self.on_good) / self.on_bad)
        return np.log(self.prior / (1 - self.prior)) + (votes > 0) @ up + (votes < 0) @ down

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(votes)))


def start(floors: np.ndarray) -> VoteModel:
    """Where EM starts: most documents are good, and each rule sees its own kind of fault only."""
    return VoteModel(0.8, (1 + floors) / 2, np.full(len(floors), 0.2))


def fit_votes(votes: np.ndarray, counts: np.ndarray, floors: np.ndarray, rounds: int = 100) -> VoteModel:
    """EM over vote patterns (rows of -1, 0, 1) that occur ``counts`` times."""
    m = start(floors)
    votes, counts = votes.astype(float), counts.astype(float)
    for _ in range(rounds):
        good = m.posterior(votes) * counts
        bad = counts - good
        # a little prior weight keeps every estimate inside (0, 1); on_good + on_bad >= 1 keeps each vote on its own side
        on_good = np.clip((good @ (votes > 0) + 4) / (good @ (votes != 0) + 4.02), floors, 0.9995)
        on_bad = np.clip((bad @ (votes < 0) + 1) / (bad @ (votes != 0) + 2), 1 - on_good + 1e-6, 0.9995)
        m = VoteModel(float(np.clip((good.sum() + 4) / (counts.sum() + 5), 0.01, 0.99)), on_good, on_bad)
    return m


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Statistics, each rule's vote (``vote_<name>``), ``quality`` (posterior), ``base_failed`` and ``kept``."""
    stats = materialize(text_stats(docs, id_col, text_col), "op5-stats")
    named = rules()
    floors = np.array([r.floor for r in named])
    voted = stats.withColumns({f"vote_{r.name}": F.when(r.bad, -1).when(r.good, 1).otherwise(0) for r in named})
    names = [f"vote_{r.name}" for r in named]
    patterns = voted.groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    if patterns:
        got = np.array([tuple(p) for p in patterns], dtype=np.int64)
        order = np.lexsort(got.T[::-1])
        model = fit_votes(got[order, :-1], got[order, -1], floors)
    else:
        model = start(floors)
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for n, g, b in zip(names, model.on_good.tolist(), model.on_bad.tolist()):
        odds = odds + F.when(F.col(n) > 0, float(np.log(g / (1 - b)))).when(F.col(n) < 0, float(np.log((1 - g) / b))).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
