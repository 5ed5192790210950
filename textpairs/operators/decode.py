"""Greedy decoding, character by character (PIP3, SRT7, UDF1).

``step_predictor`` turns any model that gives logits for the next id into a UDF1 predictor: it starts with <bos>,
takes ``max_len - 1`` steps, and each step appends the arg-max of the logits (the smallest id of equal ones).

``CountedModel`` is such a model, counted from training pairs by Spark.  It knows three contexts, asked in this order:

1. the row's question, the step and the last id (the *memory* of that question's training answers);
2. the last two ids (the first step has -1 for the one before <bos>);
3. the last id.

The next id is the one that followed most often in the first context that training has, the smallest of equally
frequent ones; a context that training has in none of the three forms gives <eos>, so <eos> follows <eos> to the end.
Rows with one question differ only in how far they are decoded: each question is decoded once, as far as its longest row,
and its rows take their part.  So a memory reaches one place, by a join on a number of the question, and the model of millions of
questions is never in one place; only the contexts of one and two ids are broadcast (at most the code space, and ``PAIR_CONTEXTS``).

Defined cases: a null question has no memory (and joins nothing); a null answer counts nowhere; rows that repeat count
each; a ``max_len`` of one gives <bos> alone, of zero or null nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.fixed import BOS, EOS
from textpairs.operators.evaluate import bounded_slices
from textpairs.operators.vocab import Vocabulary
from textpairs.session import materialize

#: contexts of two ids that the model keeps, the most frequent first: bounds what is broadcast
PAIR_CONTEXTS = 1 << 20
#: questions decoded side by side, and the ids and memory entries that they may have together
ROWS = 1 << 12
CELLS = 1 << 22


def step_predictor(make_step: Callable[[], Callable[[list, np.ndarray], np.ndarray]]):
    """A UDF1 predictor from a model of one step.

    ``make_step() -> step(questions, prefixes) -> logits``: question ids of the rows still decoded, their ids so far
    as an (n, steps) matrix, and (n, vocabulary) logits for the next id.
    """

    def make_predictor():
        step = make_step()

        def predict(questions, max_lens):
            lens = np.nan_to_num(np.asarray(max_lens, dtype=float)).astype(np.int64)
            out = np.full((len(questions), max(1, int(lens.max(initial=1)))), BOS, np.int64)
            for at in range(1, out.shape[1]):
                live = np.flatnonzero(lens > at)
                logits = np.asarray(step([questions[i] for i in live], out[live, :at]))
                out[live, at] = logits.argmax(1)
            return [out[i, :n].tolist() for i, n in enumerate(lens)]

        return predict

    return make_predictor


# ----------------------------------------------------------------------------- the counted model
#: an id is below this power of two (the code space and the specials)
ID_BITS = 21


def _most_frequent(transitions: DataFrame, context: list[str]) -> DataFrame:
    """The next id of each context: the most frequent, the smallest of equals (count and id as one number, so that its largest is hashed)."""
    each = transitions.groupBy(*context, "next").agg(F.count(F.lit(1)).alias("c"))
    top = F.max(F.shiftleft(F.col("c"), ID_BITS) + F.lit((1 << ID_BITS) - 1) - F.col("next"))
    return each.groupBy(*context).agg((F.lit((1 << ID_BITS) - 1) - top.bitwiseAND(F.lit((1 << ID_BITS) - 1))).cast("int").alias("next"))


def transitions(train: DataFrame, voc: Vocabulary, keep=()) -> DataFrame:
    """(keep..., step, before, prev, next): every step of every training answer; step 1 gives the first character."""
    ids = train.filter(F.col("answer").isNotNull()).select(*keep, voc.encode("answer").alias("__ids"))
    at = F.sequence(F.lit(1), F.size("__ids") - 1)
    steps = F.transform(
        at,
        lambda i: F.struct(
            i.alias("step"),
            F.when(i > 1, F.get("__ids", i - F.lit(2))).otherwise(F.lit(-1)).alias("before"),
            F.get("__ids", i - F.lit(1)).alias("prev"),
            F.get("__ids", i).alias("next"),
        ),
    )
    return ids.select(*keep, F.explode(steps).alias("s")).select(*keep, "s.*")


def count_contexts(train: DataFrame, voc: Vocabulary) -> dict:
    """Contexts 2 and 3 as sorted arrays, bounded by ``PAIR_CONTEXTS`` and the code space."""
    t = transitions(train, voc)
    # one pass over the answers: pairs of ids first, single ids from their counts
    each = t.groupBy("before", "prev", "next").agg(F.count(F.lit(1)).alias("c")).persist()
    try:
        best = lambda ctx: each.groupBy(*ctx, "next").agg(F.sum("c").alias("c")).groupBy(*ctx).agg(
            F.max_by("next", F.struct("c", -F.col("next"))).alias("next"), F.sum("c").alias("n")
        )
        two = best(["before", "prev"]).orderBy(F.desc("n"), "before", "prev").limit(PAIR_CONTEXTS).toPandas()
        one = best(["prev"]).toPandas()
    finally:
        each.unpersist()
    two = two.sort_values(["before", "prev"])
    one = one.sort_values("prev")
    key = (two["before"].to_numpy(np.int64) + 1) << 21 | two["prev"].to_numpy(np.int64)
    return {"two": key, "two_next": two["next"].to_numpy(np.int32), "one": one["prev"].to_numpy(np.int64), "one_next": one["next"].to_numpy(np.int32)}


def question_memories(train: DataFrame, questions: DataFrame, voc: Vocabulary) -> DataFrame:
    """(no, memory) of the ``questions(question, no)`` that training rows have; memory: [(at, next)] in order of ``at``, which is the step
    above ``ID_BITS`` bits of the last id.

    A memory has at most (longest answer x characters) entries, however many rows have the question: they are counted
    before they are gathered, under the question's number instead of its text.  Answers to other questions are not taken apart.
    """
    asked = train.join(questions.select("question", "no"), "question").select("no", "answer")
    at = F.shiftleft(F.col("step").cast("long"), ID_BITS).bitwiseOR(F.col("prev").cast("long"))
    best = _most_frequent(transitions(asked, voc, ["no"]).select("no", at.alias("at"), "next"), ["no", "at"])
    return best.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("at", "next"))).alias("memory"))


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each wanted key is known, its value)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def decode_rows(contexts: dict, sizes: np.ndarray, at: np.ndarray, follows: np.ndarray, max_lens: np.ndarray) -> list[np.ndarray]:
    """Predictions of rows side by side: one look-up a step and context for all rows that go on.

    ``sizes``: entries of each row's memory; ``at``, ``follows``: the memories' entries, one row after another.
    """
    lens = np.asarray(max_lens, np.int64)
    # memories are in order of (step, prev), so the joint keys rise
    keys = np.repeat(np.arange(len(sizes)), sizes) << 51 | at
    begin = np.cumsum(np.maximum(lens, 0)) - np.maximum(lens, 0)
    out = np.full(int(np.maximum(lens, 0).sum()), EOS, np.int32)
    out[begin[lens > 0]] = BOS
    before, prev = np.full(len(lens), -1), np.full(len(lens), BOS)
    live = np.flatnonzero(lens > 1)
    step = 1
    while len(live):
        known, nxt = _find(keys, follows, live << 51 | step << ID_BITS | prev[live])
        two, by_two = _find(contexts["two"], contexts["two_next"], (before[live] + 1) << 21 | prev[live])
        one, by_one = _find(contexts["one"], contexts["one_next"], prev[live])
        got = np.where(known, nxt, np.where(two, by_two, np.where(one, by_one, EOS)))
        out[begin[live] + step] = got
        before[live], prev[live] = prev[live], got
        step += 1
        live = live[(lens[live] > step) & (got != EOS)]  # after <eos> only <eos> follows
    return np.split(out, np.cumsum(np.maximum(lens, 0))[:-1]) if len(lens) else []


class CountedModel:
    """A character model counted from ``train(question, answer)``."""

    def __init__(self, train: DataFrame, voc: Vocabulary):
        self.train, self.voc = train.select("question", "answer"), voc
        self.contexts = count_contexts(self.train, voc)

    def decode(self, rows: DataFrame, keys: list[str], max_len_col: str = "max_len", out_col: str = "pred_ids") -> DataFrame:
        """``keys`` and ``max_len`` ids for each of ``rows(keys, question, max_len)``."""
        held = rows.sparkSession.sparkContext.broadcast(self.contexts)
        rows = rows.select(*keys, "question", F.greatest(F.coalesce(F.col(max_len_col).cast("long"), F.lit(0)), F.lit(0)).cast("int").alias("__len"))
        # written once, so that a question keeps its number
        asked = rows.groupBy("question").agg(F.max("__len").alias("len")).withColumn("no", F.monotonically_increasing_id())
        asked = materialize(asked, "asked")
        with_memory = asked.select("no", "len").join(question_memories(self.train, asked, self.voc), "no", "left")

        def run(batches):
            for batch in batches:
                lens = batch.column("len").to_numpy().astype(np.int64)
                sizes = pc.fill_null(pc.list_value_length(batch.column("memory")), 0).to_numpy().astype(np.int64)
                for lo, hi in bounded_slices(lens + sizes, CELLS, ROWS):
                    memory = batch.column("memory").slice(lo, hi - lo).flatten()
                    found = decode_rows(held.value, sizes[lo:hi], memory.field("at").to_numpy(), memory.field("next").to_numpy(), lens[lo:hi])
                    # <eos> once: the rows add theirs
                    ends = [np.flatnonzero(p == EOS) for p in found]
                    found = [p[: e[0] + 1] if len(e) else p for p, e in zip(found, ends)]
                    yield pa.RecordBatch.from_arrays([batch.column("no").slice(lo, hi - lo), pa.array(found, pa.list_(pa.int32()))], names=["no", "ids"])

        found = with_memory.select("no", "len", "memory").mapInArrow(run, "no long, ids array<int>")
        answers = asked.select(F.col("question").alias("__q"), "no").join(found, "no").select("__q", F.col("ids").alias("__ids"))
        both = rows.join(answers, F.col("question").eqNullSafe(F.col("__q")))
        more = F.array_repeat(F.lit(EOS), F.greatest(F.col("__len") - F.size("__ids"), F.lit(0)))
        return both.select(*keys, F.slice(F.concat("__ids", more), F.lit(1), F.col("__len")).alias(out_col))
