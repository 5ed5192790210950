"""Checks, slicing and the length budget (FLT1-FLT6, AGG3, PRJ1).

Checks on the schema are driver-side (they cost nothing); checks on the data are one
small job each (``isEmpty`` is a limit-1 scan, the null report one aggregate).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textpairs.fixed import SEQUENCE_LENGTH

log = logging.getLogger(__name__)

# The position budget of the network gives two limits: a question of SEQUENCE_LENGTH ids, and an
# answer one longer (it is shifted by one position before use).  Nothing applies them unasked.
QUESTION_LIMIT = SEQUENCE_LENGTH
ANSWER_LIMIT = SEQUENCE_LENGTH + 1


def require_columns(df: DataFrame, cols) -> None:
    """FLT1: raise ValueError naming the first missing column."""
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"column {c!r} is needed here; the frame has {df.columns}")


def require_nonempty(df: DataFrame, what: str = "input", strict: bool = True) -> bool:
    """FLT2: error (strict) or warning when the frame has no row; returns non-emptiness."""
    empty = df.isEmpty()
    if empty:
        if strict:
            raise ValueError(f"no rows in the {what} frame")
        log.warning("no rows in the %s frame", what)
    return not empty


def qa_only(df: DataFrame) -> DataFrame:
    """PRJ1: keep only question and answer (after FLT1)."""
    require_columns(df, ["question", "answer"])
    return df.select("question", "answer")


MAX_KEYS = 100_000


def distinct_keys(df: DataFrame, key: str, max_keys: int = MAX_KEYS) -> list:
    """AGG3 / SET2: distinct values of ``key`` in ascending order, null first.

    One row per key reaches the driver, so more than ``max_keys`` are an error: a frame
    of many keys is better grouped than split into named frames.
    """
    require_columns(df, [key])
    keys = [r[0] for r in df.select(key).distinct().orderBy(F.asc_nulls_first(key)).limit(max_keys + 1).collect()]
    if len(keys) > max_keys:
        raise ValueError(f"{key!r} has more than {max_keys} distinct values; group by it instead")
    return keys


def split_by(df: DataFrame, key: str) -> dict:
    """FLT3 / FLT4: ``{value: rows of that value}`` - lazy filters, one per distinct key, null among them.

    Equal module names in different folders are merged (FLT4).  An empty frame gives an
    empty dict.
    """
    require_columns(df, [key])
    if df.isEmpty():
        log.warning("nothing to split: the frame has no rows")
        return {}
    return {k: df.filter(F.col(key).eqNullSafe(F.lit(k))) for k in distinct_keys(df, key)}


def null_report(df: DataFrame, cols=("question", "answer")) -> DataFrame:
    """FLT5: one row: rows and the number of nulls per text column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
    )


def require_all_strings(df: DataFrame, cols=("question", "answer")) -> None:
    """FLT5 strict form: TypeError when any text cell is null."""
    _no_nulls(null_report(df, cols).first().asDict(), cols)


def _no_nulls(report: dict, cols) -> None:
    bad = {c: report[f"null_{c}"] for c in cols if report[f"null_{c}"]}
    if bad:
        raise TypeError(f"text columns must hold strings only; nulls found: {bad}")


def observed(df: DataFrame, cols=("question", "answer"), seen: Observation | None = None) -> tuple[DataFrame, Observation]:
    """FLT2 / FLT5 beside a write that is made anyway: ``df`` and what its first action will have seen of it.

    Spark adds the numbers up in the tasks of that action, so the checks need no job of their own.  A task that runs twice may be
    counted twice: the numbers tell none from some, and are no exact counts.
    """
    seen = seen or Observation()
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols]
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *nulls), seen


def require_observed(seen: Observation, what: str = "input", cols=("question", "answer")) -> None:
    """After the action: ValueError without a row (FLT2), TypeError with a null text (FLT5)."""
    report = seen.get
    if not report["n_rows"]:
        raise ValueError(f"no rows in the {what} frame")
    _no_nulls(report, cols)


def within_budget_condition(question: str = "question", answer: str = "answer", question_limit: int | None = None, answer_limit: int | None = None):
    """FLT6 on the text: ``size(ids) = length + 2`` exactly (one id per code point plus <bos> and
    <eos>), so the budget needs no encoding.  A limit of None lets every length pass."""
    cond = F.lit(True)
    for c, limit in ((question, question_limit), (answer, answer_limit)):
        if limit is not None:
            cond = cond & (F.length(c) + F.lit(2) <= F.lit(limit))
    return cond


def within_budget_text(df: DataFrame, question: str = "question", answer: str = "answer", question_limit: int | None = None, answer_limit: int | None = None) -> DataFrame:
    """FLT6: the rows whose texts fit the given limits; all rows when none is given."""
    if question_limit is None and answer_limit is None:
        return df
    return df.filter(within_budget_condition(question, answer, question_limit, answer_limit))


def budget_report(df: DataFrame, by: str = "folder", q_ids: str = "question_ids", a_ids: str = "answer_ids") -> DataFrame:
    """FLT6 report: per ``by``, pairs, over-long questions / answers, dropped and kept rows."""
    over_q = F.size(q_ids) > F.lit(QUESTION_LIMIT)
    over_a = F.size(a_ids) > F.lit(ANSWER_LIMIT)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(over_q).alias("over_question"),
        F.count_if(over_a).alias("over_answer"),
        F.count_if(over_q | over_a).alias("dropped"),
        F.count_if(~(over_q | over_a)).alias("kept"),
    )
