"""Scoring of predictions (FUN10, AGG11, AGG12, SRT6-SRT8, JOI3, UDF1).

``batch_predict`` is the one place where a caller's model runs: ``mapInArrow``, few enough ids
at a time, the predictor set up once per task.  Everything around it (joins on
the row key, matching, averaging) is built-in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.functions.arrays import PAD, cross_entropy_at, exact_match


#: ids that a model reads and writes at once, unless one row alone has more
CELLS = 1 << 21


def bounded_slices(sizes: np.ndarray, limit: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Neighbouring rows (from, to) whose sizes sum to at most ``limit``, at most ``rows`` of them; a larger row stands alone."""
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < len(sizes):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right"))
        hi = max(lo + 1, hi if rows is None else min(hi, lo + rows))
        yield lo, hi
        lo = hi


def match_predictions(batches: DataFrame, predictions: DataFrame, keys: list[str], target: str = "answers", pred: str = "pred_ids") -> DataFrame:
    """JOI3 + FUN10: join predictions to their rows on the key, add ``match``."""
    return batches.join(predictions.select(*keys, pred), keys, "inner").withColumn("match", exact_match(target, pred))


def accuracy(df: DataFrame, match_col: str = "match", by=None) -> DataFrame:
    """AGG11: rows, matches and accuracy = matches / rows (null - not an error - on no rows)."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(match_col)).alias("matches"),
        F.avg(F.col(match_col).cast("double")).alias("accuracy"),
    ]
    if by:
        return df.groupBy(*([by] if isinstance(by, str) else by)).agg(*aggs)
    return df.agg(*aggs)


def first_batches(df: DataFrame, fraction: float, batch_col: str = "batch_id") -> tuple[DataFrame, int, int]:
    """SRT6: rows of the first ``int(n_batches * fraction)`` batches (fraction in [0, 1])."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction is a share of the batches, from 0 to 1; got {fraction!r}")
    n_batches = df.agg(F.max(batch_col)).first()[0]
    n_batches = 0 if n_batches is None else int(n_batches) + 1
    k = int(n_batches * fraction)
    return df.filter(F.col(batch_col) < F.lit(k)), n_batches, k


def argmax_long(df: DataFrame, keys: list[str], id_col: str, value_col: str, out: str = "pred") -> DataFrame:
    """SRT7 long form: per key the id of the largest value, ties to the lowest id.

    ``max_by`` over ``struct(value, -id)``: the partial aggregate keeps one candidate per
    key and task, so the shuffle carries one row per key and partition.
    """
    return df.groupBy(*keys).agg(F.max_by(F.col(id_col), F.struct(F.col(value_col), -F.col(id_col))).alias(out))


def batch_examples(df: DataFrame, pos_col: str = "pos_in_batch") -> DataFrame:
    """SRT8: the first row of every batch."""
    return df.filter(F.col(pos_col) == F.lit(0))


def masked_cross_entropy(df: DataFrame, logits: str, target: str, pad: int = PAD, by=None) -> DataFrame:
    """AGG12: mean of ``-log softmax(logits)[target]`` over positions whose target is not <pad>.

    All positions masked -> null loss (the reference yields NaN).
    """
    kept = df.filter(F.col(target) != F.lit(pad)).withColumn("__xe", cross_entropy_at(logits, target))
    aggs = [F.count(F.lit(1)).alias("positions"), F.avg("__xe").alias("loss")]
    out = kept.groupBy(*([by] if isinstance(by, str) else by)).agg(*aggs) if by else kept.agg(*aggs)
    return out.withColumn("perplexity", F.exp("loss"))


def batch_predict(
    df: DataFrame,
    make_predictor: Callable[[], Callable[[list, np.ndarray], list]],
    keys: list[str],
    ids_col: str = "questions",
    max_len_col: str | None = "max_len",
    out_col: str = "pred_ids",
) -> DataFrame:
    """UDF1: one prediction per row, ``predict(list_of_id_arrays, max_lens) -> list_of_id_lists``.

    ``make_predictor`` is called once per task (load weights there), then fed rows that have few enough ids
    together; ragged id arrays are passed as numpy arrays.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + f", `{out_col}` array<int>"
    cols = [*keys, ids_col] + ([max_len_col] if max_len_col else [])

    def run(batches):
        predict = make_predictor()
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if max_len_col:
                sizes = sizes + np.maximum(pc.fill_null(batch.column(max_len_col), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            for lo, hi in bounded_slices(sizes, CELLS):
                part = batch.slice(lo, hi - lo)
                max_lens = part.column(max_len_col).to_pandas().to_numpy() if max_len_col else np.zeros(hi - lo, dtype=np.int64)
                preds = predict(list(part.column(ids_col).to_pandas()), max_lens)
                found = pa.array([np.asarray(p, dtype=np.int32) for p in preds], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], found], names=[*keys, out_col])

    return df.select(*cols).mapInArrow(run, schema)


def echo_predictor():
    """Deterministic stand-in model that keeps UDF1's contract: exactly ``max_len`` ids that start with
    <bos>.  It answers with the question (cut or padded), so it is right where the two are equal."""

    def predict(ids, max_lens):
        out = []
        for x, n in zip(ids, max_lens):
            y = np.full(int(n), PAD, dtype=np.int32)
            y[: min(int(n), len(x))] = np.asarray(x)[: int(n)]
            out.append(y)
        return out

    return predict


def reverse_predictor():
    """Deterministic stand-in model for tests and checks: the question ids reversed."""

    def predict(ids, _max_lens):
        return [np.asarray(x)[::-1] for x in ids]

    return predict


__all__ = [
    "accuracy",
    "argmax_long",
    "batch_examples",
    "batch_predict",
    "bounded_slices",
    "echo_predictor",
    "first_batches",
    "masked_cross_entropy",
    "match_predictions",
    "reverse_predictor",
]
