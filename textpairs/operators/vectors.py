"""Attention inside sequences of vectors (VEC1-VEC4, JOI5, WIN6).

Input: one row per vector ``(seq, pos, vec array<float>)`` with ``0 <= pos < max_len``; inside a
sequence every vector is a query and a key; with ``causal=True`` a query at ``q`` sees keys
at ``k <= q``.  Per query the operator returns the scaled-dot-score summary (number of visible
keys, best key, max score, log of the softmax normaliser, largest weight, entropy) and
the softmax-weighted pooling of the key vectors.

A sequence is cut into query blocks of ``block_size`` positions.  Every vector goes as a key to
the blocks that can see it, so one shuffle on ``(seq, block)`` puts a block's queries and all
their keys into one task: at most ``max_len`` vectors, however many sequences there are.  One
vectorised kernel pass then gives the final rows; no (query, key) pair is ever a row, and
partial results need no merge.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.fixed import SEQUENCE_LENGTH
from textpairs.functions.arrays import hadamard

COLUMNS = ["seq", "q_pos", "n_keys", "best_key", "max_score", "log_norm", "max_weight", "entropy", "pooled"]
OUT = "n_keys long, best_key long, max_score double, log_norm double, max_weight double, entropy double, pooled array<double>"


def _kernel(causal: bool, block_size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seq, block = pdf["seq"].iloc[0], int(pdf["blk"].iloc[0])
        pos = pdf["pos"].to_numpy(np.int64)
        k = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        mine = pos // block_size == block
        if not mine.any():  # keys of a shorter sequence, sent to a block that it does not reach
            return pd.DataFrame(columns=COLUMNS)
        q, q_pos = k[mine], pos[mine]
        scores = (q @ k.T) / math.sqrt(k.shape[1])
        visible = pos[None, :] <= q_pos[:, None] if causal else np.ones(scores.shape, dtype=bool)
        masked = np.where(visible, scores, -np.inf)
        top = masked.max(axis=1)
        best = np.where(masked == top[:, None], pos[None, :], np.iinfo(np.int64).max).min(axis=1)
        weights = np.exp(masked - top[:, None])
        total = weights.sum(axis=1)
        log_norm = top + np.log(total)
        return pd.DataFrame(
            {
                "seq": seq,
                "q_pos": q_pos,
                "n_keys": visible.sum(axis=1).astype(np.int64),
                "best_key": best,
                "max_score": top,
                "log_norm": log_norm,
                "max_weight": 1.0 / total,
                "entropy": log_norm - (weights * np.where(visible, scores, 0.0)).sum(axis=1) / total,
                "pooled": list((weights @ k) / total[:, None]),
            }
        )

    return run


def attention(
    df: DataFrame,
    seq: str,
    pos: str,
    vec: str,
    causal: bool = True,
    max_len: int = SEQUENCE_LENGTH,
    block_size: int = 64,
) -> DataFrame:
    """VEC1 + VEC2 + VEC3: (seq, q_pos, n_keys, best_key, max_score, log_norm, max_weight, entropy, pooled).

    ``log_norm`` = log of the sum over visible keys of exp(score); the softmax weight of key k is
    ``exp(score_k - log_norm)``; ``max_weight`` is the largest weight and ``entropy`` the
    entropy of the weights; ``pooled`` = sum of weight * key vector (array<double>).
    A position outside ``0 .. max_len - 1`` is an error.
    """
    p = F.col(pos).cast("long")
    checked = F.when((p >= 0) & (p < max_len), p).otherwise(F.raise_error(F.concat(F.lit(f"position outside 0..{max_len - 1}: "), p.cast("string"))).cast("long"))
    last = F.lit((max_len - 1) // block_size)
    first = (F.expr("pos div {}".format(block_size)) if causal else F.lit(0)).cast("int")
    rows = df.select(F.col(seq).alias("seq"), checked.alias("pos"), F.col(vec).alias("vec"))
    spread = rows.withColumn("blk", F.explode(F.sequence(first, last.cast("int"))))
    schema = f"seq {df.schema[seq].dataType.simpleString()}, q_pos long, {OUT}"
    return spread.groupBy("seq", "blk").applyInPandas(_kernel(causal, block_size), schema).withColumnRenamed("seq", seq)


def bind_role(pooled: DataFrame, roles: DataFrame, keys: list[str], pooled_col: str = "pooled", role_col: str = "role") -> DataFrame:
    """VEC4: pooled vector times a role vector, element-wise (joined on the query key)."""
    return pooled.join(roles.select(*keys, role_col), keys).withColumn("bound", hadamard(pooled_col, role_col))
