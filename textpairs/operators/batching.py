"""Collation of encoded rows into padded, masked batches (FUN13, AGG10, FUN6-FUN9, UDF2).

A batch is a set of rows sharing ``batch_id`` (see ``rank.batch_ids``); its maximum
length is a window over ``batch_id`` - at most ``batch_size`` rows per window
partition, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpairs.functions import arrays
from textpairs.functions.arrays import pad_to, shift_input, shift_mask, shift_target, src_mask, trg_mask
from textpairs.operators.vocab import Vocabulary, id_bytes, unpack_ids


def pad_batches(
    df: DataFrame,
    ids_cols=("question_ids", "answer_ids"),
    batch_keys=("batch_id",),
    suffix: str = "_padded",
) -> DataFrame:
    """AGG10 + FUN6: pad every id column to the longest one of its batch."""
    w = Window.partitionBy(*batch_keys)
    widths = {f"__w_{c}": F.max(F.size(c)).over(w) for c in ids_cols}
    return df.withColumns(widths).withColumns({f"{c}{suffix}": pad_to(F.col(c), F.col(f"__w_{c}")) for c in ids_cols}).drop(*widths)


def make_batches(
    df: DataFrame,
    q_col: str = "question_ids",
    a_col: str = "answer_ids",
    batch_keys=("batch_id",),
    with_masks: bool = False,
    extra_cols=(),
) -> DataFrame:
    """FUN13 (collate): padded ``questions`` / ``answers`` plus, on demand, both masks.

    ``extra_cols`` (UDF2) are extra Column expressions evaluated per row after padding.
    The L x L target mask is O(L^2) per row, so it is produced only when asked for.
    """
    out = pad_batches(df, (q_col, a_col), batch_keys).withColumnRenamed(f"{q_col}_padded", "questions").withColumnRenamed(
        f"{a_col}_padded", "answers"
    )
    return _finish(out, with_masks, extra_cols)


def make_packed_batches(df: DataFrame, vocab: Vocabulary, text_cols=("question", "answer"), batch_keys=("batch_id",)) -> DataFrame:
    """``make_batches`` of ids that are bytes (``vocab.pack_ids``) until they are behind the batch shuffle."""
    w, n = Window.partitionBy(*batch_keys), id_bytes(vocab.size)
    widths = {f"__w_{c}": F.max((F.octet_length(f"{c}_packed") / n).cast("int")).over(w) for c in text_cols}
    ids = {f"{c}_ids": unpack_ids(F.col(f"{c}_packed"), n) for c in text_cols}
    padded = {out: pad_to(F.col(f"{c}_ids"), F.col(f"__w_{c}")) for c, out in zip(text_cols, ("questions", "answers"))}
    return df.withColumns(widths).withColumns(ids).withColumns(padded).drop(*widths, *[f"{c}_packed" for c in text_cols])


def encode_batches(
    df: DataFrame,
    vocab: Vocabulary,
    text_cols=("question", "answer"),
    batch_keys=("batch_id",),
    with_masks: bool = False,
    extra_cols=(),
) -> DataFrame:
    """FUN13 from text: the batch shuffle carries the texts, and ids are made and padded after it.

    A text of n code points has n + 2 ids, so the batch maximum is known from the text; both
    columns share one window.  Adds ``<col>_ids`` and the columns of ``make_batches``.
    """
    w = Window.partitionBy(*batch_keys)
    widths = {f"__w_{c}": F.max(F.length(c) + F.lit(2)).over(w) for c in text_cols}
    ids = {f"{c}_ids": vocab.encode(c) for c in text_cols}
    padded = {out: pad_to(F.col(f"{c}_ids"), F.col(f"__w_{c}")) for c, out in zip(text_cols, ("questions", "answers"))}
    out = df.withColumns(widths).withColumns(ids).withColumns(padded).drop(*widths)
    return _finish(out, with_masks, extra_cols)


def _finish(out: DataFrame, with_masks: bool, extra_cols) -> DataFrame:
    if with_masks:
        out = out.withColumn("questions_mask", src_mask("questions")).withColumn("answers_mask", trg_mask("answers"))
    if extra_cols:
        out = out.select("*", *extra_cols)
    return out


def teacher_forcing(df: DataFrame, answers: str = "answers") -> DataFrame:
    """FUN9: decoder input, target and (when present) the shifted target mask."""
    out = df.withColumn("decoder_input", shift_input(answers)).withColumn("target", shift_target(answers))
    if "answers_mask" in df.columns:
        out = out.withColumn("decoder_mask", shift_mask("answers_mask"))
    return out


def mask_bits(mask_col) -> F.Column:
    """A boolean matrix as one '0'/'1' string per row (compact exchange form of FUN8)."""
    return arrays.mask_bits(mask_col)
