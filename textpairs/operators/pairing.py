"""Pairing of alternating question / answer lines (SRC1, SRC4, SRC6, WIN1-WIN3).

Two physical forms, one meaning:

* ``pairs_in_rows`` - every row holds one whole text (a document, a ``wholetext`` file,
  a streamed file).  Lines are split and paired *inside the row* with array functions,
  so the operator is narrow: no shuffle, no window, any number of partitions.
* ``pairs_in_splits`` - one row per line, as a task reads them (the large-file path, see
  ``sources.files``).  A line is paired with the next one of its split; only the lines at the borders
  of splits are put together across tasks, so no exchange carries the text.
* ``pairs_from_lines`` - one row per line with a global line number.  Even and odd lines are joined on
  ``(file, ln div 2)``; needs nothing of how lines lie in tasks, at the price of a shuffle of the text.

Line semantics follow Python's text-mode file iteration: ``\\n``, ``\\r\\n`` and
``\\r`` end a line, a final newline does not open an empty line, an empty text has
no lines.  Both members are stripped of all Unicode white space (FUN1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.functions.text import strip

NEWLINES = r"\r\n|\r|\n"
ON_UNPAIRED = ("quarantine", "drop", "fail")


def text_lines(text) -> Column:
    """Universal-newline split with Python's end-of-text rules."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.split(t, NEWLINES)
    ends_nl = F.substring(t, -1, 1).isin("\n", "\r")
    return (
        F.when(t == F.lit(""), F.array().cast("array<string>"))
        .when(ends_nl, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
        .otherwise(parts)
    )


def _check_mode(on_unpaired: str) -> None:
    if on_unpaired not in ON_UNPAIRED:
        raise ValueError(f"on_unpaired must be one of {ON_UNPAIRED}, got {on_unpaired!r}")


def _check_cap(cap) -> None:
    if cap is not None and (not isinstance(cap, int) or isinstance(cap, bool)):
        raise TypeError(f"the cap on pairs is a whole number or None, got {type(cap).__name__}")
    if cap is not None and cap <= 0:
        raise ValueError(f"the cap on pairs is above 0, got {cap}")


def _exploded_lines(df: DataFrame, text_col: str, keys: list[str], cap: int | None) -> DataFrame:
    """(keys..., ln, q, a): every even line with its successor (null when there is none)."""
    lines = df.select(*keys, text_lines(text_col).alias("__lines"))
    nxt = F.slice(F.col("__lines"), 2, F.greatest(F.size("__lines") - 1, F.lit(0)))
    zipped = F.zip_with(F.col("__lines"), nxt, lambda q, a: F.struct(q.alias("q"), a.alias("a")))
    ex = lines.select(*keys, F.posexplode(zipped).alias("ln", "__qa"))
    cond = F.col("ln") % 2 == 0
    if cap is not None:
        cond = cond & (F.col("ln") < F.lit(2 * cap))
    return ex.filter(cond).select(*keys, F.col("ln").cast("long").alias("ln"), "__qa.q", "__qa.a")


# WIN2: a line is paired with the next one; WIN5: ``posexplode`` gives each line its position.
def pairs_in_rows(
    df: DataFrame,
    text_col: str,
    keys: list[str],
    cap: int | None = None,
    on_unpaired: str = "quarantine",
) -> DataFrame:
    """(keys..., pair_idx, question, answer) from whole texts, one row per pair, no shuffle."""
    _check_mode(on_unpaired)
    _check_cap(cap)
    ex = _exploded_lines(df, text_col, keys, cap)
    answer = strip(F.col("a"))
    if on_unpaired == "fail":
        answer = F.when(
            F.col("a").isNull(),
            F.raise_error(F.concat(F.lit("unpaired trailing line at "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))),
        ).otherwise(answer)
    else:
        ex = ex.filter(F.col("a").isNotNull())
    return ex.select(
        *keys,
        F.shiftright(F.col("ln"), 1).alias("pair_idx"),
        strip(F.col("q")).alias("question"),
        answer.cast("string").alias("answer"),
    )


def unpaired_in_rows(df: DataFrame, text_col: str, keys: list[str], cap: int | None = None) -> DataFrame:
    """SRC6 quarantine: (keys..., ln, text) of an odd last line reached before the cap.

    At most one line per text, so nothing is exploded: the last line where their number is odd.
    """
    _check_cap(cap)
    lines = df.select(*keys, text_lines(text_col).alias("__lines"))
    odd = F.size("__lines") % 2 == 1
    if cap is not None:
        odd = odd & (F.size("__lines") <= F.lit(2 * cap))
    return lines.filter(odd).select(*keys, (F.size("__lines") - 1).cast("long").alias("ln"), F.element_at("__lines", -1).alias("text"))


def pairs_from_lines(
    lines: DataFrame,
    keys: list[str],
    cap: int | None = None,
    on_unpaired: str = "quarantine",
) -> tuple[DataFrame, DataFrame]:
    """(pairs, unpaired) from one row per line ``(keys..., ln, value)``.

    Even lines are joined with odd ones on ``keys + [ln div 2]``: one row on each side, so no key
    can grow with the data however large one file is, and the lines are sorted once, after
    their shuffle (an aggregate over text would also sort them before it).
    """
    _check_mode(on_unpaired)
    _check_cap(cap)
    if cap is not None:
        lines = lines.filter(F.col("ln") < F.lit(2 * cap))
    pair = F.shiftright(F.col("ln"), 1).alias("pair_idx")
    even = lines.filter(F.col("ln") % 2 == 0).select(*keys, pair, F.col("value").alias("q"))
    odd = lines.filter(F.col("ln") % 2 == 1).select(*keys, pair, F.col("value").alias("a"))
    both = even.join(odd, [*keys, "pair_idx"], "left")
    unpaired = both.filter(F.col("a").isNull()).select(*keys, (F.col("pair_idx") * 2).alias("ln"), F.col("q").alias("text"))
    answer = strip(F.col("a"))
    if on_unpaired == "fail":
        answer = F.when(
            F.col("a").isNull(),
            F.raise_error(F.concat(F.lit("unpaired trailing line at "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))),
        ).otherwise(answer)
    else:
        both = both.filter(F.col("a").isNotNull())
    pairs = both.select(*keys, "pair_idx", strip(F.col("q")).alias("question"), answer.cast("string").alias("answer"))
    return pairs, unpaired


# ----------------------------------------------------------------------------- inside splits
def split_lines(lines: DataFrame) -> DataFrame:
    """``(file, block, n, first, last)`` of every split of ``lines(file, block, value)`` as a scan gives them: the rows of a
    split are neighbours in one task.  One read; a row a split comes out."""

    def run(batches):
        now, n, first, last = None, 0, None, None

        def row():
            return pa.RecordBatch.from_pydict({"file": pa.array([now[0]]), "block": pa.array([now[1]], pa.int64()), "n": pa.array([n], pa.int64()), "first": pa.array([first]), "last": pa.array([last])})

        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, value = (batch.column(c) for c in ("file", "block", "value"))
            code = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            at = block.to_numpy()
            new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows]):
                here = (file[a].as_py(), int(at[a]))
                if here != now:
                    if now is not None:
                        yield row()
                    now, n, first = here, 0, value[a].as_py()
                n, last = n + b - a, value[b - 1].as_py()
        if now is not None:
            yield row()

    return lines.select("file", "block", "value").mapInArrow(run, "file string, block long, n long, first string, last string")


def _inside(batches):
    """(no, pair_idx, q, a): even lines of a split with the next line of the same split."""
    held, seen = None, 0  # the last line, if it waits for its answer; lines of its split so far
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        no = batch.column("no").to_numpy()
        new = np.append(no[0] != now, no[1:] != no[:-1])
        start = np.flatnonzero(new)
        at = np.arange(len(no))
        # place in its split: rows since its first one, which may lie in an earlier batch
        begin = np.concatenate(([-seen], start))[np.searchsorted(start, at, "right")]
        ln = batch.column("off").to_numpy() + at - begin
        value = batch.column("value")
        follows = np.append(~new[1:], False)
        q = np.flatnonzero((ln % 2 == 0) & follows)
        parts = [(no[q], ln[q] >> 1, value.take(pa.array(q)), value.take(pa.array(q + 1)))]
        if held is not None and not new[0]:
            parts.insert(0, (no[:1], ln[:1] >> 1, held, value.slice(0, 1)))
        for n, idx, questions, answers in parts:
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(idx), questions, answers], names=["no", "pair_idx", "q", "a"])
        now, seen = no[-1], int(at[-1] - begin[-1]) + 1
        held = value.slice(len(no) - 1, 1) if ln[-1] % 2 == 0 else None


def pairs_in_splits(lines: DataFrame, splits: DataFrame, cap: int | None = None, on_unpaired: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(pairs, unpaired) of ``lines(no, off, value)`` as a scan gives them and the splits' table.

    ``splits(file, no, off, n, first, last, next_first)``: number, lines of the file before it, lines, first and last line, and the
    first line of the next split.  Pairs inside a split are made where they are read; a question that ends its split
    gets its answer from the splits' table, which has one row a split.
    """
    _check_mode(on_unpaired)
    _check_cap(cap)
    name = F.broadcast(splits.select("no", "file"))  # as many rows as the offsets that the caller has broadcast
    inside = lines.select("no", "off", "value").mapInArrow(_inside, "no long, pair_idx long, q string, a string").join(name, "no").select("file", "pair_idx", "q", "a")
    ends = splits.filter((F.col("off") + F.col("n")) % 2 == 1).select("file", F.shiftright(F.col("off") + F.col("n"), 1).alias("pair_idx"), F.col("last").alias("q"), F.col("next_first").alias("a"))
    if cap is not None:
        inside, ends = inside.filter(F.col("pair_idx") < cap), ends.filter(F.col("pair_idx") < cap)
    unpaired = ends.filter(F.col("a").isNull()).select("file", (F.col("pair_idx") * 2).alias("ln"), F.col("q").alias("text"))
    answer = F.col("a")
    if on_unpaired == "fail":
        answer = F.when(F.col("a").isNull(), F.raise_error(F.concat(F.lit("unpaired trailing line at "), F.col("file")))).otherwise(answer)
    else:
        ends = ends.filter(F.col("a").isNotNull())
    pairs = inside.unionByName(ends.select("file", "pair_idx", "q", answer.cast("string").alias("a")))
    return pairs.select("file", "pair_idx", strip(F.col("q")).alias("question"), strip(F.col("a")).alias("answer")), unpaired
