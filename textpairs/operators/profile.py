"""Profiling tables behind the reference's printouts and charts (AGG4-AGG9, SRT1, SRT2, PRJ2).

Every statistic is an aggregate with a partial (map-side) phase.  The exact
percentiles use Spark's ``percentile``, whose buffer is a value -> count map: for
lengths that is bounded by the number of distinct lengths, not by the rows, so the
exact form stays safe on large inputs.  ``approx=True`` switches to
``percentile_approx`` for columns with very many distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.fixed import WHISKER_IQR
from textpairs.functions.text import code_length, round1
from textpairs.operators.clean import require_columns
from textpairs.operators.rank import DEFAULT_SEED, order_hash

QUARTILES = [0.25, 0.5, 0.75]
STAT_ORDER = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def _quartiles(c, approx: bool):
    if approx:
        return F.percentile_approx(c, QUARTILES, 10000)
    return F.percentile(c, F.array(*[F.lit(q) for q in QUARTILES]))


def lengths(df: DataFrame, cols=("question", "answer")) -> DataFrame:
    """FUN5 + PRJ2: ``<col>_length`` per text column."""
    require_columns(df, cols)
    return df.select(*[code_length(c).alias(f"{c}_length") for c in cols])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """AGG4: (value, count) without nulls, ordered by count desc then value."""
    require_columns(df, [column])
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(column))
    )


def value_share(df: DataFrame, column: str) -> DataFrame:
    """AGG5: adds ``share`` = count / total.

    The total is a scalar subquery over the counted values, so the rows are read once and the
    counts stay distributed (a window over all of them would gather them into one partition).
    """
    vc = value_counts(df, column)
    return vc.withColumn("share", F.col("count") / vc.agg(F.sum("count")).scalar().cast("double"))


def length_stats(df: DataFrame, cols=("question", "answer"), approx: bool = False, rounded: bool = True) -> DataFrame:
    """AGG6: pandas ``describe()`` of the code-point lengths, one row per statistic.

    Output (stat, question_length, answer_length), rounded to 1 decimal half-even.
    """
    require_columns(df, cols)
    lens = lengths(df, cols)
    aggs = []
    for c in cols:
        lc = F.col(f"{c}_length")
        aggs += [
            F.count(lc).cast("double").alias(f"{c}__count"),
            F.avg(lc).alias(f"{c}__mean"),
            F.stddev_samp(lc).alias(f"{c}__std"),
            F.min(lc).cast("double").alias(f"{c}__min"),
            _quartiles(lc, approx).alias(f"{c}__q"),
            F.max(lc).cast("double").alias(f"{c}__max"),
        ]
    one = lens.agg(*aggs)

    def stat_value(c, s):
        if s in ("25%", "50%", "75%"):
            v = F.element_at(F.col(f"{c}__q"), QUARTILES.index({"25%": 0.25, "50%": 0.5, "75%": 0.75}[s]) + 1).cast("double")
        else:
            v = F.col(f"{c}__{s}")
        return round1(v) if rounded else v

    rows = F.array(
        *[
            F.struct(F.lit(s).alias("stat"), *[stat_value(c, s).alias(f"{c}_length") for c in cols])
            for s in STAT_ORDER
        ]
    )
    return one.select(F.inline(rows))


def length_hist(df: DataFrame, cols=("question", "answer")) -> DataFrame:
    """AGG7: (column, length, count) - rows per exact length, existing lengths only; one scan."""
    require_columns(df, cols)
    per_row = F.array(*[F.struct(F.lit(c).alias("column"), code_length(c).alias("length")) for c in cols])
    return (
        df.select(F.inline(per_row))
        .groupBy("column", "length")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("column", "length")
    )


def length_extent(df: DataFrame, cols=("question", "answer")) -> DataFrame:
    """AGG8: (column, distinct_lengths, max_length)."""
    require_columns(df, cols)
    per_row = F.array(*[F.struct(F.lit(c).alias("column"), code_length(c).alias("length")) for c in cols])
    return (
        df.select(F.inline(per_row))
        .groupBy("column")
        .agg(F.count_distinct("length").alias("distinct_lengths"), F.max("length").alias("max_length"))
    )


def _length_hist_by(df: DataFrame, column: str, by: str) -> DataFrame:
    """(by, length, cnt): the only pass over row data; bounded by groups x distinct lengths."""
    return df.groupBy(by, code_length(column).alias("length")).agg(F.count(F.lit(1)).alias("cnt"))


def _box_fences(hist: DataFrame, by: str, approx: bool) -> DataFrame:
    if approx:
        q = hist.groupBy(by).agg(F.percentile_approx(F.col("length"), QUARTILES, 10000).alias("q"))
    else:
        # exact quartiles from the histogram: percentile with a frequency column
        q = hist.groupBy(by).agg(F.percentile(F.col("length"), F.array(*[F.lit(x) for x in QUARTILES]), F.col("cnt")).alias("q"))
    return q.select(
        by,
        F.col("q")[0].cast("double").alias("q1"),
        F.col("q")[1].cast("double").alias("median"),
        F.col("q")[2].cast("double").alias("q3"),
    ).withColumn("iqr", F.col("q3") - F.col("q1")).withColumn(
        "lo_fence", F.col("q1") - F.lit(WHISKER_IQR) * F.col("iqr")
    ).withColumn("hi_fence", F.col("q3") + F.lit(WHISKER_IQR) * F.col("iqr"))


def box_stats(df: DataFrame, column: str = "question", by: str = "folder", approx: bool = False) -> DataFrame:
    """AGG9: per group Q1, median, Q3, whiskers (most extreme points inside 1.5 IQR), outlier count.

    One aggregate over the rows builds a (group, length) histogram; quartiles, whiskers
    and counts are then computed on the histogram alone, so the row data is read once
    and never joined.  No mutation of the input.
    """
    require_columns(df, [column, by])
    hist = _length_hist_by(df, column, by)
    fences = _box_fences(hist, by, approx)
    inside = (F.col("length") >= F.col("lo_fence")) & (F.col("length") <= F.col("hi_fence"))
    return hist.join(fences, by).groupBy(by, "q1", "median", "q3").agg(
        F.sum("cnt").alias("n"),
        F.min(F.when(inside, F.col("length"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("length"))).alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("cnt"))), F.lit(0)).cast("long").alias("n_outliers"),
    )


BROADCAST_GROUPS = 100_000
SALTS = 64


def box_outliers(df: DataFrame, keys: list[str], column: str = "question", by: str = "folder", approx: bool = False) -> DataFrame:
    """AGG9 outliers: (keys..., by, length) of the points beyond the fences.

    Fences come from the histogram, one row per group.  Up to ``BROADCAST_GROUPS`` groups
    (counted) they are broadcast; beyond, rows and fences are joined on the group and a
    salt, so that a group that holds most rows is spread over ``SALTS`` tasks.
    """
    require_columns(df, [column, by, *keys])
    fences = _box_fences(_length_hist_by(df, column, by), by, approx)
    lens = df.select(*keys, *([by] if by not in keys else []), code_length(column).alias("length"))
    if fences.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        joined = lens.join(F.broadcast(fences), by)
    else:
        salted = fences.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = lens.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")).join(salted, [by, "__salt"])
    return (
        joined
        .filter((F.col("length") < F.col("lo_fence")) | (F.col("length") > F.col("hi_fence")))
        .select(*keys, *([by] if by not in keys else []), "length")
    )


def head_sample(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """SRT1: first ``n`` rows in key order - a top-k (TakeOrderedAndProject), no full sort."""
    if not isinstance(n, int) or n <= 0:
        raise ValueError(f"a sample needs a whole number of rows above 0; got {n!r}")
    return df.orderBy(*order).limit(n)


def random_sample(df: DataFrame, keys: list[str], n: int = 5, seed: int = DEFAULT_SEED) -> DataFrame:
    """SRT2: exactly ``n`` rows without replacement (all rows when fewer), seeded and repeatable."""
    if not isinstance(n, int) or n <= 0:
        raise ValueError(f"a sample needs a whole number of rows above 0; got {n!r}")
    h = order_hash(seed, *keys)
    return df.withColumn("__h", h).orderBy("__h", *keys).limit(n).drop("__h")
