"""Exact, reproducible ranks and splits without a single-partition sort (H3, SRT3, SRT4, WIN4, SET4, AGG13).

* ``order_hash`` - ``md5(seed|...|key)`` as the random sort key; deterministic under
  task retry, and reproducible in any SQL engine that has ``md5``.
* ``exact_split`` - the first ``floor(n * num / den)`` rows in hash order are "train".
  Only the *threshold* is needed, not the rank: rows are counted per hash-prefix
  bucket (a partial aggregate, one row per bucket), the bucket holding the boundary
  is found on the driver (<= 16^digits rows), and inside that single bucket the
  boundary row is located by a window over roughly n / 16^digits rows.  The split
  itself is then a plain row predicate - no shuffle of the data.
* ``hash_rank`` - the full 0-based rank in hash order: bucket counts -> prefix
  offsets (a window over the bucket table, broadcast) -> ``row_number`` within the
  bucket.  Buckets are uniform by construction (md5 of a unique key), so one
  shuffle with evenly sized window partitions.
* ``ordered_rank`` - the rank in an arbitrary column order (the unshuffled order):
  range partitioning + a local sort, ids taken right after the sort and the frame
  written so that counts and ids come from one and the same partitioning;
  offsets per partition are then tiny (one row per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.fixed import TRAIN_DEN, TRAIN_NUM
from textpairs.session import estimated_bytes, materialize

DEFAULT_SEED = 42
DEFAULT_DIGITS = 4
# Rows per hash bucket we are happy to sort in one window partition.
BUCKET_ROWS = 1_000_000


def auto_digits(df: DataFrame, bytes_per_row: int = 64) -> int:
    """4 hex digits (65,536 buckets), or 5 (1,048,576) when the optimizer's size estimate
    suggests more than ``BUCKET_ROWS`` rows per bucket.  The offsets table (one row per
    bucket, broadcast) stays below ~20 MB either way."""
    size = estimated_bytes(df)
    if size is None:
        return DEFAULT_DIGITS
    return 5 if size // bytes_per_row > BUCKET_ROWS * 16**DEFAULT_DIGITS else DEFAULT_DIGITS


def order_hash(seed, *keys, epoch=None) -> Column:
    """``md5('seed|[epoch|]k1|k2...')``."""
    parts = [F.lit(str(seed))]
    if epoch is not None:
        parts.append(F.lit(str(epoch)))
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def _bucket(h: Column, digits: int) -> Column:
    return F.substring(h, 1, digits)


def split_size(n: int, num: int = TRAIN_NUM, den: int = TRAIN_DEN) -> int:
    """AGG13: ``int(0.8 * n)`` computed exactly as ``n * 4 // 5``."""
    return (n * num) // den


def split_rule(
    df: DataFrame,
    keys: list[str],
    seed: int = DEFAULT_SEED,
    num: int = TRAIN_NUM,
    den: int = TRAIN_DEN,
    digits: int | None = None,
) -> Column:
    """The column of ``exact_split``, from nothing but the keys: any table with the same keys can be split by it."""
    digits = digits or auto_digits(df)
    h = order_hash(seed, *keys)
    hashed = df.withColumn("__h", h).withColumn("__b", _bucket(F.col("__h"), digits))
    counts = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("c")).collect()
    n = sum(r["c"] for r in counts)
    k = split_size(n, num, den)
    if k <= 0:
        return F.lit("val")
    if k >= n:
        return F.lit("train")
    before = 0
    boundary, need = None, 0
    for r in sorted(counts, key=lambda r: r["__b"]):
        if before + r["c"] >= k:
            boundary, need = r["__b"], k - before
            break
        before += r["c"]
    # Locate the need-th row (1-based) of the boundary bucket in (hash, key) order.
    w = Window.partitionBy("__b").orderBy("__h", *keys)
    last = (
        hashed.filter(F.col("__b") == F.lit(boundary))
        .select("__h", *keys, F.row_number().over(w).alias("__rn"))
        .filter(F.col("__rn") == F.lit(need))
        .first()
    )
    if last is None:
        raise RuntimeError("exact_split: the input changed between its jobs (keys must be unique and the input stable)")
    types = {f.name: f.dataType for f in df.schema.fields}
    thr = F.struct(F.lit(last["__h"]).alias("__h"), *[F.lit(last[k]).cast(types[k]).alias(k) for k in keys])
    mine = F.struct(h.alias("__h"), *[F.col(k) for k in keys])
    return F.when(mine <= thr, F.lit("train")).otherwise(F.lit("val"))


def exact_split(
    df: DataFrame,
    keys: list[str],
    seed: int = DEFAULT_SEED,
    num: int = TRAIN_NUM,
    den: int = TRAIN_DEN,
    digits: int | None = None,
    out: str = "split",
) -> DataFrame:
    """SRT3 / SET4: adds ``out`` = 'train' for the first ``n*num//den`` rows in hash order, else 'val'.

    Disjoint and exhaustive by construction: one column, one predicate.  ``keys`` must be
    unique (a key held by many copies would also put all of them into one hash bucket).
    """
    return df.withColumn(out, split_rule(df, keys, seed, num, den, digits))


def hash_rank(
    df: DataFrame,
    keys: list[str],
    seed: int = DEFAULT_SEED,
    epoch=None,
    digits: int | None = None,
    out: str = "rank",
) -> DataFrame:
    """0-based rank by ``(order_hash(seed, [epoch,] keys), keys)``; ``digits=None`` -> ``auto_digits``."""
    digits = digits or auto_digits(df)
    hashed = df.withColumn("__h", order_hash(seed, *keys, epoch=epoch)).withColumn("__b", _bucket(F.col("__h"), digits))
    counts = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    # One row per non-empty bucket (<= 16^digits): a global window here is legitimate.
    offsets = counts.select(
        "__b",
        (F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).alias("__off"),
    ).fillna(0, ["__off"])
    w = Window.partitionBy("__b").orderBy("__h", *keys)
    return (
        hashed.join(F.broadcast(offsets), "__b")
        .withColumn(out, (F.col("__off") + F.row_number().over(w) - F.lit(1)).cast("long"))
        .drop("__h", "__b", "__off")
    )


RANGE_PARTITION_BYTES = 256 << 20
MAX_RANGE_PARTITIONS = 1 << 16


def _range_partitions(df: DataFrame) -> int:
    """At least ``spark.sql.shuffle.partitions``; more when the size estimate says so (~256 MB each)."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df)
    if size is None:
        return base
    return int(min(MAX_RANGE_PARTITIONS, max(base, -(-size // RANGE_PARTITION_BYTES))))


def ordered_rank(df: DataFrame, order: list[str], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """0-based rank in ``order`` (must be a unique key) via range partitioning and a written, sorted table.

    The rows are written first: the estimate of their size is that of a table then (an inner join's is the product
    of its sides), and the range bounds are found from it without the plan that made the rows.
    """
    df = materialize(df, "ordered")
    n_parts = partitions or _range_partitions(df)
    sorted_df = materialize(
        df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id()), "ordered-ids"
    )
    part = F.shiftright(F.col("__mid"), 33)
    counts = sorted_df.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.select(
        "__p",
        F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__off"),
    ).fillna(0, ["__off"])
    within = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        sorted_df.withColumn("__p", part)
        .join(F.broadcast(offsets), "__p")
        .withColumn(out, (F.col("__off") + within).cast("long"))
        .drop("__mid", "__p", "__off")
    )


def batch_ids(df: DataFrame, rank_col: str = "rank", batch_size: int = 32) -> DataFrame:
    """WIN4: ``batch_id = rank div batch_size``, ``pos_in_batch = rank mod batch_size``; last batch partial."""
    if not isinstance(batch_size, int) or batch_size <= 0:
        raise ValueError("batch_size must be a positive integer")
    return df.withColumn("batch_id", F.expr(f"`{rank_col}` div {batch_size}")).withColumn(
        "pos_in_batch", F.pmod(F.col(rank_col), F.lit(batch_size)).cast("int")
    )
