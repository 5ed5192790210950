"""Training epochs over a bucketed table (WIN4, SRT4, AGG10, FUN6): the rows are shuffled once, when they are stored.

A *shard* is a run of ``shard_batches`` whole batches of the first epoch's hash order, so a row's shard is as random as
its rank.  The rows are stored bucketed by shard.  An epoch puts the rows of each shard into a new hash order and cuts it into
batches: every batch is full but the last one of the last shard, and epoch 0 has the very batches of ``rank.hash_rank``.
Both windows (order inside the shard, widest row of the batch) are clustered by the bucketing column, so neither an epoch nor its
padding exchanges a row.  A window's partition holds at most ``batch_size * shard_batches`` rows.

What it gives up: a row changes its batch within its shard only.  ``flows.epoch_batches`` shuffles over all rows, at the
price of an exchange of the text in every epoch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpairs.fixed import BATCH_SIZE
from textpairs.operators import batching, rank
from textpairs.operators.vocab import Vocabulary, encode_columns
from textpairs.session import estimated_bytes

SHARD_BATCHES = 64
BUCKET_BYTES = 256 << 20
MAX_BUCKETS = 1 << 16


def bucket_number(df: DataFrame) -> int:
    """At least ``spark.sql.shuffle.partitions``; more when the size estimate says so (~256 MB each)."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(MAX_BUCKETS, max(base, -(-(estimated_bytes(df) or 0) // BUCKET_BYTES))))


def write_shards(
    rows: DataFrame,
    keys: list[str],
    vocab: Vocabulary,
    path: str,
    seed: int = rank.DEFAULT_SEED,
    batch_size: int = BATCH_SIZE,
    shard_batches: int = SHARD_BATCHES,
    buckets: int | None = None,
    text_cols=("question", "answer"),
) -> DataFrame:
    """Stores ``rows`` with ids and ``shard`` below ``path``, bucketed by shard, and returns the table; ``keys`` must be unique.

    The exchanges carry text; ids are made behind them.  One task writes a bucket, so a bucket is one file.  The
    table has a name of its own in the session's catalog; the rows lie in ``path``.
    """
    if shard_batches <= 0:
        raise ValueError("shard_batches must be a positive integer")
    spark = rows.sparkSession
    buckets = buckets or bucket_number(rows)
    ranked = rank.hash_rank(rows, keys, seed=seed, epoch=0)
    sharded = ranked.withColumn("shard", F.expr(f"`rank` div {batch_size * shard_batches}")).drop("rank").repartition(buckets, "shard")
    name = f"shards_{uuid.uuid4().hex[:12]}"
    encoded = encode_columns(sharded, vocab, text_cols)
    encoded.write.bucketBy(buckets, "shard").sortBy("shard").format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def shard_epoch(shards: DataFrame, keys: list[str], epoch: int, seed: int = rank.DEFAULT_SEED, batch_size: int = BATCH_SIZE, shard_batches: int = SHARD_BATCHES) -> DataFrame:
    """``shards`` with ``batch_id`` and ``pos_in_batch`` of an epoch; no exchange."""
    order = Window.partitionBy("shard").orderBy("__h", *keys)
    at = shards.withColumn("__h", rank.order_hash(seed, *keys, epoch=epoch)).withColumn("__at", F.row_number().over(order) - 1)
    return (
        at.withColumn("batch_id", F.col("shard") * shard_batches + F.expr(f"`__at` div {batch_size}"))
        .withColumn("pos_in_batch", F.pmod("__at", F.lit(batch_size)).cast("int"))
        .drop("__h", "__at")
    )


def epoch_padded(shards: DataFrame, keys: list[str], epoch: int, **sizes) -> DataFrame:
    """The padded batches of an epoch (``batching.make_batches``); no exchange."""
    return batching.make_batches(shard_epoch(shards, keys, epoch, **sizes), batch_keys=("shard", "batch_id"))
