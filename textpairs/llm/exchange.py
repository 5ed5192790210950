"""Questions from chunks of documents to hash buckets and answers back, in packed arrays.

A *chunk* is a run of documents that one task has read, written as one row of a table.  It asks
about its own distinct 64-bit keys; the buckets cut the range of keys.  Each bucket gets at most one
row from each chunk, however often a key occurs in it (so a key that a third of all documents
share costs one entry a chunk), and answers each chunk in the order of its question.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.session import materialize

#: text bytes that one bucket stands for
BUCKET_BYTES = 12 << 20
#: text bytes of one chunk
CHUNK_BYTES = 4 << 20

ASK = "chunk long, bucket long, keys binary, vals binary"


def bucket_count(text_bytes: int) -> int:
    """A power of two, in proportion to the text."""
    return 1 << max(2, int(np.ceil(np.log2(max(1, text_bytes) / BUCKET_BYTES))))


def total_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts: one aggregate over the text column."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's run begins (and the last ends) in sorted uint64 keys."""
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    return np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))


def chunk_number(partition: int, sequence: int) -> int:
    return (partition << 24) + sequence


def answers(asks: DataFrame, answer, extra: str = "", n: int | None = None) -> DataFrame:
    """``answer(keys, vals) -> (bytes of answers, extra values)`` once for each bucket.

    ``keys``: a list of uint64 arrays, ``vals``: a list of bytes, one for each asking chunk; it returns a
    list of bytes in the same order and a dict of lists for the ``extra`` columns, one value a chunk.
    """
    schema = "chunk long, bucket long, answer binary" + (", " + extra if extra else "")

    def one(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in table["keys"]]
        vals = [x.as_py() for x in table["vals"]]
        got, more = answer(keys, vals)
        out = {"chunk": table["chunk"].combine_chunks(), "bucket": table["bucket"].combine_chunks(), "answer": pa.array(got, pa.binary())}
        return pa.table(out | more)

    asks = asks.repartition(n, "bucket") if n else asks
    return asks.groupBy("bucket").applyInArrow(one, schema)


def joined(table: pa.Table, column: str = "answer") -> bytes:
    """A chunk's answers put together in the order of the buckets."""
    order = np.argsort(table["bucket"].to_numpy())
    return b"".join(table[column][int(i)].as_py() for i in order)


#: numbers that keys are put into to tell texts that need a join from those that do not
GROUPS = 1 << 24
#: groups that one broadcast row has as the bits of a number
GROUP_BITS = 64


def split_by_key(docs: DataFrame, keys: DataFrame, doc_key: str | list[str], key: str | list[str], salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` whose key may be among ``keys``, rows whose key surely is not), without a shuffle of ``docs``.

    A key is one column or several, of the same types on both sides; two nulls are alike.  What is broadcast are at most
    ``GROUPS / GROUP_BITS`` rows, whatever the size of ``keys``.  Another ``salt`` makes other groups.
    """
    group = lambda c: F.pmod(F.xxhash64(F.lit(salt), *([c] if isinstance(c, str) else c)), F.lit(GROUPS))
    word, bit = F.floor(F.col("__g") / GROUP_BITS), F.expr(f"cast(__g % {GROUP_BITS} as int)")
    groups = keys.select(group(key).alias("__g")).groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    marked = docs.withColumn("__g", group(doc_key)).join(F.broadcast(groups), word == F.col("__word"), "left")
    there = F.coalesce(F.getbit("__bits", bit), F.lit(0)) == 1
    return tuple(marked.filter(x).drop("__g", "__word", "__bits") for x in (there, ~there))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``gone(id, tkey)`` does not name; tkey is the text's xxhash64.

    Texts of rows that go are not shuffled: ``maybe`` is first looked up without them, for the rows that only share a group.
    """
    gone = materialize(gone.select(F.col("id").cast("long").alias("__id"), F.col("tkey").alias("__key")).distinct(), "gone")
    docs = docs.withColumn("__tid", F.col(id_col).cast("long")).withColumn("__tkey", F.xxhash64(text_col))
    maybe, rest = split_by_key(docs, gone, ["__tid", "__tkey"], ["__id", "__key"])
    on = F.col("__tid").eqNullSafe(F.col("__id")) & (F.col("__tkey") == F.col("__key"))
    stay = maybe.select("__tid", "__tkey").distinct().join(gone, on, "left_anti")
    stay = materialize(stay.select(F.col("__tid").alias("__id"), F.col("__tkey").alias("__key")), "stay")
    maybe, _ = split_by_key(maybe, stay, ["__tid", "__tkey"], ["__id", "__key"], salt=1)
    kept = maybe.join(stay, on, "left_semi")
    return kept.unionByName(rest).drop("__tid", "__tkey")


#: texts are long, so fewer rows go to a Python worker at once than Spark's 10,000
ARROW_ROWS = 2000


def small_batches(spark) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
