"""Incremental ingest + encode of newly arriving module files (STR1).

Each new file is read whole (``wholetext=True``, passed as an argument - the option
form is silently overridden) and paired inside its row, so the query is stateless:
no watermark, no state store.  Every micro-batch writes its pairs (encoded against
a fixed vocabulary) and its odd tails to two Parquet tables, each into a directory named by
the batch id that a re-run replaces; so a restarted query neither loses nor doubles a file.
Files of any suffix are read, as in the batch reader.  Here one file must fit one row; larger ones
come through ``streaming.pieces``, cut into pieces or by their listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.functions.text import decode_uri_path, drop_last4, parent_name
from textpairs.operators.pairing import pairs_in_rows, unpaired_in_rows
from textpairs.operators.vocab import Vocabulary
from textpairs.session import few_listing_tasks
from textpairs.sources.files import FILE_KEYS, without_mark


def stream_files(spark: SparkSession, root_glob: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (file, folder, module, text) of ``<root>/<folder>/<file>``, e.g. ``<root>/*/*``."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    with few_listing_tasks(spark):
        raw = reader.text(root_glob, wholetext=True)
    path = decode_uri_path(F.col("_metadata.file_path"))
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        parent_name(path).alias("folder"),
        drop_last4(F.element_at(F.split(path, "/"), -1)).alias("module"),
        without_mark("value").alias("text"),
    )


def stream_pairs(spark: SparkSession, root_glob: str, cap: int | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (file, folder, module, pair_idx, question, answer)."""
    return pairs_in_rows(stream_files(spark, root_glob, max_files_per_trigger), "text", FILE_KEYS, cap=cap)


def encode_stream(pairs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Stream-static encode with the fixed vocabulary (OOV -> <unk>)."""
    return pairs.withColumn("question_ids", vocab.encode("question")).withColumn("answer_ids", vocab.encode("answer"))


def await_available(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> None:
    """Runs ``write(batch, batch_id)`` over all that is there now; an error of the query is raised here."""
    with few_listing_tasks(stream.sparkSession):
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_available(texts: DataFrame, vocab: Vocabulary, out_path: str, checkpoint: str, cap: int | None = None) -> None:
    """Process every file that is there now (``availableNow``) into ``<out>/pairs`` and ``<out>/unpaired``, then stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        pairs = encode_stream(pairs_in_rows(batch, "text", FILE_KEYS, cap=cap), vocab)
        tails = unpaired_in_rows(batch, "text", FILE_KEYS, cap=cap)
        for name, df in (("pairs", pairs), ("unpaired", tails)):
            df.write.mode("overwrite").parquet(f"{out_path}/{name}/batch={batch_id}")

    await_available(texts, write, checkpoint)


def read_stream_output(spark: SparkSession, out_path: str, name: str) -> DataFrame:
    """``pairs`` or ``unpaired`` of all batches so far."""
    return spark.read.parquet(f"{out_path}/{name}").drop("batch")
