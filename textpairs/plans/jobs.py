"""Batch jobs for a cluster: ``python -m textpairs.plans.jobs <step> ...`` (or spark-submit).

Steps read and write Parquet tables so that each one can run, fail and be re-run on its
own; the session comes from the environment (``spark-submit`` / cluster defaults) and
scratch data goes to its ``spark.checkpoint.dir``.

* ``ingest``  - module files under ``--input`` -> pairs table (+ unpaired lines, ingest report)
* ``stream``  - new files, or new pieces of files, under the glob ``--input`` -> encoded pairs and odd tails, batch by batch
* ``profile`` - pairs table -> length statistics, histograms, box statistics, value counts
* ``prepare`` - pairs table -> vocabulary, train / val batches (padded ids), test batches
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Observation, SparkSession

from textpairs.operators import clean, profile
from textpairs.operators.vocab import Vocabulary
from textpairs.plans import flows
from textpairs.session import drop_scratch, scratch_mark
from textpairs.sources import files
from textpairs.streaming import pieces


log = logging.getLogger(__name__)


def _session() -> SparkSession:
    return SparkSession.builder.appName("textpairs").getOrCreate()


def ingest(spark: SparkSession, inp: str, out: str, folders=None, modules=None, cap: int | None = None, on_unpaired: str = "quarantine") -> None:
    pairs, unpaired, listing = files.read_qa(spark, inp, folders=folders, files=modules, samples_per_module=cap, on_unpaired=on_unpaired)
    seen = Observation()
    files.write_split(pairs, f"{out}/pairs", "folder", watch=lambda df: clean.observed(df, seen=seen)[0])  # folder names stay text
    clean.require_observed(seen, "ingested")  # FLT2 / FLT5, seen by the write itself
    unpaired.write.mode("overwrite").parquet(f"{out}/unpaired")
    report = files.ingest_report(files.read_split_table(spark, f"{out}/pairs"), files.listed_files(spark, listing))
    report.write.mode("overwrite").parquet(f"{out}/report")


def stream(spark: SparkSession, inp: str, out: str, voc: str, checkpoint: str, in_pieces: bool = False, cap: int | None = None, max_files: int | None = None) -> None:
    """One run over what is new since the last one; ``inp`` is a glob of files, or of the pieces of files."""
    vocabulary = Vocabulary.from_df(files.read_vocab(spark, voc))
    if in_pieces:
        pieces.run_pieces(pieces.stream_pieces(spark, inp, max_files), vocabulary, out, checkpoint, cap=cap)
    else:
        pieces.run_listed(pieces.stream_listing(spark, inp, max_files), vocabulary, out, checkpoint, cap=cap)


def profile_pairs(spark: SparkSession, inp: str, out: str, approx: bool = False) -> None:
    pairs = spark.read.parquet(inp)
    clean.require_columns(pairs, ["question", "answer", "folder", "module"])  # FLT1
    clean.require_nonempty(pairs, "pairs", strict=False)  # FLT2: a warning, as when profiling
    profile.length_stats(pairs, approx=approx).write.mode("overwrite").parquet(f"{out}/length_stats")
    profile.length_hist(pairs).write.mode("overwrite").parquet(f"{out}/length_hist")
    profile.box_stats(pairs, "question", "folder", approx=approx).write.mode("overwrite").parquet(f"{out}/box_question")
    profile.box_stats(pairs, "answer", "folder", approx=approx).write.mode("overwrite").parquet(f"{out}/box_answer")
    for c in ("folder", "module"):
        profile.value_counts(pairs, c).write.mode("overwrite").parquet(f"{out}/counts_{c}")


def prepare(spark: SparkSession, inp: str, out: str, test: str | None = None, batch_size: int = flows.BATCH_SIZE, seed: int = flows.SEED, question_limit: int | None = None, answer_limit: int | None = None) -> None:
    keys = ["file", "pair_idx"]
    train = spark.read.parquet(inp)
    test_df = spark.read.parquet(test) if test else None
    prep = flows.prepare(train, test_df, keys=keys, batch_size=batch_size, seed=seed, save_path=out, question_limit=question_limit, answer_limit=answer_limit)
    if prep["dropped"]:
        log.warning("%d rows are beyond the length limits and left out", prep["dropped"])
    for name in ("train", "val", "test"):
        if prep[name] is not None:
            prep[name].write.mode("overwrite").parquet(f"{out}/batches_{name}")


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="textpairs")
    sub = ap.add_subparsers(dest="step", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--folders", nargs="*")
    a.add_argument("--files", nargs="*")
    a.add_argument("--samples-per-module", type=int, help="pairs to take of each file (default: all)")
    a.add_argument("--on-unpaired", default="quarantine")
    d = sub.add_parser("stream")
    for name in ("--input", "--output", "--vocab", "--checkpoint"):
        d.add_argument(name, required=True)
    d.add_argument("--pieces", action="store_true", help="the files come as numbered pieces, the last one marked -last")
    d.add_argument("--samples-per-module", type=int)
    d.add_argument("--max-files", type=int, help="files (pieces) of one micro-batch")
    b = sub.add_parser("profile")
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--approx", action="store_true")
    c = sub.add_parser("prepare")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--test")
    c.add_argument("--batch-size", type=int, default=flows.BATCH_SIZE)
    c.add_argument("--seed", type=int, default=flows.SEED)
    c.add_argument("--question-limit", type=int, help="leave out questions of more ids (default: none)")
    c.add_argument("--answer-limit", type=int)
    args = ap.parse_args(argv)
    spark = _session()
    mark = scratch_mark()
    if args.step == "ingest":
        ingest(spark, args.input, args.output, args.folders, args.files, args.samples_per_module, args.on_unpaired)
    elif args.step == "stream":
        stream(spark, args.input, args.output, args.vocab, args.checkpoint, args.pieces, args.samples_per_module, args.max_files)
    elif args.step == "profile":
        profile_pairs(spark, args.input, args.output, args.approx)
    else:
        prepare(spark, args.input, args.output, args.test, args.batch_size, args.seed, args.question_limit, args.answer_limit)
    # outputs are written: the step's intermediate tables are no longer read
    drop_scratch(spark, since=mark)


if __name__ == "__main__":
    main()
