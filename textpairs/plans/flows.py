"""Composite entry points (PIP1-PIP3) and the shared stages of the query catalogue.

* ``prepare`` (PIP2): rows written once (all of them, or those within a length budget that
  the caller gives) -> exact 80/20 split -> vocabulary (built, loaded or given) -> hash
  ranks -> batch ids -> encode -> pad; test rows keep their key order.
  ``epoch_batches`` re-shuffles the training rows.
* ``evaluate_greedy`` (PIP3): first ``fraction`` of the batches -> caller's model
  (``batch_predict``) -> exact match -> accuracy (+ one example per batch).
* ``files.read_qa`` is PIP1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpairs.fixed import BATCH_SIZE
from textpairs.functions import arrays as A
from textpairs.operators import batching, clean, evaluate, rank, vocab
from textpairs.operators.pairing import pairs_in_rows, text_lines
from textpairs.session import materialize, read_table, scratch_path
from textpairs.sources import files, tables
from textpairs.streaming import ingest, pieces

KEYS = ["doc_id", "pair_idx"]
SEED = rank.DEFAULT_SEED


# ----------------------------------------------------------------------------- shared stages
def select_docs(spark: SparkSession, sf: str, folders=None, modules=None) -> DataFrame:
    """SRC2 / SRC3 on the table stand-in: filters reach the Parquet scan before pairing.

    Missing names are skipped; nothing left -> ValueError (as for folders / files).
    """
    docs = tables.documents(spark, sf)
    if folders:
        docs = docs.filter(F.col("folder").isin(list(folders)))
    if modules:
        docs = docs.filter(F.col("module").isin(list(modules)))
    if (folders or modules) and docs.isEmpty():
        raise ValueError(f"no documents for folders {folders} and modules {modules}")
    return pairs_in_rows(docs, "text", tables.DOC_KEYS)


def docs_vocab(spark: SparkSession, sf: str) -> vocab.Vocabulary:
    return vocab.Vocabulary.from_freq(vocab.char_freq(tables.qa_docs(spark, sf)))


def encoded_docs(spark: SparkSession, sf: str, voc: vocab.Vocabulary | None = None) -> DataFrame:
    return vocab.encode_columns(tables.qa_docs(spark, sf), voc or docs_vocab(spark, sf))


def pairs_split(spark: SparkSession, sf: str, question_limit: int | None = None, answer_limit: int | None = None) -> DataFrame:
    """All pairs (or those within the given limits), written once to the shared checkpoint
    folder, then split 80/20."""
    pairs = clean.within_budget_text(tables.qa_docs(spark, sf), question_limit=question_limit, answer_limit=answer_limit)
    return rank.exact_split(materialize(pairs, "pairs"), KEYS, seed=SEED)


def train_batches(spark: SparkSession, sf: str, epoch: int = 0, **limits) -> DataFrame:
    """Train rows with batch ids."""
    s = pairs_split(spark, sf, **limits).filter(F.col("split") == "train")
    return rank.batch_ids(rank.hash_rank(s, KEYS, seed=SEED, epoch=epoch), batch_size=BATCH_SIZE)


def val_batches(spark: SparkSession, sf: str, **limits) -> DataFrame:
    s = pairs_split(spark, sf, **limits).filter(F.col("split") == "val")
    return rank.batch_ids(rank.hash_rank(s, KEYS, seed=SEED), batch_size=BATCH_SIZE)


def echo_predictions(df: DataFrame, answers: str = "answers") -> DataFrame:
    """Deterministic stand-in predictions: the padded answer, junk (7) on its pad positions, and
    <unk> at the first character of rows whose md5 key starts with 0-4."""
    corrupt = F.substring(F.md5(F.concat_ws("|", F.lit("p"), F.col("doc_id").cast("string"), F.col("pair_idx").cast("string"))), 1, 1) < F.lit("5")
    pred = F.transform(
        answers,
        lambda x, i: F.when(x == F.lit(A.PAD), F.lit(7)).when((i == F.lit(1)) & corrupt, F.lit(A.UNK)).otherwise(x),
    )
    return df.withColumn("pred_ids", pred)


def val_matches(spark: SparkSession, sf: str, voc=None) -> DataFrame:
    b = batching.encode_batches(val_batches(spark, sf), voc or docs_vocab(spark, sf))
    return echo_predictions(b).withColumn("match", A.exact_match("answers", "pred_ids"))


# ----------------------------------------------------------------------------- derived files
DOCS_PER_FILE = 4000


def write_doc_files(spark: SparkSession, sf: str) -> str:
    """Writes the documents as module files: the lines of the documents of one (lang, source)
    and one range of ``DOCS_PER_FILE`` doc ids, in doc order, form one file
    ``<root>/folder=<lang>__<source>__<chunk>/part-*.txt``.  Returns ``<root>``.

    A file holds at most ``DOCS_PER_FILE`` documents whatever the number of groups, so a
    dominant (lang, source) is written by many tasks, never by one.
    """
    root = scratch_path(spark, "docfiles")
    docs = read_table(spark, sf, "documents")
    chunk = F.expr(f"doc_id div {DOCS_PER_FILE}").cast("string")
    lines = docs.select(
        F.concat_ws("__", "lang", "source", chunk).alias("folder"), "doc_id", F.posexplode(text_lines("text")).alias("ln", "value")
    )
    (
        lines.repartition("folder")
        .sortWithinPartitions("folder", "doc_id", "ln")
        .select("folder", "value")
        .write.partitionBy("folder")
        .text(root)
    )
    return root


PIECE_BYTES = 128 << 10


def write_doc_pieces(spark: SparkSession, sf: str) -> str:
    """The files of ``write_doc_files`` cut into numbered pieces, ``<root>/folder=<...>/module=<source>.txt/piece=<number>[-last]``;
    returns ``<root>``.

    A piece ends with the document that reaches the next multiple of ``PIECE_BYTES`` of its file, so there are at most as many
    pieces as the text has such multiples, and one more a file, however many documents there are.  Texts of one id are in one
    piece; a text without an id or source has no place in a file and is left out.
    """
    root = scratch_path(spark, "docpieces")
    docs = read_table(spark, sf, "documents").filter(F.size(text_lines("text")) > 0).filter("doc_id is not null and source is not null")
    docs = docs.select(
        F.concat_ws("__", "lang", "source", F.expr(f"doc_id div {DOCS_PER_FILE}").cast("string")).alias("folder"),
        F.concat("source", F.lit(".txt")).alias("module"),
        "doc_id",
        "text",
    )
    # one exchange: a file has at most DOCS_PER_FILE documents, and its directories are made by one task
    file = Window.partitionBy("folder", "module")
    docs = docs.repartition("folder").withColumn("upto", F.sum(F.octet_length("text").cast("long")).over(file.orderBy("doc_id")))  # with all texts of its id
    docs = docs.withColumn("cut", F.expr(f"(upto - 1) div {PIECE_BYTES}"))
    docs = docs.withColumn("number", F.dense_rank().over(file.orderBy("cut")) - 1).withColumn("most", F.max("number").over(file))
    piece = F.concat(F.col("number").cast("string"), F.when(F.col("number") == F.col("most"), F.lit("-last")).otherwise(F.lit("")))
    (
        docs.select("folder", "module", piece.alias("piece"), "doc_id", F.posexplode(text_lines("text")).alias("ln", "value"))
        .sortWithinPartitions("folder", "module", "piece", "doc_id", "ln")
        .select("folder", "module", "piece", "value")
        .write.partitionBy("folder", "module", "piece")
        .text(root)
    )
    return root


_FOLDER_RE = r"^folder=(.*)__(.*)__([0-9]+)$"


def with_lang_source(df: DataFrame) -> DataFrame:
    """Recover (lang, source, chunk) from the ``folder=<lang>__<source>__<chunk>`` directory name."""
    return (
        df.withColumn("lang", F.regexp_extract("folder", _FOLDER_RE, 1))
        .withColumn("source", F.regexp_extract("folder", _FOLDER_RE, 2))
        .withColumn("chunk", F.regexp_extract("folder", _FOLDER_RE, 3).cast("long"))
    )


def stream_ingest(spark: SparkSession, root: str, voc: vocab.Vocabulary) -> tuple[DataFrame, DataFrame]:
    """STR1 over ``root``: availableNow run into two Parquet tables; returns (pairs, odd tails)."""
    out = scratch_path(spark, "stream-out")
    ck = scratch_path(spark, "stream-ckpt")
    ingest.run_available(ingest.stream_files(spark, root.rstrip("/") + "/*/*"), voc, out, ck)
    return tuple(ingest.read_stream_output(spark, out, name) for name in ("pairs", "unpaired"))


def stream_pieces(spark: SparkSession, root: str, voc: vocab.Vocabulary) -> tuple[DataFrame, DataFrame]:
    """STR1 over the pieces of ``write_doc_pieces``; returns (pairs, odd tails)."""
    out = scratch_path(spark, "pieces-out")
    ck = scratch_path(spark, "pieces-ckpt")
    pieces.run_pieces(pieces.stream_pieces(spark, root.rstrip("/") + "/*/*/*/*", pieces.BATCH_PIECES), voc, out, ck)
    return tuple(ingest.read_stream_output(spark, out, name) for name in ("pairs", "unpaired"))


def stream_listed(spark: SparkSession, root: str, voc: vocab.Vocabulary, **options) -> DataFrame:
    """STR1 over whole files by their listing; returns the pairs."""
    out = scratch_path(spark, "listed-out")
    ck = scratch_path(spark, "listed-ckpt")
    pieces.run_listed(pieces.stream_listing(spark, root.rstrip("/") + "/*/*"), voc, out, ck, **options)
    return ingest.read_stream_output(spark, out, "pairs")


# ----------------------------------------------------------------------------- PIP2 / PIP3
def prepare(
    train_df: DataFrame,
    test_df: DataFrame | None,
    keys: list[str],
    test_keys: list[str] | None = None,
    vocab_df: DataFrame | None = None,
    batch_size: int = BATCH_SIZE,
    seed: int = SEED,
    epoch: int = 0,
    fit_on: str = "train+val",
    strict: bool = True,
    save_path: str | None = None,
    load_path: str | None = None,
    question_limit: int | None = None,
    answer_limit: int | None = None,
    written: bool = False,
) -> dict:
    """PIP2: ``{"vocab", "vocabulary", "split", "train", "val", "test", "dropped", "cache"}``; batches padded and keyed.

    The vocabulary is built on train+validation rows, or on the rows of the one 80/20 split that
    are "train" with ``fit_on="train"``; a given ``vocab_df`` is used as is.  With
    ``save_path`` the vocabulary and the encoded tables (with the vocabulary's fingerprint) are
    written there, each row with a fingerprint of its texts; with only ``load_path`` both are read from there (save
    wins when both are given).  No row depends on the cache: one whose texts the cache has is taken from there, one that
    changed or is new is encoded, and ``cache`` has the number of each by table (a lazy frame).  One of the three sources
    of a vocabulary must be named.  Test rows use the same vocabulary and keep their key order.

    Every row is kept unless ``question_limit`` / ``answer_limit`` (numbers of ids) are given;
    ``dropped`` is the number of train and test rows beyond them.

    ``written`` says that the frames are rows of written tables, the same in every job, so that they are not written once more;
    the strict checks ride on that write, so they still make it.
    """
    if vocab_df is None and not (save_path or load_path):
        raise ValueError("prepare needs save_path (build and keep a vocabulary), load_path (use a kept one) or vocab_df")
    spark = train_df.sparkSession
    clean.require_columns(train_df, ["question", "answer", *keys])
    enc_cols = ("question", "answer")
    tk = test_keys or keys
    if strict and test_df is not None:
        clean.require_columns(test_df, ["question", "answer", *tk])
    limits = {"question_limit": question_limit, "answer_limit": answer_limit}
    limited = question_limit is not None or answer_limit is not None

    def stored(df, what, name):
        """The rows within the limits, written once; FLT2 / FLT5: no row or a null text is an error, seen by that same write."""
        if not strict:
            rows = clean.within_budget_text(df, **limits)
            return rows if written else materialize(rows, name)
        df, seen = clean.observed(df, enc_cols)
        kept = materialize(clean.within_budget_text(df, **limits), name)
        clean.require_observed(seen, what, enc_cols)
        return kept

    dropped = sum(df.filter(~clean.within_budget_condition(**limits)).count() for df in (train_df, test_df) if limited and df is not None)
    # written once: the split's count jobs and the ranks reuse it
    kept = stored(train_df, "training", "prepare-train")
    te = None if test_df is None else stored(test_df, "test", "prepare-test")
    rule = rank.split_rule(kept, keys, seed=seed)
    split = kept.withColumn("split", rule)
    loading = vocab_df is None and load_path and not save_path
    if loading:
        vocab_df = files.read_vocab(spark, load_path.rstrip("/") + "/vocab")
    built = vocab_df is None
    if built:  # counted once, by the write
        files.write_vocab(vocab.build_vocab(split.filter(F.col("split") == "train") if fit_on == "train" else kept), save_path.rstrip("/") + "/vocab")
        vocab_df = files.read_vocab(spark, save_path.rstrip("/") + "/vocab")
    voc = vocab.Vocabulary.from_df(vocab_df)
    if save_path and not built:
        files.write_vocab(vocab_df, save_path.rstrip("/") + "/vocab")
    cache = (save_path or (load_path if loading else None) or "").rstrip("/")

    reports = []

    def encoded(df, name, key_cols):
        """The encoded table (written first when saving); None without a cache."""
        if not cache:
            return None
        path = f"{cache}/encoded_{name}"
        if save_path:
            ids = vocab.encode_columns(df, voc, enc_cols).withColumn(files.ROW_FP, files.row_fingerprint(enc_cols))
            files.write_encoded(ids.select(*key_cols, *[f"{c}_ids" for c in enc_cols], files.ROW_FP), path, voc.fingerprint)
        table = files.read_encoded(spark, path, voc.fingerprint)
        states = files.reuse_encoded(df, table, key_cols, voc, enc_cols)
        reports.append(files.cache_report(states, table, key_cols).select(F.lit(name).alias("table"), "state", "rows"))
        return table

    def batches(ranked, table, key_cols):
        ranked = rank.batch_ids(ranked, batch_size=batch_size)
        if table is None:
            return batching.encode_batches(ranked, voc, enc_cols)
        # rows are ranked by their texts' table, and take their ids from the cache only then
        return batching.make_packed_batches(files.reuse_packed(ranked, table, key_cols, voc, enc_cols).drop("cached_state"), voc, enc_cols)

    def part(name):
        rows = rank.hash_rank(split.filter(F.col("split") == name), keys, seed=seed, epoch=epoch if name == "train" else None)
        # rows of equal keys are in one part, so only that part of the cache is read
        return batches(rows, None if table is None else table.filter(rule == name), keys)

    table = encoded(split, "train", keys)
    out = {
        "vocab": vocab_df,
        "vocabulary": voc,
        "split": split,
        "dropped": dropped,
        "train": part("train"),
        "val": part("val"),
        "test": None,
    }
    if test_df is not None:
        test_table = encoded(te, "test", tk)
        out["test"] = batches(rank.ordered_rank(te, tk), test_table, tk)  # written inside
    out["cache"] = reports[0] if len(reports) == 1 else reports[0].unionByName(reports[1]) if reports else None
    return out


def epoch_batches(prepared: dict, keys: list[str], epoch: int, seed: int = SEED, batch_size: int = BATCH_SIZE) -> DataFrame:
    """SRT4: the training batches of another epoch - a new hash order over the same split,
    padded and encoded."""
    tr = prepared["split"].filter(F.col("split") == "train")
    ranked = rank.batch_ids(rank.hash_rank(tr, keys, seed=seed, epoch=epoch), batch_size=batch_size)
    return batching.encode_batches(ranked, prepared["vocabulary"])


def decode_batches(batches: DataFrame, keys: list[str], model, question: str = "question") -> DataFrame:
    """PIP3 with generation: ``batches`` with ``pred_ids`` of a ``decode.CountedModel`` and ``match``; a prediction has as many
    ids as the padded answer."""
    rows = batches.select(*keys, F.col(question).alias("question"), F.size("answers").alias("max_len"))
    return evaluate.match_predictions(batches, model.decode(rows, keys), keys)


def evaluate_greedy(batches: DataFrame, keys: list[str], make_predictor, fraction: float, voc: vocab.Vocabulary | None = None) -> dict:
    """PIP3: accuracy over the first ``int(n_batches * fraction)`` batches + one example per batch.

    ``make_predictor() -> predict(question_id_arrays, max_lens)``; ``max_len`` is the padded
    answer length, and a model gives exactly that many ids.  ``batches`` is read three times (batch
    count, model, scoring): pass a written table.
    """
    kept, n_batches, k = evaluate.first_batches(batches, fraction)
    kept = kept.withColumn("max_len", F.size("answers"))
    preds = evaluate.batch_predict(kept, make_predictor, keys, ids_col="questions", max_len_col="max_len")
    matched = evaluate.match_predictions(kept, preds, keys)
    result = {"n_batches": n_batches, "used_batches": k, "accuracy": evaluate.accuracy(matched), "matches": matched}
    ex = evaluate.batch_examples(matched)
    if voc is not None:
        ex = ex.select(
            *keys,
            "batch_id",
            voc.decode("questions").alias("question_text"),
            voc.decode("answers").alias("answer_text"),
            voc.decode("pred_ids").alias("predicted_text"),
        )
    result["examples"] = ex
    return result
