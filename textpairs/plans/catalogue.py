"""The query catalogue: one Spark plan per operator id, over the driver's tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the *whole*
tables; the matching DuckDB SQL lives in ``plans.oracle_sql``.  Shared stages
(pairs, vocabulary, encoded pairs, split, batches) are built by the helpers below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textpairs.functions import arrays as A
from textpairs.operators import batching, clean, decode, evaluate, profile, rank, shards, vectors, vocab
from textpairs.plans import flows
from textpairs.session import materialize, read_table, scratch_path
from textpairs.sources import files, tables

KEYS = ["doc_id", "pair_idx"]
QA_OUT = ["doc_id", "folder", "module", "pair_idx", "question", "answer"]
SEED = rank.DEFAULT_SEED
FLOAT_DIGITS = 6


def _round_arr(c):
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: F.round(x, FLOAT_DIGITS))


# ----------------------------------------------------------------------------- sources / pairing
def q_qa_pairs(spark, sf):
    return tables.qa_docs(spark, sf).select(*QA_OUT)


def q_qa_capped(spark, sf):
    return tables.qa_docs(spark, sf, cap=3).select(*QA_OUT)


def q_qa_unpaired(spark, sf):
    return tables.qa_docs_unpaired(spark, sf)


def q_qa_conv(spark, sf):
    return tables.qa_conv(spark, sf)


def q_qa_conv_unanswered(spark, sf):
    return tables.qa_conv_unanswered(spark, sf)


def q_folder_selected(spark, sf):
    return flows.select_docs(spark, sf, folders=["en", "fr", "xx"]).select(*QA_OUT)


def q_file_selected(spark, sf):
    return flows.select_docs(spark, sf, modules=["src1", "src7", "nope"]).select(*QA_OUT)


def q_ingest_report(spark, sf):
    p = tables.qa_docs(spark, sf).withColumnRenamed("doc_id", "file")
    listed = read_table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.col("lang").alias("folder"), F.col("source").alias("module"))
    return files.ingest_report(p, listed)


def q_null_report(spark, sf):
    return clean.null_report(tables.qa_docs(spark, sf)).select("n_rows", "null_question", "null_answer")


def _split_roundtrip(spark, sf, key):
    p = tables.qa_docs(spark, sf).select(key, *KEYS, "question", "answer")
    path = scratch_path(spark, f"split-{key}")
    files.write_split(p, path, key)
    return files.read_split_table(spark, path).select(F.col(key).alias("split_key"), *KEYS, "question", "answer")


def _all_parts(parts, *cols):
    """The named frames of a split, one after another, with their name."""
    out = None
    for k, df in parts.items():
        df = df.select(F.lit(k).cast("string").alias("split_key"), *cols)
        out = df if out is None else out.unionByName(df)
    return out


def q_split_by_folder(spark, sf):
    """FLT3 / FLT4 on the frame itself: one filter per key."""
    return _all_parts(clean.split_by(tables.qa_docs(spark, sf), "folder"), *KEYS, "question", "answer")


def _odd_keys(spark, sf):
    """Pairs under keys that look alike once types are inferred or blanks are trimmed."""
    keys = F.array(*[F.lit(x) for x in ("", "7", "07", "007", "a b", "x/y=z%", "null")], F.lit(None).cast("string"))
    return tables.qa_docs(spark, sf).select(
        F.element_at(keys, (F.pmod("doc_id", F.lit(8)) + 1).cast("int")).alias("key"),
        *KEYS,
        F.concat(F.lit(" "), "question", F.lit(" ")).alias("question"),
        F.concat(F.lit("\x01"), "answer", F.lit("\x02")).alias("answer"),
    )


def q_split_odd_keys(spark, sf):
    """SNK5 per key: every named frame of the read side."""
    path = scratch_path(spark, "split-odd")
    files.write_split(_odd_keys(spark, sf), path, "key")
    return _all_parts(files.read_split(spark, path, "key"), "key", *KEYS, "question", "answer")


def q_csv_odd_cells(spark, sf):
    """SNK1 / SRC9: blanks and control characters at both ends, empty and null keys."""
    path = scratch_path(spark, "csv-odd")
    files.write_csv(_odd_keys(spark, sf), path)
    back = files.read_csv(spark, path)
    return back.select("key", F.col("doc_id").cast("long").alias("doc_id"), F.col("pair_idx").cast("long").alias("pair_idx"), "question", "answer")


def q_qa_only(spark, sf):
    """PRJ1."""
    return clean.qa_only(tables.qa_docs(spark, sf))


def q_checked(spark, sf):
    """FLT1 + FLT2: the checks that run before a frame is used, then its size."""
    p = tables.qa_docs(spark, sf)
    clean.require_columns(p, ["question", "answer", "folder", "module"])
    return p.select(F.lit(clean.require_nonempty(p)).alias("has_rows")).groupBy("has_rows").agg(F.count(F.lit(1)).alias("n_rows"))


def q_ingest_observed(spark, sf):
    """FLT2 + FLT5 + SRC8: whether files gave rows and null texts, as the write of their pairs saw it; no job of its own."""
    pairs, _unpaired, _listing = files.read_qa(spark, flows.write_doc_files(spark, sf))
    seen = Observation()
    files.write_split(pairs, scratch_path(spark, "observed"), "folder", watch=lambda df: clean.observed(df, seen=seen)[0])
    clean.require_observed(seen, "ingested")
    got = {k: v > 0 for k, v in seen.get.items()}
    return spark.createDataFrame([(got["n_rows"], got["null_question"], got["null_answer"])], "has_rows boolean, null_question boolean, null_answer boolean")


def q_split_folder(spark, sf):
    return _split_roundtrip(spark, sf, "folder")


def q_split_module(spark, sf):
    return _split_roundtrip(spark, sf, "module")


def q_file_source(spark, sf):
    root = flows.write_doc_files(spark, sf)
    pairs, _unpaired, _listing = files.read_qa(spark, root)
    return flows.with_lang_source(pairs).select("lang", "source", "chunk", "pair_idx", "question", "answer")


_FILE_OUT = ("lang", "source", "chunk", "pair_idx", "question", "answer")


def q_folder_files_selected(spark, sf):
    """SRC2 / JOI4 over written files: the folders of two languages (and one that is not there) by a semi-join of the listing."""
    listed = files.file_table(spark, flows.write_doc_files(spark, sf))
    wanted = flows.with_lang_source(listed).filter(F.col("lang").isin("en", "fr", "xx")).select("folder")
    pairs, _ = files.read_selected(spark, files.select_files(listed, folders=wanted))
    return flows.with_lang_source(pairs).select(*_FILE_OUT)


def q_module_files_selected(spark, sf):
    """SRC3 / JOI4 over written files: certain files of certain folders, read through the path for large files."""
    listed = files.file_table(spark, flows.write_doc_files(spark, sf))
    wanted = flows.with_lang_source(listed).filter(F.col("source").isin("src1", "src7", "nope")).select("folder", "name")
    pairs, _ = files.read_selected(spark, files.select_files(listed, names=wanted), whole_file_bytes=-1)
    return flows.with_lang_source(pairs).select(*_FILE_OUT)


def q_listed_files(spark, sf):
    """SRC2 / SRC3: files of each language and source, from the listing alone."""
    listed = flows.with_lang_source(files.file_table(spark, flows.write_doc_files(spark, sf)))
    return listed.groupBy("lang", "source").agg(F.count_distinct("folder").alias("folders"))


def q_split_rerun(spark, sf):
    """SNK5: one folder written, then the others, then the first again: every pair once."""
    pairs, path = materialize(tables.qa_docs(spark, sf), "rerun"), scratch_path(spark, "rerun-split")
    for part in (pairs.filter("folder = 'en'"), pairs.filter("folder <> 'en'"), pairs.filter("folder = 'en'")):
        files.write_split(part, path, "folder", only_keys=True)
    return files.read_split_table(spark, path).select(*QA_OUT)


def q_file_source_lines(spark, sf):
    """Same files and result as ``file_source``, forced through the numbered-line path (H1)."""
    root = flows.write_doc_files(spark, sf)
    pairs, _unpaired, _listing = files.read_qa(spark, root, whole_file_bytes=-1)
    return flows.with_lang_source(pairs).select("lang", "source", "chunk", "pair_idx", "question", "answer")


def q_stream_ingest(spark, sf):
    root = flows.write_doc_files(spark, sf)
    voc = flows.docs_vocab(spark, sf)
    out, _tails = flows.stream_ingest(spark, root, voc)
    return flows.with_lang_source(out).select("lang", "source", "chunk", "pair_idx", "question", "answer", "question_ids", "answer_ids")


def q_stream_unpaired(spark, sf):
    """SRC6 in the stream: the odd tails of the same files."""
    root = flows.write_doc_files(spark, sf)
    _pairs, tails = flows.stream_ingest(spark, root, flows.docs_vocab(spark, sf))
    return flows.with_lang_source(tails).select("lang", "source", "chunk", "ln", "text")


_STREAM_OUT = (*_FILE_OUT, "question_ids", "answer_ids")


def _pieces_as_files(df):
    """The file's folder is the one above ``module=<source>.txt``."""
    return flows.with_lang_source(df.withColumn("folder", F.element_at(F.split("file", "/"), -2)))


def q_stream_pieces(spark, sf):
    """STR1 on the same files cut into pieces: the same pairs and ids."""
    pairs, _tails = flows.stream_pieces(spark, flows.write_doc_pieces(spark, sf), flows.docs_vocab(spark, sf))
    return _pieces_as_files(pairs).select(*_STREAM_OUT)


def q_stream_pieces_unpaired(spark, sf):
    """SRC6 on the same files cut into pieces."""
    _pairs, tails = flows.stream_pieces(spark, flows.write_doc_pieces(spark, sf), flows.docs_vocab(spark, sf))
    return _pieces_as_files(tails).select("lang", "source", "chunk", "ln", "text")


def q_stream_listed(spark, sf):
    """STR1 on whole files by their listing, through the path for files larger than a row."""
    pairs = flows.stream_listed(spark, flows.write_doc_files(spark, sf), flows.docs_vocab(spark, sf), whole_file_bytes=-1)
    return flows.with_lang_source(pairs).select(*_STREAM_OUT)


def q_file_unpaired(spark, sf):
    """SRC6 in the batch reader, through the numbered-line path."""
    root = flows.write_doc_files(spark, sf)
    _pairs, unpaired, _listing = files.read_qa(spark, root, whole_file_bytes=-1)
    return flows.with_lang_source(unpaired).select("lang", "source", "chunk", "ln", "text")


def q_file_report(spark, sf):
    """SRC8 over real files: the listing's files and the pairs read from them."""
    root = flows.write_doc_files(spark, sf)
    pairs, _unpaired, listing = files.read_qa(spark, root)
    rep = flows.with_lang_source(files.ingest_report(pairs, files.listed_files(spark, listing)).filter("folder is not null and module is null"))
    return rep.select("lang", "source", "chunk", "files", "pairs")


# ----------------------------------------------------------------------------- vocabulary / encoding
def q_char_freq(spark, sf):
    return vocab.char_freq(tables.qa_docs(spark, sf))


def q_vocab_build(spark, sf):
    return vocab.build_vocab(tables.qa_docs(spark, sf))


def q_encode(spark, sf):
    return flows.encoded_docs(spark, sf).select(*KEYS, "question_ids", "answer_ids")


def q_encode_oov(spark, sf):
    p = tables.qa_docs(spark, sf)
    voc = vocab.Vocabulary.from_freq(vocab.char_freq(p.filter(F.col("folder") == "en")))
    return vocab.encode_columns(p, voc).select(*KEYS, "question_ids", "answer_ids")


def q_encode_benchmark(spark, sf):
    """FUN4 on held-out text: ``benchmark`` items encoded with the documents' vocabulary."""
    voc = flows.docs_vocab(spark, sf)
    bench = read_table(spark, sf, "benchmark")
    return bench.select("item_id", voc.encode("text").alias("text_ids"))


def q_decode(spark, sf):
    voc = flows.docs_vocab(spark, sf)
    e = vocab.encode_columns(tables.qa_docs(spark, sf), voc)
    return e.select(*KEYS, voc.decode("question_ids").alias("question_text"), voc.decode("answer_ids").alias("answer_text"))


def q_over_budget(spark, sf):
    return clean.budget_report(flows.encoded_docs(spark, sf), by="folder")


def q_test_batches(spark, sf):
    # the ranks need only the keys: the texts of both turns stay out of the sort
    conv = tables.qa_conv(spark, sf).select("conv_id", "turn")
    ranked = rank.ordered_rank(conv, ["conv_id", "turn"])
    return rank.batch_ids(ranked).select("conv_id", "turn", "batch_id", "pos_in_batch")


# ----------------------------------------------------------------------------- profiling
def q_value_counts(spark, sf):
    return profile.value_counts(tables.qa_docs(spark, sf), "module")


def q_value_share(spark, sf):
    return profile.value_share(tables.qa_docs(spark, sf), "folder")


def q_value_counts_events(spark, sf):
    return profile.value_counts(read_table(spark, sf, "events"), "event_type")


def q_length_stats(spark, sf):
    return profile.length_stats(tables.qa_docs(spark, sf))


def q_length_hist(spark, sf):
    return profile.length_hist(tables.qa_docs(spark, sf))


def q_length_extent(spark, sf):
    return profile.length_extent(tables.qa_docs(spark, sf))


def q_box_stats(spark, sf):
    return profile.box_stats(tables.qa_docs(spark, sf), "question", "folder")


def q_box_outliers(spark, sf):
    return profile.box_outliers(tables.qa_docs(spark, sf), KEYS, "question", "folder")


def q_head_sample(spark, sf):
    return profile.head_sample(tables.qa_docs(spark, sf), KEYS, 5).select(*QA_OUT)


def q_random_sample(spark, sf):
    return profile.random_sample(tables.qa_docs(spark, sf), KEYS, 5, seed=SEED).select(*QA_OUT)


# ----------------------------------------------------------------------------- split / batches
def q_split_80_20(spark, sf):
    # the split needs only the keys: write them once (16 bytes a pair) instead of
    # re-deriving the pairs from the text for each of the split's three passes
    keys = materialize(tables.qa_docs(spark, sf).select(*KEYS), "split-keys")
    return rank.exact_split(keys, KEYS, seed=SEED).select(*KEYS, "split")


def q_shuffle_batches(spark, sf):
    return flows.train_batches(spark, sf).select(*KEYS, "batch_id", "pos_in_batch")


def q_ordered_batches(spark, sf):
    return flows.val_batches(spark, sf).select(*KEYS, "batch_id", "pos_in_batch")


def _train_padded(spark, sf, with_masks=False, extra_cols=(), **limits):
    return batching.encode_batches(flows.train_batches(spark, sf, **limits), flows.docs_vocab(spark, sf), with_masks=with_masks, extra_cols=extra_cols)


def _short_padded(spark, sf, **options):
    """Training batches under the network's position budget, asked for."""
    return _train_padded(spark, sf, question_limit=clean.QUESTION_LIMIT, answer_limit=clean.ANSWER_LIMIT, **options)


def q_padded(spark, sf):
    return _train_padded(spark, sf).select(*KEYS, "batch_id", "questions", "answers")


def q_epoch_bucketed(spark, sf):
    """WIN4 SRT4 AGG10 FUN6: all training rows stored bucketed by shard, then the padded batches of the second epoch."""
    rows = flows.pairs_split(spark, sf).filter(F.col("split") == "train")
    table = shards.write_shards(rows, KEYS, flows.docs_vocab(spark, sf), scratch_path(spark, "shards"), seed=SEED)
    return shards.epoch_padded(table, KEYS, 1, seed=SEED).select(*KEYS, "batch_id", "pos_in_batch", "questions", "answers")


def q_prepare_train(spark, sf):
    """PIP2 end to end (split, vocabulary, encoded cache, epoch-0 shuffle, batches, pad);
    the same rows as ``padded``."""
    prep = flows.prepare(tables.qa_docs(spark, sf), None, keys=KEYS, strict=False, save_path=scratch_path(spark, "prepared"))
    return prep["train"].select(*KEYS, "batch_id", "questions", "answers")


def q_prepare_test(spark, sf):
    """PIP2: the test rows, encoded and padded with the training vocabulary, in key order."""
    conv = tables.qa_conv(spark, sf)
    prep = flows.prepare(tables.qa_docs(spark, sf), conv, keys=KEYS, test_keys=["conv_id", "turn"], strict=False, vocab_df=vocab.build_vocab(tables.qa_docs(spark, sf)))
    return prep["test"].select("conv_id", "turn", "batch_id", "questions", "answers")


def q_prepare_loaded(spark, sf):
    """PIP2 from a kept vocabulary and encoded cache: the validation batches."""
    path, pairs = scratch_path(spark, "prepared"), tables.qa_docs(spark, sf)
    flows.prepare(pairs, None, keys=KEYS, strict=False, save_path=path)
    prep = flows.prepare(pairs, None, keys=KEYS, strict=False, load_path=path)
    return prep["val"].select(*KEYS, "batch_id", "questions", "answers")


def _older(pairs):
    """Another state of the pairs as an earlier run might have cached them: some rows were not there yet, some had other
    answers, some are gone since."""
    there = pairs.filter(F.col("doc_id") % 5 != 3)
    answer = F.when(F.col("doc_id") % 7 == 2, F.concat("answer", F.lit(" (old)"))).otherwise(F.col("answer"))
    gone = pairs.filter(F.col("doc_id") % 11 == 4).withColumn("pair_idx", -1 - F.col("pair_idx"))
    return there.withColumn("answer", answer).unionByName(gone)


def _prepare_changed(spark, sf):
    # paired once, for the vocabulary and both states of the table
    path, pairs = scratch_path(spark, "prepared"), materialize(tables.qa_docs(spark, sf), "pairs")
    # the vocabulary is today's: a cache of another one is refused
    voc = materialize(vocab.build_vocab(pairs), "vocabulary")
    flows.prepare(_older(pairs), None, keys=KEYS, strict=False, save_path=path, vocab_df=voc, written=True)
    return flows.prepare(pairs, None, keys=KEYS, strict=False, load_path=path, written=True)


def q_prepare_changed(spark, sf):
    """PIP2 from a cache of another state of the table: rows it has, rows that changed and rows it never had all come out,
    as from a full encode."""
    return _prepare_changed(spark, sf)["train"].select(*KEYS, "batch_id", "questions", "answers")


def q_cache_report(spark, sf):
    """SRC10: how many rows of the table were reused, changed or new, and how many cached rows are gone."""
    return _prepare_changed(spark, sf)["cache"]


def q_prepare_budget(spark, sf):
    """PIP2 with the position budget as an option, and the number of rows it leaves out."""
    prep = flows.prepare(
        tables.qa_docs(spark, sf), None, keys=KEYS, strict=False, save_path=scratch_path(spark, "prepared"),
        question_limit=clean.QUESTION_LIMIT, answer_limit=clean.ANSWER_LIMIT,
    )
    return prep["train"].select(*KEYS, "batch_id", "questions", "answers", F.lit(prep["dropped"]).cast("long").alias("dropped"))


def q_src_mask(spark, sf):
    return _train_padded(spark, sf).select(*KEYS, A.src_mask("questions").alias("questions_mask"))


def q_trg_mask(spark, sf):
    """FUN8 in its exact compact form: ``m[i][j] = j < valid_len and j <= i`` for ``0 <= i, j < mask_len``."""
    return _train_padded(spark, sf).select(*KEYS, F.size("answers").alias("mask_len"), A.valid_len("answers").alias("valid_len"))


def q_trg_mask_matrix(spark, sf):
    """FUN8 / FUN13 with masks: the full L x L matrix of the short rows."""
    b = _short_padded(spark, sf, with_masks=True)
    return b.select(*KEYS, "questions_mask", batching.mask_bits("answers_mask").alias("answers_mask"))


def q_shifted_mask(spark, sf):
    """FUN9 on masks: ``mask[:-1, :-1]`` of the short rows."""
    b = batching.teacher_forcing(_short_padded(spark, sf, with_masks=True))
    return b.select(*KEYS, batching.mask_bits("decoder_mask").alias("decoder_mask"))


def q_trg_mask_digest(spark, sf):
    """FUN8 on all training rows: every row of the L x L mask is built, and one digest of all is kept."""
    return _train_padded(spark, sf).select(*KEYS, F.size("answers").alias("mask_len"), A.trg_mask_digest("answers").alias("digest"))


def q_shifted_mask_compact(spark, sf):
    """FUN9 on the masks of all training rows, in the exact compact form of ``trg_mask``."""
    b = batching.teacher_forcing(_train_padded(spark, sf))
    return b.select(*KEYS, F.size("decoder_input").alias("mask_len"), A.valid_len("decoder_input").alias("valid_len"))


def q_shifted_mask_digest(spark, sf):
    """FUN9 on the masks of all training rows: ``mask[:-1, :-1]`` is the mask of ``ids[:-1]``; digest of all its rows."""
    b = batching.teacher_forcing(_train_padded(spark, sf))
    return b.select(*KEYS, F.size("decoder_input").alias("mask_len"), A.trg_mask_digest("decoder_input").alias("digest"))


def q_collate_extra(spark, sf):
    """UDF2: a caller's columns, evaluated per padded row."""
    extra = [F.size("questions").alias("width"), A.valid_len("questions").alias("used")]
    return _train_padded(spark, sf, extra_cols=extra).select(*KEYS, "batch_id", "width", "used")


def q_shifted(spark, sf):
    return batching.teacher_forcing(_train_padded(spark, sf)).select(*KEYS, "decoder_input", "target")


# ----------------------------------------------------------------------------- evaluation
def q_exact_match(spark, sf):
    return flows.val_matches(spark, sf).select(*KEYS, "batch_id", "match")


def q_accuracy(spark, sf):
    return evaluate.accuracy(flows.val_matches(spark, sf))


def q_accuracy_by_folder(spark, sf):
    return evaluate.accuracy(flows.val_matches(spark, sf), by="folder")


def q_accuracy_by_quality(spark, sf):
    """AGG11 grouped by a key from a second table: accuracy of the labelled documents by
    ``labels.quality`` (equi-join on ``doc_id``; the optimizer / AQE picks the strategy)."""
    labels = read_table(spark, sf, "labels").select("doc_id", "quality")
    return evaluate.accuracy(flows.val_matches(spark, sf).join(labels, "doc_id"), by="quality")


def q_accuracy_fraction(spark, sf):
    m = flows.val_matches(spark, sf)
    kept, n_batches, k = evaluate.first_batches(m, 0.5)
    return evaluate.accuracy(kept).select(
        F.lit(n_batches).cast("long").alias("n_batches"), F.lit(k).cast("long").alias("used_batches"), "n", "matches", "accuracy"
    )


def q_greedy_eval(spark, sf):
    """PIP3: first half of the validation batches (written once) -> caller's model (stub: the question
    as the answer, in ``max_len`` ids) -> joined on the key -> exact match -> accuracy."""
    voc = flows.docs_vocab(spark, sf)
    batches = materialize(batching.encode_batches(flows.val_batches(spark, sf), voc).select(*KEYS, "batch_id", "pos_in_batch", "questions", "answers"), "val")
    res = flows.evaluate_greedy(batches, KEYS, evaluate.echo_predictor, 0.5)
    return res["accuracy"].select(
        F.lit(res["n_batches"]).cast("long").alias("n_batches"), F.lit(res["used_batches"]).cast("long").alias("used_batches"),
        "n", "matches", "accuracy",
    )


def _decoded(spark, sf):
    """All validation batches (written once), decoded by a model counted from the training rows."""
    voc = flows.docs_vocab(spark, sf)
    train = materialize(flows.pairs_split(spark, sf).filter("split = 'train'").select("question", "answer"), "decode-train")
    batches = batching.encode_batches(flows.val_batches(spark, sf), voc).select(*KEYS, "question", "batch_id", "pos_in_batch", "questions", "answers")
    return flows.decode_batches(materialize(batches, "val"), KEYS, decode.CountedModel(train, voc))


def q_greedy_decode(spark, sf):
    """PIP3 / UDF1 / SRT7: every validation answer generated character by character, ``max_len - 1`` arg-max steps."""
    return _decoded(spark, sf).select(*KEYS, "pred_ids", "match")


def q_greedy_decode_accuracy(spark, sf):
    """PIP3: exact matches of the generated answers, by language."""
    folder = tables.documents(spark, sf).select("doc_id", "folder")
    return evaluate.accuracy(_decoded(spark, sf).join(folder, "doc_id"), by="folder")


def q_batch_examples(spark, sf):
    voc = flows.docs_vocab(spark, sf)
    m = evaluate.batch_examples(flows.val_matches(spark, sf, voc))
    return m.select(
        *KEYS,
        "batch_id",
        voc.decode("questions").alias("question_text"),
        voc.decode("answers").alias("answer_text"),
        voc.decode("pred_ids").alias("predicted_text"),
    )


def q_batch_predict(spark, sf):
    e = flows.encoded_docs(spark, sf)
    return evaluate.batch_predict(e, evaluate.reverse_predictor, KEYS, ids_col="question_ids", max_len_col=None)


def q_greedy_argmax(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return emb.select("vec_id", "label", A.argmax("embedding").alias("pred"))


def q_greedy_argmax_long(spark, sf):
    """SRT7 long form: one row per (vector, position) -> max_by per vector."""
    emb = read_table(spark, sf, "embeddings")
    long = emb.select("vec_id", "label", F.posexplode("embedding").alias("pos", "logit"))
    return evaluate.argmax_long(long, ["vec_id", "label"], "pos", "logit").withColumn("pred", F.col("pred").cast("int"))


def q_token_xent(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return emb.select("vec_id", "label", F.round(A.cross_entropy_at("embedding", "label"), FLOAT_DIGITS).alias("xent"))


def q_softmax(spark, sf):
    """VEC5: softmax weights of every row of logits."""
    emb = read_table(spark, sf, "embeddings")
    return emb.select("vec_id", _round_arr(A.softmax("embedding")).alias("weights"))


def q_masked_xent(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    out = evaluate.masked_cross_entropy(emb, "embedding", "label")
    return out.select("positions", F.round("loss", FLOAT_DIGITS).alias("loss"), F.round("perplexity", FLOAT_DIGITS).alias("perplexity"))


# ----------------------------------------------------------------------------- vectors
VECTORS_PER_SEQUENCE = 100


def _sequences(spark, sf):
    """``embeddings`` as sequences of ``VECTORS_PER_SEQUENCE`` consecutive vectors."""
    n = VECTORS_PER_SEQUENCE
    return read_table(spark, sf, "embeddings").select(F.expr(f"vec_id div {n}").alias("seq_id"), (F.col("vec_id") % n).alias("pos"), "embedding")


def _attention(spark, sf, causal=True, **blocks):
    return vectors.attention(_sequences(spark, sf), "seq_id", "pos", "embedding", causal=causal, **blocks)


def q_attn_stats(spark, sf):
    a = _attention(spark, sf)
    return a.select(
        "seq_id", "q_pos", "n_keys", "best_key",
        F.round("max_score", FLOAT_DIGITS).alias("max_score"), F.round("log_norm", FLOAT_DIGITS).alias("log_norm"),
    )


def q_dot_scores(spark, sf):
    """VEC1 / JOI5 re-aimed: per query, the summary of its scaled dot scores over all keys of its sequence."""
    a = _attention(spark, sf, causal=False)
    return a.select(
        "seq_id", "q_pos", "n_keys", "best_key",
        F.round("max_score", FLOAT_DIGITS).alias("max_score"), F.round("log_norm", FLOAT_DIGITS).alias("log_norm"),
    )


def q_attn_softmax(spark, sf):
    """VEC2 re-aimed: per query, the largest softmax weight and the entropy of the weights (causal)."""
    a = _attention(spark, sf)
    return a.select(
        "seq_id", "q_pos", F.round("max_weight", FLOAT_DIGITS).alias("max_weight"), F.round("entropy", FLOAT_DIGITS).alias("entropy")
    )


def q_attn_pool(spark, sf):
    return _attention(spark, sf).select("seq_id", "q_pos", _round_arr("pooled").alias("pooled"))


def q_attn_pool_full(spark, sf):
    return _attention(spark, sf, causal=False).select("seq_id", "q_pos", _round_arr("pooled").alias("pooled"))


def q_attn_bind(spark, sf):
    a = _attention(spark, sf)
    roles = _sequences(spark, sf).select("seq_id", F.col("pos").alias("q_pos"), F.col("embedding").alias("role"))
    return vectors.bind_role(a, roles, ["seq_id", "q_pos"]).select("seq_id", "q_pos", _round_arr("bound").alias("bound"))


def q_attn_blocks(spark, sf):
    """Many query blocks a sequence: the same pooling as ``attn_pool``."""
    return _attention(spark, sf, block_size=7).select("seq_id", "q_pos", "n_keys", _round_arr("pooled").alias("pooled"))


# ----------------------------------------------------------------------------- sink round trips
def q_csv_roundtrip(spark, sf):
    p = tables.qa_docs(spark, sf).select(*QA_OUT)
    path = scratch_path(spark, "csv")
    files.write_csv(p, path)
    back = files.read_csv(spark, path)
    return back.select(
        F.col("doc_id").cast("long").alias("doc_id"), "folder", "module",
        F.col("pair_idx").cast("long").alias("pair_idx"), "question", "answer",
    )


def q_parquet_roundtrip(spark, sf):
    voc = flows.docs_vocab(spark, sf)
    e = vocab.encode_columns(tables.qa_docs(spark, sf), voc).select(*KEYS, "question_ids", "answer_ids")
    path = scratch_path(spark, "encoded")
    files.write_encoded(e, path, voc.fingerprint)
    return files.read_encoded(spark, path, voc.fingerprint).select(*KEYS, "question_ids", "answer_ids")


def q_vocab_roundtrip(spark, sf):
    path = scratch_path(spark, "vocab")
    files.write_vocab(vocab.build_vocab(tables.qa_docs(spark, sf)), path)
    back = files.read_vocab(spark, path)
    vocab.Vocabulary.from_df(back)  # validates dense ids and specials
    return back.select("token", "freq", "id")


def q_dataset_layout(spark, sf):
    """SNK4: both halves written and read, with tokenized tables beside them under one root."""
    split = rank.exact_split(materialize(tables.qa_docs(spark, sf), "layout"), KEYS, seed=SEED)
    root, n = scratch_path(spark, "dataset"), 10000
    for half, kind in (("train", "train"), ("val", "test")):
        rows = split.filter(F.col("split") == half).select(*QA_OUT)
        files.write_dataset(rows, root, kind, None, n)
        files.write_dataset(rows.select(*KEYS, F.array(F.length("question")).alias("ids")), root, kind, None, n, tokenized=True)
    out = None
    for kind in ("train", "test"):
        plain = files.read_dataset(spark, root, kind, None, n)
        both = plain.join(files.read_dataset(spark, root, kind, None, n, tokenized=True), KEYS)
        part = both.select(F.lit(kind).alias("kind"), *QA_OUT, F.col("ids")[0].alias("question_length"))
        out = part if out is None else out.unionByName(part)
    return out


def q_dataset_modules(spark, sf):
    """SNK4 per module: names that differ only as text stay apart."""
    pairs = materialize(_odd_keys(spark, sf).filter("key in ('7', '07', '007')"), "modules")
    root, out = scratch_path(spark, "modules"), None
    for module in ("7", "07", "007"):
        files.write_dataset(pairs.filter(F.col("key") == module), root, "test", module, 5)
    for module in ("7", "07", "007"):
        part = files.read_dataset(spark, root, "test", module, 5).select(F.lit(module).alias("name"), "key", *KEYS)
        out = part if out is None else out.unionByName(part)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
