"""File sources and sinks (SRC1-SRC11, SNK1-SNK5, JOI4).

``read_qa`` reads ``<root>/<folder>/<module-file>`` text files of alternating
question / answer lines.  Spark's text source yields lines but no line numbers; for files too large for one row
they are recovered exactly and at scale (H1):

1. the lines of one split (``_metadata.file_path``, ``_metadata.file_block_start``) are consecutive rows of one task, so one
   read gives, per split, the line count and the first and last line - one row per split, however large the files;
2. a prefix sum over the splits of a file (a window over that small table) gives each split's first line number, which
   is joined back by broadcast;
3. lines are paired inside their split as they are read again; pairs over a border come from the table of step 1.

Listing (SRC2, SRC3) goes through the Hadoop FileSystem of the session, so the same
code lists local folders, HDFS or object stores.
"""

from __future__ import annotations

import logging
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpairs.functions.text import decode_uri_path, drop_last4, parent_name
from textpairs.operators.clean import distinct_keys
from textpairs.operators.pairing import _check_cap, pairs_from_lines, pairs_in_rows, pairs_in_splits, split_lines, unpaired_in_rows
from textpairs.operators.vocab import id_bytes, pack_ids, unpack_ids
from textpairs.session import few_listing_tasks, materialize

log = logging.getLogger(__name__)

QA_SCHEMA = "question string, answer string, folder string, module string"


# ----------------------------------------------------------------------------- listing
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _hidden(name: str) -> bool:
    return name.startswith("_") or name.startswith(".")


def list_inputs(spark: SparkSession, root: str, folders=None, files=None) -> dict:
    """SRC2 + SRC3 + JOI4: the chosen folders and files under ``root``.

    Returns ``{"folders": [...], "files": [...], "skipped_hidden": [...]}`` (paths).
    Missing folders / files are skipped silently; no folder -> ValueError; files asked
    for but none found -> ValueError; a hidden file (``_x``, ``.x`` - Spark never reads
    those) asked for by name -> ValueError.  A name given twice counts once.  With
    ``folders`` only those folders are listed.
    """
    for name, seq in (("folders", folders), ("files", files)):
        if seq is not None and not all(isinstance(x, str) for x in seq):
            raise TypeError(f"{name}: names are strings, got {[type(x).__name__ for x in seq]}")
    folders = list(dict.fromkeys(folders)) if folders else None
    files = list(dict.fromkeys(files)) if files else None
    fs, rootp = _fs(spark, root)
    if not fs.exists(rootp):
        raise FileNotFoundError(f"input directory {root} not found")
    jvm = spark.sparkContext._jvm
    base = rootp.toString().rstrip("/")

    sizes: dict = {}

    def glob(pattern):
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or []
        out = []
        for st in found:
            p, is_dir = st.getPath().toString(), st.isDirectory()
            if not is_dir:
                sizes[p] = st.getLen()
            out.append((p, is_dir))
        return out

    by_folder: dict = {}
    if folders:
        # only the named folders are opened
        chosen = []
        for f in folders:
            d = jvm.org.apache.hadoop.fs.Path(base + "/" + f)
            if fs.exists(d) and fs.getFileStatus(d).isDirectory():
                chosen.append(d.toString())
                for st in fs.listStatus(d):
                    p = st.getPath().toString()
                    name = p.rsplit("/", 1)[-1]
                    if st.isFile() and not name.startswith("."):
                        sizes[p] = st.getLen()
                        by_folder.setdefault(d.toString(), {})[name] = p
    else:
        # one glob per level, not one listing call per folder
        chosen = sorted((p for p, is_dir in glob(base + "/*") if is_dir), key=lambda p: p.rsplit("/", 1)[-1])
        for p, is_dir in glob(base + "/*/*"):
            if not is_dir:
                by_folder.setdefault(p.rsplit("/", 1)[0], {})[p.rsplit("/", 1)[-1]] = p
    if not chosen:
        raise ValueError(f"no folder to read under {root}" + (f" among {folders}" if folders else ""))
    # glob skips names starting with '.'; when asked for by name, look them up directly
    if files:
        for d in chosen:
            for f in files:
                if f not in by_folder.get(d, {}):
                    cand = jvm.org.apache.hadoop.fs.Path(d + "/" + f)
                    if fs.exists(cand) and fs.getFileStatus(cand).isFile():
                        by_folder.setdefault(d, {})[f] = cand.toString()
                        sizes[cand.toString()] = fs.getFileStatus(cand).getLen()
    out_files, hidden = [], []
    for d in chosen:
        entries = by_folder.get(d, {})
        names = [f for f in files if f in entries] if files else sorted(entries)
        for n in names:
            (hidden if _hidden(n) else out_files).append(entries[n])
    if files and hidden:
        raise ValueError(f"Spark passes over names that start with '_' or '.': {hidden}")
    if files and not out_files:
        raise ValueError(f"no chosen folder holds any of {files}")
    if not out_files:
        raise ValueError(f"the chosen folders under {root} hold no readable file")
    return {"folders": chosen, "files": out_files, "sizes": {f: sizes.get(f, 0) for f in out_files}, "skipped_hidden": hidden}


def file_table(spark: SparkSession, root: str) -> DataFrame:
    """SRC2 / SRC3 as a table: ``(path, folder, name, length)`` of every file ``<root>/<folder>/<name>`` that Spark reads.

    Only paths and sizes are read (no content); Spark lists many folders in parallel tasks.  Names that start with ``_`` or
    ``.`` are not among them, as Spark's readers pass over these too, and neither are empty files, which hold no pair.
    """
    with few_listing_tasks(spark):
        found = spark.read.format("binaryFile").load(root.rstrip("/") + "/*/*").select("path", "length")
    uri = F.col("path")
    return found.select("path", parent_name(uri).alias("folder"), F.element_at(F.split(uri, "/"), -1).alias("name"), "length")


def select_files(table: DataFrame, folders=None, names=None) -> DataFrame:
    """JOI4: the rows of ``file_table`` whose folder / name is wanted, by semi-joins.

    ``folders`` and ``names`` are lists of names or tables with a column ``folder`` / ``name`` (both, for certain files
    of certain folders).  Wanted names that do not exist are skipped; a name given twice counts once.
    """
    spark = table.sparkSession
    for column, wanted in (("folder", folders), ("name", names)):
        if wanted is None:
            continue
        if not isinstance(wanted, DataFrame):
            if not all(isinstance(x, str) for x in wanted):
                raise TypeError(f"{column}: names are strings, got {[type(x).__name__ for x in wanted]}")
            wanted = spark.createDataFrame([(x,) for x in wanted], f"{column} string")
        on = [c for c in ("folder", "name") if c in wanted.columns]
        table = table.join(wanted.select(*on), on, "left_semi")
    return table


def read_selected(spark: SparkSession, selected: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """PIP1 over chosen rows of ``file_table``: ``(pairs, unpaired)``, with the options of ``read_qa``; no file: an error."""
    sizes = {r["path"]: r["length"] for r in selected.select("path", "length").coalesce(spark.sparkContext.defaultParallelism).toLocalIterator()}  # Spark's own file index holds these paths too
    if not sizes:
        raise ValueError("no chosen file to read")
    return _read_files(spark, sorted(sizes), sizes, **options)


# ----------------------------------------------------------------------------- text pairs
# Largest per-split offsets table broadcast by ``numbered_lines`` (estimated bytes).
OFFSETS_BROADCAST_BYTES = 128 << 20


def _raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC7 / SET1: all chosen files are one ``read.text`` over their paths - a union all of the per-file line sets; row
    order is defined by ``(folder, module, pair_idx)`` keys."""
    with few_listing_tasks(spark):
        raw = spark.read.text(paths)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def pairs_of_lines(spark: SparkSession, paths: list[str], cap: int | None = None, on_unpaired: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(pairs, unpaired) of large files, each with its file.

    One read counts the lines of every split and keeps its first and last (a written table of one row a split); its prefix
    sums give each split the number of its first line (WIN1).  A second read pairs lines inside their split
    (``pairing.pairs_in_splits``): no exchange carries lines.

    The splits' numbers are broadcast.  A file of len bytes gives at most len / S + 1 splits and no scan partition holds
    more than S bytes, so splits <= scan partitions + files (doubled here as a margin), both known before any job runs.  Beyond
    ``OFFSETS_BROADCAST_BYTES`` (files of about 100 TB) lines are numbered by a join and paired by a shuffle: the same rows.
    """
    raw = _raw_lines(spark, paths)
    max_splits = 2 * raw.rdd.getNumPartitions() + len(paths)
    if max_splits * (max((len(p) for p in paths), default=0) + 48) > OFFSETS_BROADCAST_BYTES:
        return pairs_from_lines(numbered_lines(spark, paths), ["file"], cap=cap, on_unpaired=on_unpaired)
    splits = materialize(split_lines(raw), "splits")
    by = Window.partitionBy("file").orderBy("block")
    splits = splits.select(
        "file", "block", "n", "first", "last",
        F.xxhash64("file", "block").alias("no"),
        F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"),
        F.lead("first").over(by).alias("next_first"),
    )
    splits = materialize(splits, "splits-numbered")
    lines = raw.join(F.broadcast(splits.select("file", "block", "no", "off")), ["file", "block"])
    return pairs_in_splits(lines, splits, cap=cap, on_unpaired=on_unpaired)


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, ln, value): every line with its 0-based number in its file (WIN1)."""
    raw = _raw_lines(spark, paths).withColumn("mid", F.monotonically_increasing_id())
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("mid0"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("file", "block", "mid0", F.coalesce(before, F.lit(0)).alias("off"))
    return raw.join(offsets, ["file", "block"]).select("file", (F.col("off") + F.col("mid") - F.col("mid0")).alias("ln"), "value")


def named(df: DataFrame) -> DataFrame:
    """``df`` with folder and module of its ``file``, as columns 2 and 3."""
    path = decode_uri_path(F.col("file"))
    base = F.element_at(F.split(path, "/"), -1)
    rest = [c for c in df.columns if c != "file"]
    return df.select("file", parent_name(path).alias("folder"), drop_last4(base).alias("module"), *rest)


# Files up to this size are read whole and paired in-row; larger ones take the line path, as
# do compressed ones, whose size says little about their text.  Both give the same rows.
WHOLE_FILE_BYTES = 64 << 20
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
BYTE_ORDER_MARK = "\ufeff"
FILE_KEYS = ["file", "folder", "module"]


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, folder, module, text): one row per file (``wholetext``, passed as an argument)."""
    with few_listing_tasks(spark):
        raw = spark.read.text(paths, wholetext=True)
    path = decode_uri_path(F.col("_metadata.file_path"))
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        parent_name(path).alias("folder"),
        drop_last4(F.element_at(F.split(path, "/"), -1)).alias("module"),
        without_mark("value").alias("text"),
    )


def without_mark(text: str):
    """A text without a leading byte-order mark, which says how the file is encoded and is no part of its
    first line (Spark's line reader drops it too)."""
    return F.when(F.startswith(F.col(text), F.lit(BYTE_ORDER_MARK)), F.substr(F.col(text), F.lit(2))).otherwise(F.col(text))


def read_qa(
    spark: SparkSession,
    root: str,
    folders=None,
    files=None,
    samples_per_module: int | None = None,
    on_unpaired: str = "quarantine",
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> tuple[DataFrame, DataFrame, dict]:
    """PIP1 (SRC1-SRC8): ``(pairs, unpaired, listing)``.

    pairs: (file, folder, module, pair_idx, question, answer) - whole files, or the first
    ``samples_per_module`` pairs of every file when that is given; unpaired: (file, folder, module, ln, text).

    Files are routed by the size the listing reports: up to ``whole_file_bytes`` a file is
    read whole and paired inside its row (one read, no shuffle); larger files take the
    line path (two reads, no shuffle of lines, any file size).  Both give the same rows.
    """
    _check_cap(samples_per_module)
    listing = list_inputs(spark, root, folders, files)
    pairs, unpaired = _read_files(spark, listing["files"], listing["sizes"], samples_per_module, on_unpaired, whole_file_bytes)
    return pairs, unpaired, listing


def _read_files(
    spark: SparkSession, paths: list[str], sizes: dict, samples_per_module: int | None = None, on_unpaired: str = "quarantine", whole_file_bytes: int = WHOLE_FILE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(pairs, unpaired) of files routed by their sizes."""
    _check_cap(samples_per_module)
    is_small = {f: sizes[f] <= whole_file_bytes and not f.endswith(COMPRESSED) for f in paths}
    small = [f for f, s in is_small.items() if s]
    big = [f for f, s in is_small.items() if not s]
    parts = []
    if small:
        texts = whole_files(spark, small)
        parts.append(
            (
                pairs_in_rows(texts, "text", FILE_KEYS, cap=samples_per_module, on_unpaired=on_unpaired),
                unpaired_in_rows(texts, "text", FILE_KEYS, cap=samples_per_module),
            )
        )
    if big:
        found = pairs_of_lines(spark, big, cap=samples_per_module, on_unpaired=on_unpaired)
        parts.append(tuple(named(p) for p in found))
    pairs, unpaired = parts[0]
    for p, u in parts[1:]:
        pairs, unpaired = pairs.unionByName(p), unpaired.unionByName(u)
    return pairs, unpaired


def listing_counts(listing: dict) -> dict:
    """SRC8: numbers of chosen folders and files (and hidden files Spark skips), as logged
    after an ingest; counts come from the listing, so files without a pair count too."""
    return {"folders": len(listing["folders"]), "files": len(listing["files"]), "skipped_hidden": len(listing["skipped_hidden"])}


def listed_files(spark: SparkSession, listing: dict) -> DataFrame:
    """(file, folder, module) of the listed files, named as in the pairs."""
    paths = spark.createDataFrame([(f,) for f in listing["files"]], "file string")
    base = F.element_at(F.split("file", "/"), -1)
    return paths.select("file", parent_name(F.col("file")).alias("folder"), drop_last4(base).alias("module"))


def ingest_report(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """SRC8: files and pairs per (folder, module), with folder totals and a grand total (rollup).

    ``listed(file, folder, module)`` are the chosen files; a file that gave no pair counts as a file.
    """
    counts = pairs.groupBy("folder", "module").agg(F.lit(0).cast("long").alias("files"), F.count(F.lit(1)).alias("pairs"))
    chosen = listed.groupBy("folder", "module").agg(F.count(F.lit(1)).alias("files"), F.lit(0).cast("long").alias("pairs"))
    return chosen.unionByName(counts).rollup("folder", "module").agg(F.sum("files").alias("files"), F.sum("pairs").alias("pairs"))


# ----------------------------------------------------------------------------- csv
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# Text that looks like the null marker (backslashes then N) gets one more backslash on
# write and loses it on read, so "\N" typed by a user survives as text.
_MARKER_LIKE_W = r"^(\\+N)$"
_MARKER_LIKE_R = r"^\\(\\+N)$"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """SNK1: header, RFC-4180 quoting (doubled quotes), null written as ``\\N`` so '' and null both survive.

    An empty frame still gets its header.  ``single_file`` coalesces to one task (small outputs only).
    """
    if df.isEmpty():
        log.warning("no rows to write: %s gets a header alone", path)
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    df = df.select(*[F.regexp_replace(c, _MARKER_LIKE_W, r"\\$1").alias(c) if c in strings else F.col(c) for c in df.columns])
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, columns=None, na_values=None) -> DataFrame:
    """SRC9: every column as string; ``na_values`` (opt-in) turns those words into null."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no csv at {path}")
    if columns is None:
        header = spark.read.options(**CSV_OPTIONS).csv(path).columns
        columns = header
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    df = df.select(*[F.regexp_replace(c, _MARKER_LIKE_R, "$1").alias(c) for c in columns])
    if na_values:
        df = df.select(*[F.when(F.col(c).isin(list(na_values)), F.lit(None)).otherwise(F.col(c)).alias(c) for c in columns])
    if df.isEmpty():
        log.warning("%s holds no rows", path)
    return df


# ----------------------------------------------------------------------------- parquet tables
#: columns of an encoded table beside its keys and ids
VOCAB_FP, ROW_FP = "vocab_fp", "row_fp"


def row_fingerprint(cols):
    """A 64-bit fingerprint of a row's texts; null and '' differ, and so do texts that moved to another column."""
    parts = [x for c in cols for x in (F.col(c).isNull(), F.length(c), F.col(c))]
    return F.xxhash64(*parts)


def table_digest(df: DataFrame, cols) -> tuple[int, int]:
    """(rows, sum of row hashes): the same for the same rows in any order and partitioning."""
    # a null is hashed as a flag, so that it cannot change places with another
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))).first()
    return int(n), int(total or 0)


def write_encoded(df: DataFrame, path: str, fingerprint: str, mode: str = "overwrite", partition_by=None) -> None:
    """SNK2: encoded table with the vocabulary fingerprint stored in every row."""
    w = df.withColumn(VOCAB_FP, F.lit(fingerprint)).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_encoded(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """SRC10: encoded table; with ``fingerprint`` it must match the vocabulary it was made with."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no encoded table at {path}")
    df = spark.read.parquet(path)
    if fingerprint is not None:
        bad = df.filter(F.col(VOCAB_FP) != F.lit(fingerprint)).limit(1).count()
        if bad:
            raise ValueError("encoded table was made with a different vocabulary")
    return df.drop(VOCAB_FP)


def reuse_packed(df: DataFrame, cached: DataFrame, keys: list[str], voc, cols=("question", "answer")) -> DataFrame:
    """All rows of ``df`` with ``<col>_packed`` (``vocab.pack_ids``): from ``cached`` where its row has the same texts, encoded anew
    where it has not (``cached_state``: ``reused``, ``changed`` or ``new``).

    ``cached(keys, <col>_ids, row_fp)``; the join keeps every row of ``df``, null keys included.  Of cached rows that share
    their keys those with the row's texts count, and equal ones once.
    """
    width = id_bytes(voc.size)
    ids = [pack_ids(F.col(f"{c}_ids"), width).alias(c) for c in cols]  # exchanged, sorted and joined as bytes
    # structs of keys are equal where nulls stand in the same places; hashed alike on both sides, so each side is exchanged once
    mine = df.withColumns({"__key": F.struct(*keys), "__fp": row_fingerprint(cols)})
    all_kept = cached.select(F.struct(*keys).alias("__key"), F.col(ROW_FP).alias("__fp"), F.struct(*ids).alias("__hit"))
    kept = all_kept.repartition("__key", "__fp").dropDuplicates(["__key", "__fp"])
    known = cached.select(F.struct(*keys).alias("__key")).distinct().withColumn("__known", F.lit(True))
    both = mine.join(kept, ["__key", "__fp"], "left").join(known, "__key", "left")
    state = F.when(F.col("__hit").isNotNull(), "reused").when(F.col("__known"), "changed").otherwise("new")
    there = F.col("__hit").isNotNull()
    # only rows that the cache lacks are encoded: a Python function sees all rows
    out = {f"{c}_packed": F.when(there, F.col("__hit")[c]).otherwise(pack_ids(F.when(~there, voc.encode(c)), width)) for c in cols}
    return both.withColumns({**out, "cached_state": state}).drop("__key", "__fp", "__hit", "__known")


def reuse_encoded(df: DataFrame, cached: DataFrame, keys: list[str], voc, cols=("question", "answer")) -> DataFrame:
    """``reuse_packed`` with the ids as arrays, ``<col>_ids``."""
    got = reuse_packed(df, cached, keys, voc, cols)
    ids = [unpack_ids(F.col(f"{c}_packed"), id_bytes(voc.size)).alias(f"{c}_ids") for c in cols]
    return got.select(*df.columns, *ids, "cached_state")


def cache_report(reused: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """(state, rows): how many rows of a table were reused, changed or new, and how many cached rows it has ``gone``."""
    states = reused.groupBy(F.col("cached_state").alias("state")).agg(F.count(F.lit(1)).alias("rows"))
    have = reused.select(*[F.col(k).alias(f"__k_{k}") for k in keys]).distinct()
    gone = cached.join(have, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "left_anti")
    return states.unionByName(gone.agg(F.lit("gone").alias("state"), F.count(F.lit(1)).alias("rows")).filter("rows > 0"))


def write_vocab(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK3: the vocabulary (one small file)."""
    vocab.coalesce(1).write.mode(mode).parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: the vocabulary; ids must be dense 0..V-1 with the specials first (checked by ``Vocabulary``)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no vocabulary table at {path}")
    return spark.read.parquet(path)


# ----------------------------------------------------------------------------- dataset layout
def dataset_name(kind: str, module: str | None, samples_per_module: int) -> tuple[str, str]:
    """SNK4 naming rule -> (mix, name).  ``kind`` is 'train' or 'test'; N must be a positive int."""
    if not isinstance(samples_per_module, int) or isinstance(samples_per_module, bool):
        raise TypeError(f"samples_per_module is a whole number, got {type(samples_per_module).__name__}")
    if samples_per_module <= 0:
        raise ValueError(f"samples_per_module is above 0, got {samples_per_module}")
    if kind not in ("train", "test"):
        raise ValueError(f"kind is 'train' or 'test', got {kind!r}")
    if not module:
        return "mixed", ("interpolate" if kind == "test" else f"mixed_{samples_per_module}")
    return "unique_module", (module if kind == "test" else f"{module}_{samples_per_module}")


def _leaf(root: str, kind: str, module: str | None, samples_per_module: int, tokenized: bool) -> str:
    mix, name = dataset_name(kind, module, samples_per_module)
    table = "tokenized_dataframe" if tokenized else "dataframe"
    return f"{root.rstrip('/')}/kind={table}/split={kind}/mix={mix}/name={quote(name, safe='')}"


def write_dataset(df: DataFrame, root: str, kind: str, module: str | None, samples_per_module: int, tokenized: bool = False, mode: str = "overwrite") -> str:
    """SNK4: one Parquet tree laid out ``kind=/split=/mix=/name=``; returns the leaf path."""
    leaf = _leaf(root, kind, module, samples_per_module, tokenized)
    df.write.mode(mode).parquet(leaf)
    return leaf


def read_dataset(spark: SparkSession, root: str, kind: str, module: str | None, samples_per_module: int, tokenized: bool = False) -> DataFrame:
    """SNK4 read side: the one leaf, read by its own path - names stay text (``007`` is not ``7``) and
    plain and tokenized tables under one root keep their own schemas."""
    leaf = _leaf(root, kind, module, samples_per_module, tokenized)
    return spark.read.option("basePath", leaf).parquet(leaf)


_PART = "key_part"


def _key_part(key: str):
    """The directory value of a key: marked text, so '' and null differ and no type is inferred."""
    c = F.col(key).cast("string")
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("k_"), c))


def write_split(df: DataFrame, path: str, key: str, mode: str = "overwrite", only_keys: bool = False, watch=None) -> None:
    """SNK5: persist the per-key frames of FLT3 / FLT4 as one table with a directory per key.

    ``only_keys`` replaces the directories of the keys that ``df`` has and leaves the others, so a step that is run again for
    some keys neither loses nor doubles any; otherwise an overwrite replaces the table.  ``watch`` takes the rows as they
    are written, behind the exchange, and gives them back (to observe them: an empty exchange drops what stands before it).

    The key stays a data column; rows are gathered by key and rebalanced by size first, so a small key has one file, however
    many keys there are, and a key that holds most rows is written by many tasks.
    """
    out = df.withColumn(_PART, _key_part(key))
    kind = "dynamic" if only_keys else "static"
    out = out.hint("rebalance", _PART)
    (watch(out) if watch else out).write.mode(mode).option("partitionOverwriteMode", kind).partitionBy(_PART).parquet(path)


def read_split_table(spark: SparkSession, path: str) -> DataFrame:
    """All keys of a split in one scan."""
    with few_listing_tasks(spark):
        return spark.read.parquet(path).drop(_PART)


def read_split(spark: SparkSession, path: str, key: str) -> dict:
    """SNK5 read side: ``{value: pruned scan of that partition}``; keys ascending, null first."""
    with few_listing_tasks(spark):
        df = spark.read.parquet(path)
    parts = {k: "null" if k is None else f"k_{k}" for k in distinct_keys(df, key)}
    return {k: df.filter((F.col(_PART) == part) & F.col(key).eqNullSafe(F.lit(k))).drop(_PART) for k, part in parts.items()}
