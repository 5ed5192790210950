"""Streams of files that do not fit one row (STR1): cut into pieces, or whole and read by their splits.

``run_pieces`` - a module file arrives as numbered pieces (``<root>/<folder>/<file>/00000``, ``00001``, ..., the
last one marked ``-last``), cut between any two characters.  A piece is one row, the file need not be.  What a
piece does to its neighbours is said by a summary of one row: its first and last lines and how many there are.  The
summaries alone are shuffled, to the state of their file: the number of the next piece, lines so far, the
unanswered question and the line that is still open.  The lines inside a piece are paired inside its row, from the
offset that the state gives it, in a second read of the piece; so no exchange and no state holds a file's lines,
however large one file is.

``run_listed`` - whole files of any size arrive.  The stream carries paths and sizes only (no content); every
micro-batch reads its files through the batch reader, which pairs large ones inside their splits.

Defined cases of ``run_pieces``: pieces may come in any order and wait (as summaries) for those before them; a piece
number that was there already is passed over; pieces after the last one are passed over; a file without a byte is not
read by Spark, so a piece holds at least one (``open_files`` shows what a file waits for); a line may reach over many pieces; ``\\r`` and ``\\n`` of one line end may lie in two pieces; a byte-order mark is
dropped from the start of piece 0; a name that gives no piece number fails the query.  An odd last line is
quarantined when the last piece is there.  Every micro-batch replaces what an earlier try of it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from textpairs.functions.text import decode_uri_path, strip
from textpairs.operators.vocab import Vocabulary
from textpairs.session import few_listing_tasks
from textpairs.sources.files import FILE_KEYS, named, read_selected, without_mark
from textpairs.streaming.ingest import await_available, encode_stream

#: <file>/<number>[-last], as a file with or without a suffix, or as a directory written by Spark (``piece=<number>``)
PIECE_PATH = r"^(.*)/(?:piece=)?([0-9]+)(-last)?(?:\.[^/]*|/[^/]*)?$"
#: a ``\r`` that ends a piece may be half of a line end: it stays with the open line
LINE_ENDS = r"\r\n|\n|\r(?!\z)"

#: pieces of one micro-batch whose paths and places the driver holds and sends to every executor
BATCH_PIECES = 20_000

STEPS = "path string, start int, pairs int, pair_idx long, q string, a string"
STATE = "next long, lines long, asked string, open string, early string, done boolean"


def _parts(text: str):
    return F.split(F.col(text), LINE_ENDS)


def _piece_rows(raw: DataFrame) -> DataFrame:
    """(file, piece, last, path, text) of ``wholetext`` rows."""
    path = F.col("_metadata.file_path")
    number = F.regexp_extract(path, PIECE_PATH, 2)
    rows = raw.select(
        F.regexp_extract(path, PIECE_PATH, 1).alias("file"),
        F.when(number == "", F.raise_error(F.concat(F.lit("no piece number in "), path))).otherwise(number).cast("long").alias("piece"),
        (F.regexp_extract(path, PIECE_PATH, 3) != "").alias("last"),
        path.alias("path"),
        "value",
        without_mark("value").alias("unmarked"),
    )
    return rows.select("file", "piece", "last", "path", F.when(F.col("piece") == 0, F.col("unmarked")).otherwise(F.col("value")).alias("text"))


def stream_pieces(spark: SparkSession, root_glob: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (file, piece, last, path, text) of the pieces under ``root_glob``, e.g. ``<root>/*/*/*``."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    with few_listing_tasks(spark):
        raw = reader.text(root_glob, wholetext=True)
    return _piece_rows(raw)


def summaries(pieces: DataFrame) -> DataFrame:
    """One row a piece: the text before its first line end, after its last one, the lines next to these, and how many
    line ends it has.  Made inside the row; no line between these leaves it."""
    p = pieces.select("file", "piece", "last", "path", F.startswith("text", F.lit("\n")).alias("after_cr"), _parts("text").alias("parts"))
    ends = F.size("parts") - 1
    inner = ends > 1
    return p.select(
        "file", "piece", "last", "path", "after_cr",
        ends.alias("ends"),
        F.element_at("parts", 1).alias("head"),
        F.when(inner, F.get("parts", F.lit(1))).alias("first"),
        F.when(inner, F.get("parts", ends - 1)).alias("final"),
        F.element_at("parts", -1).alias("tail"),
    )


class _File:
    """The state of one file while its pieces are taken in order."""

    def __init__(self, lines: int, asked: str | None, open_: str):
        self.lines, self.asked, self.open = lines, asked, open_
        self.steps: list[tuple] = []

    def line(self, text: str) -> None:
        """The next line: a question waits, an answer makes a pair."""
        if self.asked is None:
            self.asked = text
        else:
            self.steps.append((None, None, None, self.lines >> 1, self.asked, text))
            self.asked = None
        self.lines += 1

    def take(self, s: dict) -> None:
        if self.open.endswith("\r") and (s["ends"] or s["head"]):
            whole, self.open = self.open[:-1], self.open[:-1] if s["after_cr"] else ""
            if not s["after_cr"]:
                self.line(whole)
        if not s["ends"]:
            self.open += s["head"]
        else:
            self.line(self.open + s["head"])
            self.open = s["tail"]
            inner, start = s["ends"] - 1, 1
            if inner and self.asked is not None:
                self.line(s["first"])
                inner, start = inner - 1, 2
            if inner > 1:
                self.steps.append((s["path"], start, inner >> 1, self.lines >> 1, None, None))
                self.lines += inner & ~1
            if inner & 1:
                self.line(s["final"])
        if s["last"]:
            if self.open:
                self.line(self.open.removesuffix("\r"))
            if self.asked is not None:
                self.steps.append((None, None, None, self.lines >> 1, self.asked, None))
            self.open, self.asked = "", None


def _advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Takes the pieces of one file that are next in number; the summaries of later ones wait in the state."""
    next_, lines, asked, open_, early, done = state.get if state.exists else (0, 0, None, "", "[]", False)
    waiting = {s["piece"]: s for s in json.loads(early)}
    for frame in frames:
        for s in frame.drop(columns="file").astype(object).to_dict("records"):
            s = {k: None if v is None or v != v else v.item() if hasattr(v, "item") else v for k, v in s.items()}
            if not done and s["piece"] >= next_:
                held = waiting.setdefault(s["piece"], s)
                if s["path"] < held["path"]:
                    waiting[s["piece"]] = s
    f = _File(lines, asked, open_)
    while not done and next_ in waiting:
        s = waiting.pop(next_)
        f.take(s)
        done = s["last"]
        next_ += 1
    kept = [] if done else [waiting[n] for n in sorted(waiting)]
    state.update((next_, f.lines, f.asked, f.open, json.dumps(kept), done))
    columns = ["path", "start", "pairs", "pair_idx", "q", "a"]
    got = pd.DataFrame([*f.steps, (None, len(kept), int(done), next_, None, None)], columns=columns).astype({"start": "Int32", "pairs": "Int32", "pair_idx": "Int64"})
    got.insert(0, "file", key[0])
    yield got


def steps(pieces: DataFrame) -> DataFrame:
    """Streaming ``(file, path, start, pairs, pair_idx, q, a)``: pairs over the borders of pieces (q, a), odd last lines (q alone),
    for each piece, from which line on it holds how many pairs and the number of the first one (path), and for each file that moved
    its next piece as ``pair_idx``, the pieces that wait as ``start`` and 1 as ``pairs`` if it has ended (no path, no q)."""
    return summaries(pieces).groupBy("file").applyInPandasWithState(_advance, "file string, " + STEPS, STATE, "append", GroupStateTimeout.NoTimeout)


def _pairs_inside(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(file, pair_idx, question, answer) of the pairs inside pieces: each piece is read again, by its path, and paired in its row."""
    # names of the pieces of one micro-batch; the stream's own file index holds them too
    paths = [r.path for r in found.select(decode_uri_path(F.col("path")).alias("path")).distinct().toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "file string, pair_idx long, question string, answer string")
    with few_listing_tasks(spark):
        raw = spark.read.text(paths, wholetext=True)
    text = _piece_rows(raw).select("path", _parts("text").alias("parts"))
    lines = text.join(F.broadcast(found.select("file", "path", "start", "pairs", "pair_idx")), "path")  # a row a piece of the batch: no exchange carries the text
    lines = lines.select("file", "pair_idx", F.slice("parts", F.col("start") + 1, F.col("pairs") * 2).alias("lines"))
    zipped = F.zip_with("lines", F.slice("lines", 2, F.size("lines")), lambda q, a: F.struct(q.alias("q"), a.alias("a")))
    each = lines.select("file", "pair_idx", F.posexplode(zipped).alias("ln", "qa")).filter(F.col("ln") % 2 == 0)
    return each.select("file", (F.col("pair_idx") + F.shiftright("ln", 1)).alias("pair_idx"), strip(F.col("qa.q")).alias("question"), strip(F.col("qa.a")).alias("answer"))


def run_pieces(pieces: DataFrame, vocab: Vocabulary, out_path: str, checkpoint: str, cap: int | None = None) -> None:
    """Process every piece that is there now into ``<out>/pairs`` and ``<out>/unpaired``, then stop; a later run goes on with
    the state that the checkpoint holds.  Read them with ``ingest.read_stream_output``."""
    spark = pieces.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        # the state moves once a batch: what it gives is written before it is used
        at = f"{out_path}/steps/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at)
        got = spark.read.parquet(at)
        border = got.filter("path is null and a is not null").select("file", "pair_idx", strip(F.col("q")).alias("question"), strip(F.col("a")).alias("answer"))
        pairs = border.unionByName(_pairs_inside(spark, got.filter("path is not null")))
        tails = got.filter("path is null and q is not null and a is null").select("file", (F.col("pair_idx") * 2).alias("ln"), F.col("q").alias("text"))
        if cap is not None:
            pairs, tails = pairs.filter(F.col("pair_idx") < cap), tails.filter(F.col("ln") < 2 * cap)
        for name, df in (("pairs", encode_stream(named(pairs), vocab)), ("unpaired", named(tails))):
            df.write.mode("overwrite").parquet(f"{out_path}/{name}/batch={batch_id}")

    await_available(steps(pieces), write, checkpoint, "append")


def open_files(spark: SparkSession, out_path: str) -> DataFrame:
    """(file, folder, module, next_piece, waiting) of files whose last piece has not been taken yet."""
    seen = spark.read.parquet(f"{out_path}/steps").filter("path is null and q is null").groupBy("file")
    now = seen.agg(F.max_by(F.struct(F.col("pair_idx").alias("next_piece"), F.col("start").alias("waiting"), F.col("pairs").alias("done")), "batch").alias("s"))
    return named(now.select("file", "s.*").filter("done = 0").drop("done"))


# ----------------------------------------------------------------------------- whole files, by their listing
def stream_listing(spark: SparkSession, root_glob: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (path, length) of new files ``<root>/<folder>/<file>``; their content is not read."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    with few_listing_tasks(spark):
        raw = reader.load(root_glob)
    return raw.select("path", "length")


def run_listed(listing: DataFrame, vocab: Vocabulary, out_path: str, checkpoint: str, cap: int | None = None, **options) -> None:
    """Process every file that is there now, of any size, as ``ingest.run_available`` does; ``options`` are those of ``read_selected``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        pairs, tails = read_selected(batch.sparkSession, batch, samples_per_module=cap, **options)
        for name, df in (("pairs", encode_stream(pairs, vocab)), ("unpaired", tails.select(*FILE_KEYS, "ln", "text"))):
            df.write.mode("overwrite").parquet(f"{out_path}/{name}/batch={batch_id}")

    await_available(listing, write, checkpoint, "append")
