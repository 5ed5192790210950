"""STR1 for files larger than a row: numbered pieces with state, and whole files by their listing."""

import random

import pytest
from pyspark.sql import functions as F

from textpairs.operators import vocab
from textpairs.plans import flows
from textpairs.sources import files
from textpairs.streaming import ingest, pieces

VOC = vocab.Vocabulary(("<unk>", "<eos>", "<bos>", "<pad>", "q", "a", "1", "2"))
COLS = ["folder", "module", "pair_idx", "question", "answer"]


def _cut(text: str, n: int, rng: random.Random) -> list[str]:
    at = sorted(rng.randrange(len(text) + 1) for _ in range(n - 1))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


TEXTS = {
    "fa/long.txt": "".join(f"q{i} é\r\na{i}\n" for i in range(200)) + "tail",
    "fa/cr.txt": "q0\ra0\r\rq1\r\n\r\na1\r",
    "fb/one.txt": "only",
    "fb/mark.txt": "﻿q\na\n",
    "fb/wide.txt": "q" * 300 + "\n" + "a" * 300 + "\nq\n",
    "fb/blank.txt": "\n\n\n",
}


def _state(text: str, cuts: list[str]):
    """All lines in pairs by the state alone, as a plain loop over the summaries."""
    f = pieces._File(0, None, "")
    out = {}
    import re

    for i, c in enumerate(cuts):
        parts = re.split(pieces.LINE_ENDS.replace(r"\z", r"\Z"), c)
        ends = len(parts) - 1
        s = {"path": str(i), "last": i == len(cuts) - 1, "after_cr": c.startswith("\n"), "ends": ends, "head": parts[0], "tail": parts[-1]}
        s |= {"first": parts[1] if ends > 1 else None, "final": parts[ends - 1] if ends > 1 else None}
        f.steps = []
        f.take(s)
        for path, start, n, idx, q, a in f.steps:
            if path is None:
                assert idx not in out
                out[idx] = (q, a)
            else:
                for j in range(n):
                    assert idx + j not in out
                    out[idx + j] = (parts[start + 2 * j], parts[start + 2 * j + 1])
    return [out[i] for i in range(len(out))]


def test_state_equals_whole_text_for_any_cut():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", "\n", "\r", "\r\n"]) for _ in range(rng.randrange(14)))
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        lines = lines if lines[-1] else lines[:-1]
        want = [(lines[i], lines[i + 1] if i + 1 < len(lines) else None) for i in range(0, len(lines), 2)]
        cuts = _cut(text, rng.randrange(1, 7), rng)
        assert _state(text, cuts) == want, (text, cuts)


@pytest.mark.parametrize("per_batch", [None, 7])
def test_pieces_with_a_restart_equal_whole_files(spark, write_files, tmp_path, per_batch):
    root = write_files(TEXTS)
    whole, tails, _ = files.read_qa(spark, root)
    rng = random.Random(11)
    cut, out, ck = tmp_path / "cut", str(tmp_path / "out"), str(tmp_path / "ck")
    todo = []
    for name, text in TEXTS.items():
        parts = [p for p in _cut(text, 9, rng) if p]
        todo += [(cut / name / (f"{i:05d}" + ("-last" if i == len(parts) - 1 else "")), p) for i, p in enumerate(parts)]
    rng.shuffle(todo)  # pieces come in any order

    def run():
        pieces.run_pieces(pieces.stream_pieces(spark, f"{cut}/*/*/*", per_batch), VOC, out, ck)

    for part in (todo[: len(todo) // 2], todo[len(todo) // 2 :]):
        for path, text in part:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text.encode())
        run()  # the second run starts from the state of the first
    got = ingest.read_stream_output(spark, out, "pairs")
    assert _rows(got, COLS) == _rows(whole, COLS)
    odd = ["folder", "module", "ln", "text"]
    assert _rows(ingest.read_stream_output(spark, out, "unpaired"), odd) == _rows(tails, odd)
    assert len(_rows(tails, odd)) == 4
    assert pieces.open_files(spark, out).count() == 0
    ids = {r["pair_idx"]: r["question_ids"] for r in got.filter("module = 'mark'").collect()}
    assert ids == {0: [2, 4, 1]}
    run()
    assert got.count() == len(_rows(whole, COLS))


def test_no_exchange_carries_the_text(spark, tmp_path):
    p = spark.createDataFrame([("f", 0, True, "f/0", "q\na\n")], "file string, piece long, last boolean, path string, text string")
    assert pieces.summaries(p).columns == ["file", "piece", "last", "path", "after_cr", "ends", "head", "first", "final", "tail"]


def test_odd_pieces(spark, write_files, tmp_path):
    root = write_files({"f/m.txt/0": "q\n", "f/m.txt/1-last": "a\n", "f/m.txt/01": "z\n", "f/m.txt/2": "late\n", "f/n.txt/1-last": "waits\n", "f/e.txt/0-last": "\n"})
    out = str(tmp_path / "out")
    pieces.run_pieces(pieces.stream_pieces(spark, root + "/*/*/*"), VOC, out, str(tmp_path / "ck"), cap=1)
    # of two pieces of one number the first path counts: 01 has no end mark, 2 follows
    assert _rows(ingest.read_stream_output(spark, out, "pairs"), COLS) == [("f", "m", 0, "q", "z")]
    assert _rows(ingest.read_stream_output(spark, out, "unpaired"), ["module", "ln", "text"]) == [("e", 0, "")]
    assert _rows(pieces.open_files(spark, out), ["module", "next_piece", "waiting"]) == [("m", 3, 0), ("n", 0, 1)]
    bad = write_files({"g/m.txt/first": "q\n"})
    with pytest.raises(Exception, match="no piece number"):
        pieces.run_pieces(pieces.stream_pieces(spark, bad + "/g/*/*"), VOC, str(tmp_path / "o2"), str(tmp_path / "c2"))


@pytest.mark.parametrize("whole_file_bytes", [-1, 20])
def test_listed_files_of_any_size(spark, write_files, tmp_path, whole_file_bytes):
    root = write_files(TEXTS)
    whole, tails, _ = files.read_qa(spark, root)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):
        pieces.run_listed(pieces.stream_listing(spark, root + "/*/*", 4), VOC, out, ck, whole_file_bytes=whole_file_bytes)
        assert _rows(ingest.read_stream_output(spark, out, "pairs"), COLS) == _rows(whole, COLS)
        odd = ["folder", "module", "ln", "text"]
        assert _rows(ingest.read_stream_output(spark, out, "unpaired"), odd) == _rows(tails, odd)


def _docs(spark, tmp_path, rows):
    sf = tmp_path / "sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(sf / "documents.parquet"))
    return str(sf)


def test_number_of_pieces_follows_the_text_not_the_documents(spark, tmp_path, monkeypatch):
    """Documents of one file: one piece for each full ``PIECE_BYTES`` at most and one more, and the same pairs as from whole files."""
    rows = [(i, f"q{i}\nanswer {i}\n", "en", "web") for i in range(0, 4000, 7)] + [(4001, "x\n" * 9, "en", "web")]
    rows += [(22, "twice\n", "en", "web"), (22, "twice\n", "en", "web"), (5, None, "en", "web"), (6, "", "en", "web"), (8, "a\nb", None, "web"), (None, "a\nb", "en", "web"), (9, "a\nb", "en", None)]
    sf = _docs(spark, tmp_path, rows)
    files_of = lambda: [r.p for r in spark.read.text(flows.write_doc_pieces(spark, sf) + "/*/*/*/*").select(F.col("_metadata.file_path").alias("p")).distinct().collect()]
    assert len(files_of()) == 3  # ranges of 400 ids gave 12
    size = sum(len(t) for _, t, lang, _s in rows if t and lang)
    monkeypatch.setattr(flows, "PIECE_BYTES", 500)
    cut = files_of()
    assert 10 < len(cut) <= size // 500 + 3
    root = flows.write_doc_pieces(spark, sf)
    monkeypatch.setattr(pieces, "BATCH_PIECES", 4)  # many micro-batches
    got, tails = flows.stream_pieces(spark, root, VOC)
    whole = tables_pairs(rows)
    assert sorted((r.file.split("/")[-2], r.pair_idx, r.question, r.answer) for r in got.collect()) == whole
    assert [(r.ln, r.text) for r in tails.collect()] == [(8, "x")]


def tables_pairs(rows):
    """Pairs of the files as a plain loop: texts by folder in order of their ids, lines of one id side by side."""
    lines = {}
    for i, t, lang, source in rows:
        if t and i is not None and source is not None:
            for n, x in enumerate(t.splitlines()):
                lines.setdefault("folder=" + "__".join(x for x in (lang, source, str(i // 4000)) if x), []).append((i, n, x))
    out = []
    for folder, found in lines.items():
        found = [x for _, _, x in sorted(found)]
        out += [(folder, i // 2, found[i], found[i + 1]) for i in range(0, len(found) - 1, 2)]
    return sorted(out)


def test_the_second_read_of_pieces_is_not_shuffled(spark, write_files):
    root = write_files({"f/m.txt/0-last": "q\na\nq1\na1\n"})
    path = spark.read.text(root + "/*/*/*").select(F.col("_metadata.file_path")).first()[0]
    found = spark.createDataFrame([("f", path, 0, 2, 0)], "file string, path string, start int, pairs int, pair_idx long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = pieces._pairs_inside(spark, found)
        assert sorted((r.pair_idx, r.question, r.answer) for r in got.collect()) == [(0, "q", "a"), (1, "q1", "a1")]
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
