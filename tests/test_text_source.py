"""Hand goldens for the paired-line file source (SRC1-SRC8, H1)."""

import pytest
from pyspark.sql import functions as F

from textpairs.operators.pairing import pairs_from_lines
from textpairs.sources import files


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# read_qa routes small files through whole-file reads; -1 forces the numbered-line path
PATHS = pytest.mark.parametrize("whole", [files.WHOLE_FILE_BYTES, -1], ids=["whole-file", "line-numbers"])


def test_large_file_across_many_splits_keeps_order(spark, write_files):
    n = 50000
    root = write_files({"fa/m1.txt": "".join(f"q{i}\na{i}\n" for i in range(n))})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        lines = files.numbered_lines(spark, [f"{root}/fa/m1.txt"])
        assert lines.select("value").rdd.getNumPartitions() > 5
        pairs, unpaired, _ = files.read_qa(spark, root, samples_per_module=10**9, whole_file_bytes=-1)
        bad = pairs.filter(
            (F.col("question") != F.concat(F.lit("q"), F.col("pair_idx").cast("string")))
            | (F.col("answer") != F.concat(F.lit("a"), F.col("pair_idx").cast("string")))
        ).count()
        assert pairs.count() == n
        assert bad == 0
        assert unpaired.count() == 0
        assert pairs.agg(F.min("pair_idx"), F.max("pair_idx")).first() == (0, n - 1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@PATHS
def test_edge_files(spark, write_files, whole):
    root = write_files(
        {
            "fa/m1.txt": "q\na\n",
            "fb/m1.txt": "q0\r\n a0  \nq1\na1\nodd\n",
            "fb/m2.txt": "x\ny",
            "fb/m3.txt": "q\n\n\na\n",
            "fb/m4.txt": "x\ry\r",
            "fb/empty.txt": "",
            "fb/_hidden.txt": "q\na\n",
        }
    )
    pairs, unpaired, listing = files.read_qa(spark, root, folders=["fb", "missing"], whole_file_bytes=whole)
    got = _rows(pairs, "module", "pair_idx", "question", "answer")
    assert got == [
        ("m1", 0, "q0", "a0"),
        ("m1", 1, "q1", "a1"),
        ("m2", 0, "x", "y"),
        ("m3", 0, "q", ""),
        ("m3", 1, "", "a"),
        ("m4", 0, "x", "y"),
    ]
    assert _rows(unpaired, "module", "ln", "text") == [("m1", 4, "odd")]
    assert any(p.endswith("_hidden.txt") for p in listing["skipped_hidden"])
    assert files.listing_counts(listing) == {"folders": 1, "files": 5, "skipped_hidden": 1}
    # equal module names in two folders stay apart by folder
    allp, _, _ = files.read_qa(spark, root, whole_file_bytes=whole)
    assert _rows(allp.filter(F.col("module") == "m1"), "folder", "pair_idx") == [("fa", 0), ("fb", 0), ("fb", 1)]


@PATHS
def test_cap_before_odd_tail_and_fail_mode(spark, write_files, whole):
    root = write_files({"fb/cap.txt": "q\na\nodd\n", "fc/bad.txt": "q\na\nodd\n"})
    pairs, unpaired, _ = files.read_qa(spark, root, folders=["fb"], samples_per_module=1, on_unpaired="fail", whole_file_bytes=whole)
    assert _rows(pairs, "question", "answer") == [("q", "a")]
    assert unpaired.count() == 0
    pairs2, _, _ = files.read_qa(spark, root, folders=["fc"], on_unpaired="fail", whole_file_bytes=whole)
    with pytest.raises(Exception, match="unpaired"):
        pairs2.collect()


@PATHS
def test_names_and_errors(spark, write_files, whole):
    root = write_files({"f a/m.txt": "q\na\n", "f a/ab": "q\na\n"})
    pairs, _, _ = files.read_qa(spark, root, whole_file_bytes=whole)
    assert _rows(pairs, "folder", "module") == [("f a", ""), ("f a", "m")]
    with pytest.raises(ValueError):
        files.read_qa(spark, root, folders=["nope"])
    with pytest.raises(ValueError):
        files.read_qa(spark, root, files=["none.txt"])
    root2 = write_files({"g/_h.txt": "q\na\n", "g/ok.txt": "q\na\n"})
    with pytest.raises(ValueError):
        files.read_qa(spark, root2, folders=["g"], files=["_h.txt"])
    with pytest.raises(ValueError):
        files.read_qa(spark, root, samples_per_module=0)
    with pytest.raises(TypeError):
        files.read_qa(spark, root, samples_per_module=1.5)


def test_ingest_report_rollup(spark, write_files):
    root = write_files({"fa/m1.txt": "q\na\nq\na\n", "fb/m1.txt": "q\na\n", "fb/m2.txt": "q\na\n", "fb/none.txt": "q\n", "f c/m é.txt": "q\na\n"})
    pairs, _, listing = files.read_qa(spark, root)
    rep = {(r["folder"], r["module"]): (r["files"], r["pairs"]) for r in files.ingest_report(pairs, files.listed_files(spark, listing)).collect()}
    assert rep[("fa", "m1")] == (1, 2)
    assert rep[("fb", None)] == (3, 2)
    assert rep[("fb", "none")] == (1, 0)
    assert rep[("f c", "m é")] == (1, 1)
    assert rep[(None, None)] == (5, 5)


@PATHS
def test_marks_repeated_names_and_compressed_files(spark, write_files, whole):
    import gzip

    root = write_files({"fa/m001.txt": "\ufeffq0\na0\nq1\na1\nodd\n", "fb/other.txt": "x\ny\n"})
    with gzip.open(f"{root}/fa/z.txt.gz", "wb") as f:
        f.write(b"qz\naz\n")
    pairs, unpaired, listing = files.read_qa(spark, root, folders=["fa", "fa"], files=["m001.txt", "m001.txt", "z.txt.gz"], whole_file_bytes=whole)
    assert _rows(pairs, "question", "answer") == [("q0", "a0"), ("q1", "a1"), ("qz", "az")]
    assert _rows(unpaired, "ln", "text") == [(4, "odd")]
    assert len(listing["files"]) == 2 and len(listing["folders"]) == 1


def test_whole_files_by_default(spark, write_files):
    root = write_files({"fa/m.txt": "q\na\n" * 10001})
    assert files.read_qa(spark, root)[0].count() == 10001
    assert files.read_qa(spark, root, samples_per_module=7)[0].count() == 7


def test_line_path_sorts_no_aggregate_over_text(spark, write_files):
    root = write_files({"fa/m.txt": "q\na\n"})
    # the form that joins numbered lines: they are shuffled with their file alone
    pairs = files.named(pairs_from_lines(files.numbered_lines(spark, [f"{root}/fa/m.txt"]), ["file"])[0])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "folder" not in plan[plan.index("hashpartitioning(file") :]
    # the form that pairs inside splits: no shuffle at all
    plan = files.read_qa(spark, root, whole_file_bytes=-1)[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "hashpartitioning" not in plan


def test_split_and_layout_keep_odd_names(spark, tmp_path):
    rows = [(k, i) for i, k in enumerate(["", "7", "07", "007", None, "null", "a/b", "7"])]
    df = spark.createDataFrame(rows, "key string, v int")
    files.write_split(df, str(tmp_path / "s"), "key")
    got = {k: sorted(r["v"] for r in x.collect()) for k, x in files.read_split(spark, str(tmp_path / "s"), "key").items()}
    assert got == {None: [4], "": [0], "007": [3], "07": [2], "7": [1, 7], "a/b": [6], "null": [5]}
    root = str(tmp_path / "d")
    for m in ("007", "7", "a/b"):
        files.write_dataset(df.filter(F.col("key") == m).select("v"), root, "test", m, 5)
        files.write_dataset(df.filter(F.col("key") == m).select(F.array("v").alias("ids")), root, "test", m, 5, tokenized=True)
    assert [r["v"] for r in files.read_dataset(spark, root, "test", "007", 5).collect()] == [3]
    assert [r["ids"] for r in files.read_dataset(spark, root, "test", "a/b", 5, tokenized=True).collect()] == [[6]]
    assert files.read_dataset(spark, root, "test", "7", 5).columns == ["v"]


def test_csv_round_trip_keeps_quotes_empty_null(spark, tmp_path):
    rows = [
        ('say "hi", ok', "x", "f", "m"),
        ("q2", "", "f", "m"),
        ("q3", None, "f", "m"),
        ("q4", "None", "f", "m"),
        ("back\\slash", "multi\nline", "f", "m"),
        ("\\N", "\\\\N", "f", "m"),
        (" lead", "trail ", "\x01ctl", "ctl\x02"),
        ("\t", " ", "f", "m"),
    ]
    df = spark.createDataFrame(rows, files.QA_SCHEMA)
    path = str(tmp_path / "qa.csv")
    files.write_csv(df, path)
    back = files.read_csv(spark, path)
    assert back.columns == ["question", "answer", "folder", "module"]
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    nulled = files.read_csv(spark, path, na_values=["None"])
    assert nulled.filter(F.col("question") == "q4").first()["answer"] is None
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "missing.csv"))


def test_empty_csv_has_header(spark, tmp_path):
    df = spark.createDataFrame([], files.QA_SCHEMA)
    path = str(tmp_path / "empty.csv")
    files.write_csv(df, path, single_file=True)
    text = "".join(p.read_text() for p in (tmp_path / "empty.csv").glob("part-*"))
    assert text.strip() == "question,answer,folder,module"


def test_dataset_layout_naming():
    assert files.dataset_name("test", None, 5) == ("mixed", "interpolate")
    assert files.dataset_name("train", None, 5) == ("mixed", "mixed_5")
    assert files.dataset_name("test", "algebra", 5) == ("unique_module", "algebra")
    assert files.dataset_name("train", "algebra", 5) == ("unique_module", "algebra_5")
    with pytest.raises(ValueError):
        files.dataset_name("train", None, 0)
    with pytest.raises(ValueError):
        files.dataset_name("dev", None, 5)


def test_mixed_routing_equals_single_path(spark, write_files):
    root = write_files({"fa/big.txt": "".join(f"q{i}\na{i}\n" for i in range(3000)) + "tail\n", "fb/small.txt": "x\ny\nz\n"})
    mixed, mixed_u, _ = files.read_qa(spark, root, whole_file_bytes=1000)  # big.txt > 1000 bytes
    lines, lines_u, _ = files.read_qa(spark, root, whole_file_bytes=-1)
    cols = ["folder", "module", "pair_idx", "question", "answer"]
    assert _rows(mixed, *cols) == _rows(lines, *cols)
    assert _rows(mixed_u, "module", "ln", "text") == _rows(lines_u, "module", "ln", "text") == [("big", 6000, "tail"), ("small", 2, "z")]
