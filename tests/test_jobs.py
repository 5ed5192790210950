"""The cluster job steps, run in-process on the test session."""

import pytest

from textpairs.operators import vocab
from textpairs.plans import jobs
from textpairs.sources import files
from textpairs.streaming import ingest


def test_ingest_profile_prepare(spark, write_files, tmp_path):
    root = write_files({f"f{j}/m{i}.txt": "".join(f"q{k}+{i}\na{k}\n" for k in range(60)) for j in range(2) for i in range(3)})
    out = str(tmp_path / "out")
    from textpairs import session

    before = session.scratch_mark()
    jobs.main(["ingest", "--input", root, "--output", out, "--samples-per-module", "50"])
    pairs = spark.read.parquet(f"{out}/pairs")
    assert pairs.count() == 2 * 3 * 50
    jobs.main(["profile", "--input", f"{out}/pairs", "--output", f"{out}/profile"])
    assert spark.read.parquet(f"{out}/profile/length_stats").count() == 8
    jobs.main(["prepare", "--input", f"{out}/pairs", "--output", f"{out}/prep"])
    tr = spark.read.parquet(f"{out}/prep/batches_train")
    va = spark.read.parquet(f"{out}/prep/batches_val")
    assert tr.count() == 300 * 4 // 5 and va.count() == 300 - 240
    assert spark.read.parquet(f"{out}/prep/vocab").count() > 4
    assert spark.read.parquet(f"{out}/prep/encoded_train").count() == 300
    assert session.scratch_mark() == before  # each step removed only its own intermediates


def test_ingest_takes_whole_files_and_keeps_folder_names(spark, write_files, tmp_path):
    root = write_files({"007/m.txt": "q\na\n" * 10050, "7/m.txt": "q\na\n", "07/none.txt": "only\n"})
    out = str(tmp_path / "out")
    jobs.main(["ingest", "--input", root, "--output", out])
    pairs = spark.read.parquet(f"{out}/pairs")
    assert {r[0]: r[1] for r in pairs.groupBy("folder").count().collect()} == {"007": 10050, "7": 1}
    rep = {(r["folder"], r["module"]): (r["files"], r["pairs"]) for r in spark.read.parquet(f"{out}/report").collect()}
    assert rep[("007", "m")] == (1, 10050) and rep[("7", None)] == (1, 1) and rep[("07", "none")] == (1, 0) and rep[(None, None)] == (3, 10051)


def test_ingest_without_a_pair_fails(spark, write_files, tmp_path):
    root = write_files({"f/m.txt": "only\n"})
    with pytest.raises(ValueError, match="no rows in the ingested frame"):
        jobs.main(["ingest", "--input", root, "--output", str(tmp_path / "out")])


def test_stream_step_goes_on_where_it_stopped(spark, write_files, tmp_path):
    voc, out = str(tmp_path / "voc"), str(tmp_path / "out")
    write_files({"f/m.txt/0": "q\na\nq"})
    files.write_vocab(vocab.build_vocab(spark.createDataFrame([("q", "a")], "question string, answer string")), voc)
    args = ["stream", "--input", f"{tmp_path}/corpus/*/*/*", "--output", out, "--vocab", voc, "--checkpoint", str(tmp_path / "ck"), "--pieces"]
    jobs.main(args)
    assert ingest.read_stream_output(spark, out, "pairs").count() == 1
    write_files({"f/m.txt/1-last": "q\na"})
    jobs.main(args)
    got = ingest.read_stream_output(spark, out, "pairs")
    assert sorted((r["pair_idx"], r["question"], r["answer"]) for r in got.collect()) == [(0, "q", "a"), (1, "qq", "a")]
