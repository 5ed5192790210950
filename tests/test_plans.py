"""Plan shape checks: no single-partition exchange over row data, filters reach the scan."""

from textpairs.plans import catalogue
from tests.conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairing_is_narrow(spark):
    plan = _plan(catalogue.q_qa_pairs(spark, SMALL))
    assert "SinglePartition" not in plan
    assert "Window" not in plan


def test_encode_has_no_join_and_no_single_partition(spark):
    plan = _plan(catalogue.q_encode(spark, SMALL))
    assert "Join" not in plan and "SinglePartition" not in plan


def test_selection_pushed_to_scan(spark):
    df = catalogue.q_folder_selected(spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lang" in plan or "PushedFilters: [IsNotNull(lang), In(lang" in plan


def test_split_is_a_row_predicate(spark):
    plan = _plan(catalogue.q_split_80_20(spark, SMALL))
    assert "Window" not in plan and "SinglePartition" not in plan


def test_conversation_pairs_join_on_turn_not_window(spark):
    plan = _plan(catalogue.q_qa_conv(spark, SMALL))
    assert "Window" not in plan


def test_join_encode_fallback_broadcasts_the_vocabulary(spark):
    from textpairs.operators import vocab

    df = spark.createDataFrame([(1, "ab"), (2, "ba a")], "k long, question string")
    v = vocab.build_vocab(df.withColumn("answer", df.question))
    out = vocab.encode_by_join(df, v, ["k"], "question", "question_ids")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert {r["k"]: r["question_ids"] for r in out.collect()} == {
        r["k"]: r["question_ids"] for r in vocab.encode_columns(df, vocab.Vocabulary.from_df(v), ("question",)).collect()
    }


def test_lines_of_large_files_are_not_exchanged(spark, write_files):
    """Pairs inside a split are made where they are read: the one exchange is the broadcast of the splits' numbers."""
    from textpairs.sources import files

    root = write_files({"fa/m1.txt": "".join(f"q{i}\na{i}\n" for i in range(3000)) + "odd\n"})
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "1000")
    try:
        pairs, unpaired, _ = files.read_qa(spark, root, whole_file_bytes=-1)
        plan = _plan(pairs)
        inside = plan[: plan.index("FileScan text")]
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "Sort " not in inside
        assert plan.count("FileScan text") == 1  # the text is read once beside the count
        got = sorted((r.pair_idx, r.question, r.answer) for r in pairs.collect())
        assert got == [(i, f"q{i}", f"a{i}") for i in range(3000)]
        assert [(r.ln, r.text) for r in unpaired.collect()] == [(6000, "odd")]
    finally:
        spark.conf.set(conf, before)
