"""Edge cases of the column functions."""

from pyspark.sql import functions as F

from textpairs.functions import arrays as A
from textpairs.functions.text import decode_uri_path, drop_last4, round1
from textpairs.operators import vocab

def test_shift_pad_and_masks_on_short_arrays(spark):
    df = spark.createDataFrame([([2, 1],), ([2],), ([],)], "ids array<int>")
    rows = df.select(
        A.shift_input("ids").alias("i"), A.shift_target("ids").alias("t"), A.pad_to("ids", 3).alias("p"),
        A.src_mask("ids").alias("m"), A.valid_len(A.pad_to("ids", 4)).alias("v"),
    ).collect()
    assert [(r["i"], r["t"], r["p"], r["m"], r["v"]) for r in rows] == [
        ([2], [1], [2, 1, 3], [True, True], 2),
        ([], [], [2, 3, 3], [True], 1),
        ([], [], [3, 3, 3], [], 0),
    ]
    assert df.select(A.pad_to("ids", 1).alias("p")).first()["p"] == [2, 1]  # never truncates

def test_decode_strip_special(spark):
    voc = vocab.Vocabulary(("<unk>", "<eos>", "<bos>", "<pad>", "a", "b"))
    df = spark.createDataFrame([([2, 4, 5, 1, 3, 3],), ([2, 4, 1, 4, 1],), ([4, 9, 5],)], "ids array<int>")
    full = [r[0] for r in df.select(voc.decode("ids")).collect()]
    cut = [r[0] for r in df.select(voc.decode("ids", strip_special=True)).collect()]
    assert full == ["<bos>ab<eos><pad><pad>", "<bos>a<eos>a<eos>", "a<unk>b"]
    assert cut == ["ab", "a", "a<unk>b"]

def test_text_helpers(spark):
    df = spark.createDataFrame([("file:/x/f%20a/m%2Bn+.txt", "m.txt", 2.25), ("file:/y/abc", "abc", 2.35)], "p string, n string, v double")
    rows = df.select(decode_uri_path("p").alias("d"), drop_last4("n").alias("m"), round1("v").alias("r")).collect()
    assert [(r["d"], r["m"], r["r"]) for r in rows] == [("file:/x/f a/m+n+.txt", "m", 2.2), ("file:/y/abc", "", 2.4)]

def test_trg_mask_shape_and_causality(spark):
    df = spark.createDataFrame([([2, 5, 1, 3],)], "a array<int>")
    m = df.select(A.trg_mask("a")).first()[0]
    assert m == [
        [True, False, False, False],
        [True, True, False, False],
        [True, True, True, False],
        [True, True, True, False],
    ]


def test_argmax_long_ties_go_to_lowest_id(spark):
    from textpairs.operators.evaluate import argmax_long

    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 2.0), (1, 2, 2.0), (2, 5, -1.0), (2, 3, -1.0)], "k long, id long, v double")
    assert sorted(tuple(r) for r in argmax_long(df, ["k"], "id", "v").collect()) == [(1, 1), (2, 3)]
    arr = spark.createDataFrame([([0.5, 2.0, 2.0],)], "l array<double>").select(A.argmax("l")).first()[0]
    assert arr == 1
