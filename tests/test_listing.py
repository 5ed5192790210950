"""Files listed as a table, and directories of single keys written again."""

import pytest
from pyspark.sql import functions as F

from textpairs.sources import files


def _tree(write_files):
    return write_files({"fa/m1.txt": "q\na\n", "fb/m1.txt": "q1\na1\nodd\n", "fb/m2.txt": "x\ny", "f c/m1.txt": "q\n\n\na\n", "fb/_hidden.txt": "q\na\n", "fb/empty.txt": ""})


def test_listing_equals_the_driver_side_one(spark, write_files):
    root = _tree(write_files)
    table = files.file_table(spark, root)
    want = files.list_inputs(spark, root)
    rows = {(r.folder, r.name): r.length for r in table.collect()}
    assert set(rows) == {("fa", "m1.txt"), ("fb", "m1.txt"), ("fb", "m2.txt"), ("f c", "m1.txt")}  # an empty file has no row
    assert sum(rows.values()) == sum(want["sizes"].values())


@pytest.mark.parametrize("whole", [files.WHOLE_FILE_BYTES, -1])
def test_selected_files_read_as_by_name(spark, write_files, whole):
    root = _tree(write_files)
    table = files.file_table(spark, root)
    cols = ["folder", "module", "pair_idx", "question", "answer"]
    rows = lambda d: sorted(map(tuple, d.select(*cols).collect()))
    for folders, names in ((["fb", "fb", "nope"], None), (None, ["m1.txt", "zz"]), (["f c", "fa"], ["m1.txt"])):
        want, want_odd, _ = files.read_qa(spark, root, folders, names)
        got, odd = files.read_selected(spark, files.select_files(table, folders, names), whole_file_bytes=whole)
        assert rows(got) == rows(want)
        assert sorted(r.text for r in odd.collect()) == sorted(r.text for r in want_odd.collect())
    both = spark.createDataFrame([("fa", "m1.txt"), ("fb", "m2.txt"), ("fa", "m2.txt")], "folder string, name string")
    assert {(r.folder, r.name) for r in files.select_files(table, names=both).collect()} == {("fa", "m1.txt"), ("fb", "m2.txt")}
    with pytest.raises(ValueError):
        files.read_selected(spark, files.select_files(table, ["nope"]))
    with pytest.raises(TypeError):
        files.select_files(table, [1])


def test_a_key_written_again_replaces_itself_alone(spark, tmp_path):
    path = str(tmp_path / "split")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("", 5)], "key string, v int")
    write = lambda d: files.write_split(d, path, "key", only_keys=True)
    write(df.filter("key = 'a'"))
    write(df.filter("key <> 'a' or key is null"))
    write(df.filter("key = 'a'").withColumn("v", F.col("v") + 10))
    assert sorted((r.key is None, r.key or "", r.v) for r in files.read_split_table(spark, path).collect()) == [(False, "", 5), (False, "a", 11), (False, "a", 12), (False, "b", 3), (True, "", 4)]
    files.write_split(df.filter("key = 'b'"), path, "key")
    assert files.read_split_table(spark, path).count() == 1
