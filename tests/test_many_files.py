"""Many small files: listed in a few tasks, and a table split by many small keys has few files."""

from pyspark.sql import functions as F

from textpairs.session import LISTING_PER_CORE, few_listing_tasks
from textpairs.sources import files
from textpairs.streaming import ingest

KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
N = 90


def _most_tasks(spark, name, action):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    out = action()
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds]
    return out, max(s.numTasks for s in stages)


def test_files_are_listed_in_a_few_tasks_a_core(spark, write_files):
    root = write_files({f"fold{i % 3}/m{i}.txt": f"q{i}\na{i}\n" for i in range(N)})
    most = LISTING_PER_CORE * spark.sparkContext.defaultParallelism
    assert most < N
    before = spark.conf.get(KEY, None)
    (pairs, _tails, listing), tasks = _most_tasks(spark, "batch", lambda: files.read_qa(spark, root))
    assert len(listing["files"]) == N and tasks <= most
    assert {(r.question, r.answer) for r in pairs.collect()} == {(f"q{i}", f"a{i}") for i in range(N)}
    _, tasks = _most_tasks(spark, "stream", lambda: ingest.stream_files(spark, root + "/*/*"))
    assert tasks <= most
    assert spark.conf.get(KEY, None) == before


def test_a_sessions_own_number_of_listing_tasks_stays(spark):
    spark.conf.set(KEY, "7")
    try:
        with few_listing_tasks(spark):
            assert spark.conf.get(KEY) == "7"
        assert spark.conf.get(KEY) == "7"
    finally:
        spark.conf.unset(KEY)


def _files_by_key(spark, df, path):
    files.write_split(df, path, "key")
    back = spark.read.parquet(path).select("key", "n", F.col("_metadata.file_path").alias("f"))
    return {r.key: r.c for r in back.groupBy("key").agg(F.count_distinct("f").alias("c")).collect()}


def test_small_keys_have_one_file_each(spark, tmp_path):
    df = spark.range(4000).select(F.concat(F.lit("k"), F.col("id") % 40).alias("key"), F.col("id").alias("n"))
    path = str(tmp_path / "small")
    assert _files_by_key(spark, df, path) == {f"k{i}": 1 for i in range(40)}
    assert sorted(r.n for r in files.read_split_table(spark, path).collect()) == list(range(4000))


def test_a_key_of_most_rows_is_written_by_many_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    df = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") < 39_000, "hot").otherwise("cold").alias("key"), F.col("id").alias("n"))
    spark.conf.set(size, "32k")
    try:
        found = _files_by_key(spark, df, str(tmp_path / "hot"))
    finally:
        spark.conf.unset(size)
    assert found["hot"] > 2
    assert files.read_split_table(spark, str(tmp_path / "hot")).count() == 40_000
