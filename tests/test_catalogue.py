"""Every catalogue query against its DuckDB oracle on the smallest tables, plus the entry smoke."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as se
from textpairs.plans.catalogue import QUERIES
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, np.generic):
        return v.item()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["token", "freq", "id"]
    assert df.count() > 4


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    oracle = se.oracle_sql()
    got = se.queries()[name](spark, SMALL).toPandas()
    if name not in oracle:
        pytest.skip("no SQL form")
    want = con.execute(oracle[name]).fetchdf()
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", ["split_80_20", "shuffle_batches", "test_batches", "accuracy", "attn_pool", "file_source_lines"])
def test_same_result_without_aqe_ansi_and_other_partitioning(spark, con, name):
    keys = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled")
    old = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("false", "3", "false")):
        spark.conf.set(k, v)
    try:
        got = se.queries()[name](spark, SMALL).toPandas()
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    assert _rows(got) == _rows(con.execute(se.oracle_sql()[name]).fetchdf())
