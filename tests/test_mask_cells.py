"""The L x L masks: odd rows, and one Python call a row for masks of masks."""

import __spark_entry__ as se
from textpairs.functions import arrays as A
from textpairs.operators.batching import mask_bits
from tests.conftest import SMALL


def test_null_ids_rows_and_cells(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [3]), (3, [2, None, 3, 5])], "k int, a array<int>")
    got = {r.k: r for r in df.select("k", A.trg_mask("a").alias("m"), A.shift_mask(A.trg_mask("a")).alias("s"), mask_bits(A.trg_mask("a")).alias("b")).collect()}
    assert (got[0].m, got[0].s, got[0].b) == (None, None, None)
    assert (got[1].m, got[1].s, got[1].b) == ([], [], [])
    assert (got[2].m, got[2].s, got[2].b) == ([[False]], [], ["0"])
    assert got[3].m == [[True, False, False, False], [True, None, False, False], [True, None, False, False], [True, None, False, True]]
    assert got[3].s == [[True, False, False], [True, None, False], [True, None, False]]
    assert got[3].b == ["1000", "1000", "1000", "1001"]
    odd = spark.createDataFrame([([None, [True, None], []],)], "m array<array<boolean>>")
    assert tuple(odd.select(A.shift_mask("m"), mask_bits("m")).first()) == ([None, [True]], [None, "10", ""])


def test_no_lambda_a_cell_and_one_call_a_row(spark):
    for name in ("trg_mask_matrix", "shifted_mask"):
        df = se.queries()[name](spark, SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BatchEvalPython") == 1 and "array_join" not in plan
        assert "_bits(" in plan
