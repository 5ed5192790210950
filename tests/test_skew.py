"""One key holding most of the rows: results stay exact, plans keep the work spread."""

import math

import numpy as np
from pyspark.sql import functions as F

from textpairs.operators import profile, vectors


def test_hot_conversation_pairs_by_join(spark, tmp_path):
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(3000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c}t{t}") for c in range(1, 200) for t in range(4)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    from textpairs.sources import tables

    got = tables.qa_conv(spark, str(tmp_path))
    assert got.count() == 1500 + 199 * 2
    assert got.filter((F.col("conv_id") == 0) & (F.col("turn") == 2998)).first()["answer"] == "t2999"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_long_sequence_attention_is_exact_and_spread(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(g, i, [float(x) for x in rng.normal(size=4)]) for g in range(1, 6) for i in range(3)]
    df = spark.createDataFrame(rows, "g int, pos long, v array<float>")
    att = vectors.attention(df, "g", "pos", "v", causal=True, max_len=300, block_size=16)
    plan = att._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    assert "hashpartitioning(seq" in plan and ", blk" in plan[plan.index("hashpartitioning(seq") :].split(")")[0]
    out = {(r["g"], r["q_pos"]): r for r in att.collect()}
    assert len(out) == len(rows)
    hot = [(p, np.array(v, dtype=np.float32).astype(np.float64)) for g, p, v in rows if g == 0]
    for qp, qv in hot[::37]:
        keys = [kv for kp, kv in hot if kp <= qp]
        s = np.array([qv @ kv / 2.0 for kv in keys])
        w = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert np.allclose(out[(0, qp)]["pooled"], sum(wi * kv for wi, kv in zip(w, keys)), rtol=1e-9, atol=1e-12)
        assert math.isclose(out[(0, qp)]["log_norm"], s.max() + math.log(np.exp(s - s.max()).sum()), rel_tol=1e-9)


def test_hot_value_counts_and_box_stats(spark):
    rows = [("hot", "x" * (i % 50)) for i in range(5000)] + [(f"k{i}", "y" * i) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "folder string, question string")
    vc = {r["folder"]: r["count"] for r in profile.value_counts(df, "folder").collect()}
    assert vc["hot"] == 5000 and len(vc) == 40
    box = {r["folder"]: r for r in profile.box_stats(df, "question", "folder").collect()}
    lens = np.array([i % 50 for i in range(5000)])
    q1, med, q3 = np.percentile(lens, [25, 50, 75])
    assert (box["hot"]["q1"], box["hot"]["median"], box["hot"]["q3"]) == (q1, med, q3)
    assert box["hot"]["n"] == 5000 and box["hot"]["n_outliers"] == 0
