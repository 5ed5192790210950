"""Generated texts: in-row pairing equals a plain-Python model of the reference semantics."""

import io

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textpairs.operators.pairing import pairs_in_rows, unpaired_in_rows

ALPHABET = st.sampled_from(list("ab é😀") + ["\n", "\r", "\r\n", "\t", "　", " ", "​", "\x1c", " "])
TEXT = st.lists(ALPHABET, max_size=40).map("".join)


def model(text):
    """Python text-mode iteration (universal newlines) + str.strip, pairs of consecutive lines."""
    lines = [ln[:-1] if ln.endswith("\n") else ln for ln in io.StringIO(text, newline=None)]
    pairs = [(i // 2, lines[i].strip(), lines[i + 1].strip()) for i in range(0, len(lines) - 1, 2)]
    tail = [(len(lines) - 1, lines[-1])] if len(lines) % 2 else []
    return pairs, tail


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=30))
def test_pairs_match_python_model(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {}
    for r in pairs_in_rows(df, "text", ["k"]).collect():
        got.setdefault(r["k"], []).append((r["pair_idx"], r["question"], r["answer"]))
    tails = {r["k"]: [(r["ln"], r["text"])] for r in unpaired_in_rows(df, "text", ["k"]).collect()}
    for k, t in enumerate(texts):
        want_pairs, want_tail = model(t)
        assert sorted(got.get(k, [])) == want_pairs, repr(t)
        assert tails.get(k, []) == want_tail, repr(t)


LINE = st.lists(st.sampled_from(list("ab é")), min_size=0, max_size=30).map("".join)
END = st.sampled_from(["\n", "\r", "\r\n"])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(LINE, END), min_size=50, max_size=400), st.booleans())
def test_line_number_path_across_tiny_splits(spark, tmp_path_factory, lines, final_newline):
    from textpairs.sources import files

    text = "".join(a + b for a, b in lines)
    if not final_newline:
        text = text.rstrip("\r\n")
    root = tmp_path_factory.mktemp("corpus")
    (root / "f").mkdir()
    (root / "f" / "m.txt").write_bytes(text.encode("utf-8"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        pairs, unpaired, _ = files.read_qa(spark, str(root), samples_per_module=10**9, whole_file_bytes=-1)
        got = sorted((r["pair_idx"], r["question"], r["answer"]) for r in pairs.collect())
        tail = [(r["ln"], r["text"]) for r in unpaired.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want_pairs, want_tail = model(text)
    assert got == want_pairs
    assert tail == want_tail
