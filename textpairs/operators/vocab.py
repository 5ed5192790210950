"""Character vocabulary: counting, building, encoding, decoding (AGG1, AGG2, SRT5, JOI1, JOI2, FUN3, FUN4).

Each task counts code points into an array as long as the code space, batch by batch, and sends one
row a distinct character, so the shuffle carries at most (distinct characters x partitions) rows.

The vocabulary itself is bounded by the Unicode code space (1,114,112 code points plus
four specials), so it may be held on the driver and shipped inside the plan.  Encoding
uses a dense id array indexed by code point (one literal of at most 1,114,112 integers) -
O(1) per character, all JVM-side, for a vocabulary of any size.  ``encode_by_join`` is the
same by a join, for vocabularies that exist only as a table.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpairs.functions.arrays import BOS, EOS, SPECIALS, UNK, wrap_ids
from textpairs.functions.text import chars


def array_literal(values: list, element_type: str) -> Column:
    """A constant array built from one JSON string: one call into the JVM instead of one per
    element, and constant-folded by the optimizer into a single literal."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), f"array<{element_type}>")


CODE_SPACE = 0x110000
#: bytes of text that are held as code points at once
COUNT_BYTES = 4 << 20


def _count_chars(batches):
    counts = np.zeros(CODE_SPACE, np.int64)
    for batch in batches:
        for column in batch.columns:
            texts = column.cast(pa.large_binary())
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            lo = 0
            while off[lo] < off[-1]:  # a null has no bytes; cuts stand between texts
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + COUNT_BYTES, "right")) - 1)
                part = texts.buffers()[2].slice(off[lo], off[hi] - off[lo]).to_pybytes().decode("utf-8", "replace")
                found = np.bincount(np.frombuffer(part.encode("utf-32-le"), np.uint32))
                counts[: len(found)] += found
                lo = hi
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array([chr(i) for i in at.tolist()], pa.string()), pa.array(counts[at])], names=["token", "freq"])


def char_freq(df: DataFrame, cols=("question", "answer")) -> DataFrame:
    """AGG1 / SET3: (token, freq) over the characters of all given columns together."""
    counted = df.select(*cols).mapInArrow(_count_chars, "token string, freq long")
    return counted.groupBy("token").agg(F.sum("freq").alias("freq"))


def build_vocab(df: DataFrame, cols=("question", "answer"), specials=SPECIALS) -> DataFrame:
    """AGG2: (token, freq, id) - specials first (freq 0: never counted as characters), then by freq desc, token asc.

    The ordering window has no partition key on purpose: its input is one row per
    distinct character (bounded by the code space), never row-level data.
    """
    freq = char_freq(df, cols).filter(~F.col("token").isin(list(specials)))
    ranked = freq.withColumn(
        "id", (F.row_number().over(Window.orderBy(F.desc("freq"), F.asc("token"))) + F.lit(len(specials) - 1)).cast("int")
    )
    spark = df.sparkSession
    sp = spark.createDataFrame([(t, 0, i) for i, t in enumerate(specials)], "token string, freq long, id int")
    return sp.unionByName(ranked.select("token", "freq", "id"))


@dataclass(frozen=True)
class Vocabulary:
    """Driver-side lookup tables of a (bounded) vocabulary: ``itos[id] = token``."""

    itos: tuple[str, ...]

    @staticmethod
    def from_df(vocab: DataFrame) -> "Vocabulary":
        # a character vocabulary has at most 1,114,112 + 4 rows (the code space): one collect
        rows = vocab.select("token", "id").collect()
        n = len(rows)
        ids = sorted(r["id"] for r in rows)
        if ids != list(range(n)):
            raise ValueError("vocabulary ids must be dense 0..V-1")
        itos = [None] * n
        for r in rows:
            itos[r["id"]] = r["token"]
        if tuple(itos[: len(SPECIALS)]) != SPECIALS:
            raise ValueError(f"vocabulary must start with the specials {SPECIALS}")
        bad = [t for t in itos[len(SPECIALS):] if t is None or len(t) != 1]
        if bad:
            raise ValueError(f"character vocabulary holds tokens that are not one code point: {bad[:5]}")
        return Vocabulary(tuple(itos))

    @staticmethod
    def from_freq(freq: DataFrame, specials=SPECIALS) -> "Vocabulary":
        """AGG2 on the driver from the character counts (<= code-space rows, one job):
        specials, then freq desc, token asc (Python str order = code-point order = Spark's)."""
        rows = freq.select("token", "freq").collect()
        toks = sorted(((r["token"], r["freq"]) for r in rows if r["token"] not in specials), key=lambda tf: (-tf[1], tf[0]))
        return Vocabulary(tuple(specials) + tuple(t for t, _ in toks))

    @property
    def size(self) -> int:
        return len(self.itos)

    @property
    def fingerprint(self) -> str:
        return hashlib.md5("\x00".join(self.itos).encode("utf-8")).hexdigest()

    def stoi(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.itos)}

    def lookup(self):
        """Returns ``f(char_col) -> id_col`` (OOV -> <unk>)."""
        points = {ord(t): i for i, t in enumerate(self.itos) if len(t) == 1}
        dense = [UNK] * (max(points, default=-1) + 1)
        for cp, i in points.items():
            dense[cp] = i
        if not dense:
            return lambda c: F.lit(UNK)
        table = array_literal(dense, "int")
        return lambda c: F.coalesce(F.try_element_at(table, F.ascii(c) + F.lit(1)), F.lit(UNK))

    def encode(self, text) -> Column:
        """FUN4: ``[<bos>] + ids(chars) + [<eos>]``; null text stays null."""
        t = F.col(text) if isinstance(text, str) else text
        f = self.lookup()
        return F.when(t.isNull(), F.lit(None)).otherwise(wrap_ids(F.transform(chars(t), f)))

    def decode(self, ids, strip_special: bool = False) -> Column:
        """FUN3: ids -> tokens joined.  ``strip_special`` drops a leading <bos> and stops at the first <eos>."""
        i = F.col(ids) if isinstance(ids, str) else ids
        itos = array_literal(list(self.itos), "string")
        if strip_special:
            body = F.when(F.element_at(i, 1) == F.lit(BOS), F.slice(i, 2, F.size(i))).otherwise(i)
            stop = F.array_position(body, F.lit(EOS))
            i = F.when(stop > 0, F.slice(body, 1, (stop - 1).cast("int"))).otherwise(body)
        toks = F.transform(i, lambda x: F.coalesce(F.try_element_at(itos, x + F.lit(1)), F.lit(SPECIALS[UNK])))
        return F.array_join(toks, "")


def id_bytes(size: int) -> int:
    """Bytes that hold any id of a vocabulary of ``size`` tokens."""
    return 1 if size <= 1 << 8 else 2 if size <= 1 << 16 else 4


def pack_ids(ids, width: int) -> Column:
    """Ids as bytes, ``width`` each, so that an exchange carries no four bytes an id; null stays null."""

    def pack(lists: pa.Array) -> pa.Array:
        values = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        if len(values) and not 0 <= values.min() <= values.max() < 1 << 8 * width:
            raise ValueError(f"ids of {width} bytes: found {values.min()} to {values.max()}")
        off = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy() * width))).astype(np.int32)
        there = pa.py_buffer(np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little")) if lists.null_count else None
        return pa.Array.from_buffers(pa.binary(), len(lists), [there, pa.py_buffer(off), pa.py_buffer(values.astype(f"<u{width}").tobytes())])

    return F.arrow_udf(pack, "binary")(ids)


def unpack_ids(packed, width: int) -> Column:
    """The ids of ``pack_ids``."""

    def unpack(rows: pa.Array) -> pa.Array:
        rows = rows.cast(pa.binary())
        off = np.concatenate(([0], np.cumsum(pc.binary_length(rows).fill_null(0).to_numpy() // width))).astype(np.int32)
        _, ends, data = rows.buffers()
        first, last = np.frombuffer(ends, np.int32)[[rows.offset, rows.offset + len(rows)]] if len(rows) else (0, 0)
        values = np.frombuffer(data if data is not None else b"", np.uint8)[first:last].view(f"<u{width}").astype(np.int32)  # a null has no bytes
        return pa.ListArray.from_arrays(pa.array(off), pa.array(values), mask=rows.is_null())

    return F.arrow_udf(unpack, "array<int>")(packed)


def encode_columns(df: DataFrame, vocab: Vocabulary, cols=("question", "answer"), suffix="_ids") -> DataFrame:
    """Adds ``<col>_ids array<int>`` for each text column."""
    return df.withColumns({f"{c}{suffix}": vocab.encode(c) for c in cols})


def encode_by_join(df: DataFrame, vocab: DataFrame, key_cols: list[str], col: str, out: str) -> DataFrame:
    """FUN4 for vocabularies too large to inline: explode / broadcast equi-join / ordered regroup.

    Costs a shuffle by the row key (the regroup); each group is one row's characters.
    """
    ex = df.select(*key_cols, F.posexplode(chars(col)).alias("pos", "token"))
    # Broadcast: a character vocabulary has at most 1,114,112 + 4 entries (the code
    # space), a proven bound; a shuffle join on the token would send every blank of
    # the corpus to one task.
    ids = ex.join(F.broadcast(vocab.select("token", "id")), "token", "left").select(
        *key_cols, "pos", F.coalesce("id", F.lit(UNK)).alias("id")
    )
    regrouped = ids.groupBy(*key_cols).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("__s"))
    body = regrouped.select(*key_cols, wrap_ids(F.transform("__s", lambda s: s["id"])).alias(out))
    return df.join(body, key_cols, "left").withColumn(
        out, F.when(F.col(col).isNull(), F.lit(None)).otherwise(F.coalesce(F.col(out), wrap_ids(F.array().cast("array<int>"))))
    )
