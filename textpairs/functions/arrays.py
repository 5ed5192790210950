"""Array functions on id sequences (FUN3-FUN10, SRT7, VEC5) as Column expressions.

Built-in higher-order functions (``transform``, ``zip_with``, ``forall``, ``aggregate``) keep the work in the JVM, one row
at a time, without Python workers.  Two things are made in Python: ``trg_mask_digest`` hashes there, where rows that share mask
rows share their digests and what is sent is two numbers a row; and the L x L masks (``trg_mask``, ``shift_mask``,
``mask_bits``) are lists there, as a lambda of the JVM costs some 100 ns a cell.  Spark runs mask functions of each other in
one call a row, so that only ids go in and the last result comes out.
"""

from __future__ import annotations

from collections import OrderedDict
from hashlib import md5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from textpairs.fixed import BOS, EOS, PAD, SPECIALS, UNK  # noqa: F401  (re-exported)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wrap_ids(inner_ids) -> Column:
    """FUN4 framing: ``[<bos>] + ids + [<eos>]``."""
    return F.concat(F.array(F.lit(BOS)), _col(inner_ids), F.array(F.lit(EOS)))


def pad_to(ids, length) -> Column:
    """FUN6: right-pad with <pad> up to ``length`` (no-op when already that long)."""
    ids = _col(ids)
    n = _col(length) if not isinstance(length, int) else F.lit(length)
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(n - F.size(ids), F.lit(0))))


def src_mask(ids) -> Column:
    """FUN7: padding mask, ``id <> <pad>`` per position."""
    return F.transform(_col(ids), lambda x: x != F.lit(PAD))


MASK = ArrayType(ArrayType(BooleanType()))


def _mask_of(ids):
    if ids is None:
        return None
    valid = [None if x is None else x != PAD for x in ids]
    n = len(valid)
    return [valid[:i] + [False] * (n - i) for i in range(1, n + 1)]


def trg_mask(ids) -> Column:
    """FUN8 / WIN6: L x L mask, ``m[i][j] = ids[j] <> <pad> AND j <= i``.  O(L^2) per row.  A null id's cells up to i are null."""
    return F.udf(_mask_of, MASK, useArrow=False)(_col(ids))


def trg_mask_rows(ids, of_row=lambda bits: bits) -> Column:
    """FUN8 row by row: ``of_row`` of each mask row as a '0'/'1' string (the valid bits up to i, then zeros).

    The same cells as ``trg_mask``; only one row of L cells is held at a time if ``of_row`` shortens it.
    """
    ids = _col(ids)
    valid = F.array_join(F.transform(ids, lambda x: F.when(x != F.lit(PAD), "1").otherwise("0")), "")
    # the valid bits are bound once, so that they are not made again for every row
    rows = F.transform(F.array(valid), lambda v: F.transform(ids, lambda _y, i: of_row(F.rpad(F.substring(v, F.lit(1), i + 1), F.length(v), F.lit("0")))))
    return F.element_at(rows, 1)


#: bytes of row digests that a Python worker keeps, of the lengths used last
DIGEST_CACHE_BYTES = 64 << 20
_ROW_DIGESTS: OrderedDict[int, list] = OrderedDict()


def _row_digests(length: int, upto: int) -> memoryview:
    """The joined md5 of the mask rows with 0, 1, ... ``upto`` ones before zeros, ``length`` cells each; each row is built once a
    length and worker, from the state that the hash had after its ones."""
    held = _ROW_DIGESTS.pop(length, None) or [md5(), bytearray()]
    ones, done = held
    zeros = memoryview(bytes(b"0") * length)
    for k in range(len(done) // 32, upto + 1):
        if k:
            ones.update(b"1")
        row = ones.copy()
        row.update(zeros[: length - k])
        done += row.hexdigest().encode()
    _ROW_DIGESTS[length] = held
    kept = sum(len(d) for _, d in _ROW_DIGESTS.values())
    while kept > DIGEST_CACHE_BYTES and len(_ROW_DIGESTS) > 1:
        kept -= len(_ROW_DIGESTS.popitem(last=False)[1][1])
    return memoryview(bytes(done[: 32 * (upto + 1)]))


def _mask_digest(length: int, valid: int, bits: str | None) -> str:
    whole = md5()
    if bits is None:
        rows = _row_digests(length, valid)
        # from row ``valid`` on every mask row is the last one again
        whole.update(rows[32 : 32 * (min(valid, length) + 1)])
        whole.update(bytes(rows[32 * valid :]) * (length - valid))
    else:
        seen = md5()
        zeros = b"0" * length
        for i, bit in enumerate(bits.encode()):
            seen.update(b"01"[bit - 48 : bit - 47])
            row = seen.copy()
            row.update(zeros[i + 1 :])
            whole.update(row.hexdigest().encode())
    return whole.hexdigest()


def _mask_digests(length: pd.Series, valid: pd.Series, bits: pd.Series) -> pd.Series:
    return pd.Series([_mask_digest(int(n), int(v), b) for n, v, b in zip(length, valid, bits)], dtype=object)


def trg_mask_digest(ids) -> Column:
    """md5 of the md5 of every mask row: the whole L x L mask in one value, without holding it.

    Where all pads are at the end, the mask rows are those of the row's length and number of ids, whatever the ids are: rows of
    equal length share them.  Any other row gives all its valid bits.
    """
    ids = _col(ids)
    size = F.coalesce(F.size(ids), F.lit(0))
    pad = F.array_position(ids, F.lit(PAD))
    valid = F.coalesce(F.when(pad > 0, (pad - 1).cast("int")).otherwise(size), F.lit(0))
    # both tests run over the array once; a null id makes the first one null
    plain = F.coalesce(~F.array_contains(F.slice(ids, F.lit(1), valid), F.lit(PAD)), F.lit(False)) & (
        F.size(F.array_remove(F.slice(ids, valid + 1, F.greatest(size - valid, F.lit(0))), F.lit(PAD))) == 0
    )
    bits = F.when(~plain, F.array_join(F.transform(ids, lambda x: F.when(x != F.lit(PAD), "1").otherwise("0")), ""))
    digests = F.pandas_udf(_mask_digests, "string")
    return F.when(ids.isNotNull(), digests(size, valid, bits))


def valid_len(ids) -> Column:
    """Compact form of the masks: number of non-pad ids."""
    return F.size(F.filter(_col(ids), lambda x: x != F.lit(PAD)))


def shift_input(ids) -> Column:
    """FUN9: decoder input ``ids[:-1]``."""
    ids = _col(ids)
    return F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))


def shift_target(ids) -> Column:
    """FUN9: target ``ids[1:]``."""
    ids = _col(ids)
    return F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))


def shift_mask(mask) -> Column:
    """FUN9: ``mask[:-1, :-1]`` of an L x L mask."""
    return F.udf(_shifted, MASK, useArrow=False)(_col(mask))


def _shifted(mask):
    return None if mask is None else [None if row is None else row[:-1] for row in mask[:-1]]


_BITS = bytes.maketrans(b"\x00\x01", b"01")


def _row_bits(row):
    if row is None:
        return None
    try:
        return bytes(row).translate(_BITS).decode()
    except TypeError:  # a null cell
        return "".join("1" if x else "0" for x in row)


def mask_bits(mask) -> Column:
    """A boolean matrix as one '0'/'1' string per row; a null cell is 0."""
    return F.udf(_bits, ArrayType(StringType()), useArrow=False)(_col(mask))


def _bits(mask):
    return None if mask is None else [_row_bits(row) for row in mask]


def exact_match(target, prediction) -> Column:
    """FUN10: equal at every position, or the target is <pad> there; unequal sizes are false."""
    t, p = _col(target), _col(prediction)
    same = F.forall(F.zip_with(t, p, lambda a, b: (a == b) | (a == F.lit(PAD))), lambda x: x)
    return F.when(t.isNull() | p.isNull(), F.lit(None).cast("boolean")).otherwise(
        (F.size(t) == F.size(p)) & F.coalesce(same, F.lit(False))
    )


def argmax(values) -> Column:
    """SRT7: 0-based index of the largest element, ties to the lowest index."""
    v = _col(values)
    return (F.array_position(v, F.array_max(v)) - F.lit(1)).cast("int")


def log_sum_exp(values) -> Column:
    """Stable ``log(sum(exp(v)))`` of a numeric array, in double."""
    v = F.transform(_col(values), lambda x: x.cast("double"))
    m = F.array_max(v)
    return m + F.log(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m)))


def cross_entropy_at(logits, target) -> Column:
    """VEC5 / AGG12 row form: ``-log softmax(logits)[target]`` (target is a 0-based id)."""
    lg = _col(logits)
    t = _col(target)
    return log_sum_exp(lg) - F.element_at(lg, t + F.lit(1)).cast("double")


def softmax(values) -> Column:
    """VEC5: softmax of a numeric array, in double."""
    v = F.transform(_col(values), lambda x: x.cast("double"))
    m = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m))
    return F.transform(v, lambda x: F.exp(x - m) / total)


def hadamard(a, b) -> Column:
    """VEC4: element-wise product, in double."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
