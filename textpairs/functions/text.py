"""Scalar string functions (FUN1, FUN2, FUN5, FUN11, FUN12) as Column expressions.

All of them are built-in Spark expressions, so they stay inside whole-stage codegen
(or, for the higher-order ones, at least on the JVM side).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpairs.fixed import MODULE_SUFFIX_LEN

# FUN1: the white-space set of Python's str.strip() with no argument, derived by rule:
# every code point whose str.isspace() is true (29 of them, the last is U+3000).
WHITESPACE_CODEPOINTS: tuple[int, ...] = tuple(c for c in range(0x3001) if chr(c).isspace())
WHITESPACE: str = "".join(chr(c) for c in WHITESPACE_CODEPOINTS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """FUN1: strip all Unicode white space from both ends (``trim`` alone strips only U+0020)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def chars(c) -> Column:
    """FUN2: the code points of a string as ``array<string>``; '' gives [] (split would give [''])."""
    c = _col(c)
    return F.when(c == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(c, ""))


def code_length(c) -> Column:
    """FUN5: length in code points."""
    return F.length(_col(c))


def base_name(path) -> Column:
    """FUN11: last path element."""
    return F.element_at(F.split(_col(path), "/"), -1)


def parent_name(path) -> Column:
    """FUN11: name of the directory holding the file."""
    return F.element_at(F.split(_col(path), "/"), -2)


def drop_last4(name) -> Column:
    """SRC5: module name = base name minus its last four characters ('' when shorter)."""
    k = MODULE_SUFFIX_LEN
    n = _col(name)
    return F.when(F.length(n) <= k, F.lit("")).otherwise(n.substr(F.lit(1), F.length(n) - F.lit(k)))


def decode_uri_path(path) -> Column:
    """``_metadata.file_path`` is a URI: '%20' for blanks etc.  Protect '+' then url-decode."""
    return F.url_decode(F.regexp_replace(_col(path), r"\+", "%2B"))


def round1(c) -> Column:
    """FUN12: round to one decimal, half to even (numpy / pandas ``round``)."""
    return F.bround(_col(c), 1)
