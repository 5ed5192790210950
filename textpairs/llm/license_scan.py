"""License detection by ordered signature rules: regexes behind a keyword prefilter, overlaps resolved.

A rule has a label, a priority, a confidence, gate words and a regex over a text's words (lower-cased, one
blank between them).  The rules come from ``LICENSES`` (what names a license) and ``PHRASES`` (how a
text speaks of one), so there are hundreds.  Only documents that hold one of a
rule's gate words are searched for it; the gate is derived from the regex, so that whatever it can match has one of
them (``gplv3`` and ``freebsd`` beside ``gpl`` and ``bsd``).  Detections are intervals of words; one that lies inside another of the same or a
higher priority is suppressed, and the base phrases always stay.

Defined cases: a null or empty text has no words and no detections; equal rows get equal results; an
empty table gives no rows; clashing columns of the input are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate, groupby, product
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.llm import words

#: fixed values: base phrases and their labels
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: label, the word to gate by wherever the name has it, and the regexes of the license's names (words of a-z0-9)
LICENSES: list[tuple[str, str, str]] = [
    ("mit", "mit", r"(?:mit|mit x11|x11 mit|expat mit)"),
    ("expat", "expat", r"expat"),
    ("x11", "x11", r"x11"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?1 1"),
    ("apache-2", "apache", r"apache(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?"),
    ("apache-2", "asl", r"asl ?2(?: 0)?"),
    ("gpl-1", "gpl", r"(?:gnu )?gpl ?v?1(?: 0)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl(?: version)? ?v?3(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-2", "gnu", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 0)?"),
    ("gpl-3", "gnu", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?"),
    ("gpl", "gnu", r"gnu general public licen[cs]e"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version)? ?v?2 1"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e (?:version|v) ?2 1"),
    ("lgpl-3", "lesser", r"gnu lesser general public licen[cs]e (?:version|v) ?3(?: 0)?"),
    ("lgpl", "lesser", r"gnu lesser general public licen[cs]e"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl(?: version)? ?v?3(?: 0)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[cs]e(?: (?:version|v) ?3(?: 0)?)?"),
    ("fdl", "gfdl", r"(?:gnu )?gfdl(?: 1 [123])?"),
    ("fdl", "documentation", r"gnu free documentation licen[cs]e(?: version 1 [123])?"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)"),
    ("bsd-0", "0bsd", r"(?:0bsd|zero clause bsd)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("isc", "isc", r"isc"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version|v) ?1 1"),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e(?: (?:version|v))? ?2(?: 0)?"),
    ("mpl-2", "mpl", r"mpl ?v?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e(?: (?:version|v))? ?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e(?: (?:version|v))? ?2(?: 0)?"),
    ("eupl", "eupl", r"eupl(?: 1 [012])?"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("cddl", "common", r"common development and distribution licen[cs]e"),
    ("cpl", "common", r"common public licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost", "boost", r"boost software licen[cs]e(?: (?:version )?1(?: 0)?)?"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e(?: (?:version )?[12](?: 0)?)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python", "psf", r"psf"),
    ("python", "python", r"python software foundation licen[cs]e"),
    ("php", "php", r"php licen[cs]e(?: 3 01?)?"),
    ("openssl", "openssl", r"openssl"),
    ("ofl", "ofl", r"(?:sil )?ofl(?: 1 1)?"),
    ("ofl", "sil", r"sil open font licen[cs]e(?: (?:version )?1 1)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc", "cc", r"cc by nc(?! nd| sa)(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by", "cc", r"cc by(?! nc| nd| sa)(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:atives|s)?(?: [1-4] 0)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?! share| no)(?: [1-4] 0)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] 0)?"),
    ("cc-by", "creative", r"creative commons attribution(?! non| share| no)(?: [1-4] 0)?"),
    ("public-domain", "domain", r"(?:the )?public domain"),
    ("proprietary", "proprietary", r"(?:a )?proprietary"),
]

#: name, priority, confidence and regex of how a text speaks of a license; {n} is the license's name
PHRASES: list[tuple[str, int, float, str]] = [
    ("spdx", 9, 1.0, r"spdx licen[cs]e identifier {n}"),
    ("licensed", 8, 0.95, r"licen[cs]ed under(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {n}(?: licen[cs]e)?"),
    ("released", 8, 0.95, r"released (?:under|into)(?: the)?(?: terms of)?(?: the)? {n}(?: licen[cs]e)?"),
    ("distributed", 8, 0.95, r"(?:re)?distributed under(?: the)?(?: terms of)?(?: the)? {n}(?: licen[cs]e)?"),
    ("available", 8, 0.9, r"(?:made )?available under(?: the)?(?: terms of)?(?: the)? {n}(?: licen[cs]e)?"),
    ("subject", 7, 0.9, r"subject to(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {n}(?: licen[cs]e)?"),
    ("terms", 6, 0.85, r"under the terms of(?: the)? {n}(?: licen[cs]e)?"),
    ("named", 4, 0.7, r"{n} licen[cs]es?"),
    ("title", 3, 0.6, r"licen[cs]e {n}"),
]


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int
    confidence: float
    words: frozenset[str]
    pattern: re.Pattern


def spellings(regex: str) -> list[str]:
    """Every text that a regex without unbounded repeats can match; assertions count as met."""

    def of(items) -> list[str]:
        out = [""]
        for op, arg in items:
            if op is _parser.LITERAL:
                new = [chr(arg)]
            elif op is _parser.IN:
                new = [chr(c) for kind, x in arg for c in (range(x[0], x[1] + 1) if kind is _parser.RANGE else [x])]
            elif op is _parser.BRANCH:
                new = [x for branch in arg[1] for x in of(branch)]
            elif op is _parser.SUBPATTERN:
                new = of(arg[3])
            elif op is _parser.MAX_REPEAT and arg[1] <= 2:
                new = ["".join(x) for n in range(arg[0], arg[1] + 1) for x in product(of(arg[2]), repeat=n)]
            elif op in (_parser.ASSERT, _parser.ASSERT_NOT):
                continue
            else:
                raise ValueError(f"{op} in {regex}")
            out = [x + y for x in out for y in new]
        return out

    return sorted(set(of(_parser.parse(regex))))


def gate_words(keyword: str, name: str) -> frozenset[str]:
    """Words of which every spelling of the name has one: the keyword, or a word it is written into, or its first word."""

    def gate(spelling: str) -> str:
        held = spelling.split()
        return keyword if keyword in held else next((w for w in held if keyword in w), held[0])

    return frozenset(map(gate, spellings(name)))


def signatures() -> list[Signature]:
    """All rules, by falling priority, then in the order of the lists."""
    out = []
    for label, key, name in LICENSES:
        gate = gate_words(key, name)
        # a name that says "license" itself needs no phrase around it
        for _, priority, sure, p in [*PHRASES, *([("full name", 5, 0.8, "{n}")] if "licen" in name else [])]:
            out.append(Signature(label, priority, sure, gate, re.compile((r"(?<![^ ])" + p.replace("{n}", name) + r"(?![^ ])").encode())))
    return sorted(out, key=lambda s: -s.priority)


def suppress(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Detections (start, end, priority, label, confidence) that lie inside none of the same or a higher priority.

    Of equal intervals of equal priority the first given stays.
    """
    kept: list[tuple[int, int, int, str, float]] = []
    starts: list[int] = []  # of what is kept at higher priorities, rising
    reach: list[int] = []  # the farthest end up to there
    for _, same in groupby(sorted(found, key=lambda x: (-x[2], x[0], -x[1])), key=lambda x: x[2]):
        new, far = [], -1
        for f in same:  # by start, the longest first: a container comes before what it holds
            i = bisect_right(starts, f[0])
            if far < f[1] and not (i and reach[i - 1] >= f[1]):
                new.append(f)
                far = f[1]
        kept += new
        both = sorted((k[0], k[1]) for k in kept)
        starts = [x for x, _ in both]
        reach = list(accumulate((y for _, y in both), max))
    return kept


SCHEMA = "id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<first:long,last:long,label:string>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base phrases' places, all labels, the best confidence and the detections' word spans."""

    def hashes(phrase: list[str]) -> np.ndarray:
        at = np.cumsum([0] + [len(w) + 1 for w in phrase])
        buf = np.frombuffer(" ".join(phrase).encode() + b" ", np.uint8)
        return words.hash_words(buf, at[:-1], at[1:] - 1)

    def run(batches):
        rules = signatures()
        names = sorted({w for r in rules for w in r.words})
        keys = hashes(names)
        order = np.argsort(keys)
        keys, names = keys[order], [names[i] for i in order]
        base = [(hashes(p.split()), label) for p, label in BASE]
        by_word = {w: {i for i, r in enumerate(rules) if w in r.words} for w in names}

        for batch in batches:
            cols: dict[str, list] = {c.strip().split()[0]: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for s in words.slices(batch.column(1), words.ALNUM, True):
                h = words.word_hashes(s)
                doc = s.doc_of_word()
                n = s.hi - s.lo
                places: dict[int, list[tuple[int, str]]] = {}
                for p, label in base:
                    m = len(h) - len(p) + 1
                    if m <= 0:
                        continue
                    ok = doc[:m] == doc[len(p) - 1 :]
                    for j, x in enumerate(p):
                        ok &= h[j : j + m] == x
                    for at in np.flatnonzero(ok).tolist():
                        d = int(doc[at])
                        places.setdefault(d, []).append((at - int(s.off[d]), label))
                near = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[near] == h)
                gate: dict[int, set[int]] = {}
                for d, k in set(zip(doc[hit].tolist(), near[hit].tolist())):
                    gate.setdefault(d, set()).update(by_word[names[k]])
                for d in range(n):
                    b = places.get(d, [])
                    found: list[tuple[int, int, int, str, float]] = []
                    if d in gate:
                        first, last = int(s.off[d]), int(s.off[d + 1])
                        w, e = s.starts[first:last], s.ends[first:last]
                        text = b" ".join(s.buf[x:y].tobytes() for x, y in zip(w.tolist(), e.tolist()))
                        begin = np.cumsum(e - w + 1) - (e - w + 1)
                        for r in (rules[i] for i in sorted(gate[d])):
                            for m in r.pattern.finditer(text):
                                a = int(np.searchsorted(begin, m.start()))
                                found.append((a, a + m.group().count(b" ") + 1, r.priority, r.label, r.confidence))
                    kept = suppress(found)
                    labels = {label for _, label in b}
                    at = [a for a, _ in b]
                    cols["n_words"].append(int(s.counts[d]))
                    cols["n_base"].append(len(b))
                    cols["first_word"].append(min(at) if at else None)
                    cols["last_word"].append(max(at) if at else None)
                    cols["base_labels"].append(sorted(labels))
                    cols["labels"].append(sorted(labels | {f[3] for f in kept}))
                    cols["score"].append(1.0 if b else max((f[4] for f in kept), default=0.0))
                    cols["spans"].append([{"first": f[0], "last": f[1] - 1, "label": f[3]} for f in sorted(kept)])
            types = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), _SPANS]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(v, t) for v, t in zip(cols.values(), types)], names=["id", *cols])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, SCHEMA)
    return out.withColumnRenamed("id", id_col)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    got = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")
