"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in segments of ``SEGMENT`` bytes, forwards and backwards, gives every
position a probability for each language, and a document's probabilities are the mean over its letter
positions.  Gates use a piecewise linear sigmoid.  It is trained in numpy by backpropagation through
time on segments of a bounded sample: at most about ``SAMPLE`` documents of each language (those with
the smallest hashes of their ids), ``SEGMENTS`` segments of each, and the ``LANGUAGES`` commonest
languages.  Prediction covers every byte of every text.

Defined cases: a null or empty text and one without any letter is ``und`` with score 0, as is everything
when there is nothing to learn from; a null id hashes as the empty text; equal texts get equal
results; rows without a language are predicted all the same; clashing columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpairs.llm import words

SEGMENT = 64
UNITS = 8
SAMPLE = 500
SEGMENTS = 6
LANGUAGES = 64
STEPS = 400
BATCH = 128
RATE = 0.02
BLOCK = 4096

_LETTERISH = np.zeros(256, bool)
_LETTERISH[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class BiGru:
    """Two gated recurrent networks (rows 0 forwards, 1 backwards) and a softmax on both states.

    Arrays have the units first and the segments last.  The gates stand in the order update, reset, new.
    """

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        k, h = len(languages), units
        self.languages, self.units = languages, h
        self.inp = rng.normal(0, 0.3, (2, 3 * h, 256)).astype(np.float32)
        self.rec = rng.normal(0, 0.6 / np.sqrt(h), (2, 3 * h, h)).astype(np.float32)
        self.out = rng.normal(0, 0.3, (k, 2 * h)).astype(np.float32)
        self.bias = np.zeros((k, 1), np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.inp, self.rec, self.out, self.bias]

    def states(self, x: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """Hidden states ``[position, unit, segment]`` of byte columns ``x[position, segment]`` in direction d."""
        t, n = x.shape
        h = self.units
        out = np.empty((t, h, n), np.float32)
        s = np.zeros((h, n), np.float32)
        for i in range(t) if d == 0 else range(t - 1, -1, -1):
            g = np.take(self.inp[d], x[i], axis=1)
            a = self.rec[d] @ s
            g[: 2 * h] += a[: 2 * h]
            zr = g[: 2 * h] * np.float32(0.25)
            zr += np.float32(0.5)
            np.clip(zr, 0, 1, out=zr)
            new = a[2 * h :] * zr[h:]
            new += g[2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((i, s, a[2 * h :], zr, new))
            s = new + zr[:h] * (s - new)
            out[i] = s
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """``[position, language, segment]``."""
        f, b = self.states(x, 0), self.states(x, 1)
        h = self.units
        z = np.matmul(self.out[:, :h], f) + np.matmul(self.out[:, h:], b) + self.bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over positions of weight 1, and its gradients by backpropagation through time."""
        t, n = x.shape
        h, k = self.units, len(self.languages)
        kept: list[list] = [[], []]
        f, b = (self.states(x, d, kept[d]) for d in (0, 1))
        both = np.concatenate([f, b], axis=1)
        z = np.matmul(self.out, both) + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        target = np.zeros((k, n), np.float32)
        target[y, np.arange(n)] = 1
        scale = (weight / max(1.0, weight.sum()))[:, None, :].astype(np.float32)
        loss = float(-(np.log(p[:, y, np.arange(n)] + 1e-9) * scale[:, 0]).sum())
        dz = (p - target) * scale
        g_out = np.einsum("tkn,thn->kh", dz, both)
        g_bias = dz.sum(axis=(0, 2))[:, None]
        d_state = np.matmul(self.out.T, dz)
        g_inp, g_rec = np.zeros_like(self.inp), np.zeros_like(self.rec)
        for d in (0, 1):
            carry = np.zeros((h, n), np.float32)
            for i, s, a, zr, new in reversed(kept[d]):
                ds = d_state[i, d * h : d * h + h] + carry
                dn = ds * (1 - zr[:h]) * (1 - new * new)
                lin = ((zr > 0) & (zr < 1)) * np.float32(0.25)
                dz_ = ds * (s - new) * lin[:h]
                dr = dn * a * lin[h:]
                da = np.concatenate([dz_, dr, dn * zr[h:]])
                carry = ds * zr[:h] + self.rec[d].T @ da
                g_rec[d] += da @ s.T
                dg = np.concatenate([dz_, dr, dn])
                hot = np.zeros((n, 256), np.float32)
                hot[np.arange(n), x[i]] = 1
                g_inp[d] += dg @ hot
        return loss, [g_inp, g_rec, g_out.astype(np.float32), g_bias.astype(np.float32)]


def fit(segments: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS) -> BiGru:
    """Adam on batches of segments ``[segment, position]``; every language is drawn equally often."""
    m = BiGru(languages)
    rng = np.random.Generator(np.random.PCG64(17))
    by = [np.flatnonzero(labels == k) for k in range(len(languages))]
    mom = [np.zeros_like(p) for p in m.params()]
    pow_ = [np.zeros_like(p) for p in m.params()]
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, -(-BATCH // len(by))) for b in by])
        x = segments[pick].T
        weight = (np.arange(x.shape[0])[:, None] < lengths[pick]).astype(np.float32)
        _, grads = m.gradients(x, labels[pick], weight)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - (t - 1) / steps))
        for p, g, a, b in zip(m.params(), grads, mom, pow_):
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            a += np.float32(0.1) * (g - a)
            b += np.float32(0.01) * (g * g - b)
            p -= np.float32(rate) * (a / np.float32(1 - 0.9**t)) / (np.sqrt(b / np.float32(1 - 0.99**t)) + np.float32(1e-7))
    return m


def predict_slice(m: BiGru, s: words.Slice) -> np.ndarray:
    """Mean probabilities ``[document, language]`` over each document's letter positions (0 without any)."""
    n, k = s.hi - s.lo, len(m.languages)
    lens = np.diff(s.byte_off)
    count = -(-lens // SEGMENT)
    doc = np.repeat(np.arange(n), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = s.byte_off[doc] + nth * SEGMENT
    size = np.minimum(SEGMENT, s.byte_off[doc + 1] - begin)
    total, letters = np.zeros((n, k)), np.zeros(n)
    padded = np.append(s.buf, np.full(SEGMENT, 32, np.uint8))
    for lo in range(0, len(doc), BLOCK):
        hi = min(lo + BLOCK, len(doc))
        at = np.arange(SEGMENT)[:, None]
        inside = at < size[lo:hi]
        x = np.where(inside, padded[begin[lo:hi] + at], 32).astype(np.uint8)
        use = (_LETTERISH[x] & inside).astype(np.float32)
        p = np.einsum("tkn,tn->kn", m.probabilities(x), use)
        for j in range(k):
            total[:, j] += np.bincount(doc[lo:hi], p[j], n)
        letters += np.bincount(doc[lo:hi], use.sum(axis=0), n)
    return total / np.maximum(letters, 1)[:, None]


def training_segments(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, fold: int):
    """(segments, lengths, label numbers, languages) of the bounded sample, in a fixed order."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = d.filter(F.col("lang").isNotNull() & (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % folds != fold))
    share = d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r.lang for r in share)
    if not languages:
        return np.zeros((0, SEGMENT), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    part = F.create_map(*[x for r in share for x in (F.lit(r.lang), F.lit(min(1.0, 1.25 * SAMPLE / r["count"])))])
    unit = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
    sample = d.filter(F.col("lang").isin(languages) & (unit < part[F.col("lang")])).filter(F.length("text") > 0)

    def cut(batches):
        for batch in batches:
            ids, langs, segs = [], [], []
            for i, text, lang in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist()):
                raw = text.as_py()
                every = -(-len(raw) // SEGMENT)
                for j in range(min(SEGMENTS, every)):
                    at = (j * every // min(SEGMENTS, every)) * SEGMENT
                    ids.append(i)
                    langs.append(lang)
                    segs.append(raw[at : at + SEGMENT])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(segs, pa.binary())], names=["id", "lang", "seg"])

    rows = sorted(sample.mapInArrow(cut, "id long, lang string, seg binary").toLocalIterator(), key=lambda r: (r.lang, r.id or 0, r.seg))
    x = np.full((len(rows), SEGMENT), 32, np.uint8)
    for i, r in enumerate(rows):
        x[i, : len(r.seg)] = np.frombuffer(r.seg, np.uint8)
    have = sorted({r.lang for r in rows})
    number = {lang: i for i, lang in enumerate(have)}
    return x, np.array([len(r.seg) for r in rows], np.int64), np.array([number[r.lang] for r in rows], np.int64), have


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, fold: int = 0) -> BiGru:
    x, lengths, labels, languages = training_segments(docs, id_col, text_col, lang_col, folds, fold)
    return fit(x, lengths, labels, languages) if languages else BiGru([])


def predict(docs: DataFrame, model: BiGru, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``."""
    docs = docs.drop("lang_pred", "lang_score")
    held = docs.sparkSession.sparkContext.broadcast(vars(model))
    names = docs.columns

    def run(batches):
        m = words.revive(BiGru, held.value)
        for batch in batches:
            pred, score = [], []
            texts = batch.column(names.index(text_col))
            for s in words.slices(texts, words.SPACED, False):
                ascii_letters = np.concatenate(([0], np.cumsum(_ASCII_LETTER[s.buf])))
                plain = np.diff(ascii_letters[s.byte_off]) > 0
                p = predict_slice(m, s) if m.languages else None
                for d in range(s.hi - s.lo):
                    if p is None or not (plain[d] or any(c.isalpha() for c in texts[s.lo + d].as_py() or "")):
                        pred.append("und")
                        score.append(0.0)
                    else:
                        k = int(np.argmax(p[d]))
                        pred.append(m.languages[k])
                        score.append(float(min(1.0, p[d, k])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "lang_score"])

    schema = T.StructType(docs.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    got = predict(docs.select("doc_id", "text"), train(docs))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return got.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
