"""Language ID, toxicity, quality rules, LM scores, licenses, packing and chat rotation on small data."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import alnum_words, collect, edge_docs, edge_rows, empty_docs, lower, words_of, write_tables
from textpairs.llm import chat_rotation, language_id, license_scan, lm_scoring, packing, quality_rules, toxicity

SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"


def crc(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


# language ID


def test_gradients_of_the_network():
    m = language_id.BiGru(["a", "b", "c"], 4)
    for name in ("inp", "rec", "out", "bias"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(0, 256, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.ones((6, 5), np.float32)
    _, grads = m.gradients(x, y, w)
    for g, p in zip(grads, m.params()):
        for i in np.argsort(-np.abs(g).ravel())[:5]:
            at = np.unravel_index(i, p.shape)
            old = p[at]
            p[at] = old + 1e-4
            up = m.gradients(x, y, w)[0]
            p[at] = old - 1e-4
            down = m.gradients(x, y, w)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-5)


def test_language_held_out_accuracy(spark):
    got = language_id.op4_language_id(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    lang = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    rows = got.collect()
    assert len(rows) == len(lang) and all(r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)
    out = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(out) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, tmp_path):
    got = {}
    for r in language_id.op4_language_id(spark, write_tables(spark, tmp_path / "a", edge_docs(spark))).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(edge_rows())
    for i, t, *_ in edge_rows():
        und = not any(c.isalpha() for c in t or "")
        assert any((r.lang_pred == "und") == und and (r.score == 0 or not und) for r in got[i])
    assert {r.lang_pred for rs in got.values() for r in rs} <= {"en", "de", "und"}
    assert collect(language_id.op4_language_id(spark, write_tables(spark, tmp_path / "b", empty_docs(spark)))) == []
    no_lang = edge_docs(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id.predict(no_lang, language_id.train(no_lang)).collect()} == {"und"}


# toxicity


def test_toxicity_held_out(spark):
    got = toxicity.op7_toxicity(spark, SF)
    lab = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect())
    rows = got.collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(lab[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in lab]
    tp, fp = held.count((1, 1)), held.count((0, 1))
    assert tp >= 0.5 * (tp + held.count((1, 0))) and fp <= 0.05 * held.count((0, 0))


def test_toxicity_edges(spark, tmp_path):
    texts = ["good words only here", "you vile toad", "Vile toad again", "nice day", None, "", "vile toad " * 30000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts * 8)] + [(None, "vile toad", 0)] * 2, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int("toad" in (texts[i % 7] or "")), "x") for i in range(56)] + [(None, 1, "x"), (3, None, "x"), (1, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.op7_toxicity(spark, write_tables(spark, tmp_path / "a", docs, labels=labels)).collect()
    assert len(got) == 58
    toad = [r.score for r in got if r.doc_id is None or "toad" in (texts[r.doc_id % 7] or "")]
    rest = [r.score for r in got if r.doc_id is not None and "toad" not in (texts[r.doc_id % 7] or "")]
    assert min(toad) > max(rest)
    clean = labels.filter("toxic = 0")
    assert {r.score for r in toxicity.op7_toxicity(spark, write_tables(spark, tmp_path / "b", docs, labels=clean)).collect()} == {0.0}
    bad = labels.filter("toxic = 1")
    assert {r.score for r in toxicity.op7_toxicity(spark, write_tables(spark, tmp_path / "d", docs, labels=bad)).collect()} == {1.0}
    assert {r.score for r in toxicity.op7_toxicity(spark, write_tables(spark, tmp_path / "e", docs, labels=labels.filter("false"))).collect()} == {0.0}
    assert collect(toxicity.op7_toxicity(spark, write_tables(spark, tmp_path / "c", empty_docs(spark), labels=labels))) == []


def test_toxicity_equals_a_plain_version(spark, monkeypatch):
    """Places, counts, choice, fit and scores by plain loops over the texts."""
    import numpy as np
    import pyarrow as pa

    from textpairs.llm import words

    monkeypatch.setattr(toxicity, "FEATURES", 300)
    monkeypatch.setattr(toxicity, "ROUNDS", 40)
    texts = [f"you {w} toad {i}" if i % 3 else f"a {w} day {i}" for i, w in enumerate(["vile", "nice", "Grün", "odd"] * 12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, "zzz repeated id")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(48)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, "doc_id", "text", 4, 2)

    def places(text):
        return set(toxicity.char_ngrams(next(words.slices(pa.array([text]), words.SPACED, True)))[1].tolist())

    learned = [i for i in range(48) if crc(i, 4) != 2]
    of = {i: places(min(texts[i], "zzz repeated id") if i == 7 else texts[i]) for i in learned}
    y = np.array([float(i % 3 > 0) for i in learned])
    n_bad, n_good = y.sum(), (1 - y).sum()
    stats = []
    for p in sorted(set().union(*of.values())):
        bad, good = sum(p in of[i] for i in learned if i % 3), sum(p in of[i] for i in learned if not i % 3)
        r = np.log((bad + 1) / (n_bad + 2) / ((good + 1) / (n_good + 2)))
        if bad + good >= 4 and r:
            stats.append((-abs(r) * np.sqrt(bad + good), p, r))
    chosen = sorted((p, r) for _, p, r in sorted(stats)[:300])
    x = np.array([[r if p in of[i] else 0.0 for p, r in chosen] for i in learned])
    w, b, m, v = np.zeros(len(chosen)), np.log(y.mean() / (1 - y.mean())), 0, 0
    for t in range(1, 41):
        e = (1 / (1 + np.exp(-(b + x @ w))) - y) / len(y)
        g = np.append(x.T @ e + toxicity.RIDGE * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    assert np.allclose(model.weight[[p for p, _ in chosen]], [wi * r for wi, (_, r) in zip(w, chosen)], atol=1e-5)
    assert np.count_nonzero(model.weight) <= len(chosen) and np.isclose(model.intercept, b, atol=1e-6)
    weight = {p: wi * r for wi, (p, r) in zip(w, chosen)}
    got = {(r.doc_id, r.score) for r in toxicity.score_toxicity(docs.filter("doc_id <> 7"), model).collect()}
    want = {i: 1 / (1 + np.exp(-(b + sum(weight.get(p, 0) for p in places(texts[i]))))) for i in range(48) if i != 7}
    assert len(got) == 47 and all(abs(want[i] - s) < 1e-4 for i, s in got)


def test_words_parted_at_signs_have_the_same_ids():
    import random

    from tokenizers import Tokenizer

    from textpairs.llm import packing

    rng = random.Random(4)
    text = packing.default_tokenizer()
    tokenizer, split = Tokenizer.from_str(text), packing._splitter(text)
    assert split(b"Word, Two.") == [b"word", b",", b"two", b"."]
    bits = ["a", "Zz", "the", "'s", "'", "é", "É", "ß", ",", ".", "...", ";:", "!", "?", "—", "-", "7", "e\u0301", "\u0338", "İ", "Σ", "一", "☃", "_"]
    for _ in range(400):
        raw = "  ".join("".join(rng.choice(bits) for _ in range(rng.randrange(1, 7))) for _ in range(5))
        want = tokenizer.encode(raw, add_special_tokens=False).ids
        assert [i for w in split(raw.encode()) for i in tokenizer.encode(w.decode(), add_special_tokens=False).ids] == want, raw
    plain = text.replace('"Lowercase"', '"NFKC"', 1) if '"Lowercase"' in text else text
    assert packing._splitter(plain) is bytes.split


def test_joined_words_get_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    text = packing.default_tokenizer()
    tokenizer, split, ends = Tokenizer.from_str(text), packing._splitter(text), packing._word_ends(text)
    assert ends is not None and packing._word_ends(text.replace('"</w>"', "null", 1)) is None
    signs = ["a", "b", "E", "İ", "ß", "é", "e\u0301", "\u212b", "ſ", "ʼ", "'s", "'", "ll", "ñ", "中", "ा", "क", "1", "²", "_", "-", ".", ",", "$", "#", "<|endoftext|>", "<|", "|>", "endoftext", "\u200d", "😀", "ǅ", "K", "ⅷ", "\u0345", "ª", "\U0001e900", "\U00031350"]
    rng = np.random.default_rng(8)
    for _ in range(300):
        words = packing.WordIds(tokenizer, ends)
        texts = [" ".join("".join(rng.choice(signs, rng.integers(1, 7))) for _ in range(rng.integers(0, 12))) for _ in range(5)]
        for raw, got in zip(texts, words.encode([split(t.encode()) for t in texts])):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(raw, add_special_tokens=False).ids, raw


def test_ngrams_are_of_code_points():
    import pyarrow as pa

    from textpairs.llm import words

    s = next(words.slices(pa.array(["été!", "Ét", "été!x", None]), words.SPACED, True))
    doc, place = toxicity.char_ngrams(s, (4,))
    assert doc.tolist() == [0, 2, 2] and place[0] == place[1] != place[2]


# quality rules


def quality_brute(t):
    w = words_of(t)
    lines = [x for x in (t or "").split("\n") if words_of(x)]
    c = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    g = [0] * len(w)
    for j in range(len(w) - 4):
        if c[tuple(w[j : j + 5])] > 1:
            g[j : j + 5] = [1] * 5
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), sum(g), len(w) < 10 or 100 * sum(g) > 20 * len(w)


def test_quality_statistics(spark, tmp_path):
    more = [(900, "a\na\n\n \n a\na\r\n|<>|", *[None] * 9), (901, "\n" * 50 + "x y\n" * 9, *[None] * 9), (902, "# " * 12, *[None] * 9)]
    docs = edge_docs(spark).unionByName(spark.createDataFrame(more, edge_docs(spark).schema))
    got = quality_rules.op5_quality_rules(spark, write_tables(spark, tmp_path, docs))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = sorted(((r[0], *quality_brute(r[1])) for r in [*edge_rows(), *more]), key=repr)
    assert collect(got.select(*names)) == want
    assert got.filter("kept and base_failed").count() == 0
    assert collect(quality_rules.op5_quality_rules(spark, write_tables(spark, tmp_path / "b", empty_docs(spark)))) == []


def test_quality_verdicts_agree_with_labels(spark):
    got = {r.doc_id: r for r in quality_rules.op5_quality_rules(spark, SF).collect()}
    lab = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()
    good = [got[i].kept or got[i].base_failed for i, q in lab if q == 1]
    bad = [not got[i].kept for i, q in lab if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) > 0.9


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.7
    acc = [0.95, 0.9, 0.8, 0.9]
    votes = np.stack([np.where(rng.random(20000) < 0.2, 0, np.where((rng.random(20000) < a) == good, 1, -1)) for a in acc], 1)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    m = quality_rules.fit_votes(rows, counts, np.full(4, 0.5))
    assert m.prior == pytest.approx(0.7, abs=0.03) and np.allclose(m.on_good, acc, atol=0.03) and np.allclose(m.on_bad, acc, atol=0.04)


# LM scores


def lm_brute(docs):
    held = [crc(i, 10) == 0 for i, _ in docs]
    toks = [[*words_of(lower(t)), None] for _, t in docs]
    c = Counter(x for h, w in zip(held, toks) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for (i, _), h, w in zip(docs, held, toks)), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_lm_base(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 500)
        monkeypatch.setattr(lm_scoring, "VOCAB", 12)
        monkeypatch.setattr(lm_scoring.exchange, "BUCKET_BYTES", 300)
    got = lm_scoring.op9_lm_score(spark, write_tables(spark, tmp_path, edge_docs(spark)))
    assert sorted(((*r[:5], round(r[5], 5)) for r in got.drop("score").collect()), key=repr) == lm_brute([r[:2] for r in edge_rows()])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got.collect())
    assert collect(lm_scoring.op9_lm_score(spark, write_tables(spark, tmp_path / "b", empty_docs(spark)))) == []


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(3)
    v = lm_scoring.Vocabulary(np.arange(5, 15, dtype=np.uint64), np.full(10, 1000), 500, 700)
    m = lm_scoring.LogBilinear(v)
    u = rng.integers(0, v.size, 60000).astype(np.int32)
    w = np.where(rng.random(60000) < 0.8, (u + 1) % v.size, rng.integers(0, v.size, 60000)).astype(np.int32)
    x = rng.integers(0, v.size, 60000).astype(np.int32)
    before = m.log_prob(w, u, x).mean()
    for seed in range(5):
        m.train(w, u, x, seed)
    assert m.log_prob(w, u, x).mean() > before + 0.5
    every = np.arange(v.size)
    for a, b in ((3, 4), (0, 11)):
        assert np.exp(m.log_prob(every, np.full(v.size, a), np.full(v.size, b))).sum() == pytest.approx(1, abs=1e-4)


def plain_log_prob(m, w, u, v):
    """One token at a time: the group's softmax, then the slot's among the slots of its group."""
    c = m.q[u].astype(float) * m.a + m.q[v] * m.b
    group = m.sd[:, :-1] @ c + m.sd[:, -1]
    inside = [i for i in range(len(m.group)) if m.group[i] == m.group[w]]
    slot = {i: float(m.rb[i, :-1] @ c + m.rb[i, -1]) for i in inside}
    return group[m.group[w]] - math.log(sum(math.exp(x) for x in group)) + slot[w] - math.log(sum(math.exp(x) for x in slot.values()))


def plain_train(m, w, u, v, seed, batch, tile, draws, noise, rate):
    """The same draws as ``train``, every example and noise slot by itself in float64."""
    rng = np.random.Generator(np.random.PCG64(seed))
    size, ends = len(m.q), np.cumsum(m.noise)
    par = {k: getattr(m, k).astype(float) for k in ("a", "b", "sd", "q", "rb")}
    power = {k: np.full_like(p, 1e-4) for k, p in par.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    order = rng.permutation(len(w))
    for lo in range(0, len(w), batch):
        todo = sorted(order[lo : lo + batch].tolist(), key=lambda i: m.group[w[i]])
        tiles = []
        for i in todo:
            g = m.group[w[i]]
            if not tiles or tiles[-1][0] != g or len(tiles[-1][1]) == tile:
                tiles.append((g, []))
            tiles[-1][1].append(i)
        at = rng.random((len(tiles), draws))
        drawn = []
        for (g, _), t in zip(tiles, at):
            begin, end = g * m.width, min((g + 1) * m.width, size)
            mass = m.total[begin] + t * (m.total[end] - m.total[begin])
            drawn.append([m.order[min(max(int(np.searchsorted(m.total, x, "right")) - 1, begin), end - 1)] for x in mass])
        others = [min(int(np.searchsorted(ends, x)), len(ends) - 1) for x in rng.random(noise) * ends[-1]]
        grad = {k: np.zeros_like(p) for k, p in par.items()}
        for (g, examples), slots in zip(tiles, drawn):
            for i in examples:
                qu, qv = par["q"][u[i]], par["q"][v[i]]
                c = np.append(qu * par["a"] + qv * par["b"], 1)
                gc = np.zeros_like(c)
                terms = [("rb", w[i], 1, m.log_share[w[i]]), ("sd", g, 1, math.log(m.noise[g]))]
                terms += [("rb", x, -noise / draws, m.log_share[x]) for x in slots] + [("sd", y, -1, math.log(m.noise[y])) for y in others]
                for k, x, weight, log_p in terms:
                    s = c @ par[k][x] - log_p - math.log(noise)
                    d = 1 - sigmoid(s) if weight > 0 else weight * sigmoid(s)
                    grad[k][x] += d * c
                    gc += d * par[k][x]
                gc = gc[:-1]
                grad["q"][u[i]] += gc * par["a"]
                grad["q"][v[i]] += gc * par["b"]
                grad["a"] += gc * qu
                grad["b"] += gc * qv
        for k in par:
            g = grad[k] / len(todo)
            power[k] += g * g
            par[k] += rate * g / np.sqrt(power[k])
    return par


def test_lm_against_a_plain_version(monkeypatch):
    for name, value in (("BATCH", 40), ("TILE", 4), ("DRAWS", 3), ("NOISE", 5)):
        monkeypatch.setattr(lm_scoring, name, value)
    rng = np.random.default_rng(6)
    v = lm_scoring.Vocabulary(np.arange(5, 26, dtype=np.uint64), rng.integers(1, 60, 21), 30, 7)
    m = lm_scoring.LogBilinear(v)
    w, u, x = (rng.integers(0, v.size, 150).astype(np.int32) for _ in range(3))
    want = plain_train(m, w, u, x, 5, 40, 4, 3, 5, lm_scoring.RATE)
    met = m.train(w, u, x, 5)
    for k, p in want.items():
        assert np.allclose(getattr(m, k), p, atol=2e-3), k
    assert np.all(met >= np.bincount(np.concatenate((w, u, x)), minlength=v.size))
    assert np.allclose(m.log_prob(w, u, x), [plain_log_prob(m, *t) for t in zip(w, u, x)], atol=1e-4)


def test_lm_puts_whole_rows():
    rng = np.random.default_rng(2)
    for width in (16, 17):
        p, new, at = rng.normal(size=(50, width)).astype(np.float32), rng.normal(size=(9, width)).astype(np.float32), rng.permutation(50)[:9]
        want = p.copy()
        want[at] = new
        lm_scoring._put_rows(p, at, new)
        assert np.array_equal(p, want)


class WholeRows(np.ndarray):
    """A table whose rows are not to be read by index arrays, which copy them a cell at a time."""

    def __getitem__(self, key):
        assert not (self.ndim == 2 and isinstance(key, np.ndarray)), "rows read by an index array"
        return super().__getitem__(key)


def test_lm_reads_whole_rows():
    rng = np.random.default_rng(5)
    v = lm_scoring.Vocabulary(np.arange(5, 305, dtype=np.uint64), rng.integers(1, 60, 300), 30, 7)
    m, plain = lm_scoring.LogBilinear(v), lm_scoring.LogBilinear(v)
    m.q, m.rb = m.q.view(WholeRows), m.rb.view(WholeRows)
    w, u, x = (rng.integers(0, v.size, 9000).astype(np.int32) for _ in range(3))
    assert np.array_equal(m.train(w, u, x, 5), plain.train(w, u, x, 5))
    assert np.array_equal(m.q, plain.q) and np.array_equal(m.rb, plain.rb)
    m.rb = np.asarray(m.rb)
    assert np.array_equal(m.log_prob(w, u, x), plain.log_prob(w, u, x))


def test_lm_beats_the_unigram_base_on_held_out_texts(spark):
    r = lm_scoring.op9_lm_score(spark, SF).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first().asDict()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_lm_vocabulary_grows_with_the_words(monkeypatch):
    monkeypatch.setattr(lm_scoring, "VOCAB", 8)
    rng = np.random.default_rng(4)
    sizes, buckets = [], 4
    for distinct in (400, 4000):
        keys = np.sort(rng.integers(0, 2**64, distinct, dtype=np.uint64))
        cuts = lm_scoring.exchange.bucket_cuts(keys, buckets)
        own, shared = [], []
        for b in range(buckets):
            k = keys[cuts[b] : cuts[b + 1]]
            _, got = lm_scoring._count(buckets)([k], [rng.integers(1, 9, len(k)).astype(np.int32).tobytes()])
            x = {c: got[c][0].as_py() for c in got}
            own.append((np.frombuffer(x["own"], np.uint64), np.frombuffer(x["own_n"], np.int64)))
            shared.append((np.frombuffer(x["shared_n"], np.int64), np.frombuffer(x["shared_words"], np.int64)))
        v = lm_scoring.Vocabulary(*(np.concatenate(c) for c in zip(*own)), 50, 0, shared)
        slot = v.of(keys)
        assert slot.min() > 1 and np.array_equal(np.bincount(slot, minlength=v.size)[v.words > 0], v.words[v.words > 0])
        m = lm_scoring.LogBilinear(v)
        assert len(m.noise) > 1
        w, u = rng.integers(1, v.size, 2000).astype(np.int32), rng.integers(1, v.size, 2000).astype(np.int32)
        m.train(w, u, np.roll(u, 1), 3)
        every = np.arange(v.size)
        assert np.exp(m.log_prob(every, np.full(v.size, 5), np.full(v.size, 6))).sum() == pytest.approx(1, abs=1e-4)
        assert not np.allclose(m.log_prob(every, np.full(v.size, 5), every), m.log_prob(every, np.full(v.size, v.size - 1), every))
        sizes.append(v.size)
    assert sizes[1] > 3 * sizes[0]


# licenses


def license_brute(t):
    w = alnum_words(t)
    at = [(j, label) for p, label in license_scan.BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
    pos = [j for j, _ in at]
    return len(w), len(at), min(pos, default=None), max(pos, default=None), ",".join(sorted({x for _, x in at}))


def test_license_base(spark, tmp_path):
    lines = ["Released under the MIT License. under the mit license", "Apache License, Version 2.0 and CC-BY-NC 4.0; CC BY NC", "under the\nMIT-license " * 3000, "mit", "the GNU General Public License, version 3.", "underthe mit license", "SPDX-License-Identifier: BSD-3-Clause", "licensed under CC BY-NC-SA 4.0"]
    more = [(800 + i, t, *[None] * 9) for i, t in enumerate(lines)]
    docs = edge_docs(spark).unionByName(spark.createDataFrame(more, edge_docs(spark).schema))
    got = license_scan.op8_license_scan(spark, write_tables(spark, tmp_path, docs))
    assert collect(got.drop("labels", "score")) == sorted(((r[0], *license_brute(r[1])) for r in [*edge_rows(), *more]), key=repr)
    labels = {r.doc_id: r.labels for r in got.collect()}
    assert labels[800] == "mit" and labels[804] == "gpl-3" and labels[806] == "bsd-3" and labels[803] == "" and labels[807] == "cc-by-nc,cc-by-nc-sa"
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got.collect())
    assert collect(license_scan.op8_license_scan(spark, write_tables(spark, tmp_path / "b", empty_docs(spark)))) == []


def test_license_rules_and_suppression():
    rules = license_scan.signatures()
    assert len(rules) > 300 and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)
    rng = np.random.default_rng(5)
    for _ in range(200):
        found = [(int(a), int(a + n), int(p), str(i), 1.0) for i, (a, n, p) in enumerate(zip(rng.integers(0, 12, 9), rng.integers(1, 7, 9), rng.integers(1, 4, 9)))]
        kept = license_scan.suppress(found)
        inside = lambda f, k: k[0] <= f[0] and f[1] <= k[1]
        for f in found:
            over = [k for k in kept if k != f and inside(f, k) and k[2] >= f[2]]
            assert (f in kept) != bool(over)


def test_license_gate_lets_every_spelling_through(spark):
    rules = license_scan.signatures()
    texts = ["The FreeBSD license", "licensed under GPLv3", "Apache2 license", "released under zero clause bsd"]
    for _, _, name in license_scan.LICENSES:
        texts += [f"licensed under the {x}" for x in license_scan.spellings(name)] + [f"see {license_scan.spellings(name)[0]} license"]
    want = []
    for i, t in enumerate(texts):
        text = " ".join(alnum_words(t)).encode()
        found = []
        for r in rules:  # no gate
            for m in r.pattern.finditer(text):
                a = text[: m.start()].count(b" ")
                found.append((a, a + m.group().count(b" ") + 1, r.priority, r.label, r.confidence))
        spans = sorted(license_scan.suppress(found))
        assert spans, t
        want.append((i, max(f[4] for f in spans), [(f[0], f[1] - 1, f[3]) for f in spans]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = license_scan.scan_licenses(docs).collect()
    assert sorted((r.doc_id, 1.0 if r.n_base else r.score, [tuple(x) for x in r.spans]) for r in got) == [(i, 1.0 if r.n_base else s, x) for (i, s, x), r in zip(want, sorted(got))]
    labels = {r.doc_id: r.labels for r in got}
    assert [labels[i] for i in range(4)] == [["bsd-2"], ["gpl-3"], ["apache-2"], ["bsd-0"]]


# packing


def test_packing_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(packing.default_tokenizer())
    more = [(700, "I'll ask: don't " * 4000, *[None] * 9), (701, "x" * 9000, *[None] * 9), (702, "É́   a\x1cb <|endoftext|> é", *[None] * 9)]
    docs = edge_docs(spark).unionByName(spark.createDataFrame(more, edge_docs(spark).schema))
    got = packing.pack_documents(docs, keep_ids=True).collect()
    want = Counter()
    for r in [*edge_rows(), *more]:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            x = ids[p : p + 4096]
            want[(r[0], p // 4096, p, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), tuple(x))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096 and len(at) == -(-sum(r.length for r in got) // 4096)
    path = write_tables(spark, tmp_path, empty_docs(spark))
    assert collect(packing.op1_best_fit_packing(spark, path)) == []


@pytest.mark.parametrize("seed", range(8))
def test_local_search(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, rng.choice([30, 60, 100]) + 1, 300)
    bins = packing.best_fit(lengths, 100)
    worse = [[i] for i in range(300)] if seed % 2 else bins
    better = packing.local_search([list(b) for b in worse], lengths, 100)
    for b in (bins, better):
        assert sorted(i for x in b for i in x) == list(range(300)) and max(int(lengths[x].sum()) for x in b) <= 100
    assert len(better) <= len(worse) and len(better) <= math.ceil(lengths.sum() / 100) + 8
    fill = lambda bs: sum(int(lengths[x].sum()) ** 2 for x in bs)
    assert fill(better) >= fill(worse)


def test_exchanges_empty_a_bin_that_moves_cannot():
    lengths = np.array([60, 30, 50, 40, 20])  # 60+30, 50+40 leave 20 alone; 60+40, 50+30+20 fit
    assert len(packing.local_search([[0, 1], [2, 3], [4]], lengths, 100)) == 2


# chat rotation


def test_rotation(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "who"), (1, 3, "ann", "me"), (1, 3, "ann", "me"), (2, 0, "system", "alone"), (None, 5, "cy", "x"), (None, None, "di", "é"), (3, 300, "ann", "late"), (3, 5, "bob", "early")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    got = chat_rotation.rotate(df).collect()
    want = []
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, s or "unknown", x or "", t) for k, t, s, x in rows if k == c), key=lambda x: x[:3])
        for who in {s for _, s, _, _ in turns} - {"system"}:
            at = 0
            for _, s, x, t in turns:
                role = "system" if s == "system" else "assistant" if s == who else "user"
                head = f"<|im_start|>{role}" + (f" name={s}" if role == "user" else "") + "\n"
                piece = head + x + "<|im_end|>\n"
                want.append((c, who, t, role, piece, at, at + len(head), len(x), int(role == "assistant")))
                at += len(piece)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert chat_rotation.rotate(df.limit(0)).count() == 0


def test_rotation_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = sorted(con.execute(chat_rotation.ORACLE_SQL).fetchall(), key=repr)
    assert collect(chat_rotation.op6_chat_rotation(spark, SF)) == want
