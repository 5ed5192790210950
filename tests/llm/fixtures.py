"""Small tables with the awkward cases, and plain Python forms of the contracts' word rules."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n_words string, spans string, sid string, tkey string, piece string"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def make_texts(seed=1, n=60):
    """Texts over few words, so that windows, shingles and lines repeat in and across them."""
    rng = random.Random(seed)
    vocab = ["a", "bb", "Öl", "été", "C", "dd.", "e", "ff,", "über", "x" * 40]
    passage = " ".join(rng.choice(vocab) + str(rng.randrange(50)) for _ in range(30))
    out = []
    for i in range(n):
        w = [rng.choice(vocab) + (str(rng.randrange(40)) if rng.random() < 0.7 else "") for _ in range(rng.choice([0, 1, 4, 5, 9, 13, 14, 40, 120]))]
        t = " ".join(w)
        if i % 5 == 0:
            t = t + "\n" + passage + " " + t
        if i % 7 == 0:
            t = t.replace(" ", "\t\x0b ", 3) + "    x"
        out.append(t)
    out += out[5:9] + [out[10] + " tail", out[10].upper()]
    return out


def rows(texts):
    return [(i, t, "en" if i % 2 else "de", "s", len(t or ""), -i, "x", None, "y", "z", "p") for i, t in enumerate(texts)]


def edge_rows():
    texts = make_texts()
    long = " ".join(f"w{i % 997}x{i % 1013}" for i in range(30000))
    r = rows([None, "", "  \n\t ", long, long, "one", *texts])
    n = len(r)
    twice = (n, texts[20], "de", None, None, None, None, None, None, None, None)
    nameless = (None, texts[11], None, None, None, None, None, None, None, None, None)
    return [*r, twice, twice, nameless, (None, None, None, None, None, None, None, None, None, None, None), (n + 1, "1 2 3 ... !!", None, "s", 1, 1, "", "", "", "", "")]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(5)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def write_tables(spark, path, docs, **others):
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    for name, df in others.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
