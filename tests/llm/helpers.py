"""Tables with every awkward case, and plain-Python counterparts of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, host string, size long, line string"


def awkward(spark, texts=()):
    """Nulls in every column, empty and very long texts, repeated rows and clashing column names."""
    rng = random.Random(5)
    long_ = " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) + str(rng.randint(0, 9999)) for _ in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t\n"), (4, "one"), (4, "one"), (5, long_), (6, long_), (None, "no id at all here"), (None, None), (7, "x" * 50_000), (8, "ünïcödé ☃ 日本語 text\r\nline\n\n"),
    ] + list(texts)
    rows = [(i, t, "en", "src", len(t) if t else 0, "k", "h", 1, "l") for i, t in rows]
    rows.append((None,) * 9)
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def shingles(text, n, short=True):
    w = words(text)
    if len(w) < n:
        return {tuple(w)} if w and short else set()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def prose(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))
