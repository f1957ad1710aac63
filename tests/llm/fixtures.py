"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("place", "fp", "root", "id", "number", "u", "v", "a", "b", "length", "mark")]])
WORDS = [a + b for a in "ka lo mi ten sur vé dra pol un ix".split() for b in "ra sel mo ti an ost é zig nu ke".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(40)]
    out = list(base)
    out += [base[i % 5] for i in range(30)]  # copies
    for i in range(20):  # near copies
        w = base[i % 10].split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    passage = prose(rng, 30)
    out += [prose(rng, 10) + " " + passage + " " + prose(rng, 10) for _ in range(15)]
    out += ["", None, " \t\n", "one", "one two", "Ça  va?", "x" * 3000, "ab " * 900, prose(rng, 4000), " \U0001F600 é" * 40, "", None]
    return out


def documents(spark, seed=1, rows=None):
    rows = list(enumerate(texts(seed))) if rows is None else rows
    rows = [*rows, rows[3], (None, "row without a key")] if rows else []
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x"] * 11) for i, t in rows], DOCS).repartition(4)


def empty(spark):
    return spark.createDataFrame([], DOCS)
