"""Small tables with the awkward rows every operator must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs_frame(spark, texts, extra=()):
    """texts: list of text or (doc_id, text)."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc_id, text, "en" if i % 3 else None, f"s{i % 2}", len(text) if text is not None else None))
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit(c))
    return df


def vocabulary(n=200, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 8))) for _ in range(n)]


def random_texts(n, seed=2, words=200, longest=120):
    r, v = random.Random(seed), vocabulary(words)
    return [" ".join(r.choice(v) for _ in range(r.randint(0, longest))) for _ in range(n)]


AWKWARD = [None, "", " \t\n", "a", "A  b\tc d", "word " * 30_000, "\u0001 é́ \U0001f600 ＡＢＣ", "same text here", "same  text\there", "same text here"]

#: Names that operators use inside: extra columns may be called so.
CLASHING = ("fp", "a", "b", "u", "v", "key", "name", "level", "root", "book", "shard", "group", "bin", "n", "i", "x", "y", "low", "_id", "_sha", "host", "part", "score", "size")
