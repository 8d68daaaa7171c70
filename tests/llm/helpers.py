"""Small fixtures with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("component", T.IntegerType()), T.StructField("digest", T.StringType()),
    T.StructField("length", T.DoubleType()), T.StructField("fp", T.StringType()),
])


def words(rng, n, stock="the of and to in that is was for on with by this are from be as at ore tion ent ing".split()):
    return " ".join(rng.choice(stock) + rng.choice(["", "s", "ed", "ly", rng.choice(stock)]) for _ in range(n))


def texts(seed=0):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(30, 120)) for _ in range(12)]
    passage = words(rng, 60)
    out = list(base)
    out += [base[0], base[0].replace(" ", "\n\t "), base[1].upper(), base[2] + " tail", passage + " " + base[3], base[4] + "\n" + passage, words(rng, 5000)]
    out += [base[5].replace(" ", " ", 1), "one", "two words", "", "   \n ", None, "héé wörld 漢字 🙂 " * 30, base[6][:90]]
    return out


def docs(spark, seed=0, extra=()):
    rows = [(i * 3 % 101, t, "en", f"src{i % 2}", len(t or ""), "x", 1, "y", 0.5, "z") for i, t in enumerate(texts(seed))]
    rows += [rows[0], rows[12], (None, "null id text " * 20, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    rows += [(rows[1][0], "same id, other text", "en", "src0", 1, "x", 1, "y", 0.5, "z")]
    return spark.createDataFrame(rows + list(extra), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
