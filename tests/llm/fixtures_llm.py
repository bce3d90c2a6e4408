"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows,
extra columns whose names the operators use themselves."""
import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # clashing names
    *[T.StructField(n, T.StringType()) for n in
      ("id", "key", "size", "shard", "slot", "part", "component", "chunk", "blob", "rank", "label", "draw", "n",
       "number", "length", "score", "kept", "value", "node")]])
EXTRA = len(DOCS.fields) - 5


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * EXTRA)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=1):
    """About 70 rows: copies, near-copies, a shared passage, nulls, empty and long texts."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(5, 120)) for _ in range(30)]
    passage = sentence(rng, 60)
    rows = [row(i, t) for i, t in enumerate(texts)]
    rows += [row(100 + i, texts[0]) for i in range(8)]  # exact copies
    rows += [row(120 + i, texts[1].upper()) for i in range(2)]
    for i in range(8):  # near copies
        w = texts[2 + i % 3].split() + sentence(rng, 80).split()
        base = " ".join(w)
        w[rng.randrange(len(w))] = f"edit{i}"
        rows += [row(200 + 2 * i, base), row(201 + 2 * i, " ".join(w))]
    rows += [row(300 + i, sentence(rng, 20) + f" m{i}a\n" + passage + f"\t m{i}b " + sentence(rng, 15)) for i in range(4)]
    rows += [row(400, None, None, None), row(401, ""), row(402, "   \n"), row(403, "one"), row(404, "one"), row(405, "12 34 !?"),
             row(406, sentence(rng, 6000, 5000)), row(406, "same id other text"), row(None, texts[0]), row(None, None),
             row(50, texts[5]), row(50, texts[5]), row(407, "é" * 700 + " ünï 漢字 \U0001F600 x")]
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs_df(spark, rows):
    return spark.createDataFrame(rows, DOCS)
