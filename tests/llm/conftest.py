import random

import pytest
from pyspark.sql import functions as F

PASSAGE = " ".join(f"p{i}" for i in range(60))


def _text(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, blanks, near and exact copies, passages, repeated rows and a very long text."""
    rng = random.Random(5)
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "one", "en"), (5, "ONE", "de"), (6, "a b c d", "en"), (7, "a b c d", "en"),
            (8, "!!! ???", "fr"), (9, "<|endoftext|> it's 42, é.", "fr"), (None, "a b c d", None), (None, None, None)]
    base = _text(rng, 120).split()
    for i in range(10, 30):  # near copies of one text, of changing distance
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w), "en"))
    rows += [(i, _text(rng, 20) + " " + PASSAGE + " " + _text(rng, i), "de") for i in range(30, 36)]
    rows += [(36, "la la " * 60, "es"), (37, PASSAGE.upper(), "en"), (38, _text(rng, 60_000), "en"), (39, _text(rng, 300), "fr")]
    rows += [(40, "same row twice " * 20, "en")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("source", "row_id", "row_hash", "kept", "set_id", "label", "carried", "key", "n", "prefix", "_group", "component_id", "score", "held_out"):
        df = df.withColumn(name, F.lit("x") if len(name) % 2 else F.lit(None).cast("string"))
    return df.withColumn("n_chars", F.length("text").cast("long")).repartition(5), [(r[0], r[1]) for r in rows]
