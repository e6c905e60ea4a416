import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, h long, size string, target string, rid long, token string, keys string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def sentences(rng, n):
    return " ".join(words(rng, rng.randint(3, 9)).capitalize() + rng.choice(".!?,") for _ in range(n))


def odd_texts():
    """(doc_id, text, source): copies, near copies, shared passages, nulls, empty, blank, long and non-ASCII texts, repeated rows."""
    rng = random.Random(11)
    passage = sentences(rng, 14)
    base = [sentences(rng, 12) for _ in range(14)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(20 + i, base[0], "s1") for i in range(4)]  # exact copies
    for i in range(5):  # near copies: a word changed
        w = base[1].split(" ")
        w[3 * i + 2] = "changed" + str(i)
        rows.append((30 + i, " ".join(w), "s2"))
    rows += [(40 + i, sentences(rng, 3) + " " + passage + " " + sentences(rng, 3), "s0") for i in range(4)]
    long = sentences(rng, 900)
    rows += [(50, long, "s3"), (51, long[:20000] + sentences(rng, 40), "s3")]
    rows += [(60, None, "s0"), (61, "", "s1"), (62, " \n\t ", None), (63, "é" * 150, None), (64, "a" * 900, "s0"), (65, "日本語 " * 120, "é"), (66, "x", ""), (67, "one two three", "s1"), (68, "one two three", "s1")]
    rows += [(None, base[2], "s0"), (None, base[3] + " tail", None), (None, None, None)]
    rows += [(70, base[4], "s1"), (70, base[4], "s1"), (71, sentences(rng, 8), "s2"), (71, sentences(rng, 8), "s2")]  # repeated row; same id, other text
    return rows


def frame(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), 7, 8, "x", None, 9, "tok", "k") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_texts()).cache()


@pytest.fixture(scope="session")
def empty(spark, odd):
    return odd.where(F.lit(False))
