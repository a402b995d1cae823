"""A table that holds the awkward cases, and helpers of the corpus tests."""

from __future__ import annotations

import random

# columns that the operators use as names of their own
CLASHING = "doc_id long, text string, id string, row int, body string, mark string, fp long, n int"
WORDS = [f"w{k}" for k in range(400)]


def words(n: int, seed: int) -> str:
    chance = random.Random(seed)
    return " ".join(chance.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    shared, long = words(70, 1), words(30_000, 2)
    texts = [
        (1, None), (2, ""), (3, "   \n\t"), (4, "One line"), (5, "oNE LINE"), (6, "Éa eé"),
        (7, "éa eé"), (8, long), (9, long), (10, f"start of it {shared} end"),
        (11, f"other {shared}"), (11, f"other {shared}"), (11, "same id, other text"),
        (None, "no id"), (None, None), (None, f"{shared} without id"),
        (12, "a\nb\nc\nd\ne"), (13, "x\na\nb\nc\n\nd\ny"), (14, "ab " * 300), (15, "ab " * 300),
    ]
    return [(i, t, f"k{n}", n, "body", None, n, n) for n, (i, t) in enumerate(texts)]


def table(spark, empty: bool = False):
    return spark.createDataFrame([] if empty else rows(), CLASHING)


def plain(spark, texts: list, first: int = 0):
    return spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)],
                                 "doc_id long, text string")
