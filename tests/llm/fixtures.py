"""Documents with all that may be odd about a table."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h int, size string, comp string, block int, tokens string, shard string, prob string, accepted string, host string, rank int, lead string"


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    vocab = [f"{random.Random(k).choice('bcdfgklmnprst')}{random.Random(k + 1).choice('aeiou')}{k:x}" for k in range(words)]
    glue = ["the", "a", "is", "of", "was"]
    return " ".join(rng.choice(glue) if rng.random() < 0.3 else rng.choice(vocab) for _ in range(n))


def edited(text: str, seed: int, share: float = 0.03) -> str:
    rng = random.Random(seed)
    return " ".join(f"new{rng.randrange(999)}" if rng.random() < share else w for w in text.split())


def odd_rows() -> list[tuple]:
    base = prose(1, 300)
    long = prose(2, 60_000)
    texts = [
        (1, base), (2, base), (2, base), (3, edited(base, 5)), (4, prose(3, 250)), (5, None), (6, ""), (None, base), (None, None), (7, long), (8, long + " tail"), (9, "!!! ... 123"),
        (10, "one"), (11, "the cat"), (12, "é ñ ü ß 漢字 😀 the the the"), (13, "\n\n \t"), (14, prose(4, 300)), (15, edited(prose(4, 300), 9)), (16, "x" * 5000), (17, "\u0000﻿ the end of it"),
    ]
    return [(i, t, None if k % 5 == 4 else "en" if k % 2 else "fr", None if k % 3 == 2 else "s", None if t is None else len(t), "z", 1, "z", "z", 1, "z", "z", "z", "z", "z", 1, "z") for k, (i, t) in enumerate(texts)]


def odd_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
