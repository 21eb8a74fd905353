"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9))) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = prose(1, 30_000)
    rows = [
        (1, "Plain words here.\nAnd a line.\nAnd a line.", "en", "a", 42),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \t\n ", "fr", None, 4),
        (5, long_text, "en", "b", len(long_text)),
        (6, "x" * 200_000, None, "b", 200_000),
        (7, "élan vital 東京 ünïcode \U0001f600  nbsp em", "fr", "c", None),
        (8, "same text twice", "en", "c", 15),
        (9, "same text twice", "en", "c", 15),
        (9, "same text twice", "en", "c", 15),
        (None, "no id at all", "en", "a", 12),
        (None, "no id at all", "en", "a", 12),
        (None, None, None, None, None),
        (10, "!!! ### $$$ 123", "de", "", 15),
    ]
    return rows


def documents(spark, rows: list[tuple] | None = None, clash: bool = False):
    """A documents table; with ``clash``, further columns that have the names operators like to use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)
    if clash:
        for name in ("size", "src", "_key", "_bin", "_n", "bucket", "length", "fp", "_mark", "_known", "_clean", "_row", "copies", "held_out", "score", "words"):
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def as_list(df, *order: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
