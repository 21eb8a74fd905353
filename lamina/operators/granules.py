"""The sparse index as data: a mark is the first key of each granule of a sorted part."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.errors import StatementError


def marks(part: DataFrame, key: list[str], granularity: int = 8192) -> DataFrame:
    """file, granule and the key columns of each granule's first row; ``part`` is sorted within its partitions.

    Each partition, which is a file once written, counts its granules from 0. Nothing is
    shuffled, and one row in ``granularity`` leaves a task.
    """
    at = F.monotonically_increasing_id()
    placed = part.select(*key, F.shiftright(at, 33).alias("file"), at.bitwiseAND((1 << 33) - 1).alias("__at"))
    first = placed.where(F.col("__at") % granularity == 0)
    return first.select("file", (F.col("__at") / granularity).cast("long").alias("granule"), *key)


def candidates(first: list, op: str, value: object) -> list[int]:
    """The granules of a file that may hold a key ``op value``, given its marks in order.

    A granule spans from its mark to the next; so that equal keys across an edge are
    found, the granule before the first mark that reaches the value counts too. Spark's
    reader prunes by page statistics; this is for planning and tests.
    """
    n, low, high = len(first), bisect_left(first, value), bisect_right(first, value)
    spans = {
        "=": (max(low - 1, 0), high),
        "<": (0, low),
        "<=": (0, high),
        ">": (max(high - 1, 0), n),
        ">=": (max(low - 1, 0), n),
        "!=": (0, n),
    }
    if op not in spans:
        raise StatementError(f"no comparison {op}")
    begin, end = spans[op]
    return list(range(begin, end)) if n else []
