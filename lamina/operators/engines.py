"""What a table engine does to rows, as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.errors import InvalidKey


def _need(df: DataFrame, key: list[str]) -> None:
    if missing := [k for k in key if k not in df.columns]:
        raise InvalidKey(f"no column {missing[0]}")


def merge_tree(df: DataFrame, order_by: list[str], tie: list[str] | None = None) -> DataFrame:
    """Rows sorted by key within each partition; every row stays. NULLs come first, ``tie`` orders equal keys.

    No shuffle: a part is a set of sorted files.
    """
    _need(df, order_by)
    return df.sortWithinPartitions(*order_by, *(tie or []))


def replacing(df: DataFrame, primary_key: list[str], order_by: list[str], tie: list[str] | None = None) -> DataFrame:
    """Of the rows of each primary key the last: greatest by the sort key, then by ``tie``.

    NULL is a key value like any other and sorts lowest. The rank filter is applied
    before the shuffle as well, so a key with very many rows sends one from each task.
    """
    _need(df, [*primary_key, *order_by])
    rank = "__rank"
    last = [F.col(c).desc_nulls_last() for c in [*order_by[len(primary_key) :], *(tie or [])]]
    window = Window.partitionBy(*primary_key).orderBy(*(last or [F.lit(0)]))
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1).drop(rank)


def replacing_max_by(df: DataFrame, primary_key: list[str], order_by: list[str]) -> DataFrame:
    """``replacing`` as one aggregate. Columns of equal keys must differ in ``order_by``, or any of the last rows may win."""
    _need(df, [*primary_key, *order_by])
    rest = [c for c in df.columns if c not in primary_key]
    best = F.max_by(F.struct(*rest), F.struct(*order_by)).alias("__last")
    return df.groupBy(*primary_key).agg(best).select(*[F.col(f"__last.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])
