"""Merging parts into one, under the table's engine."""

from __future__ import annotations

import threading
from functools import reduce
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.engines import merge_tree, replacing
from lamina.sources.catalog import PART_SEQ, ROW_SEQ, TableDef
from lamina.sources.parts import Part, PartStore


def arranged(df: DataFrame, table: TableDef) -> DataFrame:
    """Rows of one part: deduplicated where the engine says so, dealt by range of the sort key, sorted.

    The range also covers the hidden columns, so rows of one very frequent key are dealt
    to many tasks; AQE makes small inserts one file.
    """
    tie = [c for c in (PART_SEQ, ROW_SEQ) if c in df.columns]
    if table.engine == "ReplacingMergeTree":
        df = replacing(df, list(table.primary_key), list(table.order_by), tie)
    return merge_tree(df.repartitionByRange(*table.order_by, *tie), list(table.order_by), tie)


def compact(parts: PartStore, max_parts: int | None = None, alike: bool = False) -> Part | None:
    """Merges the ``max_parts`` oldest parts (all by default) into one; None if there is nothing to merge.

    With ``alike`` those neighbours that have the fewest rows together, of equal ones the
    oldest: parts then grow alike, and a row is rewritten a number of times that grows with
    the logarithm of the inserts. A column that a part lacks gets its default. Rows keep their hidden columns, so a later merge breaks ties as if all were merged at
    once. Readers of the old parts are not disturbed.
    """
    if max_parts is not None and max_parts < 2:
        raise ValueError("a merge takes two parts or more")
    live = parts.manifest().parts
    many = min(max_parts or len(live), len(live))
    begin = min(range(len(live) - many + 1), key=lambda i: (sum(p.rows for p in live[i : i + many]) * alike, i))
    old = live[begin : begin + many]
    if len(old) < 2 and not (len(old) == 1 and max_parts is None and parts.table.engine == "ReplacingMergeTree"):
        return None
    names = tuple(c.name for c in parts.table.columns)
    alike: dict[tuple[str, ...], list[Part]] = {}
    for p in old:
        alike.setdefault(tuple(n for n in names if not p.columns or n in p.columns), []).append(p)
    read = [with_defaults(parts.read(tuple(some), held), parts.table) for held, some in alike.items()]
    df = reduce(lambda a, b: a.unionByName(b), read)
    return parts.replace(old, arranged(df, parts.table))


def with_defaults(df: DataFrame, table: TableDef) -> DataFrame:
    """``df`` with each column of the table that it lacks, as its default or NULL."""
    for c in table.columns:
        if c.name not in df.columns:
            df = df.withColumn(c.name, F.lit(c.default).cast(table.schema[c.name].dataType))
    return df


@dataclass
class Load:
    """The weight of running statements; merges wait while it is at or above ``merge_below``."""

    merge_below: int = 30
    weights: dict[str, int] = field(default_factory=lambda: {"select": 4, "insert": 2, "ddl": 1, "skip": 0})
    running: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock)

    def enter(self, kind: str) -> int:
        with self.lock:
            self.running += self.weights[kind]
        return self.weights[kind]

    def leave(self, weight: int) -> None:
        with self.lock:
            self.running -= weight

    def allows_merge(self, others: int = 0) -> bool:
        """``others``: the weight of what runs beside the statements that were entered."""
        return max(self.running, others) < self.merge_below
