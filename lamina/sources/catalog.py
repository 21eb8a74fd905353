"""Databases and tables: names, column definitions, keys, and their metadata files."""

from __future__ import annotations

import json
import re
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from lamina.errors import DatabaseAlreadyExists, DatabaseNotFound, InvalidColumns, InvalidKey, InvalidName, InvalidValue, TableAlreadyExists, TableNotFound, UnsupportedOption
from lamina.functions.types import coerce, logical
from lamina.sources.fs import Store

NAME = re.compile(r"[A-Za-z0-9_]+")
ENGINES = ("MergeTree", "ReplacingMergeTree")
#: Kept in every part to break ties between equal keys; never shown.
PART_SEQ, ROW_SEQ = "__part_seq", "__row_seq"


def valid_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise InvalidName(f"{name!r} is no name: letters, digits and underscores only")
    return name


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    default: object = None
    has_default: bool = False


@dataclass(frozen=True)
class TableDef:
    """A table as created: columns, ORDER BY, PRIMARY KEY (a prefix of it), engine and index granularity."""

    database: str
    name: str
    columns: tuple[ColumnDef, ...]
    order_by: tuple[str, ...]
    primary_key: tuple[str, ...]
    engine: str = "MergeTree"
    index_granularity: int = 8192
    created_at: float = field(default=0.0, compare=False)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, logical(c.type).spark, c.nullable) for c in self.columns])

    @property
    def stored(self) -> T.StructType:
        """With the hidden columns; all nullable, as a column absent from a part reads as NULL."""
        fields = [T.StructField(f.name, f.dataType, True) for f in self.schema.fields]
        return T.StructType([*fields, T.StructField(PART_SEQ, T.LongType()), T.StructField(ROW_SEQ, T.LongType())])

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise InvalidColumns(f"{self.database}.{self.name} has no column {name}")


def define(
    database: str,
    name: str,
    columns: list[ColumnDef],
    order_by: list[str] | None = None,
    primary_key: list[str] | None = None,
    engine: str = "MergeTree",
    index_granularity: int = 8192,
) -> TableDef:
    """A checked definition. A missing key is the other one; without either, the first column."""
    valid_name(database), valid_name(name)
    if not columns:
        raise InvalidColumns("a table needs a column")
    names = [valid_name(c.name) for c in columns]
    if len(set(names)) < len(names):
        raise InvalidColumns("a column is declared twice")
    if {PART_SEQ, ROW_SEQ} & set(names):
        raise InvalidName(f"{PART_SEQ} and {ROW_SEQ} are kept for the engine")
    if engine not in ENGINES:
        raise UnsupportedOption(f"no engine {engine}")
    checked = []
    for c in columns:
        kind = logical(c.type)
        if c.has_default and c.default is None and not c.nullable:
            raise InvalidValue(f"column {c.name}: NOT NULL and DEFAULT NULL exclude each other")
        default = coerce(c.default, kind) if c.has_default and not c.type.startswith("spark:") else c.default
        checked.append(ColumnDef(c.name, kind.name, c.nullable, None if default is None else str(default) if kind.is_integer else default, c.has_default))
    for what, key in (("ORDER BY", order_by), ("PRIMARY KEY", primary_key)):
        if key is not None:
            if not key:
                raise InvalidKey(f"{what} is empty")
            if unknown := [k for k in key if k not in names]:
                raise InvalidKey(f"{what}: no column {unknown[0]}")
            if len(set(key)) < len(key):
                raise InvalidKey(f"{what} names a column twice")
    order_by = order_by or primary_key or names[:1]
    primary_key = primary_key or order_by
    if order_by[: len(primary_key)] != primary_key:
        raise InvalidKey("PRIMARY KEY must be a prefix of ORDER BY")
    return TableDef(database, name, tuple(checked), tuple(order_by), tuple(primary_key), engine, index_granularity, time.time())


class Catalog:
    """Databases are folders below ``root``, tables folders with a metadata.json: nothing else is state.

    A new Catalog over a folder sees all that is there, so a restart needs no loading.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self.store = root.rstrip("/"), Store(spark)
        self.store.mkdirs(self.root)

    def database_path(self, database: str) -> str:
        return f"{self.root}/{valid_name(database)}"

    def table_path(self, database: str, table: str) -> str:
        return f"{self.database_path(database)}/{valid_name(table)}"

    def databases(self) -> list[str]:
        return [n for n in self.store.names(self.root) if NAME.fullmatch(n)]

    def tables(self, database: str) -> list[str]:
        self.need_database(database)
        path = self.database_path(database)
        return [n for n in self.store.names(path) if NAME.fullmatch(n) and self.store.exists(f"{path}/{n}/metadata.json")]

    def need_database(self, database: str) -> None:
        if not self.store.exists(self.database_path(database)):
            raise DatabaseNotFound(f"no database {database}")

    def create_database(self, database: str, if_not_exists: bool = False) -> bool:
        """False if it was there and ``if_not_exists``."""
        path = self.database_path(database)
        if self.store.exists(path):
            if if_not_exists:
                return False
            raise DatabaseAlreadyExists(f"database {database} exists")
        self.store.mkdirs(path)
        return True

    def create_table(self, table: TableDef, if_not_exists: bool = False) -> bool:
        self.need_database(table.database)
        path = self.table_path(table.database, table.name)
        if not self.store.exists(f"{path}/metadata.json"):
            self.store.mkdirs(path)
            if self.store.create(f"{path}/metadata.json", json.dumps({"version": 1, **asdict(table)}, indent=1)):
                return True
        if if_not_exists:
            return False
        raise TableAlreadyExists(f"table {table.database}.{table.name} exists")

    def table(self, database: str, name: str) -> TableDef:
        self.need_database(database)
        path = f"{self.table_path(database, name)}/metadata.json"
        if not self.store.exists(path):
            raise TableNotFound(f"no table {database}.{name}")
        found = json.loads(self.store.read(path))
        found.pop("version")
        found["columns"] = tuple(ColumnDef(**c) for c in found["columns"])
        return TableDef(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})

    def drop_metadata(self, database: str, name: str) -> None:
        """Forgets a table's definition and leaves its parts, for a definition with further columns to take them over."""
        self.store.delete(f"{self.table_path(database, name)}/metadata.json")

    def drop_table(self, database: str, name: str, if_exists: bool = False) -> bool:
        try:
            self.table(database, name)
        except (TableNotFound, DatabaseNotFound):
            if if_exists:
                return False
            raise
        # the metadata first: from then on the table is gone, whatever happens to its files
        self.drop_metadata(database, name)
        self.store.delete(self.table_path(database, name))
        return True

    def drop_database(self, database: str, if_exists: bool = False) -> bool:
        """Drops its tables too."""
        if not self.store.exists(self.database_path(database)):
            if if_exists:
                return False
            raise DatabaseNotFound(f"no database {database}")
        self.store.delete(self.database_path(database))
        return True
