"""The engine: statements and DataFrames in, DataFrames out."""

from __future__ import annotations

import logging
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.config import Config
from lamina.errors import CommitConflict, InvalidColumns, InvalidValue, TableNotFound
from lamina.functions.types import coerce, guarded, logical, of_spark
from lamina.operators.compaction import Load, arranged, compact
from lamina.operators.engines import replacing
from lamina.plans import statements as S
from lamina.plans.select import qualifiers, remaining_columns, table_refs
from lamina.sources.catalog import PART_SEQ, ROW_SEQ, Catalog, ColumnDef, TableDef, define, valid_name
from lamina.sources.fs import shared_root
from lamina.sources.parts import Part, PartStore

log = logging.getLogger(__name__)


class Engine:
    """Tables below one folder, over a Spark session of its own settings.

    ``sql`` runs one statement; SELECT gives a lazy DataFrame that Catalyst has analysed,
    others a row ``OK``. Column names are case-sensitive, integer overflow is an error,
    times are UTC.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, config: Config | None = None) -> None:
        self.config = config or Config()
        self.spark = spark.newSession()
        for key, value in (("spark.sql.caseSensitive", "true"), ("spark.sql.ansi.enabled", "true"), ("spark.sql.session.timeZone", "UTC")):
            self.spark.conf.set(key, value)
        self.root = root or self.config.root or shared_root(spark, "tables")
        self.catalog = Catalog(self.spark, self.root)
        self.load = Load(self.config.merge_below)
        self.external: dict[tuple[str, str], str] = {}
        self.elapsed = 0.0

    # ---- statements

    def sql(self, text: str) -> DataFrame:
        """Runs one statement. ``elapsed`` then holds its seconds on the driver (for SELECT: of planning)."""
        began = time.perf_counter()
        plan = S.parse(text)
        weight = self.load.enter({S.Select: "select", S.InsertValues: "insert", S.InsertSelect: "insert"}.get(type(plan), "ddl"))
        try:
            return self._run(plan)
        finally:
            self.load.leave(weight)
            self.elapsed = time.perf_counter() - began

    def _run(self, plan) -> DataFrame:
        if isinstance(plan, S.Select):
            return self.select(plan.text)
        if isinstance(plan, S.CreateDatabase):
            self.catalog.create_database(plan.name, plan.if_not_exists)
        elif isinstance(plan, S.CreateTable):
            key = lambda k: None if k is None else list(k)
            table = define(plan.database, plan.name, list(plan.columns), key(plan.order_by), key(plan.primary_key), plan.engine, self.config.index_granularity)
            self.catalog.create_table(table, plan.if_not_exists)
        elif isinstance(plan, S.InsertValues):
            self.insert_rows(plan.database, plan.name, list(plan.columns), list(plan.rows))
        elif isinstance(plan, S.InsertSelect):
            self.insert_df(plan.database, plan.name, self.select(plan.query).toDF(*plan.columns))
        elif isinstance(plan, S.DropTable):
            self.catalog.drop_table(plan.database, plan.name, plan.if_exists)
        elif isinstance(plan, S.DropDatabase):
            self.catalog.drop_database(plan.name, plan.if_exists)
        elif isinstance(plan, S.Optimize):
            self.compact(plan.database, plan.name, None if plan.final else 2)
        return self.spark.createDataFrame([("OK",)], "OK string")

    def select(self, text: str) -> DataFrame:
        """A query in Spark's SQL; ``database.table [FINAL]`` is one of this engine's tables or attached Parquet tables."""
        refs = table_refs(text)
        views: dict = {}
        edits = [*refs, *((a, b, None) for a, b in qualifiers(text, refs))]
        for start, end, ref in sorted(edits, key=lambda e: -e[0]):
            if ref is None:
                text = text[:start] + text[end:]
                continue
            if ref not in views:
                views[ref] = f"lamina_{uuid.uuid4().hex}"
                self.table(ref.database, ref.name, ref.final).createOrReplaceTempView(views[ref])
            after = text[end:].split(None, 2)[:2]
            named = after and (after[0].upper() == "AS" or (after[0][0].isalpha() or after[0][0] in "_`") and after[0].upper() not in _NOT_ALIAS)
            text = f"{text[:start]}{views[ref]}{'' if named else f' AS `{ref.name}`'}{text[end:]}"
        try:
            return self.spark.sql(remaining_columns(text))
        finally:
            for view in views.values():
                self.spark.catalog.dropTempView(view)

    # ---- tables

    def attach_parquet(self, database: str, name: str, path: str) -> None:
        """Lets queries read the Parquet table at ``path`` as ``database.name``; it cannot be written."""
        self.external[(valid_name(database), valid_name(name))] = path

    def parts(self, database: str, name: str) -> PartStore:
        if (database, name) in self.external:
            raise TableNotFound(f"{database}.{name} is attached, not a table of this engine")
        table = self.catalog.table(database, name)
        return PartStore(self.spark, self.catalog.table_path(database, name), table, self.config.compression)

    def table(self, database: str, name: str, final: bool = False) -> DataFrame:
        """The rows of all live parts. With ``final``, of a replacing table only the last row of each key, as after a full merge."""
        if path := self.external.get((database, name)):
            return self.spark.read.parquet(path)
        store = self.parts(database, name)
        df, table = store.read(), store.table
        if final and table.engine == "ReplacingMergeTree":
            df = replacing(df, list(table.primary_key), list(table.order_by), [PART_SEQ, ROW_SEQ])
        return df.select(*table.schema.names)

    def create_like(self, database: str, name: str, df: DataFrame, order_by: list[str], primary_key: list[str] | None = None, engine: str = "MergeTree") -> TableDef:
        """A table with the columns of ``df``, all nullable; types beyond the declared ones pass through."""
        columns = [ColumnDef(f.name, of_spark(f.dataType).name) for f in df.schema.fields]
        table = define(database, name, columns, order_by, primary_key, engine, self.config.index_granularity)
        self.catalog.create_table(table)
        return table

    def insert_rows(self, database: str, name: str, columns: list[str], rows: list[tuple]) -> Part | None:
        """Inserts literal rows as one part; a later row counts as later where keys are equal."""
        store = self.parts(database, name)
        kinds = [logical(store.table.column(c).type) for c in columns]
        fields = [store.table.schema[c] for c in columns]
        values = [tuple(coerce(v, k) for v, k in zip(row, kinds, strict=True)) for row in rows]
        for c, field, column in zip(columns, fields, zip(*values)):
            if not field.nullable and None in column:
                raise InvalidValue(f"column {c} cannot be NULL")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        df = self.spark.createDataFrame([(*row, i) for i, row in enumerate(values)], f"{ddl}, `{ROW_SEQ}` long")
        return self._add(store, df)

    def insert_df(self, database: str, name: str, df: DataFrame, order: list[str] | None = None, source: str | None = None, epoch: int = -1) -> Part | None:
        """Inserts a DataFrame as one part: columns by name, checked while written, omitted ones filled.

        ``order`` names columns of ``df`` by which a row is later than another of the same
        sort key (they need not be columns of the table); without it that is arbitrary.
        With ``source`` an ``epoch`` is inserted at most once.
        """
        store = self.parts(database, name)
        if unknown := [c for c in df.columns if c not in store.table.schema.names and c not in (order or [])]:
            raise InvalidColumns(f"{database}.{name} has no column {unknown[0]}")
        if len(set(df.columns)) < len(df.columns):
            raise InvalidColumns("a column is given twice")
        seq = F.monotonically_increasing_id()
        if order:
            df = df.sort(*order)
        return self._add(store, df.withColumn(ROW_SEQ, seq), source, epoch)

    def _add(self, store: PartStore, df: DataFrame, source: str | None = None, epoch: int = -1) -> Part | None:
        table, out = store.table, []
        for c in table.columns:
            kind = logical(c.type)
            if c.name in df.columns:
                out.append(guarded(F.col(f"`{c.name}`"), df.schema[c.name].dataType, kind, c.name, c.nullable).alias(c.name))
            elif c.has_default or c.nullable:
                out.append(F.lit(c.default).cast(kind.spark).alias(c.name))
            else:
                raise InvalidColumns(f"column {c.name} has neither a value nor a default")
        return store.add(arranged(df.select(*out, ROW_SEQ), table), source, epoch)

    def compact(self, database: str, name: str, max_parts: int | None = None, alike: bool = False) -> Part | None:
        """Merges the oldest ``max_parts`` parts, or all; with ``alike`` the neighbours with the fewest rows."""
        return compact(self.parts(database, name), max_parts, alike)

    def compact_if_idle(self, max_parts: int | None = 2) -> int:
        """One merge step on every table that has more than one part, as long as the load allows it; returns the merges.

        A table that another writer has just changed is left for the next time.
        """
        done = 0
        for database in self.catalog.databases():
            for name in self.catalog.tables(database):
                if self.idle() and len(self.parts(database, name).manifest().parts) > 1:
                    try:
                        done += self.compact(database, name, max_parts, alike=True) is not None
                    except CommitConflict:
                        log.info("%s.%s changed during a merge", database, name)
        return done

    def idle(self) -> bool:
        """Whether the load allows a merge. Spark jobs at work count as running SELECTs, whose DataFrames are run after ``sql`` returns."""
        jobs = len(self.spark.sparkContext.statusTracker().getActiveJobsIds())
        return self.load.allows_merge(jobs * self.load.weights["select"])

    def vacuum(self, database: str, name: str, older_than: float = 0.0) -> list[str]:
        """Deletes what no live manifest lists; give ``older_than`` seconds where writers may be at work."""
        return self.parts(database, name).vacuum(older_than)


_NOT_ALIAS = {
    "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW", "QUALIFY", "JOIN", "INNER", "LEFT", "RIGHT",
    "FULL", "CROSS", "ANTI", "SEMI", "NATURAL", "ON", "USING", "LATERAL", "PIVOT", "UNPIVOT", "TABLESAMPLE", "SORT", "CLUSTER", "DISTRIBUTE",
}


class Merger(threading.Thread):
    """Merges in the background while the engine's load allows.

    A step that fails is logged and tried again, after twice the time for each failure in
    turn and ``most_seconds`` at most. ``stop`` waits for the step at work and raises what
    the last step failed with.
    """

    def __init__(self, engine: Engine, seconds: float | None = None, most_seconds: float = 60.0) -> None:
        super().__init__(daemon=True)
        self.most_seconds = most_seconds
        self.engine, self.seconds = engine, seconds or engine.config.merge_seconds
        self.ending, self.failure, self.merges = threading.Event(), None, 0

    def run(self) -> None:
        wait = self.seconds
        while not self.ending.wait(wait):
            try:
                self.merges += self.engine.compact_if_idle()
                self.failure, wait = None, self.seconds
            except Exception as e:  # the thread outlives it
                log.exception("a merge failed")
                self.failure, wait = e, min(2 * wait, max(self.most_seconds, self.seconds))

    def stop(self) -> None:
        self.ending.set()
        self.join()
        if self.failure is not None:
            raise self.failure
