"""The registered queries over the engine's own operators, with the same rows in DuckDB's SQL.

Each runs through ``Engine``: plain SELECTs over attached Parquet tables; table engines,
inserts and compaction over tables made in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.engine import Engine
from lamina.operators.engines import replacing, replacing_max_by
from lamina.operators.granules import marks
from lamina.sources.catalog import ColumnDef
from lamina.streaming.ingest import stream_into

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels")
Query = Callable[[SparkSession, str], DataFrame]

#: name: (statement for the engine, the same for DuckDB; None where it is the same but for the database)
SELECTS: dict[str, tuple[str, str | None]] = {
    "scan_all": ("SELECT * FROM sf.region", None),
    "project": ("SELECT c_name, c_acctbal FROM sf.customer", None),
    "wildcard_tail": ("SELECT c_name, * FROM sf.customer", "SELECT c_name, c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "cmp_chain": ("SELECT o_orderkey, o_custkey FROM sf.orders WHERE o_orderkey > 2 AND o_orderkey <= 4000", None),
    "flipped": ("SELECT o_orderkey, o_custkey FROM sf.orders WHERE 4000 >= o_orderkey", None),
    "neq": ("SELECT c_custkey, c_mktsegment FROM sf.customer WHERE c_mktsegment <> 'BUILDING'", None),
    "col_vs_col": ("SELECT l_orderkey, l_partkey, l_suppkey FROM sf.lineitem WHERE l_partkey = l_suppkey", None),
    "or_filter": ("SELECT o_orderkey, o_orderstatus, o_totalprice FROM sf.orders WHERE o_orderstatus = 'F' OR o_totalprice < 50000", None),
    "not_filter": ("SELECT o_orderkey FROM sf.orders WHERE NOT o_orderkey = 5", None),
    "bool_column": ("SELECT doc_id, bad FROM (SELECT doc_id, toxic = 1 AS bad FROM sf.labels) t WHERE bad", None),
    "const_true": ("SELECT r_regionkey, r_name FROM sf.region WHERE 1 = 1", None),
    "const_false": ("SELECT r_regionkey, r_name FROM sf.region WHERE 'a' = 'b'", None),
    "literal_true": ("SELECT r_regionkey FROM sf.region WHERE TRUE", None),
    "between_in_like": ("SELECT p_partkey, p_name FROM sf.part WHERE p_size BETWEEN 5 AND 20 AND p_partkey IN (1, 2, 3, 50, 51) OR p_name LIKE '%1'", None),
    "order_tuple_topk": ("SELECT o_orderkey, o_custkey FROM sf.orders ORDER BY o_custkey, o_orderkey LIMIT 5 OFFSET 3", None),
    "order_desc": ("SELECT o_orderkey, o_totalprice FROM sf.orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "order_by_all": ("SELECT n_regionkey, n_nationkey FROM sf.nation ORDER BY ALL LIMIT 7", "SELECT n_regionkey, n_nationkey FROM nation ORDER BY n_regionkey, n_nationkey LIMIT 7"),
    "offset_only": ("SELECT r_regionkey FROM sf.region ORDER BY r_regionkey OFFSET 2", None),
    "limit_zero": ("SELECT r_regionkey FROM sf.region LIMIT 0", None),
    "order_unprojected": ("SELECT c_name FROM sf.customer ORDER BY c_custkey LIMIT 10", None),
    "nested_subquery": (
        "SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT * FROM sf.orders WHERE o_totalprice > 1000) a WHERE o_orderkey > 100) b WHERE o_custkey < 150",
        None,
    ),
    "nested_limit": ("SELECT o_orderkey FROM (SELECT o_orderkey FROM sf.orders ORDER BY o_orderkey LIMIT 4 OFFSET 6) t ORDER BY o_orderkey LIMIT 4 OFFSET 2", None),
    "filter_over_limit": ("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey FROM sf.orders ORDER BY o_orderkey LIMIT 100) t WHERE o_custkey > 600", None),
    "join_aggregate": (
        "SELECT n.n_name, count(*) AS n_orders, sum(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_done FROM sf.orders o JOIN sf.customer c ON o.o_custkey = c.c_custkey JOIN sf.nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
        None,
    ),
    "window_rank": (
        "SELECT c_nationkey, c_custkey, rk FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rk FROM sf.customer) t WHERE rk <= 3",
        None,
    ),
    "order_tuple": ("SELECT o_orderkey, o_custkey FROM sf.orders ORDER BY (o_custkey, o_orderkey) LIMIT 7", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 7"),
    "order_nulls_last": (
        "SELECT k, n_name FROM (SELECT nullif(n_regionkey, 2) AS k, n_name FROM sf.nation) t ORDER BY k DESC NULLS LAST, n_name LIMIT 22",
        None,
    ),
    "order_null_key": ("SELECT k, n_name FROM (SELECT nullif(n_regionkey, 2) AS k, n_name FROM sf.nation) t ORDER BY k, n_name LIMIT 7", "SELECT k, n_name FROM (SELECT nullif(n_regionkey, 2) AS k, n_name FROM nation) t ORDER BY k NULLS FIRST, n_name LIMIT 7"),
    "null_comparison": ("SELECT n_nationkey FROM (SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM sf.nation) t WHERE NOT k = 1 OR k <> k", None),
    "negative_literal": ("SELECT c_custkey, c_acctbal FROM sf.customer WHERE c_acctbal < -100 AND -c_custkey <= -3", None),
    "other_operators": ("SELECT o_orderkey, o_orderkey % 7 + 2 * o_custkey AS n FROM sf.orders WHERE o_orderkey % 7 = 3 AND o_orderpriority || '!' LIKE '1%' AND o_custkey - 2 > 5", None),
    "distinct_from": ("SELECT a.n_nationkey FROM sf.nation a JOIN sf.region b ON nullif(a.n_regionkey, 2) IS NOT DISTINCT FROM nullif(b.r_regionkey, 2)", None),
    "extract_from": ("SELECT EXTRACT(YEAR FROM o.o_orderdate) AS y, count(*) AS n FROM sf.orders o GROUP BY EXTRACT(YEAR FROM o.o_orderdate)", None),
    "qualified_column": ("SELECT sf.customer.c_custkey, sf.nation.n_name FROM sf.customer JOIN sf.nation ON sf.customer.c_nationkey = sf.nation.n_nationkey WHERE sf.customer.c_acctbal > 9000", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000"),
    "comma_join": ("SELECT n.n_name, r.r_name FROM sf.nation n, sf.region r WHERE n.n_regionkey = r.r_regionkey", None),
    "having_distinct": ("SELECT DISTINCT n FROM (SELECT o_custkey, count(*) AS n FROM sf.orders GROUP BY o_custkey HAVING count(*) > 5) t", None),
    "union_all": ("SELECT n_name AS name FROM sf.nation UNION ALL SELECT r_name AS name FROM sf.region", None),
}

_LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_EVENT = ["user_id", "event_type", "event_id", "value"]
_LAST_LINE = f"SELECT {', '.join(_LINES)} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _LINES[2:])}) AS rk FROM lineitem) t WHERE rk = 1"
_LAST_EVENT = f"SELECT {', '.join(_EVENT)} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rk FROM events) t WHERE rk = 1"


def engine_over(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine in which ``sf.<table>`` are the Parquet tables of ``sf_dir``."""
    engine = Engine(spark)
    for name in TABLES:
        engine.attach_parquet("sf", name, f"{sf_dir}/{name}.parquet")
    return engine


def _select(text: str) -> Query:
    return lambda spark, sf_dir: engine_over(spark, sf_dir).sql(text)


def _lines(spark: SparkSession, sf_dir: str, engine_name: str, parts: int) -> Engine:
    """db.lines holds lineitem, inserted as ``parts`` parts by supplier, sorted by all its columns."""
    engine = engine_over(spark, sf_dir)
    df = engine.table("sf", "lineitem").select(*_LINES)
    engine.catalog.create_database("db")
    engine.create_like("db", "lines", df, _LINES, _LINES[:2], engine_name)
    for i in range(parts):
        engine.insert_df("db", "lines", df.where(F.col("l_suppkey") % parts == i))
    return engine


def merge_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts, read with a key filter that reaches the files."""
    return _lines(spark, sf_dir, "MergeTree", 3).sql("SELECT l_orderkey, l_linenumber, l_partkey FROM db.lines WHERE l_orderkey >= 100 AND l_orderkey < 900")


def merge_tree_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge of all parts changes no row."""
    engine = _lines(spark, sf_dir, "MergeTree", 3)
    engine.compact("db", "lines")
    return engine.table("db", "lines")


def replacing_pre_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before a merge, each part holds the last row of its keys: those of three parts are all seen."""
    return _lines(spark, sf_dir, "ReplacingMergeTree", 3).table("db", "lines")


def replacing_post_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a merge of all parts, one row a key is left."""
    engine = _lines(spark, sf_dir, "ReplacingMergeTree", 3)
    engine.compact("db", "lines")
    return engine.table("db", "lines")


def replacing_final_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FINAL before any merge gives what a merge would leave."""
    return _lines(spark, sf_dir, "ReplacingMergeTree", 3).sql(f"SELECT {', '.join(_LINES)} FROM db.lines FINAL")


def replacing_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = engine_over(spark, sf_dir).table("sf", "events")
    return replacing(events, ["user_id", "event_type"], ["user_id", "event_type", "ts", "event_id"]).select(*_EVENT)


def replacing_max_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = engine_over(spark, sf_dir).table("sf", "events")
    return replacing_max_by(events, ["user_id", "event_type"], ["ts", "event_id"]).select(*_EVENT)


def part_sequence_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal sort keys in two inserts: the later insert wins, before and after a merge."""
    engine = engine_over(spark, sf_dir)
    engine.sql("CREATE DATABASE db")
    engine.sql("CREATE TABLE db.nation (k Int32, name String, turn Int32) ENGINE = ReplacingMergeTree() ORDER BY (k)")
    engine.sql("INSERT INTO db.nation (k, name, turn) SELECT n_nationkey, n_name, 1 FROM sf.nation")
    engine.sql("INSERT INTO db.nation (k, name, turn) SELECT n_nationkey, n_name, 2 FROM sf.nation WHERE n_regionkey = 1")
    engine.sql("OPTIMIZE TABLE db.nation FINAL")
    return engine.sql("SELECT k, name, turn FROM db.nation")


def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VALUES with omitted columns: a default, a NULL, unsigned numbers and a UUID."""
    engine = engine_over(spark, sf_dir)
    engine.sql("CREATE DATABASE db")
    engine.sql("CREATE TABLE db.t (id UInt64, tag UUID, level UInt8 DEFAULT 7, note String NULL, ok Bool NOT NULL DEFAULT TRUE) ORDER BY (id)")
    engine.sql("INSERT INTO db.t (id, tag) VALUES (18446744073709551615, '123E4567-E89B-12D3-A456-426614174000'), (1, '123e4567e89b12d3a456426614174001')")
    engine.sql("INSERT INTO db.t (id, tag, level, note, ok) VALUES (2, '123e4567-e89b-12d3-a456-426614174002', 255, 'it''s', FALSE)")
    return engine.sql("SELECT CAST(id AS STRING) AS id, tag, CAST(level AS INT) AS level, note, ok FROM db.t")


def granule_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key of each 100 rows of one part sorted by key."""
    part = engine_over(spark, sf_dir).table("sf", "part").select("p_partkey").repartition(1).sortWithinPartitions("p_partkey")
    return marks(part, ["p_partkey"], 100).select("granule", "p_partkey")


def part_not_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AND, OR and NOT over the sort key of a table of parts."""
    return _lines(spark, sf_dir, "MergeTree", 2).sql("SELECT l_orderkey, l_linenumber, l_partkey FROM db.lines WHERE NOT (l_orderkey > 50 AND l_orderkey <= 9000 OR l_orderkey = 7)")


def missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose later parts have a column more: rows of older parts have NULL there."""
    engine = engine_over(spark, sf_dir)
    nations = engine.table("sf", "nation")
    engine.catalog.create_database("db")
    old = nations.select("n_nationkey", "n_name")
    engine.create_like("db", "t", old, ["n_nationkey"])
    engine.insert_df("db", "t", old.where("n_nationkey < 10"))
    table = engine.catalog.table("db", "t")
    more = replace(table, columns=(*table.columns, ColumnDef("n_regionkey", "Int32")))
    engine.catalog.drop_metadata("db", "t")
    engine.catalog.create_table(more)
    engine.insert_df("db", "t", nations.where("n_nationkey >= 10"))
    return engine.sql("SELECT n_nationkey, n_name, n_regionkey FROM db.t")


def drop_and_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and databases that were dropped can be made anew, and are empty; what is missing is skipped if asked."""
    engine = engine_over(spark, sf_dir)
    make = "CREATE TABLE IF NOT EXISTS db.r (k Int32, name String) ORDER BY (k)"
    fill = "INSERT INTO db.r (k, name) SELECT r_regionkey, r_name FROM sf.region"
    for statement in (
        "DROP DATABASE IF EXISTS db", "CREATE DATABASE db", "CREATE DATABASE IF NOT EXISTS db", make, make, fill,
        "DROP TABLE db.r", "DROP TABLE IF EXISTS db.r", make, fill, "DROP DATABASE db", "CREATE DATABASE db", make,
        f"{fill} WHERE r_regionkey > 1",
    ):
        engine.sql(statement)
    return engine.sql("SELECT k, name FROM db.r")


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events table, inserted by micro-batch and merged."""
    engine = engine_over(spark, sf_dir)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    engine.catalog.create_database("db")
    engine.create_like("db", "e", spark.createDataFrame([], schema), ["user_id", "event_type", "ts", "event_id"], ["user_id", "event_type"], "ReplacingMergeTree")
    stream = engine.spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    stream_into(engine, stream, "db", "e", f"{engine.root}/checkpoint").awaitTermination()
    return engine.sql(f"SELECT {', '.join(_EVENT)} FROM db.e FINAL")


FUNCTIONS: dict[str, tuple[Query, str]] = {
    "part_not_filter": (part_not_filter, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_orderkey > 50 AND l_orderkey <= 9000 OR l_orderkey = 7)"),
    "missing_column": (missing_column, "SELECT n_nationkey, n_name, CASE WHEN n_nationkey >= 10 THEN n_regionkey END AS n_regionkey FROM nation"),
    "drop_and_create": (drop_and_create, "SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_regionkey > 1"),
    "streamed_events": (streamed_events, _LAST_EVENT),
    "merge_tree_scan": (merge_tree_scan, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 900"),
    "merge_tree_compaction": (merge_tree_compaction, f"SELECT {', '.join(_LINES)} FROM lineitem"),
    "replacing_pre_merge": (replacing_pre_merge, _LAST_LINE.replace("PARTITION BY", "PARTITION BY l_suppkey % 3,")),
    "replacing_post_merge": (replacing_post_merge, _LAST_LINE),
    "replacing_final_lineitem": (replacing_final_lineitem, _LAST_LINE),
    "replacing_latest_event": (replacing_latest_event, _LAST_EVENT),
    "replacing_max_by": (replacing_max_by_event, _LAST_EVENT),
    "part_sequence_tie": (part_sequence_tie, "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS turn FROM nation"),
    "insert_defaults": (
        insert_defaults,
        "SELECT * FROM (VALUES ('18446744073709551615', '123e4567-e89b-12d3-a456-426614174000', 7, NULL, TRUE), ('1', '123e4567-e89b-12d3-a456-426614174001', 7, NULL, TRUE), ('2', '123e4567-e89b-12d3-a456-426614174002', 255, 'it''s', FALSE)) t(id, tag, level, note, ok)",
    ),
    "granule_marks": (granule_marks, "SELECT pos // 100 AS granule, p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) t WHERE pos % 100 = 0"),
}

QUERIES: dict[str, Query] = {name: _select(text) for name, (text, _) in SELECTS.items()} | {name: f for name, (f, _) in FUNCTIONS.items()}
ORACLE_SQL: dict[str, str] = {name: own or text.replace("sf.", "") for name, (text, own) in SELECTS.items()} | {name: sql for name, (_, sql) in FUNCTIONS.items()}
