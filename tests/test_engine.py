"""Tables, inserts, merges, recovery and streams on small hand-made rows."""

import json
import time

import pytest
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import functions as F

from lamina import __main__ as prompt
from lamina import errors as E
from lamina.engine import Engine, Merger
from lamina.errors import CommitConflict
from lamina.operators.compaction import with_defaults
from lamina.operators.engines import merge_tree, replacing, replacing_max_by
from lamina.operators.granules import candidates, marks
from lamina.sources.parts import Manifest


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/root")
    e.sql("CREATE DATABASE db")
    return e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_users(engine):
    engine.sql("CREATE TABLE db.users (id UInt64, name String, age UInt8, email String) ENGINE = MergeTree() PRIMARY KEY (id, age) ORDER BY (id, age, name)")
    engine.sql("INSERT INTO db.users (id, name, age, email) VALUES (1, 'Alice', 25, 'alice@example.com'), (2, 'Alice', 30, 'alice@example.com')")
    engine.sql("INSERT INTO db.users (id, name, age, email) VALUES (3, 'Charlie', 35, 'charlie@example.com'), (4, 'Diana', 28, 'diana@example.com')")
    assert engine.sql("SELECT name, age FROM db.users").count() == 4
    assert rows(engine.sql("SELECT name, age FROM db.users WHERE id > 2 AND id <= 4 ORDER BY id LIMIT 1")) == [("Charlie", 35)]
    assert engine.sql("SELECT age, * FROM db.users").columns == ["age", "id", "name", "email"]


def test_versions_before_and_after_merge(engine):
    engine.sql("CREATE TABLE db.v (id UInt64, version String, name String, updated_at UInt64) ENGINE = ReplacingMergeTree() PRIMARY KEY (id) ORDER BY (id, updated_at)")
    engine.sql("INSERT INTO db.v (id, version, name, updated_at) VALUES (1, 'v1', 'Alice', 1000), (2, 'v1', 'Bob', 1000), (3, 'v1', 'Charlie', 1000)")
    engine.sql("INSERT INTO db.v (id, version, name, updated_at) VALUES (1, 'v2', 'Alice Updated', 2000), (2, 'v2', 'Bob Updated', 2000)")
    engine.sql("INSERT INTO db.v (id, version, name, updated_at) VALUES (1, 'v3', 'Alice Final', 3000)")
    last = [(1, "v3", "Alice Final", 3000), (2, "v2", "Bob Updated", 2000), (3, "v1", "Charlie", 1000)]
    assert engine.table("db", "v").count() == 6
    assert rows(engine.sql("SELECT * FROM db.v FINAL")) == last
    reader = engine.table("db", "v")
    engine.compact("db", "v", 2)
    assert engine.table("db", "v").count() == 4
    engine.compact("db", "v")
    assert rows(engine.table("db", "v")) == last
    assert engine.compact("db", "v", 2) is None
    assert reader.count() == 6  # parts of an older manifest are still there
    assert len(engine.vacuum("db", "v")) == 4
    assert rows(Engine(engine.spark, engine.root).table("db", "v")) == last


@pytest.mark.parametrize("split", [0, 1, 3, 5])
def test_replacing_golden_rows_however_inserted(engine, split):
    given = [("1", "v1", "old"), ("1", "v2", "mid"), ("2", "v1", "old"), ("2", "v3", "new"), ("3", "v1", "only"), ("1", "v3", "newest")]
    engine.sql("CREATE TABLE db.t (id String, version String, d String) ENGINE=ReplacingMergeTree PRIMARY KEY id ORDER BY (id, version)")
    for part in (given[:split], given[split:]):
        if part:
            engine.insert_rows("db", "t", ["id", "version", "d"], part)
    want = [("1", "v3", "newest"), ("2", "v3", "new"), ("3", "v1", "only")]
    assert rows(engine.table("db", "t", final=True)) == want
    engine.compact("db", "t")
    assert rows(engine.table("db", "t")) == want


def test_replacing_functions_agree_and_take_null_keys(spark):
    given = [("a", "q", 1), ("b", "w", 2), ("b", "e", 3), ("c", "d", 4), ("a", "q", 5), ("d", "w", 6), ("b", "w", 7), (None, "x", 8), (None, "x", 9)]
    df = spark.createDataFrame(given, "c1 string, c2 string, c3 int")
    want = {("a", "q", 5), ("b", "e", 3), ("b", "w", 7), ("c", "d", 4), ("d", "w", 6), (None, "x", 9)}
    assert {tuple(r) for r in replacing(df, ["c1", "c2"], ["c1", "c2", "c3"]).collect()} == want
    assert {tuple(r) for r in replacing_max_by(df, ["c1", "c2"], ["c3"]).collect()} == want
    assert [r.c3 for r in merge_tree(df.coalesce(1), ["c2", "c3"]).collect()] == [4, 3, 1, 5, 2, 6, 7, 8, 9]
    with pytest.raises(E.InvalidKey):
        merge_tree(df, ["nope"])


def test_ties_take_the_later_row_and_part(engine):
    engine.sql("CREATE TABLE db.t (id Int32, v Int32) ENGINE=ReplacingMergeTree() ORDER BY (id)")
    engine.sql("INSERT INTO db.t (id, v) VALUES (1, 1), (1, 2), (2, 1)")
    engine.sql("INSERT INTO db.t (id, v) VALUES (1, 0), (2, NULL)")
    assert rows(engine.table("db", "t", final=True)) == [(1, 0), (2, None)]
    engine.compact("db", "t")
    assert rows(engine.table("db", "t")) == [(1, 0), (2, None)]


def test_defaults_nulls_and_domains(engine):
    engine.sql("CREATE TABLE db.t (id UInt8, u UUID, n Int8 DEFAULT 5, s String NOT NULL DEFAULT 'x', b Bool) ORDER BY id")
    engine.sql("INSERT INTO db.t (id) VALUES (255)")
    assert rows(engine.table("db", "t")) == [(255, None, 5, "x", None)]
    for values in ("(256)", "(-1)", "('1')", "(1.5)", "(TRUE)"):
        with pytest.raises(E.InvalidValue):
            engine.sql(f"INSERT INTO db.t (id) VALUES {values}")
    for columns, values in (("s", "(NULL)"), ("u", "('not-a-uuid')"), ("b", "(1)"), ("n", "(128)")):
        with pytest.raises(E.InvalidValue):
            engine.sql(f"INSERT INTO db.t ({columns}) VALUES {values}")
    engine.sql("INSERT INTO db.t (id, n) VALUES (+1, -128)")
    with pytest.raises(SparkRuntimeException):
        engine.insert_df("db", "t", engine.spark.range(300, 302))
    with pytest.raises(SparkRuntimeException):
        engine.insert_df("db", "t", engine.spark.sql("SELECT CAST(NULL AS STRING) s"))
    with pytest.raises(E.InvalidValue):
        engine.insert_df("db", "t", engine.spark.sql("SELECT 'x' AS id"))
    assert engine.table("db", "t").count() == 2  # failed inserts leave no part


def test_required_column_without_default(engine):
    engine.sql("CREATE TABLE db.t (a Int32 NOT NULL, b Int32) ORDER BY a")
    with pytest.raises(E.InvalidColumns):
        engine.sql("INSERT INTO db.t (b) VALUES (1)")


def test_empty_table_and_empty_insert(engine):
    engine.sql("CREATE TABLE db.t (a Int32) ORDER BY a")
    assert engine.sql("SELECT * FROM db.t").collect() == []
    engine.insert_df("db", "t", engine.spark.createDataFrame([], "a int"))
    assert engine.table("db", "t").count() == 0 and engine.compact("db", "t") is None


def test_insert_select_join_and_window(engine):
    engine.sql("CREATE TABLE db.a (k Int64, v Int64) ORDER BY k")
    engine.insert_df("db", "a", engine.spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    engine.sql("INSERT INTO db.a (k, v) SELECT k + 10, v FROM db.a WHERE k < 3")
    assert engine.table("db", "a").count() == 13
    joined = engine.sql("SELECT x.k FROM db.a x, db.a AS y WHERE x.k = y.v AND y.k IN (SELECT k FROM db.a WHERE k > 1)")
    table = [(k, 2 * k) for k in range(10)] + [(k + 10, 2 * k) for k in range(3)]
    assert rows(joined) == sorted((x,) for x, _ in table for y, v in table if x == v and y > 1)
    assert engine.sql("WITH t AS (SELECT v FROM db.a) SELECT count(DISTINCT v) c FROM t").first().c == 10


def test_pruning_reaches_the_files(engine):
    engine.sql("CREATE TABLE db.t (id Int64, v Int64, w Int64) ORDER BY id")
    engine.insert_df("db", "t", engine.spark.range(20000).select("id", (F.col("id") % 7).alias("v"), F.lit(1).cast("long").alias("w")))
    df = engine.sql("SELECT v FROM db.t WHERE id >= 9000 AND NOT id = 9005")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,9000)" in plan and "ReadSchema: struct<id:bigint,v:bigint>" in plan
    assert df.count() == 10999


def test_marks_and_candidates(spark):
    part = spark.range(1, 32769).repartition(1).sortWithinPartitions("id")
    first = [r.id for r in marks(part, ["id"]).orderBy("granule").collect()]
    assert first == [1, 8193, 16385, 24577]
    given = [1, 8193, 8193, 16385, 24577]
    want = {
        "=": ([2], [0, 1, 2], [4], []), ">": ([2, 3, 4], [2, 3, 4], [4], [0, 1, 2, 3, 4]), ">=": ([2, 3, 4], [0, 1, 2, 3, 4], [4], [0, 1, 2, 3, 4]),
        "<": ([0, 1, 2], [0], [0, 1, 2, 3, 4], []), "<=": ([0, 1, 2], [0, 1, 2], [0, 1, 2, 3, 4], []), "!=": ([0, 1, 2, 3, 4],) * 4,
    }
    for op, by_value in want.items():
        assert tuple(candidates(given, op, v) for v in (9000, 8193, 30000, 0)) == by_value, op


def test_concurrent_commits_and_conflicts(engine):
    engine.sql("CREATE TABLE db.t (a Int32) ENGINE=ReplacingMergeTree ORDER BY a")
    one, two = engine.parts("db", "t"), engine.parts("db", "t")
    assert [one.reserve(), two.reserve(), one.reserve()] == [1, 2, 3]
    engine.sql("INSERT INTO db.t (a) VALUES (1)")
    stale = engine.parts("db", "t").manifest()
    engine.sql("INSERT INTO db.t (a) VALUES (2)")
    engine.compact("db", "t")
    with pytest.raises(E.CommitConflict):
        one.replace(stale.parts, one.read())
    assert isinstance(one.commit(lambda now: None), Manifest)
    assert not one.store.create(f"{one.path}/manifest/{one.manifest().version:012d}.json", "x")
    assert rows(engine.table("db", "t")) == [(1,), (2,)]


def test_unpublished_parts_are_not_seen_and_vacuumed(engine):
    engine.sql("CREATE TABLE db.t (a Int32) ORDER BY a")
    engine.sql("INSERT INTO db.t (a) VALUES (1)")
    store = engine.parts("db", "t")
    store.write(store.read(), 99)
    assert rows(Engine(engine.spark, engine.root).table("db", "t")) == [(1,)]
    assert len(engine.vacuum("db", "t")) == 1


def test_load_holds_merges_back(engine):
    engine.sql("CREATE TABLE db.t (a Int32) ORDER BY a")
    for i in range(3):
        engine.sql(f"INSERT INTO db.t (a) VALUES ({i})")
    engine.load.running = 30
    assert engine.compact_if_idle() == 0
    engine.load.running = 0
    assert engine.compact_if_idle() == 1
    merger = Merger(engine, 0.05)
    merger.start()
    for _ in range(200):
        if len(engine.parts("db", "t").manifest().parts) == 1:
            break
        merger.join(0.1)
    merger.stop()
    assert rows(engine.table("db", "t")) == [(0,), (1,), (2,)] and len(engine.parts("db", "t").manifest().parts) == 1


def test_stream_is_inserted_once(engine, tmp_path):
    from lamina.streaming.ingest import stream_into

    engine.sql("CREATE TABLE db.s (a Int64, t Int64) ENGINE=ReplacingMergeTree() PRIMARY KEY a ORDER BY (a, t)")
    for i in range(3):
        engine.spark.range(5).select(F.col("id").alias("a"), F.lit(i).cast("long").alias("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = engine.spark.readStream.schema("a long, t long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_into(engine, stream, "db", "s", f"{tmp_path}/cp", source="in", compact_every=2).awaitTermination()
    assert rows(engine.table("db", "s", final=True)) == [(i, 2) for i in range(5)]
    before = engine.parts("db", "s").manifest()
    assert before.epoch("in") == 2
    assert engine.insert_df("db", "s", engine.spark.sql("SELECT 9L a, 9L t"), source="in", epoch=2) is None
    assert engine.parts("db", "s").manifest() == before


def test_missing_column_reads_as_default(engine):
    engine.sql("CREATE TABLE db.t (a Int32, b Int32 DEFAULT 3) ORDER BY a")
    table = engine.catalog.table("db", "t")
    assert with_defaults(engine.spark.sql("SELECT 1 AS a"), table).first().b == 3


def test_drop(engine):
    engine.sql("CREATE TABLE db.t (a Int32)")
    engine.sql("DROP TABLE db.t")
    with pytest.raises(E.TableNotFound):
        engine.sql("SELECT * FROM db.t")
    with pytest.raises(E.TableNotFound):
        engine.sql("DROP TABLE db.t")
    assert engine.sql("DROP TABLE IF EXISTS db.t").first().OK == "OK"
    engine.sql("DROP DATABASE db")
    assert engine.catalog.databases() == []
    engine.sql("DROP DATABASE IF EXISTS db")
    for name in ("DROP DATABASE `../x`", "CREATE DATABASE `a=`"):
        with pytest.raises(E.InvalidName):
            engine.sql(name)


def test_names_are_case_sensitive_and_hidden_ones_stay_hidden(engine):
    engine.sql("CREATE TABLE db.t (a Int32, flag Bool) ORDER BY a")
    for bad in ("SELECT A FROM db.t", "SELECT a FROM (SELECT a FROM db.t) x WHERE flag", "SELECT __part_seq FROM db.t", "SELECT a FROM db.t WHERE a"):
        with pytest.raises(AnalysisException):
            engine.sql(bad)


def test_a_merger_outlives_conflicts_and_failures(engine, monkeypatch):
    for i in range(3):
        if i == 0:
            engine.sql("CREATE TABLE db.m (id Int32)")
        engine.insert_rows("db", "m", ["id"], [(i,)])
    real, left = engine.compact, [CommitConflict("lost a race"), RuntimeError("a disk"), None]

    def compact(*args, **named):
        fault = left.pop(0) if left else None
        if fault:
            raise fault
        return real(*args, **named)

    monkeypatch.setattr(engine, "compact", compact)
    merger = Merger(engine, 0.02, 0.05)
    merger.start()
    for _ in range(600):
        if len(engine.parts("db", "m").manifest().parts) == 1:
            break
        time.sleep(0.05)
    merger.stop()  # raises nothing: the last step was well
    assert merger.merges >= 1 and rows(engine.table("db", "m")) == [(0,), (1,), (2,)]


def test_background_merges_rewrite_few_rows(engine):
    engine.sql("CREATE TABLE db.g (id Int32)")
    for i in range(4):
        engine.insert_rows("db", "g", ["id"], [(i,)])
    written = 0
    while (part := engine.compact("db", "g", 2, alike=True)) is not None:
        written += part.rows
    assert written == 8 and rows(engine.table("db", "g")) == [(i,) for i in range(4)]


def test_a_merge_fills_columns_that_a_part_lacks(engine):
    engine.sql("CREATE TABLE db.w (id Int32)")
    engine.insert_rows("db", "w", ["id"], [(1,)])
    path = f"{engine.catalog.table_path('db', 'w')}/metadata.json"
    old = json.loads(engine.catalog.store.read(path))
    old["columns"].append({"name": "b", "type": "Int32", "nullable": True, "default": "3", "has_default": True})
    engine.catalog.store.delete(path)
    engine.catalog.store.create(path, json.dumps(old))
    engine.insert_rows("db", "w", ["id", "b"], [(2, 5)])
    assert rows(engine.sql("SELECT id, coalesce(b, -1) FROM db.w")) == [(1, -1), (2, 5)]  # a scan gives NULL
    engine.compact("db", "w")
    assert rows(engine.table("db", "w")) == [(1, 3), (2, 5)]


def test_jobs_at_work_hold_merges_back(engine, monkeypatch):
    class Busy:
        def getActiveJobsIds(self):  # noqa: N802
            return range(8)

    monkeypatch.setattr(type(engine.spark.sparkContext), "statusTracker", lambda self: Busy())
    assert not engine.idle()


def test_the_prompt_goes_on_after_any_statement(engine, capsys):
    for line in ("SELECT nothing FROM db.nowhere", "SELECT misspelt FROM (SELECT 1 AS a)", "SELECT 1 AS one"):
        prompt.step(engine, line)
    out = capsys.readouterr().out
    assert "TableNotFound" in out and "AnalysisException" in out and "one" in out


def test_vacuum_spares_what_is_young(engine):
    engine.sql("CREATE TABLE db.y (id Int32)")
    for i in range(2):
        engine.insert_rows("db", "y", ["id"], [(i,)])
    engine.compact("db", "y")
    assert engine.vacuum("db", "y", older_than=3600) == [] and len(engine.vacuum("db", "y")) == 2


def test_tables_are_told_from_other_uses_of_from(engine):
    engine.sql("CREATE TABLE db.a (id Int32, s String)")
    engine.insert_rows("db", "a", ["id", "s"], [(1, "xx"), (2, None)])
    assert rows(engine.sql("SELECT x.id FROM db.a x JOIN db.a y ON x.s IS NOT DISTINCT FROM y.s WHERE y.id = 2")) == [(2,)]
    assert rows(engine.sql("SELECT substring(a.s FROM a.id) FROM db.a WHERE a.s IS DISTINCT FROM a.id || 'z' AND a.id = 1")) == [("xx",)]
    assert rows(engine.sql("SELECT trim(BOTH 'x' FROM a.s) AS t, EXTRACT(YEAR FROM DATE'2020-01-01') AS y FROM db.a WHERE id = 1")) == [("", 2020)]
    assert rows(engine.sql("SELECT db.a.id FROM db.a WHERE db.a.s IS NULL ORDER BY db.a.id")) == [(2,)]
