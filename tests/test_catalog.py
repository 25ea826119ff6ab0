"""The writable catalog: key models, loads, deletes, schema changes, views, what outlasts an engine."""

import pytest

from tessera.catalog import CatalogError
from tessera.engine import Engine


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, warehouse=f"file://{tmp_path}")


def rows(engine, sql):
    return [tuple(r) for r in engine.query(sql).collect()]


def test_duplicate_rows_defaults_truncate_and_overwrite(engine):
    engine.execute("CREATE DATABASE d; USE d; CREATE TABLE t (a INT NOT NULL, b VARCHAR(10) DEFAULT 'x;y', m MAP<INT, VARCHAR(5)>) DUPLICATE KEY(a) DISTRIBUTED BY HASH(a) BUCKETS 2 PROPERTIES ('replication_num' = '1')")
    engine.execute("INSERT INTO t (a) VALUES (1), (1); INSERT INTO d.t (b, a) SELECT 'z', cast(id AS int) FROM range(2, 4)")
    assert rows(engine, "SELECT a, b, m FROM t ORDER BY 1, 2") == [(1, "x;y", None), (1, "x;y", None), (2, "z", None), (3, "z", None)]
    assert rows(engine, "SELECT count(*), max(t.a) FROM d.t WHERE t.a > 1") == [(2, 3)]
    assert rows(engine, "SELECT x.a, y.a FROM d.t x JOIN d.t AS y ON x.a = y.a AND x.a = 3") == [(3, 3)]
    engine.execute("INSERT OVERWRITE t SELECT 7, 'o', map(1, 'k')")
    assert rows(engine, "SELECT * FROM t") == [(7, "o", {1: "k"})]
    engine.execute("TRUNCATE TABLE t")
    assert rows(engine, "SELECT * FROM t") == []
    with pytest.raises(CatalogError):
        engine.query("INSERT INTO t VALUES (1)")


def test_primary_key_last_row_wins_and_conditions(engine):
    engine.execute('CREATE TABLE p (k INT, v INT, w STRING) ENGINE=OLAP PRIMARY KEY(`k`); INSERT INTO p VALUES (1, 10, "a"), (2, 20, "b"), (2, 21, "c"), (NULL, 0, "n")')
    assert rows(engine, "SELECT * FROM p ORDER BY k") == [(None, 0, "n"), (1, 10, "a"), (2, 21, "c")]
    engine.execute('INSERT INTO p PROPERTIES ("merge_condition" = "v") VALUES (1, 9, "low"), (2, 30, "high"), (3, 1, "new")')
    assert rows(engine, "SELECT * FROM p WHERE k IS NOT NULL ORDER BY k") == [(1, 10, "a"), (2, 30, "high"), (3, 1, "new")]
    engine.execute('INSERT INTO p (k, w) PROPERTIES ("partial_update" = "true") VALUES (1, "part"), (4, "only")')
    assert rows(engine, "SELECT * FROM p WHERE k IN (1, 4) ORDER BY k") == [(1, 10, "part"), (4, None, "only")]
    engine.execute("DELETE FROM p WHERE v > 9 OR k IS NULL")
    assert rows(engine, "SELECT k, v FROM p ORDER BY k") == [(3, 1), (4, None)]
    for bad, said in (("k", "should not be primary key"), ("nope", "does not exist")):
        with pytest.raises(CatalogError, match=said):
            engine.query(f'INSERT INTO p PROPERTIES ("merge_condition" = "{bad}") VALUES (1, 1, "x")')


def test_aggregate_key_merges(engine):
    engine.execute("CREATE TABLE g (k INT, s BIGINT SUM, lo INT MIN, hi INT MAX, r STRING REPLACE, q STRING REPLACE_IF_NOT_NULL, b BITMAP BITMAP_UNION) AGGREGATE KEY(k)")
    engine.execute("INSERT INTO g SELECT 1, 2L, 5, 5, 'a', 'a', to_bitmap(1); INSERT INTO g SELECT 1, 3L, 4, 9, NULL, NULL, to_bitmap(2); INSERT INTO g SELECT 2, 1L, 1, 1, 'z', 'z', to_bitmap(1)")
    want = [(1, 5, 4, 9, None, "a", [1, 2]), (2, 1, 1, 1, "z", "z", [1])]
    assert rows(engine, "SELECT * FROM g ORDER BY k") == want
    engine.catalog.compact("g")
    engine.catalog.vacuum("g")
    assert rows(engine, "SELECT * FROM g ORDER BY k") == want


def test_delete_rewrites_only_segments_with_a_match(engine):
    engine.execute("CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (2); INSERT INTO t VALUES (3), (NULL)")
    first, second = engine.catalog.table("t").segments
    engine.execute("DELETE FROM t WHERE a = 2")
    assert first not in engine.catalog.table("t").segments and second in engine.catalog.table("t").segments
    assert sorted(rows(engine, "SELECT a FROM t"), key=str) == [(1,), (3,), (None,)]
    version = engine.catalog.table("t").version
    engine.execute("DELETE FROM t WHERE a = 99")
    assert engine.catalog.table("t").version == version


def test_schema_changes_and_files_taken_in(engine, spark, tmp_path):
    spark.range(2).selectExpr("cast(id AS int) AS a", "'f' AS b").write.parquet(f"{tmp_path}/outside")
    engine.execute(f"CREATE TABLE t (a INT, b STRING); INSERT INTO t VALUES (5, 'i'); ALTER TABLE t ADD FILES FROM 'file://{tmp_path}/outside'")
    assert rows(engine, "SELECT * FROM t ORDER BY a") == [(0, "f"), (1, "f"), (5, "i")]
    engine.execute("DELETE FROM t WHERE a = 0; ALTER TABLE t ADD COLUMN c INT; ALTER TABLE t ADD COLUMN e INT DEFAULT 8; ALTER TABLE t MODIFY COLUMN a BIGINT; ALTER TABLE t RENAME COLUMN b TO bb; ALTER TABLE t DROP COLUMN c; INSERT INTO t (a) VALUES (6)")
    assert rows(engine, "SELECT * FROM t ORDER BY a") == [(1, "f", 8), (5, "i", 8), (6, None, 8)]
    engine.execute("ALTER TABLE t RENAME u")
    assert rows(engine, "SELECT count(*) FROM u") == [(3,)]
    assert spark.read.parquet(f"{tmp_path}/outside").count() == 2


def test_auto_increment_and_labels(engine):
    engine.execute("CREATE TABLE t (id BIGINT AUTO_INCREMENT, v INT) PRIMARY KEY(id); INSERT INTO t (v) VALUES (1); INSERT INTO t VALUES (100, 2); INSERT INTO t (v) VALUES (3)")
    assert rows(engine, "SELECT id, v FROM t ORDER BY id") == [(1, 1), (100, 2), (101, 3)]
    engine.execute("INSERT INTO t WITH LABEL l1 (v) VALUES (4); INSERT INTO t WITH LABEL l1 (v) VALUES (4)")
    assert rows(engine, "SELECT count(*) FROM t") == [(4,)]


def test_materialized_views_follow_their_tables(engine):
    engine.execute("CREATE TABLE t (k INT, v INT); INSERT INTO t VALUES (1, 1), (1, 2); CREATE MATERIALIZED VIEW m REFRESH ASYNC AS SELECT k, sum(v) AS s FROM t GROUP BY k; CREATE MATERIALIZED VIEW o REFRESH MANUAL AS SELECT count(*) AS n FROM t")
    engine.execute("INSERT INTO t VALUES (2, 5)")
    assert rows(engine, "SELECT * FROM m ORDER BY k") == [(1, 3), (2, 5)]
    assert rows(engine, "SELECT * FROM o") == [(2,)]
    engine.execute("REFRESH MATERIALIZED VIEW o")
    assert rows(engine, "SELECT * FROM o") == [(3,)]
    assert rows(engine, "SELECT table_name, refresh_type FROM information_schema.materialized_views ORDER BY 1") == [("m", "ASYNC"), ("o", "MANUAL")]


def test_information_schema_and_what_outlasts_an_engine(engine, spark):
    engine.execute("CREATE DATABASE d; CREATE TABLE d.t (a INT, b DATETIME) UNIQUE KEY(a); INSERT INTO d.t VALUES (1, '2024-01-02 03:04:05')")
    again = Engine(spark, warehouse=engine.catalog.root)
    assert rows(again, "SELECT a, year(b) FROM d.t") == [(1, 2024)]
    assert rows(again, "SELECT column_name, data_type, column_key FROM information_schema.columns WHERE table_name = 't' ORDER BY ordinal_position") == [("a", "int", "PRI"), ("b", "timestamp_ntz", "")]
    assert rows(again, "SELECT t.table_type FROM information_schema.tables t WHERE t.table_schema = 'd'") == [("BASE TABLE",)]
    again.execute("DROP TABLE d.t; DROP DATABASE d")
    assert rows(again, "SELECT schema_name FROM information_schema.schemata") == [("default",)]
    with pytest.raises(CatalogError):
        again.query("DROP TABLE d.t")


def test_a_failed_write_publishes_nothing(engine):
    engine.execute("CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")
    before = engine.catalog.table("t")
    with pytest.raises(Exception, match="boom"):
        engine.query("INSERT INTO t SELECT raise_error('boom')")
    assert engine.catalog.table("t") == before and len(engine.catalog.files.names(f"{engine.catalog.root}/default/t/data")) == 1


def test_qualify(engine):
    v = "(SELECT * FROM VALUES (1, 5), (1, 7), (2, 3) AS s(k, v))"
    assert rows(engine, f"SELECT k, v FROM {v} t QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1 ORDER BY k") == [(1, 7), (2, 3)]
    assert rows(engine, f"SELECT k, rank() OVER (PARTITION BY k ORDER BY v) AS r FROM {v} t WHERE v > 3 QUALIFY r = 2") == [(1, 2)]
    assert rows(engine, f"SELECT max(v) FROM (SELECT v FROM {v} t QUALIFY row_number() OVER (ORDER BY v) < 3) u") == [(5,)]
