"""The SQL surface: table functions, casts, slices, keys, funnels, against plain versions."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tessera.engine import Engine
from tessera.functions.udfs import sort_key


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, [1, 2, 3], ["a"]), (2, [4], ["b", "c"]), (3, [], []), (4, None, None)], "id int, a array<int>, b array<string>"))
    return e


def rows(engine, sql):
    return [tuple(r) for r in engine.query(sql).collect()]


def test_unnest_beside_a_table(engine):
    assert rows(engine, "SELECT id, x FROM t, unnest(a) AS u(x) ORDER BY id, x") == [(1, 1), (1, 2), (1, 3), (2, 4)]
    assert rows(engine, "SELECT id, unnest FROM t CROSS JOIN UNNEST(a) ORDER BY 1, 2") == [(1, 1), (1, 2), (1, 3), (2, 4)]
    assert rows(engine, "SELECT t.id, x, y FROM t CROSS JOIN LATERAL UNNEST(t.a, t.b) AS u(x, y) ORDER BY 1, 2 NULLS LAST") == [(1, 1, "a"), (1, 2, None), (1, 3, None), (2, 4, "b"), (2, None, "c")]
    assert rows(engine, "SELECT id, x FROM t LEFT JOIN unnest(a) u(x) ON TRUE WHERE id > 2 ORDER BY id") == [(3, None), (4, None)]


def test_bitmap_table_functions(engine):
    assert rows(engine, "SELECT id, unnest_bitmap FROM t, unnest_bitmap(array_to_bitmap(array(5L, 1L, 5L))) u WHERE id = 1 ORDER BY 2") == [(1, 1), (1, 5)]
    assert rows(engine, "SELECT c FROM t, subdivide_bitmap(array_to_bitmap(sequence(1L, 5L)), 2) u(c) WHERE id = 1") == [([1, 2],), ([3, 4],), ([5],)]


def test_bitmap_union_count_of_bitmaps_and_numbers(engine):
    assert rows(engine, "SELECT bitmap_union_count(x) FROM (SELECT array_to_bitmap(array(1L, 2L)) x UNION ALL SELECT array_to_bitmap(array(2L, 3L)) UNION ALL SELECT bitmap_empty()) s") == [(3,)]
    assert rows(engine, "SELECT bitmap_union_count(x) FROM VALUES (1), (2), (2), (NULL) AS s(x)") == [(2,)]


@pytest.mark.parametrize(("unit", "seconds"), [("second", 1), ("minute", 60), ("hour", 3600), ("day", 86400), ("week", 7 * 86400)])
def test_slices_from_year_one(engine, unit, seconds):
    rng, origin = random.Random(1), dt.datetime(1, 1, 1)
    for _ in range(12):
        ts = origin + dt.timedelta(seconds=rng.randrange(9000 * 366 * 86400))
        n = rng.choice([1, 2, 5, 7, 1000])
        low = origin + (ts - origin) // dt.timedelta(seconds=n * seconds) * dt.timedelta(seconds=n * seconds)
        got = rows(engine, f"SELECT time_slice('{ts.isoformat(' ')}', INTERVAL {n} {unit}), time_slice(timestamp_ntz'{ts.isoformat(' ')}', {n}, '{unit}', 'ceil')")
        assert got == [(low, low + dt.timedelta(seconds=n * seconds))]


def test_slices_at_the_ends(engine):
    sql = "SELECT time_slice('9999-12-31 23:59:59', INTERVAL 5 second, ceil), time_slice('2023-12-31 03:12:04', INTERVAL 2147483647 second), time_slice('2023-12-31 03:12:04', INTERVAL 5 year), time_slice('9999-12-31 23:59:59', interval 5 month, ceil), time_slice('2023-10-31 23:59:59', INTERVAL 17 millisecond, ceil)"
    size = dt.timedelta(seconds=2147483647)
    low = dt.datetime(1, 1, 1) + (dt.datetime(2023, 12, 31, 3, 12, 4) - dt.datetime(1, 1, 1)) // size * size
    assert rows(engine, sql) == [(None, low, dt.datetime(2021, 1, 1), None, dt.datetime(2023, 10, 31, 23, 59, 59, 1000))]


def test_formats_keep_unknown_tokens(engine):
    assert rows(engine, "SELECT date_format(timestamp_ntz'2024-02-03 04:05:06', '%Y-%c-%e %w %U %H:%i:%s at')") == [("2024-02-03 %w %U 04:05:06 at",)]


def test_numbers_as_dates(engine):
    assert rows(engine, "SELECT cast(20240102 AS date), year(cast(n as date)) FROM VALUES (20230405) AS s(n)") == [(dt.date(2024, 1, 2), 2023)]


def test_array_map_over_three(engine):
    assert rows(engine, "SELECT array_map((x, y, z) -> x + y * z, array(1, 2), array(3, 4), array(5, 6))") == [([16, 26],)]


def test_group_concat_length_is_a_setting(spark):
    e = Engine(spark)
    e.query("SET group_concat_max_len = 3")
    assert rows(e, "SELECT group_concat(x) FROM VALUES ('aa'), ('bb') AS s(x)") == [("aa,",)]
    assert rows(Engine(spark), "SELECT group_concat(x) FROM VALUES ('aa'), ('bb') AS s(x)") == [("aa,bb",)]


def test_sort_keys_order_as_values_do(engine):
    values = [[None, -(2**63), -5, 0, 9, 10, 2**62], [None, float("-inf"), -2.5, -0.0, 1e-9, 9.0, 10.0], [None, "", "a", "a\0", "ab", "b"], [None, Decimal("-10.5"), Decimal("9"), Decimal("10.25")], [None, dt.date(1, 1, 1), dt.date(2024, 1, 1)]]
    for column in values:
        keys = [sort_key([v, "tail"]) for v in column]
        assert keys == sorted(keys) and len(set(keys)) == len(keys)
    got = rows(engine, "SELECT x FROM VALUES (9), (10), (NULL), (-1) AS s(x) ORDER BY encode_sort_key(x)")
    assert [r[0] for r in got] == [None, -1, 9, 10]


def test_funnel_and_retention_in_sql(spark):
    from pyspark.sql import functions as F

    from tessera.operators import events as ops

    rng = random.Random(2)
    events = [(rng.randrange(6), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(400)), rng.choice("abc")) for _ in range(200)]
    df = spark.createDataFrame(events, "u int, ts timestamp, k string")
    e = Engine(spark)
    e.register("e", df)
    kinds = [F.col("k") == x for x in "abc"]
    for mode in range(8):
        want = {r.u: r.level for r in ops.window_funnel(df, ["u"], "ts", 1800, kinds, bool(mode & 1), bool(mode & 2), bool(mode & 4)).collect()}
        assert dict(rows(e, f"SELECT u, window_funnel(1800, ts, {mode}, array(k = 'a', k = 'b', k = 'c')) FROM e GROUP BY u")) == want
    want = {u: [any(x[0] == u and x[2] == "a" for x in events), *(any(x[0] == u and x[2] == "a" for x in events) and any(x[0] == u and x[2] == k for x in events) for k in "bc")] for u in range(6)}
    assert dict(rows(e, "SELECT u, retention(array(k = 'a', k = 'b', k = 'c')) FROM e GROUP BY u")) == want


def test_empty_sketch(engine):
    assert rows(engine, "SELECT coalesce(hll_cardinality(hll_empty()), 0)") == [(0,)]
