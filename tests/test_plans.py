import pytest
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans"))
    tables = {
        "events": ([(9000 + i, i, ["click", "view", "buy"][i % 3], i * 0.25) for i in range(150)], "event_id long, user_id long, event_type string, value double"),
        "orders": ([(5000 + i, i * 700.0) for i in range(60)], "o_orderkey long, o_totalprice double"),
        "part": ([(700 + i, f"p{i}", i) for i in range(40)], "p_partkey long, p_name string, p_size int"),
        "region": ([(i,) for i in range(5)], "r_regionkey int"),
        "customer": ([(4000 + i, i % 25, ["MACHINERY", "BUILDING"][i % 2], 100.0 * i) for i in range(80)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{path}/{name}.parquet")
    return path, {name: rows for name, (rows, _) in tables.items()}


def test_whole_tables_are_queried(spark, folder):
    path, t = folder
    run = lambda name: [tuple(r) for r in registry.queries()[name](spark, path).collect()]
    assert sorted(run("join_range_bucketed")) == [(e, o) for e, _, _, v in t["events"] for o, p in t["orders"] if abs(v // 1 - p // 1000) <= 1]
    assert sorted(run("join_range_binned")) == [(e, p) for e, _, _, v in t["events"] for p, _, s in t["part"] if s <= v <= s + 0.5]
    kinds = [(e, None if k == "click" else k) for e, _, k, _ in t["events"]]
    assert run("sort_nulls_first") == sorted(kinds, key=lambda r: (r[1] or "", r[0]))
    assert run("sort_nulls_last_desc") == sorted(sorted(kinds), key=lambda r: r[1] or "", reverse=True)
    null = lambda k: None if k == 3 else k
    assert sorted(run("null_safe_equal_join")) == [(e, r) for e, u, _, _ in t["events"] for (r,) in t["region"] if null(u % 7) == null(r)]
    assert run("typeof_info") == [("bigint", "string")] * 40
    want = [(c, n if b >= 2000 else None, "NEW" if n < 9 else m) for c, n, m, b in t["customer"] if not (n < 9 and m == "MACHINERY") and (b >= 2000 or n < 9)]
    assert sorted(run("upsert_partial_delete")) == want


def test_a_full_bin_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "TILE_ROWS", 16, raising=False)
    events = [(i, 20.0 + i % 3 + 0.25) for i in range(120)] + [(900, 1.0), (901, None)]
    orders = [(i, 21000.0 + 10 * (i % 5)) for i in range(80)] + [(700, 2500.0), (701, None)]
    spark.createDataFrame(events, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [tuple(r) for r in registry.queries()["join_range_bucketed"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(g[:2] for g in got) == [(e, o) for e in range(120) for o in range(80)] + [(900, 700)]
    tasks = [g[2] for g in got]
    assert max(tasks.count(t) for t in set(tasks)) < len(got) / 2
