import pytest
from pyspark.sql import functions as F

from tessera.plans import ORACLES, QUERIES
from tests.oracle import assert_same, duck

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], SF)


def test_filters_and_columns_reach_the_scan(spark, capsys):
    QUERIES["filter_and"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [" in plan and "GreaterThan(l_quantity,30.0)" in plan
    assert "ReadSchema" in plan and "l_extendedprice" not in plan.split("ReadSchema")[1].splitlines()[0]
    assert "Python" not in plan


def test_equi_join_is_no_nested_loop(spark, capsys):
    QUERIES["join_multi_pred"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_multi_pred_deals_one_nation_to_many_tasks(spark, tmp_path):
    c = spark.range(0, 5000, numPartitions=1).selectExpr(
        "id AS c_custkey", "int(IF(id % 100 = 0, null, IF(id < 20, id, 3))) AS c_nationkey", "IF(id % 77 = 0, null, double(id * 37 % 1000)) AS c_acctbal"
    )
    s = spark.range(0, 4500, numPartitions=1).selectExpr(
        "id AS s_suppkey", "int(IF(id % 90 = 0, null, IF(id < 30, id, 3))) AS s_nationkey", "IF(id % 91 = 0, null, double(id * 53 % 900)) AS s_acctbal"
    )
    c.union(c.limit(40)).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    s.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    df = QUERIES["join_multi_pred"](spark, str(tmp_path))
    total = "count(*) AS n, sum(c_custkey) AS c, sum(s_suppkey) AS s, sum(c_custkey * s_suppkey % 1009) AS cs"
    theirs = duck(str(tmp_path)).execute(f"SELECT {total} FROM ({ORACLES['join_multi_pred']})").fetchone()
    assert tuple(df.selectExpr(*total.split(", ")).first()) == tuple(int(x) for x in theirs)
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks) > 2 and max(tasks) < 0.6 * sum(tasks)
