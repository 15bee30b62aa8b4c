"""CSV ingestion, sinks, shell, batch runner, golden sample and compatibility options."""

import csv

import pytest
from pyspark.sql import functions as F

from tessera.cli import Shell, run_batch, split_statements
from tessera.engine import Engine
from tessera.functions import all_of, any_of, check_types, compare
from tessera.operators import global_agg, project, sort_by, theta_join, vs_global_agg, where
from tessera.sources import read_csv, write_result
from tessera.sources.csv_source import infer_type, parse_header

EMPLOYEES = """Employees_id (N) (P),Name (T),Salary (N),JoinedDate (D)
1,Ada Okoye,60000.50,2021-01-05 08:00:00
2,Ben Lindqvist,75000,2020-03-01 08:00:00
3,Chiara Rossi,91000.65,2019-07-10 9:15:00
"""
ORDERS = """Orders_id (N) (P),#Employees_id (N),TotalAmount (N),OrderDate (D)
1,1,10.5,2023-01-15 08:45:00
2,1,20,2023-02-15 08:45:00
3,3,5.25,2023-03-15 08:45:00
4,9,7,2023-04-15 08:45:00
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "Employees.csv").write_text(EMPLOYEES)
    (tmp_path / "SalesOrders.csv").write_text(ORDERS)
    return tmp_path


def test_header_and_types():
    assert parse_header("id (N) (P)", "t")[0] == "id"
    name, meta = parse_header("#departments_dept_id", "t")
    assert (name, meta["ref_table"], meta["ref_column"], meta["fk"]) == ("departments_dept_id", "departments_dept", "id", True)
    kinds = {"7": "bigint", "-7": "bigint", "1.5": "double", "-.5": "double", "2023-01-15": "string", "TRUE": "boolean", "": "string", "99999999999999999999": "string"}
    assert {v: infer_type(v) for v in kinds} == kinds


def test_types_widen_when_later_rows_disagree(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("a,b,c,d\n80000,1,true,x\n70000.5,two,false,\n,,,\"q \"\"z\"\", k\"\n")
    df = read_csv(spark, str(p), "w")
    assert dict(df.dtypes) == {"a": "double", "b": "string", "c": "boolean", "d": "string"}
    assert [tuple(r) for r in df.collect()] == [(80000.0, "1", True, "x"), (70000.5, "two", False, None), (None, None, None, 'q "z", k')]
    lenient = read_csv(spark, str(p), "w", lenient=True)
    assert tuple(lenient.collect()[2])[:3] == (0.0, "", False)


def test_bad_files_are_refused(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="header"):
        read_csv(spark, str(tmp_path / "e.csv"), "e")
    (tmp_path / "r.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_csv(spark, str(tmp_path / "r.csv"), "r").collect()


def test_catalog_and_metadata(spark, folder):
    e = Engine(spark)
    assert e.load_folder(str(folder)) == ["Employees", "SalesOrders"]
    assert e.has_table("Employees") and {"employees", "salesorders"} <= {t.lower() for t in e.tables()}
    assert e.describe("Employees")[0] == ("Employees_id", "bigint", "PK")
    assert e.describe("SalesOrders")[1] == ("Employees_id", "bigint", "FK -> Employees.id")


def test_sample_queries(spark, folder):
    e = Engine(spark)
    e.load_folder(str(folder))
    avg = e.sql("SELECT AVG(e.Salary) AS a FROM Employees e, SalesOrders o WHERE e.Employees_id = o.Employees_id AND o.TotalAmount > 6;").first().a
    assert avg == pytest.approx(60000.5)
    text = e.sql("SELECT Orders_id FROM SalesOrders WHERE OrderDate > '2023-02-01 00:00:00' ORDER BY TotalAmount")
    assert [r[0] for r in text.collect()] == [3.0, 4.0, 2.0]
    total = e.sql("SELECT e.Name, (SELECT SUM(o.TotalAmount) FROM SalesOrders o WHERE o.Employees_id = e.Employees_id) AS t FROM Employees e ORDER BY t DESC")
    assert [tuple(r) for r in total.collect()] == [("Ada Okoye", 30.5), ("Chiara Rossi", 5.25), ("Ben Lindqvist", None)]


def test_only_select(spark):
    e = Engine(spark)
    for text in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "-- SELECT\nCREATE TABLE t (a INT)"):
        with pytest.raises(ValueError, match="SELECT"):
            e.sql(text)
    assert e.sql("WITH t AS (SELECT 1 AS a) SELECT a FROM t").first().a == 1
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("one")
    assert e.sql("SELECT COUNT(*) AS n FROM one WHERE a > 5").first().n == 0
    assert e.sql("SELECT COUNT(*) AS n FROM one WHERE a > 5", empty_agg="no_row").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, True, "a,b"), (2, None, False, "")], "i long, d double, b boolean, s string")
    write_result(df, str(tmp_path / "one.csv"), single_file=True)
    assert (tmp_path / "one.csv").read_text() == 'i,d,b,s\n1,2.50,TRUE,"a,b"\n2,NULL,FALSE,NULL\n'
    write_result(df, str(tmp_path / "many"))
    assert spark.read.option("header", True).csv(str(tmp_path / "many")).count() == 2


def test_batch_and_shell(spark, folder, tmp_path):
    q = tmp_path / "q.txt"
    q.write_text("SELECT Name FROM Employees\nWHERE Salary > 70000;\nSELECT COUNT(*) AS n FROM SalesOrders;")
    out = run_batch(Engine(spark), str(folder), str(q), str(tmp_path), single_file=True)
    assert [p.name for p in out] == ["q_1.csv", "q_2.csv"]
    assert sorted(r[0] for r in csv.reader(out[0].open())) == ["Ben Lindqvist", "Chiara Rossi", "Name"]
    q.write_text("SELECT 1")
    with pytest.raises(ValueError, match="semicolon"):
        run_batch(Engine(spark), str(folder), str(q), str(tmp_path))
    shell = Shell(Engine(spark))
    assert shell.feed(f".load {folder}/Employees.csv") == ["loaded Employees"]
    assert shell.feed("SELECT Name") == []
    lines = shell.feed("FROM Employees WHERE Salary > 70000 ORDER BY Name;")
    assert lines[2].strip() == "Ben Lindqvist" and lines[-1] == "(2 rows)"
    assert shell.feed("SELECT nope FROM Employees;")[0].startswith("error")
    assert any("PK" in x for x in shell.feed(".schema Employees"))
    shell.feed(".exit")
    assert shell.done


def test_batch_writes_folders_unless_told_otherwise(spark, folder, tmp_path):
    q = tmp_path / "p.txt"
    q.write_text("SELECT Name FROM Employees WHERE Salary > 70000;")
    (out,) = run_batch(Engine(spark), str(folder), str(q), str(tmp_path / "out"))
    assert out.is_dir() and spark.read.option("header", True).csv(str(out)).count() == 2


def test_comments_and_literals_are_told_apart(spark):
    e = Engine(spark)
    assert e.sql("/* it's; */ SELECT 'a/*b*/c' AS x, 'a--b' AS y -- end;").first() == ("a/*b*/c", "a--b")
    assert split_statements("SELECT 1 -- it's; fine\n; SELECT /* ; ' */ 2; rest") == (["SELECT 1 -- it's; fine", "SELECT /* ; ' */ 2"], "rest")
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("one")
    assert e.sql("SELECT COUNT(*) AS n, ';' AS s FROM one WHERE a > 5; -- end", empty_agg="no_row").count() == 0


def test_wide_integers_and_ids_keep_their_digits(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("id (N) (P),big,late (N)\n9007199254740993,1,1\n2,99999999999999999999,\n3,4,2.5\n\n")
    df = read_csv(spark, str(p), "n")
    assert df.dtypes == [("id", "bigint"), ("big", "double"), ("late", "double")]
    assert [tuple(r) for r in df.collect()] == [(9007199254740993, 1.0, 1.0), (2, 1e20, None), (3, 4.0, 2.5)]
    assert read_csv(spark, str(p), "n", schema={"big": "string", "late": "string"}).dtypes == [("id", "bigint"), ("big", "string"), ("late", "string")]
    with pytest.raises(ValueError, match="can't have type"):
        read_csv(spark, str(p), "n", schema={"big": "date"})


def test_mixed_types_and_constant_sort_keys_are_refused(spark):
    df = spark.createDataFrame([(1, 1.5, "a", True)], "i long, d double, s string, b boolean")
    check_types(df, "i", "d")
    for pair in (("i", "s"), ("b", "i"), ("b", "s")):
        with pytest.raises(ValueError, match="can't compare"):
            check_types(df, *pair)
    for key in ("1", "'x'", " 2.5 "):
        with pytest.raises(ValueError, match="sort key"):
            sort_by(df, key)
    assert global_agg(df, {"s": ("sum", "b"), "a": ("avg", "b")}).first() == (1.0, 1.0)
    assert vs_global_agg(df, "d", ">", "avg", over="b").count() == 1


def test_split_statements():
    assert split_statements("SELECT ';' AS a; SELECT 2") == (["SELECT ';' AS a"], "SELECT 2")


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, 0.1 + 0.2, "b"), (2, None, "a"), (3, 5.0, None)], "k long, d double, s string")
    assert where(df, compare("d", "=", 0.3)).count() == 0
    assert where(df, compare("d", "=", 0.3, tolerance=1e-10)).count() == 1
    assert where(df, compare("d", "!=", 0.3, tolerance=1e-10)).count() == 1
    assert [r.k for r in sort_by(df, "s").collect()] == [3, 2, 1]
    assert [r.k for r in sort_by(df, ("s", "desc"), tie_breaker="k").collect()] == [1, 2, 3]
    assert [r.k for r in vs_global_agg(df, "d", ">", "avg").collect()] == [3]
    empty = df.filter("false")
    assert global_agg(empty, {"n": ("count", None), "s": ("sum", "k")}).first().asDict() == {"n": 0, "s": None}
    assert global_agg(empty, {"n": ("count", None)}, empty="no_row").count() == 0
    assert project(df, x="k").columns == ["x"]
    assert where(df, any_of()).count() == 0 and where(df, all_of()).count() == 3
    with pytest.raises(ValueError):
        theta_join(df, df)
    with pytest.raises(ValueError):
        compare("k", "~", 1)
    assert theta_join(df, df.select(F.col("k").alias("j")), F.col("k") > F.col("j")).count() == 3
