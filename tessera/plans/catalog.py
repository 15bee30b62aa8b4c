"""Query catalogue: each entry pairs a DataFrame plan with the SQL that checks it.

The plans use the operators of :mod:`tessera.operators`; ``_sql`` entries go through
the SQL front door instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions import any_of, compare, compare_columns
from tessera.operators import cell_join, derived, global_agg, project, scalar_lookup, sort_by, theta_join, vs_global_agg, where
from tessera.sources import read_csv, read_tables, write_result

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _plan(name: str, tables: str, sql: str):
    """Register a plan that takes the named tables as arguments."""

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*read_tables(spark, sf_dir, tables.split()).values())

        QUERIES[name], ORACLES[name] = run, sql
        return build

    return add


def _sql(name: str, tables: str, sql: str, **options: str) -> None:
    """Register a statement that goes through the engine's SQL front door."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.load_parquet(sf_dir, *tables.split())
        return engine.sql(sql, **options)

    QUERIES[name], ORACLES[name] = run, sql


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


# Projections
_plan("scan_star", "nation", "SELECT * FROM nation")(lambda n: project(n))
_plan("project_columns", "part", "SELECT p_partkey, p_name FROM part")(lambda p: project(p, "p_partkey", "p_name"))
_plan("project_alias", "supplier", "SELECT s.s_name AS supplier_name FROM supplier AS s")(lambda s: project(s.alias("s"), supplier_name="s.s_name"))
_plan("project_duplicate", "region", "SELECT r_name AS a, r_name AS b FROM region")(lambda r: project(r, a="r_name", b="r_name"))

# Filters
_plan("filter_eq_string", "customer", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")(
    lambda c: project(where(c, compare("c_mktsegment", "=", "BUILDING")), "c_custkey", "c_name")
)
_plan("filter_ne_string", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'")(
    lambda o: project(where(o, compare("o_orderstatus", "!=", "F")), "o_orderkey")
)
_plan("filter_lt_int", "part", "SELECT p_partkey FROM part WHERE p_size < 10")(lambda p: project(where(p, compare("p_size", "<", 10)), "p_partkey"))
_plan("filter_le_double", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal <= 500")(
    lambda c: project(where(c, compare("c_acctbal", "<=", 500.0)), "c_custkey")
)
_plan("filter_gt_double", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")(
    lambda o: project(where(o, compare("o_totalprice", ">", 100000.0)), "o_orderkey")
)
_plan("filter_ge_int", "part", "SELECT p_partkey FROM part WHERE p_size >= 40")(lambda p: project(where(p, compare("p_size", ">=", 40)), "p_partkey"))
_plan(
    "filter_float_tol",
    "lineitem",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - CAST(0.05 AS DOUBLE)) < CAST(1e-10 AS DOUBLE)",
)(lambda l: project(where(l, compare("l_discount", "=", 0.05, tolerance=1e-10)), "l_orderkey", "l_linenumber"))
_plan("filter_string_range", "part", "SELECT p_partkey FROM part WHERE p_name > 'm' AND p_name <= 'z'")(
    lambda p: project(where(p, compare("p_name", ">", "m"), compare("p_name", "<=", "z")), "p_partkey")
)
_plan("filter_datetime_string", "orders", "SELECT o_orderkey FROM orders WHERE o_orderdate > '1996-01-01 00:00:00'")(
    lambda o: project(where(o, compare("o_orderdate", ">", "1996-01-01 00:00:00")), "o_orderkey")
)
_plan("filter_col_col", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")(
    lambda l: project(where(l, compare_columns("l_partkey", "<", "l_suppkey")), "l_orderkey", "l_linenumber")
)
_plan(
    "filter_and",
    "lineitem",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.03 AND l_returnflag = 'R'",
)(
    lambda l: project(
        where(l, compare("l_quantity", ">", 30.0), compare("l_discount", "<", 0.03), compare("l_returnflag", "=", "R")), "l_orderkey", "l_linenumber"
    )
)
_plan(
    "filter_or_nested",
    "customer",
    "SELECT c_custkey FROM customer WHERE (c_acctbal > 9000 OR c_acctbal < -500) AND (c_mktsegment = 'BUILDING' OR c_nationkey = 3)",
)(
    lambda c: project(
        where(
            c,
            any_of(compare("c_acctbal", ">", 9000.0), compare("c_acctbal", "<", -500.0)),
            any_of(compare("c_mktsegment", "=", "BUILDING"), compare("c_nationkey", "=", 3)),
        ),
        "c_custkey",
    )
)
_plan("filter_agg_in_where", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")(
    lambda c: project(vs_global_agg(c, "c_acctbal", ">", "avg"), "c_custkey")
)
_plan("filter_boolean", "customer", "SELECT c_custkey, c_acctbal < 0 AS in_debt FROM customer WHERE (c_acctbal < 0) = TRUE")(
    lambda c: where(project(c, "c_custkey", (F.col("c_acctbal") < 0).alias("in_debt")), compare("in_debt", "=", True))
)

_NULLS = "SELECT *, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS credit FROM customer"
_with_nulls = lambda c: c.withColumn("credit", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
_plan("filter_null_comparison", "customer", f"SELECT c_custkey FROM ({_NULLS}) WHERE credit < 1000 OR credit <> 5000")(
    lambda c: project(where(_with_nulls(c), any_of(compare("credit", "<", 1000.0), compare("credit", "!=", 5000.0))), "c_custkey")
)
_plan(
    "filter_float_ne_tol",
    "lineitem",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT abs(l_discount - CAST(0.05 AS DOUBLE)) < CAST(1e-10 AS DOUBLE)",
)(lambda l: project(where(l, compare("l_discount", "!=", 0.05, tolerance=1e-10)), "l_orderkey", "l_linenumber"))
_plan("filter_mixed_numbers", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey < o_totalprice / 100")(
    lambda o: project(where(o.withColumn("hundredth", F.col("o_totalprice") / 100), compare_columns("o_custkey", "<", "hundredth")), "o_orderkey")
)

# Sorts. The limited ones are top-k reports, so that the order of nulls and ties decides which rows they have.
_plan("sort_nulls_first", "customer", f"SELECT c_custkey, credit FROM ({_NULLS}) ORDER BY credit NULLS FIRST, c_custkey LIMIT 200")(
    lambda c: project(sort_by(_with_nulls(c), "credit", tie_breaker="c_custkey").limit(200), "c_custkey", "credit")
)
_plan("sort_nulls_last_desc", "customer", f"SELECT c_custkey, credit FROM ({_NULLS}) ORDER BY credit DESC NULLS LAST, c_custkey LIMIT 1480")(
    lambda c: project(sort_by(_with_nulls(c), ("credit", "desc"), tie_breaker="c_custkey").limit(1480), "c_custkey", "credit")
)
_plan("sort_tie_breaker", "part", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 300")(
    lambda p: project(sort_by(p, ("p_size", "desc"), tie_breaker="p_partkey").limit(300), "p_partkey", "p_size")
)
_plan("sort_asc", "part", "SELECT p_partkey, p_size FROM part ORDER BY p_size")(lambda p: project(sort_by(p, "p_size"), "p_partkey", "p_size"))
_plan("sort_desc_string", "supplier", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name DESC")(
    lambda s: project(sort_by(s, ("s_name", "desc")), "s_suppkey", "s_name")
)
_plan("sort_multi", "part", "SELECT p_size, p_retailprice FROM part ORDER BY p_size ASC, p_retailprice DESC")(
    lambda p: project(sort_by(p, "p_size", ("p_retailprice", "desc")), "p_size", "p_retailprice")
)

# Ungrouped aggregates
_plan("agg_count_star", "lineitem", "SELECT COUNT(*) AS cnt FROM lineitem")(lambda l: global_agg(l, {"cnt": ("count", None)}))
_plan("agg_count_col", "customer", "SELECT COUNT(c_name) AS cnt FROM customer")(lambda c: global_agg(c, {"cnt": ("count", "c_name")}))
_plan("agg_sum_int", "lineitem", "SELECT CAST(SUM(l_linenumber) AS DOUBLE) AS sum_1 FROM lineitem")(lambda l: global_agg(l, {"sum_1": ("sum", "l_linenumber")}))
_plan("agg_sum_double", "orders", "SELECT ROUND(SUM(o_totalprice), 2) AS sum_1 FROM orders")(
    lambda o: _round(global_agg(o, {"sum_1": ("sum", "o_totalprice")}), sum_1=2)
)
_plan("agg_avg", "lineitem", "SELECT ROUND(AVG(l_extendedprice), 4) AS avg_1, ROUND(AVG(l_linenumber), 6) AS avg_2 FROM lineitem")(
    lambda l: _round(global_agg(l, {"avg_1": ("avg", "l_extendedprice"), "avg_2": ("avg", "l_linenumber")}), avg_1=4, avg_2=6)
)
_plan("agg_minmax_num", "customer", "SELECT MIN(c_acctbal) AS mn, MAX(c_acctbal) AS mx, MIN(c_custkey) AS mnk, MAX(c_custkey) AS mxk FROM customer")(
    lambda c: global_agg(c, {"mn": ("min", "c_acctbal"), "mx": ("max", "c_acctbal"), "mnk": ("min", "c_custkey"), "mxk": ("max", "c_custkey")})
)
_plan("agg_minmax_string", "customer", "SELECT MIN(c_name) AS mn, MAX(c_name) AS mx FROM customer")(
    lambda c: global_agg(c, {"mn": ("min", "c_name"), "mx": ("max", "c_name")})
)
_plan("agg_filtered", "orders", "SELECT COUNT(*) AS cnt, MAX(o_totalprice) AS mx FROM orders WHERE o_orderstatus = 'F'")(
    lambda o: global_agg(where(o, compare("o_orderstatus", "=", "F")), {"cnt": ("count", None), "mx": ("max", "o_totalprice")})
)
_plan("agg_empty_standard", "orders", "SELECT COUNT(*) AS cnt, MAX(o_totalprice) AS mx FROM orders WHERE o_totalprice < -1")(
    lambda o: global_agg(where(o, compare("o_totalprice", "<", -1.0)), {"cnt": ("count", None), "mx": ("max", "o_totalprice")})
)
_plan("agg_empty_compat", "orders", "SELECT COUNT(*) AS cnt, MAX(o_totalprice) AS mx FROM orders WHERE o_totalprice < -1 HAVING COUNT(*) > 0")(
    lambda o: global_agg(where(o, compare("o_totalprice", "<", -1.0)), {"cnt": ("count", None), "mx": ("max", "o_totalprice")}, empty="no_row")
)

_plan(
    "agg_boolean",
    "customer",
    "SELECT CAST(SUM(CAST(c_acctbal < 0 AS INT)) AS DOUBLE) AS debtors, ROUND(AVG(CAST(c_acctbal < 0 AS INT)), 9) AS part FROM customer",
)(
    lambda c: _round(global_agg(c.withColumn("debt", F.col("c_acctbal") < 0), {"debtors": ("sum", "debt"), "part": ("avg", "debt")}), part=9)
)

# Joins
_plan("join_comma_equi", "customer orders", "SELECT c.c_name, o.o_totalprice FROM customer c, orders o WHERE c.c_custkey = o.o_custkey")(
    lambda c, o: project(theta_join(c.alias("c"), o.alias("o"), compare_columns("c.c_custkey", "=", "o.o_custkey")), "c_name", "o_totalprice")
)
_plan("join_reversed", "customer orders", "SELECT c.c_name, o.o_totalprice FROM customer c, orders o WHERE o.o_custkey = c.c_custkey")(
    lambda c, o: project(theta_join(c.alias("c"), o.alias("o"), compare_columns("o.o_custkey", "=", "c.c_custkey")), "c_name", "o_totalprice")
)
_plan(
    "join_filter",
    "customer orders",
    "SELECT c.c_name, o.o_totalprice FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 AND c.c_acctbal < 1000",
)(
    lambda c, o: project(
        where(
            theta_join(c.alias("c"), o.alias("o"), compare_columns("c.c_custkey", "=", "o.o_custkey")),
            compare("o.o_totalprice", ">", 200000.0),
            compare("c.c_acctbal", "<", 1000.0),
        ),
        "c_name",
        "o_totalprice",
    )
)
_plan(
    "join_agg",
    "customer orders",
    "SELECT ROUND(SUM(o.o_totalprice),2) AS sum_1, COUNT(*) AS cnt FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'",
)(
    lambda c, o: _round(
        global_agg(
            theta_join(where(c, compare("c_mktsegment", "=", "BUILDING")), o, compare_columns("c_custkey", "=", "o_custkey")),
            {"sum_1": ("sum", "o_totalprice"), "cnt": ("count", None)},
        ),
        sum_1=2,
    )
)
for _name, _op, _symbol in (("join_theta_lt", "<", "<"), ("join_theta_ne", "!=", "!=")):
    _plan(_name, "region nation", f"SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey {_symbol} n.n_regionkey")(
        lambda r, n, op=_op: project(theta_join(r, n, compare_columns("r_regionkey", op, "n_regionkey")), "r_name", "n_name")
    )
_plan(
    "join_or",
    "region nation",
    "SELECT r.r_name, n.n_name FROM region r, nation n WHERE (r.r_regionkey = n.n_regionkey OR r.r_regionkey > n.n_nationkey)",
)(
    lambda r, n: project(
        theta_join(r, n, any_of(compare_columns("r_regionkey", "=", "n_regionkey"), compare_columns("r_regionkey", ">", "n_nationkey"))), "r_name", "n_name"
    )
)
_plan("join_string_key", "customer", "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a, customer b WHERE a.c_name = b.c_name")(
    lambda c: project(theta_join(c.alias("a"), c.alias("b"), compare_columns("a.c_name", "=", "b.c_name")), x="a.c_custkey", y="b.c_custkey")
)
_plan(
    "join_boolean_key",
    "region nation",
    "SELECT r.r_name, n.n_name FROM region r, nation n WHERE (r.r_regionkey = 0) = (n.n_nationkey = 5) AND (r.r_regionkey > 3) = (n.n_regionkey > 3)",
)(
    lambda r, n: project(
        theta_join(
            r.withColumns({"r_first": F.col("r_regionkey") == 0, "r_late": F.col("r_regionkey") > 3}),
            n.withColumns({"n_fifth": F.col("n_nationkey") == 5, "n_late": F.col("n_regionkey") > 3}),
            compare_columns("r_first", "=", "n_fifth"),
            compare_columns("r_late", "=", "n_late"),
        ),
        "r_name",
        "n_name",
    )
)
_plan("join_self", "nation", "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey")(
    lambda n: project(theta_join(n.alias("a"), n.alias("b"), compare_columns("a.n_regionkey", "=", "b.n_regionkey")), x="a.n_name", y="b.n_name")
)
_plan("join_star", "nation region", "SELECT * FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")(
    lambda n, r: project(theta_join(n, r, compare_columns("n_regionkey", "=", "r_regionkey")))
)
_plan(
    "join_three",
    "customer nation region",
    "SELECT c.c_name, n.n_name, r.r_name FROM customer c, nation n, region r WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey",
)(
    lambda c, n, r: project(
        theta_join(theta_join(c, n, compare_columns("c_nationkey", "=", "n_nationkey")), r, compare_columns("n_regionkey", "=", "r_regionkey")),
        "c_name",
        "n_name",
        "r_name",
    )
)
_plan(
    "join_multi_pred",
    "customer supplier",
    "SELECT c.c_custkey, s.s_suppkey FROM customer c, supplier s WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal < s.s_acctbal",
)(
    lambda c, s: project(
        cell_join(
            project(c, "c_custkey", "c_nationkey", "c_acctbal"),
            project(s, "s_suppkey", "s_nationkey", "s_acctbal"),
            "c_nationkey",
            "s_nationkey",
            compare_columns("c_acctbal", "<", "s_acctbal"),
        ),
        "c_custkey",
        "s_suppkey",
    )
)
_sql("join_explicit", "customer orders", "SELECT c.c_name, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
_plan("join_left", "customer orders", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")(
    lambda c, o: project(theta_join(c, o, compare_columns("c_custkey", "=", "o_custkey"), how="left"), "c_custkey", "o_orderkey")
)
_plan("join_right", "orders customer", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey")(
    lambda o, c: project(theta_join(o, c, compare_columns("c_custkey", "=", "o_custkey"), how="right"), "c_custkey", "o_orderkey")
)
_plan("join_full", "region nation", "SELECT r.r_name, n.n_name FROM region r FULL JOIN nation n ON r.r_regionkey = n.n_nationkey")(
    lambda r, n: project(theta_join(r, n, compare_columns("r_regionkey", "=", "n_nationkey"), how="full"), "r_name", "n_name")
)
_plan(
    "join_sort",
    "customer orders",
    "SELECT c.c_name, o.o_totalprice FROM customer c, orders o WHERE c.c_custkey = o.o_custkey ORDER BY o.o_totalprice DESC",
)(
    lambda c, o: sort_by(
        project(theta_join(c, o, compare_columns("c_custkey", "=", "o_custkey")), "c_name", "o_totalprice"), ("o_totalprice", "desc")
    )
)

# Subqueries
_plan("derived", "customer", "SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name FROM customer)")(
    lambda c: project(derived(project(c, "c_custkey", "c_name")), "c_custkey", "c_name")
)
_sql("derived_nested", "customer", "SELECT c_name FROM (SELECT c_acctbal, c_name FROM (SELECT c_name, c_nationkey, c_acctbal FROM customer))")
_sql(
    "derived_join",
    "customer nation",
    "SELECT c_name, n_name FROM (SELECT c.c_name, c.c_acctbal, n.n_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000)",
)
_sql(
    "derived_agg",
    "customer nation",
    "SELECT ROUND(AVG(c_acctbal),4) AS agg_0 FROM (SELECT c.c_acctbal, n.n_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000)",
)
_sql("derived_filter", "customer", "SELECT c_name FROM (SELECT c_name, c_acctbal FROM customer) WHERE c_acctbal > 5000")
_plan("derived_alias", "customer", "SELECT t.c_name FROM (SELECT c_name, c_acctbal FROM customer) AS t WHERE t.c_acctbal > 5000")(
    lambda c: project(where(derived(project(c, "c_name", "c_acctbal"), "t"), compare("t.c_acctbal", ">", 5000.0)), "t.c_name")
)
_plan(
    "scalar_corr",
    "customer orders",
    "SELECT c.c_name, (SELECT SUM(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS TotalSales FROM customer c ORDER BY TotalSales DESC",
)(
    lambda c, o: sort_by(
        project(scalar_lookup(c, o, "c_custkey", "o_custkey", "sum", "o_totalprice", "TotalSales"), "c_name", "TotalSales"), ("TotalSales", "desc")
    )
)
_sql(
    "scalar_corr_sql",
    "customer orders",
    "SELECT c.c_name, (SELECT COUNT(o.o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM customer c",
)
_plan(
    "scalar_count",
    "customer orders",
    "SELECT c.c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) AS n FROM customer c",
)(lambda c, o: project(scalar_lookup(c, where(o, compare("o_totalprice", ">", 400000.0)), "c_custkey", "o_custkey", "count", "o_orderkey", "n"), "c_custkey", "n"))
_sql("literal_comment", "nation", "SELECT n_nationkey, 'a/*b*/c--d' AS note /* a comment; with 'signs' */ FROM nation -- and another")
_plan(
    "sample_avg_join",
    "customer orders",
    "SELECT ROUND(AVG(c.c_acctbal),4) AS AverageBalance FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
)(
    lambda c, o: _round(
        global_agg(
            theta_join(c, where(o, compare("o_totalprice", ">", 200000.0)), compare_columns("c_custkey", "=", "o_custkey")),
            {"AverageBalance": ("avg", "c_acctbal")},
        ),
        AverageBalance=4,
    )
)


# CSV: tables written as tagged CSV into the warehouse's store and read back


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, else, on a local master, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/csv-{uuid.uuid4().hex}"


def _csv(name: str, table: str, tags: dict[str, str], sql: str, lenient: bool = False, **columns: str):
    """Register a plan over ``table``, which is written as CSV under a tagged header and read by the engine's source."""

    def add(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = read_tables(spark, sf_dir, [table])[table].withColumns({c: F.expr(e) for c, e in columns.items()})
            path = _folder(spark)
            df.select(*[F.col(c).alias(f"{c} {tags[c]}".rstrip()) for c in tags]).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
            return build(read_csv(spark, path, table, lenient))

        QUERIES[name], ORACLES[name] = run, sql
        return build

    return add


_csv("csv_round_trip", "customer", {"c_custkey": "(N) (P)", "c_name": "(T)", "c_nationkey": "", "c_acctbal": "(N)", "c_mktsegment": ""}, "SELECT * FROM customer")(
    lambda c: c.select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment")
)
_csv(
    "csv_widening", "orders", {"o_orderkey": "(N)", "big": "", "mixed": "", "gaps": "(N)"},
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN 99999999999999999999.0::DOUBLE ELSE o_orderkey::DOUBLE END AS big,"
    " CASE WHEN o_orderkey % 5 = 0 THEN 'x, \"y\"' ELSE CAST(o_custkey AS VARCHAR) END AS mixed, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS gaps FROM orders",
    big="CASE WHEN o_orderkey % 7 = 3 THEN '99999999999999999999' ELSE string(o_orderkey) END",
    mixed="CASE WHEN o_orderkey % 5 = 0 THEN 'x, \"y\"' ELSE string(o_custkey) END", gaps="CASE WHEN o_custkey % 3 > 0 THEN o_custkey END",
)(lambda o: o)
_csv(
    "csv_lenient", "orders", {"o_orderkey": "(N)", "gaps": "(N)", "named": "(T)"},
    "SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey ELSE 0 END AS gaps, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE '' END AS named FROM orders",
    lenient=True, gaps="CASE WHEN o_custkey % 3 > 0 THEN o_custkey END", named="CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END",
)(lambda o: o)


def _result_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the result sink writes them, read back as text."""
    path = _folder(spark)
    write_result(project(read_tables(spark, sf_dir, ["customer"])["customer"].withColumn("debt", F.col("c_acctbal") < 0), "c_custkey", "c_acctbal", "debt"), path)
    return spark.read.option("header", True).csv(path)


QUERIES["result_csv"], ORACLES["result_csv"] = (
    _result_csv,
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, printf('%.2f', c_acctbal) AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'TRUE' ELSE 'FALSE' END AS debt FROM customer",
)
