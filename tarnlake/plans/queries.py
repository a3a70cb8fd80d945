"""The engine's queries: each builds lake objects in a fresh warehouse and must equal plain SQL over the source tables."""

from __future__ import annotations

import datetime
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.transforms import Transform
from tarnlake.operators.table import LakeTable
from tarnlake.plans.catalogue import query
from tarnlake.plans.predicates import Compare
from tarnlake.sources.session import LakeSession

DAY = datetime.datetime


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession) -> LakeSession:
    return LakeSession(spark)


def lake(s: LakeSession, sf_dir: str, name: str, partition_by: tuple = (), columns: tuple = (), batches: tuple = (None,)) -> LakeTable:
    """A lake copy of a source table, appended in batches."""
    df = source(s.spark, sf_dir, name)
    df = df.select(*columns) if columns else df
    t = s.create_table(name, df.schema, partition_by)
    for b in batches:
        t.append(df if b is None else df.where(b))
    return t


# -- scan and append

query("scan_full", "SELECT * FROM orders")(lambda spark, d: lake(session(spark), d, "orders").df())

query("scan_projection", "SELECT o_orderkey, o_totalprice FROM orders")(
    lambda spark, d: lake(session(spark), d, "orders").df(columns=["o_orderkey", "o_totalprice"])
)

query("scan_filter", "SELECT * FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")(
    lambda spark, d: lake(session(spark), d, "orders").df(Compare("o_totalprice", ">", 250000.0) & Compare("o_orderstatus", "=", "F"))
)

query("append_two_batches", "SELECT * FROM orders")(
    lambda spark, d: lake(session(spark), d, "orders", batches=("o_orderkey <= 7000", "o_orderkey > 7000")).df()
)


@query("insert_select", "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def insert_select(spark, d):
    s = session(spark)
    lake(s, d, "orders", columns=("o_custkey",))
    s.sql("CREATE TABLE counts (k BIGINT, n BIGINT)")
    s.sql("INSERT INTO counts SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey")
    return s.sql("SELECT * FROM counts")


@query("insert_values", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (CAST(2 AS BIGINT), NULL)) AS t(id, name)")
def insert_values(spark, d):
    s = session(spark)
    s.sql("CREATE TABLE t (id BIGINT NOT NULL, name STRING)")
    s.sql("INSERT INTO t VALUES (1, 'a'), (2, NULL)")
    return s.sql("SELECT * FROM t")


@query("csv_load", "SELECT r_regionkey, r_name FROM region")
def csv_load(spark, d):
    s = session(spark)
    folder = f"{s.catalog.warehouse}/csv"
    source(spark, d, "region").write.csv(folder)
    s.sql(f"CREATE EXTERNAL TABLE region_csv (r_regionkey INT, r_name STRING) STORED AS CSV LOCATION '{folder}' OPTIONS ('has_header' 'false')")
    s.sql("CREATE TABLE region (r_regionkey INT, r_name STRING)")
    s.sql("INSERT INTO region SELECT * FROM region_csv")
    return s.sql("SELECT * FROM region")


query("limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(
    lambda spark, d: lake(session(spark), d, "orders").df(columns=["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
)


@query("limit_above_deletes", "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderkey < 120) AS gone FROM (SELECT o_orderkey FROM orders WHERE o_orderkey >= 120 LIMIT 100)")
def limit_above_deletes(spark, d):
    t = lake(session(spark), d, "orders")
    t.delete(t.df(Compare("o_orderkey", "<", 120), ["o_orderkey"]), ["o_orderkey"])
    return t.df(limit=100).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") < 120).alias("gone"))


@query("orc_source", "SELECT n_name, n_regionkey FROM nation")
def orc_source(spark, d):
    s = session(spark)
    folder = f"{s.catalog.warehouse}/orc"
    source(spark, d, "nation").write.orc(folder)
    s.register_external("nation_orc", folder, "orc")
    return s.sql("SELECT n_name, n_regionkey FROM nation_orc")


# -- partition transforms as expressions


def transformed(spark, d, kind: str, table: str, key: str, column: str) -> DataFrame:
    df = source(spark, d, table)
    return df.select(key, Transform.parse(kind).column(F.col(column), df.schema[column].dataType).alias("v"))


for _name, _kind, _table, _key, _col, _sql in (
    ("tx_identity", "identity", "orders", "o_orderkey", "o_custkey", "o_custkey"),
    ("tx_year", "year", "orders", "o_orderkey", "o_orderdate", "CAST(year(o_orderdate) - 1970 AS INTEGER)"),
    ("tx_month", "month", "orders", "o_orderkey", "o_orderdate", "CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) AS INTEGER)"),
    ("tx_day", "day", "orders", "o_orderkey", "o_orderdate", "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER)"),
    ("tx_hour", "hour", "events", "event_id", "ts", "CAST(floor(epoch(ts) / 3600) AS INTEGER)"),
    ("tx_truncate_int", "truncate[10]", "orders", "o_orderkey", "o_custkey", "o_custkey - o_custkey % 10"),
    ("tx_truncate_str", "truncate[3]", "orders", "o_orderkey", "o_orderpriority", "substr(o_orderpriority, 1, 3)"),
):
    query(_name, f"SELECT {_key}, {_sql} AS v FROM {_table}")(
        lambda spark, d, a=(_kind, _table, _key, _col): transformed(spark, d, *a)
    )

#: murmur3 over eight bytes, seed 0, in unsigned 64-bit arithmetic.
_BUCKET_SQL = """
WITH a AS (SELECT o_orderkey, CAST(o_orderkey AS UBIGINT) AS x FROM orders),
b AS (SELECT *, (((x & 4294967295) * 3432918353) & 4294967295) AS k1, (((x >> 32) * 3432918353) & 4294967295) AS k2 FROM a),
c AS (SELECT *, ((((k1 << 15) & 4294967295) | (k1 >> 17)) * 461845907) & 4294967295 AS m1, ((((k2 << 15) & 4294967295) | (k2 >> 17)) * 461845907) & 4294967295 AS m2 FROM b),
e AS (SELECT *, ((((m1 << 13) & 4294967295) | (m1 >> 19)) * 5 + 3864292196) & 4294967295 AS h1 FROM c),
f AS (SELECT *, xor(h1, m2) AS y FROM e),
g AS (SELECT *, xor(((((y << 13) & 4294967295) | (y >> 19)) * 5 + 3864292196) & 4294967295, 8) AS h FROM f),
i AS (SELECT *, (xor(h, h >> 16) * 2246822507) & 4294967295 AS h3 FROM g),
j AS (SELECT *, (xor(h3, h3 >> 13) * 3266489909) & 4294967295 AS h4 FROM i)
SELECT o_orderkey, CAST((xor(h4, h4 >> 16) & 2147483647) % 16 AS INTEGER) AS v FROM j
"""
query("tx_bucket", _BUCKET_SQL)(lambda spark, d: transformed(spark, d, "bucket[16]", "orders", "o_orderkey", "o_orderkey"))


# -- partitioned tables


@query("part_month_agg", "SELECT CAST((year(l_shipdate) - 1970) * 12 + month(l_shipdate) AS INTEGER) AS m, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def part_month_agg(spark, d):
    t = lake(session(spark), d, "lineitem", ("month(l_shipdate)",), ("l_orderkey", "l_shipdate", "l_quantity"))
    m = Transform("month").column(F.col("l_shipdate"), T.TimestampNTZType())
    return t.df().groupBy(m.alias("m")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("part_identity_agg", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def part_identity_agg(spark, d):
    return lake(session(spark), d, "orders", ("o_orderstatus",)).df().groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("part_multi", "SELECT * FROM events")
def part_multi(spark, d):
    return lake(session(spark), d, "events", ("event_type", "bucket(4, user_id)")).df()


@query("part_bucket_truncate", "SELECT p_partkey, p_brand FROM part WHERE p_partkey = 77 OR p_brand = 'Brand#12'")
def part_bucket_truncate(spark, d):
    t = lake(session(spark), d, "part", ("bucket(8, p_partkey)", "truncate(7, p_brand)"))
    return t.df(Compare("p_partkey", "=", 77) | Compare("p_brand", "=", "Brand#12"), ["p_partkey", "p_brand"])


@query("part_null_kept", "SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE o_orderstatus END AS s, COUNT(*) AS n FROM orders GROUP BY 1")
def part_null_kept(spark, d):
    s = session(spark)
    df = source(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE o_orderstatus END AS s")
    t = s.create_table("t", df.schema, ("s",))
    t.append(df)
    parts = [t.df(Compare("s", "null")), t.df(Compare("s", "=", "")), t.df(Compare("s", ">", ""))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("s").agg(F.count("*").alias("n"))


# -- pruning


@query("prune_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-10' AND o_orderdate < TIMESTAMP '1997-05-05'")
def prune_range(spark, d):
    t = lake(session(spark), d, "orders", ("month(o_orderdate)",))
    return t.df(Compare("o_orderdate", ">=", DAY(1997, 3, 10)) & Compare("o_orderdate", "<", DAY(1997, 5, 5)), ["o_orderkey"])


@query("prune_strict_gt", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01'")
def prune_strict_gt(spark, d):
    return lake(session(spark), d, "orders", ("year(o_orderdate)",)).df(Compare("o_orderdate", ">", DAY(2000, 6, 1)), ["o_orderkey"])


@query("prune_ne", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'")
def prune_ne(spark, d):
    return lake(session(spark), d, "orders", ("o_orderstatus",)).df(Compare("o_orderstatus", "<>", "O"), ["o_orderkey"])


@query("prune_file_stats", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (5, 6999, 7001)")
def prune_file_stats(spark, d):
    t = lake(session(spark), d, "orders", batches=("o_orderkey <= 7000", "o_orderkey > 7000"))
    return t.df(Compare("o_orderkey", "in", (5, 6999, 7001)), ["o_orderkey", "o_custkey"])


@query("table_statistics", "SELECT 'o_orderkey' AS column_name, COUNT(*) AS rows, 0 AS nulls, CAST(MIN(o_orderkey) AS VARCHAR) AS lower, CAST(MAX(o_orderkey) AS VARCHAR) AS upper FROM orders")
def table_statistics(spark, d):
    t = lake(session(spark), d, "orders", batches=("o_orderkey <= 7000", "o_orderkey > 7000"))
    return t.statistics().where("column_name = 'o_orderkey'").select("column_name", "rows", F.col("nulls").cast("int").alias("nulls"), "lower", "upper")


# -- versions


@query("time_travel", "SELECT * FROM orders WHERE o_orderkey <= 7000")
def time_travel(spark, d):
    t = lake(session(spark), d, "orders", batches=("o_orderkey <= 7000", "o_orderkey > 7000"))
    return t.df(snapshot_id=t.metadata.log[0][1])


@query("range_scan", "SELECT * FROM orders WHERE o_orderkey > 3000 AND o_orderkey <= 7000")
def range_scan(spark, d):
    t = lake(session(spark), d, "orders", batches=("o_orderkey <= 3000", "o_orderkey > 3000 AND o_orderkey <= 7000", "o_orderkey > 7000"))
    first, second, _ = [i for _, i in t.metadata.log]
    return t.df(after_snapshot=first, snapshot_id=second)


@query("branch_isolation", "SELECT 'main' AS b, COUNT(*) AS n FROM orders WHERE o_orderkey <= 7000 UNION ALL SELECT 'dev', COUNT(*) FROM orders")
def branch_isolation(spark, d):
    s = session(spark)
    t = lake(s, d, "orders", batches=("o_orderkey <= 7000",))
    t.create_branch("dev").append(source(spark, d, "orders").where("o_orderkey > 7000"))
    count = lambda x, b: x.sql("SELECT count(*) AS n FROM orders").select(F.lit(b).alias("b"), "n")
    return count(s, "main").unionByName(count(s.on("dev"), "dev"))


@query("tag_read", "SELECT * FROM orders WHERE o_orderkey <= 7000")
def tag_read(spark, d):
    t = lake(session(spark), d, "orders", batches=("o_orderkey <= 7000",))
    t.create_tag("first")
    t.append(source(spark, d, "orders").where("o_orderkey > 7000"))
    return t.df(ref="first")


@query("replace", "SELECT 'now' AS v, COUNT(*) AS n FROM orders WHERE o_orderkey > 7000 UNION ALL SELECT 'before', COUNT(*) FROM orders WHERE o_orderkey <= 7000")
def replace_all(spark, d):
    t = lake(session(spark), d, "orders", batches=("o_orderkey <= 7000",))
    old = t.metadata.log[0][1]
    t.replace(source(spark, d, "orders").where("o_orderkey > 7000"))
    count = lambda df, v: df.agg(F.count("*").alias("n")).select(F.lit(v).alias("v"), "n")
    return count(t.df(), "now").unionByName(count(t.df(snapshot_id=old), "before"))


@query("schema_evolution", "SELECT o_orderkey AS key, o_orderstatus, CASE WHEN o_orderkey > 7000 THEN 'new' END AS note FROM orders")
def schema_evolution(spark, d):
    cols = ("o_orderkey", "o_orderstatus")
    t = lake(session(spark), d, "orders", columns=cols, batches=("o_orderkey <= 7000",))
    t.rename_column("o_orderkey", "key")
    t.add_schema(T.StructType([*t.metadata.schema().fields, T.StructField("note", T.StringType())]))
    t.append(source(spark, d, "orders").where("o_orderkey > 7000").selectExpr("o_orderkey AS key", "o_orderstatus", "'new' AS note"))
    return t.df()


@query("spec_evolution", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'")
def spec_evolution(spark, d):
    t = lake(session(spark), d, "orders", batches=("o_orderkey <= 7000",))
    t.set_partitioning(["year(o_orderdate)"])
    t.append(source(spark, d, "orders").where("o_orderkey > 7000"))
    return t.df(Compare("o_orderdate", ">=", DAY(1999, 1, 1)))


@query("compact_expire", "SELECT * FROM orders WHERE o_orderstatus <> 'P'")
def compact_expire(spark, d):
    t = lake(session(spark), d, "orders", batches=("o_orderkey <= 7000", "o_orderkey > 7000"))
    t.delete(spark.createDataFrame([("P",)], "o_orderstatus string"), ["o_orderstatus"])
    t.compact()
    t.expire_snapshots(2**62)
    return t.df()


# -- equality deletes


def _deleted(spark, d, where: str, on: tuple, partition_by: tuple = ()) -> LakeTable:
    t = lake(session(spark), d, "orders", partition_by)
    t.delete(source(spark, d, "orders").where(where).select(*on), on)
    return t


query("eqdel_basic", "SELECT * FROM orders WHERE o_custkey % 3 <> 0")(lambda spark, d: _deleted(spark, d, "o_custkey % 3 = 0", ("o_custkey",)).df())


@query("eqdel_reinsert", "SELECT * FROM orders WHERE o_custkey % 3 <> 0 OR o_orderkey % 2 = 0")
def eqdel_reinsert(spark, d):
    t = _deleted(spark, d, "o_custkey % 3 = 0", ("o_custkey",))
    t.append(source(spark, d, "orders").where("o_custkey % 3 = 0 AND o_orderkey % 2 = 0"))
    return t.df()


@query("eqdel_multi", "SELECT * FROM orders WHERE o_custkey % 3 <> 0 AND NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def eqdel_multi(spark, d):
    t = _deleted(spark, d, "o_custkey % 3 = 0", ("o_custkey",))
    t.delete(spark.createDataFrame([("F", "1-URGENT")], "o_orderstatus string, o_orderpriority string"), ("o_orderstatus", "o_orderpriority"))
    return t.df()


query("eqdel_partitioned", "SELECT * FROM orders WHERE o_orderkey % 4 <> 1")(
    lambda spark, d: _deleted(spark, d, "o_orderkey % 4 = 1", ("o_orderkey", "o_orderdate"), ("year(o_orderdate)",)).df()
)

query("eqdel_projection_without_key", "SELECT o_totalprice FROM orders WHERE o_custkey % 3 <> 0 AND o_totalprice > 100000")(
    lambda spark, d: _deleted(spark, d, "o_custkey % 3 = 0", ("o_custkey",)).df(Compare("o_totalprice", ">", 100000.0), ["o_totalprice"])
)


@query("eqdel_null_key", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0")
def eqdel_null_key(spark, d):
    s = session(spark)
    df = source(spark, d, "orders").selectExpr("o_orderkey", "IF(o_orderkey % 5 = 0, NULL, o_orderstatus) AS s")
    t = s.create_table("t", df.schema)
    t.append(df)
    t.delete(spark.createDataFrame([(None,)], "s string"), ["s"])
    return t.df(columns=["o_orderkey"])


@query("delete_where", "SELECT * FROM nation WHERE n_regionkey <> 2")
def delete_where(spark, d):
    s = session(spark)
    lake(s, d, "nation")
    s.sql("DELETE FROM nation WHERE n_regionkey = 2")
    return s.sql("SELECT * FROM nation")


# -- SQL over lake tables

_SQL = {
    "join_inner": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000",
    "join_full": "SELECT s_suppkey, n_nationkey FROM supplier FULL OUTER JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "agg_group": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_quantity), 6) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus",
    "agg_filter": "SELECT COUNT(*) FILTER (WHERE o_totalprice > 200000) AS high, COUNT(*) AS n FROM orders",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))",
    "window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders",
    "window_frame": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "window_lag": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders",
    "union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "in_list": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'O'",
    "date_interval": "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '3' MONTH",
    "case_agg": "SELECT o_orderstatus, SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high FROM orders GROUP BY o_orderstatus",
    "subquery_alias": "SELECT t.k, t.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS t WHERE t.n > 10",
    "cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 400000) SELECT c_mktsegment, COUNT(*) AS n FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "sort_offset": "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 5",
    "string_fns": "SELECT p_partkey, upper(p_name) AS u, substring(p_brand, 1, 5) AS s, trim(concat(' ', p_type, ' ')) AS t, length(p_name) AS n, replace(p_name, 'e', 'E') AS r, p_name LIKE '%a%' AS l FROM part",
    "math_fns": "SELECT p_partkey, abs(p_size - 25) AS a, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round(sqrt(p_size), 6) AS q, round(power(p_size, 2), 2) AS w FROM part",
    "q12_like": "SELECT l_returnflag, SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high_line_count, SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low_line_count FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_returnflag",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _plain_sql(spark, d, sql: str) -> DataFrame:
    s = session(spark)
    for t in _TABLES:
        if t in sql:
            lake(s, d, t)
    return s.sql(sql)


def _wide(sql: str) -> str:
    """DuckDB sums integers in 128 bits, and counts floor and ceil as doubles."""
    sql = re.sub(r"SUM\((CASE.*?END)\)", r"CAST(SUM(\1) AS BIGINT)", sql)
    return re.sub(r"\b(floor|ceil)\((\w+)\)", r"CAST(\1(\2) AS BIGINT)", sql)


for _name, _sql in _SQL.items():
    query(_name, _wide(_sql))(lambda spark, d, q=_sql: _plain_sql(spark, d, q))


@query("date_fns", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS n FROM orders")
def date_fns(spark, d):
    return _plain_sql(spark, d, "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS n FROM orders")


@query("json_fn", "SELECT event_id, md5(props) AS h, length(props) AS n, json_extract_string(props, '$.k') AS k FROM events")
def json_fn(spark, d):
    return _plain_sql(spark, d, "SELECT event_id, md5(CAST(props AS BINARY)) AS h, length(props) AS n, get_json_object(props, '$.k') AS k FROM events")


@query("array_fn", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, ROUND(CAST(embedding[1] AS DOUBLE), 6) AS first, list_contains([label, 3], 3) AS has FROM embeddings")
def array_fn(spark, d):
    s = session(spark)
    lake(s, d, "embeddings")
    return s.sql("SELECT vec_id, size(embedding) AS n, round(CAST(embedding[0] AS DOUBLE), 6) AS first, array_contains(array(label, 3), 3) AS has FROM embeddings")


@query("udf_surface", "SELECT n_name, length(n_name) * 2 AS v FROM nation")
def udf_surface(spark, d):
    @F.pandas_udf("int")
    def doubled(names: pd.Series) -> pd.Series:
        return names.str.len() * 2

    spark.udf.register("tarnlake_doubled", doubled)
    return _plain_sql(spark, d, "SELECT n_name, tarnlake_doubled(n_name) AS v FROM nation")


# -- views


@query("view_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def view_scan(spark, d):
    s = session(spark)
    lake(s, d, "orders")
    s.sql("CREATE VIEW big AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
    return s.sql("SELECT * FROM big")


@query("view_branch_version", "SELECT 'main' AS b, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'dev', COUNT(*) FROM orders WHERE o_orderstatus = 'O'")
def view_branch_version(spark, d):
    from tarnlake.operators.views import update_view

    s = session(spark)
    lake(s, d, "orders")
    s.sql("CREATE VIEW v AS SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
    update_view(s.resolver, "v", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'", "dev")
    count = lambda x, b: x.sql("SELECT count(*) AS n FROM v").select(F.lit(b).alias("b"), "n")
    return count(s, "main").unionByName(count(s.on("dev"), "dev"))


@query("view_over_view", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY o_orderstatus")
def view_over_view(spark, d):
    s = session(spark)
    lake(s, d, "orders")
    s.sql("CREATE VIEW big AS SELECT * FROM orders WHERE o_totalprice > 300000")
    s.sql("CREATE VIEW counted AS SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
    return s.sql("SELECT * FROM counted")


@query("sql_catalog", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def sql_catalog(spark, d):
    from tarnlake.sources.catalog import SqlCatalog
    from tarnlake.sources.storage import new_warehouse

    s = LakeSession(spark, SqlCatalog(spark, new_warehouse(spark), ":memory:"))
    lake(s, d, "nation")
    return s.sql("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")


# -- materialized views


def refreshed(spark, d, sql: str, expect: str, tables: tuple, extra: str = "") -> DataFrame:
    """Refresh after the first batches, again after the rest; ``expect`` is how the second must go."""
    s = session(spark)
    cut = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey", "events": "event_id"}
    at = {}
    for t in tables:
        top = source(spark, d, t).agg(F.max(cut[t])).first()[0]
        at[t] = f"{cut[t]} <= {int(top * 0.6)}"
        lake(s, d, t, batches=(at[t],))
    s.sql(f"CREATE MATERIALIZED VIEW mv AS {sql}")
    first = s.refresh("mv")
    for t in tables:
        s.table(t).append(source(spark, d, t).where(f"NOT ({at[t]})"))
    second = s.refresh("mv")
    if (first, second) != ("full", expect):
        raise AssertionError(f"refreshed {first}, {second}; expected full, {expect}")
    return s.sql("SELECT * FROM mv")


_MV = {
    "mv_full_window": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders", "full", ("orders",)),
    "mv_full_sort": ("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice", "full", ("orders",)),
    "mv_full_distinct": ("SELECT DISTINCT o_custkey FROM orders", "full", ("orders",)),
    "mv_full_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10", "full", ("orders",)),
    "mv_full_global": ("SELECT COUNT(*) AS n, MAX(o_orderkey) AS k FROM orders", "full", ("orders",)),
    "mv_full_subquery": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)", "full", ("orders", "customer")),
    "mv_filter": ("SELECT * FROM orders WHERE o_orderstatus = 'F'", "incremental", ("orders",)),
    "mv_project": ("SELECT o_orderkey, o_totalprice > 250000 AS big FROM orders", "incremental", ("orders",)),
    "mv_union": ("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT o_orderkey FROM orders", "incremental", ("orders", "customer")),
    "mv_join": ("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey", "incremental", ("customer", "orders")),
    "mv_join3": ("SELECT c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 30", "incremental", ("customer", "orders", "lineitem")),
    "mv_self_join": ("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey", "incremental", ("orders",)),
    "mv_agg_sum": ("SELECT l_returnflag, SUM(l_linenumber) AS total FROM lineitem GROUP BY l_returnflag", "incremental", ("lineitem",)),
    "mv_agg_count": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey", "incremental", ("orders",)),
    "mv_agg_minmax": ("SELECT o_custkey, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, MAX(o_orderdate) AS last FROM orders GROUP BY o_custkey", "incremental", ("orders",)),
    "mv_agg_join": ("SELECT c_mktsegment, COUNT(*) AS n, SUM(l_linenumber) AS s, MAX(o_totalprice) AS hi FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_mktsegment", "incremental", ("customer", "orders", "lineitem")),
    "mv_case_agg": ("SELECT o_orderstatus, SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS many FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus", "incremental", ("orders", "lineitem")),
    "mv_q12": (_SQL["q12_like"], "incremental", ("orders", "lineitem")),
    "mv_expression_key": ("SELECT year(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY year(o_orderdate)", "incremental", ("orders",)),
    "mv_null_group": ("SELECT CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS s, COUNT(*) AS n, SUM(CASE WHEN o_custkey % 4 = 1 THEN o_orderkey END) AS t FROM orders GROUP BY CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END", "incremental", ("orders",)),
    "mv_avg_fallback": ("SELECT o_orderstatus, ROUND(AVG(o_totalprice), 4) AS a FROM orders GROUP BY o_orderstatus", "full", ("orders",)),
    "mv_outer_join_fallback": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "full", ("customer", "orders")),
}


def _mv_oracle(sql: str) -> str:
    sql = re.sub(r"SUM\((l_linenumber)\)", r"CAST(SUM(\1) AS BIGINT)", _wide(sql))
    return sql.replace("year(o_orderdate) AS y", "CAST(year(o_orderdate) AS INTEGER) AS y")


for _name, (_sql, _expect, _tables) in _MV.items():
    query(_name, _mv_oracle(_sql))(lambda spark, d, a=(_sql, _expect, _tables): refreshed(spark, d, *a))


@query("mv_noop_fresh", "SELECT o_custkey, COUNT(*) AS n, 'fresh' AS how FROM orders GROUP BY o_custkey")
def mv_noop_fresh(spark, d):
    """A refresh without news changes nothing and makes no snapshot."""
    s = session(spark)
    lake(s, d, "orders", columns=("o_custkey", "o_orderkey"), batches=("o_orderkey <= 7000",))
    s.sql("CREATE MATERIALIZED VIEW mv AS SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
    s.refresh("mv")
    s.table("orders").append(source(spark, d, "orders").select("o_custkey", "o_orderkey").where("o_orderkey > 7000"))
    s.refresh("mv")
    held = len(s.table("mv__storage").metadata.snapshots)
    how = s.refresh("mv")
    if len(s.table("mv__storage").metadata.snapshots) != held:
        raise AssertionError("a refresh without news made a snapshot")
    return s.sql("SELECT *, '" + how + "' AS how FROM mv")


@query("mv_on_mv", "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def mv_on_mv(spark, d):
    s = session(spark)
    lake(s, d, "orders", batches=("o_orderkey <= 7000",))
    s.sql("CREATE MATERIALIZED VIEW f AS SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
    s.sql("CREATE MATERIALIZED VIEW mv AS SELECT o_custkey, count(*) AS n FROM f GROUP BY o_custkey")
    how = [s.refresh("f"), s.refresh("mv")]
    s.table("orders").append(source(spark, d, "orders").where("o_orderkey > 7000"))
    how += [s.refresh("f"), s.refresh("mv")]
    if source(spark, d, "orders").where("o_orderkey > 7000").limit(1).count() and how[2:] != ["incremental", "incremental"]:
        raise AssertionError(how)
    return s.sql("SELECT * FROM mv")


@query("mv_branch", "SELECT 'main' AS b, COUNT(*) AS n FROM orders WHERE o_orderkey <= 7000 UNION ALL SELECT 'dev', COUNT(*) FROM orders")
def mv_branch(spark, d):
    s = session(spark)
    t = lake(s, d, "orders", batches=("o_orderkey <= 7000",))
    s.sql("CREATE MATERIALIZED VIEW mv AS SELECT o_orderkey FROM orders")
    s.refresh("mv")
    t.create_branch("dev").append(source(spark, d, "orders").where("o_orderkey > 7000"))
    dev = s.on("dev")
    dev.refresh("mv")
    count = lambda x, b: x.sql("SELECT count(*) AS n FROM mv").select(F.lit(b).alias("b"), "n")
    return count(s, "main").unionByName(count(dev, "dev"))


@query("mv_source_delete", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_orderstatus")
def mv_source_delete(spark, d):
    s = session(spark)
    t = lake(s, d, "orders")
    s.sql("CREATE MATERIALIZED VIEW mv AS SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
    s.refresh("mv")
    t.delete(source(spark, d, "orders").where("o_custkey % 3 = 0").select("o_custkey"), ["o_custkey"])
    if s.refresh("mv") != "full":
        raise AssertionError("a source with deletes must be computed anew")
    return s.sql("SELECT * FROM mv")


@query("stream_ingest", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def stream_ingest(spark, d):
    from tarnlake.streaming.ingest import append_stream

    s = session(spark)
    df = source(spark, d, "events")
    s.create_table("events", df.schema)
    s.sql("CREATE MATERIALIZED VIEW mv AS SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
    folder = f"{s.catalog.warehouse}/incoming"
    df.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    append_stream(s, stream, "events", f"{s.catalog.warehouse}/progress", ("mv",)).trigger(availableNow=True).start().awaitTermination()
    return s.sql("SELECT * FROM mv")
