"""More of the engine's queries: statements, pruned SQL, time travel, layouts and metadata."""

from __future__ import annotations

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.transforms import Transform, date_transform
from tarnlake.operators import manifest as M
from tarnlake.plans.catalogue import query
from tarnlake.plans.predicates import Compare
from tarnlake.plans.queries import lake, session, source
from tarnlake.sources.catalog import SqlCatalog
from tarnlake.sources.session import LakeSession


def must(holds: bool, what: str) -> None:
    if not holds:
        raise AssertionError(what)


# -- SQL scans that read only what they need


def pruned(name: str, oracle: str, sql: str, less: bool = True):
    """A query over orders, a file for each month; it must read fewer files than there are."""

    def run(spark, d):
        s = session(spark)
        t = lake(s, d, "orders", ("month(o_orderdate)",))
        df = s.sql(sql)
        must(not less or len(df.inputFiles()) < len(t.files()), f"{name} read every file")
        return df

    query(name, oracle)(run)


_RANGE = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP'1996-03-01 00:00:00' AND o_orderdate < TIMESTAMP'1996-06-01 00:00:00'"
pruned("prune_sql_range", _RANGE, _RANGE)
_EITHER = "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE (o_orderdate < TIMESTAMP'1993-01-01 00:00:00' OR o_orderdate > TIMESTAMP'1998-01-01 00:00:00') AND o_custkey % 2 = 0 GROUP BY o_orderstatus"
pruned("prune_sql_or", _EITHER, _EITHER)
_CTE = "WITH c AS (SELECT o_custkey, o_orderdate, o_totalprice FROM orders) SELECT o_custkey, MAX(o_totalprice) AS top FROM c WHERE o_orderdate BETWEEN TIMESTAMP'1995-01-01 00:00:00' AND TIMESTAMP'1995-02-15 00:00:00' GROUP BY o_custkey"
pruned("prune_sql_cte", _CTE, _CTE)


@query("prune_sql_files", "SELECT COUNT(*) AS n, COUNT(DISTINCT month(o_orderdate)) AS files FROM orders WHERE year(o_orderdate) = 1997 AND o_orderdate >= TIMESTAMP'1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP'1998-01-01 00:00:00'")
def prune_sql_files(spark, d):
    """As many files as the year has months with orders."""
    s = session(spark)
    lake(s, d, "orders", ("month(o_orderdate)",))
    df = s.sql("SELECT * FROM orders WHERE year(o_orderdate) = 1997 AND o_orderdate >= TIMESTAMP'1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP'1998-01-01 00:00:00'")
    return df.agg(F.count("*").alias("n")).withColumn("files", F.lit(len(df.inputFiles())).cast("long"))


@query("prune_sql_join", "SELECT c_custkey, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey < 40 AND o_orderkey > 1000 GROUP BY c_custkey")
def prune_sql_join(spark, d):
    """The join's other side is pruned by what equality carries over."""
    s = session(spark)
    t = lake(s, d, "orders", ("truncate(o_custkey, 50)",))
    lake(s, d, "customer")
    df = s.sql("SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey < 40 AND o_orderkey > 1000 GROUP BY c_custkey")
    must(len(df.inputFiles()) <= max(2, len(t.files()) - 1), "orders was not pruned")
    return df


@query("prune_timestamp_bounds", "SELECT event_type, COUNT(*) AS n FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY event_type")
def prune_timestamp_bounds(spark, d):
    """Not partitioned: files are told apart by the bounds of a moment, the events of the last day."""
    s = session(spark)
    df = source(spark, d, "events")
    cut = df.select(F.expr("cast(date_trunc('day', max(ts)) as timestamp_ntz)")).first()[0]
    t = lake(s, d, "events", batches=(F.col("ts") < cut, F.col("ts") >= cut))
    kept = t.files(Compare("ts", ">=", cut))
    must(0 < sum(f.rows for f in kept) < df.count(), "no file was pruned by its moments")
    return t.df(Compare("ts", ">=", cut)).groupBy("event_type").agg(F.count("*").alias("n"))


# -- time travel and metadata in SQL


@query("sql_version_as_of", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey <= 7000 GROUP BY o_orderstatus")
def sql_version_as_of(spark, d):
    s = session(spark)
    t = lake(s, d, "orders", batches=("o_orderkey <= 7000",))
    first = t.metadata.snapshot().snapshot_id
    t.append(source(spark, d, "orders").where("o_orderkey > 7000"))
    return s.sql(f"SELECT o_orderstatus, count(*) AS n FROM orders VERSION AS OF {first} GROUP BY o_orderstatus")


@query("sql_tag_as_of", "SELECT a.o_orderkey FROM orders a WHERE a.o_orderkey > 7000")
def sql_tag_as_of(spark, d):
    """What is new since a tag: both versions in one query."""
    s = session(spark)
    t = lake(s, d, "orders", columns=("o_orderkey",), batches=("o_orderkey <= 7000",))
    s.sql("ALTER TABLE orders CREATE TAG early")
    t.append(source(spark, d, "orders").select("o_orderkey").where("o_orderkey > 7000"))
    return s.sql("SELECT o_orderkey FROM orders EXCEPT ALL SELECT o_orderkey FROM orders VERSION AS OF 'early'")


@query("sql_timestamp_as_of", "SELECT COUNT(*) AS n FROM orders WHERE o_orderkey <= 7000")
def sql_timestamp_as_of(spark, d):
    s = session(spark)
    t = lake(s, d, "orders", batches=("o_orderkey <= 7000",))
    ms = t.metadata.snapshot().timestamp_ms
    time.sleep(0.01)
    t.append(source(spark, d, "orders").where("o_orderkey > 7000"))
    return s.sql(f"SELECT count(*) AS n FROM orders TIMESTAMP AS OF timestamp_millis({ms})")


@query("describe_table", "SELECT column_name AS col_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp' END AS data_type FROM information_schema.columns WHERE table_name = 'orders'")
def describe_table(spark, d):
    s = session(spark)
    lake(s, d, "orders")
    return s.sql("DESCRIBE TABLE orders").select("col_name", F.regexp_replace("data_type", "timestamp_ntz", "timestamp").alias("data_type"))


@query("schema_of_sql", "SELECT column_name AS name, row_number() OVER (ORDER BY ordinal_position) AS place FROM information_schema.columns WHERE table_name = 'customer'")
def schema_of_sql(spark, d):
    """The output schema of a query that does not run."""
    s = session(spark)
    lake(s, d, "customer")
    names = s.schema_of("SELECT * FROM customer WHERE raise_error('never run') IS NULL").fieldNames()
    return spark.createDataFrame([(n, k) for k, n in enumerate(names, 1)], "name string, place long")


# -- statements


@query("insert_overwrite", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def insert_overwrite(spark, d):
    s = session(spark)
    lake(s, d, "orders", columns=("o_orderkey", "o_custkey"))
    s.sql("INSERT OVERWRITE orders SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
    return s.sql("SELECT * FROM orders")


@query("mv_sql_refresh", "SELECT o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_orderpriority")
def mv_sql_refresh(spark, d):
    s = session(spark)
    lake(s, d, "orders", batches=("o_orderkey <= 7000",))
    s.sql("CREATE MATERIALIZED VIEW mv AS SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderpriority")
    s.sql("REFRESH MATERIALIZED VIEW mv")
    s.table("orders").append(source(spark, d, "orders").where("o_orderkey > 7000"))
    must(s.sql("SELECT refresh_materialized_view('mv')").first()[0] in ("incremental", "fresh"), "the refresh was not incremental")
    return s.sql("SELECT * FROM mv")


@query("schema_ddl", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def schema_ddl(spark, d):
    """A schema, a table and a view in it, a second schema that goes again."""
    s = session(spark)
    s.sql("CREATE SCHEMA IF NOT EXISTS geo")
    s.sql("CREATE SCHEMA gone")
    lake(s, d, "nation")
    s.sql("CREATE TABLE geo.nations (n_nationkey BIGINT, n_regionkey BIGINT)")
    s.sql("INSERT INTO geo.nations SELECT n_nationkey, n_regionkey FROM nation")
    s.sql("CREATE VIEW geo.counts AS SELECT n_regionkey, count(*) AS n FROM geo.nations GROUP BY n_regionkey")
    s.sql("DROP SCHEMA gone")
    must(sorted(r.namespace for r in s.sql("SHOW NAMESPACES").collect()) == ["geo", "public"], "namespaces")
    kind = source(spark, d, "nation").schema["n_regionkey"].dataType
    return s.sql("SELECT * FROM geo.counts").withColumn("n_regionkey", F.col("n_regionkey").cast(kind))


@query("drop_objects", "SELECT 'nation' AS name")
def drop_objects(spark, d):
    s = session(spark)
    for t in ("nation", "region"):
        lake(s, d, t)
    s.sql("CREATE VIEW v AS SELECT * FROM region")
    s.sql("DROP VIEW v")
    s.sql("DROP TABLE region")
    s.sql("DROP TABLE IF EXISTS region")
    return s.sql("SHOW TABLES").select("name")


@query("alter_columns", "SELECT r_regionkey, r_name AS label, CAST(NULL AS INTEGER) AS extra FROM region")
def alter_columns(spark, d):
    s = session(spark)
    lake(s, d, "region", columns=("r_regionkey", "r_name"))
    s.sql("ALTER TABLE region ADD COLUMNS (extra INT)")
    s.sql("ALTER TABLE region RENAME COLUMN r_name TO label")
    return s.sql("SELECT r_regionkey, label, extra FROM region")


@query("catalog_list", "SELECT DISTINCT 'lake' || (r_regionkey % 2) AS catalog FROM region")
def catalog_list(spark, d):
    """Two catalogs in one database."""
    root = session(spark).catalog.warehouse
    first = SqlCatalog(spark, root, f"file:{root.rpartition('-')[2]}?mode=memory&cache=shared", "lake0")
    LakeSession(spark, first)
    LakeSession(spark, SqlCatalog(spark, root, f"file:{root.rpartition('-')[2]}?mode=memory&cache=shared", "lake1"))
    return LakeSession(spark, first).sql("SHOW CATALOGS")


# -- transforms and layouts


@query("tx_void", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS v FROM orders")
def tx_void(spark, d):
    df = source(spark, d, "orders")
    return df.select("o_orderkey", Transform.parse("void").column(F.col("o_orderkey"), T.LongType()).cast("string").alias("v"))


@query("part_void", "SELECT * FROM customer")
def part_void(spark, d):
    return lake(session(spark), d, "customer", ("void(c_custkey)",)).df()


@query("date_transform_fn", "SELECT event_id, CAST(year(ts) - 1970 AS INTEGER) AS y, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS d, CAST(floor(epoch(ts) / 3600) AS INTEGER) AS h FROM events")
def date_transform_fn(spark, d):
    df = source(spark, d, "events")
    kind = df.schema["ts"].dataType
    return df.select("event_id", *[date_transform(u, F.col("ts"), kind).alias(u[0]) for u in ("year", "day", "hour")])


@query("partition_names", "SELECT * FROM (VALUES ('o_orderdate_month'), ('o_custkey_bucket'), ('o_orderstatus')) AS t(name)")
def partition_names(spark, d):
    t = lake(session(spark), d, "orders", ("month(o_orderdate)", "bucket(o_custkey, 4)", "o_orderstatus"), batches=())
    return spark.createDataFrame([(f.name,) for f in t.metadata.spec], "name string")


@query("write_rollover", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem")
def write_rollover(spark, d):
    """Files end at a target size; row groups and compression level are the table's."""
    s = session(spark)
    df = source(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    props = {"write.target-file-size-bytes": "40000", "write.parquet.row-group-size-bytes": "1048576", "write.parquet.compression-level": "5"}
    t = s.create_table("lineitem", df.schema, properties=props)
    t.append(df)
    must(len(t.files()) >= df.count() * 20 // 40000, "files did not roll over")
    return t.df()


@query("write_object_layout", "SELECT n_nationkey, n_name FROM nation")
def write_object_layout(spark, d):
    s = session(spark)
    df = source(spark, d, "nation").select("n_nationkey", "n_name")
    t = s.create_table("nation", df.schema, properties={"write.object-storage.enabled": "true"})
    t.append(df)
    must(all(len(f.path.split("/data/")[1].split("/")) >= 4 for f in t.files()), "no hashed folders")
    return t.df()


@query("manifest_gather", "SELECT o_orderkey % 8 AS k, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderkey % 8")
def manifest_gather(spark, d):
    """Small manifests are rewritten into few; entries keep the sequence numbers that deletes go by."""
    s = session(spark)
    df = source(spark, d, "orders").select("o_orderkey", "o_custkey")
    t = s.create_table("orders", df.schema, properties={"commit.manifest.min-count-to-merge": "4"})
    for k in range(8):
        t.append(df.where(f"o_orderkey % 8 = {k}"))
    held = t.manifests(t.metadata, t.metadata.snapshot())
    must(len(held) < 8 and sorted({f.sequence_number for f in t.files()}) == list(range(1, 9)), "manifests were not gathered")
    must(any(f.status == M.EXISTING for m in held for f in M.read_manifest(t.storage, m["path"])), "no existing entries")
    return t.df().groupBy((F.col("o_orderkey") % 8).alias("k")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))
