import datetime as dt
import threading
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators import manifest as M
from tarnlake.operators.table import LakeTable
from tarnlake.operators.views import Refresh
from tarnlake.plans.metadata import CommitConflict, TableMetadata, ViewMetadata, parse
from tarnlake.plans.predicates import And, Compare, Or, literal_first
from tarnlake.sources.catalog import Exists, FileCatalog, NoSuch, SqlCatalog, split
from tarnlake.sources.session import LakeSession
from tarnlake.sources.storage import AlreadyThere, Storage, new_warehouse

ORDERS = "CREATE TABLE orders (id BIGINT NOT NULL, customer_id BIGINT NOT NULL, product_id BIGINT NOT NULL, date DATE NOT NULL, amount INT NOT NULL)"
BATCH1 = "(1,1,1,DATE'2020-01-01',1),(2,2,1,DATE'2020-01-01',1),(3,3,1,DATE'2020-01-01',3),(4,1,2,DATE'2020-02-02',1),(5,1,1,DATE'2020-02-02',2),(6,3,3,DATE'2020-02-02',3)"
BATCH2 = "(7,1,3,DATE'2020-01-03',1),(8,2,1,DATE'2020-01-03',2),(9,2,2,DATE'2020-01-03',1)"


def by_product(s, table="orders", what="sum(amount)"):
    return {r.product_id: r.t for r in s.sql(f"SELECT product_id, {what} AS t FROM {table} GROUP BY product_id").collect()}


@pytest.fixture(params=["file", "sql"])
def session(spark, request):
    root = new_warehouse(spark)
    return LakeSession(spark, FileCatalog(spark, root) if request.param == "file" else SqlCatalog(spark, root, ":memory:"))


def test_insert_and_equality_delete(session):
    for extra in ("", ' PARTITIONED BY ("day(date)")'):
        session.sql(ORDERS + extra)
        assert session.sql(f"INSERT INTO orders VALUES {BATCH1}").first()[0] == 6
        assert by_product(session) == {1: 7, 2: 1, 3: 3}
        session.sql(f"INSERT INTO orders VALUES {BATCH2}")
        assert by_product(session) == {1: 9, 2: 2, 3: 4}
        session.sql("DELETE FROM orders WHERE id > 6")
        t = session.table("orders")
        gone = session.sql("SELECT id, customer_id, product_id, date FROM orders WHERE customer_id = 1")
        t.delete(gone, ["id", "customer_id", "product_id", "date"])
        assert by_product(session) == {1: 4, 3: 3}
        assert [m["sequence_number"] for m in t.manifests(t.metadata, t.metadata.snapshot())] == [1, 2, 3, 4]
        session.sql("DROP TABLE orders")


def test_required_columns_and_types(session):
    session.sql(ORDERS)
    t, spark = session.table("orders"), session.spark
    ok = spark.sql(f"SELECT * FROM VALUES {BATCH1} AS t(id, customer_id, product_id, date, amount)")
    t.append(ok)
    with pytest.raises(Exception, match="null in required column amount"):
        t.append(ok.withColumn("amount", F.expr("IF(id = 3, NULL, amount)")))
    with pytest.raises(ValueError):
        t.append(ok.withColumn("id", F.lit("x")))
    with pytest.raises(ValueError):
        t.append(ok.drop("id"))
    assert t.df().count() == 6


def test_sequence_ranges(session):
    session.sql(ORDERS)
    t = session.table("orders")
    for b in (BATCH1, BATCH2, BATCH2.replace("(7", "(17")):
        session.sql(f"INSERT INTO orders VALUES {b}")
    ids = [i for _, i in t.metadata.log]
    count = lambda **k: t.df(**k).count()
    assert [count(snapshot_id=i) for i in ids] == [6, 9, 12]
    assert count(after_snapshot=ids[0]) == 6 and count(after_snapshot=ids[0], snapshot_id=ids[1]) == 3 and count(after_snapshot=ids[2]) == 0
    assert t.df(as_of_ms=0).count() == 0 and t.df(as_of_ms=2**60).count() == 12
    with pytest.raises(KeyError):
        t.df(snapshot_id=1)


def test_two_writers(session):
    session.sql(ORDERS)
    session.sql(f"INSERT INTO orders VALUES {BATCH1}")
    a, b = session.table("orders"), session.table("orders")
    df = a.df()
    old = a.catalog.load(a.identifier)[1]
    a.append(df)
    with pytest.raises(CommitConflict):
        a.catalog.swap(a.identifier, old, a.metadata)
    real, once = b.catalog.load, []

    def racing(identifier):
        got = real(identifier)
        if not once:
            once.append(1)
            a2 = LakeTable(b.catalog, identifier)
            a2.append(df)
        return got

    b.catalog.load = racing
    try:
        with pytest.raises(CommitConflict):
            b.replace(df)
        once.clear()
        assert b.append(df) == 6
    finally:
        b.catalog.load = real
    assert by_product(session)[2] == 5


def test_exclusive_create(spark):
    s, path, wins = Storage(spark), new_warehouse(spark) + "/x.json", []

    def go(k):
        try:
            s.create(path, str(k))
            wins.append(k)
        except AlreadyThere:
            pass

    ts = [threading.Thread(target=go, args=(k,)) for k in range(8)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert len(wins) == 1 and s.read(path) == str(wins[0])


def test_catalog_operations(session):
    c = session.catalog
    session.sql("CREATE SCHEMA lake.sales")
    assert c.namespaces() == ["public", "sales"] and c.namespace_exists("sales")
    with pytest.raises(Exists):
        session.sql("CREATE SCHEMA sales")
    session.sql("CREATE SCHEMA IF NOT EXISTS sales")
    c.update_namespace("sales", {"owner": "me"})
    assert c.namespace_properties("sales") == {"owner": "me"}
    session.sql("CREATE TABLE sales.t (a INT)")
    assert c.tabulars("sales") == ["sales.t"]
    with pytest.raises(Exists):
        session.sql("CREATE TABLE sales.t (a INT)")
    with pytest.raises(Exists):
        session.sql("DROP SCHEMA sales")
    c.register("sales.again", c.pointer("sales.t"))
    assert c.load("sales.again")[0].uuid == c.load("sales.t")[0].uuid
    session.sql("DROP TABLE sales.t")
    session.sql("DROP TABLE IF EXISTS sales.t")
    with pytest.raises(NoSuch):
        session.sql("DROP TABLE sales.t")
    with pytest.raises(ValueError):
        split("t")
    with pytest.raises(NoSuch):
        c.create("nowhere.t", TableMetadata.new("/x", T.StructType.fromDDL("a INT")))


def test_metadata_round_trip(spark):
    schema = T.StructType.fromDDL("a INT NOT NULL, b STRUCT<c: ARRAY<STRING>, d: MAP<STRING, INT>>, e TIMESTAMP_NTZ")
    m = TableMetadata.new("/x", schema, [], {"k": "v"})
    ids = [f.metadata["parquet.field.id"] for f in m.schema().fields]
    assert ids == [1, 2, 5] and TableMetadata.from_json(m.to_json()) == m and parse(m.to_json()) == m
    v = ViewMetadata.new("/y", "SELECT 1", schema, "public", "public.s").with_version("SELECT 2", schema, "dev")
    assert parse(v.to_json()) == v and v.version().sql == "SELECT 1" and v.version("dev").sql == "SELECT 2" and v.version("other").sql == "SELECT 1"
    for bad in ('{"kind": "table"}', m.to_json().replace('"format-version": 2', '"format-version": 9'), m.to_json().replace('"current-schema-id": 0', '"current-schema-id": 4')):
        with pytest.raises(ValueError):
            parse(bad)


def test_views_and_names(session):
    session.sql(ORDERS)
    session.sql(f"INSERT INTO orders VALUES {BATCH1}")
    session.sql("CREATE VIEW v AS SELECT product_id, amount FROM orders WHERE product_id < 3")
    assert by_product(session, "v") == by_product(session, "public.v") == by_product(session, "lake.public.v") == {1: 7, 2: 1}
    session.sql("CREATE OR REPLACE VIEW v AS SELECT product_id, amount FROM orders WHERE product_id = 3")
    assert by_product(session, "v") == {3: 3}
    session.sql("CREATE VIEW w AS SELECT orders.id, x.amount FROM orders JOIN v AS x ON orders.product_id = x.product_id")
    assert session.sql("SELECT w.id FROM w WHERE w.id IN (SELECT id FROM orders)").collect()[0].id == 6
    assert session.schema_of("SELECT id, amount + 1 AS b FROM orders").fieldNames() == ["id", "b"]
    with pytest.raises(Exists):
        session.sql("CREATE VIEW v AS SELECT 1 AS a")
    session.sql("DROP VIEW w")
    with pytest.raises(Exception):
        session.sql("SELECT * FROM w")


def test_properties_refs_and_sort_order(session):
    session.sql(ORDERS + " OPTIONS ('a' 'b')")
    session.sql(f"INSERT INTO orders VALUES {BATCH1}")
    t = session.table("orders")
    t.set_properties(c="d", a=None)
    assert t.metadata.properties == {"c": "d"}
    t.create_tag("keep")
    with pytest.raises(CommitConflict):
        t.create_branch("keep")
    first = t.metadata.snapshot().snapshot_id
    session.sql(f"INSERT INTO orders VALUES {BATCH2}")
    t.move_branch("main", first)
    assert t.df().count() == 6
    with pytest.raises(ValueError):
        t.move_branch("keep", first)
    t.drop_ref("keep")
    t.set_sort_order([("amount", "desc")])
    t.append(t.df())
    newest = [f for f in t.files() if f.sequence_number == t.metadata.last_sequence_number]
    rows = [r.amount for r in t.spark.read.parquet(newest[0].path).collect()]
    assert rows == sorted(rows, reverse=True) or len(newest) > 1


def test_many_appends_gather_manifests(session, monkeypatch):
    session.sql("CREATE TABLE t (a INT, p STRING) PARTITIONED BY (p)")
    t = session.table("t")
    real = LakeTable._gather
    monkeypatch.setattr(LakeTable, "_gather", lambda self, meta, kept, new: real(self, meta, kept, new, 3))
    for k in range(7):
        t.append(t.spark.createDataFrame([(k, "x"), (k, None), (k, "")], "a int, p string"))
    assert len(t.manifests(t.metadata, t.metadata.snapshot())) < 7 and t.df().count() == 21
    assert sorted({f.sequence_number for f in t.files()}) == list(range(1, 8))
    assert t.df(Compare("p", "=", "")).count() == 7 and t.df(Compare("p", "null")).count() == 7


def test_odd_partition_values(session):
    values = ["a/b", "a=b", "100%", "a b+c", "é", "", None, "=x", "__HIVE_DEFAULT_PARTITION__"]
    session.sql("CREATE TABLE t (v STRING, n INT) PARTITIONED BY (v)")
    t = session.table("t")
    t.append(t.spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, n int"))
    for i, v in enumerate(values):
        p = Compare("v", "=", v) if v is not None else Compare("v", "null")
        assert [r.n for r in t.df(p).collect()] == [i] and len(t.files(p)) == 1
    for k in range(9):  # beyond sixteen kinds of files a scan joins paths instead of a union
        t.append(t.spark.createDataFrame([("100%", 100 + k), ("a b+c", 200 + k)], "v string, n int"))
    t.delete(t.spark.createDataFrame([(105,), (2,), (3,)], "n int"), ["n"])
    want = [i for i in range(9) if i not in (2, 3)] + [100 + k for k in range(9) if k != 5] + [200 + k for k in range(9)]
    assert sorted(r.n for r in t.df().collect()) == want


def test_footer_and_scanned_statistics_agree(session):
    session.sql("CREATE TABLE t (a INT, s STRING, x DOUBLE, d DATE, n INT)")
    t = session.table("t")
    rows = [(i, f"s{i % 7}", i / 3, dt.date(2020, 1, 1 + i % 20), None if i % 2 else i) for i in range(100)] + [(None, None, float("nan"), None, None)]
    t.append(t.spark.createDataFrame(rows, "a int, s string, x double, d date, n int").coalesce(1))
    f = t.files()[0]
    got = M.scanned_statistics(t.spark, f.path.rpartition("/")[0], t.metadata.schema())[f.path]
    assert got[0] == f.rows == 101 and got[3] == f.nulls
    for c in ("a", "s", "d", "n"):
        assert (got[1][c], got[2][c]) == (f.lower[c], f.upper[c])


_COMPARE = some.one_of(
    some.builds(Compare, some.just("a"), some.sampled_from(["=", "<", "<=", ">", ">=", "<>"]), some.integers(-1, 31)),
    some.builds(Compare, some.just("d"), some.sampled_from(["=", "<", "<=", ">", ">=", "<>"]), some.dates(dt.date(2019, 12, 1), dt.date(2021, 2, 1))),
    some.builds(Compare, some.just("a"), some.just("in"), some.lists(some.integers(0, 30), min_size=1, max_size=3).map(tuple)),
    some.builds(Compare, some.sampled_from(["a", "d"]), some.sampled_from(["null", "notnull"])),
)
_PREDICATE = some.recursive(_COMPARE, lambda p: some.one_of(some.builds(lambda a, b: And((a, b)), p, p), some.builds(lambda a, b: Or((a, b)), p, p)), max_leaves=4)


@pytest.fixture(scope="module")
def pruned(spark):
    s = LakeSession(spark)
    rows = [(i, i % 31 if i % 13 else None, dt.date(2020, 1, 1) + dt.timedelta(days=i % 380) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, a int, d date")
    out = []
    for n, parts in enumerate([(), ("month(d)",), ("bucket(3, a)", "year(d)"), ("truncate(10, a)",)]):
        t = s.create_table(f"t{n}", df.schema, parts)
        t.append(df.where("k < 150").coalesce(2))
        t.append(df.where("k >= 150").coalesce(2))
        out.append(t)
    return out, df.collect()


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(p=_PREDICATE)
def test_pruning_loses_no_row(pruned, p):
    tables, rows = pruned
    ops = {"=": lambda x, v: x == v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<>": lambda x, v: x != v, "in": lambda x, v: x in v}

    def holds(q, r):
        if isinstance(q, And):
            return all(holds(x, r) for x in q.parts)
        if isinstance(q, Or):
            return any(holds(x, r) for x in q.parts)
        x = r[q.column]
        if q.op in ("null", "notnull"):
            return (x is None) == (q.op == "null")
        return x is not None and ops[q.op](x, q.value)

    want = {r.k for r in rows if holds(p, r)}
    for t in tables:
        meta = t.metadata
        kept = {f.path for f in t.files(p, meta=meta)}
        for f in t.files(meta=meta):
            if f.path not in _ROWS:
                _ROWS[f.path] = {r.k for r in t.spark.read.parquet(f.path).select("k").collect()}
            assert f.path in kept or not _ROWS[f.path] & want


_ROWS: dict = {}


def test_pruning_reads_fewer_files(pruned):
    t = pruned[0][1]
    p = literal_first(dt.date(2020, 3, 5), "<=", "d") & Compare("d", "<", dt.date(2020, 4, 2))
    assert len(t.files(p)) < len(t.files()) / 3
    assert t.df(p).count() == t.df().where("d >= '2020-03-05' and d < '2020-04-02'").count()


_MV = [
    "SELECT a, b FROM l WHERE a < 3",
    "SELECT a FROM l UNION ALL SELECT a FROM r",
    "SELECT l.a, r.c FROM l JOIN r ON l.a = r.a",
    "SELECT x.b, y.b AS z FROM l x JOIN l y ON x.a = y.a",
    "SELECT a, count(*) AS n, sum(b) AS s, min(b) AS lo, max(b) AS hi FROM l GROUP BY a",
    "SELECT r.c, count(l.b) AS n, sum(l.b) AS s FROM l JOIN r ON l.a = r.a GROUP BY r.c",
]
_ROW = some.tuples(some.one_of(some.none(), some.integers(0, 4)), some.one_of(some.none(), some.integers(0, 9)))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(steps=some.lists(some.tuples(some.sampled_from(["l", "r"]), some.lists(_ROW, min_size=1, max_size=5)), min_size=2, max_size=4))
def test_incremental_equals_recomputed(spark, steps):
    s = LakeSession(spark)
    s.create_table("l", T.StructType.fromDDL("a INT, b INT"))
    s.create_table("r", T.StructType.fromDDL("a INT, c INT"))
    for i, q in enumerate(_MV):
        s.sql(f"CREATE MATERIALIZED VIEW m{i} AS {q}")
        assert s.refresh(f"m{i}") == "full"
    for table, rows in steps:
        s.table(table).append(spark.createDataFrame(rows, "a int, b int" if table == "l" else "a int, c int"))
    for i, q in enumerate(_MV):
        assert s.refresh(f"m{i}") in ("incremental", "fresh")
        key = lambda df: sorted(map(repr, map(tuple, df.collect())))
        assert key(s.sql(f"SELECT * FROM m{i}")) == key(s.sql(q)), q


def test_refresh_ways(spark):
    s = LakeSession(spark)
    s.sql(ORDERS)
    s.sql("CREATE MATERIALIZED VIEW v AS SELECT product_id, amount FROM orders WHERE product_id < 3")
    s.sql("CREATE MATERIALIZED VIEW t AS SELECT product_id, sum(amount) AS total FROM v GROUP BY product_id")
    s.sql(f"INSERT INTO orders VALUES {BATCH1}")
    assert [s.refresh("v"), s.refresh("t")] == ["full", "full"]
    s.sql(f"INSERT INTO orders VALUES {BATCH2}")
    assert [s.refresh("v"), s.refresh("t"), s.refresh("t")] == ["incremental", "incremental", "fresh"]
    assert by_product(s, "t", "max(total)") == {1: 9, 2: 2}
    from tarnlake.operators.views import update_view

    update_view(s.resolver, "v", "SELECT product_id, amount FROM orders WHERE product_id = 3")
    assert s.refresh("v") == "full" and by_product(s, "v") == {3: 4}
    assert s.refresh("t") == "full" and by_product(s, "t", "max(total)") == {3: 4}
    s.table("orders").compact()
    assert s.refresh("v") == "full"
    s.sql("DROP MATERIALIZED VIEW t")
    assert not s.catalog.exists("public.t__storage")
    s.sql("CREATE VIEW plain AS SELECT * FROM orders")
    with pytest.raises(ValueError):
        s.refresh("plain")


@pytest.mark.parametrize("sql", ["SELECT rand() AS r FROM orders", "SELECT id FROM orders LIMIT 3", "SELECT product_id, count(DISTINCT id) AS n FROM orders GROUP BY product_id", "SELECT sum(amount) + 1 AS s, product_id FROM orders GROUP BY product_id", "SELECT count(*) AS n FROM orders GROUP BY product_id", "SELECT a.id FROM orders a LEFT SEMI JOIN orders b ON a.id = b.id", "SELECT n FROM (SELECT product_id, count(*) AS n FROM orders GROUP BY product_id) x", "SELECT product_id, count(*) AS n FROM orders GROUP BY product_id WITH ROLLUP", "SELECT id FROM orders UNION SELECT product_id FROM orders"])
def test_what_has_no_delta(spark, sql):
    s = LakeSession(spark)
    s.sql(ORDERS)
    s.sql(f"CREATE MATERIALIZED VIEW v AS {sql}")
    assert Refresh(s.resolver, "v").shape().kind == "full"


def test_stream_batch_is_added_once(spark):
    from tarnlake.streaming.ingest import append_stream

    s = LakeSession(spark)
    s.sql("CREATE TABLE t (a BIGINT)")
    folder, root = s.catalog.warehouse + "/in", s.catalog.warehouse
    spark.range(10).selectExpr("id AS a").write.parquet(folder)
    for progress in ("/p1", "/p1", "/p2"):  # a lost checkpoint replays batch 0
        stream = spark.readStream.schema("a long").parquet(folder)
        append_stream(s, stream, "t", root + progress).trigger(availableNow=True).start().awaitTermination()
    assert s.sql("SELECT count(*) AS n FROM t").first().n == 10


def test_no_local_warehouse_on_a_cluster():
    conf = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        new_warehouse(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
