"""SQL over lake tables: pruning, time travel, statements; and commits that race."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from tarnlake.operators.views import Refresh, refresh
from tarnlake.plans.metadata import CommitConflict
from tarnlake.plans.predicates import Compare
from tarnlake.sources.session import LakeSession
from tarnlake.streaming.ingest import append_batch, append_stream


@pytest.fixture
def s(spark):
    return LakeSession(spark)


@pytest.fixture(scope="module")
def fixed(spark):
    """For tests that only read."""
    return filled(LakeSession(spark))


@pytest.fixture
def days(s):
    return filled(s)


def filled(s):
    """Ten days, one commit and file each, twice the rows of the day's number."""
    s.sql("CREATE TABLE t (id BIGINT, day DATE, name STRING, price DECIMAL(8,2), at TIMESTAMP) PARTITIONED BY (day)")
    for d in range(1, 11):
        s.sql(f"INSERT INTO t SELECT id + {10 * d}, DATE'2020-01-{d:02d}', concat('n', id), CAST(id AS DECIMAL(8,2)), TIMESTAMP'2020-01-{d:02d} 12:00:00' FROM range({2 * d})")
    return s


@pytest.mark.parametrize("where, files", [
    ("day = DATE'2020-01-03'", 1), ("day > DATE'2020-01-08'", 2), ("day IN (DATE'2020-01-01', DATE'2020-01-09')", 2),
    ("id BETWEEN 10 AND 15", 1), ("day < DATE'2020-01-03' OR id > 105", 4), ("price >= 17", 2), ("name = 'n19'", 9),
    ("at >= TIMESTAMP'2020-01-09 00:00:00'", 2), ("day = '2020-01-03' AND upper(name) = 'N1'", 1), ("id + 1 > 5", 10), ("NOT (id = 1)", 10), ("id IS NULL", 0),
])
def test_where_prunes_files(fixed, where, files):
    days = fixed
    df = days.sql(f"SELECT * FROM t WHERE {where}")
    assert len(df.inputFiles()) == files
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, days.table("t").df().where(where).collect()))


def test_each_place_is_pruned_for_itself(days):
    df = days.sql("SELECT a.id FROM t a JOIN t b ON a.id = b.id - 10 WHERE a.day = DATE'2020-01-02' AND b.day = DATE'2020-01-03'")
    assert len(df.inputFiles()) == 2 and df.count() == 4
    df = days.sql("WITH c AS (SELECT * FROM t) SELECT count(*) AS n FROM c x, c y WHERE x.id = y.id AND x.day = DATE'2020-01-02'")
    assert df.first().n == 4
    df = days.sql("SELECT a.day, b.id FROM t a LEFT JOIN t b ON a.id = b.id AND b.day = DATE'2020-01-02' WHERE a.day < DATE'2020-01-04'")
    assert len(df.inputFiles()) == 3 and df.count() == 12 and df.where("id IS NOT NULL").count() == 4
    df = days.sql("SELECT * FROM t WHERE id = (SELECT max(id) FROM t WHERE day = DATE'2020-01-05')")
    assert df.count() == 1 and df.first().id == 59
    days.sql("CREATE VIEW v AS SELECT id, day AS d FROM t WHERE id > 30")
    assert len(days.sql("SELECT * FROM v WHERE d = DATE'2020-01-07'").inputFiles()) == 1


def test_pruning_stays_above_equality_deletes(days):
    days.sql("DELETE FROM t WHERE id = 21")
    rows = days.sql("SELECT id FROM t WHERE day = DATE'2020-01-02' ORDER BY id").collect()
    assert [r.id for r in rows] == [20, 22, 23]


def test_time_travel_in_sql(days):
    t = days.table("t")
    meta = t.metadata
    third = next(x for x in meta.snapshots.values() if x.sequence_number == 3)
    t.create_tag("early", snapshot_id=third.snapshot_id)
    count = lambda text: days.sql(text).first()[0]
    assert count(f"SELECT count(*) FROM t VERSION AS OF {third.snapshot_id}") == 12
    assert count("SELECT count(*) FROM t VERSION AS OF 'early' AS x WHERE x.day > DATE'2020-01-01'") == 10
    assert count(f"SELECT count(*) FROM t FOR SYSTEM_VERSION AS OF {third.snapshot_id} x JOIN t y ON x.id = y.id") == 12
    when = dt.datetime.fromtimestamp(third.timestamp_ms / 1000, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    assert count(f"SELECT count(*) FROM t TIMESTAMP AS OF '{when}'") == 12
    assert count("SELECT count(*) FROM t TIMESTAMP AS OF current_timestamp()") == count("SELECT count(*) FROM t")
    days.sql("CREATE VIEW old AS SELECT id FROM t VERSION AS OF 'early'")
    assert count("SELECT count(*) FROM old") == 12
    with pytest.raises(KeyError):
        days.sql("SELECT * FROM t VERSION AS OF 'never'")


def test_describe_show_alter(s):
    s.sql('CREATE TABLE t (a BIGINT NOT NULL, d DATE) PARTITIONED BY ("month(d)")')
    s.sql("CREATE VIEW v AS SELECT a + 1 AS b FROM t")
    assert [tuple(r) for r in s.sql("DESCRIBE TABLE t").collect()] == [("a", "bigint", False, ""), ("d", "date", True, "month")]
    assert [r.col_name for r in s.sql("DESC v").collect()] == ["b"]
    assert [r.data_type for r in s.sql("DESCRIBE SELECT d, a FROM t").collect()] == ["date", "bigint"]
    assert sorted((r.name, r.kind) for r in s.sql("SHOW TABLES").collect()) == [("t", "table"), ("v", "view")]
    assert [r.namespace for r in s.sql("SHOW NAMESPACES").collect()] == ["public"] and s.sql("SHOW CATALOGS").count() == 1
    s.sql("INSERT INTO t VALUES (1, DATE'2020-01-01')")
    s.sql("ALTER TABLE t ADD COLUMNS (x STRING, y INT)")
    s.sql("ALTER TABLE t RENAME COLUMN x TO z")
    s.sql("ALTER TABLE t DROP COLUMN y")
    s.sql("INSERT INTO t VALUES (2, DATE'2020-02-01', 'q')")
    assert sorted(map(tuple, s.sql("SELECT a, z FROM t").collect())) == [(1, None), (2, "q")]
    s.sql("ALTER TABLE t SET TBLPROPERTIES ('k.a' = 'v', w = '2')")
    s.sql("ALTER TABLE t UNSET TBLPROPERTIES ('w')")
    assert s.table("t").metadata.properties == {"k.a": "v"}
    s.sql("ALTER TABLE t CREATE BRANCH dev")
    s.sql("ALTER TABLE t CREATE TAG one")
    s.on("dev").sql("INSERT INTO t VALUES (3, NULL, NULL)")
    assert s.on("dev").sql("SELECT * FROM t").count() == 3 and s.sql("SELECT * FROM t").count() == 2
    s.sql("ALTER TABLE t DROP BRANCH dev")
    s.sql("ALTER TABLE t SET PARTITIONING (a, bucket(4, a))")
    assert [f.transform for f in s.table("t").metadata.spec] == ["identity", "bucket[4]"]
    with pytest.raises(ValueError):
        s.sql("ALTER TABLE t FLY")


@pytest.mark.parametrize("sql, want", [
    ("SELECT id, amount FROM t", [(1, 10), (2, 20), (3, 30)]),
    ("SELECT id % 2 AS k, count(*) AS n FROM t GROUP BY id % 2", [(0, 1), (1, 2)]),
    ("SELECT avg(amount) AS a FROM t", [(20.0,)]),
])
def test_two_refreshers_of_one_view(s, sql, want):
    s.sql("CREATE TABLE t (id BIGINT, amount BIGINT)")
    s.sql("INSERT INTO t VALUES (1, 10), (2, 20)")
    s.sql(f"CREATE MATERIALIZED VIEW v AS {sql}")
    s.refresh("v")
    s.sql("INSERT INTO t VALUES (3, 30)")
    first, second = Refresh(s.resolver, "v"), Refresh(s.resolver, "v")  # both read the same state
    assert first.run() in ("incremental", "full")
    with pytest.raises(CommitConflict):
        second.run()
    assert refresh(s.resolver, "v") == "fresh"
    assert sorted(map(tuple, s.sql("SELECT * FROM v").collect())) == want
    s.sql("INSERT INTO t VALUES (4, 40)")
    said, threads = [], []
    for _ in range(3):
        threads.append(threading.Thread(target=lambda: said.append(refresh(s.resolver, "v"))))
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(said) == 3
    plain = s.sql(sql.replace("FROM t", "FROM t")).collect()
    assert sorted(map(tuple, s.sql("SELECT * FROM v").collect())) == sorted(map(tuple, plain))


def test_two_stream_writers_of_one_batch(s, tmp_path):
    t = s.create_table("t", s.spark.range(1).schema)
    said, threads = [], []
    for k in range(3):
        threads.append(threading.Thread(target=lambda: said.append(append_batch(s.table("t"), s.spark.range(10), "a", 0))))
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(said) == [False, False, True] and t.df().count() == 10
    t.append(s.spark.range(5))
    t.expire_snapshots(2**62)
    assert not append_batch(t, s.spark.range(10), "a", 0)  # the mark outlives its snapshot
    assert append_batch(t, s.spark.range(10), "a", 1) and append_batch(t, s.spark.range(10), "b", 0)
    assert t.df().count() == 35
    assert append_stream is not None


def test_files_roll_over_at_a_size(s):
    df = s.spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).coalesce(1)
    t = s.create_table("t", df.schema, properties={"write.target-file-size-bytes": "1000000", "write.parquet.row-group-size-bytes": "300000", "write.parquet.compression-level": "1", "write.object-storage.enabled": "true"})
    t.append(df)
    t.append(df)  # now by what a row takes
    files = t.files()
    second = [f for f in files if f.sequence_number == 2]
    assert len(second) >= 3 and all(f.bytes < 1_600_000 for f in second) and t.df().count() == 120_000
    import pyarrow.parquet as pq

    from tarnlake.sources.storage import local_path

    assert pq.read_metadata(local_path(second[0].path)).num_row_groups > 1
    prefixes = {f.path.split("/data/")[1].split("/")[0] for f in files}
    assert all(len(p) == 2 for p in prefixes)


def test_rollover_is_written_by_all_tasks(spark, tmp_path):
    """Every task writes what it read; no one task gets the whole table."""
    from tarnlake.plans.queries_sql import write_rollover

    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows.repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = write_rollover(spark, str(tmp_path))
    tasks = {f.rsplit("/", 1)[1].split("-")[1] for f in got.inputFiles()}
    assert len(tasks) == 4 and got.count() == rows.count()
    assert got.exceptAll(rows.select(*got.columns)).count() == 0


def test_moments_have_bounds(s):
    t = s.create_table("t", s.spark.sql("SELECT TIMESTAMP'2020-01-01 00:00:00' AS at, 1 AS k").schema)
    for d in (1, 2, 3):
        t.append(s.spark.sql(f"SELECT TIMESTAMP'2020-01-0{d} 08:30:00.25' AS at, {d} AS k"))
    assert t.files()[0].lower["at"] == dt.datetime(2020, 1, 1, 8, 30, 0, 250000)
    moment = dt.datetime(2020, 1, 2, 8, 30, 0, 250000, tzinfo=dt.timezone.utc)
    assert len(t.files(Compare("at", ">=", moment))) == 2 and t.df(Compare("at", "=", moment)).first().k == 2
