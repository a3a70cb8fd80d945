"""Remote catalogs against small servers that keep to the public protocols, and the public file formats."""

import datetime as dt
import json
import threading
import urllib.parse
import uuid
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import types as T

from tarnlake.operators import manifest as M
from tarnlake.plans import changes
from tarnlake.plans.metadata import CommitConflict, TableMetadata, parse
from tarnlake.plans.types import from_bytes, schema_json, schema_of, to_bytes
from tarnlake.sources import avro
from tarnlake.sources.catalog import Exists, NoSuch
from tarnlake.sources.remote import GlueCatalog, RestCatalog, aws_signer
from tarnlake.sources.session import LakeSession
from tarnlake.sources.storage import Storage, local_path, new_warehouse


class Server(ThreadingHTTPServer):
    daemon_threads = True

    def __init__(self, handler, storage, root):
        super().__init__(("127.0.0.1", 0), handler)
        self.storage, self.root, self.lock, self.requests = storage, root, threading.Lock(), []
        self.namespaces, self.tables, self.versions = {}, {}, {}
        self.url = f"http://127.0.0.1:{self.server_port}"
        threading.Thread(target=self.serve_forever, daemon=True).start()


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def reply(self, status, body=None):
        raw = json.dumps(body).encode() if body is not None else b""
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def run(self):
        raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        with self.server.lock:
            self.server.requests.append((self.command, self.path, dict(self.headers)))
            try:
                self.reply(*self.answer(raw))
            except CommitConflict as e:
                self.reply(409, {"error": {"message": str(e)}})

    do_GET = do_POST = do_DELETE = run


class Rest(Handler):
    def answer(self, raw):
        s = self.server
        u = urllib.parse.urlsplit(self.path)
        query = dict(urllib.parse.parse_qsl(u.query, True))
        if u.path == "/v1/oauth/tokens":
            return 200, {"access_token": "t0k"}
        if self.headers.get("Authorization") != "Bearer t0k":
            return 401, {}
        if u.path == "/v1/config":
            return 200, {"defaults": {}, "overrides": {"prefix": "pre"}}
        parts = [urllib.parse.unquote(p) for p in u.path.removeprefix("/v1/pre/namespaces").strip("/").split("/") if p]
        body = json.loads(raw) if raw else {}
        if not parts:
            if self.command == "POST":
                name = tuple(body["namespace"])
                if name in s.namespaces:
                    return 409, {}
                s.namespaces[name] = body["properties"]
                return 200, {}
            parent = tuple(query["parent"].split("\x1f")) if "parent" in query else ()
            found = sorted(n for n in s.namespaces if n[:-1] == parent)
            at = int(query.get("pageToken") or 0)  # a page holds one
            return 200, {"namespaces": found[at : at + 1], "next-page-token": str(at + 1) if at + 1 < len(found) else None}
        ns = tuple(parts[0].split("\x1f"))
        if ns not in s.namespaces:
            return 404, {}
        if len(parts) == 1:
            if self.command == "DELETE":
                if any(k[0] == ns for k in s.tables):
                    return 409, {}
                del s.namespaces[ns]
                return 204, None
            return 200, {"namespace": ns, "properties": s.namespaces[ns]}
        if parts[1] == "properties":
            s.namespaces[ns].update(body["updates"])
            return 200, {}
        if parts[1] == "register":
            if (ns, "tables", body["name"]) in s.tables:
                return 409, {}
            s.tables[ns, "tables", body["name"]] = body["metadata-location"]
            return 200, {}
        kind = parts[1]
        if len(parts) == 2 and self.command == "GET":
            return 200, {"identifiers": [{"namespace": ns, "name": k[2]} for k in s.tables if k[:2] == (ns, kind)]}
        key = (ns, kind, parts[2] if len(parts) > 2 else body["name"])
        path = s.tables.get(key)
        if self.command == "POST":
            if kind == "tables":
                if path is None:
                    assert body["requirements"] == [{"type": "assert-create"}]
                    made = changes.apply(TableMetadata("", "", {}, 0, {}, 0, sort_orders={}), body["updates"]).to_json()
                else:
                    meta = parse(s.storage.read(path))
                    changes.check(meta, body["requirements"])
                    made = changes.apply(meta, body["updates"]).to_json()
            elif path is None:
                v = body["view-version"]
                made = json.dumps({"view-uuid": str(uuid.uuid4()), "format-version": 1, "location": body["location"], "schemas": [body["schema"]], "versions": [v], "current-version-id": v["version-id"], "version-log": [{"timestamp-ms": v["timestamp-ms"], "version-id": v["version-id"]}], "properties": body["properties"]})
            else:
                d = json.loads(s.storage.read(path))
                assert body["requirements"] == [{"type": "assert-view-uuid", "uuid": d["view-uuid"]}]
                for c in body["updates"]:
                    if c["action"] == "add-schema":
                        d["schemas"].append(c["schema"])
                    elif c["action"] == "add-view-version":
                        d["versions"].append(c["view-version"])
                    elif c["action"] == "set-current-view-version":
                        d["current-version-id"] = c["view-version-id"]
                    else:
                        d["properties"].update(c["updates"])
                made = json.dumps(d)
            s.tables[key] = f"{s.root}/meta/{uuid.uuid4().hex}.json"
            s.storage.create(s.tables[key], made)
            path = s.tables[key]
        elif path is None:
            return 404, {}
        elif self.command == "DELETE":
            del s.tables[key]
            return 204, None
        return 200, {"metadata-location": path, "metadata": json.loads(s.storage.read(path))}


class Glue(Handler):
    def answer(self, raw):
        s, body = self.server, json.loads(raw)
        action = self.headers["X-Amz-Target"].removeprefix("AWSGlue.")
        assert self.headers["Authorization"].startswith("AWS4-HMAC-SHA256 Credential=AK/")
        if action in ("CreateDatabase", "UpdateDatabase"):
            d = body["DatabaseInput"]
            if action == "CreateDatabase" and d["Name"] in s.namespaces:
                return 400, {"__type": "AlreadyExistsException"}
            s.namespaces[d["Name"]] = d
            return 200, {}
        if action == "GetDatabases":
            return 200, {"DatabaseList": list(s.namespaces.values())}
        name = body.get("Name") if "Database" in action else body["DatabaseName"]
        if name not in s.namespaces:
            return 400, {"__type": "com.amazonaws.glue#EntityNotFoundException"}
        if action == "GetDatabase":
            return 200, {"Database": s.namespaces[name]}
        if action == "DeleteDatabase":
            del s.namespaces[name]
            return 200, {}
        if action == "GetTables":
            return 200, {"TableList": [t for k, t in s.tables.items() if k[0] == name]}
        key = (name, body["TableInput"]["Name"] if "TableInput" in body else body["Name"])
        have = s.tables.get(key)
        if action == "CreateTable":
            if have:
                return 400, {"__type": "AlreadyExistsException"}
            s.tables[key] = {**body["TableInput"], "VersionId": "0"}
            return 200, {}
        if have is None:
            return 400, {"__type": "EntityNotFoundException"}
        if action == "GetTable":
            return 200, {"Table": have}
        if action == "DeleteTable":
            del s.tables[key]
            return 200, {}
        if body["VersionId"] != have["VersionId"]:
            return 400, {"__type": "ConcurrentModificationException"}
        s.tables[key] = {**body["TableInput"], "VersionId": str(int(have["VersionId"]) + 1)}
        return 200, {}


SIGNER = aws_signer("AK", "secret", "eu-west-1", "glue")


@pytest.fixture(params=["rest", "glue"])
def catalog(spark, request):
    root = new_warehouse(spark)
    server = Server(Rest if request.param == "rest" else Glue, Storage(spark), root)
    if request.param == "rest":
        yield RestCatalog(spark, server.url, "wh", root, credential="id:secret")
    else:
        yield GlueCatalog(spark, server.url, root, SIGNER)
    server.shutdown()


def test_remote_catalog(spark, catalog):
    s = LakeSession(spark, catalog)
    with pytest.raises(Exists):
        catalog.create_namespace("public")
    catalog.create_namespace("other", {"a": "1"})
    catalog.update_namespace("other", {"b": "2"})
    assert catalog.namespaces() == ["other", "public"] and catalog.namespace_properties("other") == {"a": "1", "b": "2"}
    s.sql('CREATE TABLE t (id BIGINT NOT NULL, day DATE, v INT) PARTITIONED BY ("month(day)")')
    with pytest.raises(Exists):
        s.sql("CREATE TABLE t (id BIGINT)")
    s.sql("INSERT INTO t VALUES (1, DATE'2020-01-01', 5), (2, DATE'2020-02-01', 6)")
    s.sql("INSERT INTO t VALUES (3, NULL, 7)")
    s.sql("DELETE FROM t WHERE id = 1")
    s.sql("ALTER TABLE t ADD COLUMNS (w STRING)")
    s.sql("ALTER TABLE t CREATE TAG one")
    s.sql("ALTER TABLE t SET TBLPROPERTIES (k = 'v')")
    s.sql("ALTER TABLE t SET PARTITIONING (bucket(2, id))")
    s.sql("INSERT INTO t VALUES (4, DATE'2020-02-02', 8, 'x')")
    s.table("t").set_sort_order([("id", "desc")])
    assert sorted((r.id, r.v, r.w) for r in s.sql("SELECT * FROM t").collect()) == [(2, 6, None), (3, 7, None), (4, 8, "x")]
    assert s.sql("SELECT * FROM t VERSION AS OF 'one'").count() == 2
    s.sql("CREATE VIEW w AS SELECT id + 1 AS n FROM t")
    s.sql("CREATE OR REPLACE VIEW w AS SELECT id + 2 AS n FROM t")
    assert sorted(r.n for r in s.sql("SELECT * FROM w").collect()) == [4, 5, 6]
    s.sql("CREATE MATERIALIZED VIEW m AS SELECT v % 2 AS k, count(*) AS n FROM t GROUP BY v % 2")
    assert s.refresh("m") == "full"
    s.sql("INSERT INTO t VALUES (5, NULL, 9, NULL)")
    assert s.refresh("m") in ("incremental", "full") and s.refresh("m") == "fresh"
    assert sorted(map(tuple, s.sql("SELECT * FROM m").collect())) == [(0, 2), (1, 2)]
    assert {"public.t", "public.w", "public.m"} <= set(catalog.tabulars("public"))
    with pytest.raises(Exists):
        catalog.drop_namespace("public")
    catalog.register("other.again", catalog.pointer("public.t"))
    assert catalog.load("other.again")[0] == s.table("t").metadata
    s.sql("DROP TABLE other.again")
    with pytest.raises(NoSuch):
        s.sql("DROP TABLE other.again")
    catalog.drop_namespace("other")
    assert catalog.namespaces() == ["public"] and not catalog.namespace_exists("other")


def test_two_writers_of_a_remote_table(spark, catalog):
    t = LakeSession(spark, catalog).create_table("t", T.StructType([T.StructField("a", T.LongType())]))
    meta, path = catalog.load("public.t")
    t.append(spark.createDataFrame([(1,)], "a long"))
    with pytest.raises(CommitConflict):
        catalog.swap("public.t", path, meta)
    base = t.metadata
    t.append(spark.createDataFrame([(2,)], "a long"))
    with pytest.raises(CommitConflict):
        t.append(spark.createDataFrame([(3,)], "a long"), base=base)
    assert sorted(r.a for r in t.df().collect()) == [1, 2]


def test_requirements_and_updates():
    schema = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType())])
    a = TableMetadata.new("/x", schema, [], {"k": "v", "old": "1"})
    more = T.StructType([*a.schema().fields, T.StructField("c", T.DecimalType(9, 2), True, {"parquet.field.id": 3})])
    b = TableMetadata(**{**a.__dict__, "schemas": {**a.schemas, 1: more}, "current_schema": 1, "properties": {"k": "w"}, "sort_orders": {0: (), 1: (("a", "asc"),)}, "default_sort_order": 1})
    assert changes.apply(a, changes.updates(a, b)) == b and changes.updates(b, b) == []
    for want in changes.requirements(a):
        changes.check(a, [want])
    failing = [w["type"] for w in changes.requirements(a) if _conflicts(b, w)]
    assert failing == ["assert-current-schema-id", "assert-last-assigned-field-id", "assert-default-sort-order-id"]
    with pytest.raises(CommitConflict):
        changes.check(a, [{"type": "assert-create"}])
    with pytest.raises(CommitConflict):
        changes.check(a, [{"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": 7}])


def _conflicts(meta, want):
    try:
        changes.check(meta, [want])
        return False
    except CommitConflict:
        return True


ROW = {"type": "record", "name": "r", "fields": [
    {"name": "i", "type": "int"}, {"name": "l", "type": ["null", "long"]}, {"name": "s", "type": "string"}, {"name": "b", "type": "bytes"}, {"name": "d", "type": "double"}, {"name": "t", "type": "boolean"},
    {"name": "a", "type": ["null", {"type": "array", "items": {"type": "record", "name": "x", "fields": [{"name": "k", "type": "int"}]}}]}, {"name": "m", "type": {"type": "map", "values": "long"}},
]}


@settings(max_examples=30, deadline=None)
@given(some.lists(some.fixed_dictionaries({
    "i": some.integers(-(2**31), 2**31 - 1), "l": some.none() | some.integers(-(2**63), 2**63 - 1), "s": some.text(max_size=9), "b": some.binary(max_size=9), "d": some.floats(allow_nan=False), "t": some.booleans(),
    "a": some.none() | some.lists(some.fixed_dictionaries({"k": some.integers(-9, 9)}), max_size=3), "m": some.dictionaries(some.text(max_size=3), some.integers(0, 9), max_size=3),
}), max_size=20))
def test_avro_round_trip(rows):
    got, meta = avro.read(avro.write(ROW, rows, {"k": "v"}))
    assert got == rows and meta["k"] == "v"


@pytest.mark.parametrize("kind, values", [
    ("boolean", [True, False]), ("int", [0, -5, 2**31 - 1]), ("long", [-(2**63), 7]), ("double", [1.5, -0.0]), ("date", [dt.date(1969, 5, 1), dt.date(2020, 2, 29)]),
    ("timestamptz", [dt.datetime(1969, 12, 31, 23, 59, 59, 1), dt.datetime(2020, 1, 1, 1, 2, 3, 456789)]), ("string", ["", "é"]), ("binary", [b"", b"\x00\xff"]),
    ("decimal(12, 3)", [Decimal("0.000"), Decimal("-128.000"), Decimal("123456789.125")]),
])
def test_single_values(kind, values):
    for v in values:
        assert from_bytes(to_bytes(v, kind), kind) == v


def test_schema_round_trip(spark):
    s = T.StructType.fromDDL("a TINYINT NOT NULL, b VARCHAR(5), c DECIMAL(10,2), d ARRAY<STRUCT<x: INT>>, e MAP<STRING, TIMESTAMP>, f TIMESTAMP_NTZ, g BINARY")
    with_ids = TableMetadata.new("/x", s).schema()
    assert schema_of(json.loads(json.dumps(schema_json(with_ids)))) == with_ids


def test_manifests_read_by_the_public_library(spark):
    """The JVM's own Avro reader takes manifests and lists."""
    s = LakeSession(spark)
    s.sql("CREATE TABLE t (id BIGINT, day DATE, name STRING, price DECIMAL(8,2)) PARTITIONED BY (day, truncate(name, 2))")
    s.sql("INSERT INTO t VALUES (1, DATE'2020-01-01', 'abc', 1.5), (2, NULL, NULL, NULL)")
    t = s.table("t")
    snapshot = t.metadata.snapshot()
    rows = {}
    for name, path in (("list", snapshot.manifest_list), ("manifest", t.manifests(t.metadata, snapshot)[0]["path"])):
        jvm = spark._jvm
        reader = jvm.org.apache.avro.file.DataFileReader(jvm.java.io.File(local_path(path)), jvm.org.apache.avro.generic.GenericDatumReader())
        rows[name] = []
        while reader.hasNext():
            rows[name].append(json.loads(reader.next().toString().encode("utf-8", "replace").decode("utf-8")) if name == "list" else reader.next().get("data_file").get("record_count"))
    assert rows["list"][0]["added_rows_count"] == 2 and sum(rows["manifest"]) == 2
    files = M.read_manifest(t.storage, t.manifests(t.metadata, snapshot)[0]["path"])
    assert sorted(f.partition for f in files if f.partition[0]) == [(dt.date(2020, 1, 1), "ab")]
    assert next(f for f in files if f.partition[0]).upper == {"id": 1, "day": dt.date(2020, 1, 1), "name": "abc", "price": Decimal("1.50")}
