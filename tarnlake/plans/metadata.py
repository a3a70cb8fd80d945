"""Table and view metadata: immutable records with a JSON form; every change makes a new version."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from tarnlake.functions.transforms import Transform, field_name
from tarnlake.plans.types import schema_json, schema_of

FIELD_ID = "parquet.field.id"
MAIN = "main"


class CommitConflict(Exception):
    """Another writer was first, or a requirement of the commit does not hold."""


def now_ms() -> int:
    return int(time.time() * 1000)


# -- schema


def with_ids(schema: T.StructType, start: int = 1) -> T.StructType:
    """Pre-order field ids, kept where a field has one already."""
    used = [start - 1]

    def scan(t):
        if isinstance(t, T.StructType):
            for f in t.fields:
                used.append(f.metadata.get(FIELD_ID, 0) if f.metadata else 0)
                scan(f.dataType)
        elif isinstance(t, T.ArrayType):
            scan(t.elementType)
        elif isinstance(t, T.MapType):
            scan(t.keyType), scan(t.valueType)

    scan(schema)
    last = max(used)

    def walk(t):
        nonlocal last
        if isinstance(t, T.StructType):
            out = []
            for f in t.fields:
                meta = dict(f.metadata or {})
                if FIELD_ID not in meta:
                    last += 1
                    meta[FIELD_ID] = last
                out.append(T.StructField(f.name, walk(f.dataType), f.nullable, meta))
            return T.StructType(out)
        if isinstance(t, T.ArrayType):
            return T.ArrayType(walk(t.elementType), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(walk(t.keyType), walk(t.valueType), t.valueContainsNull)
        return t

    return walk(schema)


def last_id(schema: T.StructType) -> int:
    return max((int(x) for x in re.findall(rf'"{FIELD_ID}":(\d+)', schema.json().replace(" ", ""))), default=0)


# -- parts of the metadata


@dataclass(frozen=True)
class SpecField:
    source: str
    transform: str
    name: str
    field_id: int


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: int
    parent_id: int | None
    sequence_number: int
    timestamp_ms: int
    operation: str
    manifest_list: str  # path of the file that names its manifests
    schema_id: int
    summary: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Ref:
    snapshot_id: int
    kind: str = "branch"  # or tag
    max_age_ms: int | None = None


@dataclass(frozen=True)
class TableMetadata:
    uuid: str
    location: str
    schemas: dict  # id -> StructType
    current_schema: int
    specs: dict  # id -> tuple of SpecField
    default_spec: int
    last_sequence_number: int = 0
    last_updated_ms: int = 0
    snapshots: dict = field(default_factory=dict)
    log: tuple = ()
    refs: dict = field(default_factory=dict)
    properties: dict = field(default_factory=dict)
    sort_orders: dict = field(default_factory=lambda: {0: ()})
    default_sort_order: int = 0
    format_version: int = 2
    kind: str = "table"

    @staticmethod
    def new(location: str, schema: T.StructType, spec: list[tuple[str, Transform]] = (), properties: dict | None = None) -> TableMetadata:
        names = set()
        fields = []
        for i, (col, t) in enumerate(spec):
            if col not in schema.fieldNames():
                raise ValueError(f"no column {col!r} to partition by")
            name = field_name(col, t)
            if name in names:
                raise ValueError(f"two partition fields {name!r}")
            names.add(name)
            fields.append(SpecField(col, str(t), name, 1000 + i))
        return TableMetadata(str(uuid.uuid4()), location, {0: with_ids(schema)}, 0, {0: tuple(fields)}, 0, last_updated_ms=now_ms(), properties=dict(properties or {}))

    def snapshot(self, ref: str | None = None, snapshot_id: int | None = None) -> Snapshot | None:
        """Of an id, or of a branch or tag; a branch that is missing reads main."""
        if snapshot_id is not None:
            if snapshot_id not in self.snapshots:
                raise KeyError(f"no snapshot {snapshot_id}")
            return self.snapshots[snapshot_id]
        r = self.refs.get(ref or MAIN) or self.refs.get(MAIN)
        return self.snapshots[r.snapshot_id] if r else None

    def as_of(self, timestamp_ms: int) -> Snapshot | None:
        """The snapshot that main had then."""
        found = [i for ts, i in self.log if ts <= timestamp_ms]
        return self.snapshots[found[-1]] if found else None

    def schema(self, snapshot: Snapshot | None = None) -> T.StructType:
        """The current schema, or the one a snapshot was written with."""
        return self.schemas[self.current_schema if snapshot is None else snapshot.schema_id]

    @property
    def spec(self) -> tuple:
        return self.specs[self.default_spec]

    def with_snapshot(self, s: Snapshot, ref: str) -> TableMetadata:
        refs = {**self.refs, ref: Ref(s.snapshot_id)}
        log = (*self.log, (s.timestamp_ms, s.snapshot_id)) if ref == MAIN else self.log
        return replace(self, snapshots={**self.snapshots, s.snapshot_id: s}, refs=refs, log=log, last_sequence_number=s.sequence_number, last_updated_ms=s.timestamp_ms)

    def type_of(self, column: str) -> T.DataType:
        """Of a column of the current schema, or of the latest that had it."""
        return self._field(lambda f: f.name == column, column).dataType

    def _field(self, test, what) -> T.StructField:
        order = [self.schemas[self.current_schema], *[self.schemas[k] for k in sorted(self.schemas, reverse=True)]]
        for s in order:
            for f in s.fields:
                if test(f):
                    return f
        raise ValueError(f"no column {what!r}")

    def id_of(self, column: str) -> int:
        return int(self._field(lambda f: f.name == column, column).metadata[FIELD_ID])

    def to_json(self) -> str:
        """The public table format, version 2."""
        schemas = [schema_json(v, k) for k, v in self.schemas.items()]
        ids = [int(x) for x in re.findall(r'"(?:id|element-id|key-id|value-id)": (\d+)', json.dumps(schemas))]
        current = self.refs.get(MAIN)
        snapshots = []
        for s in self.snapshots.values():
            d = {
                "snapshot-id": s.snapshot_id, "parent-snapshot-id": s.parent_id, "sequence-number": s.sequence_number, "timestamp-ms": s.timestamp_ms,
                "manifest-list": s.manifest_list, "summary": {"operation": s.operation, **s.summary}, "schema-id": s.schema_id,
            }
            snapshots.append({k: v for k, v in d.items() if v is not None})
        order = lambda k, v: {"order-id": k, "fields": [{"transform": "identity", "source-id": self.id_of(c), "direction": d, "null-order": "nulls-first" if d == "asc" else "nulls-last"} for c, d in v]}
        return json.dumps({
            "format-version": self.format_version, "table-uuid": self.uuid, "location": self.location, "last-sequence-number": self.last_sequence_number,
            "last-updated-ms": self.last_updated_ms, "last-column-id": max(ids, default=0), "schemas": schemas, "current-schema-id": self.current_schema,
            "partition-specs": [{"spec-id": k, "fields": [{"source-id": self.id_of(f.source), "field-id": f.field_id, "name": f.name, "transform": f.transform} for f in v]} for k, v in self.specs.items()],
            "default-spec-id": self.default_spec, "last-partition-id": max((f.field_id for v in self.specs.values() for f in v), default=999),
            "properties": self.properties, "current-snapshot-id": current.snapshot_id if current else -1, "snapshots": snapshots,
            "snapshot-log": [{"timestamp-ms": t, "snapshot-id": i} for t, i in self.log], "metadata-log": [],
            "sort-orders": [order(k, v) for k, v in self.sort_orders.items()], "default-sort-order-id": self.default_sort_order,
            "refs": {k: {"snapshot-id": r.snapshot_id, "type": r.kind, **({"max-ref-age-ms": r.max_age_ms} if r.max_age_ms is not None else {})} for k, r in self.refs.items()},
        }, indent=1)

    @staticmethod
    def from_json(text: str) -> TableMetadata:
        d = json.loads(text)
        missing = {"table-uuid", "location", "schemas", "current-schema-id", "partition-specs", "default-spec-id"} - set(d)
        if missing:
            raise ValueError(f"metadata without {sorted(missing)}")
        if d.get("format-version") not in (1, 2):
            raise ValueError(f"format version {d.get('format-version')!r}")
        schemas = {s["schema-id"]: schema_of(s) for s in d["schemas"]}
        if d["current-schema-id"] not in schemas or d["default-spec-id"] not in {s["spec-id"] for s in d["partition-specs"]}:
            raise ValueError("the current schema or default spec is missing")
        names = {}
        for k in [*sorted(schemas), d["current-schema-id"]]:  # the current name of an id wins
            names.update({int(f.metadata[FIELD_ID]): f.name for f in schemas[k].fields})
        specs = {s["spec-id"]: tuple(SpecField(names[f["source-id"]], f["transform"], f["name"], f["field-id"]) for f in s["fields"]) for s in d["partition-specs"]}
        snapshots = {}
        for s in d.get("snapshots", []):
            summary = dict(s.get("summary", {}))
            operation = summary.pop("operation", "append")
            snapshots[s["snapshot-id"]] = Snapshot(s["snapshot-id"], s.get("parent-snapshot-id"), s.get("sequence-number", 0), s["timestamp-ms"], operation, s["manifest-list"], s.get("schema-id", d["current-schema-id"]), summary)
        orders = {o["order-id"]: tuple((names[f["source-id"]], f["direction"]) for f in o["fields"]) for o in d.get("sort-orders", [{"order-id": 0, "fields": []}])}
        refs = {k: Ref(r["snapshot-id"], r["type"], r.get("max-ref-age-ms")) for k, r in d.get("refs", {}).items()}
        if not refs and d.get("current-snapshot-id", -1) not in (-1, None):
            refs = {MAIN: Ref(d["current-snapshot-id"])}
        return TableMetadata(
            d["table-uuid"], d["location"], schemas, d["current-schema-id"], specs, d["default-spec-id"], d.get("last-sequence-number", 0), d.get("last-updated-ms", 0), snapshots,
            tuple((x["timestamp-ms"], x["snapshot-id"]) for x in d.get("snapshot-log", [])), refs, d.get("properties", {}), orders, d.get("default-sort-order-id", 0), d["format-version"],
        )


def _without_ids(j):
    """A schema's JSON without field metadata, at any depth."""
    if isinstance(j, dict):
        return {k: {} if k == "metadata" else _without_ids(v) for k, v in j.items()}
    return [_without_ids(x) for x in j] if isinstance(j, list) else j


@dataclass(frozen=True)
class ViewVersion:
    version_id: int
    sql: str
    schema: dict
    timestamp_ms: int
    default_namespace: str
    storage_table: str | None = None


@dataclass(frozen=True)
class ViewMetadata:
    """A view, or with storage tables in its versions a materialized view."""

    uuid: str
    location: str
    versions: dict  # id -> ViewVersion
    current_version: int
    log: tuple = ()
    properties: dict = field(default_factory=dict)
    kind: str = "view"

    @staticmethod
    def new(location: str, sql: str, schema: T.StructType, namespace: str, storage: str | None = None) -> ViewMetadata:
        v = ViewVersion(1, sql, schema.jsonValue(), now_ms(), namespace, storage)
        return ViewMetadata(str(uuid.uuid4()), location, {1: v}, 1, ((v.timestamp_ms, 1),), {}, "materialized view" if storage else "view")

    def version(self, branch: str | None = None) -> ViewVersion:
        """Of property ref-<branch>, else the current one."""
        own = self.properties.get(f"ref-{branch}") if branch else None
        return self.versions[int(own) if own else self.current_version]

    def with_version(self, sql: str, schema: T.StructType, branch: str = MAIN) -> ViewMetadata:
        """A new representation; only main moves the current version."""
        n = max(self.versions) + 1
        old = self.version(branch)
        v = ViewVersion(n, sql, schema.jsonValue(), now_ms(), old.default_namespace, old.storage_table)
        return replace(
            self, versions={**self.versions, n: v}, current_version=n if branch == MAIN else self.current_version,
            log=(*self.log, (v.timestamp_ms, n)), properties={**self.properties, f"ref-{branch}": str(n)},
        )

    def to_json(self) -> str:
        """The public view format; a materialized view's versions name a storage table besides."""
        versions, schemas = [], []
        for v in self.versions.values():
            schemas.append(schema_json(with_ids(T.StructType.fromJson(v.schema)), v.version_id))
            versions.append({
                "version-id": v.version_id, "timestamp-ms": v.timestamp_ms, "schema-id": v.version_id, "summary": {}, "default-namespace": v.default_namespace.split("."),
                "representations": [{"type": "sql", "sql": v.sql, "dialect": "spark"}], **({"storage-table": v.storage_table} if v.storage_table else {}),
            })
        return json.dumps({
            "view-uuid": self.uuid, "format-version": 1, "location": self.location, "schemas": schemas, "versions": versions, "current-version-id": self.current_version,
            "version-log": [{"timestamp-ms": t, "version-id": i} for t, i in self.log], "properties": self.properties,
        }, indent=1)

    @staticmethod
    def from_json(text: str) -> ViewMetadata:
        d = json.loads(text)
        schemas, versions = {s["schema-id"]: schema_of(s) for s in d["schemas"]}, {}
        for v in d["versions"]:
            plain = T.StructType.fromJson(_without_ids(schemas[v["schema-id"]].jsonValue()))
            sql = next(r["sql"] for r in v["representations"] if r["type"] == "sql")
            versions[v["version-id"]] = ViewVersion(v["version-id"], sql, plain.jsonValue(), v["timestamp-ms"], ".".join(v["default-namespace"]), v.get("storage-table"))
        kind = "materialized view" if any(v.storage_table for v in versions.values()) else "view"
        return ViewMetadata(d["view-uuid"], d["location"], versions, d["current-version-id"], tuple((x["timestamp-ms"], x["version-id"]) for x in d["version-log"]), d.get("properties", {}), kind)


def parse(text: str) -> TableMetadata | ViewMetadata:
    return (ViewMetadata if "versions" in json.loads(text) else TableMetadata).from_json(text)
