"""Lake tables: snapshots of Parquet files, read as plain DataFrames and changed by optimistic commits."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable
from dataclasses import replace as changed
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.transforms import Transform, parse_field
from tarnlake.operators import manifest as M
from tarnlake.plans.metadata import FIELD_ID, MAIN, CommitConflict, Ref, Snapshot, SpecField, TableMetadata, now_ms, with_ids
from tarnlake.plans.predicates import Predicate
from tarnlake.sources.catalog import Catalog

_PART = "_part_"
#: Delete rows up to which a scan asks for a broadcast; beyond that the join is planned like any other.
BROADCAST_DELETES = 1_000_000
#: Files of one scan up to which their sequence numbers are broadcast.
BROADCAST_FILES = 100_000
#: Size at which a data file ends, unless the table says otherwise.
TARGET_BYTES = 512 << 20
_TIMES = "spark.sql.parquet.outputTimestampType"


def _new_id() -> int:
    return uuid.uuid4().int >> 65


class LakeTable:
    def __init__(self, catalog: Catalog, identifier: str, branch: str | None = None):
        self.catalog, self.identifier, self.branch = catalog, identifier, branch
        self.spark, self.storage = catalog.spark, catalog.storage

    @staticmethod
    def create(catalog: Catalog, identifier: str, schema: T.StructType, partition_by: Iterable[str] = (), properties: dict | None = None, location: str | None = None) -> LakeTable:
        spec = [parse_field(p) for p in partition_by]
        for col, t in spec:
            t.column(F.lit(None), schema[col].dataType)  # raises for types the transform does not take
        catalog.create(identifier, TableMetadata.new(location or catalog.location(identifier), schema, spec, properties))
        return LakeTable(catalog, identifier)

    @property
    def metadata(self) -> TableMetadata:
        return self.catalog.load(self.identifier)[0]

    def on(self, branch: str) -> LakeTable:
        """The same table, bound to a branch."""
        return LakeTable(self.catalog, self.identifier, branch)

    # -- reading

    def manifests(self, meta: TableMetadata, snapshot: Snapshot | None, after: int = 0) -> list[dict]:
        """What the snapshot's list says of each manifest that may hold greater sequence numbers."""
        if snapshot is None:
            return []
        return [m for m in M.read_list(self.storage, meta, snapshot.manifest_list) if m["sequence_number"] > after]

    def files(self, predicate: Predicate | None = None, ref: str | None = None, snapshot_id: int | None = None, after: int = 0, meta: TableMetadata | None = None) -> list[M.DataFile]:
        """Live files of a snapshot that the predicate may concern; ``after``: only with greater sequence numbers."""
        meta = meta or self.metadata
        snapshot = meta.snapshot(ref or self.branch, snapshot_id)
        schema = meta.schema(snapshot) if snapshot_id is not None else meta.schema()
        out = []
        for m in self.manifests(meta, snapshot, after):
            spec = meta.specs[m["spec_id"]]
            if not m["deletes"] and not M.manifest_may_hold(m, spec, schema, predicate):
                continue
            for f in M.read_manifest(self.storage, m["path"]):
                if f.status == M.DELETED or f.sequence_number <= after:
                    continue
                if f.content != M.DATA or M.file_may_hold(f, meta.specs[f.spec_id], schema, predicate):
                    out.append(f)
        return out

    def df(self, predicate: Predicate | None = None, columns: list[str] | None = None, ref: str | None = None, snapshot_id: int | None = None, as_of_ms: int | None = None, after_snapshot: int | None = None, limit: int | None = None, meta: TableMetadata | None = None) -> DataFrame:
        """The rows of a snapshot, branch or tag, or of a range of snapshots.

        The predicate prunes manifests and files, and filters rows above the
        deletes; Parquet gets it too.  ``after_snapshot`` reads what was appended
        since that snapshot.  A limit stays above the deletes.  ``meta`` is a state
        of the table read before; else the current one is read.
        """
        meta = meta or self.metadata
        if as_of_ms is not None:
            s = meta.as_of(as_of_ms)
            if s is None:
                return self._empty(meta.schema(), columns)
            snapshot_id = s.snapshot_id
        snapshot = meta.snapshot(ref or self.branch, snapshot_id)
        schema = meta.schema(snapshot) if snapshot_id is not None else meta.schema()
        after = meta.snapshots[after_snapshot].sequence_number if after_snapshot is not None else 0
        files = self.files(predicate, ref, snapshot_id, after, meta)
        data, deletes = [f for f in files if f.content == M.DATA], [f for f in files if f.content == M.EQUALITY_DELETES]
        out = self._read(meta, schema, data, deletes, columns, predicate)
        if predicate is not None:
            out = out.where(predicate.to_column())
        out = out.select(*[F.col(f"`{c}`") for c in columns or schema.fieldNames()])
        return out.limit(limit) if limit is not None else out

    def _empty(self, schema: T.StructType, columns: list[str] | None) -> DataFrame:
        df = self.spark.createDataFrame([], schema)
        return df.select(*columns) if columns else df

    def _parquet(self, schema: T.StructType, files: list[M.DataFile]) -> DataFrame:
        """By field id, so renamed columns are found and added ones read as null."""
        self.spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        nullable = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])
        if not files:
            return self.spark.createDataFrame([], nullable)
        return self.spark.read.schema(nullable).parquet(*[f.path for f in files])

    def _read(self, meta: TableMetadata, schema: T.StructType, data: list[M.DataFile], deletes: list[M.DataFile], columns: list[str] | None, predicate: Predicate | None) -> DataFrame:
        """Merge on read: rows of older files lose those an equality delete of their partition names."""
        hit = [f for f in data if any(_concerns(d, f) for d in deletes)]
        if not hit:
            return self._parquet(schema, data)
        names = set(f.path for f in hit)
        plain = [f for f in data if f.path not in names]
        rows = self._tagged(schema, hit)
        for keys in sorted({d.equality for d in deletes}):
            own = [d for d in deletes if d.equality == keys and any(_concerns(d, f) for f in hit)]
            if not own:
                continue
            key_schema = T.StructType([schema[k] for k in keys])
            gone = self._tagged(key_schema, own).select(*[F.col(f"`{k}`").alias(f"_d{i}") for i, k in enumerate(keys)], F.col("_seq").alias("_dseq"), F.col("_tuple").alias("_dtuple"))
            if sum(d.rows for d in own) <= BROADCAST_DELETES:
                gone = F.broadcast(gone)
            match = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_d{i}")) for i, k in enumerate(keys)])
            rows = rows.join(gone, match & (F.col("_seq") < F.col("_dseq")) & ((F.col("_dtuple") == "") | (F.col("_tuple") == F.col("_dtuple"))), "left_anti")
        rows = rows.drop("_seq", "_tuple")
        return rows.unionByName(self._parquet(schema, plain)) if plain else rows

    def _tagged(self, schema: T.StructType, files: list[M.DataFile]) -> DataFrame:
        """Rows with the sequence number and partition of their file."""
        kinds = sorted({(f.sequence_number, _tuple(f)) for f in files})
        if len(kinds) <= 16:
            parts = [self._parquet(schema, [f for f in files if (f.sequence_number, _tuple(f)) == k]).withColumn("_seq", F.lit(k[0]).cast("long")).withColumn("_tuple", F.lit(k[1])) for k in kinds]
            return reduce(lambda a, b: a.unionByName(b), parts)
        tags = self.spark.createDataFrame([(f.path, f.sequence_number, _tuple(f)) for f in files], "_path string, _seq long, _tuple string")
        if len(files) <= BROADCAST_FILES:
            tags = F.broadcast(tags)
        path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///"), F.lit("+"), F.lit("%2B")))
        return self._parquet(schema, files).withColumn("_path", path).join(tags, "_path").drop("_path")

    def statistics(self, ref: str | None = None) -> DataFrame:
        """A row per column: rows, bytes, nulls and bounds as text, folded over live data files."""
        files = [f for f in self.files(ref=ref) if f.content == M.DATA]
        rows, size, out = sum(f.rows for f in files), sum(f.bytes for f in files), []
        for c in self.metadata.schema().fieldNames():
            low = [f.lower[c] for f in files if c in f.lower]
            up = [f.upper[c] for f in files if c in f.upper]
            whole = len(low) == len([f for f in files if f.nulls.get(c, 0) < f.rows])
            out.append((c, rows, size, sum(f.nulls.get(c, 0) for f in files), str(min(low)) if low and whole else None, str(max(up)) if up and whole else None))
        return self.spark.createDataFrame(out, "column_name string, rows long, bytes long, nulls long, lower string, upper string")

    def snapshots(self) -> DataFrame:
        rows = [(s.snapshot_id, s.parent_id, s.sequence_number, s.timestamp_ms, s.operation, s.schema_id) for s in self.metadata.snapshots.values()]
        return self.spark.createDataFrame(rows, "snapshot_id long, parent_id long, sequence_number long, timestamp_ms long, operation string, schema_id int")

    # -- writing

    def _write(self, df: DataFrame, schema: T.StructType, meta: TableMetadata, content: int, equality: tuple = ()) -> list[M.DataFile]:
        """New files in a fresh folder; a commit that fails leaves only orphans."""
        spec, props, name = meta.spec, meta.properties, uuid.uuid4().hex
        base = props.get("write.data.path", f"{meta.location}/data")
        if props.get("write.object-storage.enabled", "").lower() == "true":  # spread commits over prefixes of an object store
            digest = hashlib.blake2b(name.encode(), digest_size=4).hexdigest()
            base = f"{base}/{digest[:2]}/{digest[2:4]}/{digest[4:]}"
        folder = f"{base}/{name}"
        self.spark.conf.set("spark.sql.parquet.fieldId.write.enabled", "true")
        source = {f.name: f.dataType for f in meta.schema().fields}
        present = all(f.source in df.columns for f in spec)
        if spec and present:
            parts = []
            for i, f in enumerate(spec):
                t = Transform.parse(f.transform)
                value = t.column(F.col(f"`{f.source}`"), source[f.source])
                parts.append(M.folder_value(value, t.result_type(source[f.source])).alias(f"{_PART}{i}"))
            names = [f"{_PART}{i}" for i in range(len(spec))]
            df = df.select("*", *parts)
            # Dealt by partition, so that each is written in few files; the adaptive planner splits a large one.
            df = df.hint("rebalance", *names)
            writer = df.write.partitionBy(*names)
        else:
            spec, writer = (), df.write
        order = meta.sort_orders.get(meta.default_sort_order, ())
        if order and not spec:
            writer = df.sortWithinPartitions(*[F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order]).write
        options = {"compression": props.get("write.parquet.compression-codec", "zstd"), "maxRecordsPerFile": self._rows_per_file(df.schema, meta)}
        if "write.parquet.compression-level" in props:
            options["parquet.compression.codec.zstd.level"] = props["write.parquet.compression-level"]
        if "write.parquet.row-group-size-bytes" in props:
            options["parquet.block.size"] = props["write.parquet.row-group-size-bytes"]
        kept = self.spark.conf.get(_TIMES)
        self.spark.conf.set(_TIMES, "TIMESTAMP_MICROS")  # the older form has no statistics
        try:
            writer.options(**options).parquet(folder)
        finally:
            self.spark.conf.set(_TIMES, kept)
        found = M.harvest(self.spark, folder, schema, content, meta.default_spec, spec, meta.schema(), _PART, equality)
        return found

    def _rows_per_file(self, schema: T.StructType, meta: TableMetadata) -> int:
        """Where a file ends: at a number of rows, or at a target size by what a row takes in the table's files (or its types, at first)."""
        fixed = int(meta.properties.get("write.max-records-per-file", 0))
        if fixed:
            return fixed
        target = int(meta.properties.get("write.target-file-size-bytes", TARGET_BYTES))
        held = meta.snapshot(self.branch)
        rows, size = (int(held.summary.get(k, 0)) for k in ("total-records", "total-files-size")) if held else (0, 0)
        each = size / rows if rows and size else sum(_width(f.dataType) for f in schema.fields)
        return max(1, int(target / max(each, 1e-3)))

    def _conform(self, df: DataFrame, meta: TableMetadata) -> DataFrame:
        """Names and types must match; ids are put on; a required column may hold no null."""
        schema = meta.schema()
        if sorted(df.columns) != sorted(schema.fieldNames()):
            raise ValueError(f"columns {df.columns} for table columns {schema.fieldNames()}")
        cols = []
        for f in schema.fields:
            have, want = df.schema[f.name].dataType, f.dataType
            if have != want and not _widens(have, want):
                raise ValueError(f"{f.name}: {have.simpleString()} for {want.simpleString()}")
            c = F.col(f"`{f.name}`").cast(want)
            if not f.nullable and df.schema[f.name].nullable:
                c = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"null in required column {f.name}")).cast(want))
            cols.append(c.alias(f.name, metadata={FIELD_ID: f.metadata[FIELD_ID]}))
        return df.select(*cols)

    def append(self, df: DataFrame, deletes: DataFrame | None = None, on: Iterable[str] = (), summary: dict | None = None, retries: int = 3, base: TableMetadata | None = None, properties: dict | None = None) -> int:
        """Add rows, and with ``deletes`` equality deletes on columns ``on``, in one snapshot; returns the number of rows added.

        Deletes of a snapshot concern older rows only, so its own rows stay.
        A pure append that loses a race starts over, one with deletes does not, nor
        one that names the state ``base`` it was made from: it lands on that or raises
        CommitConflict.  ``properties`` are set in the same commit.
        """
        meta = base or self.metadata
        added = self._write(self._conform(df, meta), meta.schema(), meta, M.DATA)
        gone = self._delete_files(meta, deletes, tuple(on)) if deletes is not None else []
        self._commit(meta, added, gone, "append" if not gone else "overwrite", summary, retries if not gone and base is None else 0, properties)
        return sum(f.rows for f in added)

    def _delete_files(self, meta: TableMetadata, deletes: DataFrame, on: tuple) -> list[M.DataFile]:
        schema = meta.schema()
        keys = T.StructType([schema[k] for k in on])
        df = deletes.select(*[F.col(f"`{k}`").cast(schema[k].dataType).alias(k, metadata={FIELD_ID: schema[k].metadata[FIELD_ID]}) for k in on]).distinct()
        return self._write(df, keys, meta, M.EQUALITY_DELETES, on)

    def delete(self, keys: DataFrame, on: Iterable[str]) -> int:
        """Delete rows whose ``on`` columns equal a row of ``keys`` (null equals null); returns the number of delete rows."""
        meta = self.metadata
        gone = self._delete_files(meta, keys, tuple(on))
        if gone:
            self._commit(meta, [], gone, "delete", None, 0)
        return sum(f.rows for f in gone)

    def replace(self, df: DataFrame, summary: dict | None = None, base: TableMetadata | None = None) -> int:
        """Put new rows in place of all; older snapshots stay readable."""
        meta = base or self.metadata
        added = self._write(self._conform(df, meta), meta.schema(), meta, M.DATA)
        self._commit(meta, added, [], "replace", summary, 0)
        return sum(f.rows for f in added)

    def _commit(self, base: TableMetadata, added: list[M.DataFile], gone: list[M.DataFile], operation: str, summary: dict | None, retries: int, properties: dict | None = None) -> None:
        ref = self.branch or MAIN
        seen = base.refs.get(ref)

        def requires(meta: TableMetadata) -> None:
            if meta.uuid != base.uuid:
                raise CommitConflict(f"{self.identifier} is another table now")
            if meta.current_schema != base.current_schema or meta.default_spec != base.default_spec:
                raise CommitConflict(f"{self.identifier}: schema or partitioning changed")
            if not retries and meta.refs.get(ref) != seen:
                raise CommitConflict(f"{self.identifier}: {ref} moved")

        def change(meta: TableMetadata) -> TableMetadata:
            parent = meta.snapshot(ref)
            seq, sid = meta.last_sequence_number + 1, _new_id()
            stamp = lambda fs: [changed(f, sequence_number=seq, snapshot_id=sid) for f in fs]
            kept = self.manifests(meta, parent) if operation != "replace" else []
            new = [self._manifest(meta, part) for part in (stamp(added), stamp(gone)) if part]
            kept = self._gather(meta, kept, new)
            told = {**_totals(parent if operation != "replace" else None, added), **(summary or {})}
            s = Snapshot(sid, parent.snapshot_id if parent else None, seq, now_ms(), operation, M.write_list(self.storage, meta, sid, kept), meta.current_schema, told)
            return changed(meta.with_snapshot(s, ref), properties={**meta.properties, **(properties or {})})

        self.catalog.commit(self.identifier, change, retries, requires)

    def _manifest(self, meta: TableMetadata, files: list[M.DataFile]) -> dict:
        return M.write_manifest(self.storage, meta, files)

    def _gather(self, meta: TableMetadata, kept: list[dict], new: list[dict], least: int = 100, files: int = 100) -> list[dict]:
        """Rewrite many small manifests of a spec into few, clustered by partition; entries keep their sequence numbers."""
        least = int(meta.properties.get("commit.manifest.min-count-to-merge", least))
        small = [m for m in kept if m["files"] < files and not m["deletes"]]
        if len(small) < least:
            return kept + new
        entries = [changed(f, status=M.EXISTING) for m in small for f in M.read_manifest(self.storage, m["path"])]
        merged = []
        for spec in sorted({f.spec_id for f in entries}):
            own = sorted((f for f in entries if f.spec_id == spec), key=lambda f: ([(v is not None, str(type(v)), v) for v in f.partition], f.path))
            size = 4 + int(len(own) ** 0.5)  # files to a manifest
            merged += [self._manifest(meta, own[at : at + size]) for at in range(0, len(own), size)]
        return [m for m in kept if m not in small] + merged + new

    # -- other changes

    def add_schema(self, schema: T.StructType, make_current: bool = True) -> int:
        """Evolve: fields of known names keep their ids, new ones must be nullable."""
        made = {}

        def change(meta: TableMetadata) -> TableMetadata:
            old = {f.name: f for s in meta.schemas.values() for f in s.fields}
            fields = []
            for f in schema.fields:
                meta_of = dict(f.metadata or {})
                if FIELD_ID not in meta_of and f.name in old:
                    meta_of = dict(old[f.name].metadata)
                elif FIELD_ID not in meta_of and not f.nullable:
                    raise ValueError(f"new column {f.name} must be nullable")
                fields.append(T.StructField(f.name, f.dataType, f.nullable, meta_of))
            top = max(int(x.metadata[FIELD_ID]) for s in meta.schemas.values() for x in s.fields) + 1
            n = max(meta.schemas) + 1
            made["id"] = n
            return changed(meta, schemas={**meta.schemas, n: with_ids(T.StructType(fields), top)}, current_schema=n if make_current else meta.current_schema)

        self.catalog.commit(self.identifier, change, 3)
        return made["id"]

    def set_current_schema(self, schema_id: int) -> None:
        def change(meta: TableMetadata) -> TableMetadata:
            if schema_id not in meta.schemas:
                raise KeyError(f"no schema {schema_id}")
            return changed(meta, current_schema=schema_id)

        self.catalog.commit(self.identifier, change, 3)

    def rename_column(self, old: str, new: str) -> int:
        s = self.metadata.schema()
        return self.add_schema(T.StructType([T.StructField(new if f.name == old else f.name, f.dataType, f.nullable, f.metadata) for f in s.fields]))

    def set_partitioning(self, partition_by: Iterable[str]) -> None:
        """Later writes use the new spec; older files keep theirs."""

        def change(meta: TableMetadata) -> TableMetadata:
            n = max(meta.specs) + 1
            top = max((f.field_id for s in meta.specs.values() for f in s), default=999)
            made = TableMetadata.new(meta.location, meta.schema(), [parse_field(p) for p in partition_by]).spec
            fields = tuple(SpecField(f.source, f.transform, f.name, top + 1 + i) for i, f in enumerate(made))
            return changed(meta, specs={**meta.specs, n: fields}, default_spec=n)

        self.catalog.commit(self.identifier, change, 3)

    def set_sort_order(self, order: Iterable[tuple[str, str]]) -> None:
        def change(meta: TableMetadata) -> TableMetadata:
            n = max(meta.sort_orders) + 1
            return changed(meta, sort_orders={**meta.sort_orders, n: tuple(tuple(o) for o in order)}, default_sort_order=n)

        self.catalog.commit(self.identifier, change, 3)

    def set_properties(self, **properties: str | None) -> None:
        """None takes a property away."""
        self.catalog.commit(self.identifier, lambda m: changed(m, properties={k: v for k, v in {**m.properties, **properties}.items() if v is not None}), 3)

    def create_branch(self, name: str, from_ref: str = MAIN) -> LakeTable:
        self._ref(name, from_ref, None, "branch")
        return self.on(name)

    def create_tag(self, name: str, from_ref: str = MAIN, snapshot_id: int | None = None) -> None:
        self._ref(name, from_ref, snapshot_id, "tag")

    def _ref(self, name: str, from_ref: str, snapshot_id: int | None, kind: str) -> None:
        def change(meta: TableMetadata) -> TableMetadata:
            s = meta.snapshot(from_ref, snapshot_id)
            if s is None:
                raise KeyError(f"{from_ref} has no snapshot")
            if name in meta.refs:
                raise CommitConflict(f"{name} exists")
            return changed(meta, refs={**meta.refs, name: Ref(s.snapshot_id, kind)})

        self.catalog.commit(self.identifier, change, 3)

    def move_branch(self, name: str, snapshot_id: int) -> None:
        def change(meta: TableMetadata) -> TableMetadata:
            meta.snapshot(None, snapshot_id)
            if name in meta.refs and meta.refs[name].kind == "tag":
                raise ValueError(f"{name} is a tag")
            log = (*meta.log, (now_ms(), snapshot_id)) if name == MAIN else meta.log
            return changed(meta, refs={**meta.refs, name: Ref(snapshot_id)}, log=log)

        self.catalog.commit(self.identifier, change, 3)

    def drop_ref(self, name: str) -> None:
        self.catalog.commit(self.identifier, lambda m: changed(m, refs={k: v for k, v in m.refs.items() if k != name}), 3)

    def expire_snapshots(self, older_than_ms: int) -> int:
        """Forget old snapshots that no ref needs, and delete files no snapshot left names; returns how many files went."""
        before: dict = {}

        def change(meta: TableMetadata) -> TableMetadata:
            before["meta"] = meta
            held = {r.snapshot_id for r in meta.refs.values()}
            left = {i: s for i, s in meta.snapshots.items() if i in held or s.timestamp_ms >= older_than_ms}
            return changed(meta, snapshots=left, log=tuple(x for x in meta.log if x[1] in left))

        after = self.catalog.commit(self.identifier, change, 3)
        named = lambda meta: {m["path"] for s in meta.snapshots.values() for m in self.manifests(meta, s)}
        lists = {s.manifest_list for s in before["meta"].snapshots.values()} - {s.manifest_list for s in after.snapshots.values()}
        left = named(after)
        dead = named(before["meta"]) - left
        live = {f.path for p in left for f in M.read_manifest(self.storage, p)} if dead else set()
        gone = {f.path for p in dead for f in M.read_manifest(self.storage, p)} - live
        for p in [*gone, *dead, *lists]:
            self.storage.delete(p)
        return len(gone)

    def compact(self) -> int:
        """Rewrite all live rows without deletes; returns the number of rows."""
        return self.replace(self.df())


def _totals(parent: Snapshot | None, added: list[M.DataFile]) -> dict:
    """Rows and bytes of the data files after a commit, as text."""
    out = {}
    for k, n in (("total-records", sum(f.rows for f in added)), ("total-files-size", sum(f.bytes for f in added))):
        out[k] = str(int(parent.summary.get(k, 0) if parent else 0) + n)
    return out


def _width(t: T.DataType) -> int:
    """Bytes of a value, as planners guess them."""
    if isinstance(t, T.StructType):
        return sum(_width(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return 8 * _width(t.elementType)
    if isinstance(t, T.MapType):
        return 8 * (_width(t.keyType) + _width(t.valueType))
    return {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.DecimalType: 16, T.StringType: 20, T.BinaryType: 100}.get(type(t), 8)


def _tuple(f: M.DataFile) -> str:
    """A file's partition as text; empty without one."""
    return repr((f.spec_id, f.partition)) if f.partition else ""


def _concerns(d: M.DataFile, f: M.DataFile) -> bool:
    return f.sequence_number < d.sequence_number and (not d.partition or (d.spec_id, d.partition) == (f.spec_id, f.partition))


def _widens(have: T.DataType, want: T.DataType) -> bool:
    """Casts that lose nothing."""
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if type(have) in order and type(want) in order:
        return order.index(type(have)) <= order.index(type(want))
    if isinstance(have, T.NullType) or isinstance(have, T.FloatType) and isinstance(want, T.DoubleType):
        return True
    if isinstance(have, (T.StringType, T.VarcharType, T.CharType)) and isinstance(want, T.StringType):
        return True
    if isinstance(have, T.DecimalType) and isinstance(want, T.DecimalType):
        return have.scale <= want.scale and have.precision - have.scale <= want.precision - want.scale
    return isinstance(have, T.StructType | T.ArrayType | T.MapType) and have.simpleString() == want.simpleString()
