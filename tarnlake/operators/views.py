"""Views and materialized views with incremental refresh.

Let old(T) be a source at the last refresh, new(T) the rows since, and cur(T)
both.  For a query over sources in places 1..k that is linear in each of them,

    delta = sum over i of Q(cur, .., cur, new at place i, old, .., old)

so one term is the same SQL with a source bound to each place, planned by
Catalyst like any query; a source that is fresh has no term.  UNION ALL is
linear too: a term binds the places of other branches to nothing.  For GROUP BY
on top, terms are aggregated, merged with each other, then with the stored rows
of the same keys; touched stored rows go by an equality delete in the same
snapshot, which concerns older rows only.  Everything else is computed anew.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators.table import LakeTable
from tarnlake.plans import pushdown, sqltext
from tarnlake.plans.metadata import MAIN, CommitConflict, TableMetadata, ViewMetadata
from tarnlake.sources.catalog import Catalog

STATE = "refresh-state"


def bare(schema: T.StructType) -> T.StructType:
    """The schema without field ids and with every field nullable."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


@dataclass
class Source:
    """One table behind a view: its name, table and the snapshots before and now."""

    name: str
    table: LakeTable
    uuid: str
    now: int | None
    before: int | None = None  # None with ``seen``: the source had no snapshot yet
    seen: bool = False

    @property
    def fresh(self) -> bool:
        return self.seen and self.now == self.before


class Resolver:
    """Names to DataFrames for one session: default namespace and branch."""

    def __init__(self, catalog: Catalog, namespace: str = "public", branch: str | None = None):
        self.catalog, self.namespace, self.branch, self.spark = catalog, namespace, branch, catalog.spark
        self._views: list[str] = []

    def full(self, name: str) -> str:
        parts = name.split(".")
        if len(parts) > 2 and parts[0] == self.catalog.name:
            parts = parts[1:]
        return ".".join(parts) if len(parts) > 1 else f"{self.namespace}.{name}"

    def lookup(self, name: str):
        """(full name, metadata), or None for names the catalog does not have."""
        full = self.full(name)
        return (full, self.catalog.load(full)[0]) if self.catalog.exists(full) else None

    def inline(self, sql: str, branch: str | None, seen: tuple = ()) -> str:
        """The text with plain views replaced by their queries."""
        found = sqltext.occurrences(self.spark, sql)
        names, changed = [], False
        for o in found:
            got = self.lookup(o.name)
            if got and isinstance(got[1], ViewMetadata) and got[1].kind == "view":
                if got[0] in seen:
                    raise ValueError(f"view {got[0]} names itself")
                v = got[1].version(branch)
                inner = Resolver(self.catalog, v.default_namespace, branch).qualified(v.sql)
                names.append(f"({self.inline(inner, branch, (*seen, got[0]))})")
                changed = True
            else:
                names.append(sql[o.start : o.stop + 1][: sqltext._name_length(sql[o.start : o.stop + 1])])
        if not changed:
            return sql
        return sqltext.rebind(sql, found, names)

    def qualified(self, sql: str) -> str:
        """The text with catalog names in full, so that it means the same in any namespace."""
        found = sqltext.occurrences(self.spark, sql)
        names = [self.full(o.name) if self.lookup(o.name) else o.name for o in found]
        return sqltext.rebind(sql, found, names)

    def table(self, full: str, meta) -> LakeTable:
        """The table that holds a name's rows."""
        if isinstance(meta, TableMetadata):
            return LakeTable(self.catalog, full, self.branch)
        return LakeTable(self.catalog, meta.version(self.branch).storage_table, self.branch)

    def temp(self, df: DataFrame) -> str:
        name = f"tarnlake_{uuid.uuid4().hex[:16]}"
        df.createOrReplaceTempView(name)
        self._views.append(name)
        return name

    def release(self) -> None:
        for v in self._views:
            self.spark.catalog.dropTempView(v)
        self._views = []

    def query(self, sql: str) -> DataFrame:
        """Plan a SELECT over lake names; other names are Spark's own.

        The query is planned twice: over empty relations, for the predicates that
        Catalyst derives at each place, then over the files those leave.
        """
        text = self.inline(sql, self.branch)
        found = sqltext.occurrences(self.spark, text)
        got = [self.lookup(o.name) for o in found]
        kept = [o for o, g in zip(found, got) if g is not None]
        tables: dict[str, tuple] = {}
        reads = []  # (table, its metadata, snapshot) for each place; one metadata for a name throughout
        for o, g in zip(found, got):
            if g is not None:
                if g[0] not in tables:
                    t = self.table(*g)
                    tables[g[0]] = t, t.metadata
                reads.append((*tables[g[0]], self._travel(o, tables[g[0]][1])))
        try:
            if not kept:
                return self.spark.sql(text)
            empty = []
            for i, (t, meta, at) in enumerate(reads):
                schema = meta.schema() if at is None else meta.schema(meta.snapshots[at])
                empty.append(self.temp(pushdown.placeholder(self.spark, schema, i)))
            needs = pushdown.derived(self.spark.sql(sqltext.rebind(text, kept, empty, True))._jdf.queryExecution().optimizedPlan())
            names = [self.temp(t.df(needs.get(i), snapshot_id=at, meta=meta)) for i, (t, meta, at) in enumerate(reads)]
            return self.spark.sql(sqltext.rebind(text, kept, names, True))
        finally:
            self.release()

    def _travel(self, o: sqltext.Occurrence, meta: TableMetadata) -> int | None:
        """The snapshot that VERSION or TIMESTAMP AS OF names; None for the current one."""
        if o.version is not None:
            if o.version in meta.refs:
                return meta.refs[o.version].snapshot_id
            if not o.version.isdigit() or int(o.version) not in meta.snapshots:
                raise KeyError(f"{o.name} has no snapshot, branch or tag {o.version!r}")
            return int(o.version)
        if o.moment is not None:
            ms = self.spark.sql(f"SELECT unix_millis(CAST({o.moment} AS TIMESTAMP))").first()[0]
            s = meta.as_of(ms) if ms is not None else None
            if s is None:
                raise KeyError(f"{o.name} had no snapshot at {o.moment}")
            return s.snapshot_id
        return None


def create_view(r: Resolver, name: str, sql: str, materialized: bool = False, replace: bool = False) -> None:
    full = r.full(name)
    text = r.qualified(sql)
    schema = r.query(text).schema
    if len(set(c.lower() for c in schema.fieldNames())) < len(schema):
        raise ValueError(f"{name} has two columns of one name")
    if replace and r.catalog.exists(full):
        update_view(r, name, sql)
        return
    storage = f"{full}__storage" if materialized else None
    r.catalog.create(full, ViewMetadata.new(r.catalog.location(full), text, bare(schema), r.namespace, storage))
    if storage:
        LakeTable.create(r.catalog, storage, bare(schema))


def update_view(r: Resolver, name: str, sql: str, branch: str = MAIN) -> None:
    """A new version; a materialized view is computed anew at its next refresh."""
    text = r.qualified(sql)
    schema = bare(r.query(text).schema)
    new = r.catalog.commit(r.full(name), lambda m: m.with_version(text, schema, branch), 3)
    storage = new.version(branch).storage_table
    if storage:
        t = LakeTable(r.catalog, storage)
        if bare(t.metadata.schema()) != schema:
            t.add_schema(schema)


def drop_view(r: Resolver, name: str) -> None:
    full = r.full(name)
    meta, _ = r.catalog.load(full)
    r.catalog.drop(full)
    for v in meta.versions.values():
        if v.storage_table and r.catalog.exists(v.storage_table):
            r.catalog.drop(v.storage_table)


class Refresh:
    """One refresh of a materialized view on a branch."""

    def __init__(self, r: Resolver, name: str):
        self.r, self.full = r, r.full(name)
        self.meta, _ = r.catalog.load(self.full)
        if self.meta.kind != "materialized view":
            raise ValueError(f"{self.full} is not a materialized view")
        self.version = self.meta.version(r.branch)
        self.storage = LakeTable(r.catalog, self.version.storage_table, r.branch)
        self.base = self.storage.metadata  # every read and the commit of this refresh are of this state
        self.sql = r.inline(self.version.sql, r.branch)
        self.places = sqltext.occurrences(r.spark, self.sql)
        self.sources: dict[str, Source] = {}
        self.names: list[str] = []
        state = self._state()
        for o in self.places:
            got = r.lookup(o.name)
            if got is None:
                raise ValueError(f"{o.name} is not a lake table or view")
            full, meta = got
            self.names.append(full)
            if full not in self.sources:
                t = r.table(full, meta)
                own = t.metadata
                s = own.snapshot(r.branch)
                before = state.get(full, {})
                seen = before.get("uuid") == own.uuid
                self.sources[full] = Source(full, t, own.uuid, s.snapshot_id if s else None, before.get("snapshot") if seen else None, seen)
        self.state = state

    def _state(self) -> dict:
        """What the last refresh of this view version read; a branch without its own refresh starts from main's."""
        s = self.base.snapshot(self.r.branch)
        kept = json.loads(s.summary.get(STATE, "{}")) if s else {}
        return kept.get("sources", {}) if kept.get("version") == self.version.version_id else {}

    def _summary(self) -> dict:
        sources = {s.name: {"uuid": s.uuid, "snapshot": s.now} for s in self.sources.values()}
        return {STATE: json.dumps({"version": self.version.version_id, "sources": sources})}

    def _only_appends(self, s: Source) -> bool:
        """Did the source only gain rows since the last refresh?"""
        meta = s.table.metadata
        at = s.now
        while at is not None and at != s.before:
            snap = meta.snapshots.get(at)
            if snap is None or snap.operation != "append":
                return False
            at = snap.parent_id
        return at == s.before

    def run(self) -> str:
        """fresh, incremental or full."""
        if self.state and all(s.fresh for s in self.sources.values()):
            return "fresh"
        try:
            shape = self.shape()
            if self.state and shape.kind != "full" and all(s.seen and self._only_appends(s) for s in self.sources.values()):
                self.incremental(shape)
                return "incremental"
            self.storage.replace(self._bound([s.table.df(snapshot_id=s.now) if s.now is not None else s.table.df().limit(0) for s in self._per_place()]), self._summary(), base=self.base)
            return "full"
        finally:
            self.r.release()

    def _per_place(self) -> list[Source]:
        return [self.sources[n] for n in self.names]

    def _bound(self, frames: list[DataFrame]) -> DataFrame:
        return self.r.spark.sql(sqltext.rebind(self.sql, self.places, [self.r.temp(f) for f in frames]))

    def shape(self) -> sqltext.Shape:
        df = self._bound([s.table.df().limit(0) for s in self._per_place()])
        analyzed = df._jdf.queryExecution().analyzed()
        return sqltext.shape(self.r.spark, self.sql, df.columns, analyzed)

    def delta(self) -> DataFrame | None:
        """The union of the terms; None if no place has news."""
        sources = self._per_place()
        cur = [s.table.df() for s in sources]
        old = [c if s.fresh else c.limit(0) if s.before is None else s.table.df(snapshot_id=s.before).select(*c.columns) for s, c in zip(sources, cur)]
        terms = []
        for i, s in enumerate(sources):
            if s.fresh:
                continue
            frames = []
            for j, _ in enumerate(sources):
                if self.places[j].branch != self.places[i].branch:
                    frames.append(cur[j].limit(0))
                elif j == i:
                    frames.append(s.table.df(after_snapshot=s.before))
                else:
                    frames.append(cur[j] if j < i else old[j])
            terms.append(self._bound(frames))
        return reduce(lambda a, b: a.unionAll(b), terms) if terms else None

    def incremental(self, shape: sqltext.Shape) -> None:
        delta = self.delta()
        if delta is None:
            return
        if shape.kind == "rows":
            self.storage.append(delta, summary=self._summary(), base=self.base)
            return
        how = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        keys, cols = [F.col(f"`{k}`") for k in shape.keys], delta.columns
        merge = lambda df: df.groupBy(*keys).agg(*[how[f](F.col(f"`{c}`")).alias(c) for c, f in shape.merges])
        types = {f.name: f.dataType for f in self.storage.metadata.schema().fields}
        typed = lambda df: df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in cols])
        news = typed(merge(delta)).persist()
        named = news.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)])
        if self._few_new_rows():
            named = F.broadcast(named)
        same = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        touched = self.storage.df(meta=self.base).select(*[F.col(f"`{c}`") for c in cols]).join(named, same, "left_semi").persist()
        try:
            rows = typed(merge(news.unionByName(touched)))
            self.storage.append(rows, deletes=touched.select(*keys), on=shape.keys, summary=self._summary(), base=self.base)
        finally:
            news.unpersist()
            touched.unpersist()

    def _few_new_rows(self, most: int = 1_000_000) -> bool:
        """Is the view over one place whose new files hold few rows? Then so many groups at most have news."""
        if len(self.places) != 1:
            return False
        s = self._per_place()[0]
        meta = s.table.metadata
        after = meta.snapshots[s.before].sequence_number if s.before is not None else 0
        return sum(m["rows"] for m in s.table.manifests(meta, meta.snapshots[s.now], after) if not m["deletes"]) <= most


def refresh(r: Resolver, name: str, retries: int = 5) -> str:
    """Bring a materialized view up to date, synchronously; says how.

    A refresh lands only on the state it read; one that loses to another starts over from what that one left.
    """
    for attempt in range(retries + 1):
        try:
            return Refresh(r, name).run()
        except CommitConflict:
            if attempt == retries:
                raise
    raise AssertionError
