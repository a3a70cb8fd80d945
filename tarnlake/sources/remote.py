"""Catalogs behind HTTP: the public REST protocol, and the Glue service; requests may be signed for AWS."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import json
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from tarnlake.plans import changes
from tarnlake.plans.metadata import MAIN, CommitConflict, TableMetadata, ViewMetadata, parse
from tarnlake.sources.catalog import Catalog, Exists, NoSuch, split


class Refused(Exception):
    """An answer other than success."""

    def __init__(self, status: int, body: dict):
        super().__init__(f"{status}: {body}")
        self.status, self.body = status, body


Signer = Callable[[str, str, dict, bytes], dict]


def aws_signer(access_key: str, secret_key: str, region: str, service: str, token: str | None = None) -> Signer:
    """Signature version 4: further headers for (method, url, headers, body)."""

    def sign(method: str, url: str, headers: dict, body: bytes) -> dict:
        at = datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
        u = urllib.parse.urlsplit(url)
        own = {"host": u.netloc, "x-amz-date": at, "x-amz-content-sha256": hashlib.sha256(body).hexdigest(), **({"x-amz-security-token": token} if token else {})}
        every = {**{k.lower(): v for k, v in headers.items()}, **own}
        names = ";".join(sorted(every))
        query = "&".join(sorted(urllib.parse.urlencode([(k, v)], quote_via=urllib.parse.quote) for k, v in urllib.parse.parse_qsl(u.query, True)))
        path = urllib.parse.quote(u.path or "/", safe="/-_.~")
        lines = "\n".join([method, path, query, *[f"{k}:{every[k].strip()}" for k in sorted(every)], "", names, own["x-amz-content-sha256"]])
        scope = f"{at[:8]}/{region}/{service}/aws4_request"
        text = f"AWS4-HMAC-SHA256\n{at}\n{scope}\n{hashlib.sha256(lines.encode()).hexdigest()}"
        key = f"AWS4{secret_key}".encode()
        for part in (at[:8], region, service, "aws4_request", text):
            key = hmac.new(key, part.encode(), hashlib.sha256).digest()
        del own["host"]
        return {**own, "Authorization": f"AWS4-HMAC-SHA256 Credential={access_key}/{scope}, SignedHeaders={names}, Signature={key.hex()}"}

    return sign


def _send(method: str, url: str, body: object | None, headers: dict, signer: Signer | None, timeout: float) -> dict:
    raw = json.dumps(body).encode() if body is not None else b""
    headers = {"Content-Type": "application/json", **headers}
    if signer:
        headers |= signer(method, url, headers, raw)
    request = urllib.request.Request(url, raw if body is not None else None, headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            got = r.read()
            return json.loads(got) if got else {}
    except urllib.error.HTTPError as e:
        text = e.read()
        try:
            told = json.loads(text) if text else {}
        except ValueError:
            told = {"message": text.decode("utf-8", "replace")}
        raise Refused(e.code, told) from None


class RestCatalog(Catalog):
    """The public REST catalog protocol: tables as updates with requirements, views, namespaces, register.

    ``warehouse`` is what the service calls it; tables lie where the service puts
    them, or below ``root``.  With an AWS signer it speaks to S3 Tables' endpoint.
    """

    def __init__(self, spark: SparkSession, uri: str, warehouse: str = "", root: str = "", token: str | None = None, credential: str | None = None, signer: Signer | None = None, name: str = "lake", timeout: float = 60):
        super().__init__(spark, root or warehouse, name)
        self.uri, self.signer, self.timeout, self.headers = uri.rstrip("/"), signer, timeout, {}
        if credential:
            client, _, secret = credential.rpartition(":")
            token = self._token(client, secret)
        if token:
            self.headers["Authorization"] = f"Bearer {token}"
        told = self._call("GET", "/v1/config" + (f"?warehouse={urllib.parse.quote(warehouse, safe='')}" if warehouse else ""), plain=True)
        settings = {**told.get("defaults", {}), **told.get("overrides", {})}
        self.prefix = f"/v1/{settings['prefix']}" if settings.get("prefix") else "/v1"
        self._seen: dict[str, tuple[str, TableMetadata | ViewMetadata]] = {}

    def _token(self, client: str, secret: str) -> str:
        form = urllib.parse.urlencode({"grant_type": "client_credentials", "client_id": client, "client_secret": secret, "scope": "catalog"}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{self.uri}/v1/oauth/tokens", form), timeout=self.timeout) as r:
            return json.load(r)["access_token"]

    def _call(self, method: str, path: str, body: object | None = None, plain: bool = False) -> dict:
        return _send(method, self.uri + (path if plain else self.prefix + path), body, self.headers, self.signer, self.timeout)

    @staticmethod
    def _ns(namespace: str) -> str:
        return "/namespaces/" + urllib.parse.quote("\x1f".join(namespace.split(".")), safe="")

    def _at(self, identifier: str, kind: str) -> str:
        ns, name = split(identifier)
        return f"{self._ns(ns)}/{kind}/{urllib.parse.quote(name, safe='')}"

    def _pages(self, path: str, what: str) -> list:
        out, token = [], ""
        while token is not None:
            got = self._call("GET", f"{path}{'&' if '?' in path else '?'}pageToken={urllib.parse.quote(token)}")
            out, token = out + got.get(what, []), got.get("next-page-token")
        return out

    def create_namespace(self, namespace: str, properties: dict | None = None) -> None:
        try:
            self._call("POST", "/namespaces", {"namespace": namespace.split("."), "properties": properties or {}})
        except Refused as e:
            raise (Exists(namespace) if e.status == 409 else e) from None

    def drop_namespace(self, namespace: str) -> None:
        try:
            self._call("DELETE", self._ns(namespace))
        except Refused as e:
            raise {404: NoSuch(f"namespace {namespace}"), 409: Exists(f"namespace {namespace} is not empty")}.get(e.status, e) from None

    def namespaces(self) -> list[str]:
        out, todo = [], [None]
        while todo:
            parent = todo.pop()
            path = "/namespaces" + (f"?parent={urllib.parse.quote(chr(31).join(parent), safe='')}" if parent else "")
            found = self._pages(path, "namespaces")
            out += [".".join(n) for n in found]
            todo += found
        return sorted(out)

    def namespace_properties(self, namespace: str) -> dict:
        try:
            return self._call("GET", self._ns(namespace)).get("properties", {})
        except Refused as e:
            raise (NoSuch(f"namespace {namespace}") if e.status == 404 else e) from None

    def namespace_exists(self, namespace: str) -> bool:
        try:
            self.namespace_properties(namespace)
            return True
        except NoSuch:
            return False

    def update_namespace(self, namespace: str, properties: dict) -> None:
        self._call("POST", f"{self._ns(namespace)}/properties", {"updates": properties, "removals": []})

    def tabulars(self, namespace: str) -> list[str]:
        found = [*self._pages(f"{self._ns(namespace)}/tables", "identifiers"), *self._pages(f"{self._ns(namespace)}/views", "identifiers")]
        return sorted(f"{namespace}.{i['name']}" for i in found)

    def _fetch(self, identifier: str) -> tuple[str, TableMetadata | ViewMetadata] | None:
        for kind in ("tables", "views"):
            try:
                got = self._call("GET", self._at(identifier, kind))
            except Refused as e:
                if e.status != 404:
                    raise
                continue
            self._seen[identifier] = got["metadata-location"], parse(json.dumps(got["metadata"]))
            return self._seen[identifier]
        return None

    def pointer(self, identifier: str) -> str | None:
        got = self._fetch(identifier)
        return got[0] if got else None

    def load(self, identifier: str):
        got = self._fetch(identifier)
        if got is None:
            raise NoSuch(identifier)
        return got[1], got[0]

    def swap(self, identifier: str, old: str | None, metadata) -> str:
        kind = "tables" if isinstance(metadata, TableMetadata) else "views"
        try:
            if old is None:
                return self._create(identifier, metadata, kind)["metadata-location"]
            base = self._seen.get(identifier)
            if base is None or base[0] != old:
                raise CommitConflict(identifier)
            if kind == "tables":
                refs = tuple(sorted({MAIN, *base[1].refs, *metadata.refs}))
                body = {"requirements": changes.requirements(base[1], refs), "updates": changes.updates(base[1], metadata)}
            else:
                body = {"requirements": [{"type": "assert-view-uuid", "uuid": base[1].uuid}], "updates": view_updates(base[1], metadata)}
            ns, name = split(identifier)
            return self._call("POST", self._at(identifier, kind), {"identifier": {"namespace": ns.split("."), "name": name}, **body})["metadata-location"]
        except Refused as e:
            if e.status == 409:
                raise (CommitConflict if old else Exists)(identifier) from None
            raise

    def _create(self, identifier: str, metadata, kind: str) -> dict:
        """A table is created as it is by a commit that requires that there is none; a view by its first version."""
        ns, name = split(identifier)
        form = json.loads(metadata.to_json())
        if kind == "views":
            body = {"name": name, "location": form["location"], "schema": form["schemas"][-1], "view-version": form["versions"][-1], "properties": form["properties"]}
            return self._call("POST", f"{self._ns(ns)}/views", body)
        empty = TableMetadata(metadata.uuid, metadata.location, {}, 0, {}, 0, sort_orders={}, format_version=metadata.format_version)
        more = [{"action": "assign-uuid", "uuid": metadata.uuid}, {"action": "upgrade-format-version", "format-version": metadata.format_version}, {"action": "set-location", "location": metadata.location}]
        more += changes.updates(empty, metadata)
        defaults = [("set-current-schema", "schema-id", metadata.current_schema), ("set-default-spec", "spec-id", metadata.default_spec), ("set-default-sort-order", "sort-order-id", metadata.default_sort_order)]
        more += [{"action": a, k: v} for a, k, v in defaults if not any(u["action"] == a for u in more)]
        return self._call("POST", self._at(identifier, kind), {"identifier": {"namespace": ns.split("."), "name": name}, "requirements": [{"type": "assert-create"}], "updates": more})

    def drop(self, identifier: str) -> None:
        for kind in ("tables", "views"):
            try:
                self._call("DELETE", self._at(identifier, kind))
                return
            except Refused as e:
                if e.status != 404:
                    raise
        raise NoSuch(identifier)

    def register(self, identifier: str, metadata_path: str) -> None:
        ns, name = split(identifier)
        try:
            self._call("POST", f"{self._ns(ns)}/register", {"name": name, "metadata-location": metadata_path})
        except Refused as e:
            raise (Exists(identifier) if e.status == 409 else e) from None


def view_updates(base: ViewMetadata, new: ViewMetadata) -> list[dict]:
    a, b = json.loads(base.to_json()), json.loads(new.to_json())
    have, out = {v["version-id"] for v in a["versions"]}, []
    for v in b["versions"]:
        if v["version-id"] not in have:
            schema = next(s for s in b["schemas"] if s["schema-id"] == v["schema-id"])
            out += [{"action": "add-schema", "schema": schema}, {"action": "add-view-version", "view-version": v}]
    if a["current-version-id"] != b["current-version-id"]:
        out.append({"action": "set-current-view-version", "view-version-id": b["current-version-id"]})
    changed = {k: v for k, v in b["properties"].items() if a["properties"].get(k) != v}
    return [*out, {"action": "set-properties", "updates": changed}] if changed else out


class GlueCatalog(Catalog):
    """Databases and tables of the Glue service; a swap is an UpdateTable that names the version it read.

    ``endpoint`` with the region's signer; metadata files lie in ``warehouse``.
    ``table_type`` marks this catalog's tables: pass what other readers of the
    service look for.
    """

    def __init__(self, spark: SparkSession, endpoint: str, warehouse: str, signer: Signer | None = None, name: str = "lake", catalog_id: str | None = None, table_type: str = "LAKE", timeout: float = 60):
        super().__init__(spark, warehouse, name)
        self.table_type = table_type
        self.endpoint, self.signer, self.timeout = endpoint, signer, timeout
        self.fixed = {"CatalogId": catalog_id} if catalog_id else {}
        self._versions: dict[str, tuple[str, str | None]] = {}

    def _call(self, action: str, **body) -> dict:
        headers = {"X-Amz-Target": f"AWSGlue.{action}", "Content-Type": "application/x-amz-json-1.1"}
        try:
            return _send("POST", self.endpoint, {**self.fixed, **body}, headers, self.signer, self.timeout)
        except Refused as e:
            kind = str(e.body.get("__type", "")).rpartition("#")[2]
            what = body.get("Name") or body.get("TableInput", {}).get("Name") or body.get("DatabaseName")
            known = {"EntityNotFoundException": NoSuch, "AlreadyExistsException": Exists, "ConcurrentModificationException": CommitConflict}
            raise (known[kind](what) if kind in known else e) from None

    def _pages(self, action: str, what: str, **body) -> list:
        out, token = [], {}
        while token is not None:
            got = self._call(action, **body, **token)
            out += got.get(what, [])
            token = {"NextToken": got["NextToken"]} if got.get("NextToken") else None
        return out

    def create_namespace(self, namespace: str, properties: dict | None = None) -> None:
        self._call("CreateDatabase", DatabaseInput={"Name": namespace, "Parameters": properties or {}})

    def drop_namespace(self, namespace: str) -> None:
        self.namespace_properties(namespace)
        if self.tabulars(namespace):
            raise Exists(f"namespace {namespace} is not empty")
        self._call("DeleteDatabase", Name=namespace)

    def namespaces(self) -> list[str]:
        return sorted(d["Name"] for d in self._pages("GetDatabases", "DatabaseList"))

    def namespace_properties(self, namespace: str) -> dict:
        return self._call("GetDatabase", Name=namespace)["Database"].get("Parameters", {})

    def namespace_exists(self, namespace: str) -> bool:
        try:
            self.namespace_properties(namespace)
            return True
        except NoSuch:
            return False

    def update_namespace(self, namespace: str, properties: dict) -> None:
        self._call("UpdateDatabase", Name=namespace, DatabaseInput={"Name": namespace, "Parameters": {**self.namespace_properties(namespace), **properties}})

    def tabulars(self, namespace: str) -> list[str]:
        found = self._pages("GetTables", "TableList", DatabaseName=namespace)
        return sorted(f"{namespace}.{t['Name']}" for t in found if t.get("Parameters", {}).get("table_type", "").upper() == self.table_type)

    def pointer(self, identifier: str) -> str | None:
        ns, name = split(identifier)
        try:
            t = self._call("GetTable", DatabaseName=ns, Name=name)["Table"]
        except NoSuch:
            return None
        path = t.get("Parameters", {}).get("metadata_location")
        if path:
            self._versions[identifier] = path, t.get("VersionId")
        return path

    def _input(self, identifier: str, path: str, metadata, old: str | None) -> dict:
        schema = metadata.schema() if isinstance(metadata, TableMetadata) else None
        columns = [{"Name": f.name, "Type": f.dataType.simpleString()} for f in schema.fields] if schema else []
        told = {"table_type": self.table_type, "metadata_location": path, **({"previous_metadata_location": old} if old else {})}
        return {"Name": split(identifier)[1], "TableType": "EXTERNAL_TABLE", "Parameters": told, "StorageDescriptor": {"Columns": columns, "Location": metadata.location}}

    def swap(self, identifier: str, old: str | None, metadata) -> str:
        path = f"{metadata.location}/metadata/{uuid.uuid4().hex}.metadata.json"
        self.storage.create(path, metadata.to_json())
        ns, _ = split(identifier)
        if old is None:
            self._call("CreateTable", DatabaseName=ns, TableInput=self._input(identifier, path, metadata, None))
            return path
        seen = self._versions.get(identifier)
        if seen is None or seen[0] != old:
            raise CommitConflict(identifier)
        self._call("UpdateTable", DatabaseName=ns, TableInput=self._input(identifier, path, metadata, old), SkipArchive=True, **({"VersionId": seen[1]} if seen[1] else {}))
        return path

    def drop(self, identifier: str) -> None:
        ns, name = split(identifier)
        self._call("DeleteTable", DatabaseName=ns, Name=name)

    def register(self, identifier: str, metadata_path: str) -> None:
        metadata = parse(self.storage.read(metadata_path))
        self._call("CreateTable", DatabaseName=split(identifier)[0], TableInput=self._input(identifier, metadata_path, metadata, None))
