"""Files through Hadoop's file systems: small metadata objects, and a warehouse folder all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


class AlreadyThere(Exception):
    """An exclusive create found the file."""


class Storage:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def read(self, path: str) -> str:
        return self.read_bytes(path).decode("utf-8")

    def read_bytes(self, path: str) -> bytes:
        local = local_path(path)
        if local is not None:
            with open(local, "rb") as f:
                return f.read()
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, text: str | bytes) -> None:
        """Write a new file; exactly one of several writers succeeds, the others get AlreadyThere.

        Local folders link a finished file into place, which is atomic; elsewhere
        the store's own create without overwrite decides.
        """
        raw = text.encode("utf-8") if isinstance(text, str) else text
        local = local_path(path)
        if local is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            own = f"{local}.{uuid.uuid4().hex}.tmp"
            with open(own, "wb") as f:
                f.write(raw)
            try:
                os.link(own, local)
            except FileExistsError:
                raise AlreadyThere(path) from None
            finally:
                os.unlink(own)
            return
        fs, p = self._fs(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise AlreadyThere(path) from e
            raise
        out.write(bytearray(raw))
        out.close()

    def names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def files(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of every Parquet file below, except hidden ones."""
        fs, p = self._fs(path)
        out = []
        if fs.exists(p):
            it = fs.listFiles(p, True)
            while it.hasNext():
                s = it.next()
                name = s.getPath().getName()
                if name.endswith(".parquet") and name[0] not in "._":
                    out.append((s.getPath().toString(), s.getLen()))
        return sorted(out)

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)


def local_path(path: str) -> str | None:
    """The path on this machine's disk, if it is one."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


_OWN: list[tuple[SparkSession, str]] = []
_BASE: dict[str, str] = {}


def new_warehouse(spark: SparkSession) -> str:
    """A fresh warehouse in spark.checkpoint.dir, or in a temporary folder where that is unset and one machine does all; goes when the program ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _BASE.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tarnlake-"))
    path = f"{base.rstrip('/')}/warehouse-{uuid.uuid4().hex[:12]}"
    _OWN.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _OWN:
        try:
            Storage(spark).delete(path)
        except Exception:  # the session may be gone already
            return
