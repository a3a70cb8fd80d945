"""Shared plumbing: tables, the shared scratch folder, Arrow batches, document splits."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to a Python worker at once; whole texts stay whole, so batches are small.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and one machine does all (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL.get("app") != spark.sparkContext.applicationId:
        _LOCAL.update(app=spark.sparkContext.applicationId, dir="file://" + tempfile.mkdtemp(prefix="tarnlake-"))
    return _LOCAL["dir"]


_LOCAL: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@atexit.register
def _clear() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            return


class Scratch:
    """Written tables that cut lineage; they survive lost executors and go when the program ends or on drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _MADE.append((spark, self.root))

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(compression="zstd", **options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for n in names:
            remove(self.spark, f"{self.root}/{n}")

    def close(self) -> None:
        remove(self.spark, self.root)


@contextmanager
def scratch_scope(*kept: Scratch) -> Iterator[None]:
    """Scratch tables made within go at its end, but for those of ``kept``."""
    before = len(_MADE)
    try:
        yield
    finally:
        for spark, path in _MADE[before:]:
            if all(path != k.root for k in kept):
                remove(spark, path)
                _MADE.remove((spark, path))


def held_out(doc_id, modulus: int, rest: int):
    """True where crc32 of the id's decimal text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows, by hash order of unique keys; what reaches the driver or one task is bounded by ``rows`` too."""
    n = df.count()
    if n > rows:
        share = min(1.0, (1.1 * rows + 1000) / n)
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(share * (1 << 30)))
    return df.orderBy(F.xxhash64(*keys), *keys).limit(rows)
