"""Session settings and the shared scratch folder.

Every multi-pass operator cuts its lineage by writing a table into the folder the
cluster names in ``spark.checkpoint.dir``; nothing is kept in executor-local storage,
so a lost executor only costs the tasks it was running.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Fixed settings the operators rely on (UTC instants, ANSI casts, run-time skew handling).
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM never compiles a method above this size; beyond it, per-operator code is faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Arrow batches lie outside the heap, doubled while they grow; ten thousand rows of text would take some 100 MB a task.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

# What a write shuffled goes from the executors' disks when the write is done; nobody else reads it.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# A task sorts its rows by bucket before it writes them; of a split this small they fit into its memory.
SMALL_SPLITS = {"spark.sql.files.maxPartitionBytes": "32m"}


def build_session(app: str = "caselake", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PINNED, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built."""
    for key, value in PINNED.items():
        spark.conf.set(key, value)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session, where driver and
    executors are one process, may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="caselake-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return os.path.join(scratch_root(spark), "caselake", app, f"{label}-{uuid.uuid4().hex[:12]}")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Run-time settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, label: str = "step", by: str | None = None, buckets: int = 1,
                scratch: Scratch | None = None) -> DataFrame:
    """Write once, read back: one computation, columnar, and independent of the lineage.

    With ``buckets`` rows lie by the hash of ``by``, so that tables in as many buckets are joined by it without a shuffle.
    ``scratch`` is told where, for a table that goes before the job is over.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if scratch is not None:
        scratch.add(spark, path)
    writer = df.write.mode("error").option("compression", "zstd")
    if by is None or buckets < 2:
        with settings(spark, SHUFFLES_GO):
            writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    # Only a named table is known to lie in buckets. What was read keeps knowing it; the name goes at once, the files stay.
    name = f"spark_catalog.default.caselake_{uuid.uuid4().hex}"
    with settings(spark, {**SHUFFLES_GO, **SMALL_SPLITS}):
        writer.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


class Scratch:
    """Tables that a step wrote for itself. Whoever has stored what rests on them lets go of them."""

    def __init__(self) -> None:
        self._held: list[tuple[SparkSession, str]] = []

    def add(self, spark: SparkSession, path: str) -> None:
        self._held.append((spark, path))

    def let_go(self) -> None:
        """Delete them; rows that were not read from them until now cannot be read any more."""
        while self._held:
            spark, name = self._held.pop()
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
