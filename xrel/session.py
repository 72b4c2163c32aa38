"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Counted rows up to this many may be handed to every task.
BROADCAST_ROWS = 100_000


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the jobs rely on; sizes stay with the cluster's own defaults."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A skewed join may cost one more shuffle downstream; that beats one huge task.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in spark.checkpoint.dir.

    A local master may fall back to a temporary folder; a cluster may not.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="xrel-")


# A step over more rows than this is worked out slice by slice, so that only one slice's shuffle files lie on disk.
SLICE_ROWS, SLICES = 2_000_000, 16
# What cut_lineage() has written and not deleted: path -> application and a weak reference to the file index of its plans.
_written: dict[str, tuple] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Shuffle files of a step go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def _sweep(spark: SparkSession) -> None:
    """Delete written tables that no plan reads any more, as far as the JVM has noticed."""
    application = spark.sparkContext.applicationId
    for path, (owner, index) in list(_written.items()):
        if owner != application:
            del _written[path]
        elif index.get() is None:
            del _written[path]
            _delete(spark, path)


def cut_lineage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back, so loops do not grow the plan and lost executors lose nothing.

    The table is columnar and compressed. It stays while any plan reads it, or until `dropped`.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    _sweep(spark)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    # Parquet has no column that is always null.
    voids = [f.name for f in df.schema.fields if f.dataType.typeName() == "void"]
    rows = df.withColumns({c: F.lit(None).cast("string") for c in voids}) if voids else df
    with dropping_shuffles(spark):
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    index = table._jdf.queryExecution().analyzed().relation().location()
    _written[path] = (context.applicationId, context._jvm.java.lang.ref.WeakReference(index))
    table = table.withColumns({c: F.lit(None) for c in voids}) if voids else table
    return table.select(*df.columns) if partition_by else table


def _paths_of(table: DataFrame) -> list[str]:
    """Where cut_lineage() has written a table, or the parts of one."""
    files = {f.rsplit("/step-", 1)[1].split("/", 1)[0] for f in table.inputFiles() if "/step-" in f}
    return [p for p in _written if p.rsplit("/step-", 1)[1] in files]


def dropped(*tables: DataFrame) -> None:
    """Delete tables that cut_lineage() or in_slices() has written, once all that reads them is written too."""
    for table in tables:
        for path in _paths_of(table):
            del _written[path]
            _delete(table.sparkSession, path)


def collect_dropped(spark: SparkSession) -> None:
    """Delete now what no plan reads any more, where tables are large."""
    spark.sparkContext._jvm.System.gc()
    _sweep(spark)


def few_rows(df: DataFrame) -> DataFrame:
    """Write df out and count it: handed to every task while it is small, joined like any other table beyond."""
    rows = cut_lineage(df)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def in_slices(step: Callable[..., DataFrame], tables: list[DataFrame], keys: list[str], least: int = SLICE_ROWS) -> DataFrame:
    """step(*tables), written; rows that belong together must agree in `keys`, null or not.

    The tables are written by a hash of their keys first. Beyond `least` rows in all the step runs once for each share of
    the hashes: its shuffle files are a small part of what one run would leave, and the rows are the same.
    """
    share = F.pmod(F.xxhash64(*keys), F.lit(SLICES)).cast("int")
    # In the order of their keys, which repeat, they take less room.
    dealt = [cut_lineage(t.withColumn("_slice", share).sortWithinPartitions("_slice", *keys), "_slice") for t in tables]
    if sum(t.count() for t in dealt) <= least:
        done = cut_lineage(step(*(t.drop("_slice") for t in dealt)))
    else:
        parts = []
        for i in range(SLICES):
            collect_dropped(dealt[0].sparkSession)
            parts.append(cut_lineage(step(*(t.where(F.col("_slice") == i).drop("_slice") for t in dealt))))
            for t in dealt:
                for path in _paths_of(t):
                    _delete(t.sparkSession, f"{path}/_slice={i}")
        done = reduce(DataFrame.unionByName, parts)
    dropped(*dealt)
    return done
