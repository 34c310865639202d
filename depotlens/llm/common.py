"""Helpers shared by the operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.session import parallel_tasks, shared_folder

BROADCAST_ROWS = 2_000_000  # rows of a number or two, 32 MB
TRIM = "systemTrimNativeHeap"  # a diagnostic command of OpenJDK on Linux


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a folder of its own in the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_broadcast(keys: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys``, a narrow table, stored; marked for broadcast if it has at most ``most_rows`` rows, else joined by shuffle."""
    stored = checkpointed(keys)
    return F.broadcast(stored) if stored.count() <= most_rows else stored


def release(spark) -> None:
    """Let go of what finished jobs left behind.

    Spark removes broadcasts, shuffle files and checkpoints once the driver has collected the objects that stand for
    them, which a driver with room to spare puts off. Its memory and the shared folder stay smaller this way. What the
    driver has freed outside its heap goes back to the system as well.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark) -> None:
    """Ask the driver's JVM to trim its native heap, as ``jcmd PID System.trim_native_heap`` does.

    glibc keeps freed memory for each thread that ever took some. A JVM that cannot trim is left as it is.
    """
    context = spark.sparkContext
    java = context._jvm.java.lang
    bean = context._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = java.management.ManagementFactory.getPlatformMBeanServer()
    # the server's class is not open to callers, its interface is
    invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    values = context._gateway.new_array(java.Object, 4)
    values[0], values[1] = bean, TRIM
    with suppress(Py4JJavaError):  # no such command
        invoke.invoke(server, values)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
             buckets: int | None = None, part: Column | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps in column ``name``.

    ``keys`` hold no NULL. A key is cut into buckets by a hash of ``order``; the rows of a bucket are
    numbered by themselves and the counts of the buckets, at most ``buckets`` rows per key, give the
    offsets. So a key that holds a third of all rows is numbered by many tasks. With ``part``, the share from 0 to 1
    of the order that lies before a row, buckets are ranges of it, so that the numbers follow ``order``.
    """
    buckets = buckets or parallel_tasks(df.sparkSession)
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)) if part is None else F.floor(part * buckets)
    cut = df.withColumn("_bucket", bucket.cast("int"))
    counts = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        cut.withColumn("_row", F.row_number().over(within) - 1)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_row")).cast("long"))
        .drop("_bucket", "_row", "_offset")
    )
