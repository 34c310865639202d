"""Session defaults. Anything the cluster or the caller already set wins."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Adaptive execution does the size-checked work of this library: it turns a join into a
# broadcast join only when the measured side is small, splits skewed join partitions
# otherwise, and merges small shuffle partitions by measured bytes.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
BYTES_PER_PARTITION = 128 * 1024 * 1024
SCAN_BYTES = "spark.sql.files.maxPartitionBytes"
SHUFFLED_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# of a file or of shuffled rows for one task; rows of a few numbers take some 20 times as much memory in a hash table
SMALL_TASK_BYTES = 16 * 1024 * 1024
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH_BYTES = 4 * 1024 * 1024


def partitions_for(input_bytes: int) -> int:
    """Shuffle partitions to start with so that one partition fits in a task's memory even
    if everything that is read gets shuffled."""
    return max(1, -(-input_bytes // BYTES_PER_PARTITION))


def parallel_tasks(spark: SparkSession) -> int:
    """Tasks a wide stage should have in this session."""
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get(SHUFFLE_PARTITIONS))


def _bytes(text: str) -> int:
    """The number of bytes that a size such as ``128m`` or ``134217728b`` stands for."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def small_tasks(spark: SparkSession, task_bytes: int = SMALL_TASK_BYTES, partitions: int = 1) -> Iterator[None]:
    """Jobs that run inside read at most about ``task_bytes`` of a file or of shuffled rows per task.

    Aggregations and joins of nearly unique keys need memory for all rows of a task. So their need does not grow with the
    input, as long as shuffles start with enough partitions: with the session's number or ``partitions``, the larger one.
    Frames are planned when they run, so only actions inside are meant. What the session had is restored at the end.
    """
    before = {name: spark.conf.get(name, None) for name in (SCAN_BYTES, SHUFFLED_BYTES, SHUFFLE_PARTITIONS, INITIAL_PARTITIONS)}
    try:
        for name in (SCAN_BYTES, SHUFFLED_BYTES):
            if _bytes(spark.conf.get(name)) > task_bytes:
                spark.conf.set(name, f"{task_bytes}b")
        if int(spark.conf.get(SHUFFLE_PARTITIONS)) < partitions:
            spark.conf.set(SHUFFLE_PARTITIONS, str(partitions))
        if before[INITIAL_PARTITIONS] is not None and int(before[INITIAL_PARTITIONS]) < partitions:
            spark.conf.set(INITIAL_PARTITIONS, str(partitions))
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@contextmanager
def small_batches(spark: SparkSession, batch_bytes: int = SMALL_BATCH_BYTES) -> Iterator[None]:
    """Jobs that run inside send about ``batch_bytes`` at once to Python workers.

    A batch lies in the memory of the executor and of the worker, twice there while it is read; limited by rows alone it
    grows with their texts. As with ``small_tasks`` only actions inside are meant.
    """
    before = spark.conf.get(ARROW_BYTES, None)
    try:
        if _bytes(spark.conf.get(ARROW_BYTES)) > batch_bytes:
            spark.conf.set(ARROW_BYTES, f"{batch_bytes}b")
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_BYTES)
        else:
            spark.conf.set(ARROW_BYTES, before)


def build_session(app_name: str = "depotlens", master: str | None = None, conf: dict[str, str] | None = None,
                  input_bytes: int | None = None) -> SparkSession:
    """Get or create a session; ``conf`` overrides the defaults above.

    Adaptive execution merges shuffle partitions but never adds any, so large inputs need
    a large number to start with: give their size as ``input_bytes``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    defaults = dict(DEFAULTS)
    if input_bytes is not None:
        at_least = int(spark.conf.get(SHUFFLE_PARTITIONS))
        defaults[INITIAL_PARTITIONS] = str(max(at_least, partitions_for(input_bytes)))
    # submitted properties are visible on the context: leave those alone
    submitted = dict(spark.sparkContext.getConf().getAll())
    for key, value in defaults.items():
        if key not in submitted and key not in (conf or {}):
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a temporary folder is made, in local sessions only: on a cluster it would lie on the
    driver's machine alone, so there ``ValueError`` is raised.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="depotlens-"))
    return context.getCheckpointDir()
