"""Synchronisation of stored versions that reads and writes only the buckets that differ.

A stored version is a folder with a manifest: one row per bucket of the key with the folder that holds the bucket's
rows and a digest of its keys. A synchronisation changes a bucket only if the bucket's keys differ from those of the
source, or if a key is stored more than once; values under a known key are never updated. So digests of keys, made in
one narrow pass over the source, tell which buckets to read. Others are not copied: the new manifest points to the
folders they are already in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.operators.sync import snapshot_sync
from depotlens.session import SMALL_TASK_BYTES, small_tasks

MANIFEST_SCHEMA = ("bucket INT, folder STRING, row_count BIGINT, key_count BIGINT, digest DECIMAL(38,0), "
                   "buckets INT, table_schema STRING")
BUCKET = "_bucket"
ROWS_PER_PARTITION = 250_000


def _partitions(rows: int) -> int:
    return -(-rows // ROWS_PER_PARTITION) or 1


def _bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    """(bucket, row_count, key_count, digest) of every bucket that has rows.

    The digest adds up two 64-bit hashes of each different key; rows of one key count once. Only keys are read, and
    copies are added up before they are shuffled. A bucket with a NULL in a key has no digest: NULL matches nothing, so such
    rows change with every synchronisation.
    """
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    wide = [F.xxhash64(*parts).cast("decimal(38,0)") for parts in (key, [F.lit("second"), *key])]
    without_key = F.bool_or(reduce(Column.__or__, [F.col(c).isNull() for c in key]))
    digest = F.when(~without_key, F.sum(wide[0] + wide[1] * F.lit(3).cast("decimal(38,0)")))
    return per_key.groupBy(_bucket_of(key, buckets).alias("bucket")).agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("key_count"), digest.cast("decimal(38,0)").alias("digest"))


def _write_rows(rows: DataFrame, folder: str, key: Sequence[str], buckets: int) -> None:
    placed = rows.withColumn(BUCKET, _bucket_of(key, buckets))
    placed.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)


def _write_manifest(manifest: DataFrame, version: str) -> None:
    """Written last: a version without it is unfinished. One entry of no rows carries the schema of an empty table."""
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{version.rstrip('/')}/manifest")


def _manifest(spark: SparkSession, version: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{version.rstrip('/')}/manifest")


def _described(digests: DataFrame, folder: str, buckets: int, schema: str) -> DataFrame:
    return digests.select("bucket", F.lit(folder).alias("folder"), "row_count", "key_count", "digest",
                          F.lit(buckets).alias("buckets"), F.lit(schema).alias("table_schema"))


def _no_rows(spark: SparkSession, buckets: int, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([(-1, "", 0, 0, Decimal(0), buckets, schema.json())], MANIFEST_SCHEMA)


def store_version(df: DataFrame, version: str, key: Sequence[str], buckets: int,
                  task_bytes: int = SMALL_TASK_BYTES) -> None:
    """Store ``df`` as a first version. Tasks take ``task_bytes`` each, so a bucket may be larger than what fits one."""
    spark, folder = df.sparkSession, f"{version.rstrip('/')}/rows-{uuid.uuid4().hex}"
    with small_tasks(spark, task_bytes):
        _write_rows(df, folder, key, buckets)
    stored = spark.read.schema(df.schema).parquet(folder)
    described = _described(bucket_digests(stored, key, buckets), folder, buckets, df.schema.json())
    with small_tasks(spark, task_bytes, _partitions(stored.count())):  # counted by the files' footers
        _write_manifest(described.unionByName(_no_rows(spark, buckets, df.schema)), version)


def _read(spark: SparkSession, held: Sequence, schema) -> DataFrame:
    """The rows of the given manifest entries; partition pruning reads their buckets alone."""
    by_folder: dict[str, list[int]] = {}
    for entry in held:
        by_folder.setdefault(entry.folder, []).append(entry.bucket)
    parts = [
        spark.read.schema(T.StructType([*schema.fields]).add(BUCKET, T.IntegerType())).parquet(folder).where(F.col(BUCKET).isin(sorted(own))).drop(BUCKET)
        for folder, own in sorted(by_folder.items())
    ]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _schema(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def read_version(spark: SparkSession, version: str) -> DataFrame:
    """All rows of a stored version, from the folders that its manifest names."""
    held = _entries(spark, version)
    return _read(spark, [e for e in held if e.row_count], _schema(held[0].table_schema))


def _entries(spark: SparkSession, version: str) -> list:
    """The manifest: as many rows as the table has buckets."""
    try:
        return _manifest(spark, version).collect()
    except AnalysisException as error:
        raise ValueError(f"{version} is not a complete version: it has no manifest") from error


def _compared(spark: SparkSession, version: str, source: DataFrame, key: Sequence[str], task_bytes: int) -> list:
    """(bucket, stale, rows) of every bucket: whether a synchronisation changes it, and the rows of both sides."""
    held = _manifest(spark, version)
    known = held.agg(F.max("buckets").alias("buckets"), F.sum("row_count").alias("rows")).first()
    wanted = bucket_digests(source, key, known.buckets).select(
        "bucket", F.col("row_count").alias("_rows"), F.col("key_count").alias("_keys"), F.col("digest").alias("_digest"))
    have = held.where("row_count > 0")
    compared = have.join(wanted, "bucket", "full")
    same = (F.col("row_count") == F.col("key_count")) & (F.col("key_count") == F.col("_keys")) & (
        F.col("digest") == F.col("_digest"))
    rows = F.coalesce("row_count", F.lit(0)) + F.coalesce("_rows", F.lit(0))
    with small_tasks(spark, task_bytes, _partitions(known.rows)):
        return compared.select("bucket", (~F.coalesce(same, F.lit(False))).alias("stale"), rows.alias("rows")).collect()


def stale_buckets(spark: SparkSession, version: str, source: DataFrame, key: Sequence[str],
                  task_bytes: int = SMALL_TASK_BYTES) -> list[int]:
    """Buckets that a synchronisation with ``source`` would change, in ascending order."""
    return sorted(r.bucket for r in _compared(spark, version, source, key, task_bytes) if r.stale)


def sync_version(spark: SparkSession, current: str, source: DataFrame, following: str, key: Sequence[str],
                 order_by: Sequence[Column] = (), task_bytes: int = SMALL_TASK_BYTES) -> list[int]:
    """Synchronise the stored version ``current`` with ``source`` into ``following``; returns the buckets rewritten.

    The result has the rows of :func:`depotlens.operators.sync.snapshot_sync`. ``current`` is only read, and its
    folders stay in use for the buckets that did not change. A run that dies is repeated: its manifest is missing.
    """
    if current.rstrip("/") == following.rstrip("/"):
        raise ValueError("the new version needs its own directory")
    held = _entries(spark, current)
    buckets, schema = held[0].buckets, _schema(held[0].table_schema)
    changes = [r for r in _compared(spark, current, source, key, task_bytes) if r.stale]
    stale = sorted(r.bucket for r in changes)
    kept = _manifest(spark, current).where(~F.col("bucket").isin(stale)) if stale else _manifest(spark, current)
    with small_tasks(spark, task_bytes, _partitions(sum(r.rows for r in changes))):
        if stale:
            mine = _read(spark, [e for e in held if e.bucket in set(stale) and e.row_count], schema)
            theirs = source.where(_bucket_of(key, buckets).isin(stale))
            folder = f"{following.rstrip('/')}/rows-{uuid.uuid4().hex}"
            _write_rows(snapshot_sync(mine, theirs, key, order_by), folder, key, buckets)
            rewritten = spark.read.schema(schema).parquet(folder)
            kept = kept.unionByName(_described(bucket_digests(rewritten, key, buckets), folder, buckets, schema.json()))
        _write_manifest(kept.where("row_count > 0").unionByName(_no_rows(spark, buckets, schema)), following)
    return stale
