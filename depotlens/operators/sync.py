"""Snapshot synchronisation: keep, add and delete rows by key.

A row is known by its key alone. Keys present on both sides keep the stored values, keys
only in the source are added with all their rows, keys only in the target are deleted.
A NULL key equals no other key; ``integrity_checks`` finds such rows beforehand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.sources.reader import empty_table, read_snapshot, source_path
from depotlens.sources.schemas import SPECS, TableSpec
from depotlens.sources.writer import write_table

SUMMARY_SCHEMA = "table STRING, duplicates_removed BIGINT, added BIGINT, deleted BIGINT, status STRING"
SYNCED, SKIPPED = "synced", "skipped"
MOST_REPEATED_KEYS = 500_000


def _same_key(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    """NULL keys are one key here, as they are in a grouping."""
    return reduce(Column.__and__, [left[c].eqNullSafe(right[f"_{c}"]) for c in key])


def keep_first(df: DataFrame, key: Sequence[str], order_by: Sequence[Column] = (),
               most_keys: int = MOST_REPEATED_KEYS) -> DataFrame:
    """One row per key: the first by ``order_by``, then by all columns ascending.

    Tables have few copies as a rule, so keys are counted first, by hash and without their rows. Rows whose key occurs
    once go through as they are; only those of a repeated key are ordered, and copies of one key are reduced before they
    meet in one task. The count is made when this is called. More than ``most_keys`` repeated keys are too many to send
    to every task; then all rows are ordered.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest and not order_by:
        return df.distinct()
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1").drop("_copies")
    found = repeated.limit(most_keys + 1).count()
    if found == 0:
        return df
    if found > most_keys:
        return _first_rows(df, key, rest, order_by)
    known = F.broadcast(repeated.toDF(*[f"_{c}" for c in key]))
    single = df.join(known, _same_key(df, known, key), "left_anti")
    copies = df.join(known, _same_key(df, known, key), "left_semi")
    return single.unionByName(_first_rows(copies, key, rest, order_by))


def _first_rows(df: DataFrame, key: Sequence[str], rest: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """An aggregation and not a window: copies are reduced on the map side and never meet in one task."""
    ranks = [c.alias(f"_rank{i}") for i, c in enumerate(order_by)]
    first = df.groupBy(*key).agg(F.min(F.struct(*ranks, *rest)).alias("_first"))
    return first.select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in df.columns])


def snapshot_sync(target: DataFrame, source: DataFrame, key: Sequence[str],
                  order_by: Sequence[Column] = ()) -> DataFrame:
    """The target after synchronising it with the source."""
    keys = list(key)
    survivors = keep_first(target, keys, order_by).join(source.select(*keys).distinct(), keys, "left_semi")
    return survivors.select(*target.columns).unionByName(missing_rows(target, source, keys))


def missing_rows(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Source rows whose key the target does not have."""
    keys = list(key)
    return source.join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns)


def insert_missing(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """First load: add the missing rows, delete nothing, leave copies alone."""
    return target.unionByName(missing_rows(target, source, key))


def sync_summary(target: DataFrame, source: DataFrame | None, key: Sequence[str], table: str) -> DataFrame:
    """What a synchronisation changes, as one row.

    Deleted rows are counted on the target with its copies. Both sides shrink to one count
    per key before they are joined, so a key with many copies costs no more than another.
    """
    keys = list(key)
    if source is None:
        nothing = F.lit(0).cast("bigint")
        return target.sparkSession.range(1).select(
            F.lit(table).alias("table"), nothing.alias("duplicates_removed"), nothing.alias("added"),
            nothing.alias("deleted"), F.lit(SKIPPED).alias("status"))
    have = target.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    want = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_want"))
    both = have.join(want, keys, "full")
    zero = F.lit(0)
    return both.agg(
        F.coalesce(F.sum(F.col("_have") - 1), zero).alias("duplicates_removed"),
        F.coalesce(F.sum(F.when(F.col("_have").isNull(), F.col("_want"))), zero).alias("added"),
        F.coalesce(F.sum(F.when(F.col("_want").isNull(), F.col("_have"))), zero).alias("deleted"),
    ).select(F.lit(table).alias("table"), "duplicates_removed", "added", "deleted", F.lit(SYNCED).alias("status"))


def _require_complete(spark: SparkSession, directory: str) -> None:
    try:
        spark.read.schema(SUMMARY_SCHEMA).parquet(f"{directory.rstrip('/')}/sync_summary.parquet")
    except AnalysisException as error:
        raise ValueError(f"{directory} is not a complete version: it has no summary") from error


def sync_all(spark: SparkSession, source_dir: str, current_dir: str, next_dir: str, fmt: str = "csv",
             specs: Mapping[str, TableSpec] = SPECS, first_load: bool = False) -> DataFrame:
    """Synchronise every routed table from ``current_dir`` into the new version ``next_dir``.

    The current version is only read, so a run that dies half-way can simply be repeated.
    A table without a source is carried over unchanged and reported as skipped. Returns
    the stored summary, which is written last and so marks a complete version.

    A current version without its summary is missing or unfinished and refused, unless ``first_load``
    says that there is none yet.
    """
    if current_dir.rstrip("/") == next_dir.rstrip("/"):
        raise ValueError("the new version needs its own directory")
    if not first_load:
        _require_complete(spark, current_dir)
    summaries = []
    for name, spec in specs.items():
        stored = read_snapshot(spark, source_path(current_dir, name, "parquet"), spec)
        target = empty_table(spark, spec) if stored is None else stored
        source = read_snapshot(spark, source_path(source_dir, name, fmt), spec, fmt)
        result = target if source is None else snapshot_sync(target, source, spec.key)
        write_table(result, source_path(next_dir, name, "parquet"), spec.partition_by)
        summaries.append(sync_summary(target, source, spec.key, name))
    path = f"{next_dir.rstrip('/')}/sync_summary.parquet"
    reduce(DataFrame.unionByName, summaries).write.mode("overwrite").parquet(path)
    return spark.read.schema(SUMMARY_SCHEMA).parquet(path)
