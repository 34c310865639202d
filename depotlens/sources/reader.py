"""Snapshot readers: declared types, missing sources reported instead of failing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.sources.schemas import SPECS, TableSpec

Tables = Mapping[str, DataFrame]


class LazyTables(Mapping[str, DataFrame]):
    """Tables that are opened when first asked for: a report touches two or three of them,
    and opening one reads file footers."""

    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]):
        self._openers = dict(openers)
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._openers[name]()
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)


def source_path(directory: str, table: str, fmt: str) -> str:
    """Where the snapshot of ``table`` is expected: a file or a directory of files."""
    return f"{directory.rstrip('/')}/{table}.{fmt}"


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Select the declared columns with their declared types.

    Text that does not parse becomes NULL, as a date function on malformed text does.
    Column names must be exactly the declared ones: a missing or unknown header is an error.
    """
    declared = spec.schema.fieldNames()
    missing = [c for c in declared if c not in df.columns]
    unknown = [c for c in df.columns if c not in declared]
    if missing or unknown:
        raise ValueError(f"{spec.name}: missing columns {missing}, unknown columns {unknown}")
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in spec.schema.fields])


def read_snapshot(spark: SparkSession, path: str, spec: TableSpec, fmt: str = "parquet") -> DataFrame | None:
    """Read one snapshot, or return None when nothing or only an unfinished write lies at ``path``.

    CSV columns are matched by header name and read as text; typing happens in
    :func:`conform`, so a date written with a midnight time still parses.
    """
    raw = _raw_snapshot(spark, path, spec, fmt)
    return None if raw is None else conform(raw, spec)


def _raw_snapshot(spark: SparkSession, path: str, spec: TableSpec, fmt: str) -> DataFrame | None:
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        # a partitioned table without rows is a directory without files, but with the mark of a finished
        # write; without the mark it may be an upload in progress
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return empty_table(spark, spec) if _is_finished(spark, path) else None
        raise


def read_checked(spark: SparkSession, path: str, spec: TableSpec, fmt: str = "csv") -> tuple[DataFrame, DataFrame] | None:
    """One snapshot in two parts: the rows that parse, and what does not.

    Where :func:`read_snapshot` turns text that does not parse into NULL, here a row with such text is kept aside. The
    second table has a row per text that failed: (table, file, row_key, column, text), where ``row_key`` is the row's
    key as it was written. NULL where ``path`` holds no snapshot. Both parts read the files, nothing is shuffled.
    """
    raw = _raw_snapshot(spark, path, spec, fmt)
    if raw is None:
        return None
    conform(raw, spec)  # headers must be the declared ones
    texts = raw.select(*[F.col(c) for c in spec.schema.fieldNames()], F.col("_metadata.file_name").alias("_file"))
    failed = {f.name: F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull() for f in spec.schema.fields}
    any_failed = reduce(Column.__or__, failed.values())
    accepted = conform(texts.where(~any_failed).drop("_file"), spec)
    key = F.concat_ws(",", *[F.col(c).cast("string") for c in spec.key])
    cells = F.array(*[
        F.struct(bad.alias("bad"), F.lit(name).alias("column"), F.col(name).cast("string").alias("text"))
        for name, bad in failed.items()])
    rejected = texts.where(any_failed).select(
        F.lit(spec.name).alias("table"), F.col("_file").alias("file"), key.alias("row_key"), F.inline(cells))
    return accepted, rejected.where("bad").drop("bad")


def _is_finished(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def empty_table(spark: SparkSession, spec: TableSpec) -> DataFrame:
    return spark.createDataFrame([], spec.schema)


def read_tables(spark: SparkSession, directory: str, fmt: str = "parquet",
                specs: Mapping[str, TableSpec] = SPECS) -> LazyTables:
    """All declared tables under ``directory``; an absent one is empty."""

    def opener(spec: TableSpec) -> Callable[[], DataFrame]:
        def open_table() -> DataFrame:
            df = read_snapshot(spark, source_path(directory, spec.name, fmt), spec, fmt)
            return empty_table(spark, spec) if df is None else df
        return open_table

    return LazyTables({name: opener(spec) for name, spec in specs.items()})


def catalog_tables(spark: SparkSession, prefix: str = "", specs: Mapping[str, TableSpec] = SPECS) -> LazyTables:
    """The declared tables as saved in the catalog under ``prefix`` + name, for example a
    database name and a dot. Partitioning and bucketing of the saved tables are used."""

    def opener(spec: TableSpec) -> Callable[[], DataFrame]:
        return lambda: conform(spark.table(prefix + spec.name), spec)

    return LazyTables({name: opener(spec) for name, spec in specs.items()})
