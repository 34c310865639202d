"""Declared constraints as a validation job."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.sources.reader import Tables
from depotlens.session import SMALL_TASK_BYTES, small_tasks
from depotlens.sources.schemas import SPECS, ForeignKey, TableSpec

NOT_NULL, PRIMARY_KEY, FOREIGN_KEY = "not_null", "primary_key", "foreign_key"
FINDINGS = "table STRING, rule STRING, column STRING, violations BIGINT"
PARTITIONS = 1024  # that shuffles start with; adaptive execution merges them up to the bytes of a task


def _key_name(spec: TableSpec) -> str:
    return ",".join(spec.key)


def _finding(spec: TableSpec, rule: str, column: str, violations: Column) -> Column:
    return F.struct(
        F.lit(spec.name).alias("table"), F.lit(rule).alias("rule"), F.lit(column).alias("column"),
        violations.cast("bigint").alias("violations"))


def _rules(spec: TableSpec) -> Iterator[Column]:
    """Every constraint of a table, with no violation."""
    none = F.lit(0)
    if spec.key:
        for column in (*spec.key, *spec.not_null):
            yield _finding(spec, NOT_NULL, column, none)
        yield _finding(spec, PRIMARY_KEY, _key_name(spec), none)
    for fk in spec.foreign_keys:
        yield _finding(spec, FOREIGN_KEY, fk.column, none)


def declared_rules(spark: SparkSession, specs: Mapping[str, TableSpec]) -> DataFrame:
    """One row of zero violations per declared constraint."""
    rules = F.array(*[rule for spec in specs.values() for rule in _rules(spec)])
    return spark.range(1).select(F.inline(rules))


def row_violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """NULLs in key and NOT NULL columns, and rows beyond the first of each key.

    One pass: rows are counted per key, and everything is read off those counts. A row
    with a NULL in its key is a NULL violation and never a copy. Keys in order are dropped
    before findings are written out.
    """
    per_key = df.groupBy(*spec.key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in spec.not_null])
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in spec.key])
    named = reduce(Column.__and__, [F.col(f"nulls_{c}") == 0 for c in spec.not_null], F.lit(True))
    none = F.lit(0)
    findings = [
        *[_finding(spec, NOT_NULL, c, F.when(F.col(c).isNull(), F.col("n")).otherwise(none)) for c in spec.key],
        *[_finding(spec, NOT_NULL, c, F.col(f"nulls_{c}")) for c in spec.not_null],
        _finding(spec, PRIMARY_KEY, _key_name(spec), F.when(complete, F.col("n") - 1).otherwise(none)),
    ]
    return per_key.where(~(complete & named) | (F.col("n") > 1)).select(F.inline(F.array(*findings)))


def orphan_violations(df: DataFrame, parent: DataFrame, spec: TableSpec, fk: ForeignKey) -> DataFrame:
    """Rows that refer to a parent that does not exist; NULL refers to nothing.

    References are counted per value before the join, so a value that most rows share
    takes part in it once.
    """
    used = df.where(F.col(fk.column).isNotNull()).groupBy(fk.column).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(fk.parent_column).alias(fk.column))
    orphans = used.join(known, fk.column, "left_anti")
    return orphans.select(_finding(spec, FOREIGN_KEY, fk.column, F.col("n")).alias("finding")).select("finding.*")


def integrity_checks(tables: Tables, specs: Mapping[str, TableSpec] = SPECS, task_bytes: int = SMALL_TASK_BYTES,
                     partitions: int = PARTITIONS) -> DataFrame:
    """(table, rule, column, violations) for every declared constraint.

    The checks only emit what is wrong; all of it is added up in one small shuffle. They run when this is called, in
    tasks of ``task_bytes``: counts of nearly unique keys hold every row of a task in memory. The result has one row per
    constraint, whatever the tables.
    """
    found = []
    for spec in specs.values():
        df = tables[spec.name]
        if spec.key:
            found.append(row_violations(df, spec))
        found += [orphan_violations(df, tables[fk.parent], spec, fk) for fk in spec.foreign_keys]
    spark = found[0].sparkSession
    summed = (
        reduce(DataFrame.unionByName, [declared_rules(spark, specs), *found])
        .groupBy("table", "rule", "column")
        .agg(F.sum("violations").alias("violations"))
    )
    with small_tasks(spark, task_bytes, partitions):
        return spark.createDataFrame(summed.collect(), FINDINGS)
