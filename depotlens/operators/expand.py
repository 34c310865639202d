"""Turn counted rows back into that many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.session import parallel_tasks


def expand_rows(df: DataFrame, count: str, number: str, order_by: Sequence[Column], before: str, grand: str,
                tasks: int | None = None) -> DataFrame:
    """Repeat each row ``count`` times, numbered from 1 in ``number``, in the given order.

    ``before`` and ``grand`` hold the running total of ``count`` before the row and over all rows. They place
    every row of the listing, so the listing is cut at multiples of one task's share: each task makes the same
    number of rows, whether they belong to one hot row or to many small ones. There are as many tasks as the
    session has parallel ones, which follows the input size (see ``build_session``), unless ``tasks`` says
    otherwise. Rows with no count are dropped.
    """
    tasks = tasks or parallel_tasks(df.sparkSession)
    share = f"(({grand} + {tasks - 1}) div {tasks})"
    pieces = df.where(f"{count} > 0").withColumn(
        "_task", F.expr(f"explode(sequence({before} div {share}, ({before} + {count} - 1) div {share}))"))
    first = F.expr(f"greatest(1L, _task * {share} - {before} + 1)")
    last = F.expr(f"least({count}, (_task + 1) * {share} - {before})")
    return (
        pieces.repartitionById(tasks, F.col("_task").cast("int"))
        .sortWithinPartitions(*order_by)
        .withColumn(number, F.explode(F.sequence(first, last)))
        .drop("_task")
    )
