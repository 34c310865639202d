"""Running totals over a whole table without moving the table into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.session import parallel_tasks


def with_running_total(df: DataFrame, order_by: Sequence[Column], weight: Column,
                       before: str = "weight_before", grand: str = "grand_total",
                       buckets: int | None = None) -> DataFrame:
    """Add the total weight of all earlier rows and the total weight of all rows."""
    return with_running_totals(df, order_by, {(before, grand): weight}, buckets)


def with_running_totals(df: DataFrame, order_by: Sequence[Column], weights: Mapping[tuple[str, str], Column],
                        buckets: int | None = None) -> DataFrame:
    """For each (before, grand) add the total weight of all earlier rows and that of all rows, in one pass.

    ``order_by`` sorts ascending and must tell any two rows apart. A window ordered over
    the whole table would sort it in one task. Here the order is cut into value ranges
    first: the bounds are the rows with the smallest key hashes, which is a uniform sample
    that comes out the same on every run. Each range is then summed in parallel, and only
    one sum per range goes through a single task. There are as many ranges as the session
    has parallel tasks, unless ``buckets`` says otherwise; a row finds its range by halving.
    """
    buckets = buckets or parallel_tasks(df.sparkSession)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_by)])
    bounds = (
        df.select(key.alias("key"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(max(1, buckets - 1))
        .agg(F.sort_array(F.collect_list("key")))
        .scalar()
    )
    # never NULL, and declared so: otherwise the join below adds a NULL filter that searches
    # the bounds a second time
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])
    bounds_below = F.aggregate(steps, F.lit(0), lambda below, step: below + F.when(
        F.get("_bounds", below + step - 1) < F.col("_key"), step).otherwise(0))
    ranged = df.withColumn("_bounds", bounds).withColumn("_key", key).withColumn(
        "_range", F.coalesce(bounds_below, F.lit(0))).drop("_bounds", "_key")

    # at most ``buckets`` + 1 rows from here on, whatever the size of ``df``
    sums = ranged.groupBy("_range").agg(*[F.sum(w).alias(f"_sum_{b}") for (b, _), w in weights.items()])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = sums.select(
        "_range",
        *[F.coalesce(F.sum(f"_sum_{b}").over(earlier), F.lit(0)).alias(f"_offset_{b}") for b, _ in weights],
        *[F.sum(f"_sum_{b}").over(whole).alias(grand) for b, grand in weights])

    within = W.partitionBy("_range").orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
    totals = {b: F.col(f"_offset_{b}") + F.coalesce(F.sum(w).over(within), F.lit(0)) for (b, _), w in weights.items()}
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumns(totals)
        .drop("_range", *[f"_offset_{b}" for b, _ in weights])
    )
