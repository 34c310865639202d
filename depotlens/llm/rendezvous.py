"""Sharding by weighted rendezvous hashing of record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score for ``key``: -weight / ln(u), u the hash of key and shard in (0, 1).

    A shard draws records in proportion to its weight. A new shard takes records only into itself; a
    NULL key is a key like any other. Weights must be positive.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    # 52 random bits, moved half a step off 0 and 1
    scores = [
        F.struct(
            (-float(w) / F.ln((F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 12) + 0.5) / float(1 << 52))
             ).alias("score"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
    ]
    best = F.array_max(F.array(*scores)) if len(scores) == 1 else F.greatest(*scores)
    return best.getField("shard")


def assigned(docs: DataFrame, key: str, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """Add ``shard``, and ``grown_shard`` for the same shards and one more of ``new_weight``."""
    return docs.withColumn("shard", shard_of(F.col(key), weights)).withColumn(
        "grown_shard", shard_of(F.col(key), [*weights, new_weight]))
