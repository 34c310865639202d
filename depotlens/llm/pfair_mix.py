"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. With weight w of W, block j of a source is released at floor(jW/w) and
due at ceil((j+1)W/w); the earliest deadline among the released blocks goes next. The schedule repeats
every W slots, so one period of it is computed and every block finds its place by its number: block j
is in period j div w, in the slot that the period gives to block j mod w.

Weights are exact: they are brought to their common period W, however many sources there are. If that is longer
than ``PERIOD_SLOTS``, one task schedules block after block in bounded memory instead of repeating a period.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from numbers import Rational

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.llm.common import numbered, sized_broadcast

RESOLUTION = 1000
SLOTS = 10_000
PERIOD_SLOTS = 1_000_000
BLOCK_ROWS = 16
NO_SOURCE = ""


def exact_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """The smallest whole weights in the same proportions. A float counts as the decimal number it is written as."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) if isinstance(w, Rational) else Fraction(str(w)) for s, w in weights.items()}
    common = math.lcm(*[x.denominator for x in exact.values()])
    whole = {s: int(x * common) for s, x in exact.items()}
    divisor = math.gcd(*whole.values())
    return {s: w // divisor for s, w in whole.items()}


def schedule(weights: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """All blocks in their order, as (source, block, release, deadline), with one block per source in memory.

    The earliest deadline among the released blocks goes next; a source that has run out leaves its slots to the others.
    """
    length = sum(weights.values())

    def job(s: str, j: int) -> tuple[int, int, str, int]:
        return j * length // weights[s], -(-(j + 1) * length // weights[s]), s, j

    waiting, ready, slot = [job(s, 0) for s in weights if blocks[s]], [], 0
    heapq.heapify(waiting)
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        yield s, j, release, deadline
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, job(s, j + 1))
        slot += 1


def whole_weights(weights: Mapping[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Weights as whole slots of a period: at least one each, ``resolution`` in all or as many as there are sources."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total, slots = sum(weights.values()), max(resolution, len(weights))
    exact = {s: w / total * slots for s, w in weights.items()}
    whole = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (whole[s] - exact[s], s))
    while sum(whole.values()) < slots:
        for s in by_rest[:slots - sum(whole.values())]:
            whole[s] += 1
    while sum(whole.values()) > slots:
        most = max(whole, key=lambda s: (whole[s] - exact[s] if whole[s] > 1 else -1, s))
        whole[most] -= 1
    return whole


def period(weights: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """One period of the schedule as (source, block in the period, slot), slots from 0.

    The length of a period is the sum of the weights, whatever the data.
    """
    length = sum(weights.values())
    jobs = [(j * length // w, -(-(j + 1) * length // w), s, j) for s, w in weights.items() for j in range(w)]
    jobs.sort()
    ready, placed, i = [], [], 0
    for slot in range(length):
        while i < length and jobs[i][0] <= slot:
            heapq.heappush(ready, (jobs[i][1], jobs[i][2], jobs[i][3]))
            i += 1
        _, source, j = heapq.heappop(ready)
        placed.append((source, j, slot))
    return placed


def _placed_blocks(spark, weights: Mapping[str, int], blocks: Mapping[str, int]) -> DataFrame:
    """``schedule`` as rows, made by one task; each block is a row."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = "_source", "block", "release", "deadline", "position"
        kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
        for batch in batches:
            out = []
            for n, (s, j, release, deadline) in enumerate(schedule(weights, blocks) if batch.num_rows else ()):
                out.append((s, j, release, deadline, n))
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], columns)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], columns)

    return spark.range(1, numPartitions=1).mapInArrow(
        place, "_source string, block bigint, release bigint, deadline bigint, position bigint")


def target_weights(docs: DataFrame, source: str = "source", size: str | None = None, slots: int = SLOTS) -> dict[str, int]:
    """Shares of ``slots`` in proportion to the square roots of the sources' sums of ``size``, or of their rows.

    Large sources are sampled more, but less than they are larger. Shares are whole and add up to ``slots``, or to the
    number of sources if there are more, so the period of the mix does not grow with the data. NULL sizes count 0.
    """
    weight = F.count(F.lit(1)) if size is None else F.coalesce(F.sum(size), F.lit(0))
    rows = docs.groupBy(F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("_source")).agg(weight.alias("w")).collect()
    return whole_weights({r._source: math.sqrt(max(r.w, 1)) for r in rows}, slots) if rows else {}


def in_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(_id, _position): the first position of every key in the mix to :func:`target_weights` by bytes of text.

    Only keys, sources and sizes are scheduled. Own columns of ``docs`` may be called like the two.
    """
    ids = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.octet_length(text).alias("bytes"))
    return mixed(ids, target_weights(ids, size="bytes")).groupBy(F.col("doc_id").alias("_id")).agg(
        F.min("position").alias("_position"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, key: str = "doc_id", source: str = "source",
          block_rows: int = BLOCK_ROWS, default_weight: float = 1.0, resolution: int | None = None) -> DataFrame:
    """Add ``block``, ``release``, ``deadline`` and ``position`` of each row's block in the mix.

    Sources that ``weights`` does not name have ``default_weight``; a NULL source is the source ''.
    Rows of a source are put into blocks by the hash of their key. While all sources last, each has had
    its weighted share of the positions to less than one block at any point; when one has run out, the
    others go on in the same order, and ``position`` stays without gaps. The last block of a source may
    be short. Every row is kept; own columns named as the new ones are replaced. The sources are few: they are listed
    on the driver. Weights are exact unless a ``resolution`` is given, to which they are rounded then.
    """
    spark = docs.sparkSession
    docs = docs.drop("block", "release", "deadline", "position")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("_source"),
                       F.xxhash64(key).alias("_shuffled"), F.col(key).alias("_key"))
    counts = {r._source: r.n for r in rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    given = {s: (weights or {}).get(s, default_weight) for s in counts}
    whole = (exact_weights(given) if resolution is None else whole_weights(given, resolution)) if counts else {}
    length = sum(whole.values()) or 1
    blocks = numbered(rows, ["_source"], ["_shuffled", "_key"], "_number").withColumn(
        "block", F.expr(f"_number div {block_rows}"))
    if length > PERIOD_SLOTS:
        placed = sized_broadcast(_placed_blocks(spark, whole, {s: -(-n // block_rows) for s, n in counts.items()}))
        return blocks.join(placed, ["_source", "block"]).select("_doc.*", "block", "release", "deadline", "position")
    plan = spark.createDataFrame(
        [(s, whole[s], j, slot) for s, j, slot in period(whole)],
        "_source string, _weight bigint, _in_period bigint, _slot bigint")
    of_source = plan.select("_source", "_weight").distinct()
    placed = blocks.join(F.broadcast(of_source), "_source").withColumns({
        "_period": F.expr("block div _weight"), "_in_period": F.col("block") % F.col("_weight"),
        "release": F.expr(f"block * {length} div _weight"),
        "deadline": F.expr(f"((block + 1) * {length} + _weight - 1) div _weight"),
    }).join(F.broadcast(plan.drop("_weight")), ["_source", "_in_period"])

    # blocks before a period, and in a period those in earlier slots: sums over the sources, not over the rows
    totals = F.array(*[F.struct(F.lit(-(-n // block_rows)).cast("bigint").alias("b"), F.lit(whole[s]).cast("bigint").alias("w"))
                       for s, n in counts.items()]).cast("array<struct<b:bigint,w:bigint>>")
    slots = placed.select("_period", "_slot").distinct()
    before = F.aggregate(totals, F.lit(0).cast("bigint"),
                         lambda acc, x: acc + F.least(x.b, F.col("_period") * x.w))
    order = W.partitionBy("_period").orderBy("_slot")
    positions = slots.select("_period", "_slot", (before + F.row_number().over(order) - 1).alias("position"))
    return placed.join(positions, ["_period", "_slot"]).select(
        "_doc.*", "block", "release", "deadline", "position")
