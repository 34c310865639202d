"""Packing token pieces into sequences by length patterns fitted with non-negative least squares.

Only the histogram of piece lengths reaches the driver: at most as many numbers as a sequence has
tokens, whatever the number of documents. There, patterns of two and three lengths that nearly fill a
sequence get repeat counts by non-negative least squares; the counts are rounded down and the rest of
the histogram is packed by best fit, decreasing. Spark then numbers the pieces of each length and joins
the numbers to the plan. Where pieces have a position, all patterns are repeated at an even pace, so that the pieces
of a sequence come from about the same part of the order, and sequences are numbered by their first piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.llm.common import checkpointed, numbered
from depotlens.llm.token_chunks import closed, library_encoder, words_and_spaces
from depotlens.llm.words import give_back
from depotlens.session import small_batches

CAPACITY = 2048
END_ID = 0
KEPT_BYTES = 64 << 20  # of chunks in a worker, which the other stages of a pipeline share the executor with
SLICE_BYTES = 1 << 20
TOKENIZER_FILE = "word_bpe_49k.json"
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLAN = "length bigint, first bigint, last bigint, base bigint, offset bigint"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: its ids and a closing 0, cut only where longer than ``capacity``.

    A NULL or empty text is the closing id alone. The ids themselves are returned as their CRC-32.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, specials = library_encoder(tokenizer_path, most_bytes=KEPT_BYTES)
        for batch in batches:
            for tokens in encoder.tokens(batch.column("text"), words_and_spaces, specials, SLICE_BYTES):
                ids, bounds = closed(tokens, END_ID)
                size = np.diff(bounds)
                n = -(-size // capacity)
                row = np.repeat(np.arange(tokens.rows), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                raw, at = memoryview(ids.astype("<u4")).cast("B"), 4 * (bounds[row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(tokens.first + row)), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


def length_patterns(present: np.ndarray, capacity: int, companions: int = 24) -> np.ndarray:
    """Patterns of two or three present lengths, each completed by the longest length that still fits.

    Rows of three lengths, 0 where a pattern has two. Patterns that leave over 3 % free are left out.
    """
    present = np.sort(present)
    if not len(present):
        return np.zeros((0, 3), int)

    def longest(room: np.ndarray) -> np.ndarray:
        at = np.searchsorted(present, room, "right") - 1
        return np.where(at >= 0, present[np.maximum(at, 0)], 0)

    pairs = [np.stack([present, longest(capacity - present - k), 0 * present], 1) for k in (0, 1, 2)]
    picks = present[np.unique(np.linspace(0, len(present) - 1, companions).astype(int))]
    a, b = (x.ravel() for x in np.meshgrid(present, picks, indexing="ij"))
    triples = np.stack([a, b, longest(capacity - a - b)], 1)[a + b < capacity]
    found = np.concatenate([*pairs, triples])
    found = np.unique(np.sort(found, 1), axis=0)
    filled = found.sum(1)
    return found[(filled <= capacity) & (filled >= 0.97 * capacity)]


def fitted_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that brings ``sum x * pattern`` close to the histogram, by multiplicative updates."""
    if not len(patterns):
        return np.zeros(0)
    wanted = histogram.astype(float)
    wanted[0] = 0.0
    size = len(histogram)
    toward = wanted[patterns].sum(1)
    x = np.where(toward > 0, 1.0, 0.0)
    for _ in range(rounds):
        made = sum(np.bincount(patterns[:, k], x, size) for k in range(patterns.shape[1]))
        made[0] = 0.0
        now = made[patterns].sum(1)
        x *= np.divide(toward, now, out=np.zeros_like(x), where=now > 0)
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, on counts: (lengths of a sequence, how many such sequences)."""
    free: dict[int, dict[tuple[int, ...], int]] = {}

    def put(content: tuple[int, ...], n: int) -> None:
        if n:
            place = free.setdefault(capacity - sum(content), {})
            place[content] = place.get(content, 0) + n

    for length in range(len(histogram) - 1, 0, -1):
        left = int(histogram[length])
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                each = capacity // length
                put((length,) * each, left // each)
                put((length,) * (left % each), 1 if left % each else 0)
                left = 0
                continue
            content, n = next(iter(free[room].items()))
            each = room // length
            used = min(n, left // each)
            take = each
            if not used:
                used, take = 1, left
            free[room][content] -= used
            if not free[room][content]:
                del free[room][content]
                if not free[room]:
                    del free[room]
            put(content + (length,) * take, used)
            left -= used * take
    return [(content, n) for place in free.values() for content, n in place.items()]


def packing_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that use every length exactly as often as the histogram says."""
    left = histogram.astype(np.int64).copy()
    plan = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = length_patterns(np.flatnonzero(left), capacity)
    counts = np.floor(fitted_counts(patterns, left)).astype(np.int64)
    for k in np.argsort(-counts, kind="stable"):
        if counts[k] < 1:
            break
        lengths, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        n = min(int(counts[k]), int((left[lengths] // times).min()))
        if n:
            left[lengths] -= n * times
            plan.append((tuple(int(x) for x in patterns[k] if x), n))
    return plan + best_fit(left, capacity)


def _in_order(stored: DataFrame, plan: list[tuple[tuple[int, ...], int]], position: str) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, along ``position``.

    Repeat k of n of a pattern is due at (k + 1/2) / n of the way. The slots of a length take its pieces in the order of
    their times, and a sequence is numbered by, and begins with, its first piece.
    """
    spark, columns = stored.sparkSession, stored.columns
    patterns = spark.createDataFrame([(i, list(map(int, x)), int(n)) for i, (x, n) in enumerate(plan)],
                                     "pattern int, lengths array<bigint>, repeats bigint")
    # a pattern with many repeats is listed in pieces of so many
    step = 4096
    runs = patterns.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(repeats - 1) div {step}"))))
    each = runs.repartition("pattern", "run").withColumn("repeat", F.explode(F.sequence(
        F.col("run") * step, F.least((F.col("run") + 1) * step, F.col("repeats")) - 1)))
    slots = each.withColumn("time", (F.col("repeat") + 0.5) / F.col("repeats")).select(
        "pattern", "repeat", "time", F.posexplode("lengths").alias("nth", "length"))
    slots = numbered(slots, ["length"], ["time", "pattern", "repeat", "nth"], "_rank", part=F.col("time"))

    last = stored.agg(F.max(position)).first()[0] or 0
    order = [position, "doc_id", "piece", "start", "ids_crc32"]
    ranked = numbered(stored, ["length"], order, "_rank", part=F.col(position) / (last + 1))
    placed = ranked.join(slots.select("length", "_rank", "pattern", "repeat"), ["length", "_rank"])
    within = W.partitionBy("pattern", "repeat").orderBy(*order)
    placed = checkpointed(placed.withColumns({
        "offset": F.coalesce(F.sum("length").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_first": F.min(position).over(within)}))
    sequences = numbered(placed.where("offset = 0").select("pattern", "repeat", "_first"), [],
                         ["_first", "pattern", "repeat"], "sequence_id", part=F.col("_first") / (last + 1))
    return placed.join(sequences.select("pattern", "repeat", "sequence_id"), ["pattern", "repeat"]).select(
        *columns, "sequence_id", "offset")


def packed(cut: DataFrame, capacity: int = CAPACITY, position: str | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``length`` from 1 to ``capacity``; every piece is placed.

    With ``position``, a column of whole numbers from 0 with few rows each, pieces of each length are used in its
    order and the first pieces of the sequences ascend in it.
    """
    spark = cut.sparkSession
    with small_batches(spark):
        stored = checkpointed(cut)
    histogram = np.zeros(capacity + 1, np.int64)
    for row in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[row.length] = row.n
    found = packing_plan(histogram, capacity)
    if position is not None:
        return _in_order(stored, found, position)
    rows, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, n in found:
        offset = 0
        for length in lengths:
            rows.append((int(length), int(used[length]), int(used[length]) + n - 1, base, offset))
            used[length] += n
            offset += int(length)
        base += n
    plan = spark.createDataFrame(rows, PLAN)
    ranked = numbered(stored, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_rank")
    # the plan has a few rows per length, however many pieces there are
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & F.col("_rank").between(
        F.col("first"), F.col("last")))
    return placed.select(*[ranked[c] for c in cut.columns],
                         (F.col("base") + F.col("_rank") - F.col("first")).alias("sequence_id"), plan["offset"])
