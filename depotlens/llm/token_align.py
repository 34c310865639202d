"""Alignment of the tokens of two vocabularies over the same bytes.

Per batch, pandas ``merge_asof`` keyed by document finds for the start of each token the token of the other side that
covers it. Both directions together are all overlaps, and equal ends close groups. How often a pair of ids is linked in
the whole corpus is counted per batch first and then by shuffle. The ``HOT_PAIRS`` most frequent pairs, a table of
bounded size, are looked up where the documents are read; all other pairs are joined by shuffle, so that neither a
pair that every document has nor the number of different pairs weighs on one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.llm.common import stored
from depotlens.llm.token_chunks import ChunkEncoder, Tokens, before_spaces, byte_level, library_encoder, piece_encoder
from depotlens.llm.words import column_bytes

BYTE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
HOT_PAIRS = 1 << 17
SLICE_BYTES = 2 << 20
MERGE_TOKENS = 500_000
KEPT_BYTES = 64 << 20  # of chunks, on each side

ALIGNED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "pairs array<bigint>, times array<bigint>")


@dataclass
class Side:
    """Tokens of one vocabulary: row, id, first byte and the byte after the last one."""

    row: np.ndarray
    id: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _side(tokens: Tokens, sizes: np.ndarray, kept: np.ndarray, at: np.ndarray) -> Side:
    """The tokens of the rows ``kept``; ``at`` tells where each row's bytes begin."""
    row = np.repeat(np.arange(tokens.rows), np.diff(tokens.bounds))
    mine = kept[row]
    row, ids = row[mine], tokens.ids[mine]
    size = sizes[ids]
    own = np.where(kept, np.diff(at), 0)
    end = np.cumsum(size) + (at[:-1] - np.cumsum(own) + own)[row]
    return Side(row, ids, end - size, end)


def overlaps(a: Side, b: Side, ends: np.ndarray, most: int = MERGE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping tokens as positions in ``a`` and ``b``; ``ends`` are the ends that both sides share.

    No token crosses a shared end, so long inputs are merged in stretches between such ends.
    """
    stops = np.unique(ends[np.searchsorted(ends, a.end[most - 1::most])]) if len(a.end) > most else ends[:0]
    stops = np.unique(np.append(stops, ends[-1:]))
    found, from_a, from_b = [], 0, 0
    for stop in stops:
        to_a, to_b = np.searchsorted(a.end, stop, "right"), np.searchsorted(b.end, stop, "right")
        left = pd.DataFrame({"at": a.start[from_a:to_a], "doc": a.row[from_a:to_a], "a": np.arange(from_a, to_a)})
        right = pd.DataFrame({"at": b.start[from_b:to_b], "doc": b.row[from_b:to_b], "b": np.arange(from_b, to_b)})
        over_a = pd.merge_asof(left, right, on="at", by="doc")
        over_b = pd.merge_asof(right, left, on="at", by="doc")
        # a link of two tokens with one start is found from both sides: keep it once
        inside = over_b["at"].to_numpy() > a.start[over_b["a"].to_numpy()]
        found += [(over_a["a"].to_numpy(), over_a["b"].to_numpy()),
                  (over_b["a"].to_numpy()[inside], over_b["b"].to_numpy()[inside])]
        from_a, from_b = to_a, to_b
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _group_texts(a: Side, b: Side, ends: np.ndarray, decimals: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;...`` for all groups, and of each token in them its row and where its text ends."""
    group_a, group_b = np.searchsorted(ends, a.end), np.searchsorted(ends, b.end)
    order_a = np.arange(len(group_a)) + np.searchsorted(group_b, group_a, "left")
    order_b = np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")
    third = len(decimals) // 3  # three texts per id: with a comma, with a bar, with a semicolon
    text, row = np.zeros(len(order_a) + len(order_b), np.int64), np.zeros(len(order_a) + len(order_b), np.int64)
    text[order_a] = a.id + third * np.isin(a.end, ends, assume_unique=True)
    text[order_b] = b.id + 2 * third * np.isin(b.end, ends, assume_unique=True)
    row[order_a], row[order_b] = a.row, b.row
    data, offsets = column_bytes(decimals.take(pa.array(text)))
    return data, row, offsets[1:]


def _aligned_rows(column: pa.Array, a: ChunkEncoder, b: ChunkEncoder) -> Iterator[pa.RecordBatch]:
    """One row per text, see ``aligned``; all columns but doc_id."""
    sizes = [np.array([len(x) for x in side.bytes_of]) for side in (a, b)]
    most = max(map(len, sizes))
    decimals = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], pa.large_string())
    spaced = pc.binary_join_element_wise(" ", column.fill_null(""), "").cast(pa.large_string())
    data, offsets = column_bytes(spaced)
    sides = [side.tokens(spaced, cuts, slice_bytes=SLICE_BYTES) for side, cuts in ((a, byte_level), (b, before_spaces))]
    for in_a, in_b in zip(*sides):
        rows, first = in_a.rows, in_a.first
        at = offsets[first:first + rows + 1] - offsets[first]
        kept = np.diff(at) > 1  # a single space is an empty text
        for encoder, tokens in ((a, in_a), (b, in_b)):
            wrong = np.flatnonzero(~encoder.sound[tokens.chunk])
            for row in np.unique(np.searchsorted(tokens.chunks, wrong, "right") - 1):
                ids = tokens.ids[tokens.bounds[row]:tokens.bounds[row + 1]]
                own = data[offsets[first + row]:offsets[first + row + 1]].tobytes()
                kept[row] &= b"".join([encoder.bytes_of[i] for i in ids]) == own
        sa, sb = (_side(t, s, kept, at) for t, s in zip((in_a, in_b), sizes))
        ends = np.intersect1d(sa.end, sb.end, assume_unique=True)
        left, right = overlaps(sa, sb, ends)

        n = [np.bincount(x, minlength=rows) for x in (
            sa.row, sb.row, np.searchsorted(at, ends, "left") - 1, sa.row[left])]
        text, row_of, text_end = _group_texts(sa, sb, ends, decimals)
        last = np.searchsorted(row_of, np.arange(rows), "right")
        stop = np.append(0, text_end)[last]
        begin = np.append(0, stop[:-1])
        raw = memoryview(text)
        digests = [hashlib.sha256(raw[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(begin.tolist(), stop.tolist())]

        width = np.int64(most)
        pair, times = np.unique((sa.row[left] * width + sa.id[left]) * width + sb.id[right], return_counts=True)
        row, pair = pair // (width * width), pair % (width * width)
        bounds = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(x) for x in n], pa.array(digests, pa.string()),
             pa.ListArray.from_arrays(bounds, pa.array((pair // width << 32) | pair % width)),
             pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int64)))],
            ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row of ``docs``.

    ``pairs`` holds each linked pair of ids of the document once, as a * 2**32 + b, and ``times`` its links there. Texts
    that are NULL, empty or not spelt out by the tokens of either side have no tokens, 0 everywhere and '' as digest.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = library_encoder(byte_path, True, KEPT_BYTES)[0], piece_encoder(piece_path, KEPT_BYTES)
        for batch in batches:
            done = 0
            for found in _aligned_rows(batch.column("text"), a, b):
                ids = batch.column("doc_id").slice(done, found.num_rows)
                done += found.num_rows
                yield pa.RecordBatch.from_arrays([ids, *found.columns], ["doc_id", *found.schema.names])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(read, ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): links per pair of ids over all documents, and whether no pair with the same b has more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch.column("pairs").flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy()
            order = np.argsort(pair)
            pair = pair[order]
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            n = np.add.reduceat(times[order], first) if len(first) else times
            yield pa.RecordBatch.from_arrays([pa.array(pair[first]), pa.array(n)], ["pair", "n"])

    counted = found.select("pairs", "times").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(
        F.sum("n").alias("n"))
    # at most as many rows share b as the first vocabulary has ids
    of_b = W.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))
    return counted.withColumn("best", F.col("n") == F.max("n").over(of_b))


def scored(found: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(_row, n_best, count_sum) for each ``_row`` of ``found``, which tells its rows apart.

    ``n_best`` counts links whose pair is a best one of its b, ``count_sum`` adds up the corpus-wide counts of all
    links. Both tables are read more than once and should be stored.
    """
    hot = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).toArrow().sort_by("pair")
    known, n, best = (hot.column(c).to_numpy() for c in ("pair", "n", "best"))
    best = best.astype(np.int64)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            pair = pairs.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for total, weight in zip(sums, (best, n)):
                np.add.at(total, row[hit], weight[at[hit]] * times[hit])
            cold = pa.array(row[~hit])
            ids = batch.column("_row")
            blank = pa.array(np.zeros(len(cold), np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([ids, ids.take(cold)]),
                # a row of its own for what was found here: its negative number is no pair
                pa.concat_arrays([pa.array(-1 - ids.to_numpy()), pa.array(pair[~hit])]),
                pa.concat_arrays([pa.array(np.zeros(batch.num_rows, np.int64)), pa.array(times[~hit])]),
                *[pa.concat_arrays([pa.array(s), blank]) for s in sums]],
                ["_row", "pair", "times", "n_best", "count_sum"])

    sent = found.select("_row", "pairs", "times").mapInArrow(
        look_up, "_row bigint, pair bigint, times bigint, n_best bigint, count_sum bigint")
    met = sent.join(counts, "pair", "left")
    return met.groupBy("_row").agg(
        F.sum(F.col("n_best") + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count_sum") + F.col("times") * F.coalesce("n", F.lit(0))).alias("count_sum"))


def alignment(docs: DataFrame, byte_path: str, piece_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    Rows that repeat a doc_id or have none are rows of their own; texts without tokens have zeros and ''.
    """
    found = stored(aligned(docs, byte_path, piece_path).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    sums = scored(found, stored(pair_counts(found), "pair-counts"), hot_pairs)
    return found.drop("pairs", "times").join(sums, "_row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
