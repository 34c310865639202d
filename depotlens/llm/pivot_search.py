"""Exact top-k inner products with a pivot-distance index.

Components become whole numbers. A vector is keyed by its nearest pivot and its distance to it; the
vectors of a pivot are cut into rings of equal width. For a query q at distance D from a pivot and a
ring [lo, hi] whose longest vector is M, the triangle inequality gives |q - v| >= gap, the distance of D
from [lo, hi], so q.v <= (|q|^2 + M^2 - gap^2) / 2, and also q.v <= |q| M. Rings are visited in order of
the gap from the query's own ring on, and those whose bound is below the k-th score already known are
never visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.llm.common import checkpointed

SCALE = 1024
TOP = 10
PIVOTS = 24
RINGS = 24
BLOCK = 2048
QUERY_BLOCK = 256
INDEXED = "vec_id bigint, dim int, pivot int, distance double, norm double, is_query boolean, v binary"
_EXACT = float(1 << 53)


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products; in floating point where every sum stays exact."""
    if a.size and b.size and float(abs(a).max()) * float(abs(b).max()) * a.shape[1] < _EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per query the places of its best rows without its own: higher scores, then smaller ids."""
    for i in range(len(scores)):
        allowed = np.flatnonzero(ids != own[i])
        line = scores[i, allowed]
        if len(line) > top:
            least = np.partition(line, len(line) - top)[len(line) - top]
            allowed, line = allowed[line >= least], line[line >= least]
        yield i, allowed[np.lexsort((ids[allowed], -line))[:top]]


def whole_vectors(df: DataFrame, key: str, vector: str, is_query, scale: int = SCALE) -> DataFrame:
    """(vec_id, q, is_query) with floor(scale * x) for each component; unusable vectors are left out.

    A vector that is NULL or empty or holds a NULL or non-finite component, and a row without a key, is unusable.
    """
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return df.where((F.size(vector) > 0) & finite & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("vec_id"), x.alias("q"), F.coalesce(is_query, F.lit(False)).alias("is_query"))


def _indexed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Key every vector by its nearest pivot and distance. Lengths of vector without a pivot use the origin."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                q = part.column("q")
                sizes = q.value_lengths().to_numpy()
                for dim in np.unique(sizes):
                    rows = part.filter(pa.array(sizes == dim))
                    v = rows.column("q").flatten().to_numpy().reshape(-1, dim).astype("<i8")
                    p = pivots.get(int(dim), np.zeros((1, dim)))
                    x = v.astype(np.float64)
                    away = np.stack([np.linalg.norm(x - c, axis=1) for c in p], 1)
                    near = away.argmin(1)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("vec_id"), pa.array(np.full(len(v), dim), pa.int32()),
                         pa.array(near, pa.int32()), pa.array(away[np.arange(len(v)), near]),
                         pa.array(np.linalg.norm(x, axis=1)), rows.column("is_query"),
                         pa.array([r.tobytes() for r in v], pa.binary())],
                        ["vec_id", "dim", "pivot", "distance", "norm", "is_query", "v"])

    return vectors.mapInArrow(assign, INDEXED)


def _block(table: pa.Table, top: int) -> pa.Table:
    """One block of a ring: its vectors in one row, and for the queries among them the k-th score inside the block."""
    dim = table.column("dim")[0].as_py()
    m = _matrix(table.column("v"), dim)
    ids = table.column("vec_id").to_numpy()
    asked = np.flatnonzero(table.column("is_query").to_numpy())
    floors = []
    for at in range(0, len(asked), QUERY_BLOCK):
        some = asked[at:at + QUERY_BLOCK]
        scores = _products(m[some], m)
        floors += [int(scores[i, best[-1]]) if len(best) == top else None
                   for i, best in _best(scores, ids, ids[some], top)]
    first = {c: table.column(c)[0].as_py() for c in ("dim", "pivot", "ring", "part")}
    return pa.table({
        **{c: pa.array([x], pa.int32()) for c, x in first.items()},
        "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary()),
        "query_ids": pa.array([ids[asked].tolist()], pa.list_(pa.int64())),
        "floors": pa.array([floors], pa.list_(pa.int64())),
        "queries": pa.array([[m[i].tobytes() for i in asked]], pa.list_(pa.binary()))})


BLOCKS = ("dim int, pivot int, ring int, part int, ids binary, m binary, query_ids array<bigint>, "
          "floors array<bigint>, queries array<binary>")


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", is_query=None, top: int = TOP,
            pivots: int = PIVOTS, rings: int = RINGS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` highest whole-number inner products of each query row.

    Candidates are all usable rows with vectors of the query's length but those with its own key; ties go to the
    smaller key, fewer than ``top`` candidates are all returned. Repeated rows are candidates each.
    The pivots are the origin and the ``pivots`` vectors with the smallest key hashes: a bounded sample that
    decides only how much is skipped, never a result. Rings are at most pivots x rings a length of
    vector, so what the queries are planned with does not grow; a full ring is cut into blocks.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, key, vector, F.lit(True) if is_query is None else is_query)
    chosen: dict[int, list] = {}
    for row in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(pivots).collect():
        chosen.setdefault(len(row.q), []).append(row.q)
    centres = {dim: np.unique(np.array([[0] * dim, *rows], np.float64), axis=0) for dim, rows in chosen.items()}
    index = checkpointed(_indexed(vectors, centres))

    widths = {r.dim: (r.far or 0) / rings + 1e-9 for r in index.groupBy("dim").agg(F.max("distance").alias("far")).collect()}
    if not widths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair])
    ringed = index.withColumn("ring", F.floor(F.col("distance") / width[F.col("dim")]).cast("int"))
    summary = ringed.groupBy("dim", "pivot", "ring").agg(
        F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.max("norm").alias("longest"),
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("bigint")).alias("asked")).collect()
    parts = spark.createDataFrame([(r.dim, r.pivot, r.ring, -(-r.n // BLOCK)) for r in summary],
                                  "dim int, pivot int, ring int, parts int")
    cell = ["dim", "pivot", "ring"]
    keyed = ringed.join(F.broadcast(parts), cell).withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    blocks = checkpointed(keyed.groupBy(*cell, "part").applyInArrow(lambda t: _block(t, top), BLOCKS))

    limits = {d: [r for r in summary if r.dim == d] for d in widths}
    arrays = {d: tuple(np.array([getattr(r, c) for r in rows]) for c in ("pivot", "ring", "lo", "hi", "longest"))
              for d, rows in limits.items()}

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, query, floor, raw in zip(*(batch.column(c).to_pylist() for c in ("dim", "query_id", "floor", "v"))):
                q = np.frombuffer(raw, "<i8").astype(np.float64)
                pivot, ring, lo, hi, longest = arrays[dim]
                away = np.linalg.norm(centres.get(dim, np.zeros((1, dim))) - q, axis=1)[pivot]
                gap = np.maximum(np.maximum(lo - away, away - hi), 0)
                norm = np.linalg.norm(q)
                bound = np.minimum((norm ** 2 + longest ** 2 - gap ** 2) / 2, norm * longest)
                # slack for rounding: its size is that of the terms, which may cancel out, and its sign is always the same
                bound += 1e-9 * (norm ** 2 + longest ** 2 + gap ** 2 + away ** 2) + 1e-3
                go = np.flatnonzero(bound >= floor) if floor is not None else np.arange(len(pivot))
                go = go[np.argsort(gap[go], kind="stable")]
                n = len(go)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, dim), pa.int32()), pa.array(pivot[go], pa.int32()),
                     pa.array(ring[go], pa.int32()), pa.array(np.full(n, query), pa.int64()),
                     pa.array([floor] * n, pa.int64()), pa.array([raw] * n, pa.binary())],
                    ["dim", "pivot", "ring", "query_id", "floor", "v"])

    asked = blocks.select("dim", F.explode(F.arrays_zip("query_ids", "floors", "queries")).alias("x")).select(
        "dim", F.col("x.query_ids").alias("query_id"), F.col("x.floors").alias("floor"),
        F.col("x.queries").alias("v"))
    # the same key may ask twice; once is enough
    asked = asked.groupBy("dim", "query_id", "v").agg(F.max("floor").alias("floor"))
    planned = asked.select("dim", "query_id", "floor", "v").mapInArrow(
        visits, "dim int, pivot int, ring int, query_id bigint, floor bigint, v binary")
    lists = max(1, -(-sum(r.asked for r in summary) // QUERY_BLOCK))  # lists keep their length as queries grow in number
    groups = planned.groupBy(*cell, F.pmod(F.xxhash64("query_id"), F.lit(lists)).alias("g")).agg(
        F.collect_list(F.struct("query_id", "floor", "v")).alias("qs"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids_, m_, qs in zip(*(batch.column(c) for c in ("dim", "ids", "m", "qs"))):
                ids = np.frombuffer(ids_.as_py(), "<i8")
                m = np.frombuffer(m_.as_py(), "<i8").reshape(-1, dim.as_py())
                qs = qs.as_py()
                for at in range(0, len(qs), QUERY_BLOCK):
                    some = qs[at:at + QUERY_BLOCK]
                    q = np.frombuffer(b"".join(s["v"] for s in some), "<i8").reshape(-1, dim.as_py())
                    own = np.array([s["query_id"] for s in some])
                    scores = _products(q, m)
                    out = [[], [], []]
                    for i, best in _best(scores, ids, own, top):
                        floor = some[i]["floor"]
                        best = best if floor is None else best[scores[i, best] >= floor]
                        out[0] += [own[i]] * len(best)
                        out[1] += ids[best].tolist()
                        out[2] += scores[i, best].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                                     ["query_id", "vec_id", "score"])

    pairs = blocks.select(*cell, "ids", "m").join(groups, cell).select("dim", "ids", "m", "qs")
    found = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
