"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A document is the mix of the shapes of its words (length, case, last character) and of how much it
repeats itself; a truncated singular value decomposition of a bounded labelled sample gives the space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.words import Words, windows, words_of

SAMPLE_PER_CLASS = 2000
DIMENSIONS = 24
NEIGHBOURS = 25
SHARPNESS = 8
BLOCK_ROWS = 512
THRESHOLD = 0.3

_LENGTHS = np.array([0, 1, 2, 3, 4, 6, 8, 11, 16])  # lower bounds of the length classes, in bytes
_SHAPES, _TAILS = 5, 5
TERMS = len(_LENGTHS) * _SHAPES * _TAILS
REPEATED = TERMS
FEATURES = TERMS + 1


@dataclass
class Model:
    """What every task needs: term weights, projection, labelled vectors and labels, share of label 1."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _byte_classes() -> dict[str, np.ndarray]:
    table = {name: np.zeros(256, bool) for name in ("upper", "digit", "letter", "stop", "shout", "symbol")}
    table["upper"][65:91] = True
    table["digit"][48:58] = True
    table["letter"][97:123] = table["letter"][65:91] = table["letter"][128:] = True
    table["stop"][[ord(c) for c in ".,;:"]] = True
    table["shout"][[ord(c) for c in "!?"]] = True
    table["symbol"][[ord(c) for c in "#*$%&|<>@~^_=+"]] = True
    return table


def features(words: Words) -> np.ndarray:
    """One row of term shares per text; a text without words is all zeros."""
    classes = _byte_classes()
    start, end = words.start, words.end

    def inside(name: str) -> np.ndarray:
        sums = np.zeros(len(words.data) + 1, np.int64)
        np.cumsum(classes[name][words.data], out=sums[1:])
        return sums[end] - sums[start]

    upper, digits, letters = inside("upper"), inside("digit"), inside("letter")
    last = words.data[end - 1] if len(end) else words.data[:0]
    first_upper = classes["upper"][words.data[start]] if len(start) else np.zeros(0, bool)
    shape = np.select([digits > 0, (upper >= 2) & (upper == letters), (upper == 1) & first_upper, upper == 0],
                      [3, 2, 1, 0], 4)
    tail = np.select([classes[c][last] for c in ("letter", "stop", "shout", "symbol")], [0, 1, 2, 3], 4)
    length = np.searchsorted(_LENGTHS, end - start, "right") - 1
    term = (length * _SHAPES + shape) * _TAILS + tail
    out = np.zeros((words.rows, FEATURES), np.float32)
    counts = np.bincount(words.row * TERMS + term, minlength=words.rows * TERMS).reshape(words.rows, TERMS)
    n = np.bincount(words.row, minlength=words.rows)
    out[:, :TERMS] = counts / np.maximum(n, 1)[:, None]
    row, value = windows(words, 3)
    if len(row):
        key = value + row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        key.sort()
        # repeats after the first, credited to texts by way of a second pass over the windows
        twice = np.unique(key[1:][key[1:] == key[:-1]])
        if len(twice):
            own = value + row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
            at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
            hits = np.bincount(row[twice[at] == own], minlength=words.rows)
            out[:, REPEATED] = hits / np.maximum(n, 1)
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in words_of(batch.column("text"), fold_case=False):
            rows = batch.slice(words.first, words.rows)
            yield pa.RecordBatch.from_arrays(
                [rows.column("label").cast(pa.int32()),
                 pa.array([x.tobytes() for x in features(words)], pa.binary())], ["label", "features"])


def held_out(key: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the key as text divisible by 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, dimensions: int = DIMENSIONS) -> Model:
    """Learn from at most ``sample_per_class`` labelled rows of each class, those with the smallest key hashes.

    Held-out rows and rows without a 0/1 label are skipped; of several labels of a key the highest counts, of several
    texts the first in order. The sample is bounded, so it may be gathered and broadcast. Without labelled rows every
    score is 0.5.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    keyed = usable.groupBy("doc_id").agg(F.max("quality").alias("label")).withColumn("_h", F.xxhash64("doc_id"))
    keyed = keyed.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    shares = {r.label: r.n for r in keyed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = None
    for label in (0, 1):
        part = keyed.where(F.col("label") == label).orderBy("_h", "doc_id").limit(sample_per_class)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "label")), "doc_id").groupBy(
        "doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    got = texts.select("label", "text").mapInArrow(_feature_rows, "label int, features binary").toArrow()
    prior = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    y = got.column("label").to_numpy().astype(np.float32)
    x = np.frombuffer(b"".join(got.column("features").to_pylist()), np.float32).reshape(-1, FEATURES)
    order = np.lexsort([*x.T[::-1], y])  # the same model whatever the order of the rows
    x, y = np.sqrt(x[order]), y[order]
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    weights[REPEATED] = 4.0
    if len(x):
        _, _, v = np.linalg.svd((x * weights).astype(np.float64), full_matrices=False)
        projection = v[:dimensions].T.astype(np.float32)
    else:
        projection = np.zeros((FEATURES, dimensions), np.float32)
    return Model(weights, projection, _unit(x * weights @ projection), y, prior)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def votes(model: Model, x: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: int = SHARPNESS) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by a power of their cosine.

    Cosines with all labelled vectors are computed in blocks of rows. A zero vector gets the share of
    label 1 among the labelled rows.
    """
    out = np.full(len(x), model.prior)
    if not len(model.labels):
        return np.full(len(x), 0.5)
    for at in range(0, len(x), BLOCK_ROWS):
        unit = _unit(np.sqrt(x[at:at + BLOCK_ROWS]) * model.weights @ model.projection)
        cosine = unit @ model.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, 1), 0, 1).astype(np.float64) ** sharpness
        total = weight.sum(1)
        share = np.divide((weight * model.labels[near]).sum(1), total, out=np.full(len(unit), model.prior), where=total > 0)
        out[at:at + BLOCK_ROWS] = share
    return np.clip(out, 0, 1)


def _broadcast(docs: DataFrame, model: Model):
    """The model's arrays. A broadcast object of a class of this package could not be read where workers lack it."""
    return docs.sparkSession.sparkContext.broadcast(
        (model.weights, model.projection, model.vectors, model.labels, model.prior))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every document, in one pass over the texts and without a shuffle.

    NULL and empty texts have a score too; repeated rows are scored like any others.
    """
    shared = _broadcast(docs, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("text"), fold_case=False):
                rows = batch.slice(words.first, words.rows)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(votes(Model(*shared.value), features(words)), pa.float64())],
                    ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(score, "doc_id bigint, score double")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns.

    The score is computed beside the row it belongs to, so nothing is joined or shuffled.
    """
    shared = _broadcast(docs, model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("text"), fold_case=False):
                passed = votes(Model(*shared.value), features(words)) >= threshold
                yield batch.slice(words.first, words.rows).filter(pa.array(passed))

    return docs.mapInArrow(keep, docs.schema)
