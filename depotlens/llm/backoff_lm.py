"""Stupid-backoff scores of documents under a bigram model of the corpus, computed relationally.

Counts cover all documents and, as ``min_count`` is 1, all n-grams: every word and bigram has its own count, and no
bigram of the corpus backs off. With a larger ``min_count`` n-grams seen less often are not in the tables; a bigram
that is missing backs off to its second word, and a word that is missing to the pooled count of all such words. The
first word of a text is scored as a word.

    S(w2 | w1) = c(w1 w2) / c(w1)      if the bigram is in its table
               = alpha * c(w2) / N     otherwise

Words are known by 64-bit hashes. So are bigrams of the whole model, together with their part, which follows another
hash; with a larger ``min_count`` they are pairs of word numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.llm.common import checkpointed, numbered, release, sized_broadcast
from depotlens.llm.words import Words, mixed, words_of

ALPHA = 0.4
MIN_COUNT = 1
HOT_SHARE = 2000  # a word is frequent if it stands for more than one in so many of all words
BROADCAST_WORDS = 4_000_000
WORD_BYTES = 64  # a known word in the memory of the driver
DRIVER_SHARE = 4  # known words are broadcast if they fit one of so many parts of it
WORDS_PER_PART = 2_000_000  # occurrences that one partition sorts
COUNT_CLASSES = 16
LIST_ROWS = 256  # bigrams that travel as one list
PACKET_ROWS = 4_000_000
MOST_KNOWN = 3_000_000_000  # two word numbers fit one 64-bit integer
TOP_WORDS = 1 << 18  # the most frequent words, whose counts every task has
COUNT_BINS = 16  # of counts, for each power of two
HOT_PAIRS = 100_000  # a bigram is frequent if it stands for more than one in so many of all words
ASKED_WORDS = 2_000_000  # of one packet of texts, about
CODEC = "zstd"
_STEP, _OTHER = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_U = np.uint64


def _word_ids(words) -> np.ndarray:
    """Word hashes as signed integers; 0 stands for the beginning of a text."""
    return words.hash.view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; every batch is counted before it is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = np.unique(np.concatenate([_word_ids(w) for w in words_of(batch.column("text"))]
                                              or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(words) -> tuple[np.ndarray, np.ndarray]:
    """Every word and the word before it; the first word of a text has the beginning, 0, before it."""
    w2 = _word_ids(words)
    w1 = np.zeros(len(w2), np.int64)
    w1[1:] = w2[:-1]
    w1[1:][words.row[1:] != words.row[:-1]] = 0
    return w1, w2


def bigrams(docs: DataFrame) -> DataFrame:
    """(doc_id, w1, w2): all bigrams, in the order of the texts."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("text")):
                w1, w2 = _pairs(words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(words.first + words.row)), pa.array(w1), pa.array(w2)],
                    ["doc_id", "w1", "w2"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(read, "doc_id bigint, w1 bigint, w2 bigint")


def frequent_pairs(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(w1, w2, c12): counts of the bigrams of two ``frequent`` words; every chunk is counted before it is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("text")):
                pair = np.stack(_pairs(words))
                both = pair[:, np.isin(pair, frequent).all(axis=0)]
                own, n = np.unique(both, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[0]), pa.array(own[1]), pa.array(n.astype(np.int64))], ["w1", "w2", "n"])

    return docs.select("text").mapInArrow(count, "w1 bigint, w2 bigint, n bigint").groupBy("w1", "w2").agg(
        F.sum("n").alias("c12"))


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """(part, docs, grams, n, s) from (doc_id, score, gram): one list of documents and bigrams per part and packet.

    A bigram's part follows its hash. One more row a packet has the number and the sum of each document's scores,
    and no bigrams. Packets grow with the number of parts, up to ``PACKET_ROWS``, so that lists stay long; they
    take a third of the bytes of single rows.
    """
    most = min(LIST_ROWS * parts, PACKET_ROWS)

    def lists(flat, offsets, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))

    def packet(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        docs = table.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode")
        code, ids = docs.indices.to_numpy(), docs.dictionary
        sums = np.bincount(code, table.column("score").to_numpy(), len(ids))
        some = table.column("gram").is_valid().to_numpy()
        gram, code_of = table.column("gram").drop_null().to_numpy(), code[some]
        part = (mixed(gram.view(_U)) % _U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        at = np.flatnonzero(np.diff(part, prepend=-1))
        own = int(mixed(np.array([table.num_rows + len(gram)], _U))[0] % _U(parts))
        k, n = len(gram), len(ids)
        none = [0] * (len(at) + 1)
        return pa.RecordBatch.from_arrays([
            pa.array(np.append(part[at], own), pa.int32()),
            lists(pa.concat_arrays([ids.take(pa.array(code_of[order])), ids]), [*at, k, k + n], pa.int64()),
            lists(gram[order], [*at, k, k], pa.int64()),
            lists(np.bincount(code, minlength=n), [*none, n], pa.int64()),
            lists(sums, [*none, n], pa.float64())], ["part", "docs", "grams", "n", "s"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= most:
                yield packet(waiting)
                waiting, size = [], 0
        if size:
            yield packet(waiting)

    return rows.select("doc_id", "score", "gram").mapInArrow(
        pack, "part int, docs array<bigint>, grams array<bigint>, n array<bigint>, s array<double>")


def most_broadcast(spark) -> int:
    """Known words that are sent to every executor at most; beyond, they are joined by shuffle."""
    memory = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    return min(BROADCAST_WORDS, memory // (DRIVER_SHARE * WORD_BYTES))


def _looked_up(rows: DataFrame, key: str, facts: DataFrame, count: str, broadcast: bool, least: float,
               nothing: int | None = None) -> DataFrame:
    """``rows`` with the ``facts`` of their ``key``, NULL if there are none.

    Without ``broadcast`` the few facts whose ``count`` exceeds ``least`` are sent ahead. Rows that met one, and rows
    whose key is NULL or ``nothing``, are spread over all tasks, so no key weighs down one of them.
    """
    if broadcast:
        return rows.join(F.broadcast(facts), key, "left")
    values = [c for c in facts.columns if c != key]
    top = facts.where(F.col(count) > least).select(key, *[F.col(c).alias(f"_top_{c}") for c in values])
    rest = facts.where(F.col(count) <= least).select(F.col(key).alias("_key"), F.lit(True).alias("_sought"), *values)
    sought = F.col(key).isNotNull() & F.col(f"_top_{count}").isNull()
    if nothing is not None:
        sought &= F.col(key) != nothing
    met = rows.join(F.broadcast(top), key, "left").withColumn("_sought", sought)
    met = met.withColumn("_key", F.when(F.col("_sought"), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    return met.join(rest, ["_key", "_sought"], "left").select(
        *rows.columns, *[F.coalesce(f"_top_{c}", c).alias(c) for c in values])


@dataclass
class Known:
    """What a task knows before it asks: counts of the most frequent words and bigrams of the ``total`` words.

    ``words`` and ``pairs`` rise. ``place`` numbers the frequent ones of ``words`` and is -1 for others, and a pair is
    the place of its first word times ``frequent``, their number, plus that of its second.
    """

    total: int
    words: np.ndarray
    word_logs: np.ndarray
    place: np.ndarray
    frequent: int
    pairs: np.ndarray
    pair_logs: np.ndarray


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key whether it is in the rising ``table``, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers, first all their lowest bytes, then the next ones, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.Codec(CODEC, compression_level=1).compress(planes.tobytes(), asbytes=True)


def _spread(data: bytes, n: int, kind: type) -> np.ndarray:
    """The ``n`` numbers of :func:`_squeezed`."""
    wide = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec(CODEC).decompress(data, n * wide), np.uint8).reshape(wide, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _spots(docs: int) -> type:
    """The narrowest kind of number for the spots of so many documents, twice each and one more."""
    return np.uint16 if 2 * docs < 1 << 16 else np.uint32


def _pair_places(words: Words, table: np.ndarray, place: np.ndarray, frequent: int) -> np.ndarray:
    """Of every word the pair that it and the word before it make, -1 if one is not frequent or there is none before."""
    known, at = _found(table, words.hash)
    own = np.where(known, place[at] if len(table) else -1, -1)
    pair = np.full(len(own), -1, np.int64)
    pair[1:] = own[:-1] * frequent + own[1:]
    pair[1:][(own[:-1] < 0) | (own[1:] < 0) | (words.row[1:] != words.row[:-1])] = -1
    return pair


def _hot_pairs(docs: DataFrame, frequent: np.ndarray, least: float) -> pa.Table:
    """(pair, n): the bigrams of two words of ``frequent``, which rises, that are seen more than ``least`` times."""
    many, place = len(frequent), np.arange(len(frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for words in words_of(batch.column("text")):
                pair = _pair_places(words, frequent, place, many)
                found.append(pair[pair >= 0])
            pairs, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    return docs.select("text").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(
        F.sum("n").alias("n")).where(F.col("n") > least).toArrow().sort_by("pair")


def _known(docs: DataFrame) -> Known:
    """Counts all words, and of them the ``TOP_WORDS`` most frequent, as far as equal counts allow, come to the driver.

    Words that stand for more than one in ``HOT_SHARE`` of all are always among them.
    """
    words = checkpointed(word_counts(docs).withColumn("_bin", F.floor(F.log2("n") * COUNT_BINS).cast("int")))
    bins = sorted(words.groupBy("_bin").agg(F.count(F.lit(1)), F.sum("n")).collect(), reverse=True)
    total = max(sum(n for _, _, n in bins), 1)
    lowest = next((k + 1 for (k, *_), so_far in zip(bins, np.cumsum([c for _, c, _ in bins])) if so_far > TOP_WORDS), 0)
    hot = total / HOT_SHARE
    top = words.where((F.col("_bin") >= lowest) | (F.col("n") > hot)).select("word", "n").toArrow()
    word, n = (c.to_numpy() for c in top.columns)
    order = np.argsort(word.view(_U))
    word, n = word.view(_U)[order], n[order]
    place = np.where(n > hot, np.cumsum(n > hot) - 1, -1)
    pairs, times = (c.to_numpy() for c in _hot_pairs(docs, word[n > hot], total / HOT_PAIRS).columns)
    return Known(total, word, np.log(n), place, int((n > hot).sum()), pairs, np.log(times))


def _asked(words: Words, known: Known, parts: int) -> tuple[np.ndarray, ...]:
    """Hash, part, row and sign of the words and bigrams whose counts a task has to ask for; then of every row the
    number of its words and the sum of what is known.

    The log of a bigram's count adds to the score of its text, that of its first word's count is taken off, and that of
    the first word of the text adds. So the words in the middle count -1, a text's only word 1, its first and last 0.
    """
    w, n = words.hash, len(words.hash)
    begins, ends = np.ones(n, bool), np.ones(n, bool)
    begins[1:] = words.row[1:] != words.row[:-1]
    ends[:-1] = begins[1:]
    sign = begins.astype(np.int8) + ends - 1
    is_top, at = _found(known.words, w)
    hot, pair = _found(known.pairs, _pair_places(words, known.words, known.place, known.frequent))
    size = np.bincount(words.row, minlength=words.rows)
    sums = np.where(size > 0, -math.log(known.total), 0.0)
    sums += np.bincount(words.row[is_top], sign[is_top] * known.word_logs[at[is_top]], words.rows)
    sums += np.bincount(words.row[hot], known.pair_logs[pair[hot]], words.rows)
    second, rest = np.flatnonzero(~begins & ~hot), ~is_top
    w1, w2 = w[second - 1], w[second]
    part = np.concatenate([mixed(w1 + w2 * _U(_OTHER)), mixed(w[rest] * _U(_OTHER))]) % _U(parts)
    return (np.concatenate([mixed(w1 * _U(_STEP) + w2), w[rest]]), part.astype(np.uint16 if parts < 1 << 16 else np.int32),
            np.concatenate([words.row[second], words.row[rest]]).astype(np.int32),
            np.concatenate([np.ones(len(second), np.int8), sign[rest]]), size, sums)


SENT = "packet bigint, n_grams int, times binary, spots binary, docs array<bigint>, n array<bigint>, s array<double>, lists int"


def questions(docs: DataFrame, known: Known, parts: int) -> DataFrame:
    """One row per packet of texts and part: the hashes of the words and bigrams there whose counts are asked for.

    A packet asks once for each, in rising order, so that differences are sent. ``times`` has how often each occurs,
    and ``spots`` whose documents' sums take part, in that order; answers come back with them. One more row a packet,
    without ``grams``, has its documents, their numbers of words, what is known of their sums, and how many lists the packet has.
    """
    def packet(chunks: list, ids: list, seen: int) -> pa.RecordBatch:
        h, part, row, sign, size, sums = map(np.concatenate, zip(*chunks))
        k = len(size)
        spot = np.where(sign > 0, row, np.where(sign < 0, row + k + 1, k)).astype(_spots(k))
        order = np.argsort(part, kind="stable")
        h, spot, part = h[order], spot[order], part[order]
        own = int(mixed(np.array([seen, h.sum(dtype=_U), k], _U) * _U(_STEP)).sum(dtype=_U).astype(np.int64))
        starts = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
        grams, n_grams, times, spots = [], [], [], []
        for a, b in zip(starts, [*starts[1:], len(part)]):
            order = np.argsort(h[a:b])
            rising = h[a:b][order]
            first = np.flatnonzero(np.concatenate([[True], rising[1:] != rising[:-1]]))
            grams.append(_squeezed(np.diff(rising[first], prepend=_U(0))))
            n_grams.append(len(first))
            times.append(_squeezed(np.diff(first, append=b - a).astype(np.uint32)))
            spots.append(_squeezed(spot[a:b][order]))
        n = len(grams)
        last = lambda values: pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [k], pa.int32()), values)
        return pa.RecordBatch.from_arrays([
            pa.array([*part[starts], own % parts], pa.int32()), pa.array([*grams, None], pa.binary()),
            pa.array([own] * (n + 1), pa.int64()), pa.array([*n_grams, None], pa.int32()),
            pa.array([*times, None], pa.binary()), pa.array([*spots, None], pa.binary()),
            last(pa.concat_arrays(ids)), last(pa.array(size, pa.int64())), last(pa.array(sums, pa.float64())),
            pa.array([None] * n + [n], pa.int32())],
            ["part", "grams", "packet", "n_grams", "times", "spots", "docs", "n", "s", "lists"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, ids, rows, waiting, seen = [], [], 0, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for words in words_of(batch.column("text")):
                h, part, row, *figures = _asked(words, known, parts)
                chunks.append((h, part, row + np.int32(rows), *figures))
                ids.append(batch.column("doc_id").slice(words.first, words.rows))
                rows, waiting = rows + words.rows, waiting + len(words.hash)
                if waiting >= ASKED_WORDS or rows >= ASKED_WORDS:  # texts may have no words
                    yield packet(chunks, ids, seen)
                    chunks, ids, rows, waiting, seen = [], [], 0, 0, seen + 1
        if chunks:
            yield packet(chunks, ids, seen)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(ask, f"part int, grams binary, {SENT}")


def answered(asked: DataFrame, parts: int) -> DataFrame:
    """The ``questions`` with ``counts`` over all packets in place of ``grams``, in their order."""
    def counts(lists: pa.Table) -> pa.Array:
        grams, m, times = (lists.column(c).to_pylist() for c in ("grams", "n_grams", "times"))
        full = [i for i, g in enumerate(grams) if g is not None]
        told: list[bytes | None] = [None] * len(grams)
        if full:
            own, inverse = np.unique(np.concatenate([np.cumsum(_spread(grams[i], m[i], _U), dtype=_U) for i in full]),
                                     return_inverse=True)
            n = np.bincount(inverse, np.concatenate([_spread(times[i], m[i], np.uint32) for i in full]), len(own))
            each = n.astype(_U)[inverse]
            ends = np.cumsum([m[i] for i in full])
            for i, end in zip(full, ends):
                told[i] = _squeezed(each[end - m[i]:end])
        return pa.array(told, pa.binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        if not read:
            return
        rows = pa.Table.from_batches(read)
        for part in rows.column("part").unique():
            lists = rows.filter(pc.equal(rows.column("part"), part))
            yield from lists.append_column("counts", counts(lists)).drop_columns(["part", "grams"]).to_batches()

    return asked.repartitionById(parts, F.col("part")).mapInArrow(count, f"{SENT}, counts binary")


def summed(answers: DataFrame) -> DataFrame:
    """(doc_id, n, s) of every row of the documents: all lists of a packet meet and are added up there."""
    def add(packet: pa.Table) -> pa.Table:
        m, times, spots, counts, lists = (packet.column(c).to_pylist() for c in ("n_grams", "times", "spots", "counts", "lists"))
        if [n for n in lists if n is not None] != [len(lists) - 1]:
            raise RuntimeError("lists of a packet are missing: its texts came in another order when they were read again")
        docs, n, s = (packet.column(c).combine_chunks().flatten() for c in ("docs", "n", "s"))
        k = len(docs)
        sums = np.zeros(2 * k + 1)
        for i, own in enumerate(counts):
            if own is not None:
                logs = np.repeat(np.log(_spread(own, m[i], _U)), _spread(times[i], m[i], np.uint32))
                sums += np.bincount(_spread(spots[i], len(logs), _spots(k)), logs, 2 * k + 1)
        return pa.table({"doc_id": docs, "n": n, "s": pa.array(s.to_numpy() + sums[:k] - sums[k + 1:])})

    return answers.groupBy("packet").applyInArrow(add, "doc_id bigint, n bigint, s double")


def _whole_sums(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_score) with every n-gram by its own count, of every document.

    Each task asks for the counts that it does not know, in packets, and gets them back. What is sent is one hash per
    word or bigram of a packet, a number per occurrence and the counts, so disk stays within a multiple of the input
    however many different words there are, and no table of words is broadcast or joined.
    """
    spark = docs.sparkSession
    known = _known(docs)
    release(spark)
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-known.total // WORDS_PER_PART))
    return summed(answered(questions(docs, known, parts), parts)).groupBy("doc_id").agg(
        F.sum("n").alias("n_words"), F.sum("s").alias("log_score"))


def _cut_sums(docs: DataFrame, alpha: float, min_count: int, broadcast_words: int | None) -> DataFrame:
    """(doc_id, n_words, log_score), the last two NULL without words, with n-grams seen ``min_count`` times, 2 at least.

    Known words are numbered, so that a bigram is one integer. Every occurrence first gets the score it has without its
    bigram; bigrams of known words go to the partition of their hash once, are counted there, and those in the table
    correct the sum.

    A word is frequent if it stands for more than one in ``HOT_SHARE`` of all words. Bigrams of two frequent words,
    at most ``HOT_SHARE`` squared, are counted beforehand by partial sums and looked up where the text is read; all
    others are too rare to weigh down a partition. More than ``MOST_KNOWN`` known words raise ``ValueError``.
    """
    spark = docs.sparkSession
    words = checkpointed(word_counts(docs))
    total, rare, known = words.agg(
        F.sum("n"), F.sum(F.when(F.col("n") < min_count, F.col("n"))),
        F.count(F.when(F.col("n") >= min_count, 1))).first()
    total = total or 1
    if known > MOST_KNOWN:
        raise ValueError(f"{known} known words, at most {MOST_KNOWN} can be numbered")
    unknown = math.log(max(rare or 1, 1) / total)
    # numbered by rising count, so that the number tells the count of all but the words of the last class
    last = min_count + COUNT_CLASSES
    classed = words.where(F.col("n") >= min_count).withColumn("_class", F.least("n", F.lit(last)).cast("int"))
    sizes = {r["_class"]: r["count"] for r in classed.groupBy("_class").count().collect()}
    starts = {c: sum(n for k, n in sizes.items() if k < c) for c in range(min_count, last + 1)}
    table = checkpointed(numbered(classed, ["_class"], ["word"], "_rank").withColumn(
        "id", F.col("_rank") + F.element_at(F.lit(list(starts.values())), F.col("_class") - min_count + 1)))
    counted = table.where(F.col("_class") == last).select("id", "n")
    broadcast = known <= (most_broadcast(spark) if broadcast_words is None else broadcast_words)
    frequent = np.array([r.word for r in words.where(F.col("n") > total / HOT_SHARE).select("word").collect()], np.int64)
    pairs = sized_broadcast(frequent_pairs(docs, frequent).where(F.col("c12") >= min_count))

    grams = bigrams(docs)
    for k in "12":
        facts = table.select(F.col("word").alias(f"w{k}"), F.col("n").alias(f"c{k}"), F.col("id").alias(f"id{k}"))
        grams = _looked_up(grams, f"w{k}", facts, f"c{k}", broadcast, total / HOT_SHARE, nothing=0)
    grams = grams.join(pairs, ["w1", "w2"], "left")
    begins = F.col("w1") == 0
    word = F.coalesce(F.log("c2") - math.log(total), F.lit(unknown))
    is_hot = F.least("c1", "c2") > total / HOT_SHARE
    score = F.when(begins, word).when(F.col("c12").isNotNull(), F.log("c12") - F.log("c1")).otherwise(math.log(alpha) + word)
    gram = F.when(~begins & F.col("id1").isNotNull() & F.col("id2").isNotNull() & ~is_hot,
                  F.col("id1") * F.lit(known) + F.col("id2"))
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-total // WORDS_PER_PART))
    sent = packed(grams.select("doc_id", score.alias("score"), gram.alias("gram")), parts)

    one = sent.repartitionById(parts, F.col("part")).select("*", F.posexplode("docs").alias("_pos", "_doc")).select(
        "part", F.col("_doc").alias("doc_id"), F.get("grams", "_pos").alias("gram"), F.get("n", "_pos").alias("n"),
        F.get("s", "_pos").alias("s"))
    c12 = F.count("gram").over(W.partitionBy("gram", "part"))  # sorted by bigram first
    seen = one.withColumn("c12", c12)
    seen = seen.withColumn("_seen", F.when(F.col("c12") >= min_count, F.col("gram"))).select(
        "doc_id", "n", "s", "c12", F.expr(f"_seen div {max(known, 1)}").alias("id1"),
        (F.col("_seen") % max(known, 1)).alias("id2"))
    for k in "12":
        facts = counted.select(F.col("id").alias(f"id{k}"), F.col("n").alias(f"c{k}"))
        seen = _looked_up(seen, f"id{k}", facts, f"c{k}", broadcast, total / HOT_SHARE)
        below = [F.when(F.col(f"id{k}") < starts[c + 1], F.lit(c)) for c in range(min_count, last)]
        seen = seen.withColumn(f"c{k}", F.coalesce(f"c{k}", *below))
    better = F.log("c12") - F.log("c1") - math.log(alpha) - F.log("c2") + math.log(total)
    sums = seen.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.sum("n").alias("n_words"), F.sum(F.coalesce("s", better)).alias("log_score"))
    ids = docs.select(F.col("doc_id").cast("bigint")).distinct()
    return ids.join(sums, ids["doc_id"].eqNullSafe(sums["_doc"]), "left").drop("_doc")


def scores(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT,
           broadcast_words: int | None = None) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every document.

    A text without words, NULL or empty, has 0 words, score 0 and a NULL mean. Rows that repeat a doc_id are
    added up. With ``min_count`` 1 every n-gram has its own count and nothing backs off. With more, up to
    ``broadcast_words`` known words, as many as the driver's memory suits unless given, are looked up by broadcast,
    more of them by shuffle, with the same result.
    """
    sums = _whole_sums(docs) if min_count <= 1 else _cut_sums(docs, alpha, min_count, broadcast_words)
    return sums.select(
        "doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.round(F.coalesce("log_score", F.lit(0.0)), 6).alias("log_score"),
        F.round(F.col("log_score") / F.nullif(F.col("n_words"), F.lit(0)), 9).alias("mean_log_score"))
