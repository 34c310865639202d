"""Token ids in binary files: a static range asymmetric numeral system with interleaved lanes.

A folder of files holds three tables:

    format       one row: version, lanes, bits, tokens per block, tokens per checkpoint
    frequencies  (id, frequency): one table for all blocks, frequencies add up to 2**bits
    blocks       one row per block: its file and number, which documents it holds, and its payload

Documents lie in ascending order of their id. Every file is a range of ids, cut into blocks of equally many tokens that
are coded by themselves. Inside a block token t belongs to lane t % lanes, so numpy codes one token of every lane at a
time. A payload (little-endian) is

    magic, tokens, words, checkpoints, CRC-32 of the ids; per checkpoint the number of words before it and the states
    of all lanes; the words; CRC-32 of all that

The first checkpoint is the beginning. A reader can start at any other as well, so that a task decodes a part of a
block, or only what a document needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.llm.common import stored
from depotlens.llm.token_chunks import byte_level, closed, library_encoder
from depotlens.llm.words import column_bytes

TOKENIZER_FILE = "byte_bpe_50k.json"
END_ID = 2
VERSION = 1
MAGIC = b"RAN1"
LANES = 1024
BITS = 20
BLOCK_TOKENS = 1 << 18
CHECKPOINT_TOKENS = 1 << 17  # a multiple of the lanes
_LOW = 31  # states lie in 2**31 to 2**63 - 1 between tokens
_HEAD, _HEAD_SIZE = "<4sIIII", 20
_U = np.uint64

TOKENS = "doc_id bigint, n_tokens int, ids binary"
BLOCKS = ("file int, block int, first bigint, n_tokens int, doc_ids array<bigint>, doc_starts array<bigint>, "
          "parts array<bigint>, lengths array<bigint>, offsets array<bigint>, payload binary")


@dataclass
class Coding:
    """Frequencies of ids, and the same as numpy needs them."""

    ids: np.ndarray
    frequency: np.ndarray

    def __post_init__(self):
        self.frequency = self.frequency.astype(_U)
        self.before = np.cumsum(self.frequency, dtype=_U) - self.frequency

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id in the table."""
        place = np.zeros(int(self.ids[-1]) + 1 if len(self.ids) else 1, np.uint32)
        place[self.ids] = np.arange(len(self.ids))
        return place[ids]

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every slot its id, the id's frequency, and how far the slot lies into the id's share."""
        times = self.frequency.astype(np.int64)
        n = int(times.sum())
        return (np.repeat(self.ids, times), np.repeat(self.frequency, times),
                np.arange(n, dtype=_U) - np.repeat(self.before, times))


def fitted_frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whole numbers in proportion to positive ``counts``, 1 at least, that add up to ``2**bits``."""
    total = 1 << bits
    if not len(counts):
        return np.zeros(0, np.int64)
    if len(counts) > total:
        raise ValueError(f"{len(counts)} different ids, at most {total} have a frequency")
    share = counts.astype(np.float64) / float(counts.sum())
    found = np.maximum(1, np.floor(share * total)).astype(np.int64)
    order = np.argsort(-found, kind="stable")
    spare = total - int(found.sum())
    if spare > 0:
        found[order[0]] += spare
    while spare < 0:
        cut = np.minimum(found[order] - 1, found[order] * -spare // int(found.sum()) + 1)
        cut = np.diff(np.minimum(np.cumsum(cut), -spare), prepend=0)
        found[order] -= cut
        spare += int(cut.sum())
    return found


def encode(ids: np.ndarray, coding: Coding, lanes: int = LANES, bits: int = BITS,
           checkpoint_tokens: int = CHECKPOINT_TOKENS) -> bytes:
    """The payload of a block."""
    number = coding.numbers(ids)
    f_all, before_all = coding.frequency[number], coding.before[number]
    limit_all, rest_all = f_all << _U(63 - bits), _U(1 << bits) - f_all
    state = np.full(lanes, 1 << _LOW, _U)
    steps, every = -(-len(ids) // lanes), checkpoint_tokens // lanes
    words, marks = [], []
    for step in reversed(range(steps)):
        now = slice(step * lanes, (step + 1) * lanes)
        f = f_all[now]
        x = state[:len(f)]
        full = np.flatnonzero(x >= limit_all[now])
        out = x[full]
        words.append(out)
        x[full] = out >> _U(32)
        # x // f * 2**bits + x % f + before
        x += x // f * rest_all[now] + before_all[now]
        if step % every == 0:
            marks.append((len(words), state.copy()))
    sizes = np.cumsum([0] + [len(w) for w in reversed(words)])
    words.reverse()
    marks.reverse()
    body = [struct.pack(_HEAD, MAGIC, len(ids), int(sizes[-1]), len(marks), zlib.crc32(ids.astype("<u4").tobytes()))]
    for done, states in marks:
        body += [struct.pack("<I", int(sizes[len(words) - done])), states.astype("<u8").tobytes()]
    low = (np.concatenate(words) & _U(0xFFFFFFFF)).astype("<u4") if words else np.zeros(0, "<u4")
    raw = b"".join([*body, low.tobytes()])
    return raw + struct.pack("<I", zlib.crc32(raw))


def decode(payload: bytes, slots: tuple[np.ndarray, np.ndarray, np.ndarray], first: int = 0, last: int | None = None,
           lanes: int = LANES, bits: int = BITS, checkpoint_tokens: int = CHECKPOINT_TOKENS) -> np.ndarray:
    """The ids ``first`` to ``last - 1`` of a block, read from the last checkpoint before them; see ``Coding.slots``.

    A payload that does not have its checksum, and a whole block whose ids do not, raise ``ValueError``.
    """
    raw = memoryview(payload)
    if len(raw) < _HEAD_SIZE + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("a block is damaged: its checksum differs")
    magic, n, n_words, n_marks, crc = struct.unpack(_HEAD, raw[:_HEAD_SIZE])
    if magic != MAGIC:
        raise ValueError(f"not a block of ids: {magic!r}")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    mark, width = first // checkpoint_tokens, 4 + 8 * lanes
    at = _HEAD_SIZE + mark * width
    position = struct.unpack("<I", raw[at:at + 4])[0]
    state = np.frombuffer(raw[at + 4:at + width], "<u8").astype(_U)
    words = np.frombuffer(raw[_HEAD_SIZE + n_marks * width:-4], "<u4").astype(_U)
    begin = mark * checkpoint_tokens
    out = np.zeros(-(-(last - begin) // lanes) * lanes, np.int64)
    id_of, frequency, within = slots
    mask, low = _U((1 << bits) - 1), _U(1 << _LOW)
    for step in range(begin, last, lanes):
        x = state[:min(lanes, n - step)]
        slot = (x & mask).astype(np.int64)
        out[step - begin:step - begin + len(x)] = slot
        x >>= _U(bits)
        x *= frequency[slot]
        x += within[slot]
        short = np.flatnonzero(x < low)
        x[short] = (x[short] << _U(32)) | words[position:position + len(short)]
        position += len(short)
    ids = id_of[out[:last - begin]]
    if first == 0 and last == n and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block is damaged: its ids differ from those written")
    return ids[first - begin:]


def encoded_texts(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row: the ids of its text and ``end_id``; NULL is an empty text.

    Ids take 16 bits each where all of the vocabulary fit, else 32.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, specials = library_encoder(tokenizer_path)
        for batch in batches:
            for tokens in encoder.tokens(batch.column("text"), byte_level, specials):
                ids, bounds = closed(tokens, end_id)
                kind = _kind(max(encoder.most_id, end_id))
                raw = pa.Array.from_buffers(pa.large_binary(), tokens.rows, [
                    None, pa.py_buffer(kind.itemsize * bounds), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(tokens.first, tokens.rows), pa.array(np.diff(bounds), pa.int32()),
                     raw.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(read, TOKENS)


def _kind(most_id: int) -> np.dtype:
    return np.dtype("<u2" if most_id < 1 << 16 else "<u4")


def _unpacked(raw: pa.Scalar, n: int) -> np.ndarray:
    buffer = raw.as_buffer()
    return np.frombuffer(buffer, _width(buffer.size, n))


def _width(size: int, n: int) -> str:
    return "<u2" if size == 2 * n else "<u4"


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; every batch is counted before it is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = column_bytes(batch.column("ids"))
            kind = _width(offsets[-1] - offsets[0], pc.sum(batch.column("n_tokens")).as_py() or 0)
            found = np.bincount(raw[offsets[0]:offsets[-1]].view(kind))
            ids = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found[ids])], ["id", "n"])

    return tokens.select("ids", "n_tokens").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(rows: DataFrame, ids: np.ndarray, frequency: np.ndarray, block_tokens: int) -> DataFrame:
    """Blocks of sorted partitions, one file number per partition."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding, file = Coding(ids, frequency), TaskContext.get().partitionId()
        schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int32()),
                            *[(c, pa.list_(pa.int64())) for c in ("doc_ids", "doc_starts", "parts", "lengths", "offsets")],
                            ("payload", pa.binary())])
        waiting, held, block, first, begin = [], 0, 0, 0, 0

        def made() -> pa.RecordBatch:
            # rows of waiting: document, where it begins in the file, part of it that comes first, its ids
            lengths = np.array([len(w[3]) for w in waiting])
            columns = [[file], [block], [first], [held], *[[[w[k] for w in waiting]] for k in range(3)], [lengths],
                       [np.cumsum(lengths) - lengths], [encode(np.concatenate([w[3] for w in waiting]), coding)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for doc, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(),
                                   batch.column("ids")):
                own = _unpacked(raw, n)
                part = 0
                while part < len(own):
                    piece = own[part:part + block_tokens - held]
                    waiting.append((doc, begin, part, piece))
                    held += len(piece)
                    part += len(piece)
                    if held == block_tokens:
                        yield made()
                        block, first, waiting, held = block + 1, first + held, [], 0
                begin += len(own)
        if held:
            yield made()

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(pack, BLOCKS)


def write_ids(tokens: DataFrame, folder: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write rows of (doc_id, n_tokens, ids) to ``folder`` in ascending doc_id order.

    ``tokens`` is read several times and should be a stored table. The count of ids, at most one number per id of the
    vocabulary, is gathered; all else stays with the tasks. Rows with equal doc_id are told apart by a hash of their
    ids and split over files only at such borders; NULL comes first.
    """
    spark = tokens.sparkSession
    counted = sorted((r.id, r.n) for r in id_counts(tokens).collect())
    ids = np.array([i for i, _ in counted], np.int64).astype(np.uint32)
    frequency = fitted_frequencies(np.array([n for _, n in counted], np.int64))
    spark.createDataFrame([(VERSION, LANES, BITS, block_tokens, CHECKPOINT_TOKENS)],
                          "version int, lanes int, bits int, block_tokens int, checkpoint_tokens int"
                          ).coalesce(1).write.parquet(f"{folder}/format")
    table = pa.table({"id": pa.array(ids.astype(np.int64)), "frequency": pa.array(frequency)})
    spark.createDataFrame(table, "id bigint, frequency bigint").coalesce(1).write.parquet(f"{folder}/frequencies")
    key = ["doc_id", "_tie", "_salt"]
    ranged = tokens.withColumns({"_tie": F.xxhash64("ids"), "_salt": F.monotonically_increasing_id()})
    ranged = ranged.repartitionByRange(*key).sortWithinPartitions(*key)
    _blocks(ranged, ids, frequency, block_tokens).write.parquet(f"{folder}/blocks")


def crc_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings laid end to end, from theirs; ``length`` is that of the second in bytes."""
    def times(a: int, b: int) -> int:
        # polynomials over bits, lowest power in the highest bit, modulo that of CRC-32
        product = 0
        for k in range(31, -1, -1):
            if a >> k & 1:
                product ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return product

    power, square, n = 1 << 31, 1 << 30, 8 * length
    while n:
        if n & 1:
            power = times(square, power)
        square = times(square, square)
        n >>= 1
    return times(power, first) ^ second


def _coding(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and frequencies of the files, at most as many as the vocabulary has ids."""
    form = spark.read.parquet(f"{folder}/format").first()
    if (form.version, form.lanes, form.bits, form.checkpoint_tokens) != (VERSION, LANES, BITS, CHECKPOINT_TOKENS):
        raise ValueError(f"{folder}: written in another format: {form}")
    table = spark.read.parquet(f"{folder}/frequencies").orderBy("id").toArrow()
    return (table.column("id").to_numpy().astype(np.uint32), table.column("frequency").to_numpy())


def _numbers(column) -> np.ndarray:
    return column.flatten().to_numpy()


def read_checks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Every block is decoded by itself. The CRC-32 of a document that lies in several blocks is put together from those
    of its parts.
    """
    ids, frequency = _coding(spark, folder)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Coding(ids, frequency).slots()
        for batch in batches:
            lengths = _numbers(batch.column("lengths"))
            crcs, at = [], 0
            for payload, own in zip(batch.column("payload"), batch.column("lengths")):
                raw = memoryview(decode(payload.as_buffer(), slots).astype("<u4")).cast("B")
                n = len(own)
                ends = 4 * np.cumsum(lengths[at:at + n])
                crcs += [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * lengths[at:at + n]).tolist(), ends.tolist())]
                at += n
            times = batch.column("lengths").value_lengths()
            row = np.repeat(np.arange(batch.num_rows), times.to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("file").take(pa.array(row)), batch.column("doc_ids").flatten(),
                 batch.column("doc_starts").flatten(), batch.column("parts").flatten(), pa.array(lengths),
                 pa.array(crcs, pa.int64())], ["file", "doc_id", "doc_start", "part", "n", "crc"])

    blocks = spark.read.parquet(f"{folder}/blocks")
    found = blocks.select("file", "doc_ids", "doc_starts", "parts", "lengths", "payload").mapInArrow(
        parts, "file int, doc_id bigint, doc_start bigint, part bigint, n bigint, crc bigint")
    whole = found.groupBy("file", "doc_start", "doc_id").agg(
        F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "n", "crc"))).alias("_parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for pieces in batch.column("_parts").to_pylist():
                value = pieces[0]["crc"]
                for piece in pieces[1:]:
                    value = crc_joined(value, piece["crc"], 4 * piece["n"])
                crc.append(value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(crc, pa.int64())], ["file", "doc_start", "doc_id", "n_tokens", "ids_crc32"])

    checked = whole.select("file", "doc_start", "doc_id", "n_tokens", "_parts").mapInArrow(
        joined, "file int, doc_start bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    # one row per file, and there are as many files as the writing session had partitions
    earlier = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("_n")).select(
        "file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return checked.join(F.broadcast(files), "file").select(
        "doc_id", (F.col("_before") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def read_parts(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, file, doc_start, part, ids) of the documents whose doc_id is in ``wanted``, ids as an array.

    Of each block only the part between two checkpoints that holds the document is decoded. A document that lies in
    several blocks has a row per block.
    """
    ids, frequency = _coding(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    listed = blocks.select("file", "block", F.inline(F.arrays_zip("doc_ids", "doc_starts", "parts", "lengths", "offsets")))
    chosen = listed.join(wanted.select(F.col("doc_id").alias("doc_ids")).distinct(), "doc_ids", "left_semi")
    needed = blocks.select("file", "block", "payload").join(chosen, ["file", "block"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Coding(ids, frequency).slots()
        for batch in batches:
            found = [decode(p.as_buffer(), slots, at, at + n) for p, at, n in zip(
                batch.column("payload"), batch.column("offsets").to_pylist(), batch.column("lengths").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_ids"), batch.column("file"), batch.column("doc_starts"), batch.column("parts"),
                 pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))],
                ["doc_id", "file", "doc_start", "part", "ids"])

    return needed.mapInArrow(read, "doc_id bigint, file int, doc_start bigint, part bigint, ids array<int>")


def written(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> str:
    """Encode every text of ``docs`` and write the files; returns ``folder``."""
    write_ids(stored(encoded_texts(docs, tokenizer_path, end_id), "token-ids"), folder)
    return folder
