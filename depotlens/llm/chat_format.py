"""Chat formatting by columnar byte assembly.

A turn becomes ``<turn:ROLE>TEXT</turn>`` and a line end. In role and text the characters ``\\``, ``<``
and ``>`` get a backslash before them, so no text can close or open a turn, and reading back is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.words import column_bytes

OPEN, CLOSE_ROLE, CLOSE_TURN = b"<turn:", b">", b"</turn>\n"
TRAINED_ROLE = "assistant"
CHUNK_BYTES = 4 << 20
FORMATTED = "conv_id bigint, turn bigint, formatted string, loss_start bigint, loss_end bigint"


def _escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the rows with a backslash before each control character."""
    control = np.zeros(256, bool)
    control[[0x5C, 0x3C, 0x3E]] = True
    part = data[offsets[0]:offsets[-1]]
    marked = control[part]
    added = np.zeros(len(part) + 1, np.int64)
    np.cumsum(marked, out=added[1:])
    out = np.full(len(part) + int(added[-1]), 0x5C, np.uint8)
    out[np.arange(len(part)) + added[1:]] = part
    at = offsets - offsets[0]
    return out, at + added[at]


def _scatter(out: np.ndarray, place: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy row i of (data, offsets) to ``out`` from ``place[i]`` on, all rows at once."""
    lengths = np.diff(offsets)
    out[np.repeat(place - offsets[:-1], lengths) + np.arange(offsets[0], offsets[-1])] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and where the characters of the escaped text begin and end in each.

    Segment lengths give cumulative offsets, those give the place of every byte, and headers and
    contents are copied into one buffer. NULL roles and texts count as empty.
    """
    n = len(texts)
    role, role_at = _escaped(*column_bytes(roles))
    text, text_at = _escaped(*column_bytes(texts))
    segments = [
        (np.tile(np.frombuffer(OPEN, np.uint8), n), np.arange(n + 1) * len(OPEN)),
        (role, role_at),
        (np.tile(np.frombuffer(CLOSE_ROLE, np.uint8), n), np.arange(n + 1) * len(CLOSE_ROLE)),
        (text, text_at),
        (np.tile(np.frombuffer(CLOSE_TURN, np.uint8), n), np.arange(n + 1) * len(CLOSE_TURN)),
    ]
    lengths = np.stack([np.diff(at) for _, at in segments], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(n, len(segments))
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (data, at) in enumerate(segments):
        _scatter(out, starts[:, k], data, at)
    offsets = np.concatenate([[0], ends[:, -1]]) if n else np.zeros(1, np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)),
                                                              pa.py_buffer(out)]).cast(pa.string())
    # code points: all bytes but the continuation bytes of UTF-8
    points = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=points[1:])
    begin = points[offsets[:-1]]
    return formatted, points[starts[:, 3]] - begin, points[ends[:, 3]] - begin


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about ``CHUNK_BYTES`` in ``column``."""
    _, offsets = column_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(first + 1, last), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _pieces(batch, "text"):
            formatted, start, end = assemble(part.column("role"), part.column("text"))
            trained = np.array(part.column("role").fill_null("").to_numpy(zero_copy_only=False) == TRAINED_ROLE, bool)
            yield pa.RecordBatch.from_arrays(
                [part.column("conv_id"), part.column("turn"), formatted,
                 pa.array(start, pa.int64(), mask=~trained), pa.array(end, pa.int64(), mask=~trained)],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end"])


def formatted(turns: DataFrame) -> DataFrame:
    """One row per turn: its formatted piece and the characters of it under the loss mask, if it is trained on.

    The conversation is the pieces of its turns in order. Turns are formatted where they lie, without a
    shuffle. NULL roles and texts count as empty; other columns are not read.
    """
    return turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").mapInArrow(
        _format, FORMATTED)


def unescaped(text: str) -> str:
    """Undo the escaping of a text."""
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\<", "<").replace("\\>", ">") for p in parts)


def parsed(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    body = piece[len(OPEN):-len(CLOSE_TURN)]
    at = 0
    while body[at] != ">":
        at += 2 if body[at] == "\\" else 1
    return unescaped(body[:at]), unescaped(body[at + 1:])


DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
          "formatted_chars bigint")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation from its sorted pieces; of a conversation only running hashes are held."""
    missing = object()
    current, state, done = missing, None, []

    def closed():
        turns, loss, n, loss_chars, chars = state
        return current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(),
                                                         pa.string(), pa.int64()))],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for conv, piece, start, end in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "formatted", "loss_start", "loss_end"))):
            if conv != current or state is None:
                if state is not None:
                    done.append(closed())
                current, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            role, text = parsed(piece)
            state[0].update(f"{role}\n{text}\n".encode())
            if start is not None:
                masked = unescaped(piece[start:end])
                state[1].update(masked.encode())
                state[3] += len(masked)
            state[2] += 1
            state[4] += len(piece)
        if len(done) >= 1000:
            yield batch_of(done)
            done = []
    if state is not None:
        done.append(closed())
    if done:
        yield batch_of(done)


def read_back(pieces: DataFrame) -> DataFrame:
    """Turns and masked texts of each conversation, read from the formatted pieces and reduced to digests.

    Turns go by number; equal numbers by piece. The pieces stream through sorted, so a conversation of
    any length needs little memory. NULL is a conversation.
    """
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(
        _read_back, DIGEST)
