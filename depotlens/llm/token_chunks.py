"""Token ids of whole Arrow columns: texts are cut where no token can cross, and each distinct chunk is encoded once.

Arrow's dictionary encoding finds the distinct chunks of a slice by their bytes, a cache of bounded size in the worker
keeps their ids for later slices, and numpy gathers the ids of all chunks. The result equals that of encoding every
text by itself.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from depotlens.llm.words import KEPT, column_bytes

SLICE_BYTES = 4 << 20
MOST_KEPT_BYTES = 192 << 20
JOINED_CHUNKS = 1000
SEPARATORS = ("\n", " ¤ ", " £ ")  # of characters that plain chunks do not have


def _table(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


# white space that every regular expression engine takes for such
_BLANK = _table([0x20, 0x09, 0x0A, 0x0D])
_ASCII_SPACE = _table([0x20, *range(0x09, 0x0E)])
# bytes that end, or begin, no white space character of any script
_ENDS_NO_SPACE = ~_table([*range(0x21), *range(0x80, 0x90), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
_BEGINS_NO_SPACE = ~_table([*range(0x21), 0xC2, 0xE1, 0xE2, 0xE3])

_LETTER, _DIGIT, _MARK = 1, 2, 3
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASSES[48:58] = _DIGIT
_CLASSES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK


def _classes(data: np.ndarray) -> np.ndarray:
    """Letters, digits and marks of ASCII, and the accented letters U+00C0 to U+00FF; 0 is anything else."""
    kind = _CLASSES[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def _between_classes(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether pieces end before each byte but the first because its class is another one. What follows an apostrophe
    may belong to it."""
    return (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (data[:-1] != 0x27)


def before_spaces(data: np.ndarray) -> np.ndarray:
    """Cuts before runs of white space that begin with a space: pieces hold spaces at their beginning only."""
    cut = np.zeros(len(data), bool)
    cut[1:] = (data[1:] == 0x20) & (_ENDS_NO_SPACE[data[:-1]] | (_classes(data)[:-1] > 0))
    return cut


def byte_level(data: np.ndarray) -> np.ndarray:
    """Cuts for byte-level vocabularies: before white space, after a single line feed, between letters, digits, marks."""
    kind, cut = _classes(data), np.zeros(len(data), bool)
    ends = _ENDS_NO_SPACE[data] | (kind > 0)
    cut[1:] = (_BLANK[data[1:]] & ends[:-1]) | _between_classes(data, kind)
    cut[2:] |= (data[1:-1] == 0x0A) & ends[:-2] & _BEGINS_NO_SPACE[data[2:]]
    return cut


def words_and_spaces(data: np.ndarray) -> np.ndarray:
    """Cuts for vocabularies that drop white space: around it, between letters, digits and marks, and between digits."""
    kind, cut = _classes(data), np.zeros(len(data), bool)
    space = _ASCII_SPACE[data]
    cut[1:] = (space[1:] != space[:-1]) | _between_classes(data, kind) | (
        (kind[1:] == _DIGIT) & (kind[:-1] == _DIGIT))
    return cut


# a special string may begin with the one that is left out
_PLAIN = _table(set(range(0x21, 0x7F)) - {0x3C})


def plain_chunks(chunks: list[bytes]) -> np.ndarray:
    """Which chunks are made of ASCII without white space and ``<``, and of U+00C0 to U+00FF; a space may come first."""
    count = np.fromiter(map(len, chunks), np.int64, len(chunks))
    end = np.cumsum(count)
    first, filled = end - count, count > 0
    data = np.frombuffer(b"".join(chunks), np.uint8)
    good, follows = _PLAIN[data], data & 0xC0 == 0x80
    lead = np.flatnonzero((data[:-1] == 0xC3) & follows[1:])
    good[lead] = good[lead + 1] = True
    # but not across two chunks
    good[end[filled] - 1] &= data[end[filled] - 1] != 0xC3
    good[first[filled]] &= ~follows[first[filled]]
    spaced = first[count > 1]
    good[spaced] |= data[spaced] == 0x20
    bad = np.append(0, np.cumsum(~good))
    return filled & (bad[end] == bad[first])


def _size(chunks) -> int:
    """Bytes that so many chunks take in a dictionary, as measured for words."""
    return 200 * len(chunks)


def _gathered(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` that begin at ``first``, end to end."""
    before = np.cumsum(count) - count
    return ids[np.repeat(first - before, count) + np.arange(int(count.sum()))]


def _flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.uint32, int(count.sum())), count


@dataclass
class Tokens:
    """Ids of the rows ``first`` to ``first + rows - 1`` of a batch, and where each row's ids begin; rows + 1 numbers.

    ``chunk`` numbers the encoder's entry of every chunk, ``chunks`` tells where each row's chunks begin.
    """

    first: int
    rows: int
    ids: np.ndarray
    bounds: np.ndarray
    chunk: np.ndarray
    chunks: np.ndarray


class ChunkEncoder:
    """Ids per chunk of bytes, kept up to about ``most_bytes`` in memory; then those not met of late are dropped.

    ``encode_many`` returns the ids of a list of chunks end to end and their number per chunk. ``bytes_of`` lists what
    each id stands for; with it ``sound`` tells which chunks their ids spell out. ``most_id`` is the largest id there is.
    """

    def __init__(self, encode_many: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
                 bytes_of: list[bytes] | None = None, most_bytes: int = MOST_KEPT_BYTES, most_id: int = (1 << 32) - 1):
        self._encode, self.bytes_of, self._most, self.most_id = encode_many, bytes_of, most_bytes, most_id
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sound, self._met = np.zeros(0, bool), np.zeros(0, bool)

    def _shrink(self) -> None:
        """Keep the chunks met since the last time, or none if they are too many by themselves."""
        chunks = [c for c, met in zip(self.known, self._met.tolist()) if met]
        if _size(chunks) > self._most // 2:
            chunks = []
        own = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        self.ids, count = _gathered(self.ids, self.first[own], self.count[own]), self.count[own]
        self.first, self.count = np.cumsum(count) - count, count
        self.sound = self.sound[own] if self.bytes_of is not None else self.sound
        self.known = dict(zip(chunks, range(len(chunks))))
        self._met = np.zeros(len(chunks), bool)

    def entries(self, chunks: list[bytes]) -> np.ndarray:
        """The numbers of the given chunks among those kept; valid until the next call."""
        if _size(self.known) > self._most:
            self._shrink()
        known = self.known
        missing = [c for c in chunks if c not in known]
        if missing:
            new, count = self._encode(missing)
            self.first = np.append(self.first, len(self.ids) + np.cumsum(count) - count)
            self.count = np.append(self.count, count)
            self.ids = np.append(self.ids, new)
            if self.bytes_of is not None:
                spelt, ends = [self.bytes_of[i] for i in new.tolist()], np.cumsum(count)
                self.sound = np.append(self.sound, np.fromiter(
                    (b"".join(spelt[x:y]) == chunk for x, y, chunk in zip((ends - count).tolist(), ends.tolist(), missing)),
                    bool, len(missing)))
            known.update(zip(missing, range(len(known), len(known) + len(missing))))
            self._met = np.append(self._met, np.zeros(len(missing), bool))
        found = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        self._met[found] = True
        return found

    def tokens(self, column: pa.Array, cuts: Callable[[np.ndarray], np.ndarray], whole: Sequence[str] = (),
               slice_bytes: int = SLICE_BYTES) -> Iterator[Tokens]:
        """Ids of a string column by slices of whole rows. NULL counts as empty; rows that contain one of the strings
        ``whole``, which the tokenizer treats by rules of their own, are encoded in one piece."""
        if column.null_count:
            column = column.fill_null("")
        special = np.zeros(len(column), bool)
        for text in whole:
            special |= pc.match_substring(column, text).to_numpy(zero_copy_only=False)
        data, offsets = column_bytes(column)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slice_bytes, "right")) - 1)
            last = min(last, len(column))
            at = offsets[first:last + 1] - offsets[first]
            part = data[offsets[first]:offsets[last]]
            cut = cuts(part)
            for row in np.flatnonzero(special[first:last]):
                cut[at[row]:at[row + 1]] = False
            cut[at[:-1][at[1:] > at[:-1]]] = True
            start = np.flatnonzero(cut)
            chunks = np.searchsorted(start, at)
            raw = pa.Array.from_buffers(pa.large_binary(), len(start), [
                None, pa.py_buffer(np.append(start, len(part)).astype(np.int64)), pa.py_buffer(part)])
            coded = raw.dictionary_encode()
            entry = self.entries(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
            count = self.count[entry]
            ids = _gathered(self.ids, self.first[entry], count)
            yield Tokens(first, last - first, ids, np.append(0, np.cumsum(count))[chunks], entry, chunks)
            first = last


def closed(tokens: Tokens, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after those of every row, and where each row's begin."""
    rows = np.arange(tokens.rows + 1)
    bounds = tokens.bounds + rows
    out = np.full(len(tokens.ids) + tokens.rows, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = tokens.ids
    return out, bounds


def _kept(name, make):
    """What ``make`` returns, made once per worker process."""
    kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def library_encoder(path: str, plain_specials: bool = False, most_bytes: int = MOST_KEPT_BYTES
                    ) -> tuple[ChunkEncoder, list[str]]:
    """The encoder of a file of the tokenizers library, one per worker process, and its special strings.

    With ``plain_specials`` those strings are ordinary text, none is returned, and the encoder knows what the ids of a
    byte-level vocabulary stand for.
    """
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = plain_specials
        added = tokenizer.get_added_tokens_decoder()
        strings = [] if plain_specials else [t.content for t in added.values()]
        # plain chunks are joined to long calls by something that stands apart and has one id
        between = next((x for x in SEPARATORS if len(tokenizer.encode(x, add_special_tokens=False).ids) == 1), None)
        mark = tokenizer.encode(between, add_special_tokens=False).ids[0] if between else -1

        def encode_many(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            plain = plain_chunks(chunks) if between else np.zeros(len(chunks), bool)
            simple, others = list(compress(chunks, plain.tolist())), list(compress(chunks, (~plain).tolist()))
            found = tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in others], add_special_tokens=False)
            ids, count = _flat([e.ids for e in found])
            parts, counts = [ids], [count]
            for at in range(0, len(simple), JOINED_CHUNKS):
                text = between.encode().join([*simple[at:at + JOINED_CHUNKS], b""]).decode()
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(ids == mark)
                keep = np.ones(len(ids), bool)
                keep[ends] = False
                parts.append(ids[keep])
                counts.append(np.diff(ends, prepend=-1) - 1)
            ids, count = np.concatenate(parts), np.concatenate(counts)
            place = np.empty(len(chunks), np.int64)
            place[~plain], place[plain] = np.arange(len(others)), np.arange(len(others), len(chunks))
            return _gathered(ids, (np.cumsum(count) - count)[place], count[place]), count[place]

        most = max(tokenizer.get_vocab().values())
        if not plain_specials:
            return ChunkEncoder(encode_many, None, most_bytes, most), strings
        letters = byte_letters()
        spelt = [b""] * (most + 1)
        for entry, i in tokenizer.get_vocab().items():
            spelt[i] = entry.encode() if i in added else bytes(letters[c] for c in entry)
        return ChunkEncoder(encode_many, spelt, most_bytes, most), []

    return _kept((path, plain_specials, most_bytes), make)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printed, else the next one free
    above 255."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}


def piece_encoder(path: str, most_bytes: int = MOST_KEPT_BYTES) -> ChunkEncoder:
    """The encoder of a sentencepiece file that adds a space before texts; chunks begin with that space."""
    def make():
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [processor.id_to_piece(i) for i in range(processor.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path}: pieces with a space inside, texts cannot be cut before spaces")
        spelt = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode()
                 for i, p in enumerate(pieces)]
        lone = [processor.piece_to_id("▁")]

        def encode_many(chunks: list[bytes]):
            found = processor.encode([c[1:].decode("utf-8", "replace") for c in chunks], num_threads=1)
            return _flat([ids if len(chunk) > 1 else lone for chunk, ids in zip(chunks, found)])

        return ChunkEncoder(encode_many, spelt, most_bytes)

    return _kept((path, most_bytes), make)
