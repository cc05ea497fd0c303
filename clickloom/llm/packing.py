"""Packing of tokenized documents into fixed windows, online and in bounded space.

Each task keeps a fixed number of open windows. A document goes into the open window that it
fills best; when it fits none, the fullest window is emitted and a new one opened. What is open
when tasks end is merged in the same way, many tasks at a time, until one is left.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.text import Memo, as_bytes, kept_by_worker, stored

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
        ("part", pa.int64()),
        ("is_open", pa.bool_()),
    ]
)
_DDL = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary, part bigint, is_open boolean"
)
PACKED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
WIDTH = 4  # bytes of an id

# A sequence number is made of the round, the task and a count, so that it is unique.
_ROUND_BITS, _TASK_BITS = 58, 34


class Windows:
    """The open windows of one task, and the rows of those it has emitted."""

    def __init__(self, size: int, most: int, level: int, part: int, with_ids: bool):
        self.size, self.most, self.part, self.with_ids = size, most, part, with_ids
        self.serial = (level << _ROUND_BITS) | (part << _TASK_BITS)
        self.free: list[tuple[int, int]] = []  # (room, window), fullest first
        self.held: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        """Place one piece; whole windows are cut off first."""
        full = self.size * WIDTH
        while len(ids) >= full:
            self.held[window := self._number()] = [(doc_id, start, ids[:full], doc_tokens)]
            self._emit(window)
            ids, start = ids[full:], start + self.size
        if not ids:
            return
        length = len(ids) // WIDTH
        best = bisect_left(self.free, (length, -1))
        if best < len(self.free):
            room, window = self.free.pop(best)
        else:
            if len(self.free) == self.most:
                self._emit(self.free.pop(0)[1])
            room, window = self.size, self._number()
            self.held[window] = []
        self.held[window].append((doc_id, start, ids, doc_tokens))
        if room == length:
            self._emit(window)
        else:
            insort(self.free, (room - length, window))

    def leave(self) -> None:
        """Put out the open windows as they are, for a later merge."""
        for _, window in self.free:
            self._emit(window, is_open=True)
        self.free = []

    def pour(self) -> None:
        """Fill the open windows to the brim by cutting pieces; at most one stays short."""
        pieces = [piece for _, window in self.free for piece in self.held.pop(window)]
        self.free, row, room = [], [], self.size
        for doc_id, start, ids, doc_tokens in pieces:
            while ids:
                part = ids[: room * WIDTH]
                row.append((doc_id, start, part, doc_tokens))
                length = len(part) // WIDTH
                ids, start, room = ids[len(part) :], start + length, room - length
                if room == 0:
                    self.held[window := self._number()] = row
                    self._emit(window)
                    row, room = [], self.size
        if row:
            self.held[window := self._number()] = row
            self._emit(window)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows, strict=True) if rows else [[] for _ in PIECES]
        arrays = [
            pa.array(column, field.type) for column, field in zip(columns, PIECES, strict=True)
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=PIECES)

    def _number(self) -> int:
        self.serial += 1
        return self.serial

    def _emit(self, window: int, is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in self.held.pop(window):
            length = len(ids) // WIDTH
            kept = ids if is_open or self.with_ids else None
            crc = zlib.crc32(ids)
            self.rows.append(
                (doc_id, start, length, crc, doc_tokens, window, offset, kept, self.part, is_open)
            )
            offset += length


# Never part of one token with a letter or digit before them, by the pattern that splits words.
TAIL = b".,!?;:|*$%&#"


def stem_and_tail(word: bytes) -> tuple[bytes, bytes]:
    """Two parts of a word that are encoded alike and each for itself.

    A-Z become lower case, as they do in the tokenizer, but where a special token could arise.
    """
    if word.isalpha():  # of bytes: A-Z and a-z
        return word.lower(), b""
    if b"<|" in word:
        return word, b""
    word = word.lower()
    stem = word.rstrip(TAIL)
    tail = word[len(stem) :]
    if not tail or stem[-1:].isalpha():  # of bytes: A-Z and a-z
        return stem, tail
    last = stem[-4:].decode(errors="ignore")[-1:]
    return (stem, tail) if last.isalpha() else (word, b"")


# Letters of which none changes, or joins another, when text is normalised.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"


def plain_letters(tokenizer) -> dict[int, str]:
    """Of ``_LETTERS``, those that the tokenizer leaves as they are, and how its model writes each."""
    found = {}
    for letter in _LETTERS:
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(letter)
        if tokenizer.normalizer.normalize_str(letter) == letter and len(pieces) == 1:
            found[ord(letter)] = pieces[0][0]
    return found


def word_encoder(tokenizer_file: str, most_words: int = 1 << 20):
    """A function from texts (bytes) to their ids, 4 bytes each.

    For lower-casing tokenizers that split at white space and between letters and punctuation.
    Words are encoded once per worker and looked up after that, special tokens are not added. Those of
    plain letters are one piece, which normalising and splitting leave alone, so the tokenizer's model
    gets them at once. A worker remembers about ``most_words`` words and as many stems, some 200 MB for
    each million.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core

    def made() -> tuple:
        tokenizer = Tokenizer.from_file(tokenizer_file)
        return tokenizer, plain_letters(tokenizer), Memo(None, most_words), Memo(None, most_words)

    tokenizer, written, known, stems = kept_by_worker(("tokenizer", tokenizer_file, most_words), made)
    model, letters = tokenizer.model, frozenset(map(chr, written))

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def add_stems(new: list[bytes]) -> None:
        others = []
        for part in new:
            text = part.decode()
            if text and letters.issuperset(text):
                stems[part] = packed([token.id for token in model.tokenize(text.translate(written))])
            else:
                others.append(part)
        for at in range(0, len(others), 10_000):
            some = others[at : at + 10_000]
            encoded = tokenizer.encode_batch_fast(
                [part.decode() for part in some], add_special_tokens=False
            )
            for part, encoding in zip(some, encoded, strict=True):
                stems[part] = packed(encoding.ids)

    def encode(texts: list[bytes]) -> list[bytes]:
        known.trim()
        stems.trim()
        split = [text.split() for text in texts]
        found = [list(map(known.get, words)) for words in split]
        missing: set[bytes] = set()
        for words, ids in zip(split, found, strict=True):
            missing.update(compress(words, map(is_, ids, repeat(None))))
        parts = {word: stem_and_tail(word) for word in missing}
        add_stems(list({part for both in parts.values() for part in both}.difference(stems)))
        for word, (stem, tail) in parts.items():
            known[word] = stems[stem] + stems[tail] if tail else stems[stem]
        for words, ids in zip(split, found, strict=True):
            if None in ids:
                ids[:] = [known[word] if one is None else one for word, one in zip(words, ids, strict=True)]
        return [b"".join(ids) for ids in found]

    return encode


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int = 1,
    window: int = 2048,
    open_windows: int = 64,
    merged_tasks: int = 32,
    with_ids: bool = False,
    most_words: int = 1 << 20,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    A document is the ids of its text (NULL: empty) and ``end_id``; each row of ``docs`` is a
    document of its own, whatever its doc_id. Documents of ``window`` tokens or more are cut
    into whole windows and a rest; rests are placed uncut. ``ids`` (little-endian, 4 bytes each)
    are NULL unless ``with_ids``. Columns other than doc_id and text are not read. An empty table
    gives no pieces.

    A task holds ``open_windows`` windows and ``most_words`` encoded words, whatever the input. Windows left open by
    ``merged_tasks`` tasks are packed again by one task, longest pieces first, in as many rounds
    as it takes; the last one cuts pieces to fill its windows, so that one sequence of the whole
    corpus is short. Each round is stored in the shared folder, so that sequences stay as they
    are if an executor is lost.
    """

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_file, most_words)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        windows = Windows(window, open_windows, 0, part, with_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                encoded = encode(as_bytes(some.column("text")))
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoded, strict=True):
                    windows.add(doc_id, 0, ids + end, len(ids) // WIDTH + 1)
                yield windows.take()
        windows.leave()
        yield windows.take()

    def merge(level: int, last: bool):
        def merged(key: tuple, pieces: pa.Table) -> pa.Table:
            windows = Windows(window, open_windows, level, key[0].as_py(), with_ids)
            order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]
            columns = pieces.sort_by(order).select(["doc_id", "start", "ids", "doc_tokens"])
            for piece in zip(*(column.to_pylist() for column in columns.columns), strict=True):
                windows.add(*piece)
            windows.pour() if last else windows.leave()
            return pa.Table.from_batches([windows.take()])

        return merged

    placed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rounds = [stored(placed.mapInArrow(online, _DDL), "packed")]
    tasks = rounds[0].filter("is_open").agg(F.max("part") + 1).first()[0]
    while tasks:
        tasks = -(-tasks // merged_tasks)
        left = rounds[-1].filter("is_open")
        again = left.groupBy((F.col("part") / merged_tasks).cast("bigint").alias("task"))
        merged = again.applyInArrow(merge(len(rounds), tasks == 1), _DDL)
        rounds.append(stored(merged, "packed"))
        if tasks == 1:
            break
    closed = [part.filter("not is_open").drop("part", "is_open") for part in rounds]
    return reduce(DataFrame.unionByName, closed)
