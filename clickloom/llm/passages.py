"""Removal of repeated passages with sharded Aho-Corasick automata.

Documents are put in chunks of bounded size. Hashes of all windows of ``width`` words meet by range of
hash, which tells every chunk which of its windows start earlier in another one. From these and
from windows that come again within the chunk its recurring passages are confirmed, word by word:
stretches of windows that are found together wherever they are. They are compiled into automata
of bounded size, and all documents of the chunk are streamed through each, which locates every
occurrence of every passage.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.text import shuffle_width, stored, word_hashes
from clickloom.session import fresh_folder

LOWEST = -(2**63)  # stands for a NULL doc_id

# Odd numbers with well mixed bits: two independent hashes of a window, and their last mixing.
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MIX = np.uint64(0xBF58476D1CE4E5B9)

_CHUNK = "chunk bigint, ids array<bigint>, texts array<binary>"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


def chunks(docs: DataFrame, chunk_bytes: int, chunk_docs: int) -> DataFrame:
    """(chunk, ids, texts): the documents as they lie, some of them in a row.

    A chunk has at most ``chunk_docs`` documents and ends with the one that reaches ``chunk_bytes``.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33

        def chunk(ids: list, texts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([texts], pa.list_(pa.binary())),
                ],
                ["chunk", "ids", "texts"],
            )

        ids, texts, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                named = (some.column(name).to_pylist() for name in ("doc_id", "text"))
                for doc_id, text in zip(*named, strict=True):
                    ids.append(doc_id)
                    texts.append(text or b"")
                    size += len(texts[-1])
                    if size >= chunk_bytes or len(ids) == chunk_docs:
                        yield chunk(ids, texts)
                        number += 1
                        ids, texts, size = [], [], 0
        if ids:
            yield chunk(ids, texts)

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")
    ).mapInArrow(gather, _CHUNK)


def _window_hashes(single: np.ndarray, width: int, step: np.uint64) -> np.ndarray:
    """Hashes of all windows of ``width``, put together from those of 1, 2, 4, ... words."""
    n = max(0, len(single) - width + 1)
    whole, done, power, size = np.zeros(n, np.uint64), 0, single, 1
    while done < width:
        if width & size:
            whole = _mixed(whole, power[done : done + n], step)
            done += size
        if done < width:
            power, size = _mixed(power[:-size], power[size:], step), 2 * size
    return whole


def _mixed(left: np.ndarray, right: np.ndarray, step: np.uint64) -> np.ndarray:
    both = left * step
    both ^= both >> np.uint64(29)
    both += right
    both *= _MIX
    both ^= both >> np.uint64(32)
    return both


class Words:
    """The words of a chunk's documents, in order of doc_id (NULL first), as numbers.

    ``place`` holds where the windows start, ``first`` for each window the place of the chunk's first
    window with the same hash. ``hashes`` and ``owners`` (doc_ids) are of the distinct ones, in
    order of place, dealt to ``ranges`` by a second hash.
    """

    def __init__(self, ids: list, texts: list[bytes], width: int):
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        self.ids = [ids[i] for i in self.order]
        self.words = [texts[i].split() for i in self.order]
        self.starts = np.cumsum([0, *map(len, self.words)])
        number = defaultdict(itertools.count().__next__)  # a new word gets the next number
        every = itertools.chain.from_iterable(self.words)
        self.numbers = np.fromiter(map(number.__getitem__, every), np.int64, self.starts[-1])
        memo = word_hashes()
        memo.trim()
        single = np.fromiter(map(memo.__getitem__, number), np.uint64, len(number))
        self.width = width
        self._windows(single[self.numbers] if len(number) else np.zeros(0, np.uint64))

    def _windows(self, single: np.ndarray) -> None:
        n = max(0, len(single) - self.width + 1)
        inside = np.ones(n, bool)
        for end in self.starts[1:-1]:
            inside[max(0, end - self.width + 1) : end] = False  # these reach over a document's end
        if len(self.starts) > 1:
            inside[max(0, self.starts[-1] - self.width + 1) :] = False
        self.place = np.flatnonzero(inside)
        hashes, self.spread = (_window_hashes(single, self.width, step)[self.place] for step in _STEP)
        order = np.argsort(hashes)
        starts = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0)[: len(order)])
        self.first = np.empty(len(order), np.int64)
        if len(order):
            sizes = np.diff(np.append(starts, len(order)))
            self.first[order] = np.repeat(np.minimum.reduceat(order, starts), sizes)
        self.distinct = np.flatnonzero(self.first == np.arange(len(hashes)))
        self.hashes = hashes[self.distinct]

    def owners(self) -> np.ndarray:
        """doc_id of each distinct window."""
        doc = np.searchsorted(self.starts, self.place[self.distinct], "right") - 1
        ids = np.array([LOWEST if i is None else i for i in self.ids] or [0], np.int64)
        return ids[doc] if len(doc) else np.zeros(0, np.int64)

    def dealt(self, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the distinct windows by range, those of one range by place, and the cuts."""
        spread = self.spread[self.distinct] >> np.uint64(32)
        to = ((spread * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        return order, np.searchsorted(to[order], np.arange(ranges + 1))


def _planes(values: np.ndarray) -> bytes:
    """Differences of ascending-ish integers, byte by byte, so that the shuffle's codec sees zeros."""
    steps = np.diff(values, prepend=np.int64(0)).astype("<i8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
    return np.cumsum(steps)


def send_windows(held: DataFrame, width: int, ranges: int) -> DataFrame:
    """(range, chunk, windows, owners): every chunk's distinct windows by range of hash."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words in _chunk_words(batches, width):
            order, cuts = words.dealt(ranges)
            hashes, owners = words.hashes[order], words.owners()[order]
            some = [at for at in range(ranges) if cuts[at] < cuts[at + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int64()),
                    pa.array([chunk] * len(some), pa.int64()),
                    pa.array([hashes[cuts[at] : cuts[at + 1]].tobytes() for at in some], pa.binary()),
                    pa.array([_planes(owners[cuts[at] : cuts[at + 1]]) for at in some], pa.binary()),
                ],
                ["range", "chunk", "windows", "owners"],
            )

    return held.mapInArrow(send, "range bigint, chunk bigint, windows binary, owners binary")


def _chunk_words(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, Words]]:
    for batch in batches:
        for at in range(batch.num_rows):
            chunk, ids, texts = (batch.column(name)[at].as_py() for name in ("chunk", "ids", "texts"))
            yield chunk, Words(ids, texts, width)


def settle(key: tuple, sent: pa.Table) -> pa.Table:
    """(chunk, range, earlier): per window of a chunk one bit, whether another has it earlier.

    Earlier is a smaller doc_id or, for rows that repeat a doc_id, a smaller chunk.
    """
    chunk = sent.column("chunk").to_numpy()
    blobs = sent.column("windows").to_pylist()
    sizes = np.array([len(blob) // 8 for blob in blobs])
    hashes = np.frombuffer(b"".join(blobs), "<u8")
    del blobs
    owners = np.concatenate([_unplanes(blob) for blob in sent.column("owners").to_pylist()])
    by_chunk = np.argsort(chunk, kind="stable")
    rank = np.empty(len(chunk), np.int32)
    rank[by_chunk] = np.arange(len(chunk))
    sender = np.repeat(rank, sizes)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    group = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    again = np.bincount(group)[group] > 1
    order, group = order[again], group[again]  # only windows of several chunks need an order
    order = order[np.lexsort((sender[order], owners[order], group))]
    later = np.zeros(len(hashes), bool)
    later[order] = np.append(False, group[1:] == group[:-1])[: len(order)]
    ends = np.cumsum(sizes)
    bits = [np.packbits(later[end - size : end]).tobytes() for end, size in zip(ends, sizes, strict=True)]
    return pa.table(
        {
            "chunk": pa.array(chunk, pa.int64()),
            "range": pa.array([key[0].as_py()] * len(chunk), pa.int64()),
            "earlier": pa.array(bits, pa.binary()),
        }
    )


def passages(words: Words, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the chunk's recurring passages, as windows of their first place.

    ``later`` says of each window whether another chunk has it earlier. A passage is a stretch of
    windows that stand next to each other at every place where one of them is, as far as the chunk
    goes; so wherever one of its windows is, the whole passage is, and all of it has been seen
    before or none.
    """
    n, first = len(words.first), words.first
    times = np.bincount(first, minlength=n)
    recurring = later[first] | (times[first] > 1)
    # Window i and the one after it go together if they do at their first place.
    follows = np.zeros(n, bool)
    if n:
        next_to = (words.place[1:] == words.place[:-1] + 1) & recurring[1:] & recurring[:-1]
        next_to &= (first[1:] == first[:-1] + 1) & (later[first[1:]] == later[first[:-1]])
        follows[1:] = next_to
    # A cut in front of window f (by first place) wherever some occurrence of it starts a stretch,
    # and behind the window in front of it wherever one ends a stretch.
    cut = np.zeros(n + 1, bool)
    cut[first[recurring & ~follows]] = True
    ends = recurring & ~np.append(follows[1:], False)
    cut[first[ends] + 1] = True
    mine = recurring & (first == np.arange(n))
    start = np.flatnonzero(mine & (cut[:n] | ~np.append(False, mine[:-1])[:n]))
    end = np.flatnonzero(mine & (cut[1:] | ~np.append(mine[1:], False)[:n])) + 1
    return start, end


def removed(words: Words, later: np.ndarray, shard_words: int) -> np.ndarray:
    """Which words are covered by a passage that starts earlier, found by streaming all documents."""
    gone = np.zeros(len(words.numbers) + 1, np.int64)
    start, end = passages(words, later)
    if not len(start):
        return gone[:-1] > 0
    begins = words.place[start]
    length = end - start + words.width - 1
    shard = np.cumsum(length) // shard_words
    bounds = zip(words.starts[:-1], words.starts[1:], strict=True)
    streams = [tuple(words.numbers[a:b].tolist()) for a, b in bounds]
    for some in np.split(np.arange(len(start)), np.flatnonzero(np.diff(shard)) + 1):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for at in some.tolist():
            begin, size = int(begins[at]), int(length[at])
            # Its own place is kept, unless the passage is earlier in another chunk.
            own = -1 if later[start[at]] else begin
            automaton.add_word(tuple(words.numbers[begin : begin + size].tolist()), (size, own))
        automaton.make_automaton()
        for offset, stream in zip(words.starts[:-1].tolist(), streams, strict=True):
            if len(stream) >= words.width:
                for last, (size, own) in automaton.iter(stream):
                    at = offset + last + 1 - size
                    if at != own:
                        gone[at] += 1
                        gone[at + size] -= 1
    return np.cumsum(gone[:-1]) > 0


def dedup_passages(
    docs: DataFrame,
    width: int = 20,
    chunk_bytes: int = 4 << 20,
    chunk_docs: int = 1 << 14,
    range_windows: int = 1 << 22,
    shard_words: int = 1 << 21,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text.

    Words are what white space (space, tab to carriage return) separates, unchanged. Every word is
    removed that lies in a window of ``width`` words whose sequence also starts earlier: in a smaller
    doc_id, or earlier in the same document. Windows are judged on the input. What stays is joined
    by single spaces. NULL text has no words; texts of fewer than ``width`` words stay whole. A
    NULL doc_id is smaller than any other. Rows that repeat a doc_id are documents of their own, one
    of them earlier than the others (which one is open). Other columns are not read, whatever their
    names. An empty table gives an empty result.

    The text is stored once, in chunks bucketed by chunk, and does not move again. 8 bytes of hash
    and a doc_id of every window that is new in its chunk are shuffled, dealt to tasks of about
    ``range_windows``; a window that a third of all documents share is one row per chunk. One bit per
    window comes back. Together with the range, windows of different chunks are told apart by 64 bits
    of hash and log2(ranges) more; inside a chunk automata compare words. An automaton has at most
    ``shard_words`` words and one passage more.
    """
    spark = docs.sparkSession
    buckets = shuffle_width(docs)
    name, folder = f"passages_{uuid.uuid4().hex}", fresh_folder(spark, "passages")
    writer = chunks(docs, chunk_bytes, chunk_docs).write.bucketBy(buckets, "chunk").format("parquet")
    writer.option("compression", "zstd").option("path", folder).saveAsTable(name)
    held = spark.table(name)
    none = F.lit(0).cast("bigint")
    size = held.select(F.sum(F.aggregate("texts", none, lambda n, t: n + F.octet_length(t))))
    # At six bytes a word.
    ranges = max(2 * buckets, (size.first()[0] or 0) // (6 * range_windows))
    earlier = stored(
        send_windows(held, width, ranges)
        .groupBy("range")
        .applyInArrow(settle, "chunk bigint, range bigint, earlier binary"),
        "earlier",
    )
    answers = (
        earlier.repartition(buckets, "chunk")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("range", "earlier")).alias("answers"))
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column("answers")
            for at, (_, words) in enumerate(_chunk_words([batch], width)):
                order, cuts = words.dealt(ranges)
                bits = np.zeros(len(order), bool)
                for one in told[at].as_py() or []:
                    a, b = cuts[one["range"]], cuts[one["range"] + 1]
                    bits[a:b] = np.unpackbits(np.frombuffer(one["earlier"], np.uint8), count=b - a)
                later = np.zeros(len(words.first), bool)
                later[words.distinct[order]] = bits
                yield from _results(words, removed(words, later, shard_words))

    # The text's side is bucketed and stays where it is; the answers are one bit per window.
    result = (
        held.join(answers.hint("shuffle_hash"), "chunk", "left")
        .select("chunk", "ids", "texts", "answers")
        .mapInArrow(stream, RESULT)
    )
    spark.sql(f"drop table {name}")  # out of the catalogue; the plan goes on reading its files
    return result


def _results(words: Words, gone: np.ndarray, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    kept = ~gone
    for at in range(0, len(words.ids), rows):
        some = range(at, min(at + rows, len(words.ids)))
        texts, sizes, dropped = [], [], []
        for doc in some:
            a, b = words.starts[doc], words.starts[doc + 1]
            stay = kept[a:b]
            own = words.words[doc]
            if not stay.all():
                own = [own[i] for i in np.flatnonzero(stay).tolist()]
            texts.append(b" ".join(own).decode())
            sizes.append(int(b - a))
            dropped.append(int(b - a) - len(own))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words.ids[at : at + rows], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(dropped, pa.int64()),
                pa.array(texts, pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )
