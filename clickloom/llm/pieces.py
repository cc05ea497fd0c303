"""SentencePiece encoding and decoding with a unigram model.

Pieces are held in a double-array trie; the best segmentation is found by Viterbi search over log
scores. Characters that no piece covers become byte pieces. White space is part of the pieces, as a
marker.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.text import Memo, as_bytes, kept_by_worker

# Fixed values of the format.
MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0  # below the lowest score of a piece
UNKNOWN_TEXT = " ⁇ ".encode()

# White space stays with what follows it, unless that is a newline, which no usual piece has.
RUN = re.compile(rb"\n| *[^ \n]+| +")
TAIL = b".,!?;:|*$%&#"


class DoubleArray:
    """A trie over bytes: the child of node s for byte c is base[s] + c + 1, if check there is s."""

    def __init__(self, words: dict[bytes, int]):
        items = sorted(words.items())
        size = 300 + 2 * sum(map(len, words))
        self._taken = np.zeros(size, bool)
        self._taken[0] = True
        self._free = 1  # hardly any slot before it is free
        base, check, value = np.zeros(size, int), np.full(size, -1), np.full(size, -1)
        waiting = [(0, 0, len(items), 0)]
        while waiting:
            node, start, end, depth = waiting.pop()
            if start < end and len(items[start][0]) == depth:
                value[node] = items[start][1]
                start += 1
            children = []
            while start < end:
                byte, stop = items[start][0][depth], start
                while stop < end and items[stop][0][depth] == byte:
                    stop += 1
                children.append((byte + 1, start, stop))
                start = stop
            if children:
                base[node] = place = self._place(np.array([code for code, _, _ in children]))
                for code, first, last in children:
                    check[place + code] = node
                    waiting.append((place + code, first, last, depth + 1))
        used = int(np.flatnonzero(self._taken)[-1]) + 1
        del self._taken
        self.base, self.check, self.value = (x[:used].tolist() for x in (base, check, value))

    def _place(self, codes: np.ndarray, window: int = 1024) -> int:
        """A base for which all slots are free; takes them."""
        at = self._free
        while True:
            free = at + np.flatnonzero(~self._taken[at : at + window])
            bases = free[free >= codes[0]] - codes[0]
            fits = ~self._taken[(bases[:, None] + codes).clip(max=len(self._taken) - 1)].any(axis=1)
            if fits.any():
                break
            if at == self._free and len(free) < window // 20:
                self._free += window
            at += window
        found = int(bases[fits.argmax()])
        self._taken[found + codes] = True
        return found


def zipf_scores(ranks: list[int]) -> list[float]:
    """Log probabilities of pieces by rank, where a model has ranks instead of probabilities."""
    total = math.log(math.fsum(1 / (rank + 2.7) for rank in ranks))
    return [-math.log(rank + 2.7) - total for rank in ranks]


class Pieces:
    """The vocabulary of a model file: pieces, their log scores, and the trie.

    A unigram model's own scores are used. A merge-based model orders its pieces by rank; its
    pieces get Zipf's log probability for their rank.
    """

    def __init__(self, model_file: str, scores: list[float] | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        names = [model.id_to_piece(at).encode() for at in range(size)]
        self.byte_ids = [model.piece_to_id(f"<0x{byte:02X}>") for byte in range(256)]
        bytes_ = {at: byte for byte, at in enumerate(self.byte_ids) if model.is_byte(at)}
        self.unknown = model.unk_id()
        special = (model.is_control, model.is_unknown, model.is_unused)
        normal = [
            at for at in range(size) if at not in bytes_ and not any(test(at) for test in special)
        ]
        if scores is None:
            scores = [model.get_score(at) for at in range(size)]
            if min(scores) < -1000:  # ranks
                order = sorted(normal, key=lambda at: (-scores[at], at))
                for at, score in zip(order, zipf_scores(list(range(len(order)))), strict=True):
                    scores[at] = score
        self.scores = scores
        self.lowest = min(scores[at] for at in normal) - UNKNOWN_PENALTY
        self.trie = DoubleArray({names[at]: at for at in normal})
        self.has_bytes = len(bytes_) == 256
        marks = TAIL.decode()
        inner = [names[at].decode().replace("▁", " ").lstrip(" ") for at in normal]
        # Then the best path never crosses into white space, over a newline, or from a letter to a mark.
        self.splits = not any(
            " " in name or "\n" in name or any(a.isalpha() and b in marks for a, b in pairwise(name))
            for name in inner
        )
        self.spoken = [
            bytes([bytes_[at]])
            if at in bytes_
            else UNKNOWN_TEXT
            if at == self.unknown
            else b""
            if model.is_control(at)
            else names[at].replace(MARK, b" ")
            for at in range(size)
        ]

    def best(self, text: bytes) -> tuple[bytes, float, int]:
        """Ids (4 bytes each), score and number of byte pieces of the best segmentation."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        size, scores = len(check), self.scores
        end = len(text)
        score: list[float | None] = [None] * (end + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (end + 1)
        score[0] = 0.0
        for start in range(end):
            here = score[start]
            if here is None:
                continue
            first = text[start]
            char = start + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            node, single = 0, False
            for at in range(start, end):
                child = base[node] + text[at] + 1
                if child >= size or check[child] != node or child == 0:
                    break
                node = child
                piece = value[node]
                if piece >= 0:
                    reached = here + scores[piece]
                    single = single or at + 1 == char
                    known = score[at + 1]
                    if known is None or reached > known:
                        score[at + 1], back[at + 1] = reached, (start, piece)
            if not single:
                reached, known = here + self.lowest, score[char]
                if known is None or reached > known:
                    score[char], back[char] = reached, (start, -1)
        ids, n_bytes, at = [], 0, end
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            elif self.has_bytes:
                ids += [self.byte_ids[byte] for byte in reversed(text[start:at])]
                n_bytes += at - start
            else:
                ids.append(self.unknown)
            at = start
        return np.array(ids[::-1], "<i4").tobytes(), score[end], n_bytes

    def best_of_run(self, run: bytes, stems: Memo) -> tuple[bytes, float, int]:
        """Like ``best`` for one of ``runs``, with a word and the marks after it looked up apart."""
        stem = run.rstrip(TAIL)
        if self.splits and len(stem) < len(run) and stem[-4:].decode(errors="ignore")[-1:].isalpha():
            one, two = stems[stem], stems[run[len(stem) :]]
            return one[0] + two[0], one[1] + two[1], one[2] + two[2]
        return stems[run]

    def runs(self, text: bytes) -> list[bytes]:
        """Parts of a text that are segmented each for itself."""
        if not text:
            return []
        text = b" " + text.replace(MARK, b" ")
        return RUN.findall(text) if self.splits else [text]

    def speak(self, ids: list[int]) -> str:
        """The text of a sequence of ids, without the marker that starts every text."""
        text = b"".join(map(self.spoken.__getitem__, ids))
        return text.removeprefix(b" ").decode(errors="replace")


def encode(
    docs: DataFrame,
    model_file: str,
    scores: list[float] | None = None,
    with_decoded: bool = False,
    most_known: int = 3 << 18,
) -> DataFrame:
    """``docs`` with ids (array<int>), n_pieces, n_byte_pieces and log_score of the whole text.

    With ``with_decoded`` also the text that the ids stand for, made from them in the same pass.
    NULL and empty texts have no pieces and score 0. Columns of the same names are replaced. The
    text is taken as it is: a space becomes the marker, one marker goes in front. A character that
    is the marker itself counts as a space. Words are segmented once per worker and looked up after
    that, ``most_known`` of them; the vocabulary travels with the tasks and does not grow with the
    data.
    """
    names = ["ids", "n_pieces", "n_byte_pieces", "log_score"] + ["decoded"] * with_decoded
    kept = docs.drop(*names)
    pieces = Pieces(model_file, scores)
    vocabulary = ("pieces", model_file, scores and tuple(scores))

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, stems = kept_by_worker(
            vocabulary, lambda: (Memo(None, most_known // 3), Memo(None, most_known))
        )
        known.of = lambda run: pieces.best_of_run(run, stems)
        stems.of = lambda stem: pieces.best(stem.replace(b" ", MARK))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                known.trim()
                stems.trim()
                ids, totals, n_bytes = [], [], []
                for text in as_bytes(some.column("text")):
                    found = [known[run] for run in pieces.runs(text)]
                    ids.append(b"".join([f[0] for f in found]))
                    totals.append(math.fsum([f[1] for f in found]))
                    n_bytes.append(sum([f[2] for f in found]))
                lengths = np.array([len(i) // 4 for i in ids], np.int64)
                offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                columns = [
                    *some.columns,
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                    pa.array(lengths),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(totals, pa.float64()),
                ]
                if with_decoded:
                    said = [pieces.speak(np.frombuffer(i, "<i4").tolist()) for i in ids]
                    columns.append(pa.array(said, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*some.schema.names, *names])

    kinds = (T.ArrayType(T.IntegerType()), T.LongType(), T.LongType(), T.DoubleType(), T.StringType())
    added = [T.StructField(name, kind) for name, kind in zip(names, kinds)]
    return kept.mapInArrow(segment, T.StructType([*kept.schema.fields, *added]))


def decoded(ids: Column, model_file: str) -> Column:
    """The text that an array of ids stands for; NULL stays NULL, an empty array is empty.

    Control pieces are silent, bytes that make no character become replacement characters, and an
    id outside the vocabulary is an error.
    """
    pieces = Pieces(model_file)

    @F.arrow_udf("string")
    def speak(column: pa.Array) -> pa.Array:
        rows = (row.as_py() for row in column)
        return pa.array([None if ids is None else pieces.speak(ids) for ids in rows], pa.string())

    return speak(ids)
