"""Elias-Fano coded sequences, searched where they lie, and levels of an n-gram trie made of them."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

CHUNK = 1 << 16  # values whose bits are handled at once
STEPS = 1 << 12  # steps per power of ten of quantised logarithms


def _words(bits: np.ndarray) -> bytes:
    """Bits as whole 64-bit words, the last of them empty."""
    data = np.packbits(bits, bitorder="little").tobytes()
    return data + bytes(16 - len(data) % 8)


def encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of uint64: per value some low bits, and two bits or so for the
    rest.
    """
    count, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // max(count, 1)).bit_length() - 1)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(count)
    bits = np.zeros(int(high[-1]) + 1 if count else 0, np.uint8)
    bits[high] = 1
    upper = _words(bits)
    parts, places = [], np.arange(low, dtype=np.uint64)
    for at in range(0, count if low else 0, CHUNK):
        some = (values[at : at + CHUNK, None] >> places) & np.uint64(1)
        parts.append(np.packbits(some.astype(np.uint8).ravel(), bitorder="little").tobytes())
    lower = b"".join(parts)
    head = np.array([count, low, len(upper) // 8, top >> low], "<u8")
    return head.tobytes() + upper + lower + bytes(16 - len(lower) % 8)


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the set bit of each rank is in each word, by halving."""
    word, rank, place = word.copy(), rank.astype(np.uint64), np.zeros(len(word), np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        inside = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.uint64)
        beyond = rank >= inside
        rank -= np.where(beyond, inside, np.uint64(0))
        step = beyond * np.uint64(width)
        word >>= step
        place += step
    return place.astype(np.int64)


class Sequence:
    """An encoded sequence, read in place by select on its bits.

    Only a count of ones per 64 bits is made; values are put together when they are asked for.
    """

    def __init__(self, data):
        self.count, self.low, size, self.top = (int(x) for x in np.frombuffer(data, "<u8", 4))
        self.upper = np.frombuffer(data, "<u8", size, 32)
        lower = -(-self.count * self.low // 64) + 1
        self.lower = np.frombuffer(data, "<u8", lower, 32 + 8 * size)
        self.ones = np.zeros(size + 1, np.int64)
        np.cumsum(np.bitwise_count(self.upper), out=self.ones[1:])
        self.zeros = 64 * np.arange(size + 1) - self.ones

    def _one(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ones, rank, "right") - 1
        return 64 * at + _select(self.upper[at], rank - self.ones[at])

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.zeros, rank, "right") - 1
        return 64 * at + _select(~self.upper[at], rank - self.zeros[at])

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        both = self.lower[word] >> shift
        both |= (self.lower[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return both & np.uint64((1 << self.low) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        high = (self._one(at) - at).astype(np.uint64)
        return (high << np.uint64(self.low)) | self._low(at)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first value is that is not below each wanted one, and whether it equals it."""
        place, found = np.full(len(wanted), self.count), np.zeros(len(wanted), bool)
        wanted = wanted.astype(np.uint64, copy=False)
        high = wanted >> np.uint64(self.low)
        inside = np.flatnonzero(high <= np.uint64(self.top)) if self.count else np.empty(0, np.int64)
        for at in range(0, len(inside), CHUNK):
            some = inside[at : at + CHUNK]
            place[some], found[some] = self._find(wanted[some], high[some].astype(np.int64))
        return place, found

    def _find(self, wanted: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values that share the high bits lie between two zeros; search their low bits."""
        rest = wanted & np.uint64((1 << self.low) - 1)
        first = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - (high - 1), 0)
        ends = self._zero(high) - high
        last, open_ = ends.copy(), np.flatnonzero(first < ends)
        while len(open_):
            middle = (first[open_] + last[open_]) >> 1
            below = self._low(middle) < rest[open_]
            first[open_[below]] = middle[below] + 1
            last[open_[~below]] = middle[~below]
            open_ = open_[first[open_] < last[open_]]
        found = first < ends
        found[found] = self._low(first[found]) == rest[found]
        return first, found


def quantise(probability: np.ndarray) -> np.ndarray:
    """Codes of probabilities, rounded down; 0 stands for none."""
    with np.errstate(divide="ignore"):
        steps = np.ceil(-np.log10(probability) * STEPS) + 1
    return np.where(probability > 0, steps.clip(1, 65535), 0).astype("<u2")


def probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** -((codes.astype(np.float64) - 1) / STEPS), 0.0)


def pack_parts(*parts: bytes) -> bytes:
    sizes = np.array([len(parts), *map(len, parts)], "<u8")
    return sizes.tobytes() + b"".join(parts)


def unpack_parts(data) -> list[memoryview]:
    view = memoryview(data)
    count = int(np.frombuffer(view, "<u8", 1)[0])
    ends = 8 * (count + 1) + np.cumsum([0, *np.frombuffer(view, "<u8", count, 8).tolist()])
    return [view[start:end] for start, end in zip(ends[:-1], ends[1:], strict=True)]


def mapped(data: bytes) -> mmap.mmap:
    """``data`` in a nameless file of the task's own, mapped into memory.

    File and mapping are gone with the last array that looks at them.
    """
    with tempfile.TemporaryFile() as file:
        file.write(data)
        file.flush()
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


class Words:
    """One shard of a trie's first level: words with a code each."""

    @staticmethod
    def build(words: np.ndarray, codes: np.ndarray) -> bytes:
        return pack_parts(encode(words), codes.astype("<u2").tobytes())

    def __init__(self, data):
        words, codes = unpack_parts(data)
        self.words, self.codes = Sequence(words), np.frombuffer(codes, "<u2")

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word, -1 where it does not occur, and its code, 0 there."""
        place, found = self.words.find(wanted)
        codes = np.zeros(len(wanted), "<u2")
        codes[found] = self.codes[place[found]]
        return np.where(found, place, -1), codes


class Successors:
    """One shard of a trie's second level: contexts, and the words that follow each of them.

    Contexts and the pointers to their first successors are monotone. Successors are sorted
    within a context; each is stored relative to the end of the context before, which makes the
    whole level monotone, so one search finds a successor of a given context.
    """

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, codes: np.ndarray, rest: np.ndarray) -> bytes:
        """From pairs sorted by context, then word: with a code each, and one per context."""
        firsts = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        sizes = np.diff(np.append(firsts, len(context)))
        ends = word[firsts + sizes - 1].astype(np.uint64) + np.uint64(1)
        base = np.cumsum(ends) - ends
        return pack_parts(
            encode(context[firsts].astype(np.uint64)),
            encode(firsts.astype(np.uint64)),
            encode(word.astype(np.uint64) + np.repeat(base, sizes)),
            codes.astype("<u2").tobytes(),
            rest.astype("<u2").tobytes(),
        )

    def __init__(self, data):
        contexts, firsts, words, codes, rest = unpack_parts(data)
        self.contexts, self.firsts, self.words = map(Sequence, (contexts, firsts, words))
        self.codes, self.rest = np.frombuffer(codes, "<u2"), np.frombuffer(rest, "<u2")

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each pair, 0 where it does not occur.

        A context's pointer leads to its successors; the search among them is relative to it.
        """
        result = np.zeros(len(word), "<u2")
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        at, known = self.contexts.find(context[starts])
        sizes = np.diff(np.append(starts, len(context)))
        asked = np.flatnonzero(np.repeat(known, sizes))
        if not len(asked):
            return result
        at, sizes = at[known], sizes[known]
        first = self.firsts.get(at).astype(np.int64)
        ends = np.full(len(at), self.words.count)
        inner = at + 1 < self.contexts.count
        ends[inner] = self.firsts.get(at[inner] + 1).astype(np.int64)
        base = np.zeros(len(at), np.uint64)
        base[first > 0] = self.words.get(first[first > 0] - 1) + np.uint64(1)
        place, found = self.words.find(word[asked].astype(np.uint64) + np.repeat(base, sizes))
        found &= place < np.repeat(ends, sizes)
        result[asked[found]] = self.codes[place[found]]
        return result

    def find_rest(self, context: np.ndarray) -> np.ndarray:
        """The code of each context, 0 where it does not occur."""
        at, known = self.contexts.find(context)
        result = np.zeros(len(context), "<u2")
        result[known] = self.rest[at[known]]
        return result
