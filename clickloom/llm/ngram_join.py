"""Similarity join of documents on word shingles, through a token-group matrix.

Similar documents form groups of bounded size; the matrix says which tokens (shingle hashes) occur
in which group. The overlap of a query with a group's token union bounds its overlap with every
member, so only groups whose bound reaches the threshold are opened and compared exactly.

The bound is used from coarse to fine: a document whose tokens do not occur often enough in the
union of all others has no link at all; two groups are candidates for each other only if they share
one of the rarest tokens of members; of these, only sets whose marks (a bit per token) are near each
other's are sent; and a query is compared with a group's members only if the group's whole union
covers enough of it.

Only connections are wanted, so documents known to be connected need not be compared. Members of a
group are compared first, then everybody with the most central document that shares a rare token
with them, which connects clusters of copies of one text however large they are; then what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.components import components
from clickloom.llm.text import Memo, as_bytes, stored, word_hashes

LOWEST = -(2**63)  # stands for a NULL doc_id
EMPTY = np.zeros(0, np.uint64)

HALF = np.uint64(32)

# Odd numbers with well mixed bits, to combine hashes.
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)]

# What is known of a set's shared tokens: how many, sets that have them, and the most spread one.
TALLY = np.dtype(
    [("class", "<i8"), ("shared", "<i8"), ("spread", "<i8"), ("most", "<i8"), ("token", "<i8")]
)

EDGES = pa.schema([("node", pa.binary()), ("other", pa.binary())])
_EDGES_DDL = "node binary, other binary"


def shingle_set(text: bytes, hashes: Memo, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word windows of a text, A-Z lower-cased.

    Fewer words are one shingle as a whole; no words, none.
    """
    words = text.lower().split()
    if not words:
        return EMPTY
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    single = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    windows = len(words) - width + 1
    mixed = single[:windows].copy()
    for place in range(1, width):
        mixed *= _MIX[0]
        mixed ^= mixed >> np.uint64(29)
        mixed += single[place : place + windows]
    mixed *= _MIX[1]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def set_key(shingles: np.ndarray) -> bytes:
    """Names a set of shingles; equal sets have equal keys."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def short(key: bytes) -> int:
    """The first half of a key as a signed number."""
    return int.from_bytes(key[:8], "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    """(row of the batch, batch, set) for each document."""
    hashes = word_hashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            hashes.trim()
            for row, text in enumerate(as_bytes(some.column("text"))):
                yield some, row, shingle_set(text, hashes, width)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per document: its id, the size of its set, the set's key (NULL if empty) and short key."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, rows = None, []
        for some, row, shingles in _sets(batches, width):
            if row == 0 and rows:
                yield _signed(batch, rows)
                rows = []
            batch = some
            rows.append((len(shingles), set_key(shingles) if len(shingles) else None))
        if rows:
            yield _signed(batch, rows)

    def _signed(batch, rows):
        sizes, keys = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array([key and short(key) for key in keys], pa.int64()),
            ],
            ["doc_id", "n_shingles", "key", "class"],
        )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        sign, "doc_id bigint, n_shingles bigint, key binary, class bigint"
    )


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on as one binary, each as narrow as its largest number allows."""
    widths = [
        next(w for w in (1, 2, 4, 8) if w == 8 or not len(column) or int(column.max()) >> 8 * w == 0)
        for column in columns
    ]
    head = [len(columns), *(x for w, column in zip(widths, columns, strict=True) for x in (w, len(column)))]
    parts = [np.array(head, "<u4")]
    parts += [column.astype(f"<u{w}") for w, column in zip(widths, columns, strict=True)]
    return b"".join(part.tobytes() for part in parts)


def unpacked(blob: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(blob, "<u4", 1)[0])
    head = np.frombuffer(blob, "<u4", 2 * count, 4).tolist()
    at, columns = 4 + 8 * count, []
    for width, length in zip(head[::2], head[1::2], strict=True):
        columns.append(np.frombuffer(blob, f"<u{width}", length, at))
        at += width * length
    return columns


def shared_counts(
    docs: DataFrame, width: int, ranges: int, held: int = 1 << 20, copied: DataFrame | None = None
) -> DataFrame:
    """(class, shared, spread, sketch): of each set with tokens that occur in other sets too, how
    many these are, in how many sets they are in sum, and which token is in the most sets.

    Tokens go to tasks by range of their hash, packed in one binary per task and range: of each
    set, 4 bytes per token, which with the range tell tokens apart well enough that counts come
    out at most a little high: two tokens of one set that look the same still count as two. A set
    that a task meets twice is sent once, so copies of a text are one set per task.

    ``copied`` lists at least the documents (doc) whose set others have too; without it, all may be.
    Only their sets are sent with their names, so that copies are known as one set wherever they come
    from. Others go by their place in the binary's pack, and what is found is sent back to the pack,
    so that a token costs 6 bytes at most however many ranges there are.
    """

    def pack(sets: list[tuple[int, bool, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sets = sorted(sets, key=lambda one: not one[1])
        names = np.array([key for key, _, _ in sets], "<i8").view("<u8")
        known = sum(named for _, named, _ in sets)
        others = len(sets) - known
        own = int(names[known]) if others else 0
        tokens = np.concatenate([shingles for _, _, shingles in sets])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(one[2]) for one in sets])
        place = (((tokens >> HALF) * np.uint64(ranges)) >> HALF).astype(np.int32)
        order = np.argsort(place, kind="stable")
        tokens, owner, place = tokens[order].astype("<u4"), owner[order], place[order]
        cuts = np.searchsorted(place, np.arange(ranges + 1))
        to, blobs = [], []
        for at in np.flatnonzero(np.diff(cuts)).tolist():
            start, end = cuts[at], cuts[at + 1]
            middle = start + np.searchsorted(owner[start:end], known)
            firsts = np.flatnonzero(np.diff(owner[start:middle], prepend=-1))
            sizes = np.diff(np.append(firsts, middle - start))
            # Who has the other tokens: each one's owner, or how many each set has, if that is less.
            owners = owner[middle:end] - known
            each = 2 if others <= 1 << 16 else 4
            counted = others < each * len(owners)
            if counted:
                owners = np.bincount(owners, minlength=others)
            head = np.array([own, others, counted], np.uint64)
            to.append(at)
            blobs.append(
                packed(head, names[owner[start:middle][firsts]], sizes, owners, tokens[start:end])
            )
        if others:
            to.append(-1 - own % ranges)
            blobs.append(packed(np.array([0, own, 0], np.uint64), names[known:]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], ["range", "blob"]
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sets, size = set(), [], 0
        for batch, row, shingles in _sets(batches, width):
            key = short(set_key(shingles))
            if len(shingles) and key not in seen:
                seen.add(key)
                sets.append((key, batch.column("perhaps")[row].as_py(), shingles))
                size += len(shingles)
                if size >= held:
                    yield from pack(sets)
                    sets, size = [], 0
        if sets:
            yield from pack(sets)

    def count(key: tuple, blobs: pa.Table) -> pa.Table:
        at, blobs = key[0].as_py(), blobs.column("blob").to_pylist()
        if at < 0:  # the names of packs, on their way to what is sent back to these
            return _parts([-1 - at] * len(blobs), blobs)
        sent = [unpacked(blob) for blob in blobs]
        del blobs
        names = np.unique(np.concatenate([one[1].astype(np.uint64) for one in sent]))
        # Sets with names come first, then those of each pack.
        bases = np.cumsum([len(names), *(int(one[0][1]) for one in sent)])
        times = np.ones(bases[-1], np.int64)
        times[: len(names)] = 0
        pairs, end = np.empty(sum(len(one[4]) for one in sent), np.uint64), 0
        for (head, known, sizes, owners, tokens), base in zip(sent, bases, strict=False):
            some = pairs[end : end + len(tokens)]
            end += len(tokens)
            some[:] = tokens
            some <<= HALF
            place = np.searchsorted(names, known)
            times[place] += 1
            middle = int(sizes.sum(dtype=np.int64))
            some[:middle] |= np.repeat(place.astype(np.uint64), sizes)
            if head[2]:
                owners = np.repeat(np.arange(len(owners), dtype=np.uint32), owners)
            some[middle:] |= owners.astype(np.uint64) + np.uint64(base)
        packs = [one[0][0] for one in sent]
        del sent
        pairs.sort()
        firsts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        repeats = np.diff(np.append(firsts, len(pairs)))
        pairs = pairs[firsts]
        token = (pairs >> HALF).astype(np.uint32)
        firsts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        spread = np.diff(np.append(firsts, len(token)))
        shared = np.repeat(spread > 1, spread)
        spread = spread[spread > 1]
        owner = (pairs[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows = np.empty(len(owner), TALLY)
        rows["class"], rows["token"] = owner, token[shared]
        # More often than the set was sent: several of its tokens.
        rows["shared"] = np.maximum(1, repeats[shared] // times[owner])
        rows["spread"] = rows["most"] = np.repeat(spread, spread)
        del pairs, token, firsts, repeats, shared, owner
        rows = added_up(rows)
        to, back = [], []
        cuts = np.searchsorted(rows["class"], bases)
        for start, end, base, own in zip(cuts, cuts[1:], bases, packs, strict=False):
            if start < end:
                some = rows[start:end]
                gaps = np.diff(some["class"] - base, prepend=0)
                to.append(int(own) % ranges)
                back.append(packed(np.array([1, own, at], np.uint64), gaps, *_tallies(some)))
        some, place = rows[: cuts[0]], names[rows["class"][: cuts[0]]]
        part = place % np.uint64(ranges)
        order = np.argsort(part, kind="stable")
        some, place, part = some[order], place[order], part[order]
        firsts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
        for start, end in zip(firsts, np.append(firsts[1:], len(part)), strict=False):
            to.append(int(part[start]))
            head = np.array([2, 0, at], np.uint64)
            back.append(packed(head, place[start:end], *_tallies(some[start:end])))
        return _parts(to, back)

    def total(blobs: pa.Table) -> pa.Table:
        sent = [unpacked(blob) for blob in blobs.column("blob").to_pylist()]
        names = {int(head[1]): rest[0].astype(np.uint64) for head, *rest in sent if head[0] == 0}
        sent = [one for one in sent if one[0][0] > 0]
        rows, end = np.empty(sum(len(one[1]) for one in sent), TALLY), 0
        for head, which, shared, more, most, token in sent:
            some = rows[end : end + len(which)]
            end += len(which)
            if head[0] == 1:
                which = names[int(head[1])][np.cumsum(which, dtype=np.int64)]
            some["class"] = which.astype(np.uint64).view(np.int64)
            some["shared"], some["most"] = shared, most
            some["spread"] = some["most"] + more.astype(np.int64)
            some["token"] = token.astype(np.int64) + (int(head[2]) << 32)
        rows = added_up(rows)
        columns = {name: rows[name].astype(np.int64) for name in ("class", "shared", "spread")}
        return pa.table(columns | {"sketch": rows["token"].astype(np.int64)})

    if copied is None:
        rows = docs.select("text", F.lit(True).alias("perhaps"))
    else:
        rows = with_perhaps(docs.select(_doc(), "text"), copied, "doc").select("text", "perhaps")
    return (
        rows.mapInArrow(send, "range bigint, blob binary")
        .groupBy("range")
        .applyInArrow(count, "part bigint, blob binary")
        .groupBy("part")
        .applyInArrow(total, "class bigint, shared bigint, spread bigint, sketch bigint")
    )


def _parts(parts: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table({"part": pa.array(parts, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _tallies(rows: np.ndarray) -> list[np.ndarray]:
    return [rows["shared"], rows["spread"] - rows["most"], rows["most"], rows["token"]]


def added_up(rows: np.ndarray) -> np.ndarray:
    """One row per class: sums, and the token that is in the most sets."""
    rows = rows[np.lexsort((rows["token"], rows["most"], rows["class"]))]
    firsts = np.flatnonzero(np.append(True, rows["class"][1:] != rows["class"][:-1])[: len(rows)])
    last = np.append(firsts[1:], len(rows))[: len(firsts)] - 1
    result = rows[last].copy()
    for name in ("shared", "spread"):
        result[name] = np.add.reduceat(rows[name], firsts) if len(firsts) else 0
    return result


def _full_sets(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(key, n, spread, sketch, home, marks, tokens) of the chosen documents (doc, key to home)."""

    narrow = ["key", "n", "spread", "sketch", "home"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, shingles in _sets(batches, width):
            key = batch.column("key")[row].as_py()
            if set_key(shingles) == key:  # else another text under the same doc_id
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(name).slice(row, 1) for name in narrow),
                        pa.array([marks(shingles).tobytes()], pa.binary()),
                        pa.array([shingles.view(np.int64)], pa.list_(pa.int64())),
                    ],
                    [*narrow, "marks", "tokens"],
                )

    # Merged, since the chosen ones grow with the documents; most others are not even shuffled.
    near = _perhaps_among(docs.select(_doc(), "text"), chosen, "doc")
    texts = near.join(chosen.hint("merge"), "doc").select(*narrow, "text")
    return texts.mapInArrow(
        load,
        "key binary, n bigint, spread bigint, sketch bigint, home bigint, marks binary, tokens array<bigint>",
    )


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("doc")


def _perhaps_among(rows: DataFrame, chosen: DataFrame, key: str, **sizes: int) -> DataFrame:
    """The rows whose key is in ``chosen``, and a few others, without a shuffle of rows."""
    return with_perhaps(rows, chosen, key, **sizes).filter("perhaps").select(rows.columns)


def with_perhaps(
    rows: DataFrame, chosen: DataFrame, key: str, bits_each: int = 16, most_bits: int = 1 << 29
) -> DataFrame:
    """``rows`` with perhaps: true if the key is in ``chosen``, and for a few others.

    Hashes of the chosen keys are marked in a bitmap, which is broadcast: ``bits_each`` bits a key, 64 MB
    at most. Beyond that more of the others get through, and nothing else changes.
    """
    bits = 1 << 15
    wanted = min(most_bits, bits_each * chosen.count())
    while bits < wanted:
        bits *= 2
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    page, bit = F.shiftright(place, 15), place % (1 << 15)
    marked = stored(
        chosen.groupBy(page.alias("bitmap_page")).agg(F.bitmap_construct_agg(bit).alias("bitmap_marks")),
        "marks",
    )
    byte = F.substring("bitmap_marks", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    seen = F.coalesce(F.getbit(value, (bit % 8).cast("int")) == 1, F.lit(False))
    paged = rows.join(F.broadcast(marked), page == F.col("bitmap_page"), "left")
    return paged.select(*rows.columns, seen.alias("perhaps"))


def marks(shingles: np.ndarray) -> np.ndarray:
    """One bit per shingle and more, each the parity of the shingles that it stands for.

    A shingle that only one of two sets has changes one bit, so marks of two sets differ in at most
    as many bits as there are such shingles.
    """
    bits = 64
    while bits < len(shingles):
        bits *= 2
    place, counts = np.unique(shingles & np.uint64(bits - 1), return_counts=True)
    odd = np.zeros(bits, np.uint8)
    odd[place.astype(np.int64)] = counts & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def _folded(marks: np.ndarray, length: int) -> np.ndarray:
    """Marks (in the last axis) as they are with fewer bits."""
    while marks.shape[-1] > length:
        half = marks.shape[-1] // 2
        marks = marks[..., :half] ^ marks[..., half:]
    return marks


class Marks:
    """The marks of some sets, and the most that each can have in common with another set."""

    def __init__(self, sizes: np.ndarray, marks: list[bytes]):
        self.sizes, self.rows, self.tables = sizes, {}, {}
        lengths = np.array([len(one) // 8 for one in marks])
        for length in np.unique(lengths).tolist():
            self.rows[length] = np.flatnonzero(lengths == length)
            some = b"".join(marks[row] for row in self.rows[length])
            self.tables[length, length] = np.frombuffer(some, "<u8").reshape(-1, length)

    def may_link(self, size: int, own: bytes, percent: int) -> np.ndarray:
        """The rows of sets that a set may link with by size and marks."""
        found, own = [np.zeros(0, np.int64)], np.frombuffer(own, "<u8")
        for length, rows in self.rows.items():
            less = min(length, len(own))
            if (length, less) not in self.tables:
                self.tables[length, less] = _folded(self.tables[length, length], less)
            apart = np.bitwise_count(self.tables[length, less] ^ _folded(own, less))
            sizes = self.sizes[rows]
            both = (size + sizes - apart.sum(axis=1, dtype=np.int64)) // 2
            both = np.minimum(both, np.minimum(size, sizes))
            found.append(rows[100 * both >= percent * (size + sizes - both)])
        return np.concatenate(found)


def _homes(sets: DataFrame, by: list[str], most: int, most_tokens: int) -> DataFrame:
    """``sets`` with home, the group: sets with equal ``by``, in parts of bounded size."""
    sizes = sets.groupBy(*by).agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    parts = F.greatest(F.ceil(F.col("sets") / most), F.ceil(F.col("tokens") / most_tokens))
    of = {name: f"{name}_of" for name in by}
    large = sizes.select(*by, parts.alias("parts")).filter("parts > 1").withColumnsRenamed(of)
    part = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))
    # A NULL in ``by`` equals other NULLs, and is parted like any value.
    same = reduce(and_, (F.col(name).eqNullSafe(F.col(of[name])) for name in by))
    homes = sets.join(large, same, "left").withColumn("home", F.xxhash64(*by, part))
    return homes.drop("parts", *of.values())


class Group:
    """The members of an open group: the tokens of their union, and who has each."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("key")
        self.keys = table.column("key").to_pylist()
        members = table.column("tokens").combine_chunks()
        self.sizes = np.diff(members.offsets.to_numpy())
        tokens = members.flatten().to_numpy()
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owner, tokens = owner[order], tokens[order]
        self.starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
        self.union = tokens[self.starts]
        self.counts = np.diff(np.append(self.starts, len(tokens)))

    def links(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The members that a query links with; none without a look if the bound excludes them."""
        place = np.searchsorted(self.union, tokens).clip(max=len(self.union) - 1)
        place = place[self.union[place] == tokens]
        if 100 * len(place) < percent * len(tokens):
            return np.zeros(0, np.int64)
        counts = self.counts[place]
        # All owners of all shared tokens: the stretches that begin at starts.
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) + np.repeat(self.starts[place] - (ends - counts), counts)
        both = np.bincount(self.owner[at], minlength=len(self.keys))
        return np.flatnonzero(100 * both >= percent * (len(tokens) + self.sizes - both))


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    nodes, others = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.Table.from_arrays(
        [pa.array(nodes, pa.binary()), pa.array(others, pa.binary())], schema=EDGES
    )


def _links_within(sets: DataFrame, percent: int) -> DataFrame:
    """Edges that connect the members of each group as far as their links do."""

    def open_own(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return _edges([])
        group, found = Group(table), []
        sets = table.sort_by("key").column("tokens").combine_chunks()
        linked = [group.links(sets[at].values.to_numpy(), percent) for at in range(len(sets))]
        left = set(range(len(group.keys)))
        while left:
            frontier = [left.pop()]
            while frontier:
                at = frontier.pop()
                near = [other for other in linked[at].tolist() if other in left]
                found += [(group.keys[at], group.keys[other]) for other in near]
                left.difference_update(near)
                frontier += near
        return _edges(found)

    return sets.select("home", "key", "tokens").groupBy("home").applyInArrow(open_own, _EDGES_DDL)


def _rare_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(token, key, n, spread, rest): each set's prefix, as far as it occurs in other groups too.

    Tokens are ordered by the number of groups that have them, rarest first; rest tells how many
    tokens of the set there are from this one on. Two sets that link share a token of the first
    n - ceil(percent n / 100) + 1 of both, whatever the order.
    """
    # Dealt by group, so that only what is left of a group is shuffled by token.
    matrix = sets.repartition("home").select("home", F.explode("tokens").alias("token")).distinct()
    spread = F.count("*").over(Window.partitionBy("token"))
    shared = (
        matrix.withColumn("groups", spread)
        .filter("groups > 1")
        .groupBy(F.col("home").alias("group"))
        .agg(F.collect_list(F.struct("token", "groups")).alias("shared"))
        .select("group", F.col("shared.token").alias("shared"), F.col("shared.groups").alias("groups"))
    )

    def prefixes(members: pa.Table, row: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if row.num_rows:
            shared = np.array(row.column("shared")[0].as_py(), np.int64)
            groups = np.array(row.column("groups")[0].as_py(), np.int64)
            by_token = np.argsort(shared)
            shared, groups = shared[by_token], groups[by_token]
            names = ["key", "n", "spread", "tokens"]
            for key, n, spread, tokens in zip(
                *(members.column(name).to_pylist() for name in names), strict=True
            ):
                tokens = np.array(tokens, np.int64)
                place = np.searchsorted(shared, tokens)
                place = place[np.append(shared, 0)[place] == tokens]
                # The others occur in this group alone, so they come first.
                length = n - -(-percent * n // 100) + 1 - (n - len(place))
                if length > 0:
                    order = np.lexsort((shared[place], groups[place]))[:length]
                    first = shared[place][order].tolist()
                    out += [(token, key, n, spread, len(place) - at) for at, token in enumerate(first)]
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["token", "key", "n", "spread", "rest"],
        )

    return (
        sets.groupBy("home")
        .cogroup(shared.groupBy("group"))
        .applyInArrow(prefixes, "token bigint, key binary, n bigint, spread bigint, rest bigint")
    )


def _labelled(frame: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.withColumnsRenamed({"node": "key"})
    return frame.join(known, "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )


def _mixed(rare: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the tokens that sets of several components share."""
    rare = _labelled(rare, labels)
    mixed = rare.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    return rare.join(mixed.filter("a != b").select("token"), "token", "left_semi")


def _promising(cases: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of each case (case, asks, key, component) that may link with one on its other side.

    Sets are compared by their marks, an eighth of a byte to a fourth per token.
    """
    names = ["case", "asks", "key", "component"]

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        component = table.column("component").combine_chunks().dictionary_encode()
        label = component.indices.to_numpy()
        kept = np.zeros(len(asks), bool)
        members, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        if len(members) and len(queries) and len(component.dictionary) > 1:
            sizes, own = table.column("n").to_numpy(), table.column("marks").to_pylist()
            group = Marks(sizes[members], [own[row] for row in members])
            for row in queries.tolist():
                near = members[group.may_link(int(sizes[row]), own[row], percent)]
                near = near[label[near] != label[row]]
                kept[near] = True
                kept[row] |= len(near) > 0
        return table.select(names).filter(pa.array(kept))

    full = cases.hint("merge").join(sets.select("key", "n", "marks"), "key")
    return (
        full.select(*names, "n", "marks")
        .groupBy("case")
        .applyInArrow(compare, "case bigint, asks boolean, key binary, component binary")
    )


def _compared(cases: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges between the members and the queries of each case (case, asks, key, component).

    A query gets an edge to one member of each component that it links with, its own excepted.
    Only here do the sets themselves move, and only those that may link by their marks.
    """
    cases = stored(_promising(cases, sets, percent), "cases")

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        members, queries = table.filter(pc.invert(asks)), table.filter(asks)
        found = []
        if members.num_rows and queries.num_rows:
            members = members.sort_by("key")
            group, labels = Group(members), members.column("component").to_pylist()
            sets = queries.column("tokens").combine_chunks()
            names = [queries.column(name).to_pylist() for name in ("key", "component")]
            for at, (key, own) in enumerate(zip(*names, strict=True)):
                reached = {own}
                if reached.issuperset(labels):
                    continue
                for other in group.links(sets[at].values.to_numpy(), percent).tolist():
                    if labels[other] not in reached:
                        reached.add(labels[other])
                        found.append((key, group.keys[other]))
        return _edges(found)

    near = _perhaps_among(sets.select("key", "tokens"), cases, "key")
    full = cases.hint("merge").join(near, "key")
    return full.groupBy("case").applyInArrow(compare, _EDGES_DDL)


def _links_to_hubs(
    sets: DataFrame, rare: DataFrame, labels: DataFrame, percent: int, chunk: int = 512
) -> DataFrame:
    """Edges between sets and hubs: for each rare token, the set that has it and is most central.

    Central is a set whose tokens are, on average, in the most sets: the text that others
    are copies of. A set has at most as many hubs as rare tokens. A hub's queries are dealt out
    over cases of some ``chunk``.
    """
    rare = _mixed(rare, labels)
    central = (F.col("spread") / F.col("n")).alias("central")
    hubs = rare.groupBy("token").agg(F.max(F.struct(central, "key", "n", "component")).alias("hub"))
    pairs = stored(
        rare.join(hubs, "token")
        .filter("component != hub.component")
        .filter(f"100 * n >= {percent} * hub.n and 100 * hub.n >= {percent} * n")
        .select("key", "component", F.col("hub.key").alias("hub"), F.col("hub.component").alias("of"))
        .distinct(),
        "hub-pairs",
    )
    chunks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    part = F.pmod(F.xxhash64("key"), F.col("chunks"))
    dealt = pairs.join(chunks, "hub").withColumn("case", F.xxhash64("hub", part))
    asked = dealt.select("case", F.lit(True).alias("asks"), "key", "component")
    opened = dealt.selectExpr("case", "false as asks", "hub as key", "of as component").distinct()
    return _compared(asked.unionByName(opened), sets, percent)


def _links_across(
    sets: DataFrame, rare: DataFrame, labels: DataFrame, percent: int, most: int, most_tokens: int
) -> DataFrame:
    """Edges between all sets that share a rare token and are not known to be connected.

    Sets are grouped anew: those of a large component stay among themselves, so that groups
    within one component drop out as a whole. The others are grouped by sketch, and may now be with
    sets that were in another part of that sketch, so a group is compared with itself too, unless
    the sets that share the token come from one first group.
    """
    large = labels.groupBy("component").count().filter("count >= 16").select("component")
    first = sets.select("key", "n", "sketch", F.col("home").alias("first"))
    named = _labelled(first, labels).join(
        large.withColumn("large", F.col("component")), "component", "left"
    )
    homes = stored(
        _homes(named, ["large", "sketch"], most, most_tokens).selectExpr(
            "key", "component", "first", "home as group"
        ),
        "homes",
    )
    rows = _mixed(rare, labels).join(homes.select("key", "first", "group"), "key")
    matrix = rows.groupBy("token", "group").agg(
        F.min("component").alias("a"),
        F.max("component").alias("b"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.max("rest").alias("rest"),
        (F.min("first") != F.max("first")).alias("apart"),
    )
    other = matrix.drop("apart").toDF("token", "group2", "a2", "b2", "least2", "most2", "rest2")
    # Of two sets that link, the first token they share has all others after it.
    after = F.least("rest", "rest2") * (100 + percent) >= percent * (F.col("least") + F.col("least2"))
    pairs = stored(
        matrix.join(other, "token")
        .filter("group < group2 or (group = group2 and apart)")
        .filter("not (a = b and a2 = b2 and a = a2)")
        .filter(f"100 * most >= {percent} * least2 and 100 * most2 >= {percent} * least")
        .filter(after)
        .select("group", "group2")
        .distinct()
        .withColumn("case", F.monotonically_increasing_id()),
        "group-pairs",
    )
    sides = pairs.selectExpr("case", "stack(2, true, group, false, group2) as (asks, group)")
    cases = sides.join(homes, "group").select("case", "asks", "key", "component")
    return _compared(cases, sets, percent)


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    group_size: int = 128,
    group_tokens: int = 200_000,
    range_tokens: int = 3_000_000,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    A document's set holds its distinct ``width``-word shingles, compared by 64-bit hashes. Two
    documents link when ``100 * intersection >= percent * union``; component_id is the smallest
    doc_id reachable by links. Documents without words link with nothing and keep their own doc_id.
    NULL text counts as empty; a NULL doc_id is smaller than all others. Repeated rows get the same
    result. Other columns are not read.

    Equal sets are joined first, by key, so copies cost one row each. All whole texts are read three
    times: for keys, for token counts, and for the sets of documents that may have links. Groups
    hold at most ``group_size`` sets of ``group_tokens`` tokens together (more only if one set alone
    has more). A cluster of many near copies spans several groups; all are compared with the most
    central of them, and members that this has connected are not compared again.
    """
    signed = stored(signatures(docs, width), "signatures")
    doc = F.coalesce("doc_id", F.lit(LOWEST))
    classes = (
        signed.filter("key is not null")
        .groupBy("key", "class", "n_shingles")
        .agg(F.min(doc).alias("doc"))
    )
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(1, -(-total // range_tokens))
    several = signed.groupBy("class").count().filter("count > 1")
    copied = stored(signed.join(several, "class", "left_semi").select(doc.alias("doc")), "copied")
    may_link = (
        classes.join(shared_counts(docs, width, ranges, copied=copied), "class")
        .filter(f"100 * shared >= {percent} * n_shingles")
        .select("doc", "key", F.col("n_shingles").alias("n"), "spread", "sketch")
    )
    chosen = _homes(stored(may_link, "chosen"), ["sketch"], group_size, group_tokens)
    sets = stored(_full_sets(docs, chosen, width), "sets")
    edges = stored(_links_within(sets, percent), "links")
    rare = stored(_rare_tokens(sets, percent), "rare-tokens")
    to_hubs = stored(_links_to_hubs(sets, rare, components(edges), percent), "links")
    edges = edges.unionByName(to_hubs)
    found = stored(
        _links_across(sets, rare, components(edges), percent, group_size, group_tokens), "links"
    )
    linked = components(edges.unionByName(found)).withColumnRenamed("node", "key")
    smallest = (
        linked.join(classes, "key").groupBy("component").agg(F.min("doc").alias("smallest"))
    )
    named = classes.join(linked.join(smallest, "component"), "key", "left").select(
        "key", F.coalesce("smallest", "doc").alias("component_id")
    )
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(
        F.nullif("component_id", F.lit(LOWEST))
    )
    return signed.join(named, "key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id")
    )
