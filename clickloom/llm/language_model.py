"""Scoring of documents with a word bigram model, an Elias-Fano trie in shards.

The model is too large for one machine, and so are the lookups. Documents are handled in blocks. A
block sends its distinct words, then its distinct word pairs, to the shards of the trie, each once
however often it occurs; a shard adds up training counts, builds its levels, and answers the blocks
from them. Blocks put the answers together.

Level 1 holds words with their smoothed probability, level 2 the successors of each word with the
discounted conditional probability, and per word the share that is left to level 1: p(w | v) =
(c(v,w) - d) / c(v) + left(v) p(w), with left(v) = d * successors(v) / c(v). Probabilities are
quantised and rounded down, so no context hands out more than 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.elias_fano import (
    Successors,
    Words,
    encode,
    mapped,
    pack_parts,
    probability,
    quantise,
    unpack_parts,
)
from clickloom.llm.text import Memo, as_bytes, stored, whole_text, word_hashes

END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word contains a newline
SCALE = 1e15  # level 1 holds shares of this many tokens, since a shard does not know of all
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)

_SENT_DDL = "shard bigint, block bigint, blob binary"
_ANSWER_DDL = (
    "level bigint, shard bigint, block bigint, blob binary, tokens bigint, words bigint"
)
_ANSWER = pa.schema(
    [
        ("level", pa.int64()),
        ("shard", pa.int64()),
        ("block", pa.int64()),
        ("blob", pa.binary()),
        ("tokens", pa.int64()),
        ("words", pa.int64()),
    ]
)


def file_blocks(rows: int = 2048) -> Column:
    """Numbers runs of rows of the same file; for a frame as read from Parquet.

    Does not depend on how the scan is split into tasks.
    """
    row = F.floor(F.col("_metadata.row_index") / rows)
    return F.xxhash64(F.col("_metadata.file_path"), row)


def held_out(doc_id) -> bool:
    """Whether a document is kept out of training; NULL counts as empty text."""
    name = "" if doc_id is None else str(doc_id)
    return zlib.crc32(name.encode()) % 7 == 2


class Block:
    """The tokens of a block of documents: hashes, one end after each document."""

    def __init__(self, texts: list[bytes], doc_ids: list, hashes: Memo):
        hashes.trim()
        parts = []
        for text in texts:
            words = text.lower().split()
            parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            parts.append(np.array([END]))
        self.tokens = np.concatenate(parts)
        self.sizes = np.array([len(part) + 1 for part in parts[::2]])
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.held = np.array([held_out(doc_id) for doc_id in doc_ids], bool)
        self.trains = ~np.repeat(self.held, self.sizes)
        self.words, self.word, self.counts = self._distinct(self.tokens)

    def _distinct(self, keys: np.ndarray):
        values, inverse = np.unique(keys, return_inverse=True)
        return values, inverse, np.bincount(inverse, self.trains, len(values)).astype(np.uint64)

    def pairs(self):
        """Distinct (context, word) pairs, sorted, where each token's is, and training counts."""
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.firsts] = END
        # Of a context, its number among the block's words is unique; sorted like its hash.
        number = np.empty_like(self.word)
        number[1:] = self.word[:-1]
        number[self.firsts] = np.searchsorted(self.words, END)
        values, inverse, counts = self._distinct(
            (number.astype(np.uint64) << HALF) | (self.tokens >> HALF)
        )
        return self.words[(values >> HALF).astype(np.int64)], values & LOW, inverse, counts


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(block, Block) for each run of rows of one block."""
    hashes, now, texts, doc_ids = word_hashes(), None, [], []
    for batch in batches:
        for block, doc_id, text in zip(
            batch.column("block").to_pylist(),
            batch.column("doc_id").to_pylist(),
            as_bytes(batch.column("text")),
            strict=True,
        ):
            if block != now and texts:
                yield now, Block(texts, doc_ids, hashes)
                texts, doc_ids = [], []
            now = block
            texts.append(text)
            doc_ids.append(doc_id)
    if texts:
        yield now, Block(texts, doc_ids, hashes)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes & LOW) * np.uint64(shards)) >> HALF).astype(np.int64)


def _pair_shard(context: np.ndarray, word: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """That of the context; of hot contexts, successors are spread over all shards."""
    spread = np.append(hot, np.uint64(0))[np.searchsorted(hot, context)] == context
    mixed = (context ^ (word * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(16)
    return _shard(np.where(spread, mixed, context), shards)


def _small(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those of 255 and more follow in full."""
    large = np.flatnonzero(counts >= 255)
    return pack_parts(
        np.minimum(counts, 255).astype(np.uint8).tobytes(),
        large.astype("<u4").tobytes(),
        counts[large].astype("<u8").tobytes(),
    )


def _counts(data) -> np.ndarray:
    small, large, full = unpack_parts(data)
    counts = np.frombuffer(small, np.uint8).astype(np.uint64)
    counts[np.frombuffer(large, "<u4").astype(np.int64)] = np.frombuffer(full, "<u8")
    return counts


def _by_shard(shard: np.ndarray, shards: int):
    """(shard, slice of the sorted order) for each shard that has any, and that order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    parts = [(at, slice(cuts[at], cuts[at + 1])) for at in range(shards)]
    return order, [(at, part) for at, part in parts if part.start < part.stop]


def _batch(columns: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], names
    )


def _sent(shard: int, block: int, blob: bytes) -> pa.RecordBatch:
    names, kinds = ["shard", "block", "blob"], [pa.int64(), pa.int64(), pa.binary()]
    return _batch([[shard], [block], [blob]], names, kinds)


def _answers(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ANSWER)
    batch = _batch(columns, _ANSWER.names, _ANSWER.types)
    return pa.Table.from_batches([batch])


def _send_words(docs: DataFrame, shards: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _blocks(batches):
            order, parts = _by_shard(_shard(block.words, shards), shards)
            for shard, part in parts:
                keys, counts = block.words[order[part]], block.counts[order[part]]
                yield _sent(shard, name, pack_parts(keys.astype("<u8").tobytes(), _small(counts)))

    return docs.mapInArrow(send, _SENT_DDL)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]):
    """Distinct keys in order, the sum of their counts, and where each of the keys is among them."""
    values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(values)).astype(np.uint64)
    return values, total, np.split(inverse, np.cumsum([len(part) for part in keys])[:-1])


def _by_block(blocks: list, places: list[np.ndarray]):
    """(block, places in order) for each block, which may have sent more than once."""
    by_block: dict[int, list] = {}
    for block, part in zip(blocks, places, strict=True):
        by_block.setdefault(block, []).append(part)
    for block, parts in by_block.items():
        yield block, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _answer_words(discount: float, most_hot: int):
    def answer(key: tuple, sent: pa.Table) -> pa.Table:
        shard, blocks = key[0].as_py(), sent.column("block").to_pylist()
        keys, counts = [], []
        for blob in sent.column("blob").to_pylist():
            hashes, said = unpack_parts(blob)
            keys.append(np.frombuffer(hashes, "<u8"))
            counts.append(_counts(said))
        words, total, places = _merge(keys, counts)
        known = total > 0
        level = Words.build(words[known], quantise((total[known] - discount) / SCALE))
        rows = [(1, shard, None, level, int(total.sum()), int(known.sum()))]
        # All that can have their share of all tokens, since they have it of this shard's.
        for at in np.flatnonzero(total * most_hot >= max(total.sum(), 1)):
            rows.append((0, shard, int(words[at].view(np.int64)), None, int(total[at]), None))
        # A word that many blocks ask for is searched once.
        place, codes = Words(mapped(level)).find(words)
        counts = np.append(total[known], np.uint64(0))[place]
        for block, own in _by_block(blocks, places):
            blob = pack_parts(_small(counts[own]), codes[own].tobytes())
            rows.append((1, shard, block, blob, None, None))
        return _answers(rows)

    return answer


def _send_pairs(docs: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _blocks(batches):
            context, word, _, counts = block.pairs()
            order, parts = _by_shard(_pair_shard(context, word, hot, shards), shards)
            for shard, part in parts:
                chosen = order[part]
                contexts, firsts = np.unique(context[chosen], return_index=True)
                blob = pack_parts(
                    contexts.astype("<u8").tobytes(),
                    firsts.astype("<u4").tobytes(),
                    word[chosen].astype("<u4").tobytes(),
                    _small(counts[chosen]),
                )
                yield _sent(shard, name, blob)

    return docs.mapInArrow(send, _SENT_DDL)


def _answer_pairs(discount: float, hot: np.ndarray, hot_counts: np.ndarray):
    def answer(key: tuple, sent: pa.Table) -> pa.Table:
        shard, asked = key[0].as_py(), []
        blocks = sent.column("block").to_pylist()
        for block, blob in zip(blocks, sent.column("blob").to_pylist(), strict=True):
            contexts, firsts, words, said = unpack_parts(blob)
            words = np.frombuffer(words, "<u4")
            contexts, firsts = np.frombuffer(contexts, "<u8"), np.frombuffer(firsts, "<u4")
            sizes = np.diff(np.append(firsts, len(words)))
            asked.append((block, contexts, sizes, words, _counts(said)))
        # Contexts by number, so that a pair is one number again.
        names = np.unique(np.concatenate([a[1] for a in asked]))
        pairs = [
            (np.repeat(np.searchsorted(names, contexts), sizes).astype(np.uint64) << HALF) | words
            for _, contexts, sizes, words, _ in asked
        ]
        every, total, places = _merge(pairs, [a[4] for a in asked])
        del asked, pairs
        values, total = every[total > 0], total[total > 0]
        number, word = (values >> HALF).astype(np.int64), values & LOW
        uses = np.bincount(number, total, len(names))
        successors = np.bincount(number, minlength=len(names))
        place = np.searchsorted(hot, names)
        is_hot = np.append(hot, np.uint64(0))[place] == names
        uses[is_hot] = np.append(hot_counts, 0)[place[is_hot]]
        left = np.where(is_hot, 0, discount * successors / np.maximum(uses, 1))
        used = np.unique(number)
        level = Successors.build(
            number.astype(np.uint64),
            word,
            quantise((total - discount) / np.maximum(uses[number], 1)),
            quantise(left[used]),
        )
        rows = [(2, shard, None, pack_parts(encode(names), level), None, None)]
        for at in np.flatnonzero(is_hot & (successors > 0)):
            # How many successors a hot context has is added up over all shards.
            name, some = int(names[at].view(np.int64)), int(successors[at])
            rows.append((3, shard, name, None, None, some))
        del values, total, number, word
        # A pair that many blocks ask for is searched once.
        trie = Successors(mapped(level))
        codes, rest = trie.find(every >> HALF, every & LOW), trie.find_rest(np.arange(len(names)))
        context = (every >> HALF).astype(np.int64)
        for block, own in _by_block(blocks, places):
            used = context[own]
            used = used[np.append(True, used[1:] != used[:-1])]
            rows.append((2, shard, block, pack_parts(codes[own].tobytes(), rest[used].tobytes()), None, None))
        return _answers(rows)

    return answer


def score(
    docs: DataFrame,
    block: Column,
    discount: float = 0.75,
    shard_bytes: int = 24 << 20,
    most_hot: int = 1 << 16,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score,
    score.

    Texts are split at white space, A-Z lower-cased, an end added. The model learns from all
    documents for which ``held_out`` is false and scores all; ``base_score`` is the add-one unigram
    score from the same counts, ``score`` the model's log10 probability. NULL text counts as empty:
    one end. Repeated rows count and are scored each for itself; columns other than doc_id and text
    are not read. Without training documents the score is the base score.

    ``block`` numbers groups of rows that one task can hold, such as ``file_blocks``; it must come
    out the same whenever ``docs`` is computed. Texts move once, to meet their block's answers. A
    shard takes about ``shard_bytes`` of text and holds distinct words or pairs of each block. Words
    with a share of 1 / ``most_hot`` of all training tokens, at most ``most_hot`` words, have their
    successors spread over all shards; only these words and their counts are broadcast. Contexts are
    told apart by 64 bits, the successors of one by 32.
    """
    rows = docs.select(
        block.cast("bigint").alias("block"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"
    )
    size = rows.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    shards = 1 + size // shard_bytes

    words = stored(
        _send_words(rows, shards)
        .groupBy("shard")
        .applyInArrow(_answer_words(discount, most_hot), _ANSWER_DDL),
        "lm-words",
    )
    n, v = words.filter("level = 1").agg(F.sum("tokens"), F.sum("words")).first()
    n, v = n or 0, v or 0
    frequent = words.filter(f"level = 0 and tokens * {most_hot} >= {n}").select("block", "tokens")
    frequent = sorted((row[0] % 2**64, row[1]) for row in frequent.collect())
    hot = np.array([word for word, _ in frequent], np.uint64)
    hot_counts = np.array([count for _, count in frequent], np.float64)
    pairs = stored(
        _send_pairs(rows, shards, hot)
        .groupBy("shard")
        .applyInArrow(_answer_pairs(discount, hot, hot_counts), _ANSWER_DDL),
        "lm-pairs",
    )
    spread = pairs.filter("level = 3").groupBy("block").agg(F.sum("words")).toArrow()
    hot_left = np.zeros(len(hot))
    names = np.array(spread.column(0).to_pylist(), np.int64).view(np.uint64)
    hot_left[np.searchsorted(hot, names)] = np.array(spread.column(1).to_pylist(), np.float64)
    hot_left *= discount / np.maximum(hot_counts, 1)

    def put_together(texts: pa.Table, answers: pa.Table) -> pa.Table:
        doc_ids = texts.column("doc_id").to_pylist()
        own = Block(as_bytes(texts.column("text")), doc_ids, word_hashes())
        by_level: dict[int, list[bytes]] = {1: [], 2: []}
        for level, blob in zip(
            *(answers.sort_by("shard").column(c).to_pylist() for c in ("level", "blob")), strict=True
        ):
            by_level[level].append(blob)
        order, _ = _by_shard(_shard(own.words, shards), shards)
        count, p1 = np.zeros(len(own.words)), np.zeros(len(own.words))
        answered = [unpack_parts(blob) for blob in by_level[1]]
        count[order] = np.concatenate([_counts(a) for a, _ in answered])
        p1[order] = probability(np.concatenate([np.frombuffer(b, "<u2") for _, b in answered]))
        p1 *= SCALE / max(n, 1)
        p1[count == 0] = discount * v / max(n, 1)

        context, word, pair, _ = own.pairs()
        shard = _pair_shard(context, word, hot, shards)
        order, _ = _by_shard(shard, shards)
        answered = [unpack_parts(blob) for blob in by_level[2]]
        alpha, left = np.zeros(len(order)), np.zeros(len(order))
        alpha[order] = probability(np.concatenate([np.frombuffer(a, "<u2") for a, _ in answered]))
        # An answer has one such code per context of its shard, in order.
        rest = probability(np.concatenate([np.frombuffer(b, "<u2") for _, b in answered]))
        name, place = context[order], shard[order]
        starts = np.append(True, (name[1:] != name[:-1]) | (place[1:] != place[:-1]))
        left[order] = rest[np.cumsum(starts) - 1]
        place = np.searchsorted(hot, context)
        is_hot = np.append(hot, np.uint64(0))[place] == context
        left[is_hot] = np.append(hot_left, 0)[place[is_hot]]
        left[count[np.searchsorted(own.words, context)] == 0] = 1.0

        base = np.log10((count + 1) / (n + v + 1))[own.word]
        model = base if n == 0 else np.log10(alpha[pair] + left[pair] * p1[own.word])
        known = (count > 0)[own.word].astype(int)
        sums = [np.add.reduceat(values, own.firsts) for values in (base, model, known)]
        return pa.table(
            {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "held_out": own.held,
                "n_tokens": own.sizes.astype(np.int64),
                "n_known": sums[2].astype(np.int64),
                "base_score": sums[0],
                "score": sums[1],
            }
        )

    answers = words.unionByName(pairs).filter("block is not null and level in (1, 2)")
    return (
        rows.groupBy("block")
        .cogroup(answers.select("level", "shard", F.col("block").alias("of"), "blob").groupBy("of"))
        .applyInArrow(
            put_together,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
            "base_score double, score double",
        )
        .withColumn("train_tokens", F.lit(n).cast("bigint"))
    )
