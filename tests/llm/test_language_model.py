import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import odd_documents, texts_of

from clickloom.llm import elias_fano, language_model
from clickloom.llm.language_model import file_blocks, score

D = 0.75


def brute(rows):
    """The same model without shards, blocks, codes or tries."""
    docs = [(i, (text or "").encode().lower().split() + [b"\n"]) for i, text in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    train = [tokens for (_, tokens), out in zip(docs, held, strict=True) if not out]
    one = Counter(token for tokens in train for token in tokens)
    two = Counter(pair for tokens in train for pair in zip([b"\n", *tokens[:-1]], tokens, strict=True))
    after = Counter(context for context, _ in two)
    n, v = sum(one.values()), len(one)
    for (doc_id, tokens), out in zip(docs, held, strict=True):
        base = sum(math.log10((one[t] + 1) / (n + v + 1)) for t in tokens)
        total = 0.0
        for context, token in zip([b"\n", *tokens[:-1]], tokens, strict=True):
            p = (one[token] - D) / n if one[token] else D * v / n
            if one[context]:
                seen = max(two[context, token] - D, 0) / one[context]
                p = seen + D * after[context] / one[context] * p
            total += math.log10(p)
        known = sum(one[t] > 0 for t in tokens)
        yield doc_id, out, len(tokens), known, n, base, total


def compare(frame, rows):
    found = sorted(
        map(tuple, frame.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()),
        key=repr,
    )
    expected = sorted(brute(rows), key=repr)
    assert len(found) == len(expected)
    found.sort(key=lambda r: (repr(r[0]), r[2], r[5]))
    expected.sort(key=lambda r: (repr(r[0]), r[2], r[5]))
    for got, want in zip(found, expected, strict=True):
        assert got[:5] == want[:5]
        assert got[5] == pytest.approx(want[5], rel=1e-9)
        # Codes are rounded down by at most a step each.
        assert want[6] - 2 * got[2] / elias_fano.STEPS <= got[6] <= want[6] + 1e-6


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 20_000, "most_hot": 200}])
def test_odd_documents(spark, sizes):
    docs = odd_documents(spark)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    compare(score(docs, block, **sizes), texts_of(docs))


def test_test_table_and_file_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    result = score(docs, file_blocks(64), shard_bytes=100_000, most_hot=500)
    compare(result, texts_of(docs))
    held = result.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_probabilities_of_a_context_add_up(spark):
    """Over all words that can follow, known and unknown, no more than 1."""
    rows = [(i, "a b a c a a b") for i in range(3)] + [(50, "c b a")]
    follow = [["a"], ["b"], ["c"], [], ["zzz"]]  # the end is one of them
    texts = [(1000 + 7 * i, " ".join(["a", *word])) for i, word in enumerate(follow)]
    held = [(i, t) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert docs.count() == len(rows)
    names = [i for i in range(1000, 3000) if language_model.held_out(i)][: len(follow)]
    probes = [(name, text) for name, (_, text) in zip(names, held, strict=True)]
    frame = spark.createDataFrame(rows + probes, "doc_id bigint, text string")
    found = {r["doc_id"]: r["score"] for r in score(frame, F.lit(0)).collect()}
    expected = {r[0]: r[6] for r in brute(rows + probes)}
    assert all(found[name] == pytest.approx(expected[name], abs=0.01) for name in names)
    # p(word | a), each from "a word", after taking out what the end and the beginning contribute.
    alone = found[names[3]]
    assert 10**alone < 1


def test_no_training_documents(spark):
    held = [i for i in range(100) if language_model.held_out(i)]
    docs = spark.createDataFrame([(i, "some words here") for i in held], "doc_id bigint, text string")
    rows = score(docs, F.lit(0)).collect()
    assert all(r["score"] == r["base_score"] and r["train_tokens"] == 0 for r in rows) and rows


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert score(docs, F.lit(0)).collect() == []


@pytest.mark.parametrize("top", [0, 1, 1000, 2**40, 2**64 - 1])
@pytest.mark.parametrize("count", [0, 1, 7, 70_000])
def test_elias_fano(top, count):
    chance = np.random.default_rng(count)
    values = np.sort(chance.integers(0, top, count, np.uint64, endpoint=True))
    data = elias_fano.encode(values)
    coded = elias_fano.Sequence(elias_fano.mapped(data))
    assert (coded.get(np.arange(count)) == values).all()
    near = np.concatenate([values, values[values > 0] - np.uint64(1), values + np.uint64(1)])
    near = np.append(near, chance.integers(0, 2**64 - 1, 1000, np.uint64, endpoint=True))
    place, found = coded.find(near)
    assert (place == np.searchsorted(values, near)).all()
    assert (found == np.isin(near, values)).all()
    if count == 70_000 and top == 2**40:
        assert len(data) < 4 * count  # 26 bits each instead of 64


def test_successors():
    chance = np.random.default_rng(1)
    pairs = np.unique(chance.integers(0, 300, (5000, 2)), axis=0).astype(np.uint64)
    codes = chance.integers(1, 60_000, len(pairs))
    contexts = np.unique(pairs[:, 0])
    rest = chance.integers(1, 60_000, len(contexts))
    built = elias_fano.Successors.build(pairs[:, 0], pairs[:, 1], codes, rest)
    level = elias_fano.Successors(elias_fano.mapped(built))
    known = {tuple(pair): code for pair, code in zip(pairs.tolist(), codes.tolist(), strict=True)}
    every = np.array([(a, b) for a in range(305) for b in range(0, 305, 3)], np.uint64)
    found = level.find(every[:, 0], every[:, 1])
    assert found.tolist() == [known.get(tuple(pair), 0) for pair in every.tolist()]
    assert level.find_rest(contexts).tolist() == rest.tolist()
    assert level.find_rest(np.array([10**6], np.uint64)).tolist() == [0]


def test_words():
    words = np.array([3, 8, 2**63, 2**64 - 1], np.uint64)
    level = elias_fano.Words(elias_fano.mapped(elias_fano.Words.build(words, np.arange(1, 5))))
    place, codes = level.find(np.array([0, 3, 9, 2**63, 2**64 - 1], np.uint64))
    assert place.tolist() == [-1, 0, -1, 2, 3] and codes.tolist() == [0, 1, 0, 3, 4]


def test_levels_are_read_in_place():
    """No array as long as a level is made when it is opened: the codes are the mapped bytes."""
    words = np.sort(np.random.default_rng(2).integers(0, 2**64 - 1, 200_000, np.uint64))
    data = elias_fano.mapped(elias_fano.Words.build(words, np.ones(len(words))))
    level = elias_fano.Words(data)
    views = (level.codes, level.words.upper, level.words.lower)
    assert all(np.shares_memory(view, np.frombuffer(data, np.uint8)) for view in views)
    assert level.words.ones.nbytes + level.words.zeros.nbytes < len(words)


def test_quantised_probabilities_are_rounded_down():
    p = 10.0 ** -np.linspace(0, 15, 1001)
    back = elias_fano.probability(elias_fano.quantise(p))
    assert (back <= p * (1 + 1e-12)).all() and (back > p * 0.999).all()
    assert elias_fano.probability(elias_fano.quantise(np.zeros(1)))[0] == 0
