import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import collected, moved_bytes, odd_documents, texts_of, words

from clickloom.llm.components import components
from clickloom.llm.ngram_join import (
    Marks,
    _compared,
    _full_sets,
    _homes,
    _perhaps_among,
    marks,
    near_duplicates,
    set_key,
    shared_counts,
    shingle_set,
    short,
)
from clickloom.llm.text import word_hashes

COLUMNS = ["doc_id", "n_shingles", "component_id"]


def shingles(text):
    found = (text or "").encode().lower().split()
    if 0 < len(found) < 5:
        return {tuple(found)}
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute(rows):
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(at):
        while parent[at] != at:
            at = parent[at]
        return at

    def number(at):
        return -1 if rows[at][0] is None else rows[at][0]

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 10**18)
    for at in range(len(rows)):
        least[root(at)] = min(least[root(at)], number(at))
    return sorted(
        (
            (rows[at][0], len(sets[at]), rows[at][0] if not sets[at] or least[root(at)] == -1 else least[root(at)])
            for at in range(len(rows))
        ),
        key=repr,
    )


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert collected(near_duplicates(docs), *COLUMNS) == brute(texts_of(docs))


def cluster(seed, copies, edits, length=120):
    """A text and copies of it with ``edits`` words changed each."""
    chance, first = random.Random(seed), words(length, seed, 10**6)
    texts = [" ".join(first)]
    for copy in range(copies):
        changed = list(first)
        for at in chance.sample(range(length), edits):
            changed[at] = f"c{seed}x{copy}x{at}"
        texts.append(" ".join(changed))
    return texts


@pytest.mark.parametrize("sizes", [{}, {"group_size": 4, "group_tokens": 600, "range_tokens": 3000}])
def test_stars_chains_and_shared_passages(spark, sizes):
    """Copies link with the text they come from more than with each other; others share much, but not enough."""
    passage = " ".join(words(40, 77, 10**6))
    texts = []
    for seed in range(4):
        texts += cluster(seed, 20, 1 + seed)
    chain = words(100, 99, 10**6)
    texts += [" ".join(chain[at : at + 60]) for at in range(0, 40, 4)]
    texts += [f"{passage} " + " ".join(words(20 + 5 * (i % 5), 1000 + i, 10**6)) for i in range(30)]
    texts += [passage] * 5
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    rows = [(at, texts[place]) for place, at in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert collected(near_duplicates(docs, **sizes), *COLUMNS) == brute(rows)


def couples(count):
    """Pairs of near copies with one line that all texts share, and a third text that is the hub of
    their rare shingles but like neither of them."""

    def part(name, length):
        return [f"{name}x{at}" for at in range(length)]

    line, texts = ["one", "line", "that", "everybody", "has"], []
    for i in range(count):
        rare = part(f"r{i}", 40)
        texts.append(part("p", 100) + line + rare)
        texts.append(part("p", 100) + line + rare[:-1] + ["other"])
        texts.append(part("q", 100) + line + rare)
        texts += [part("q", 100) + line + part(f"u{i}x{j}", 40) for j in range(3)]
    return [(at, " ".join(text)) for at, text in enumerate(texts)]


def test_copies_in_different_parts_of_one_sketch(spark):
    rows = couples(16)
    expected = brute(rows)
    assert sum(doc_id != component for doc_id, _, component in expected) == 16
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = near_duplicates(docs, group_size=8, group_tokens=10**6)
    assert collected(found, *COLUMNS) == expected


def test_groups_without_a_large_component_are_parted(spark):
    """A NULL, which stands for all small components, is split like any other value."""
    rows = [(None, 5, str(i).encode(), 10) for i in range(200)] + [(b"c", 5, b"x", 10), (None, 6, b"y", 10)]
    sets = spark.createDataFrame(rows, "large binary, sketch bigint, key binary, n bigint")
    for most, most_tokens in ((20, 10**6), (10**6, 200)):
        homes = _homes(sets, ["large", "sketch"], most, most_tokens)
        assert homes.columns == [*sets.columns, "home"] and homes.count() == len(rows)
        parts = [row["count"] for row in homes.groupBy("home").count().collect()]
        assert len(parts) == 12 and max(parts) < 45


def test_colliding_tokens_of_one_set_count_each(spark):
    """Of so many shingles some have the same low 32 bits; a document wholly in others shares all."""
    whole = " ".join(f"c{at}" for at in range(250_000))
    docs = spark.createDataFrame([(1, whole), (2, f"{whole} end")], "doc_id bigint, text string")
    own = shingle_set(whole.encode(), word_hashes(), 5)
    assert len(np.unique(own.astype("<u4"))) < len(own)
    # Once, and sent by two tasks.
    for some in (docs.coalesce(1), docs.unionByName(docs)):
        shared = {row["class"]: row["shared"] for row in shared_counts(some, 5, 1).collect()}
        assert shared[short(set_key(own))] == len(own)


def test_threshold_is_exact(spark):
    """Sets of 9 and 10 with 8 and more in common: just at, below and above 80 percent."""
    base = [f"t{i}" for i in range(14)]
    rows = [(i, " ".join(base[: 5 + i])) for i in range(10)]
    rows += [(20, " ".join(["other"] + base[:12])), (21, "t0 t1 T2"), (22, "T0 t1 t2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert collected(near_duplicates(docs), *COLUMNS) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")
    assert collected(near_duplicates(docs), *COLUMNS) == [(1, 0, 1), (2, 0, 2)]


def test_components(spark):
    chance = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 100)]
    pairs += [tuple(map(int, chance.integers(1000, 1400, 2))) for _ in range(300)] + [(7, 7), (8, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "node bigint, other bigint")).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    expected = {}
    for node in sorted(near):
        todo = [node] if node not in expected else []
        while todo:
            at = todo.pop()
            if at not in expected:
                expected[at] = node
                todo += near[at]
    lonely = {a for a, b in pairs if near[a] == {a}}
    assert found == {node: least for node, least in expected.items() if node not in lonely}
    assert components(spark.createDataFrame([], "node bigint, other bigint")).filter(F.lit(True)).collect() == []


@pytest.mark.parametrize("most_bits", [1 << 29, 1 << 15])
def test_bitmap_lets_all_chosen_through(spark, most_bits):
    """Every chosen key passes, however full the bitmap; with bits enough few others do."""
    rows = spark.range(-100_000, 100_000).selectExpr("id as doc", "string(id) as text", "1 as page")
    chosen = rows.filter("doc % 20 = 0").select("doc")
    found = _perhaps_among(rows, chosen, "doc", most_bits=most_bits)
    assert found.columns == rows.columns
    assert found.filter("doc % 20 = 0").count() == 10_000
    others = found.filter("doc % 20 != 0").count()
    assert others < (0.1 if most_bits > 1 << 15 else 0.4) * 190_000
    assert _perhaps_among(rows, chosen.limit(0), "doc").count() == 0


def counts(rows):
    """Per set: tokens that other sets have too, and the number of sets that have these in sum."""
    sets = {short(set_key(own)): own for own in rows if len(own)}
    have = defaultdict(int)
    for own in sets.values():
        for token in own.tolist():
            have[token] += 1
    shared = {key: [have[t] for t in own.tolist() if have[t] > 1] for key, own in sets.items()}
    return {key: (len(x), sum(x), max(x)) for key, x in shared.items() if x}, have


@pytest.mark.parametrize("ranges, held", [(1, 1 << 20), (7, 500), (3000, 1 << 20), (3000, 2000)])
def test_shared_counts_of_named_and_other_sets(spark, ranges, held):
    chance = random.Random(ranges)
    texts = [text for seed in range(6) for text in cluster(seed, 6, 3, 30 + 60 * seed)] + ["a b", "", None]
    texts += [" ".join(words(40, 500 + i, 12)) for i in range(40)] + ["word " * 400]
    texts += chance.sample(texts, 20)
    chance.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    sets = [shingle_set((text or "").encode(), word_hashes(), 5) for text in texts]
    times = defaultdict(int)
    for own in sets:
        times[set_key(own)] += 1
    several = [(at, ) for at, own in enumerate(sets) if times[set_key(own)] > 1 or at % 9 == 0]
    expected, have = counts(sets)
    for copied in (spark.createDataFrame(several, "doc bigint"), None):
        found = {row["class"]: row for row in shared_counts(docs, 5, ranges, held, copied).collect()}
        assert {key: (row.shared, row.spread) for key, row in found.items()} == {
            key: (shared, spread) for key, (shared, spread, _) in expected.items()
        }
        by_sketch = {(((t >> 32) * ranges) >> 32 << 32) + t % (1 << 32): n for t, n in have.items()}
        assert {key: by_sketch[row.sketch] for key, row in found.items()} == {
            key: most for key, (_, _, most) in expected.items()
        }


def test_a_token_costs_as_much_in_many_ranges(spark):
    """With more ranges than a set has tokens, each token has a range of its own and no name with it."""
    texts = [(i, " ".join(words(200, i, 10**6))) for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    tokens = sum(len(shingle_set(text.encode(), word_hashes(), 5)) for _, text in texts)
    none = spark.createDataFrame([], "doc bigint")
    assert moved_bytes(shared_counts(docs, 5, 1000, copied=none)) < 8 * tokens


def test_marks_exclude_no_set_that_links():
    chance = np.random.default_rng(1)
    excluded = 0
    for _ in range(300):
        size = int(chance.integers(1, 700))
        base = np.unique(chance.integers(0, 2**64, size, np.uint64))
        others = []
        for share in (0.0, 0.3, 0.6, 0.75, 0.85, 0.95, 1.0):
            kept = base[chance.random(len(base)) < share]
            new = chance.integers(0, 2**64, int(len(base) * (1 - share) * chance.random()), np.uint64)
            others.append(np.unique(np.concatenate([kept, new, base[:1]])))
        both = np.array([len(np.intersect1d(base, other)) for other in others])
        sizes = np.array([len(other) for other in others])
        group = Marks(sizes, [marks(other).tobytes() for other in others])
        near = set(group.may_link(len(base), marks(base).tobytes(), 80).tolist())
        linked = np.flatnonzero(100 * both >= 80 * (len(base) + sizes - both)).tolist()
        assert near.issuperset(linked) and len(others) - 1 in near
        excluded += 2 - len(near & {0, 1})
    assert excluded > 550


def test_sets_that_cannot_link_do_not_move(spark):
    """One case of sets that are unlike but for two of them: these move, and get their edge."""
    texts = [(i, " ".join(words(400, i, 10**6))) for i in range(60)]
    texts[41] = (41, texts[7][1] + " end")
    keys = [set_key(shingle_set(text.encode(), word_hashes(), 5)) for _, text in texts]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = [(i, keys[i], 396 + (i == 41), 0, 0, 0) for i in range(60)]
    chosen = spark.createDataFrame(rows, "doc bigint, key binary, n bigint, spread bigint, sketch bigint, home bigint")
    sets = _full_sets(docs, chosen, 5).cache()
    assert sets.count() == 60
    sides = [(1, i % 2 == 1, keys[i], keys[i]) for i in range(60)]
    cases = spark.createDataFrame(sides, "case bigint, asks boolean, key binary, component binary")
    edges = _compared(cases, sets, 80)
    assert [tuple(map(bytes, row)) for row in edges.collect()] == []
    sides[7] = (1, False, keys[7], keys[7])
    edges = _compared(spark.createDataFrame(sides, cases.schema), sets, 80)
    assert [tuple(map(bytes, row)) for row in edges.collect()] == [(keys[41], keys[7])]
    assert moved_bytes(edges) < 0.3 * 60 * 396 * 8
    sets.unpersist()
