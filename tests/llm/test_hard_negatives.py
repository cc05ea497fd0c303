import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import collected

from clickloom.llm.hard_negatives import Queries, Tree, hard_negatives, tiles

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
DDL = "vec_id bigint, label int, embedding array<float>, row string, vector string, anchor string"
SIZES = [{}, {"tree_rows": 40, "leaf_rows": 4, "block": 7, "group": 3}, {"positives": 2, "negatives": 90}]


def brute(rows, positives=5, negatives=5, low=80, high=100, scale=256):
    """Rows are things of their own; results name their vec_ids."""
    known = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        most = min(math.sqrt(2**61 / max(1, len(vector))), 2**31 - 1) - 1
        if any(abs(x * scale) > most for x in vector):
            continue
        known.append((vec_id, label, [math.floor(float(x) * scale) for x in vector]))
    result = []
    for at, (anchor, label, vector) in enumerate(known):
        if anchor % 100:
            continue
        others = [
            (-sum(a * b for a, b in zip(vector, other, strict=True)), vec_id, same == label)
            for place, (vec_id, same, other) in enumerate(known)
            if place != at and len(other) == len(vector)
        ]
        others.sort()
        for score, positive, _ in [o for o in others if o[2]][:positives]:
            fits = [o for o in others if not o[2] and low * -score <= 100 * -o[0] <= high * -score]
            result += [
                (anchor, positive, rank, vec_id, -score, -found)
                for rank, (found, vec_id, _) in enumerate(fits[:negatives], 1)
            ]
    return sorted(result, key=repr)


def odd_vectors():
    chance = np.random.default_rng(3)
    rows = [(i, int(i % 3), chance.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, 1, rows[100][2]) for i in range(150)]  # equal vectors
    rows += [(2000, 2, rows[100][2]), (2100, 2, rows[100][2])]
    rows += [rows[0], rows[0], (0, 2, rows[0][2]), rows[7], rows[200]]  # repeated rows and ids
    rows += [(3000 + i, i % 2, [0.0] * 6) for i in range(4)]
    rows += [(4000 + i, i % 2, [1.0, float(i)]) for i in range(101)]  # another dimension
    rows += [(5000 + i, i % 2, []) for i in range(3)]
    rows += [(6000, 1, [3e38] * 6), (6100, 0, [1e6, -1e6, 0.0, 0.0, 1e6, 5e5])]
    rows += [(6101, 0, [1e6] * 6), (6102, 1, [1e6] * 6)]
    bad = [None, float("nan"), float("inf"), -float("inf")]
    rows += [(7000 + 100 * i, 1, [1.0, x, 1.0, 1.0, 1.0, 1.0]) for i, x in enumerate(bad)]
    return [*rows, (None, 1, rows[3][2]), (8000, None, rows[3][2]), (8100, 1, None)]


def table(spark, rows):
    return spark.createDataFrame([(*row, "x", "x", "x") for row in rows], DDL).repartition(4)


@pytest.mark.parametrize("sizes", SIZES)
def test_odd_vectors(spark, sizes):
    rows = odd_vectors()
    found = hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, **sizes)
    wanted = {name: sizes[name] for name in ("positives", "negatives") if name in sizes}
    assert collected(found, *COLUMNS) == brute(rows, **wanted)


def test_other_windows(spark):
    rows = odd_vectors()
    found = hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, percent=(-50, 130), scale=10)
    assert collected(found, *COLUMNS) == brute(rows, low=-50, high=130, scale=10)


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(100, 1, [1.0])]])
def test_nothing_to_find(spark, rows):
    found = hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)
    assert found.columns == COLUMNS
    assert found.collect() == []


def test_pages_are_full_and_hold_every_row_once():
    points = np.random.default_rng(1).integers(-9, 9, (1000, 5))
    pages = tiles(points, 16)
    assert sorted(np.concatenate(pages).tolist()) == list(range(1000))
    assert max(map(len, pages)) <= 16
    assert len(pages) < 1.3 * 1000 / 16


def test_boxes_outside_the_window_are_not_opened():
    """Clustered rows: the queue leaves most leaves closed and still finds the best."""
    chance = np.random.default_rng(5)
    centres = chance.normal(size=(40, 8)) * 300
    rows = (centres[np.arange(4000) % 40] + chance.normal(size=(4000, 8)) * 5).astype(np.int32)
    pages = tiles(rows, 32)
    order = np.concatenate(pages)
    starts = np.cumsum([0, *map(len, pages[:-1])])
    vector = rows[order]
    tree = Tree(
        8, starts, np.minimum.reduceat(vector, starts), np.maximum.reduceat(vector, starts),
        order.astype(np.int64), order.astype(np.int64), np.zeros(4000, np.int64), vector,
    )
    asked = Queries(
        8, rows[:1], np.array([0]), np.array([1]), np.array([0]), np.array([-(1 << 60)]), np.array([1 << 60]),
        np.array([0]), same=False,
    ).started(5)
    opened = tree.search(asked, np.array([0]))
    scores = rows[1:].astype(np.int64) @ rows[0].astype(np.int64)
    assert asked.score[0].tolist() == sorted(scores.tolist(), reverse=True)[:5]
    assert opened < len(pages) / 4
