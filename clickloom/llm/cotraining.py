"""Quality classifier by co-training of two views.

One classifier sees what a text says, the other only the page around it: language, source, size and
layout. Each labels unlabelled documents that it is sure of for the other's training; after some
rounds both are calibrated on labelled documents kept apart, and their calibrated odds are combined.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.text import Memo, as_bytes, sliced, stored

TEXT_SIZE = 1 << 13  # buckets for words and for their shapes
PAGE_SIZE = 1 << 11  # buckets for facts about the page
SMOOTHING = 0.5
ONE = 1 << 32  # a document's mass
TIES = 1 << 16
MOST_WORDS = 1 << 18  # words that a task remembers
POOL_ROWS = 1000  # documents of the pool that a task unpacks at a time

_RUNS = [
    (re.compile(rb"[A-Z]+"), b"A"),
    (re.compile(rb"[a-z\x80-\xff]+"), b"a"),
    (re.compile(rb"[0-9]+"), b"0"),
]


def shape(word: bytes) -> bytes:
    """The word with runs of capitals, other letters and digits as one character each."""
    for run, sign in _RUNS:
        word = run.sub(sign, word)
    return word


def text_buckets(word: bytes) -> tuple[int, int]:
    half = TEXT_SIZE // 2
    return (
        xxhash.xxh3_64_intdigest(word.lower()) % half,
        half + xxhash.xxh3_64_intdigest(shape(word), 1) % half,
    )


def page_facts(lang, source, n_chars, text: bytes) -> list[int]:
    """Buckets of what is known about a page without reading its words."""
    lines = text.count(b"\n") + 1
    size = len(text) if n_chars is None else n_chars
    facts = (
        ("lang", lang),
        ("source", source),
        ("size", int(2 * math.log2(size + 1))),
        ("lines", int(2 * math.log2(lines))),
        ("line", int(2 * math.log2(len(text) / lines + 1))),
        ("gaps", int(40 * text.count(b" ") / (len(text) + 1))),
    )
    return [xxhash.xxh3_64_intdigest(repr(fact)) % PAGE_SIZE for fact in facts]


def in_steps(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """Buckets in order and their counts, as a byte for each step from one to the next and one for each count.

    A step beyond 255 goes by way of entries that count nothing. Two bytes for most entries, where plain
    buckets take three; the pool takes as much less disk.
    """
    steps = np.diff(buckets.astype(np.int64), prepend=0)
    ways = np.maximum(steps - 1, 0) // 255
    last = np.cumsum(ways + 1) - 1
    small, held = np.full(len(steps) + ways.sum(), 255, np.uint8), np.zeros(len(steps) + ways.sum(), np.uint8)
    small[last], held[last] = steps - 255 * ways, counts
    return small.tobytes() + held.tobytes()


def from_steps(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of each entry that counts something, row by row."""
    lengths = np.array([len(one) // 2 for one in packed], np.int64)
    row = np.repeat(np.arange(len(packed), dtype=np.int32), lengths)
    steps = np.frombuffer(b"".join(one[: len(one) // 2] for one in packed), np.uint8)
    count = np.frombuffer(b"".join(one[len(one) // 2 :] for one in packed), np.uint8)
    reached = np.cumsum(steps, dtype=np.int64)
    before = np.concatenate([[0], reached])[np.cumsum(lengths) - lengths]
    bucket = (reached - np.repeat(before, lengths)).astype(np.int32)
    real = count > 0
    return row[real], bucket[real], count[real].astype(float)


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, label, tie, words, page): buckets of each document, packed.

    words has a byte for each step to the next bucket, then one for each count (see ``in_steps``); page
    has 2 for each fact; tie is a hash that orders documents of equal certainty.
    """

    def both(word: bytes) -> int:
        one, two = text_buckets(word)
        return one | two << 16

    def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets in order and their counts, up to 255; of a larger one several entries."""
        buckets = np.concatenate([codes & 0xFFFF, codes >> 16])
        words, counts = np.unique(buckets, return_counts=True)
        entries = -(-counts // 255)
        words, split = np.repeat(words, entries), np.full(entries.sum(), 255, np.uint8)
        split[np.cumsum(entries) - 1] = counts - 255 * (entries - 1)
        return words.astype("<u2"), split

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(both, MOST_WORDS)
        for batch in sliced(batches, 500):
            known.trim()
            rows = []
            names = ("doc_id", "lang", "source", "n_chars")
            columns = [batch.column(name).to_pylist() for name in names]
            for doc_id, lang, source, n_chars, text in zip(
                *columns, as_bytes(batch.column("text")), strict=True
            ):
                own = text.split()
                codes = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                words, counts = counted(codes)
                page = np.array(page_facts(lang, source, n_chars, text), "<u2").tobytes()
                facts = words.tobytes() + counts.tobytes() + page
                tie = xxhash.xxh3_64_intdigest(facts, (doc_id or 0) % 2**64) % TIES
                rows.append((tie, in_steps(words, counts), page))
            ties, words, page = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array(ties, pa.int32()),
                    pa.array(words, pa.binary()),
                    pa.array(page, pa.binary()),
                ],
                ["doc_id", "label", "tie", "words", "page"],
            )

    columns = [F.col(name).cast("bigint").alias(name) for name in ("doc_id", "label")]
    return docs.select(*columns, "lang", "source", "n_chars", "text").mapInArrow(
        features, "doc_id bigint, label bigint, tie int, words binary, page binary"
    )


class View:
    """Naive Bayes over the buckets of one view; its margin is the mean evidence per token."""

    def __init__(self, size: int, packed: list[bytes], counted: bool):
        self.size = size
        if counted:
            self.row, self.bucket, self.count = from_steps(packed)
        else:
            lengths = np.array([len(one) // 2 for one in packed], np.int64)
            self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            self.bucket = np.frombuffer(b"".join(packed), "<u2").astype(np.int32)
            self.count = np.ones(len(self.bucket))
        self.total = np.bincount(self.row, self.count, len(packed)).clip(1)

    def mass(self, labels: np.ndarray) -> np.ndarray:
        """Per class, each bucket's share of documents, in units of 1 / ONE: exact in any order."""
        share = np.rint(self.count / self.total[self.row] * ONE)
        return np.stack(
            [
                np.bincount(self.bucket, share * (labels == value)[self.row], self.size)
                for value in (0, 1)
            ]
        ).astype(np.int64)

    def margins(self, evidence: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.count * evidence[self.bucket], len(self.total)) / self.total


def views_of(table: pa.Table | pa.RecordBatch) -> list[View]:
    return [
        View(TEXT_SIZE, table.column("words").to_pylist(), True),
        View(PAGE_SIZE, table.column("page").to_pylist(), False),
    ]


def evidence_of(mass: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of each bucket, good to bad, every document weighing the same."""
    logs = []
    for one in mass / ONE:
        one = one + SMOOTHING * max(one.sum(), 1) / len(one) / 50
        logs.append(np.log(one / one.sum()))
    return logs[1] - logs[0]


def logistic(inputs: np.ndarray, labels: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression with intercept, by Newton's method."""
    inputs = np.column_stack([inputs, np.ones(len(labels))])
    weights = np.zeros(inputs.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        slope = inputs.T @ (labels - p) - penalty * weights
        bend = (inputs * (p * (1 - p))[:, None]).T @ inputs + penalty * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights + step * min(1, 10 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def taught(table: pa.Table, pseudo: list[np.ndarray]) -> dict[str, np.ndarray] | None:
    """The model of the labelled documents and the masses of those with pseudo-labels."""
    table = table.sort_by("doc_id")
    label = table.column("label").to_numpy()
    views = views_of(table)
    apart = np.array(
        [xxhash.xxh3_64_intdigest(str(doc_id)) % 3 == 0 for doc_id in table.column("doc_id").to_pylist()],
        bool,
    )
    if len(set(label[apart])) < 2 or len(set(label[~apart])) < 2:
        return None
    train = np.where(apart, -1, label)
    evidence = [
        evidence_of(view.mass(train) + more) for view, more in zip(views, pseudo, strict=True)
    ]
    margins = [view.margins(one)[apart] for view, one in zip(views, evidence, strict=True)]
    scales = [logistic(one, label[apart]) for one in margins]
    odds = np.column_stack([m * a + b for m, (a, b) in zip(margins, scales, strict=True)])
    return {
        "text": evidence[0],
        "page": evidence[1],
        "text_scale": scales[0],
        "page_scale": scales[1],
        "combine": logistic(odds, label[apart]),
        "good": np.array([(label[apart] == 1).mean()]),
    }


def certainty(views: list[View], model: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(view, class, step of certainty) of each document; steps grow with the odds of the class.

    A step is the upper bits of a float, so steps are a 2,048th of the odds wide; 0 is not sure.
    """
    for at, (view, name) in enumerate(zip(views, ("text", "page"), strict=True)):
        slope, start = model[f"{name}_scale"]
        odds = view.margins(model[name]) * slope + start
        for value, sign in ((1, 1), (0, -1)):
            steps = (sign * odds).clip(0).astype("<f4").view("<u4") >> 12
            yield at, value, np.where(sign * odds >= model["sure"], steps, 0).astype(np.int64)


def _summed(pool: DataFrame, partial, schema: str) -> list:
    """Rows of ``partial``, which gets all batches of a task, added up by all columns but n."""
    names = [field.name for field in T._parse_datatype_string(schema).fields]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = zip(*partial(batches), strict=True)
        arrays = [pa.array(np.concatenate(column), pa.int64()) for column in columns]
        yield pa.RecordBatch.from_arrays(arrays, names)

    frame = pool.select("tie", "words", "page").mapInArrow(add, schema)
    return frame.groupBy(*names[:-1]).agg(F.sum("n").alias("n")).collect()


def _cuts(pool: DataFrame, model: dict, handed: float) -> dict[tuple[int, int], tuple[int, int]]:
    """Per view and class the step from which documents are handed on, and up to which tie there.

    A quantile over the whole pool, from counts per step.
    """

    def count(batches):
        rows, n = [(np.array([-1]), np.array([0]), np.array([0]), np.array([0]))], 0
        for batch in sliced(batches, POOL_ROWS):
            n += batch.num_rows
            for at, value, steps in certainty(views_of(batch), model):
                found, times = np.unique(steps[steps > 0], return_counts=True)
                rows.append((np.full(len(found), at), np.full(len(found), value), found, times))
        return [*rows, (np.array([-1]), np.array([0]), np.array([0]), np.array([n]))]

    total, steps = 0, {}
    for at, value, step, n in _summed(pool, count, "view bigint, class bigint, step bigint, n bigint"):
        if at < 0:
            total += n
        else:
            steps.setdefault((at, value), []).append((step, n))
    cuts = {}
    good = model["good"][0]
    for (at, value), counts in steps.items():
        left = int(handed * (good if value else 1 - good) * total)
        for step, n in sorted(counts, reverse=True):
            # The last step is shared out by tie, so that many equal documents are not all lost.
            cuts[at, value] = (step, TIES if n <= left else TIES * left // n)
            left -= n
            if left <= 0:
                break
    return cuts


def _masses(pool: DataFrame, history: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Per view the masses of the documents that the other has labelled so far, and their number."""

    sizes = (TEXT_SIZE, PAGE_SIZE)

    def add(batches):
        sums = [np.zeros((2, size + 1), np.int64) for size in sizes]
        for batch in sliced(batches, POOL_ROWS):
            views, ties = views_of(batch), batch.column("tie").to_numpy()
            labels = [np.full(batch.num_rows, -1) for _ in views]
            for model, cuts in history:
                for at, value, steps in certainty(views, model):
                    step, tie = cuts.get((at, value), (0, 0))
                    chosen = (steps > step) | ((steps == step) & (ties < tie) & (steps > 0))
                    labels[1 - at][chosen & (step > 0)] = value
            for view, one, total in zip(views, labels, sums, strict=True):
                total[:, :-1] += view.mass(one)
                total[:, -1] += [(one == 0).sum(), (one == 1).sum()]
        rows = []
        for at, total in enumerate(sums):
            values, buckets = total.nonzero()
            rows.append((np.full(len(values), at), values, buckets, total[values, buckets]))
        return rows

    result = [np.zeros((2, size + 1), np.int64) for size in sizes]
    for at, value, bucket, n in _summed(pool, add, "view bigint, class bigint, bucket bigint, n bigint"):
        result[at][value, bucket] = n
    return [one[:, :-1] for one in result], np.array([one[:, -1].sum() for one in result], float)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most_labelled: int = 8000,
    most_pool: int | None = None,
    rounds: int = 4,
    handed: float = 0.05,
    sure: float = 0.95,
) -> dict[str, np.ndarray] | None:
    """The model, or None if the labelled documents do not hold both classes.

    ``labels`` has doc_id and quality (1 good, 0 bad; other values do not count; of a doc_id that is
    labelled more than once the better label). Learns from at most ``most_labelled`` labelled
    documents, chosen by a hash of doc_id, in one task, and from all documents without a label
    (of which ``most_pool`` takes a sample, if given). A third of the labelled documents calibrates
    and is never trained on. In each of ``rounds`` rounds each view hands the other its surest
    documents, up to the share ``handed`` of the whole pool, and only those it gives a calibrated
    probability of ``sure``. Buckets of all documents are stored once; a round reads them twice, for
    counts per step of certainty and for sums per bucket. The driver gets these and the model, which
    are of fixed size.
    """
    chosen = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    known = (
        labels.filter("quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("quality").cast("bigint").alias("label"))
    )
    docs = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", "n_chars", "text"
    )
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    # At most most_labelled rows of two numbers.
    labelled = known.join(ids, "doc_id", "left_semi").orderBy(chosen, "doc_id").limit(most_labelled)
    sample = stored(_features(docs.join(F.broadcast(labelled), "doc_id")), "labelled")

    def learn(pseudo: list[np.ndarray]) -> dict[str, np.ndarray]:
        def learned(table: pa.Table) -> pa.Table:
            model = taught(table, pseudo) or {}
            values = pa.array([part.tolist() for part in model.values()], pa.list_(pa.float64()))
            return pa.table({"part": pa.array(list(model), pa.string()), "numbers": values})

        rows = (
            sample.groupBy(F.lit(0).alias("all"))
            .applyInArrow(learned, "part string, numbers array<double>")
            .collect()
        )
        return {row["part"]: np.array(row["numbers"]) for row in rows}

    pseudo = [np.zeros((2, size), np.int64) for size in (TEXT_SIZE, PAGE_SIZE)]
    model, number, history = learn(pseudo), np.zeros(2), []
    if not model:
        return None
    # Packed before the join, so that texts are not shuffled. A NULL doc_id has no label.
    unlabelled = F.lit(None).cast("bigint")
    pool = _features(docs.withColumn("label", unlabelled)).join(known, "doc_id", "left_anti")
    if most_pool is not None:
        pool = pool.orderBy(chosen, "doc_id").limit(most_pool)
    pool = stored(pool.select("tie", "words", "page"), "pool")
    for _ in range(rounds):
        model["sure"] = math.log(sure / (1 - sure))
        history.append((model, _cuts(pool, model, handed)))
        pseudo, number = _masses(pool, history)
        model = learn(pseudo)
    del model["good"]
    return model | {"pseudo": number}


def score(docs: DataFrame, model: dict | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with p_text, p_page, p_quality (probabilities of good) and kept.

    Scores every whole document. Columns lang, source, n_chars and text may hold NULLs; a NULL is a
    value of its own, and NULL text has no words. Without a model (too few labels) the three are
    NULL and everything is kept. Columns of the same names are replaced. The model is of fixed size.
    """
    results = ["p_text", "p_page", "p_quality"]
    kept = docs.drop(*results, "kept")
    if model is None:
        empty = {name: F.lit(None).cast("double") for name in results}
        return kept.withColumns(empty | {"kept": F.lit(True)})

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, page = model["text"], model["page"]
        (a, b), (c, d) = model["text_scale"], model["page_scale"]
        u, v, w = model["combine"]

        def weigh(word: bytes) -> float:
            one, two = text_buckets(word)
            return float(text[one] + text[two])

        known = Memo(weigh, MOST_WORDS)
        for batch in sliced(batches, 500):
            known.trim()
            columns = [batch.column(name).to_pylist() for name in ("lang", "source", "n_chars")]
            odds = []
            texts = as_bytes(batch.column("text"))
            for lang, source, n_chars, body in zip(*columns, texts, strict=True):
                words = body.split()
                evidence = sum(map(known.__getitem__, words)) / max(1, 2 * len(words))
                facts = page_facts(lang, source, n_chars, body)
                odds.append((evidence, sum(float(page[fact]) for fact in facts) / len(facts)))
            said, around = np.array(odds).reshape(-1, 2).T
            said, around = said * a + b, around * c + d
            p = 1 / (1 + np.exp(-np.clip([said, around, u * said + v * around + w], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, p), pa.array(p[2] >= threshold)],
                [*batch.schema.names, *results, "kept"],
            )

    added = [T.StructField(name, T.DoubleType()) for name in results]
    added.append(T.StructField("kept", T.BooleanType()))
    return kept.mapInArrow(estimate, T.StructType([*kept.schema.fields, *added]))
