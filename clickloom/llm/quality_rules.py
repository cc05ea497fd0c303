"""Quality rules whose cutoffs carry a guarantee on labelled holdouts.

Each rule rejects documents whose rate of something exceeds a cutoff. Cutoffs are tested on labelled
good documents that nothing was fitted on: per stratum, a fixed sequence of policies (a cutoff for
every rule) goes from loose to tight with an exact binomial test of all rules together, and the last
one that passes is used. With the chosen confidence, in every stratum at once, no more than the chosen
share of good documents is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.text import SPACES, as_bytes, sliced, stored

COUNTS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_capitals",
    "n_bangs",
]
SYMBOLS = b"#*$%&|<>"  # fixed value
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))

# Rate of each rule; a document without the denominator has rate 0.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "bangs": ("n_bangs", "n_words"),
}

# Shares of a stratum's other documents that a cutoff lets a rule reject, loose to tight.
SHARES = (0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1)
NEVER = 1 << 30  # the number of no policy

FEW_WORDS = 50
MUCH_REPEATED = 50  # percent


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice, first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(word, len(number)) for word in words), np.int64, len(words))
    kinds = np.int64(len(number))
    _, pair = np.unique(ids[:-2] * kinds + ids[1:-1], return_inverse=True)
    _, window, times = np.unique(
        pair.astype(np.int64) * kinds + ids[2:], return_inverse=True, return_counts=True
    )
    repeated = times[window] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(repeated)] |= repeated
    return int(covered.sum())


def count_text(text: bytes) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS``."""
    words = text.split()
    chars = len(text.decode()) - (len(text) - len(text.translate(None, SPACES.encode())))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        chars,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, CAPITALS)),
        text.count(b"!"),
    )


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``COUNTS``; those of the same names are replaced.

    NULL text has no words and no lines.
    """
    kept = docs.drop(*COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            rows = [count_text(text) for text in as_bytes(batch.column("text"))]
            counts = np.array(rows, np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(column) for column in counts.T)],
                [*batch.schema.names, *COUNTS],
            )

    added = [T.StructField(name, T.LongType()) for name in COUNTS]
    return kept.mapInArrow(count, T.StructType([*kept.schema.fields, *added]))


def base_failed():
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < FEW_WORDS) | (
        100 * F.col("n_repeat_words") > MUCH_REPEATED * F.col("n_words")
    )


def _rate(rule: str):
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def binomial_tail(rejected: int, good: int, share: float) -> float:
    """P(at most ``rejected`` of ``good``) if each is rejected with probability ``share``."""
    if rejected >= good:
        return 1.0
    logs = [
        math.lgamma(good + 1)
        - math.lgamma(k + 1)
        - math.lgamma(good - k + 1)
        + k * math.log(share)
        + (good - k) * math.log1p(-share)
        for k in range(rejected + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(value - top) for value in logs))


def safe_policy(rejected_first: dict[int, int], limit: float, level: float) -> int:
    """The last policy of a fixed sequence that is sure to reject few good documents; -1: not even one.

    ``rejected_first`` counts the holdout by the first policy that rejects a document (``NEVER``: none
    does). A policy rejects all that those in front of it do. Each is tested with the exact
    binomial probability of so few rejections, were the true rate at ``limit``; testing stops at
    the first that exceeds ``level``, and a sequence that is fixed in advance needs no correction.
    """
    good, rejected = sum(rejected_first.values()), 0
    for policy in range(len(SHARES) * len(RULES)):
        rejected += rejected_first.get(policy, 0)
        if binomial_tail(rejected, good, limit) > level:
            return policy - 1
    return len(SHARES) * len(RULES) - 1


def fit_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    false_rejection: float = 0.03,
    error: float = 0.05,
) -> DataFrame:
    """One row per stratum with labelled good documents: ``stratum`` and a cutoff per rule, NULL
    where none is safe.

    ``measured`` needs doc_id, the stratum column and ``COUNTS``; ``labels`` doc_id and quality
    (1: good; other values, NULLs and doc_ids that are not in ``measured`` do not count; a
    doc_id that is labelled good more than once counts once, and so do rows that repeat a doc_id in
    one stratum, by what is worst in them). Good documents that pass the base rules are the holdout.

    All rules are tightened together, so the limit holds for all of them at once and is not
    divided: in each stratum a sequence of policies goes through ``SHARES``, and at each share through
    the rules, setting the rule's cutoff to what that share of the stratum's other documents (those that
    are not labelled good) exceeds. Tests along the sequence are those of ``safe_policy``, at
    ``error`` / strata (Bonferroni). So with probability 1 - ``error`` no stratum rejects more than
    ``false_rejection`` of its good documents. Strata with too few labels reject nothing.

    A holdout document is reduced to the number of the first policy that rejects it, and those are
    counted before anything is brought together. Calling this runs jobs.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct()
    rates = [_rate(rule).alias(rule) for rule in RULES]
    base = measured.filter(~base_failed()).select("doc_id", F.col(stratum).alias("stratum"), *rates)
    levels = F.array(*[F.lit(1 - share) for share in SHARES])
    # One row per stratum; stored, so that Spark knows how small it is and moves no documents.
    ladders = stored(
        base.join(good, "doc_id", "left_anti")
        .groupBy(F.col("stratum").alias("of"))
        .agg(*[F.percentile_approx(rule, levels, 10_000).alias(f"{rule}_ladder") for rule in RULES]),
        "ladders",
    )
    firsts = []
    for place, rule in enumerate(RULES):
        # Cutoffs fall along the ladder: who exceeds n of them exceeds the last n.
        exceeded = F.expr(f"size(filter({rule}_ladder, cutoff -> {rule} > cutoff))")
        first = (F.lit(len(SHARES)) - exceeded) * len(RULES) + place
        firsts.append(F.when(exceeded > 0, first).otherwise(NEVER))
    holdout = (
        base.join(good, "doc_id", "left_semi")
        .groupBy("doc_id", "stratum")
        .agg(*[F.max(rule).alias(rule) for rule in RULES])
        .join(ladders, F.col("stratum").eqNullSafe(F.col("of")))
    )
    counts = holdout.groupBy("stratum", F.least(*firsts).alias("first")).count()
    counts = stored(counts, "holdout")
    level = error / max(counts.select("stratum").distinct().count(), 1)

    def choose(table: pa.Table) -> pa.Table:
        found = dict(zip(*(table.column(name).to_pylist() for name in ("first", "count")), strict=True))
        policy = safe_policy(found, false_rejection, level)
        return pa.table([table.column("stratum").slice(0, 1), pa.array([policy])], ["stratum", "policy"])

    kind = measured.schema[stratum].dataType.simpleString()
    policies = counts.groupBy("stratum").applyInArrow(choose, f"stratum {kind}, policy bigint")
    cutoffs = [
        F.when(
            F.col("policy") >= place,
            F.get(f"{rule}_ladder", F.floor((F.col("policy") - place) / len(RULES)).cast("int")),
        ).alias(rule)
        for place, rule in enumerate(RULES)
    ]
    chosen = policies.join(ladders, F.col("stratum").eqNullSafe(F.col("of")))
    return stored(chosen.select("stratum", *cutoffs), "cutoffs")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with base_failed and kept; the stratum NULL has cutoffs of its own.

    Whether the cutoffs are broadcast is left to Spark, which knows the size of their table. So few
    that it does (10 MB unless set otherwise, some 100,000 strata), and documents stay where they are.
    """
    prefix = "_"
    while any(name.startswith(prefix) for name in measured.columns):
        prefix += "_"
    named = cutoffs.withColumnsRenamed({name: f"{prefix}{name}" for name in ("stratum", *RULES)})
    joined = measured.join(named, F.col(stratum).eqNullSafe(F.col(f"{prefix}stratum")), "left")
    exceeded = [F.coalesce(_rate(rule) > F.col(f"{prefix}{rule}"), F.lit(False)) for rule in RULES]
    rejected = exceeded[0]
    for other in exceeded[1:]:
        rejected = rejected | other
    return joined.withColumns(
        {"base_failed": base_failed(), "kept": ~base_failed() & ~rejected}
    ).drop(*named.columns)
