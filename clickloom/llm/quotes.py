"""Quotation linking in conversations.

Messages are parsed into their own text and what they quote, by level. Quoted passages are hashed in
a normal form and joined with the messages that said them first; the message that is quoted is the
one replied to. Quotes are then left out, and messages put in the order of replies.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.text import as_bytes, stored

QUOTED = re.compile(rb"^((?:[ \t]{0,3}>)+)[ \t]?")
WROTE = rb"(wrote|writes|schrieb|escribi\xc3\xb3|a \xc3\xa9crit)"
ATTRIBUTION = re.compile(rb"^[^>].*\b" + WROTE + rb" ?:[ \t\r]*$")

_PASSAGES = "array<struct<level:int,hash:binary,chars:int>>"


def quote_level(line: bytes) -> tuple[int, bytes]:
    """How deep a line is quoted, and what it says."""
    found = QUOTED.match(line)
    return (found[1].count(b">"), line[found.end() :]) if found else (0, line)


def normal_form(passage: bytes) -> bytes:
    """A-Z in lower case, white space as single spaces: line breaks of a quote do not matter."""
    return b" ".join(passage.lower().split())


def parse(text: bytes) -> tuple[bytes, int, list[tuple[int, bytes]]]:
    """A message's own text, its deepest level, and its passages (level, normal form).

    A passage is a run of lines of one level without an empty line; a run of several lines counts
    whole and line by line, so that partial quotes are found too. A line such as "... wrote:" right
    before a quote belongs to the quote.
    """
    lines = [quote_level(line) for line in text.split(b"\n")]
    own = [
        line
        for at, (level, line) in enumerate(lines)
        if level == 0
        and not (at + 1 < len(lines) and lines[at + 1][0] > 0 and ATTRIBUTION.match(line))
    ]
    passages, run = {}, []

    def close(level: int) -> None:
        whole = normal_form(b"\n".join(run))
        for passage in [whole, *map(normal_form, run)]:
            if passage:
                passages[level, passage] = True
        run.clear()

    now = 0
    for level, line in lines:
        if level != now or not line.strip():
            close(now)
        now = level
        if line.strip():
            run.append(line)
    close(now)
    deepest = max(level for level, _ in lines)
    kept = b"\n".join(own).strip() if deepest else text
    return kept, deepest, list(passages)


def _described(level: int, said: bytes) -> dict:
    digest = hashlib.sha256(said).digest()[:16]
    return {"level": level, "hash": digest, "chars": len(said.decode())}


def _parsed(messages: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, deepest, found = [], [], []
            for text in as_bytes(batch.column("text")):
                kept, level, passages = parse(text)
                own.append(kept.decode())
                deepest.append(level)
                found.append([_described(at, said) for at, said in passages])
            kind = pa.list_(
                pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("chars", pa.int32())])
            )
            names = ["conv_id", "turn", "role", "message"]
            added = [pa.array(own, pa.string()), pa.array(deepest, pa.int32()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), *added],
                [*names, "own_text", "max_level", "passages"],
            )

    kinds = {field.name: field.dataType for field in messages.schema}
    schema = T.StructType(
        [T.StructField(name, kinds[name]) for name in ("conv_id", "turn", "role", "message")]
    )
    added = T._parse_datatype_string(f"own_text string, max_level int, passages {_PASSAGES}")
    return messages.mapInArrow(read, T.StructType([*schema.fields, *added.fields]))


def link_quotes(conversations: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row per message: conv_id, turn, role, own_text, max_level, n_quoted, n_linked,
    parent_turn, parent_conv, thread, thread_turn, depth.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. A quoted
    passage's original is the first message (by turn) of the same conversation that says it itself,
    if that is earlier, else, for passages of at least ``min_chars`` characters in normal form, the
    first message of any other conversation. n_quoted and n_linked count distinct quoted passages
    of any length. The parent is the original of the least deep, then longest, passage; parent_conv tells
    whether it is in another conversation. Messages without a parent in their own conversation start a
    thread; ``thread`` is its number, unique but not the same in every run, ``thread_turn`` the turn of
    the message that starts it, ``depth`` the number of replies between that one and this. Sorted by conv_id,
    thread_turn, thread, depth and turn, each message follows what it answers. A row's size does not depend on
    its depth.

    NULL text is empty. A NULL conv_id is a conversation, a NULL turn comes first. Repeated rows are
    messages of their own. Originals are aggregated per passage before anything is joined with them,
    so a passage that a third of all messages share is one row per task.
    """
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn(
        "message", F.monotonically_increasing_id()
    )
    messages = stored(_parsed(numbered), "messages")
    said = messages.select(
        "conv_id", "turn", "message", F.explode("passages").alias("passage")
    ).select("conv_id", "turn", "message", "passage.*")
    place = F.struct("turn", "message")
    own = said.filter("level = 0")
    here = own.groupBy(F.col("conv_id").alias("at_conv"), F.col("hash").alias("own_hash")).agg(
        F.min(place).alias("here")
    )
    # A few words alone do not tell that another conversation is quoted.
    anywhere = (
        own.filter(F.col("chars") >= min_chars)
        .groupBy("hash")
        .agg(F.min(F.struct("conv_id", "turn", "message")).alias("there"))
    )
    quoted = said.filter("level > 0")
    elsewhere_is_here = F.col("there.conv_id").eqNullSafe(F.col("conv_id"))
    rank = F.struct(F.col("here").isNull().alias("far"), "level", (-F.col("chars")).alias("chars"))
    found = (
        quoted.join(
            here,
            F.col("conv_id").eqNullSafe(F.col("at_conv")) & (F.col("hash") == F.col("own_hash")),
            "left",
        )
        .join(anywhere, "hash", "left")
        .withColumn("here", F.when(F.col("here") < place, F.col("here")))
        .withColumn("there", F.when(~elsewhere_is_here, F.col("there")))
        .select(
            "message",
            "hash",
            rank.alias("order"),
            F.struct(
                F.coalesce("here.message", "there.message").alias("parent"),
                F.coalesce("here.turn", "there.turn").alias("parent_turn"),
                F.when(F.col("here").isNull(), F.col("there.conv_id")).alias("parent_conv"),
            ).alias("original"),
        )
    )
    is_linked = F.col("original.parent").isNotNull()
    links = found.groupBy("message").agg(
        F.count_distinct("hash").alias("n_quoted"),
        F.count_distinct(F.when(is_linked, F.col("hash"))).alias("n_linked"),
        F.min_by("original", F.when(is_linked, F.col("order"))).alias("original"),
    )
    linked = stored(
        messages.drop("passages")
        .join(links, "message", "left")
        .select(
            *["message", "conv_id", "turn", "role", "own_text", "max_level"],
            F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
            "original.*",
        ),
        "linked-messages",
    )
    return linked.join(_threads(linked), "message").drop("message", "parent")


def _threads(linked: DataFrame) -> DataFrame:
    """(message, thread, thread_turn, depth), by doubling: each round joins the ways up found so far.

    Links inside a conversation lead to earlier messages, so ways end. ``above`` is the message that
    a way has got to, ``steps`` how far that is; at its end a way has no ``above``, and knows its thread.
    """
    has_parent = F.col("parent").isNotNull() & F.col("parent_conv").isNull()
    ways = linked.select(
        "message",
        F.when(has_parent, F.col("parent")).alias("above"),
        F.when(has_parent, 1).otherwise(0).cast("bigint").alias("steps"),
        F.when(~has_parent, F.struct(F.col("message").alias("thread"), "turn")).alias("start"),
    )
    while not (open_ := ways.filter("above is not null")).isEmpty():
        upper = ways.selectExpr("message as above", "above as next", "steps as more", "start")
        longer = open_.drop("start").join(upper, "above").selectExpr(
            "message", "next as above", "steps + more as steps", "start"
        )
        ways = stored(ways.filter("above is null").unionByName(longer), "threads")
    return ways.selectExpr(
        "message", "start.thread as thread", "start.turn as thread_turn", "steps as depth"
    )
