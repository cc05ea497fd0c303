"""Trie of conversation prefixes, built from range-partitioned, locally sorted shards.

Conversations are sorted by their sequence of turns, so the members of every node of the trie stand
next to each other. Splitters cut that order into shards. A node whose members may stand in more
than one shard is a prefix of some splitter: the splitters' own trie, the skeleton, is broadcast, and
each shard finishes all other nodes alone. Of skeleton nodes a shard gives partial aggregates, which
are reduced by node and then added up along the skeleton.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.text import shuffle_width, stored, whole_text

WIDTH = 16  # bytes of a turn's digest
ROOT = 0

NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
# What shards give: finished nodes, of which ``skeleton`` names a parent in the skeleton, and parts
# of skeleton nodes, with the ids that end there.
_FOUND = NODES + ", skeleton bigint, part boolean, ends string"


def _sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): digest and code points of each turn, in order."""
    role, text = whole_text("role"), whole_text("text")
    # The role's length keeps ("ab", "c") and ("a", "bc") apart.
    written = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.substring(F.sha2(written, 256), 1, 2 * WIDTH).alias("digest"),
            F.length(text).alias("size"),
        ).alias("one"),
    ).filter("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, path, sizes) per conversation, its first turns replaced by its family's.

    The family of conversation c is conversation c - c % ``family``; h = crc32(c as decimal) %
    ``heads`` of its first turns are followed by c's own after the first h. ``path`` joins the turns'
    digests, ``sizes`` lists their code points. Only digests are shuffled; families are read from
    the one conversation that each of them shares, by a join on that id.
    """
    own = stored(_sequences(conversations), "sequences")
    first = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("family"), F.slice("turns", 1, heads - 1).alias("shared")
    )
    joined = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % family).join(
        first, "family", "left"
    )
    n = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    none = F.slice("turns", 1, 0)
    turns = F.concat(
        F.slice(F.coalesce("shared", none), F.lit(1), n),
        F.slice("turns", n + 1, F.greatest(F.size("turns") - n, F.lit(0))),
    )
    return joined.select("conv_id", turns.alias("turns")).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )


def splitters(
    paths: DataFrame, rows: int, shards: int, sample: int, most_bytes: int
) -> list[tuple]:
    """Up to ``shards`` - 1 rows (path, conv_id, sizes) that cut the order into even parts.

    Chosen from a sample by hash of about ``sample`` rows per shard, thinned out until it holds
    at most ``most_bytes``, which bounds what is collected and broadcast: with very long paths there
    are fewer shards.
    """
    step = max(1, rows // max(1, sample * shards))
    number = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 40))
    while True:
        some = paths.filter(number % step == 0)
        held = some.agg(F.sum(F.octet_length("path") + 4 * F.size("sizes") + 64)).first()[0] or 0
        if held <= most_bytes:
            break
        if step > 1 << 40:  # even a single path is too long
            return []
        step *= 2
    drawn = sorted((bytes(r["path"]), r["conv_id"], r["sizes"]) for r in some.collect())
    chosen = [drawn[len(drawn) * i // shards] for i in range(1, shards)] if drawn else []
    return [row for i, row in enumerate(chosen) if i == 0 or row[:2] != chosen[i - 1][:2]]


def skeleton_of(cuts: list[tuple]) -> tuple[dict[tuple[int, bytes], int], list[tuple]]:
    """The splitters' trie: child by (node, digest), and per node (parent, depth, size)."""
    child, nodes = {}, [(None, 0, 0)]
    for path, _, sizes in cuts:
        at = ROOT
        for depth, size in enumerate(sizes):
            key = (at, path[WIDTH * depth : WIDTH * (depth + 1)])
            if key not in child:
                child[key] = len(nodes)
                nodes.append((at, depth + 1, size))
            at = child[key]
    return child, nodes


class _Node:
    """An open node: aggregates over the members of this shard seen so far."""

    __slots__ = ("bone", "size", "least", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, bone: int | None, size: int):
        self.bone, self.size = bone, size  # its number in the skeleton, code points of its turn
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.waiting: list[list] = []  # finished children; they need this node's smallest member

    def meet(self, least: int, n: int) -> None:
        self.least = least if self.least is None else min(least, self.least)
        self.n += n


def shard_nodes(rows: Iterator[tuple], child: dict) -> Iterator[list]:
    """Finished nodes and parts of skeleton nodes from a shard's rows (path, conv_id, sizes), sorted."""
    root = _Node(ROOT, 0)
    open_nodes, last = [root], b""

    def close() -> Iterator[list]:
        node, depth = open_nodes.pop(), len(open_nodes)
        above = open_nodes[-1] if open_nodes else None
        joined = ",".join(map(str, node.ends))
        if node.bone is None:
            leaves = node.leaves or 1
            saved = node.saved + (node.n - 1) * node.size
            for row in node.waiting:
                row[2] = node.least
                yield row
            digest = hashlib.sha256(joined.encode()).hexdigest()
            row = [
                node.least, depth, None, node.n, node.children, leaves, saved, digest, above.bone, False,
                None,
            ]
            above.children += 1
            if above.bone is None:
                above.waiting.append(row)
            else:
                yield row
        else:
            # Without "less one", which is taken off when all parts are together.
            leaves, saved = node.leaves, node.saved + node.n * node.size
            yield [
                node.least, depth, None, node.n, node.children, leaves, saved, None, node.bone, True,
                joined if node.ends else None,
            ]
        if above:
            above.meet(node.least, node.n)
            above.leaves += leaves
            above.saved += saved

    for path, conv_id, sizes in rows:
        shared = 0
        while (
            shared < len(open_nodes) - 1
            and shared < len(sizes)
            and path[WIDTH * shared : WIDTH * (shared + 1)] == last[WIDTH * shared : WIDTH * (shared + 1)]
        ):
            shared += 1
        while len(open_nodes) > shared + 1:
            yield from close()
        for depth in range(shared, len(sizes)):
            bone = open_nodes[-1].bone
            if bone is not None:
                bone = child.get((bone, path[WIDTH * depth : WIDTH * (depth + 1)]))
            open_nodes.append(_Node(bone, sizes[depth]))
        open_nodes[-1].meet(conv_id, 1)
        open_nodes[-1].ends.append(conv_id)
        last = path
    while open_nodes:
        yield from close()


def _as_table(rows: list[list], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_FOUND_ARROW = pa.schema(
    [(name, _ARROW[kind]) for name, kind in (field.split() for field in _FOUND.split(", "))]
)
_NODES_ARROW = pa.schema(list(_FOUND_ARROW)[:8])


def roll_up(parts: list[dict], nodes: list[tuple]) -> list[list]:
    """Whole skeleton nodes from reduced parts: leaves and savings added up from below."""
    known = {part["skeleton"]: part for part in parts}
    order = sorted(known, key=lambda bone: -nodes[bone][1])
    children, leaves, less = dict.fromkeys(known, 0), dict.fromkeys(known, 0), dict.fromkeys(known, 0)
    rows = []
    for bone in order:
        part, (parent, depth, size) = known[bone], nodes[bone]
        n_children = part["n_children"] + children[bone]
        # A shard counts leaves below; a skeleton node that has no child anywhere is one itself.
        leaves[bone] += 0 if n_children else 1
        less[bone] += size
        if parent is not None:
            children[parent] += 1
            leaves[parent] += leaves[bone]
            less[parent] += less[bone]
        rows.append(
            [
                part["conv_id"],
                depth,
                None if parent is None else known[parent]["conv_id"],
                part["n_convs"],
                n_children,
                part["n_leaves"] + leaves[bone],
                part["saved_tokens"] - less[bone],
                part["ends_sha256"],
                bone,
            ]
        )
    return rows


def _ends(found: DataFrame) -> DataFrame:
    """(skeleton, ends_sha256): the hash of all ids that end at a node, in ascending order.

    A shard sends its ids of a node as one string. Shards follow each other in the order of ids, so
    the strings are hashed one after the other as they come, never joined in memory.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(bone, state):
            return pa.RecordBatch.from_arrays(
                [pa.array([bone], pa.int64()), pa.array([state.hexdigest()])], ["skeleton", "ends_sha256"]
            )

        at, state = None, None
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("skeleton", "ends"))
            for bone, ends in zip(*columns, strict=True):
                if bone == at:
                    state.update(b",")
                else:
                    if state is not None:
                        yield row(at, state)
                    at, state = bone, hashlib.sha256()
                state.update(ends.encode())
        if state is not None:
            yield row(at, state)

    rows = found.filter("part and ends is not null").select(
        "skeleton", F.substring_index("ends", ",", 1).cast("bigint").alias("first"), "ends"
    )
    return (
        rows.repartition("skeleton")
        .sortWithinPartitions("skeleton", "first")
        .select("skeleton", "ends")
        .mapInArrow(digest, "skeleton bigint, ends_sha256 string")
    )


def trie_nodes(
    paths: DataFrame, shard_rows: int = 1 << 16, sample: int = 32, skeleton_bytes: int = 1 << 25
) -> DataFrame:
    """All nodes of the trie of ``paths`` (conv_id, path, sizes), as ``prefix_trie`` returns them.

    ``shard_rows`` is about how many conversations a task holds at a time.
    """
    spark = paths.sparkSession
    paths = stored(paths, "paths")
    rows = paths.count()
    shards = max(shuffle_width(paths), -(-rows // shard_rows))
    cuts = splitters(paths, rows, shards, sample, skeleton_bytes)
    child, nodes = skeleton_of(cuts)
    # At most what splitters() was allowed to collect.
    sent = spark.sparkContext.broadcast(([row[:2] for row in cuts], child))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = sent.value[0]
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            shard = [bisect.bisect_right(bounds, key) for key in keys]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard, pa.int64())], [*batch.schema.names, "shard"]
            )

    def finish(rows: pa.Table) -> pa.Table:
        named = (rows.column(name).to_pylist() for name in ("path", "conv_id", "sizes"))
        ordered = sorted(zip(*named, strict=True), key=lambda row: row[:2])
        return _as_table(list(shard_nodes(iter(ordered), sent.value[1])), _FOUND_ARROW)

    dealt = paths.select("conv_id", "path", "sizes").mapInArrow(
        deal, "conv_id bigint, path binary, sizes array<int>, shard bigint"
    )
    found = stored(dealt.groupBy("shard").applyInArrow(finish, _FOUND), "trie")
    parts = (
        found.filter("part")
        .groupBy("skeleton")
        .agg(
            F.min("conv_id").alias("conv_id"),
            *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        )
        .join(_ends(found), "skeleton", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    )
    schema = pa.schema([*_NODES_ARROW, ("skeleton", pa.int64())])
    skeleton = spark.sparkContext.broadcast(nodes)

    def whole(rows: pa.Table) -> pa.Table:
        return _as_table(roll_up(rows.to_pylist(), skeleton.value), schema)

    # One task for the skeleton, whose size the splitters bound.
    bones = stored(
        parts.groupBy(F.lit(0).alias("all")).applyInArrow(whole, f"{NODES}, skeleton bigint"), "skeleton"
    )
    # Children of skeleton nodes learn their parent's smallest member from that same bounded table.
    parent = bones.select("skeleton", F.col("conv_id").alias("parent"))
    local = found.filter("not part").join(F.broadcast(parent), "skeleton", "left")
    names = bones.drop("skeleton").columns
    return bones.select(names).unionByName(
        local.withColumn("parent_conv_id", F.coalesce("parent", "parent_conv_id")).select(names)
    )


def prefix_trie(conversations: DataFrame, family: int = 100, heads: int = 6, **sizes) -> DataFrame:
    """Nodes of the trie over all conversations, rebuilt as ``rebuilt`` says.

    ``conversations`` has conv_id, turn, role and text; other columns are not read, whatever their
    names. Turns are ordered by turn, NULL first; rows with the same turn by a digest of role and
    text, and rows that repeat each other are turns of their own. A NULL role or text counts as
    empty; rows without conv_id belong to no conversation. Turns are told apart by 128 bits of SHA-256.

    Returns per node, the textless root included: conv_id, its smallest member; depth; parent_conv_id
    (NULL for the root); n_convs; n_children; n_leaves; saved_tokens, over its subtree each node's
    (n_convs - 1) x code points of its last text; ends_sha256 of the ids of members that end there,
    ascending, joined by commas. An empty table has no root either.

    A conversation's digests, 16 bytes a turn, must fit a row; texts are not gathered. Equal
    conversations are ordered by conv_id, so a group of copies that holds a third of all rows is cut
    by splitters like everything else.
    """
    return trie_nodes(rebuilt(conversations, family, heads), **sizes)


PREFIX_TRIE_SQL = """
with bits as (
  select conv_id, cast(list_reduce(
    list_prepend(cast(4294967295 as ubigint), list_transform(
      string_split(cast(conv_id as varchar), ''), lambda s: cast(ascii(s) as ubigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), cast(range(8) as ubigint[])), lambda x, i:
      xor(x >> 1, case when x & 1 = 1 then cast(3988292384 as ubigint) else cast(0 as ubigint) end))
  ) as ubigint) as c
  from (select distinct conv_id from conversations where conv_id is not null)
),
turns as (
  select conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as one,
    row_number() over (partition by conv_id order by turn nulls first) as place
  from conversations where conv_id is not null
),
own as (
  select conv_id, list(one order by place) as own,
    any_value(cast(xor(c, cast(4294967295 as ubigint)) % 6 as bigint)) as h
  from turns join bits using (conv_id) group by conv_id
),
whole as (
  select o.conv_id,
    coalesce(f.own[1:o.h], []) || o.own[o.h + 1:] as path
  from own o left join own f on f.conv_id = o.conv_id - o.conv_id % 100
),
members as (
  select conv_id, len(path) as d, unnest(range(len(path) + 1)) as depth, path from whole
),
prefixes as (select conv_id, d, depth, path[1:depth] as node from members),
nodes as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id)
                    filter (where d = depth), '')) as ends_sha256
  from prefixes group by node, depth
),
children as (
  select p.node, count(*) as n_children
  from nodes p join nodes c on c.depth = p.depth + 1 and c.node[1:p.depth] = p.node group by p.node
),
counted as (
  select n.*, coalesce(n_children, 0) as n_children
  from nodes n left join children c on n.node = c.node
),
above as (
  select node[1:up] as top, n_children, case when depth > 0 then (n_convs - 1) * length(node[depth].t)
    else 0 end as saved
  from (select *, unnest(range(depth + 1)) as up from counted)
),
summed as (
  select top, count(*) filter (where n_children = 0) as n_leaves,
    cast(sum(saved) as bigint) as saved_tokens
  from above group by top
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves,
  saved_tokens, n.ends_sha256
from counted n join summed on top = n.node
  left join nodes p on p.depth = n.depth - 1 and p.node = n.node[1:n.depth - 1]
"""
