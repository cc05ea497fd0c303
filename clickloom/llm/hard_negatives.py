"""Hard negatives of embedded rows, found with sort-tile-recursive (STR) packed R-trees.

All rows are packed into R-trees of bounded size: a sort over all executors cuts them into slabs,
tasks tile their slabs on coordinate after coordinate, and every node has its minimum bounding
box. A box gives an interval per coordinate, hence an interval of the inner product with an
anchor. A best-first queue opens boxes by their highest possible score and leaves out those whose
interval misses the window of scores that is looked for, or is strictly below the k-th score found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.text import shuffle_width, stored
from clickloom.session import fresh_folder

NONE = -(1 << 62)  # below every score
FANOUT = 16
MINED = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
    "positive_score bigint, negative_score bigint"
)
_TREE = "dims int, starts binary, lows binary, highs binary, " + ", ".join(
    f"{name} binary" for name in ("row", "vec_id", "label", "vector")
)
_FOUND = "query bigint, found_score bigint, found_id bigint"


def tiles(points: np.ndarray, page: int) -> list[np.ndarray]:
    """Rows of ``points`` in pages of at most ``page``, tiled along the widest coordinates first."""
    if not len(points):
        return []
    spread = points.max(0, initial=0) - points.min(0, initial=0)
    axes = list(np.argsort(-spread, kind="stable"))

    def tile(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = -(-len(rows) // page)
        if pages <= 1:
            return [rows]
        left = len(axes) - depth
        if left > 0:
            rows = rows[np.argsort(points[rows, axes[depth]], kind="stable")]
        slabs = max(2, round(pages ** (1 / left))) if left > 1 else pages
        size = page * -(-pages // slabs)
        cuts = [rows[at : at + size] for at in range(0, len(rows), size)]
        return [some for cut in cuts for some in tile(cut, depth + 1)]

    return tile(np.arange(len(points)), 0)


@dataclass
class Queries:
    """What is searched for: ``vector[of[i]]`` is the anchor of query i.

    A query takes rows of its label (``same``) or of others with low <= score <= high, but not the
    anchor's own row. ``score`` and ``found`` hold the best ``k`` so far.
    """

    dims: int
    vector: np.ndarray
    row: np.ndarray
    label: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    number: np.ndarray
    same: bool
    score: np.ndarray | None = None
    found: np.ndarray | None = None

    def started(self, k: int) -> Queries:
        self.score = np.full((len(self.of), k), NONE, np.int64)
        self.found = np.full((len(self.of), k), NONE, np.int64)
        return self

    def take(self, asking: np.ndarray, scores: np.ndarray, ids: np.ndarray, some: np.ndarray) -> None:
        """Merge the marked scores (queries ``asking`` x rows) into the best ones."""
        at, place = np.nonzero(some)
        if not len(at):
            return
        k = self.score.shape[1]
        touched = asking[np.unique(at)]
        query = np.concatenate([np.repeat(touched, k), asking[at]])
        score = np.concatenate([self.score[touched].ravel(), scores[at, place].astype(np.int64)])
        found = np.concatenate([self.found[touched].ravel(), ids[place]])
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        best = rank < k
        self.score[query[best], rank[best]] = score[best]
        self.found[query[best], rank[best]] = found[best]


class Tree:
    """A packed R-tree: level 0 holds the leaves' boxes, each further one those of 16 nodes."""

    def __init__(self, dims: int, starts, lows, highs, row, vec_id, label, vector):
        self.starts = np.append(starts, len(row))
        self.row, self.vec_id, self.label, self.vector = row, vec_id, label, vector
        self.levels = [(lows, highs, label[starts], label[self.starts[1:] - 1])]
        while len(self.levels[-1][0]) > 1:
            low, high, least, most = self.levels[-1]
            firsts = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (
                    np.minimum.reduceat(low, firsts),
                    np.maximum.reduceat(high, firsts),
                    np.minimum.reduceat(least, firsts),
                    np.maximum.reduceat(most, firsts),
                )
            )

    def search(self, queries: Queries, which: np.ndarray) -> int:
        """Update the best of the queries ``which``; returns how many leaves were opened."""
        anchors, of = np.unique(queries.of[which], return_inverse=True)
        vector = queries.vector[anchors]
        largest = [float(np.abs(x).max(initial=0)) for x in (vector, self.vector)]
        # Doubles add integers exactly up to 2^53, and much faster.
        kind = np.float64 if largest[0] * largest[1] * queries.dims < 2**53 else np.int64
        vector, rows = vector.astype(kind), self.vector.astype(kind)
        above, below = np.maximum(vector, 0), np.minimum(vector, 0)
        low, high = queries.low[which], queries.high[which]
        label, own = queries.label[queries.of[which]], queries.row[queries.of[which]]
        opened, heap, pushed = 0, [], 0

        def wanted(at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
            kth = queries.score[which[at], -1]
            return (upper >= np.maximum(low[at], kth)) & (lower <= high[at])

        def push(level: int, nodes: range, at: np.ndarray) -> None:
            nonlocal pushed
            lows, highs, least, most = self.levels[level]
            some = slice(nodes.start, nodes.stop)
            lows, highs = lows[some].astype(kind).T, highs[some].astype(kind).T
            asked, back = np.unique(of[at], return_inverse=True)
            upper = (above[asked] @ highs + below[asked] @ lows)[back]
            lower = (above[asked] @ lows + below[asked] @ highs)[back]
            for i, node in enumerate(nodes):
                inside = (least[node] <= label[at]) & (label[at] <= most[node])
                fits = inside if queries.same else ~(inside & (least[node] == most[node]))
                fits &= wanted(at, upper[:, i], lower[:, i])
                if fits.any():
                    pushed += 1
                    entry = (level, node, at[fits], upper[fits, i], lower[fits, i])
                    heapq.heappush(heap, (-float(upper[fits, i].max()), pushed, entry))

        push(len(self.levels) - 1, range(1), np.arange(len(which)))
        while heap:
            level, node, at, upper, lower = heapq.heappop(heap)[2]
            at = at[wanted(at, upper, lower)]
            if not len(at):
                continue
            if level:
                first = node * FANOUT
                push(level - 1, range(first, min(first + FANOUT, len(self.levels[level - 1][0]))), at)
                continue
            opened += 1
            leaf = slice(self.starts[node], self.starts[node + 1])
            asked, back = np.unique(of[at], return_inverse=True)
            scores = (vector[asked] @ rows[leaf].T)[back]
            least = np.maximum(low[at], queries.score[which[at], -1])
            some = (scores >= least[:, None]) & (scores <= high[at][:, None])
            some &= (self.label[leaf] == label[at][:, None]) == queries.same
            some &= self.row[leaf] != own[at][:, None]
            queries.take(which[at], scores, self.vec_id[leaf], some)
        return opened


def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    parts = [np.zeros(0, np.int32), *(chunk.flatten().to_numpy() for chunk in vectors.chunks)]
    return np.concatenate(parts).astype(np.int32).reshape(len(vectors), dims)


def pack_trees(held: DataFrame, tree_rows: int, leaf_rows: int) -> DataFrame:
    """Stored R-trees over ``held`` (row, vec_id, label, dims, vector), one per row.

    One shuffle sorts all rows by dimension, label and first coordinate, with a hash after them, so
    that rows of one label or equal vectors spread over tasks; each task packs what it gets, at most
    ``tree_rows`` at a time.
    """
    keys = ["dims", "label", F.get("vector", F.lit(0)), F.xxhash64("row")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            dims = table.column("dims")[0].as_py()
            row, vec_id, label = (
                table.column(name).to_numpy().astype(np.int64) for name in ("row", "vec_id", "label")
            )
            vector = _matrix(table.column("vector"), dims)
            pages = []
            for value in np.unique(label):
                own = np.flatnonzero(label == value)
                pages += [own[page] for page in tiles(vector[own], leaf_rows)]
            order = np.concatenate(pages)
            starts = np.cumsum([0, *(len(page) for page in pages[:-1])])
            vector = vector[order]
            values = [starts, np.minimum.reduceat(vector, starts), np.maximum.reduceat(vector, starts)]
            values += [row[order], vec_id[order], label[order], vector]
            names = ["dims", "starts", "lows", "highs", "row", "vec_id", "label", "vector"]
            return pa.RecordBatch.from_arrays(
                [pa.array([dims], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)],
                names,
            )

        parts, size, dims = [], 0, None
        for batch in batches:
            kinds = batch.column("dims").to_numpy()
            cuts = np.flatnonzero(np.diff(kinds)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                while start < end:
                    if parts and (size == tree_rows or dims != kinds[start]):
                        yield tree(parts)
                        parts, size = [], 0
                    dims = kinds[start]
                    some = min(int(end - start), tree_rows - size)
                    parts.append(batch.slice(int(start), some))
                    size, start = size + some, start + some
        if parts:
            yield tree(parts)

    placed = held.repartitionByRange(shuffle_width(held), *keys).sortWithinPartitions(*keys)
    return stored(placed.mapInArrow(pack, _TREE), "trees")


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Tree]]:
    for batch in batches:
        for at in range(batch.num_rows):
            one = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            dims = one["dims"]
            narrow = {n: np.frombuffer(one[n], np.int64) for n in ("starts", "row", "vec_id", "label")}
            sizes = {n: len(narrow["starts"]) for n in ("lows", "highs")} | {"vector": len(narrow["row"])}
            wide = {n: np.frombuffer(one[n], np.int32).reshape(size, dims) for n, size in sizes.items()}
            yield dims, Tree(dims, **narrow, **wide)


def search_trees(trees: DataFrame, queries: list[Queries], k: int, group: int) -> DataFrame:
    """(query, found_score, found_id): the best ``k`` rows of all trees for each query.

    The queries are broadcast; their number is the caller's bound. A task goes through its trees
    with the best so far in hand, so it sends at most ``k`` rows per query.
    """
    # Plain arrays, since a broadcast value travels without the code of its class.
    sent = trees.sparkSession.sparkContext.broadcast([vars(asked) for asked in queries])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {asked["dims"]: Queries(**asked).started(k) for asked in sent.value}
        for dims, tree in _loaded(batches):
            if dims in held:
                asked = held[dims]
                # Queries of ``group`` neighbouring anchors share a queue.
                cuts = np.flatnonzero(np.diff(asked.of // group)) + 1
                for which in np.split(np.arange(len(asked.of)), cuts):
                    tree.search(asked, which)
        for asked in held.values():
            query, place = np.nonzero(asked.score != NONE)
            columns = [asked.number[query], asked.score[query, place], asked.found[query, place]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column) for column in columns], ["query", "found_score", "found_id"]
            )

    found = trees.mapInArrow(search, _FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _held(vectors: DataFrame, is_anchor: Column, scale: int) -> DataFrame:
    """Rows that take part, numbered, with integer components."""
    size = F.size("embedding")
    most = F.least(F.sqrt(F.lit(float(1 << 61)) / F.greatest(size, F.lit(1))), F.lit(float((1 << 31) - 1)))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    # A NULL component makes this NULL; NaN and infinite ones are greater than any bound.
    bounded = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) <= most - 1)
    rows = vectors.select("vec_id", "label", "embedding", is_anchor.alias("anchor")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & bounded
    )
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        size.alias("dims"),
        scaled.cast("array<int>").alias("vector"),
        F.coalesce("anchor", F.lit(False)).alias("anchor"),
    )


def _anchors(block: pa.Table, group: int) -> dict[int, dict[str, np.ndarray]]:
    """Anchors of a block by dimension, neighbours next to each other."""
    result = {}
    dims = block.column("dims").to_numpy()
    for kind in np.unique(dims):
        some = block.filter(pa.array(dims == kind))
        vector = _matrix(some.column("vector"), kind)
        order = np.concatenate(tiles(vector, group))
        names = ("row", "vec_id", "label")
        named = {name: some.column(name).to_numpy().astype(np.int64)[order] for name in names}
        result[int(kind)] = named | {"vector": vector[order]}
    return result


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
    scale: int = 256,
    tree_rows: int = 1 << 14,
    leaf_rows: int = 64,
    block: int = 1 << 15,
    group: int = 256,
) -> DataFrame:
    """For each anchor and positive, the closest rows of other labels within a window of scores.

    ``vectors`` has vec_id, label (an integer) and embedding; other columns are not read, whatever
    their names. ``is_anchor`` is a condition on these columns. A component x counts as
    floor(scale * x); a score is the integer inner product with the anchor, and higher scores come
    first, ties by smaller vec_id. An anchor's positives are its first ``positives`` other rows of
    its label, and each one's negatives the first ``negatives`` rows of other labels with
    percent[0] * positive_score <= 100 * negative_score <= percent[1] * positive_score.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); an anchor
    without positives, or a positive without negatives, has no row. Rows with a NULL vec_id, label,
    vector or component, with a component that is not finite, or one so large (beyond
    sqrt(2^61 / dimension) after scaling) that scores would not fit a long, take no part. Vectors of
    different dimension never meet. Rows that repeat a vec_id are rows of their own: each one can
    be positive or negative, also of the row it repeats, and a repeated anchor gives its results
    each time. An empty table, or none with an anchor, gives an empty result.

    Anchors are searched ``block`` at a time: that many are broadcast (at most ``block`` vectors,
    about 8 MB at 64 dimensions), and a task holds ``positives`` x ``negatives`` results of each.
    Each of the two passes per block reads all trees once; nothing is limited on the other side,
    every row is in a tree.
    """
    spark = vectors.sparkSession
    held = stored(_held(vectors, is_anchor, scale), "vectors")
    blocks = -(-held.filter("anchor").count() // block)
    if not blocks:
        return spark.createDataFrame([], MINED)
    trees = pack_trees(held.drop("anchor"), tree_rows, leaf_rows)
    asked = held.filter("anchor").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    folder, results = fresh_folder(spark, "anchors"), fresh_folder(spark, "mined")
    asked.write.partitionBy("block").parquet(folder)
    asked = spark.read.schema(asked.schema).parquet(folder)

    for number in range(blocks):
        one = asked.filter(F.col("block") == number).select("row", "vec_id", "label", "dims", "vector")
        known = _anchors(one.toArrow(), group)
        if not known:
            continue
        first, queries = 0, []
        for dims, anchor in known.items():
            n = len(anchor["row"])
            queries.append(
                Queries(
                    dims, anchor["vector"], anchor["row"], anchor["label"], np.arange(n),
                    np.full(n, NONE + 1), np.full(n, -NONE), first + np.arange(n), same=True,
                )
            )
            first += n
        # At most ``block`` x ``positives`` rows, like the anchors themselves.
        close = search_trees(trees, queries, positives, group).toArrow().sort_by(
            [("query", "ascending"), ("rank", "ascending")]
        )
        query, score, found = (close.column(i).to_numpy() for i in range(3))
        hundreds, rest = np.divmod(score, 100)  # 100 x score may not fit
        low = percent[0] * hundreds - (-percent[0] * rest) // 100
        high = percent[1] * hundreds + percent[1] * rest // 100
        windows, names = [], []
        for asking in queries:
            own = np.flatnonzero(
                (query >= asking.number[0]) & (query <= asking.number[-1]) & (low <= high)
            )
            of = query[own] - asking.number[0]
            windows.append(
                Queries(
                    asking.dims, asking.vector, asking.row, asking.label, of,
                    low[own], high[own], own, same=False,
                )
            )
            names.append(np.stack([own, known[asking.dims]["vec_id"][of], found[own], score[own]]))
        columns = np.concatenate(names, axis=1).astype(np.int64)
        named = spark.createDataFrame(
            pa.table(list(columns), ["query", "anchor_id", "positive_id", "positive_score"]),
            "query bigint, anchor_id bigint, positive_id bigint, positive_score bigint",
        )
        mined = search_trees(trees, windows, negatives, group)
        # The broadcast side has a row per positive of the block.
        mined.join(F.broadcast(named), "query").select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("found_id").alias("negative_id"),
            "positive_score",
            F.col("found_score").alias("negative_score"),
        ).write.mode("append").parquet(results)
    return spark.read.schema(MINED).parquet(results)


# Rows that take part, as the operator counts them; small enough components are assumed.
HARD_NEGATIVES_SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as vector
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scores as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same,
    cast(list_dot_product(a.vector, r.vector) as bigint) as score
  from rows a join rows r on a.vec_id <> r.vec_id
  where a.vec_id % 100 = 0
),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
),
negatives as (
  select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
    row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from positives join scores using (anchor_id)
  where not same and 80 * positive_score <= 100 * score and score <= positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score,
  negative_score
from negatives where rank <= 5
"""
