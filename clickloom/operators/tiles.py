"""Exact ntile for several measures at once, by selecting the rows that tiles start with."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.session import fresh_folder

NULLS = -1  # the bucket of NULLs, in front of all others


@dataclass
class _Search:
    """Where a row of some ranks is: rows whose ``column`` is in [low, high], with ``before`` in front.

    ``tied`` holds, once the measure is settled, its value; then the search goes on by key.
    """

    measure: str
    column: str
    low: int
    high: int
    before: int
    ranks: dict[int, int]  # tile -> rank
    tied: tuple = ()
    nulls: bool = False  # NULLs are in front of the first interval, in none of those that follow
    counts: dict[int, int] = field(default_factory=dict)

    def shift(self, buckets: int) -> int:
        bits = 0
        while (self.high >> bits) - (self.low >> bits) >= buckets:
            bits += 1
        return bits

    def bucket(self, buckets: int) -> Column:
        """Bucket of a row, counted from 0; NULL if the row is not in the interval."""
        value, shift = F.col(f"`{self.column}`").cast("bigint"), self.shift(buckets)
        number = F.shiftright(value, shift) - F.lit(self.low >> shift)
        number = F.when(value.between(F.lit(self.low), F.lit(self.high)), number)
        if self.nulls:
            number = F.when(value.isNull(), F.lit(NULLS)).otherwise(number)
        if self.tied:
            number = F.when(F.col(f"`{self.measure}`").eqNullSafe(F.lit(self.tied[0])), number)
        return number


def _starts(rows: int, tiles: int) -> dict[int, int]:
    """Rank of the first row of each tile; the first (rows % tiles) hold one row more."""
    size, more = divmod(rows, tiles)
    found = {tile: tile * size + min(tile, more) for tile in range(tiles)}
    return {tile: rank for tile, rank in found.items() if rank < rows}


def _counted(held: DataFrame, searches: list[_Search], buckets: int) -> None:
    """How many rows are in each bucket of each search: one pass over the columns of each measure.

    A row is in one search of a measure at most, since those have different values or intervals.
    """
    width = buckets + 1
    passes = []
    for measure in {search.measure: None for search in searches}:
        places = [
            F.lit(i * width + 1) + search.bucket(buckets)
            for i, search in enumerate(searches)
            if search.measure == measure
        ]
        place = F.coalesce(*places).alias("place")
        passes.append(held.select(place).filter("place is not null").groupBy("place").count())
    # At most ``buckets`` rows, and one for NULLs, per tile and measure, whatever the input.
    for row in reduce(DataFrame.unionAll, passes).collect():
        search, place = divmod(row["place"], width)
        searches[search].counts[place - 1] = row["count"]


def _narrowed(search: _Search, buckets: int, keys: tuple) -> tuple[list, dict]:
    """Searches in the buckets that hold a wanted rank, and the tile starts that are settled."""
    shift = search.shift(buckets)
    numbers = sorted(search.counts)
    ends = list(accumulate((search.counts[b] for b in numbers), initial=search.before))
    inside: dict[int, dict] = {}
    for tile, rank in search.ranks.items():
        inside.setdefault(bisect_right(ends, rank) - 1, {})[tile] = rank
    more, settled = [], {}
    for place, ranks in inside.items():
        number, before = numbers[place], ends[place]
        if number == NULLS:
            low = high = None
        else:
            number += search.low >> shift
            low = max(search.low, number << shift)
            high = min(search.high, (number + 1 << shift) - 1)
        if low != high:
            more.append(_Search(search.measure, search.column, low, high, before, ranks, search.tied))
        elif search.tied:
            settled |= {tile: (search.tied[0], low) for tile in ranks}
        else:
            key, least, most = keys
            more.append(_Search(search.measure, key, least, most, before, ranks, (low,), True))
    return more, settled


def tile_starts(
    held: DataFrame, key: str, measures: list[str], tiles: int, buckets: int = 1 << 12
) -> dict[str, dict[int, tuple]]:
    """Per measure: tile -> (value, key) of the row it starts with. Runs a few jobs.

    Rows are ordered by (measure, key), NULLs first. Each pass counts rows per bucket of high bits and
    goes on only in the buckets that hold a tile's start; once a single value is left, its ties are
    searched by key in the same way. Every pass adds 12 bits, so values and keys of b bits take
    b / 12 passes each, in which only what is inside those buckets is looked up. Counts are combined in
    the map tasks, and only they are collected.
    """
    bounds = [F.min(name).alias(f"least_{i}") for i, name in enumerate([key, *measures])]
    bounds += [F.max(name).alias(f"most_{i}") for i, name in enumerate([key, *measures])]
    known = held.agg(F.count("*").alias("rows"), *bounds).first()
    ranks = _starts(known["rows"], tiles)
    limits = [(known[f"least_{i}"] or 0, known[f"most_{i}"] or 0) for i in range(len(measures) + 1)]
    keys = (key, *limits[0])
    searches = [
        _Search(name, name, *limit, 0, ranks, nulls=True)
        for name, limit in zip(measures, limits[1:], strict=True)
        if ranks
    ]
    found: dict[str, dict[int, tuple]] = {name: {} for name in measures}
    while searches:
        _counted(held, searches, buckets)
        following = []
        for search in searches:
            more, settled = _narrowed(search, buckets, keys)
            following += more
            found[search.measure] |= settled
        searches = following
    return found


def rank_tiles(
    rows: DataFrame, key: str, measures: list[str], tiles: int = 5, folder: str | None = None
) -> DataFrame:
    """Per measure, ntile over (measure ascending, NULLs first, then key ascending).

    ``rows`` holds one row per ``key``, an integer, and integer measures. The result has the key and,
    per measure ``m``, the columns ``m`` and ``m_tile``.

    Nothing is sorted. The rows that tiles start with are found by counting (see ``tile_starts``); the
    tile of a row is the number of starts it does not precede, so scoring is one projection over
    ``rows`` with the starts as literals.

    Calling this runs jobs. Rows are stored, so that what they come from is computed once, as a
    Parquet table in ``folder``, by default a fresh one in the shared folder; the result reads it, so
    whoever gives the folder deletes it when the result has been used.
    """
    kind = rows.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{key} is no integer column")
    folder = f"{folder or fresh_folder(rows.sparkSession, 'tiles')}/rows"
    narrow = rows.select(key, *[F.col(name).cast("bigint").alias(name) for name in measures])
    narrow.write.parquet(folder)
    held = rows.sparkSession.read.schema(narrow.schema).parquet(folder)
    starts = tile_starts(held, key, measures, tiles)

    def tile_of(name: str) -> Column:
        # Structs compare field by field with NULL as the smallest, which is the order of tiles.
        row = F.struct(F.col(f"`{name}`").alias("value"), F.col(f"`{key}`").alias("key"))
        reached = F.lit(0)
        for value, first in starts[name].values():
            start = F.struct(F.lit(value).cast("bigint").alias("value"), F.lit(first).cast(kind).alias("key"))
            reached += F.when(row >= start, 1).otherwise(0)
        return reached.alias(f"{name}_tile")

    return held.select(key, *[F.col(f"`{name}`") for name in measures], *map(tile_of, measures))
