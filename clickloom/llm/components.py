"""Connected components of a graph given as edges, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.text import stored


def _with_least(neighbours: DataFrame) -> DataFrame:
    """(node, other, least): least is the smallest of a node and its listed neighbours."""
    least = neighbours.groupBy("node").agg(F.min("other").alias("least"))
    return neighbours.join(least, "node").withColumn("least", F.least("node", "least"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "other"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reached.

    ``edges`` has columns node and other of one orderable type. Large-star and small-star steps
    alternate until nothing changes, in about log(nodes) rounds; each round is stored in the
    shared folder. Least neighbours are aggregated before the shuffle, and a hub's join may be
    split by Spark.
    """
    edges = stored(
        edges.select(F.greatest("node", "other"), F.least("node", "other"))
        .toDF("node", "other")
        .filter("node != other")
        .distinct(),
        "edges",
    )
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.selectExpr("other as node", "node as other"))
        large = (
            _with_least(both)
            .filter("other > node")
            .selectExpr("other as node", "least as other")
            .distinct()
        )
        starred = _with_least(large)
        small = starred.selectExpr("other as node", "least as other").unionByName(
            starred.selectExpr("node", "least as other")
        )
        edges = stored(small.filter("node != other").distinct(), "edges")
    leaves = edges.selectExpr("node", "other as component")
    return leaves.unionByName(edges.selectExpr("other as node", "other as component").distinct())
