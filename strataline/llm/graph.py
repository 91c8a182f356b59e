"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import Steps, batch

# Up to so many links are contracted by one task, in a few megabytes; more take the rounds over all tasks.
FEW = 300_000


def _contract_few(links: DataFrame) -> DataFrame:
    """(node, component) of a counted, small number of links."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches):
        least: dict = {}
        own = None

        def root(x):
            while least[x] != x:
                least[x] = least[least[x]]
                x = least[x]
            return x

        for piece in batches:
            own = piece.column("a").type
            for a, b in zip(piece.column("a").to_pylist(), piece.column("b").to_pylist(), strict=True):
                least.setdefault(a, a)
                least.setdefault(b, b)
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
        if least:
            nodes = list(least)
            yield batch(node=pa.array(nodes, own), component=pa.array([root(x) for x in nodes], own))

    return links.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _state(edges: DataFrame) -> tuple[int, int]:
    n, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, int(total or 0)


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the least node reachable.

    Each round points the larger neighbours of every node, then the smaller ones and itself, at the least
    neighbour. Both use a partial minimum per node and a join, so a node with very many links is never
    gathered. Rounds go on until every component is a star; their number grows with the logarithm of its size.
    At most ``FEW`` links, a number that is counted first, are contracted by one task instead.
    """
    now = steps.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(now)
    if state[0] <= FEW:
        return _contract_few(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        found = steps.keep(small)
        steps.drop(now)
        before, state, now = state, _state(found), found
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
