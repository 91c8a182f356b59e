"""Interleaving sources at target weights by Pfair scheduling of their blocks (operator 4)."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.llm.common import Steps, batch
from strataline.settings import ship

# Documents of a block, and the exponent that turns the sizes of sources into target weights.
BLOCK = 16
POWER = 0.7
# Longest period, in slots, that is scheduled once and repeated.
MOST_PERIOD = 1 << 16
# Slots that the scheduling task hands on at once.
SLOT_ROWS = 1 << 15
# Sources are a short list on the driver; more than this is an error.
MOST_SOURCES = 10_000


def period_shares(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Least whole numbers in exactly the ratio of the positive weights, as their decimals are written."""
    exact = {s: Fraction(str(w)) for s, w in weights.items() if w > 0}
    unit = lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * unit) for s, w in exact.items()}
    return {s: n // gcd(*whole.values()) for s, n in whole.items()}


def pfair_slots(shares: Sequence[int]) -> Iterator[tuple[int, int]]:
    """(number of the source, its block), slot by slot without end, by earliest deadline first.

    Block j of a source with c of D slots is released at slot floor(j D / c) and due before
    ceil((j + 1) D / c). On one line of slots with shares that add up to D every block meets its deadline,
    so at any slot a source has had less than one block more or less than its share.
    """
    period = sum(shares)
    waiting = [(0, i, 0) for i in range(len(shares))]
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[i]), i, j))
        due, i, j = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a block missed its deadline")
        yield i, j
        heapq.heappush(waiting, ((j + 1) * period // shares[i], i, j + 1))
        slot += 1


def _names(shares: Mapping[str | None, int]) -> list[str | None]:
    return sorted(shares, key=lambda s: (s is None, s or ""))


def pfair_period(shares: Mapping[str | None, int]) -> list[tuple[str | None, int, int]]:
    """(source, block of the period, slot). All sources are even at the end of the period, so it repeats."""
    names, period = _names(shares), sum(shares.values())
    return [(names[i], j, slot) for slot, (i, j) in enumerate(islice(pfair_slots([shares[s] for s in names]), period))]


def _whole_order(spark: SparkSession, shares: list[int], blocks: list[int]) -> DataFrame:
    """(whose, j, at) of every slot until each source has had its blocks.

    Each slot depends on the one before, so one task goes through them; it holds a few numbers per source.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            at, through, line = 0, 0, pfair_slots(shares)
            while through < len(blocks):
                whose, turns = [], []
                while through < len(blocks) and len(whose) < SLOT_ROWS:
                    i, j = next(line)
                    whose.append(i)
                    turns.append(j)
                    through += j + 1 == blocks[i]
                yield batch(whose=np.array(whose, np.int64), j=np.array(turns, np.int64), at=np.arange(at, at + len(whose), dtype=np.int64))
                at += len(whose)

    return spark.range(0, 1, 1, 1).mapInArrow(run, "whose long, j long, at long")


def _numbered(rows: DataFrame, steps: Steps) -> DataFrame:
    """(id, source, rank): rank from 0 within the source, in the order of a hash of the id.

    Rows are cut into ranges of source and hash of about equal size and written once; each range numbers
    its own rows and adds what lies before it, so a source of any size is spread over many tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = rows.withColumn("code", F.xxhash64("id"))
    ranged = steps.keep(mixed.repartitionByRange(parts, "source", "code", "id").withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("source", "part")
        .count()
        .select(F.col("source").alias("of"), "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("part", "source").orderBy("code", "id")
    local = ranged.withColumn("nth", F.row_number().over(inside) - 1).withColumnRenamed("part", "own_part")
    return local.join(offsets, (F.col("own_part") == F.col("part")) & F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "source", (F.col("before") + F.col("nth")).alias("rank")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Mapping[str | None, float] | None = None,
    power: float = POWER,
    block: int = BLOCK,
) -> DataFrame:
    """A training order: id, source, epoch, slot, position (ascending; slots hold ``block`` places).

    Each source's documents, in the order of a hash of their ids, are cut into blocks. Target weights are
    given, or the sizes of the sources to the power ``power``. The order runs until every document of every
    source of positive weight has appeared; a source that is through before begins its next epoch. In every
    prefix of slots, however long, each source has less than one block more or less than its weight asks for.
    A period of at most ``MOST_PERIOD`` slots is scheduled once and repeated, else the whole order is
    scheduled by one task.

    Sources are counted on the cluster and listed on the driver (an error beyond ``MOST_SOURCES``). A null
    source is a source of its own; without weights for all sources there is an error, weight 0 leaves a
    source out. Rows that repeat id and source are one document, null ids too. Other columns are ignored;
    an empty table gives an empty order.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "mixing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source")).distinct()
    counts = {r.source: r["count"] for r in rows.groupBy("source").count().limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if weights is None:
        weights = {s: n**power for s, n in counts.items()}
    elif counts.keys() - weights.keys():
        raise ValueError(f"no weight for {sorted(map(str, counts.keys() - weights.keys()))[:5]}")
    shares = period_shares({s: weights[s] for s in counts})
    period = sum(shares.values())
    names = _names(shares)
    blocks = {s: -(-counts[s] // block) for s in names}
    if period <= MOST_PERIOD:
        line = pfair_period(shares)
        own_slots: dict[str | None, list[int]] = {s: [] for s in names}
        for name, _, slot in line:
            own_slots[name].append(slot)
        # The order ends with the slot in which the last source to come round has its last block.
        end = max(((blocks[s] - 1) // shares[s] * period + own_slots[s][(blocks[s] - 1) % shares[s]] + 1 for s in names), default=0)
        turns = {s: end // period * shares[s] + bisect_left(own_slots[s], end % period) for s in names}
        number = {s: i for i, s in enumerate(names)}
        slots = spark.createDataFrame([(number[s], j, slot) for s, j, slot in line], "whose long, j long, at long")
    else:
        slots = steps.keep(_whole_order(spark, [shares[s] for s in names], [blocks[s] for s in names]))
        had = {r.whose: r["count"] for r in slots.groupBy("whose").count().collect()}
        turns = {s: had[i] for i, s in enumerate(names)}
        shares, period = turns, sum(turns.values())  # the order is one period
    plan = spark.createDataFrame(
        [(s, i, shares[s], blocks[s], turns[s]) for i, s in enumerate(names)],
        T.StructType([T.StructField("of", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("number", "share", "blocks", "turns"))]),
    )
    turn = (
        _numbered(rows, steps)
        .join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("own", F.floor(F.col("rank") / block))
        .withColumn("epoch", F.explode(F.expr("sequence(0L, (turns - 1 - own) div blocks)")))
        .withColumn("turn", F.col("own") + F.col("epoch") * F.col("blocks"))
    )
    return (
        turn.join(slots, (F.col("number") == F.col("whose")) & (F.pmod("turn", F.col("share")) == F.col("j")))
        .withColumn("slot", F.floor(F.col("turn") / F.col("share")) * period + F.col("at"))
        .select(
            F.col("id").alias(id_col),
            F.col("source").alias(source_col),
            "epoch",
            "slot",
            (F.col("slot") * block + F.pmod("rank", F.lit(block))).alias("position"),
        )
    )
