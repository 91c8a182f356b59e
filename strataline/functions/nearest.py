"""Exact k nearest points.

In up to three dimensions points and probes are dealt into the leaves of a tree of nested cells, each with few of
both. A leaf's own points bound the distance that its probes look; a leaf then receives the points of other leaves
within that bound, once for all its probes, and compares them as arrays. Probes whose series owns most of a leaf, and
those with fewer than ``k`` usable points in theirs, look apart from the others: their own points are not sent to them,
and corners of cells (below) bound what they look at.

In more dimensions, or where points must agree on other columns, every probe descends by itself through nested cells.
The box around all points is halved along every axis from level to level; the finest level is the first at
which no cell holds many points. Every probe starts with the whole box and goes down: its cells are replaced
by their children that hold points it may have. The farthest corners of its cells, taken in order, tell how
far it is at most to its k-th point; cells that begin beyond that are dropped. What is left at the finest
level holds the answer and little else. In more than three dimensions corners say little, so a probe first takes
real distances to some points of its own cell, at a level where cells hold several: any ``k`` points bound the k-th.
Points of the probe's own series cost nothing, however dense; along a dense line at some distance the points met grow with the root of its density.

Points at exactly the same place are thinned first to those that can be an answer at all: with the order at
equal distance fixed, the first k of a place, and with "not from the same series" the first k of each of its
first k+1 series. Points closer together than the box's side over 2^MAX_LEVEL share a cell, however many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.functions.series import largest_group, spread_join
from strataline.functions.stream import by_group, joined
from strataline.settings import checkpoint

# Points a cell of the finest level may hold; in more than CORNERS dimensions a ball meets many cells, so they are smaller.
CELL_POINTS, SMALL_CELL = 8, 2
# Points per cell that bound a probe's distance, as a multiple of k, in more than CORNERS dimensions.
SEEDS, CORNERS = 8, 3
MAX_LEVEL = 40
# Levels that one histogram of the points covers.
SPAN = 20
# Points, and probes, that a leaf may hold in up to CORNERS dimensions; distances that a task holds at once.
LEAF_ROWS, DISTANCES = 1024, 2**20


def _thin(points: DataFrame, place: Sequence[str], k: int, tie: str, owned: bool) -> DataFrame:
    if not owned:
        first = Window.partitionBy(*place).orderBy(tie)
        return points.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")
    own = Window.partitionBy(*place, "_owner").orderBy(tie)
    few = points.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= k)
    leaders = few.where(F.col("_r") == 1).withColumn("_q", F.row_number().over(Window.partitionBy(*place).orderBy(tie)))
    kept = leaders.where(F.col("_q") <= k + 1).select(*place, "_owner")
    return few.join(kept, [*place, "_owner"], "left_semi").drop("_r")


def _cells(coords: Sequence[str], low: Sequence[float], width: float, grid: Sequence[str]) -> list[Column]:
    return [F.floor((F.col(c) - F.lit(o)) / F.lit(width)).alias(g) for c, o, g in zip(coords, low, grid)]


def _coarser(grid: Sequence[str], steps: int, names: Sequence[str]) -> list[Column]:
    return [F.shiftright(g, steps).alias(n) for g, n in zip(grid, names)]


def _levels(points: DataFrame, by: Sequence[str], coords: Sequence[str], low: Sequence[float], side: float, step: int, seeds: int) -> tuple[int, int]:
    """First level, in steps, at which no cell holds more than the wanted points, and the last at which a point's cell
    holds ``seeds`` on average; one histogram for ``SPAN`` levels."""
    grid = [f"_g{i}" for i in range(len(coords))]
    seeded, wanted = 0, SMALL_CELL if len(coords) > CORNERS else CELL_POINTS
    for start in range(0, MAX_LEVEL, SPAN):
        bottom = start + SPAN
        levels = list(range(start, bottom + 1, step))
        cells = points.select(*by, *_cells(coords, low, side / 2**bottom, grid)).groupBy(*by, *grid).agg(F.count(F.lit(1)).alias("n"))
        spread = cells.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
        coarse = [F.expr(f"shiftright({g}, {bottom} - level)").alias(g) for g in grid]
        full = spread.select(*by, "level", *coarse, "n").groupBy(*by, "level", *grid).agg(F.sum("n").alias("n")).groupBy("level")
        found = full.agg(F.max("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("met")).collect()
        seeded = max([seeded, *(r.level for r in found if r.met >= seeds)])
        fits = [r.level for r in found if r.n <= wanted]
        if fits:
            return min(fits), min(seeded, min(fits))
    return MAX_LEVEL, seeded


def _seed_bounds(
    asked: DataFrame, known: DataFrame, by: Sequence[str], coords: Sequence[str], grid: Sequence[str], cells: list[Column], steps: int, k: int, ids: Sequence[str], rows: int
) -> DataFrame:
    """Per probe the k-th least distance to some points of its cell, where there are k: at most ``SEEDS`` times k of a cell are met."""
    coarse = known.select("*", *_coarser(grid, steps, [f"_s{g}" for g in grid]))
    place = [*by, *[f"_s{g}" for g in grid]]
    few = Window.partitionBy(*place).orderBy(F.xxhash64(*coords), *coords)
    some = coarse.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= SEEDS * k)
    some = some.select(*place, *[F.col(c).alias(f"_to{c}") for c in coords], *[c for c in known.columns if c == "_owner"])
    mine = asked.select("*", *cells).select("*", *_coarser(grid, steps, [f"_s{g}" for g in grid])).drop(*grid)
    met = spread_join(mine, some, place, ids, size=rows)
    if "_owner" in known.columns:
        met = met.where(~F.col("_mine").eqNullSafe(F.col("_owner")))
    square = reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.col(f"_to{c}"), 2) for c in coords])
    kept = F.get(F.array_sort(F.collect_list(square)), F.lit(k - 1))
    return met.groupBy(*ids).agg((kept * (1 + 1e-9)).alias("_seed"))


def _corner(coords: Sequence[str], grid: Sequence[str], low: Sequence[float], width: float, slack: float) -> tuple[Column, Column]:
    """Squared distances from the probe to the nearest and the farthest corner of a cell."""
    near, far = F.lit(0.0), F.lit(0.0)
    for c, g, o in zip(coords, grid, low):
        begin = F.lit(o) + F.col(g) * F.lit(width)
        before, after = begin - F.col(c), F.col(c) - begin - F.lit(width)
        gap = F.greatest(before - slack, after - slack, F.lit(0.0))
        reach = F.greatest(F.abs(begin - F.col(c)), F.abs(begin + F.lit(width) - F.col(c))) + slack
        near, far = near + gap * gap, far + reach * reach
    return near, far


def nearest_points(
    probes: DataFrame,
    points: DataFrame,
    dims: Sequence[str],
    k: int,
    *,
    ids: Sequence[str],
    tie: str,
    by: Sequence[str] = (),
    differ: tuple[str, str] | None = None,
    payload: Sequence[str] = (),
    scale: Sequence[float] | None = None,
) -> DataFrame:
    """The ``k`` nearest points of each probe: ``(ids, rank, distance, payload)``.

    ``by``: only points with equal values there. ``differ``: ``(probe column, point column)`` that
    must not be equal (a series does not see itself). ``scale`` divides the coordinates. ``tie``
    orders points at equal distance. Fewer than ``k`` rows mean that no more points exist.
    """
    ids = list(ids)
    if not by and len(dims) <= CORNERS:
        asked, known, coords = _ready(probes, points, dims, k, ids, tie, by, differ, payload, scale)
        if largest_group(asked, ids)[0] <= 1:
            return _nearest_in_leaves(asked, known, coords, k, ids, tie, payload)
        # Probes that share their ids are one probe: the k nearest to any of them.
        counted = checkpoint(asked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*ids))))
        once, shared = (_nearest_in_leaves(counted.where(c).drop("_n"), known, coords, k, ids, tie, p) for c, p in (("_n = 1", payload), ("_n > 1", dict.fromkeys([*payload, tie]))))
        ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy(*ids).orderBy("distance", tie))).where(F.col("rank") <= k)
        return once.unionByName(ranked.select(*once.columns))
    found, coords = candidates(probes, points, dims, k, ids=ids, tie=tie, by=by, differ=differ, payload=payload, scale=scale)
    square = reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.col(f"_to{c}"), 2) for c in coords])
    order = Window.partitionBy(*ids).orderBy("_d", f"_a_{tie}")
    return (
        found.withColumn("_d", F.sqrt(square))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(*ids, "rank", F.col("_d").alias("distance"), *[F.col(f"_a_{p}").alias(p) for p in payload])
    )


def _ready(probes, points, dims, k, ids, tie, by, differ, payload, scale) -> tuple[DataFrame, DataFrame, list[str]]:
    """Probes and thinned points that have a place, written, with scaled coordinates; and the coordinates' names."""
    factors = list(scale or [1.0] * len(dims))
    coords = [f"_c{i}" for i in range(len(dims))]
    scaled = [(F.col(d).cast("double") / F.lit(float(s))).alias(c) for d, s, c in zip(dims, factors, coords)]
    placed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in coords])
    extra = [F.col(differ[0]).alias("_mine")] if differ else []
    asked = checkpoint(probes.select(*dict.fromkeys([*ids, *by]), *extra, *scaled).where(placed))
    answers = [F.col(p).alias(f"_a_{p}") for p in dict.fromkeys([*payload, tie])]
    owner = [F.col(differ[1]).alias("_owner")] if differ else []
    known = checkpoint(_thin(points.select(*by, *scaled, *answers, *owner).where(placed), [*by, *coords], k, f"_a_{tie}", bool(differ)))
    return asked, known, coords


def candidates(
    probes: DataFrame,
    points: DataFrame,
    dims: Sequence[str],
    k: int,
    *,
    ids: Sequence[str],
    tie: str,
    by: Sequence[str] = (),
    differ: tuple[str, str] | None = None,
    payload: Sequence[str] = (),
    scale: Sequence[float] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Pairs of a probe and a point of its cells at the finest level, among them its k nearest; and the coordinates' names."""
    ids, by = list(ids), list(by)
    asked, known, coords = _ready(probes, points, dims, k, ids, tie, by, differ, payload, scale)
    grid, parent = [f"_g{i}" for i in range(len(dims))], [f"_p{i}" for i in range(len(dims))]
    low, side, rows = _box(known, asked, coords)
    base = (side or 1.0) * (1 + 1e-9)
    slack = base * 1e-9
    step = 2 if len(dims) <= 3 else 1
    finest, seeded = _levels(known, by, coords, low, base, step, 2 * k) if side else (0, 0)
    known = known.select("*", *_cells(coords, low, base / 2**finest, grid))
    carried = [*dict.fromkeys([*ids, *by]), *(["_mine"] if differ else []), *coords]
    whole = Window.partitionBy(*ids)
    seeds = len(dims) > CORNERS and finest > 0
    if seeds:
        bounds = _seed_bounds(asked, known, by, coords, grid, _cells(coords, low, base / 2**finest, grid), finest - seeded, k, ids, rows)
        asked = checkpoint(asked.join(bounds, ids, "left"))
        carried = [*carried, "_seed"]
    frontier = asked.select(*carried, *[F.lit(0).cast("long").alias(g) for g in grid])
    for level in range(0, finest, step):
        below = min(level + step, finest)
        cells = known.select(*by, *(["_owner"] if differ else []), *_coarser(grid, finest - level, parent), *_coarser(grid, finest - below, [f"_n{g}" for g in grid]))
        cells = cells.select("*", *[F.col(f"_n{g}").alias(g) for g in grid]).drop(*[f"_n{g}" for g in grid])
        children = cells.groupBy(*by, *parent, *grid).agg(F.count(F.lit(1)).alias("_n"))
        here = frontier.select(*carried, *[F.col(g).alias(p) for g, p in zip(grid, parent)])
        if level or by:
            down = spread_join(here, children, [*by, *parent], ids, size=rows).drop(*parent)
        else:
            # The root has one cell per corner and step, 64 at most: every probe meets them all.
            down = here.drop(*parent).crossJoin(F.broadcast(children.drop(*parent)))
        if differ:
            own = cells.groupBy(*by, "_owner", *grid).agg(F.count(F.lit(1)).alias("_own"))
            own = own.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, *grid]], "_owner", "_own")
            same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in [*by, *grid]])
            down = down.join(own, same & F.col("_mine").eqNullSafe(F.col("_owner")), "left")
            down = down.withColumn("_n", F.col("_n") - F.coalesce("_own", F.lit(0))).where("_n > 0")
        near, far = _corner(coords, grid, low, base / 2**below, slack)
        upto = F.sum("_n").over(whole.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0))
        met = down.withColumns({"_near": near, "_far": far}).withColumn("_reach", F.when(upto >= k, F.col("_far")))
        bound = F.least(F.min("_reach").over(whole), "_seed") if seeds else F.min("_reach").over(whole)
        frontier = met.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound"))).select(*carried, *grid)
    spots = known.select(*by, *grid, *[F.col(c).alias(f"_to{c}") for c in coords], *[c for c in known.columns if c.startswith("_a_") or c == "_owner"])
    found = spread_join(frontier, spots, [*by, *grid], ids, size=rows)
    if differ:
        found = found.where(~F.col("_mine").eqNullSafe(F.col("_owner")))
    return found, coords


def _box(known: DataFrame, asked: DataFrame, coords: Sequence[str]) -> tuple[list[float], float, int]:
    """Lower corner and longest side of the box around points and probes, and the number of probes."""
    both = known.select(*coords, F.lit(0).alias("_p")).unionByName(asked.select(*coords, F.lit(1).alias("_p")))
    ends = both.agg(*[F.min(c) for c in coords], *[F.max(c) for c in coords], F.sum("_p")).first()
    n = len(coords)
    low = [v if v is not None else 0.0 for v in ends[:n]]
    high = [v if v is not None else 0.0 for v in ends[n : 2 * n]]
    return low, max(h - o for o, h in zip(low, high)), ends[2 * n] or 0


def _splits(known: DataFrame, asked: DataFrame, coords: Sequence[str], grid: Sequence[str], step: int) -> list[DataFrame]:
    """Cells to be split, level by level: more points or probes than a leaf may hold, and not all at one place."""
    rows = known.select(*coords, *grid, F.lit(0).alias("_kind")).unionByName(asked.select(*coords, *grid, F.lit(1).alias("_kind")))
    splits: list[DataFrame] = []
    for level in range(0, MAX_LEVEL, step):
        here = rows
        if splits:
            # A cell is split only if all around it are, so the last level's cells say which rows are left.
            above = splits[-1].select(*[F.col(g).alias(f"_s{g}") for g in grid])
            same = reduce(lambda a, b: a & b, [F.shiftright(g, MAX_LEVEL - level + step) == F.col(f"_s{g}") for g in grid])
            here = rows.join(F.broadcast(above), same, "left_semi")
        counted = here.select("_kind", *coords, *_coarser(grid, MAX_LEVEL - level, grid)).groupBy(*grid).agg(
            F.sum("_kind").alias("_probes"), F.count(F.lit(1)).alias("_rows"), F.max(F.struct(*coords)).alias("_to"), F.min(F.struct(*coords)).alias("_from")
        )
        many = F.greatest(F.col("_probes"), F.col("_rows") - F.col("_probes")) > LEAF_ROWS
        heavy = checkpoint(counted.where(many & (F.col("_from") != F.col("_to"))).select(*grid))
        if heavy.isEmpty():
            break
        splits.append(heavy)
    return splits


def _in_leaves(rows: DataFrame, splits: Sequence[DataFrame], grid: Sequence[str], step: int) -> DataFrame:
    """Level and cell of each row's leaf, as ``_l`` and the grid columns."""
    depth = F.lit(0)
    for i, split in enumerate(splits):
        own = split.select(*[F.col(g).alias(f"_s{i}{g}") for g in grid], F.lit(step).alias(f"_d{i}"))
        same = reduce(lambda a, b: a & b, [F.shiftright(g, MAX_LEVEL - i * step) == F.col(f"_s{i}{g}") for g in grid])
        rows = rows.join(F.broadcast(own), same, "left").drop(*[f"_s{i}{g}" for g in grid])
        depth = depth + F.coalesce(F.col(f"_d{i}"), F.lit(0))
    rows = rows.withColumn("_l", depth).drop(*[f"_d{i}" for i in range(len(splits))])
    return rows.withColumns({g: F.expr(f"shiftright({g}, {MAX_LEVEL} - _l)") for g in grid})


def _gap(begin: Column, width: Column, other: Column, wide: Column | float, slack: float) -> Column:
    """Between two intervals, 0 where they meet."""
    return F.greatest(other - begin - width - slack, begin - other - wide - slack, F.lit(0.0))


def _codes(arrays: Sequence[pa.Array]) -> np.ndarray:
    """Equal numbers for equal values, null among them."""
    whole = arrays[0] if len(arrays) == 1 else pa.concat_arrays(arrays)
    return pc.dictionary_encode(whole, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _stack(batch: pa.RecordBatch, coords: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in coords])


def _distance_blocks(asked: np.ndarray, spots: np.ndarray, mine: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of some probes at a time to all points, infinite to points of the probe's own series."""
    size = max(1, DISTANCES // max(len(spots), 1))
    for first in range(0, len(asked), size):
        some = asked[first : first + size]
        square = sum((some[:, i][:, None] - spots[:, i]) ** 2 for i in range(asked.shape[1]))
        yield first, np.where(mine[first : first + size][:, None] == own, np.inf, np.sqrt(square))


def _radii(place: Sequence[str], coords: Sequence[str], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per leaf and kind of probe the largest k-th distance to the leaf's points, none where a probe has fewer than k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shared, piece in by_group(batches, place, "_kind"):
            n = shared[0].num_rows if shared else 0
            codes = _codes([b.column("_who") for b in [*shared, piece]])
            own, mine = codes[:n], codes[n:]
            counts = np.bincount(own, minlength=codes.max() + 1)
            enough = n - counts[mine] >= k
            apart = ~enough | ((2 * counts > n)[mine])
            far = np.full(len(mine), np.nan)
            if enough.any():
                spots, asked = _stack(shared[0], coords), _stack(piece, coords)
                for first, distance in _distance_blocks(asked, spots, mine, own):
                    far[first : first + len(distance)] = np.partition(distance, k - 1, axis=1)[:, k - 1]
                far[~enough] = np.nan
            who, at = np.unique(mine[apart], return_index=True)
            at = np.flatnonzero(apart)[at]
            radius = [far[mine == w].max() if enough[a] else None for w, a in zip(who, at, strict=True)]
            classes, rest = [int(a) for a in at], [False] * len(at)
            if not apart.all():
                classes, rest, radius = [*classes, None], [*rest, True], [*radius, far[~apart].max()]
            none = pa.array(np.zeros(len(rest), np.int64))
            columns = [piece.column(c).take(none) for c in place]
            columns += [pa.array(rest), piece.column("_who").take(pa.array(classes, pa.int64())), pa.array(radius, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*place, "_rest", "_class", "_radius"])

    return run


def _best(
    group: Sequence[str], coords: Sequence[str], k: int, ids: Sequence[str], payload: Sequence[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k nearest of the points that a group of probes received, which come in the order that decides at equal distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []
        for shared, piece in by_group(batches, group, "_kind"):
            if not shared:
                continue
            n = shared[0].num_rows
            codes = _codes([shared[0].column("_who"), piece.column("_who")])
            spots, asked = _stack(shared[0], coords), _stack(piece, coords)
            for first, distance in _distance_blocks(asked, spots, codes[n:], codes[:n]):
                last = np.partition(distance, k - 1, axis=1)[:, k - 1 : k] if n > k else np.inf
                probe, point = np.nonzero((distance <= last) & np.isfinite(distance))
                order = np.lexsort((distance[probe, point], probe))
                probe, point = probe[order], point[order]
                rank = np.arange(len(probe)) - np.searchsorted(probe, probe)
                probe, point, rank = (v[rank < k] for v in (probe, point, rank))
                asker, answer = pa.array(first + probe), pa.array(point)
                columns = [piece.column(f"_i_{c}").take(asker) for c in ids]
                columns += [pa.array((rank + 1).astype(np.int32)), pa.array(distance[probe, point])]
                columns += [shared[0].column(f"_a_{c}").take(answer) for c in payload]
                ready.append(pa.RecordBatch.from_arrays(columns, names=[*ids, "rank", "distance", *payload]))
                if sum(b.num_rows for b in ready[-64:]) >= 10_000 or len(ready) >= 64:
                    yield joined(ready)
                    ready = []
        if ready:
            yield joined(ready)

    return run


def _nearest_in_leaves(asked: DataFrame, known: DataFrame, coords: list[str], k: int, ids: list[str], tie: str, payload: Iterable[str]) -> DataFrame:
    payload = list(payload)
    low, side, _ = _box(known, asked, coords)
    base = (side or 1.0) * (1 + 1e-9)
    slack, step = base * 1e-9, 2
    grid = [f"_g{i}" for i in range(len(coords))]
    place = ["_l", *grid]
    if "_owner" not in known.columns:
        asked, known = asked.withColumn("_mine", F.lit(0)), known.withColumn("_owner", F.lit(1))
    elif asked.schema["_mine"].dataType != known.schema["_owner"].dataType:
        asked, known = asked.withColumn("_mine", F.col("_mine").cast("string")), known.withColumn("_owner", F.col("_owner").cast("string"))
    kind = known.schema["_owner"].dataType
    fine = _cells(coords, low, base / 2**MAX_LEVEL, grid)
    asked, known = asked.select("*", *fine), known.select("*", *fine)
    splits = _splits(known, asked, coords, grid, step)
    asked, known = _in_leaves(asked, splits, grid, step), _in_leaves(known, splits, grid, step)

    # How far the probes of a leaf look, by its own points.
    points = known.select(*place, F.lit(0).alias("_kind"), *coords, F.col("_owner").alias("_who"))
    probes = asked.select(*place, F.lit(1).alias("_kind"), *coords, F.col("_mine").alias("_who"))
    sorted_rows = points.unionByName(probes).repartition(*place).sortWithinPartitions(*place, "_kind")
    longs = [T.StructField(c, T.IntegerType() if c == "_l" else T.LongType()) for c in place]
    schema = T.StructType([*longs, T.StructField("_rest", T.BooleanType()), T.StructField("_class", kind), T.StructField("_radius", T.DoubleType())])
    found = sorted_rows.mapInArrow(_radii(place, coords, k), schema)
    group = [*place, "_rest", "_class"]
    units = checkpoint(found.groupBy(*group).agg(F.max("_radius").alias("_radius")))

    # The leaves within that distance, from the whole box down.
    pairs = _leaves_met(units, known, len(splits) * step, grid, low, base, slack, step, k)
    width = F.lit(base) * F.pow(F.lit(2.0), -F.col("_u_l"))
    apart = [_gap(F.lit(o) + F.col(f"_u{g}") * width, width, F.col(c), 0.0, slack) for c, g, o in zip(coords, grid, low)]
    near = reduce(lambda a, b: a + b, [v * v for v in apart])
    wanted = (F.col("_limit").isNull() | (near <= F.col("_limit"))) & (F.col("_rest") | ~F.col("_owner").eqNullSafe(F.col("_class")))
    sent = known.join(pairs, place).where(wanted).select(
        F.col("_u_l").alias("_l"), *[F.col(f"_u{g}").alias(g) for g in grid], "_rest", "_class", F.lit(0).alias("_kind"), *coords,
        F.col("_owner").alias("_who"), F.col(f"_a_{tie}").alias("_tie"), *[f"_a_{p}" for p in payload],
    )
    alone = units.where(~F.col("_rest")).select(*[F.col(c).alias(f"_u{c}") for c in place], F.col("_class"), F.lit(True).alias("_apart"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_u{c}") for c in place])
    askers = asked.join(alone, same & F.col("_mine").eqNullSafe(F.col("_class")), "left").select(
        *place, F.col("_apart").isNull().alias("_rest"), F.when(F.col("_apart"), F.col("_mine")).alias("_class"), F.lit(1).alias("_kind"),
        *coords, F.col("_mine").alias("_who"), *[F.col(c).alias(f"_i_{c}") for c in ids],
    )
    rows = sent.unionByName(askers, allowMissingColumns=True).repartition(*group).sortWithinPartitions(*group, "_kind", "_tie").drop("_tie")
    kinds = {f.name: f for f in asked.schema.fields}
    answers = {f.name: f for f in known.schema.fields}
    schema = T.StructType(
        [T.StructField(c, kinds[c].dataType, True, kinds[c].metadata) for c in ids]
        + [T.StructField("rank", T.IntegerType()), T.StructField("distance", T.DoubleType())]
        + [T.StructField(p, answers[f"_a_{p}"].dataType) for p in payload]
    )
    return rows.mapInArrow(_best(group, coords, k, ids, payload), schema)


def _leaves_met(
    units: DataFrame, known: DataFrame, depth: int, grid: Sequence[str], low: Sequence[float], base: float, slack: float, step: int, k: int
) -> DataFrame:
    """Per leaf and kind of probe the leaves with points within its distance, and the distance's square ``_limit``.

    Probes without a distance take it from corners: the farthest corners of cells, in order, until they hold ``k`` usable points.
    """
    place = ["_l", *grid]
    unit, node = [f"_u{c}" for c in place], [f"_n{c}" for c in place]

    def at(level: int, names: Sequence[str]) -> list[Column]:
        """The cell of a leaf at a level, the leaf itself where it is coarser."""
        return [F.least(F.col("_l"), F.lit(level)).alias(names[0]), *[F.expr(f"shiftright({g}, greatest(_l - {level}, 0))").alias(n) for g, n in zip(grid, names[1:])]]

    leaves = checkpoint(known.groupBy(*place).agg(F.count(F.lit(1)).alias("_count")))
    given = units.select(*[F.col(c).alias(u) for c, u in zip(place, unit)], "_rest", "_class", (F.col("_radius") * F.col("_radius") * (1 + 1e-9)).alias("_limit"))
    root = [F.lit(0).alias(node[0]), *[F.expr(f"shiftright({u}, {unit[0]})").alias(n) for u, n in zip(unit[1:], node[1:])]]
    sure, lost = given.where("_limit is not null").select("*", *root), given.where("_limit is null").select("*", *root)
    width, wide = (F.lit(base) * F.pow(F.lit(2.0), -F.col(c)) for c in (unit[0], node[0]))
    near, far = F.lit(0.0), F.lit(0.0)
    for u, n, o in zip(unit[1:], node[1:], low):
        begin, other = F.lit(o) + F.col(u) * width, F.lit(o) + F.col(n) * wide
        gap = _gap(begin, width, other, wide, slack)
        reach = F.greatest(F.abs(other + wide - begin), F.abs(begin + width - other)) + slack
        near, far = near + gap * gap, far + reach * reach

    def below(level: int) -> DataFrame:
        parent = [f"_p{c}" for c in place]
        return leaves.select(*at(level - step, parent), *at(level, node), "_count").groupBy(*parent, *node).agg(F.sum("_count").alias("_count"))

    def down(frontier: DataFrame, level: int) -> DataFrame:
        renamed = frontier.withColumnsRenamed({n: f"_p{c}" for n, c in zip(node, place)})
        return renamed.join(below(level), [f"_p{c}" for c in place]).drop(*[f"_p{c}" for c in place])

    for level in range(step, depth + 1, step):
        sure = down(sure, level).drop("_count").where(near <= F.col("_limit"))
    if not lost.isEmpty():
        who = lost.select("_class").distinct()
        owned = known.join(who, known["_owner"].eqNullSafe(who["_class"]), "left_semi")
        owned = checkpoint(owned.groupBy(*place, "_owner").agg(F.count(F.lit(1)).alias("_count")))
        whole = Window.partitionBy(*unit, "_class")
        upto = F.sum("_usable").over(whole.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0))
        for level in range(step, depth + 1, step):
            own = owned.select(*at(level, [f"_o{c}" for c in place]), "_owner", "_count").groupBy(*[f"_o{c}" for c in place], "_owner")
            own = own.agg(F.sum("_count").alias("_own"))
            here = reduce(lambda a, b: a & b, [F.col(n) == F.col(f"_o{c}") for n, c in zip(node, place)])
            met = down(lost, level).join(own, here & F.col("_class").eqNullSafe(F.col("_owner")), "left")
            met = met.withColumn("_usable", F.col("_count") - F.coalesce("_own", F.lit(0))).where("_usable > 0")
            met = met.withColumns({"_near": near, "_far": far}).withColumn("_reach", F.when(upto >= k, F.col("_far")))
            met = met.withColumn("_limit", F.least("_limit", F.min("_reach").over(whole)))
            left = met.where(F.col("_limit").isNull() | (F.col("_near") <= F.col("_limit"))).select(*unit, "_rest", "_class", "_limit", *node)
            lost = checkpoint(left) if level % (2 * step) == 0 else left  # a task holds the sorts of two levels
        sure = sure.unionByName(lost)
    return sure.withColumnsRenamed(dict(zip(node, place)))
