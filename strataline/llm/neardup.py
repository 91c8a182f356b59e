"""Near-duplicate documents: banded MinHash candidates, odd sketches, links confirmed on full sets (operator 6)."""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import U64, Steps, Texts, batch, byte_table, find_words, flags, map_slices, mix
from strataline.llm.graph import components

# 24 bands of 4 samples: a pair at similarity 0.85 shares none with probability 1e-8, one at 0.8 with 3e-6.
BANDS, ROWS = 24, 4
# MinHash samples folded into a sketch, and its bits (eight 64-bit words).
SAMPLES, SKETCH_BITS = 512, 512
# Standard deviations above the expected distance at the threshold before a sketch rules a pair out.
SLACK = 5.0
# Similarity to a bucket's pivot, by sketch, from which a document belongs to the pivot's cluster.
CLUSTER = 0.6
# Documents of a cluster that a task compares with as many others, and their shingles.
BLOCK, BLOCK_ITEMS = 512, 1 << 20
# Documents of a bucket whose sketches a task compares with as many others.
SKETCH_BLOCK = 2048

_LOWER = byte_table()
_WORD = ~flags((9, 13), (32, 32))
_WORDS64 = SKETCH_BITS // 64


def _coefficients(n: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32) | np.uint32(1)


_FACTOR = _coefficients(SAMPLES)
_SHIFT = _coefficients(2 * SAMPLES)[SAMPLES:]


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; of fewer words than a shingle the whole sequence is one."""
    texts = Texts.of(column)
    data = _LOWER[texts.data]
    found = find_words(texts, data, _WORD)
    n = len(found.hash)
    run = found.hash.copy()
    for i in range(1, words):
        run[: n - i] = mix(run[: n - i] * U64(3) + found.hash[i:])
    out = []
    for first, last in zip(found.first, found.last, strict=True):
        if last - first >= words:
            out.append(np.unique(run[first : last - words + 1]))
        elif last > first:
            code = found.hash[first : first + 1]
            for i in range(first + 1, last):
                code = mix(code * U64(3) + found.hash[i])
            out.append(code ^ U64(last - first))
        else:
            out.append(np.zeros(0, U64))
    return out


def min_samples(items: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over the set."""
    low = (items ^ (items >> U64(32))).astype(np.uint32)
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(least, (np.multiply.outer(_FACTOR, low[i : i + 1024]) + _SHIFT[:, None]).min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: a bit is set where an odd number of them falls."""
    slot = mix(least.astype(U64) | (np.arange(SAMPLES, dtype=U64) << U64(32))) % U64(SKETCH_BITS)
    odd = (np.bincount(slot.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(U64)
    code = mix(np.arange(1, BANDS + 1, dtype=U64))
    for i in range(ROWS):
        code = mix(code * U64(3) + rows[:, i])
    return code.view(np.int64)


def expected_apart(similarity: float) -> float:
    """Distance of the sketches of a pair of that similarity, on average."""
    return SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS))


def most_apart(threshold: float) -> int:
    """The largest distance of two sketches that may still come from a pair at the threshold."""
    load = 4 * SAMPLES * (1 - threshold) / SKETCH_BITS
    expected = expected_apart(threshold)
    from_samples = 2 * math.sqrt(SAMPLES * threshold * (1 - threshold)) * math.exp(-load)
    from_slots = math.sqrt(SKETCH_BITS / 4 * (1 - math.exp(-2 * load)))
    return math.ceil(expected + SLACK * math.hypot(from_samples, from_slots))


def estimate(distance: int) -> float:
    """Similarity that a distance of two sketches stands for."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(max(1 - 2 * distance / SKETCH_BITS, 1e-9))


def _signatures(rows: DataFrame, words: int) -> DataFrame:
    """(id, text_hash, n, set_a, set_b, bands, sketch) of every row; bands and sketch are null for an empty set."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(piece.column("text"), words)
        digests, bands, sketches = [], [], []
        for items in sets:
            if not len(items):
                digests.append((None, None))
                bands.append(None)
                sketches.append(None)
                continue
            digests.append(tuple(np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64).tolist()))
            least = min_samples(items)
            bands.append(band_keys(least))
            sketches.append(odd_sketch(least))
        many = pa.list_(pa.int64())
        return batch(
            id=piece.column("id"),
            text_hash=piece.column("text_hash"),
            n=pa.array([len(s) for s in sets], pa.int64()),
            set_a=pa.array([d[0] for d in digests], pa.int64()),
            set_b=pa.array([d[1] for d in digests], pa.int64()),
            bands=pa.array(bands, many),
            sketch=pa.array(sketches, many),
        )

    kind = rows.schema["id"].dataType.simpleString()
    return map_slices(rows, run, f"id {kind}, text_hash long, n long, set_a long, set_b long, bands array<long>, sketch array<long>")


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    out = F.lit(0)
    for i in range(_WORDS64):
        out = out + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return out


def _alike_sizes(a: str, b: str, share: tuple[int, int]) -> Column:
    return F.least(a, b) * share[1] >= F.greatest(a, b) * share[0]


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike enough. Each pair meets its two texts by joins."""
    num, den = share

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        known: OrderedDict[object, np.ndarray] = OrderedDict()

        def sets(side: str) -> list[np.ndarray]:
            ids, column = piece.column(side).to_pylist(), piece.column(f"text_{side}")
            new = {v: i for i, v in enumerate(ids) if v not in known}
            if new:
                known.update(zip(new, shingle_sets(column.take(pa.array(list(new.values()))), words), strict=True))
            return [known[v] for v in ids]

        keep = []
        for x, y in zip(sets("a"), sets("b"), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
        return piece.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    joined = (
        pairs.select("a", "b")
        .join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    )
    return map_slices(joined.select("a", "b", "text_a", "text_b"), run, f"a {kind}, b {kind}", text="text_a")


def _in_blocks(docs: DataFrame) -> DataFrame:
    """(pair, side, rep, component, n, text) of every pair of blocks of a cluster that may hold links.

    ``docs`` has rep, cluster, component, n and text. A component too large for a block is cut into blocks
    of its own by a hash; the others of the cluster share blocks, each whole in one of them. Two blocks of
    one component are not paired. A block alone is a pair with one side.
    """
    parts = F.ceil(F.greatest(F.sum("c") / BLOCK, F.sum("items") / BLOCK_ITEMS)).cast("int")
    sizes = docs.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("items"))
    large = (F.col("c") > BLOCK) | (F.col("items") > BLOCK_ITEMS)
    owned = sizes.withColumn("owner", F.when(large, F.col("component")))
    cut = owned.groupBy("cluster", "owner").agg(parts.alias("parts"))
    cut = cut.select(F.col("cluster").alias("_cluster"), F.col("owner").alias("_owner"), "parts")
    same = (F.col("cluster") == F.col("_cluster")) & F.col("owner").eqNullSafe(F.col("_owner"))
    split = F.when(F.col("owner").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("rep"))
    placed = (
        docs.join(owned.select("cluster", "component", "owner"), ["cluster", "component"])
        .join(cut, same)
        .withColumn("block", F.xxhash64("cluster", F.col("owner").isNull(), "owner", F.pmod(split, F.col("parts"))))
    )
    blocks = cut.select(
        F.col("_cluster").alias("cluster"), F.col("_owner").alias("owner"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    ).select("cluster", "owner", F.xxhash64("cluster", F.col("owner").isNull(), "owner", F.col("part").cast("long")).alias("block"))
    other = blocks.select(F.col("cluster").alias("_cluster"), F.col("owner").alias("_owner"), F.col("block").alias("_block"))
    pairs = blocks.join(other, F.col("cluster") == F.col("_cluster")).where(
        (F.col("block") <= F.col("_block")) & ~F.coalesce(F.col("owner") == F.col("_owner"), F.lit(False))
    )
    ends = pairs.select(
        F.xxhash64("block", "_block").alias("pair"),
        F.explode(
            F.when(F.col("block") == F.col("_block"), F.array(F.struct(F.lit(0).alias("side"), "block"))).otherwise(
                F.array(F.struct(F.lit(0).alias("side"), "block"), F.struct(F.lit(1).alias("side"), F.col("_block").alias("block")))
            )
        ).alias("end"),
    ).select("pair", "end.side", "end.block")
    return placed.join(ends, "block").select("pair", "side", "rep", "component", "n", "text")


def _links_in_blocks(docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) between different components, found on full sets block by block; of those that join the same two in a block one."""
    num, den = share
    kind = docs.schema["rep"].dataType.simpleString()
    dealt = _in_blocks(docs).groupBy("pair").agg(F.collect_list(F.struct("side", "rep", "component", "text")).alias("docs"))  # two blocks

    def links(own: pa.StructArray) -> tuple[list[int], list[int]]:
        side = own.field("side").to_numpy(zero_copy_only=False)
        sets = shingle_sets(own.field("text"), words)
        size = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(sets)), size)
        vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
        label = np.unique(np.array(own.field("component").to_pylist()), return_inverse=True)[1]
        flag = np.zeros(len(vocabulary), bool)
        whole = not side.any()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not whole and len(np.unique(label[right])) > len(np.unique(label[left])):
            left, right = right, left
        a_out, b_out = [], []
        for place, a in enumerate(left):
            others = left[place + 1 :] if whole else right
            near = (np.minimum(size[others], size[a]) * den >= np.maximum(size[others], size[a]) * num) & (label[others] != label[a])
            others = others[near]
            if not len(others):
                continue
            mine = code[starts[a] : starts[a + 1]]
            flag[mine] = True
            both = np.bincount(owner[flag[code]], minlength=len(sets))[others]
            flag[mine] = False
            for b in others[den * both >= num * (size[a] + size[others] - both)]:
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    a_out.append(int(a))
                    b_out.append(int(b))
        return a_out, b_out

    def run(batches):
        for piece in batches:
            for docs in piece.column("docs"):
                a, b = links(docs.values)
                if a:
                    reps = docs.values.field("rep")
                    yield batch(a=reps.take(pa.array(a)), b=reps.take(pa.array(b)))

    return dealt.select("docs").mapInArrow(run, f"a {kind}, b {kind}")


def _meetings(entries: DataFrame, most: int, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of documents of one bucket and of different clusters that may be a link; of those that join the same two in a block one.

    ``entries`` has key, rep, cluster, n and sketch. All documents of a bucket are compared with each other,
    by size and sketch. A large bucket is cut into blocks by a hash, and every pair of blocks is a row.
    """
    num, den = share
    kind = entries.schema["rep"].dataType.simpleString()
    sizes = entries.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SKETCH_BLOCK).cast("int").alias("parts"))
    dealt = (
        entries.join(sizes, "key")
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .groupBy("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        .agg(F.collect_list(F.struct((F.col("own") > F.col("other")).alias("side"), "rep", "cluster", "n", "sketch")).alias("docs"))  # two blocks
    )

    def run(batches):
        for piece in batches:
            lists = piece.column("docs")
            flat = lists.flatten()
            borders = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            side, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("side", "n"))
            sketch = flat.field("sketch").flatten().to_numpy(zero_copy_only=False).view(U64).reshape(-1, _WORDS64)
            cluster = np.unique(np.array(flat.field("cluster").to_pylist()), return_inverse=True)[1]
            a_out, b_out = [], []
            for first, last in zip(borders[:-1], borders[1:], strict=True):
                label = cluster[first:last].copy()
                right = np.flatnonzero(side[first:last])
                left = np.flatnonzero(~side[first:last]) if len(right) else np.arange(last - first)
                for place, a in enumerate(left):
                    others = right if len(right) else left[place + 1 :]
                    others = others[label[others] != label[a]]
                    others = others[np.minimum(size[first + others], size[first + a]) * den >= np.maximum(size[first + others], size[first + a]) * num]
                    if not len(others):
                        continue
                    apart = np.bitwise_count(sketch[first + others] ^ sketch[first + a]).sum(axis=1, dtype=np.int64)
                    for b in others[apart <= most]:
                        if label[a] != label[b]:
                            label[label == label[b]] = label[a]
                            a_out.append(int(first + a))
                            b_out.append(int(first + b))
            if a_out:
                reps = flat.field("rep")
                yield batch(a=reps.take(pa.array(a_out)), b=reps.take(pa.array(b_out)))

    return dealt.select("docs").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (4, 5)
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (least id reachable over links), kept.

    Two documents are linked when the Jaccard similarity of their sets of ``words``-word shingles is at
    least share[0] / share[1], computed on the full sets.

    1. Texts with equal sets stand behind one representative, so copies make no pairs.
    2. Representatives that share a MinHash band fall into a bucket. In each bucket all are compared with
       one member picked by a hash, by odd sketch; the likeliest pair of each document is confirmed.
    3. Documents near a bucket's pivot, by a much lower bar, are one cluster with it: copies of one text
       meet in many buckets, so that most links lie within clusters. In buckets that hold several clusters all
       documents are compared by sketch, in blocks: where two may be a link, their clusters become one.
    4. Clusters that still hold several components are compared in blocks, on full sets and without a row
       per pair; blocks of one component are skipped.

    Null and empty texts have an empty set and are linked with nothing. Rows without id are linked with
    nothing, have no component and are kept. Rows that share an id are one node of the graph, each with
    its own n_shingles. Other columns are ignored; an empty table gives an empty one.
    """
    steps = Steps(docs.sparkSession, "neardup")
    most = most_apart(share[0] / share[1])
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = steps.keep(_signatures(rows, words))
    nodes = signed.where("id is not null and n > 0")
    reps = steps.keep(
        nodes.groupBy("set_a", "set_b")
        .agg(F.min(F.struct("id", "text_hash")).alias("who"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .select("set_a", "set_b", F.col("who.id").alias("rep"), "who.text_hash", "n", "bands", "sketch")
    )
    member = nodes.join(reps.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select("id", "rep")
    span = steps.keep(member.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("top")))
    shared_ids = span.where("rep < top").select("id", F.col("rep").alias("b"))
    same_id = None
    if not shared_ids.isEmpty():
        same_id = steps.keep(member.join(shared_ids, "id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct())

    entries = reps.select(F.explode("bands").alias("key"), "rep")
    full = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("key", "rep").alias("h"), "rep"))["rep"].alias("pivot")).where("m > 1")
    buckets = steps.keep(entries.join(full, "key"))
    looks = reps.select("rep", "n", "sketch")
    texts = steps.keep(
        rows.join(
            reps.select(F.col("rep").alias("id"), F.col("text_hash").alias("own_hash")).join(buckets.select(F.col("rep").alias("id")).distinct(), "id"), "id"
        )
        .where("text_hash = own_hash")
        .select(F.col("id").alias("rep"), "text")
        .dropDuplicates(["rep"])
    )
    pairs = buckets.where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    sides = [looks.select(*(F.col(c).alias(f"{c}_{s}" if c != "rep" else s) for c in looks.columns)) for s in ("a", "b")]
    alike = steps.keep(
        pairs.join(sides[0], "a")
        .join(sides[1], "b")
        .select("a", "b", _apart("sketch_a", "sketch_b").alias("z"), _alike_sizes("n_a", "n_b", share).alias("sized"))
        .where(F.col("z") <= max(most, expected_apart(CLUSTER)))
    )

    def contract(links: DataFrame) -> DataFrame:
        return steps.keep(components(links, steps))

    def labelled(df: DataFrame, by: DataFrame, column: str, out: str) -> DataFrame:
        named = by.select(F.col("node").alias(column), F.col("component").alias("_component"))
        return df.join(named, column, "left").withColumn(out, F.coalesce("_component", column)).drop("_component")

    # The nearest pair of each document, by its smaller and its larger end.
    allowed = alike.where(F.col("sized") & (F.col("z") <= most))
    ends = allowed.select(F.explode(F.array("a", "b")).alias("end"), F.struct("z", "a", "b").alias("pair"))
    likeliest = steps.keep(ends.groupBy("end").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct())
    links = steps.keep(_confirm(likeliest, texts, words, share))
    if same_id is not None:
        links = links.unionByName(same_id)
    found = contract(links)

    near_pivots = alike.select("a", "b").unionByName(links)
    clusters = contract(near_pivots)
    # A bucket of one cluster has all its pairs in it. The others are compared whole, whatever their pivot is.
    grouped = steps.keep(labelled(buckets.select("key", "rep"), clusters, "rep", "cluster"))
    open_buckets = grouped.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("key")
    meetings = steps.keep(_meetings(steps.keep(grouped.join(open_buckets, "key").join(looks, "rep")), most, share))
    if not meetings.isEmpty():
        clusters = contract(near_pivots.unionByName(meetings))
    placed = labelled(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), found, "rep", "component")
    open_clusters = placed.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("cluster")
    members = steps.keep(placed.join(open_clusters, "cluster").join(reps.select("rep", "n"), "rep").join(texts, "rep"))
    more = steps.keep(_links_in_blocks(members, words, share))
    if not more.isEmpty():
        found = contract(links.unionByName(more))

    steps.drop_all_but(signed, span, found)
    labels = labelled(span.select("id", "rep"), found, "rep", "component").select("id", F.col("component").alias("rep_component"))
    # A component is named by its least id: that of a representative, which is the least of its copies.
    out = signed.select("id", "n").join(labels, "id", "left")
    own = F.coalesce("rep_component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )
