"""Phrase collocations by external count streams: sorted, scanned and merged in step, never looked up.

1. Every word position gives one record, the up to four words of its piece that begin there. Equal records of a slice
   are counted at once; the rest are range-sorted. A scan of that prefix order sees the records of any phrase of one
   to four words as one run, so one sort counts the phrases of all lengths. Runs that reach the end of a partition
   are added up afterwards (at most ten per partition).
2. The frequent phrases are kept in two streams, sorted by their words and by their reversed words. In the first a phrase
   follows its own beginnings and is followed by its extensions to the right, in the second its endings and its
   extensions to the left. One pass over each, with the path of open phrases on a stack, gives left counts, right counts
   and the best extension; a partition learns the few phrases open at its start from the bound it begins with.
3. Both streams are merged in step: equal phrases meet, cuts are scored with exact integers, covered candidates drop.
   A phrase that covers a candidate holds a phrase that is one word longer than the candidate and at least as frequent
   as itself, so extensions by one word decide.

Words are kept in an order-preserving form that ends each word with a zero byte, so that a phrase is a byte prefix of all
its extensions and of nothing else. Exact at any size: nothing is dropped before its whole count is known.

Defined cases: null texts have no words, null languages are ``und`` (together with a language of that name); further
columns are ignored; an empty table gives no rows; a word may be as long as its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import Steps, Texts, byte_table, flags, map_slices
from strataline.settings import ship

LONGEST, LEAST, SCALE, COVER, TOP = 4, 30, 2_000_000, (80, 100), 2000
# Text that is counted at once before the shuffle.
SLICE = 4 << 20
# Text bytes per partition of records, and one text in so many to place the partitions' bounds (nothing else depends on it).
PART_BYTES, BOUNDS_SHARE, MOST_PARTS = 5 << 20, 64, 50_000

_END = flags((10, 13), (33, 33), (44, 44), (46, 46), (58, 59), (63, 63))  # . , ; : ! ? and line ends
_WORD = ~(_END | flags((9, 9), (32, 32)))
# Bytes 0 to 8 give way to the zero that ends a word; no word holds a tab, so byte 9 is free.
_HELD = byte_table()
_HELD[:9] += 1
_BACK = bytes([0, *range(9), *range(10, 256)])


# ---- records


def _records(lang: str, column: pa.Array) -> tuple[pa.Array, np.ndarray] | None:
    """Distinct records of a slice's texts in one language, in order, and their counts."""
    texts = Texts.of(column)
    # Words are runs of word bytes; a text may begin right after the last word of the text before it.
    inside = _WORD[texts.data]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    first = texts.starts[texts.sizes > 0]
    head[first] = inside[first]
    start = np.flatnonzero(head)
    n = len(start)
    if not n:
        return None
    upto = np.cumsum(inside, dtype=np.int32)
    # Words by their bytes: distinct ones in order, each with its end.
    offsets = np.append(upto[start] - 1, upto[-1]).astype(np.int64)
    wide = offsets[-1] * (LONGEST + 1) + 8 * n > 2**31 - 1
    kind, width = (pa.large_binary(), np.int64) if wide else (pa.binary(), np.int32)
    flat = _HELD[texts.data[inside]]
    held = pa.Array.from_buffers(kind, n, [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(flat)])
    found = held.dictionary_encode()
    order = pc.array_sort_indices(found.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    word = rank[found.indices.to_numpy(zero_copy_only=False)]
    end, nothing = pa.scalar(b"\0", kind), pa.scalar(b"", kind)
    lexicon = pa.concat_arrays([pa.array([b""], kind), pc.binary_join_element_wise(found.dictionary.take(order), end, nothing)])
    # A piece ends at its marks and with its text.
    marks = _END[texts.data].astype(np.int32)
    np.add.at(marks, first, 1)
    piece = np.cumsum(marks, dtype=np.int32)[start]
    following = np.zeros(n, bool)  # whether the next word is in the same piece
    following[:-1] = piece[1:] == piece[:-1]

    def after(values: np.ndarray, steps: int) -> np.ndarray:
        """The value so many words on in the piece, else 0."""
        out = np.zeros(n, np.int64)
        if n > steps:
            within = np.ones(n - steps, bool)
            for k in range(steps):
                within &= following[k : n - steps + k]
            out[: n - steps] = np.where(within, values[steps:], 0)
        return out

    # Two words in one number, then two of those; ranks keep the order and the numbers small.
    pairs, at = np.unique(word * len(lexicon) + after(word, 1), return_inverse=True)
    code, counts = np.unique((at + 1) * (len(pairs) + 1) + after(at + 1, 2), return_counts=True)
    first, second = np.divmod(code, len(pairs) + 1)
    tail = np.where(second > 0, pairs[second - 1], 0)
    columns = [lexicon.take(pa.array(c)) for pair in (pairs[first - 1], tail) for c in np.divmod(pair, len(lexicon))]
    head = pa.scalar(lang.encode().hex().encode() + b"\0", kind)
    return pc.binary_join_element_wise(head, *columns, nothing), counts


def _lower(keys: pa.Array, bound: bytes, low: int) -> int:
    """The first of the sorted keys, from ``low`` on, that is not below the bound."""
    high = len(keys)
    while low < high:
        middle = (low + high) // 2
        if keys[middle].as_py() < bound:
            low = middle + 1
        else:
            high = middle
    return low


RECORD = "part int, key binary, n long"


def _records_of(bounds: list[bytes]):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        langs, texts = piece.column("lang"), piece.column("text")
        keys, parts, counts = [], [], []
        for lang in sorted(pc.unique(langs).to_pylist()):
            found = _records(lang, texts.filter(pc.equal(langs, lang)))
            if found is None:
                continue
            keys.append(found[0].cast(pa.binary()))
            counts.append(found[1])
            cuts, low = [], 0
            for bound in bounds:  # the records are sorted, so the bounds are looked up among them
                low = _lower(found[0], bound, low)
                cuts.append(low)
            parts.append(np.searchsorted(np.array(cuts, np.int64), np.arange(len(found[0])), "right"))
        if not keys:
            return None
        columns = [pa.array(np.concatenate(parts), pa.int32()), pa.concat_arrays(keys), pa.array(np.concatenate(counts), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "key", "n"])

    return run


# ---- counts


def _shared(data: np.ndarray, start: np.ndarray, end: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Per key the whole words it shares with the key before it, the language included; ``upto`` counts zeros before each byte."""
    same = np.zeros(len(start), np.int64)
    rows = np.arange(1, len(start))
    room = np.minimum(end[1:] - start[1:], end[:-1] - start[:-1])
    at = np.zeros(len(rows), np.int64)
    step = np.arange(8)
    while len(rows):
        differ = data[(start[rows] + at)[:, None] + step] != data[(start[rows - 1] + at)[:, None] + step]
        equal = np.where(differ.any(1), differ.argmax(1), 8)
        at += equal
        done = (equal < 8) | (at >= room[rows - 1])
        same[rows[done]] = np.minimum(at[done], room[rows[done] - 1])
        rows, at = rows[~done], at[~done]
    return upto[start + same] - upto[start]


COUNT = "key binary, level int, n long, partial boolean"


def _count(least: int):
    """Sorted records to the counts of all phrases they begin with; level 1 is the language, level m + 1 a phrase of m words.

    Runs that hold a partition's first or last record may go on in another partition: they come out marked, whatever their count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list[tuple[bytes, int, bool]] = []  # per level: the open phrase, its count so far, whether the partition began with it
        begun = False
        for piece in batches:
            keys, counts = piece.column("key"), piece.column("n").to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            # The last key before the batch stands in front, so that shared words are seen across batches.
            before = opened[-1][0] if opened else b""
            _, offsets, held = keys.buffers()
            at = np.frombuffer(offsets, np.int32, len(keys) + 1, keys.offset * 4).astype(np.int64)
            own = np.frombuffer(held, np.uint8)[at[0] : at[-1]]
            data = np.concatenate([np.frombuffer(before, np.uint8), own, np.full(8, 255, np.uint8)])
            edges = np.concatenate([[0], at - at[0] + len(before)])
            zeros = np.flatnonzero(data == 0)
            upto = np.concatenate([[0], np.cumsum(data == 0)])
            shared = _shared(data, edges[:-1], edges[1:], upto)[1:]
            start, length = edges[1:-1], upto[edges[2:]] - upto[edges[1:-1]]
            out: list[tuple[bytes, int, int, bool]] = []
            now: list[tuple[bytes, int, bool]] = []

            def close(level: int, phrase: bytes, n: int, first: bool, out=out) -> None:
                if first or n >= least or level == 1:
                    out.append((phrase, level, n, first))

            for level in range(1, max(int(length.max()), len(opened)) + 1):
                heads = np.flatnonzero(shared < level)
                if not len(heads) or heads[0]:
                    heads = np.concatenate([[0], heads])
                sums, known = np.add.reduceat(counts, heads), length[heads] >= level
                goes_on = len(opened) >= level and shared[0] >= level
                if len(opened) >= level and not goes_on:
                    close(level, *opened[level - 1])

                def phrase(i: int, level=level, heads=heads) -> bytes:
                    left = start[heads[i]]
                    return data[left : zeros[upto[left] + level - 1] + 1].tobytes()

                wanted = known & ((sums >= least) | (level == 1))
                wanted[0] = wanted[-1] = False  # the ends are looked at one by one
                for i in np.flatnonzero(wanted):
                    out.append((phrase(i), level, int(sums[i]), False))
                ends = []
                if known[0]:
                    more, first = opened[level - 1][1:] if goes_on else (0, not begun)
                    ends.append((phrase(0), int(sums[0]) + more, first))
                if len(heads) > 1:
                    if ends:
                        close(level, *ends.pop())
                    if known[-1]:
                        ends.append((phrase(len(heads) - 1), int(sums[-1]), False))
                now += ends
            opened, begun = now, True
            if out:
                yield _table(out)
        if opened:
            yield _table([(phrase, level, n, True) for level, (phrase, n, _) in enumerate(opened, 1)])

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("key", pa.binary()), ("level", pa.int32()), ("n", pa.int64()), ("partial", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def _counts(docs: DataFrame, steps: Steps, least: int) -> DataFrame:
    """(key, level, n) of every phrase of one to four words that occurs ``least`` times, and of each language."""
    spark = docs.sparkSession
    unknown, empty = F.lit("und"), F.lit("")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), unknown).alias("lang"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES)))
    # Bounds of the partitions from the records of some texts: they decide where a record is counted, not whether.
    some = map_slices(texts.where(F.pmod(F.xxhash64("text"), F.lit(BOUNDS_SHARE)) == 0), _records_of([]), RECORD, limit=SLICE)
    rate = max(1, total // BOUNDS_SHARE // 8 // (20 * parts))
    sample = sorted(bytes(r.key) for r in some.where(F.pmod(F.xxhash64("key"), F.lit(rate)) == 0).select("key").collect())
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    records = map_slices(texts, _records_of(bounds), RECORD, limit=SLICE)
    sorted_parts = records.repartitionById(parts, "part").select("key", "n").sortWithinPartitions("key")
    found = steps.keep(sorted_parts.mapInArrow(_count(least), COUNT))
    enough = (F.col("n") >= least) | (F.col("level") == 1)
    ends = found.where("partial").groupBy("key", "level").agg(F.sum("n").alias("n"))
    return steps.keep(found.where(~F.col("partial")).select("key", "level", "n").unionByName(ends.where(enough)))


# ---- neighbours in the streams

WALKED = "key binary, side int, n long, counts array<long>, best long"
_WALKED = pa.schema([("key", pa.binary()), ("side", pa.int32()), ("n", pa.int64()), ("counts", pa.list_(pa.int64())), ("best", pa.int64())])


def _words(key: bytes) -> list[bytes]:
    """The language, then the words."""
    return key[:-1].split(b"\0")


def _turned(key: bytes) -> bytes:
    lang, *words = _words(key)
    return b"\0".join([lang, *reversed(words), b""])


def _beginnings(key: bytes) -> list[bytes]:
    """The shorter phrases that a key begins with, the language first."""
    ends = [i + 1 for i, b in enumerate(key) if b == 0]
    return [key[:e] for e in ends[:-1]]


def _walk(side: int, openings: dict[int, list[tuple[bytes, int]]]):
    """Each phrase with the counts of the phrases it begins with (shortest first) and its best extension by one word.

    A phrase that another partition holds, but whose extensions reach into this one, comes out with its best extension only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[list] = []  # phrase, count, best extension, whether it is of this partition
        out: list[dict] = []

        def close() -> None:
            key, n, best, own = path.pop()
            if path and (own or best):  # no language
                out.append(
                    {
                        "key": _turned(key) if side else key,
                        "side": side,
                        "n": n if own else None,
                        "counts": [p[1] for p in path[1:]] if own else None,
                        "best": best,
                    }
                )

        part = None
        for piece in batches:
            for where, key, n in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if where != part:
                    while path:
                        close()
                    part = where
                    path.extend([k, c, 0, False] for k, c in openings[part])
                while path and not key.startswith(path[-1][0]):
                    close()
                if path:
                    path[-1][2] = max(path[-1][2], n)
                path.append([key, n, 0, True])
            if out:
                yield pa.RecordBatch.from_pylist(out, _WALKED)
                out.clear()
        while path:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, _WALKED)

    return run


def _turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in batches:
        yield piece.set_column(0, "key", pa.array([_turned(k) for k in piece.column("key").to_pylist()], pa.binary()))


def _stream(phrases: DataFrame, steps: Steps, side: int, parts: int) -> DataFrame:
    """One stream, sorted and walked. Phrases open where a partition begins are beginnings of its first phrase."""
    spark = phrases.sparkSession
    ordered = phrases.select("key", "n")
    if side:
        ordered = ordered.mapInArrow(_turn, "key binary, n long")
    ranged = steps.keep(ordered.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    heads = {r.part: _beginnings(bytes(r.head)) for r in ranged.groupBy("part").agg(F.min("key").alias("head")).collect()}
    names = sorted({k for keys in heads.values() for k in keys})
    held: dict[bytes, int] = {}
    if names:
        wanted = spark.createDataFrame([(bytearray(k),) for k in names], "key binary")
        held = {bytes(r.key): r.n for r in ranged.join(F.broadcast(wanted), "key").select("key", "n").collect()}
    openings = {part: [(k, held[k]) for k in keys] for part, keys in heads.items()}
    return ranged.select("part", "key", "n").repartitionById(parts, "part").sortWithinPartitions("part", "key").mapInArrow(_walk(side, openings), WALKED)


PHRASE = "lang string, phrase string, a long, l long, r long, score long"
_PHRASE = pa.schema([("lang", pa.string()), ("phrase", pa.string()), *((c, pa.int64()) for c in ("a", "l", "r", "score"))])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both streams in one order: what is known of a phrase stands together."""
    out: list[dict] = []
    key, found = None, []

    def finish() -> None:
        lang, *words = _words(key)
        if len(words) < 2:
            return
        a = next(r[1] for r in found if r[1] is not None)
        lefts, rights = (next(r[2] for r in found if r[0] == side and r[2] is not None) for side in (0, 1))
        if COVER[1] * max(r[3] for r in found) >= COVER[0] * a:
            return
        cuts = [(lefts[k], rights[len(words) - 2 - k]) for k in range(len(words) - 1)]
        score, left, right = min(((SCALE * a // (x + y), x, y) for x, y in cuts), key=lambda c: c[0])
        text = b" ".join(words).translate(_BACK).decode()
        out.append({"lang": bytes.fromhex(lang.decode()).decode(), "phrase": text, "a": a, "l": left, "r": right, "score": score})

    for piece in batches:
        for name, *row in zip(*(c.to_pylist() for c in piece.columns), strict=True):
            if name != key:
                if key is not None:
                    finish()
                key, found = name, []
            found.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, _PHRASE)
            out.clear()
    if key is not None:
        finish()
    if out:
        yield pa.RecordBatch.from_pylist(out, _PHRASE)


def collocations(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """All phrases of two to four words that occur ``least`` times and are not covered by a longer one.

    (lang, phrase, a, l, r, n, score): occurrences of the phrase, of both parts of its weakest cut, words of its language.
    """
    spark = docs.sparkSession
    ship(spark)
    steps = Steps(spark, "collocations")
    counted = _counts(docs, steps, least)
    phrases = counted.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), phrases // 1_000_000)
    both = steps.keep(_stream(counted, steps, 0, parts).unionByName(_stream(counted, steps, 1, parts)))
    merged = both.repartitionByRange(parts, "key").sortWithinPartitions("key", "side").mapInArrow(_merge, PHRASE)
    code = F.expr("substring(cast(key AS string), 1, length(key) - 1)")
    langs = counted.where("level = 1").select(F.decode(F.unhex(code), "UTF-8").alias("lang"), "n")
    return merged.join(langs, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best ``top`` collocations of each language, ranked within parts of a language first."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = collocations(docs, least=least)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = found.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
