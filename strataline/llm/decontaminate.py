"""Benchmark decontamination by a broadcast hash set of word windows (operator 7)."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import U64, Texts, Words, batch, byte_table, columns_of, find_words, flags, map_slices, mix
from strataline.settings import ship

WINDOW = 13
# Most bytes of benchmark text in one broadcast set, which takes about six times that; a larger benchmark is scanned for in parts.
PART_BYTES = 16 << 20
# A document is contaminated when this many times its hit words reach its words.
ONE_IN = 20

_LOWER = byte_table()
_WORD = flags((48, 57), (97, 122), (128, 255))
_SLOTS = 1 << 22


def _windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``size`` words inside one text."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    # Hash of 2^k words from two halves; then the binary digits of the size, from the left.
    power, done, code = words.hash, 0, np.zeros(n, U64)
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            code = mix(code * U64(3) + power[done : done + n])
            done += 1 << bit
        if size >> (bit + 1):
            half = 1 << bit
            power = mix(power[:-half] * U64(5) + power[half:])
    at = np.flatnonzero(words.text[:n] == words.text[size - 1 :])
    return at, code[at]


@dataclass
class BenchmarkSet:
    """Windows of a benchmark as arrays: its normalised bytes and words, and per size the sorted hashes with their windows.

    A few dozen bytes per word, built without a step per window. ``groups`` holds, for hashes that were met, the items of each
    spelling, so that a hit is verified on the words.
    """

    items: list[str]
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    groups: dict[tuple[int, int], dict[bytes, list[int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[str, str]], window: int) -> BenchmarkSet:
        texts = Texts.of(pa.array([r[1] for r in rows], pa.string()))
        data = _LOWER[texts.data]
        words = find_words(texts, data, _WORD)
        owner = words.text.astype(np.int32)
        found = cls([r[0] for r in rows], data, words.start.astype(np.int32), words.end.astype(np.int32), owner)
        sizes = np.minimum(words.counts, window)
        for size in np.unique(sizes[sizes > 0]):
            first, code = _windows(words, int(size))
            own = sizes[owner[first]] == size
            order = np.argsort(code[own], kind="stable")
            found.hashes[int(size)] = code[own][order]
            found.windows[int(size)] = first[own][order].astype(np.int32)
        return found

    def owners(self, size: int, code: np.uint64) -> dict[bytes, list[int]]:
        """Spellings of the windows with that hash, and the items of each."""
        low, high = (int(np.searchsorted(self.hashes[size], code, side)) for side in ("left", "right"))
        if (size, low) not in self.groups:
            found: dict[bytes, list[int]] = defaultdict(list)
            for w in self.windows[size][low:high].tolist():
                own = found[_spelled(self.data, self, w, size)]
                if not own or own[-1] != self.owner[w]:
                    own.append(int(self.owner[w]))
            self.groups[size, low] = dict(found)
        return self.groups[size, low]

    def hits(self, data: np.ndarray, words: Words) -> list[tuple[int, int, list[int]]]:
        """(first word, one past the last, items) of every verified window, by first word within each size."""
        out = []
        for size, known in self.hashes.items():
            first, code = _windows(words, size)
            occupied = np.zeros(_SLOTS, bool)
            occupied[known % U64(_SLOTS)] = True
            maybe = np.flatnonzero(occupied[code & U64(_SLOTS - 1)])
            near = np.searchsorted(known, code[maybe])
            maybe = maybe[known[np.minimum(near, len(known) - 1)] == code[maybe]]
            for at in maybe.tolist():
                w = int(first[at])
                owners = self.owners(size, code[at]).get(_spelled(data, words, w, size))
                if owners:
                    out.append((w, w + size, owners))
        return out


def _spelled(data: np.ndarray, words: Words | BenchmarkSet, first: int, size: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(words.start[first : first + size], words.end[first : first + size], strict=True))


def _scan(rows: DataFrame, known: BenchmarkSet) -> DataFrame:
    """(id, text key, n_words, hit word ranges, items) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    kind = rows.schema["id"].dataType.simpleString()
    ranges = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        texts = Texts.of(piece.column("text"))
        data = _LOWER[texts.data]
        words = find_words(texts, data, _WORD)
        spans: list[list[dict[str, int]]] = [[] for _ in range(piece.num_rows)]
        items: list[set[str]] = [set() for _ in range(piece.num_rows)]
        for first, last, owners in own.hits(data, words):
            text = int(words.text[first])
            base = int(words.first[text])
            spans[text].append({"first": first - base, "last": last - base})
            items[text].update(own.items[o] for o in owners)
        return batch(
            id=piece.column("id"),
            row_key=piece.column("row_key"),
            n_words=words.counts.astype(np.int64),
            spans=pa.array(spans, ranges),
            items=pa.array([sorted(i) for i in items], pa.list_(pa.string())),
        )

    return map_slices(rows, run, f"id {kind}, row_key string, n_words long, spans array<struct<first: long, last: long>>, items array<string>")


def _verdict(spans: list[tuple[int, int]], n_words: int, one_in: int) -> tuple[list[dict[str, int]], int, bool]:
    """Union of word ranges, the words in it, and whether that is contamination."""
    own: list[dict[str, int]] = []
    for first, last in sorted(spans):
        if own and first <= own[-1]["last"]:
            own[-1]["last"] = max(own[-1]["last"], last)
        else:
            own.append({"first": first, "last": last})
    hit = sum(s["last"] - s["first"] for s in own)
    return own, hit, hit > 0 and one_in * hit >= n_words


def _finish(found: DataFrame, one_in: int) -> DataFrame:
    """Union of the word ranges, the items in order, and the verdict."""
    kind = found.schema["id"].dataType.simpleString()
    ranges = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for rows in batches:
            merged, hit, bad, digests, count = [], [], [], [], []
            sizes = rows.column("n_words").to_pylist()
            for size, spans, items in zip(sizes, rows.column("spans").to_pylist(), rows.column("items").to_pylist(), strict=True):
                own, n_hit, contaminated = _verdict([(s["first"], s["last"]) for s in spans], size, one_in)
                names = sorted(set(items))
                merged.append(own)
                hit.append(n_hit)
                bad.append(contaminated)
                digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                count.append(len(names))
            yield batch(
                id=rows.column("id"),
                row_key=rows.column("row_key"),
                n_words=rows.column("n_words"),
                n_hit=pa.array(hit, pa.int64()),
                n_items=pa.array(count, pa.int64()),
                items_sha256=pa.array(digests, pa.string()),
                contaminated=pa.array(bad, pa.bool_()),
                spans=pa.array(merged, ranges),
            )

    return found.select("id", "row_key", "n_words", "spans", "items").mapInArrow(
        run,
        f"id {kind}, row_key string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first: long, last: long>>",
    )


def _items(benchmark: DataFrame, item_col: str, text_col: str, part_bytes: int, window: int) -> tuple[DataFrame, int]:
    """(item, text) rows, and how many parts of at most about ``part_bytes`` they make.

    An item of more than a quarter of a part is cut into pieces that share ``window - 1`` words, so that no part grows with an item.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    size, longest = items.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    most = max(part_bytes // 4, 1)

    def cut(batches):
        for rows in batches:
            for item, text in zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True):
                whole = Texts.of(pa.array([text], pa.string()))
                words = find_words(whole, _LOWER[whole.data], _WORD)
                count = len(words.start)
                step = max(window, count * most // max(len(whole.data), 1))
                for first in range(0, max(count - window + 1, 1), step):
                    last = min(first + step + window - 1, count)
                    piece = whole.data[words.start[first] : words.end[last - 1]].tobytes().decode() if count else ""
                    yield batch(item=pa.array([item], pa.string()), text=pa.array([piece], pa.string()))

    if (longest or 0) > most:
        ship(benchmark.sparkSession)
        small = items.where(F.octet_length("text") <= most)
        items = small.unionByName(items.where(F.octet_length("text") > most).mapInArrow(cut, "item string, text string"))
        size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    return items, -(-(size or 0) // part_bytes) or 1


def _loaded(items: DataFrame, window: int) -> BenchmarkSet:
    """The set of a part; its size was measured before."""
    return BenchmarkSet.of([(r.item, r.text) for r in items.collect()], window)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    one_in: int = ONE_IN,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The rows of ``docs``, unchanged, that ``scan_benchmark`` does not find contaminated.

    A benchmark of one part is scanned for where the rows are. Beyond that the verdicts are joined by
    id and a digest of the text.
    """
    items, parts = _items(benchmark, item_col, "text", part_bytes, window)
    if parts > 1:
        found = scan_benchmark(docs, benchmark, id_col, text_col, item_col, window, one_in, part_bytes, digest=True)
        bad = found.where("contaminated").select(F.col(id_col).alias("_bad_id"), F.col("row_key").alias("_bad_key")).distinct()
        key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
        return docs.join(bad, docs[id_col].eqNullSafe(F.col("_bad_id")) & (key == F.col("_bad_key")), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(_loaded(items, window))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts.of(piece.column(text_col))
        data = _LOWER[texts.data]
        words = find_words(texts, data, _WORD)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for first, last, _ in shared.value.hits(data, words):
            spans[int(words.text[first])].append((first, last))
        clean = np.ones(piece.num_rows, bool)
        for text, own in spans.items():
            clean[text] = not _verdict(own, int(words.counts[text]), one_in)[2]
        return piece.filter(pa.array(clean))

    return map_slices(docs, run, columns_of(docs), text=text_col)


def scan_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    one_in: int = ONE_IN,
    part_bytes: int = PART_BYTES,
    digest: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged hit word ranges).

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. Every window of
    ``window`` words of a benchmark item, or the whole item if it has fewer, goes into a hash set that is
    broadcast; hits are verified on the words themselves. The size of the benchmark is measured first:
    beyond ``part_bytes`` it is dealt into parts by a hash of its items or, of long ones, of their pieces; each part is broadcast and scanned
    for on its own, and the ranges and items of a row are brought together, so no broadcast grows with it.

    Null and empty texts and items have no words; an item without id is left out; an item that is repeated counts once; repeated rows and
    null ids give a row each; other columns are ignored; an empty benchmark hits nothing.
    """
    items, parts = _items(benchmark, item_col, text_col, part_bytes, window)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("row_key", F.sha2(F.coalesce("text", F.lit("")), 256) if digest or parts > 1 else F.lit(""))
    if parts == 1:
        found = _scan(keyed, _loaded(items, window))
    else:
        found = None
        for part in range(parts):
            own = _loaded(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part), window)
            scanned = _scan(keyed, own).withColumn("part", F.lit(part))
            found = scanned if found is None else found.unionByName(scanned)
        # Equal rows (id and text) are counted, brought together once and repeated at the end.
        found = (
            found.groupBy("id", "row_key", "part")
            .agg(F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"))
            .groupBy("id", "row_key")
            .agg(
                F.max("copies").alias("copies"),
                F.first("n_words").alias("n_words"),
                F.flatten(F.collect_list("spans")).alias("spans"),
                F.flatten(F.collect_list("items")).alias("items"),
            )
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        )
    out = _finish(found, one_in).withColumnRenamed("id", id_col)
    return out if digest else out.drop("row_key")
