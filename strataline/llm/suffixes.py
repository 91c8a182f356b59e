"""Repeated byte strings by a depth-limited radix sort of suffixes (operator 5).

A suffix is ordered by its first ``depth`` bytes only, most significant digit first, and a group that
has become a single suffix is left alone. Equal groups at full depth are the repeated windows. So that
the passes move few rows, the digits of a suffix's key are taken in this order:

1. the gram of 32 bytes with the least hash among those in the window (the first of equal ones). Suffixes
   that follow one another mostly share that gram at the same place, so one row stands for a run of them;
2. the bytes of the whole run. Runs that are equal make all their suffixes equal;
3. only in groups of digit 1 that hold different runs, and there once per different run: the bytes that
   16 neighbouring windows, counted from the gram, have in common;
4. all bytes of those 16 windows. Blocks that are equal make all their suffixes equal;
5. only in groups of digit 3 that hold different blocks: the bytes of each window.

Whatever the order of digits, two suffixes have all digits equal exactly if their windows are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import U64, Steps, Texts, batch, map_slices, own_ids

DEPTH = 200
GRAM = 32
# Bytes of text handled at once; longer texts are cut with an overlap of one byte less than a window.
SEGMENT = 1 << 18
_PLACE_BITS = 20
_PLACE = U64((1 << _PLACE_BITS) - 1)
# Bytes of text at once where a text may give a row per window.
FINE_BYTES = 1 << 18
# Neighbouring windows that share a digit.
BLOCK = 16
# A run's first byte, its number of windows and the gram's place in it, in one long: 32, 16 and 16 bits.
_HALF = 16
_LOW = (1 << _HALF) - 1
_A, _B, _C, _D = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0xD6E8FEB86659FD93)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes that start at each place."""
    n = len(data) - 7
    code = np.lib.stride_tricks.as_strided(data, (n, 8), (1, 1)).copy().view(U64).ravel()
    code *= _A
    code ^= code >> U64(32)
    for step, factor in ((8, _B), (16, _C)):
        wide = code[:-step] * factor
        wide += code[step:]
        wide ^= wide >> U64(29)
        code = wide
    code *= _D
    code ^= code >> U64(32)
    return code


def _least_places(code: np.ndarray, width: int) -> np.ndarray:
    """For each place the first place of the least hash (upper bits) among ``width`` places from there on."""
    least = (code & ~_PLACE) | np.arange(len(code), dtype=U64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (least & _PLACE).astype(np.int64)


def _segments(texts: Texts, depth: int):
    """(rows, first byte of each in the piece, first window start in its text, bytes) of pieces of about SEGMENT bytes.

    Short texts share a piece. A long text is cut so that each of its windows lies in one piece.
    """
    group: list[tuple[int, int, int, int]] = []
    size = 0
    for row, (start, end) in enumerate(zip(texts.starts.tolist(), texts.ends.tolist(), strict=True)):
        at = start
        while end - at >= depth:
            stop = min(end, at + SEGMENT)
            group.append((row, at, stop, at - start))
            size += stop - at
            if size >= SEGMENT:
                yield group
                group, size = [], 0
            if stop == end:
                break
            at = stop - depth + 1
    if group:
        yield group


def _runs(texts: Texts, depth: int):
    """Runs of windows with one least gram: (data of the piece, row, start in the text, windows, start in the piece, gram place, gram hash)."""
    for group in _segments(texts, depth):
        data = np.concatenate([texts.data[a:b] for _, a, b, _ in group]) if len(group) > 1 else texts.data[group[0][1] : group[0][2]]
        data = np.ascontiguousarray(data)
        sizes = np.array([b - a for _, a, b, _ in group])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        code = _gram_hashes(data)
        place = _least_places(code, depth - GRAM + 1)
        windows = sizes - depth + 1
        # Number the windows of all texts of the piece through, then cut where the gram's place or the text changes.
        total = int(windows.sum())
        owner = np.repeat(np.arange(len(group)), windows)
        at = np.arange(total) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
        gram = place[at]
        cut = np.ones(total, bool)
        cut[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(cut)
        length = np.diff(np.append(first, total))
        own, begin, spot = owner[first], at[first], gram[first]
        rows = np.array([g[0] for g in group])
        offset = np.array([g[3] for g in group])
        yield data, rows[own], offset[own] + (begin - starts[own]), length, begin, spot, code[spot]


def _run_digest(data: memoryview, begin: int, length: int, spot: int, depth: int) -> int:
    """Signed 64-bit digest of all bytes of a run and of the gram's place in it."""
    return xxhash.xxh3_64_intdigest(data[begin : begin + length + depth - 1], spot - begin) - (1 << 63)


def _grams(rows: DataFrame, depth: int) -> DataFrame:
    """The gram hash of every run."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [r[-1] for r in _runs(Texts.of(piece.column("text")), depth)]
        return batch(gram=np.concatenate(found).view(np.int64)) if found else None

    return map_slices(rows.select("text"), run, "gram long")


def _run_rows(rows: DataFrame, depth: int) -> DataFrame:
    """(gram, digest, id, pos) of every run; pos holds its first byte in the text, its number of windows and the gram's place."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for data, row, start, length, begin, spot, code in _runs(Texts.of(piece.column("text")), depth):
            view = memoryview(data)
            digest = np.fromiter(
                (_run_digest(view, b, n, s, depth) for b, n, s in zip(begin.tolist(), length.tolist(), spot.tolist(), strict=True)), np.int64, len(begin)
            )
            for column, value in zip(out, (code.view(np.int64), digest, row, (start << 2 * _HALF) | (length << _HALF) | (spot - begin)), strict=True):
                column.append(value)
        if not out[0]:
            return None
        return batch(
            gram=np.concatenate(out[0]), digest=np.concatenate(out[1]), id=piece.column("id").take(pa.array(np.concatenate(out[2]))), pos=np.concatenate(out[3])
        )

    return map_slices(rows, run, f"gram long, digest long, id {rows.schema['id'].dataType.simpleString()}, pos long")


def _block_rows(asked: DataFrame, depth: int) -> DataFrame:
    """(gram, digest, core, block, id, at, place) of the blocks of the runs asked for.

    ``asked`` has id, text and runs (gram, digest, pos). Blocks are numbered from the gram backwards, so that
    equal windows lie in blocks of one number. core: what all windows of that number have in common; block: the
    bytes of those windows that the run has; at: where the first of them starts in the text; place: its number
    in the run and how many there are.
    """
    core_size = depth - BLOCK + 1

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts.of(piece.column("text"))
        view = memoryview(np.ascontiguousarray(texts.data))
        digest = xxhash.xxh3_64_intdigest
        owner, grams, digests, cores, blocks, ats, places = ([] for _ in range(7))
        for row, (base, runs) in enumerate(zip(texts.starts.tolist(), piece.column("runs").to_pylist(), strict=True)):
            for r in runs:
                start, length, spot = r["pos"] >> 2 * _HALF, r["pos"] >> _HALF & _LOW, r["pos"] & _LOW
                gram = base + start + spot
                for number in range((spot - length + 1) // BLOCK, spot // BLOCK + 1):
                    first, last = max(0, spot - number * BLOCK - BLOCK + 1), min(length - 1, spot - number * BLOCK)
                    begin = gram - number * BLOCK
                    owner.append(row)
                    grams.append(r["gram"])
                    digests.append(r["digest"])
                    cores.append(digest(view[begin : begin + core_size], number))
                    blocks.append(digest(view[base + start + first : base + start + last + depth], spot - first))
                    ats.append(start + first)
                    places.append(first << _HALF | (last - first + 1))
        return batch(
            gram=np.array(grams, np.int64),
            digest=np.array(digests, np.int64),
            core=np.array(cores, U64).view(np.int64),
            block=np.array(blocks, U64).view(np.int64),
            id=piece.column("id").take(pa.array(owner, pa.int64())),
            at=np.array(ats, np.int64),
            place=np.array(places, np.int32),
        )

    kind = asked.schema["id"].dataType.simpleString()
    return map_slices(asked, run, f"gram long, digest long, core long, block long, id {kind}, at long, place int", limit=FINE_BYTES)


def _window_rows(asked: DataFrame, depth: int) -> DataFrame:
    """(gram, window, core, block, i) of every window of the blocks asked for; ``asked`` has text and blocks."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts.of(piece.column("text"))
        view = memoryview(np.ascontiguousarray(texts.data))
        keys: list[tuple[int, int, int]] = []
        sizes, windows = [], []
        for base, blocks in zip(texts.starts.tolist(), piece.column("blocks").to_pylist(), strict=True):
            for x in blocks:
                start, n = base + x["at"], x["place"] & _LOW
                keys.append((x["gram"], x["core"], x["block"]))
                sizes.append(n)
                windows += [xxhash.xxh3_64_intdigest(view[s : s + depth]) for s in range(start, start + n)]
        repeat = np.array(sizes, np.int64)
        gram, core, block = np.array(keys, np.int64).reshape(-1, 3).T
        return batch(
            gram=np.repeat(gram, repeat),
            window=np.array(windows, U64).view(np.int64),
            core=np.repeat(core, repeat),
            block=np.repeat(block, repeat),
            i=(np.arange(int(repeat.sum())) - np.repeat(np.cumsum(repeat) - repeat, repeat)).astype(np.int32),
        )

    return map_slices(asked, run, "gram long, window long, core long, block long, i int", limit=FINE_BYTES)


def _without(joined: DataFrame, depth: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) from id, text and spans of covered window starts [first, last]."""
    kind = joined.schema["id"].dataType.simpleString()

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for text, spans in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
            data = (text or "").encode()
            removed, kept, count, done = 0, [], 0, 0
            last_end = -1
            for s in sorted(spans or (), key=lambda s: s["first"]):
                start, end = max(s["first"], done), s["last"] + depth
                if s["first"] > last_end:
                    count += 1
                    kept.append(data[done:start])
                removed += max(0, end - start)
                done = last_end = max(done, end)
            kept.append(data[done:])
            rest = b"".join(kept)
            for column, value in zip(out, (len(data), removed, count, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                column.append(value)
        n_bytes, n_removed, n_spans = (pa.array(c, pa.int64()) for c in out[:3])
        return batch(id=piece.column("id"), n_bytes=n_bytes, n_removed=n_removed, n_spans=n_spans, kept_sha256=pa.array(out[3]), kept=pa.array(out[4], pa.binary()))

    return map_slices(joined, run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Remove every byte covered by a string of ``depth`` bytes that also starts anywhere else.

    One row per row of ``docs``: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept
    (the remaining bytes; a character may lose some of its bytes). Matches never cross documents; the same
    document counts, overlaps too; strings are judged on the input. ``depth`` must be over 48.

    Null and empty texts, and those shorter than ``depth``, lose nothing. Rows that repeat an id are
    documents of their own, and so are rows without id. Other columns are ignored.
    """
    steps = Steps(docs.sparkSession, "suffixes")
    rows, names, numbered = own_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), steps)
    # Written, so that the join reads plain exchanges, of which Spark splits those of a hot gram.
    many = steps.keep(_grams(rows, depth).groupBy("gram").count().where("count > 1").select("gram"))
    runs = steps.keep(_run_rows(rows, depth).join(many, "gram"))
    groups = steps.keep(runs.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "pos")).alias("one")))
    mixed = groups.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("gram")
    asked = groups.join(mixed, "gram").select("one.id", F.struct("gram", "digest", "one.pos").alias("run"))
    asked = asked.groupBy("id").agg(F.collect_list("run").alias("runs"))  # at most the runs of one text
    texts = steps.keep(rows.join(asked, "id"))

    blocks = steps.keep(_block_rows(texts, depth))
    kinds = steps.keep(
        blocks.groupBy("gram", "core", "block").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "at", "place")).alias("one"))
    )
    unlike = kinds.groupBy("gram", "core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("gram", "core")
    wanted = kinds.join(unlike, ["gram", "core"]).select("one.id", F.struct("gram", "core", "block", "one.at", "one.place").alias("item"))
    wanted = wanted.groupBy("id").agg(F.collect_list("item").alias("blocks"))  # at most the blocks of one text
    windows = steps.keep(_window_rows(texts.select("id", "text").join(wanted, "id").select("text", "blocks"), depth))
    steps.drop(texts)
    again = windows.groupBy("gram", "window").count().where("count > 1").select("gram", "window")
    partly = windows.join(again, ["gram", "window"]).groupBy("gram", "core", "block").agg(F.min("i").alias("low"), F.max("i").alias("high"))

    # The windows of a run start within less than a window of one another, so what its repeated windows
    # cover is one stretch, from the first of them to the last.
    size, first = F.col("place").bitwiseAND(F.lit(_LOW)), F.shiftright("place", _HALF)
    known = kinds.join(partly, ["gram", "core", "block"], "left").where("copies > 1 or low is not null")
    within = (
        blocks.select("gram", "digest", "core", "block", "place")
        .join(known.select("gram", "core", "block", "copies", "low", "high"), ["gram", "core", "block"])
        .groupBy("gram", "digest")
        .agg(
            F.min(first + F.when(F.col("copies") > 1, F.lit(0)).otherwise(F.col("low"))).alias("low"),
            F.max(first + F.when(F.col("copies") > 1, size - 1).otherwise(F.col("high"))).alias("high"),
        )
    )
    covered = groups.select("gram", "digest", "copies").join(within, ["gram", "digest"], "left").where("copies > 1 or low is not null")
    start, length = F.shiftright("pos", 2 * _HALF), F.shiftright("pos", _HALF).bitwiseAND(F.lit(_LOW))
    whole = F.col("copies") > 1
    spans = (
        runs.join(covered, ["gram", "digest"])
        .select(
            "id",
            F.struct(
                (start + F.when(whole, F.lit(0)).otherwise(F.col("low"))).alias("first"),
                (start + F.when(whole, length - 1).otherwise(F.col("high"))).alias("last"),
            ).alias("span"),
        )
        .groupBy("id")
        .agg(F.collect_list("span").alias("spans"))  # at most the runs of one text
    )
    spans = steps.keep(spans)
    steps.drop_all_but(spans, *([numbered] if numbered is not None else []))
    out = _without(rows.join(spans, "id", "left").select("id", "text", "spans"), depth)
    if names is not None:
        out = out.join(names, "id").drop("id").withColumnRenamed("name", "id")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
