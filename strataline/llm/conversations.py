"""Repair of conversation structure: the cheapest edits that turn a conversation's roles into ``(s?(ua)+)?``.

A row's fault is the first of blank (nothing but white space), duplicate (its role and text came earlier in the
conversation) and truncated (its last character that is no white space ends no sentence). Rows become signs (a
role's initial, a capital if truncated, ``x`` if the row must go), and a conversation's signs its signature.

All signatures share one automaton. They are sorted by their reversed signs, so that suffixes meet: a node is a
distinct suffix, held once on the path from the end, and its cost to go and its best first edit are computed once
per grammar state for all conversations that end that way. Conversations longer than ``BLOCK`` rows are cut into
blocks of so many rows. A block's node has its costs for each state after the block, and one small fold per
conversation picks the states between blocks.

Ties need no comparison of whole audits: the edits of one row (insertions, then what becomes of the row) end in
exactly one letter other than ``I``, so of two different ones neither begins the other, and the ASCII-least audit
takes the least edits of the first row that differs.

Defined cases: nulls of role and text are one space; a role that does not begin with s, u or a (also an empty one)
cannot be kept; rows of one turn stand by role, by the first 64 characters of the text, then by its SHA-256; null
turns come first; rows without ``conv_id`` are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions.series import index_series
from strataline.llm.common import Steps, join_unique
from strataline.settings import ship

BLOCK = 256
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# Grammar states: nothing yet, after s, after u, after a. NEXT is the role each state can only go on with.
START, SYSTEM, USER, DONE = range(4)
NEXT = {START: "u", SYSTEM: "u", USER: "a", DONE: "u"}
AFTER = {"s": SYSTEM, "u": USER, "a": DONE}
ROLE = {"u": "user", "a": "assistant"}
SPACE = "\t\n\x0b\x0c\r "


# ---- the automaton


@cache
def _choices(sign: str) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """Per state the edits of one row: (cost, letters, state after it). More than two insertions lead nowhere new."""
    kept, cut = sign.lower(), TRUNCATED if sign.isupper() else 0
    out = []
    for state in range(4):
        found, at = [], state
        for inserted in range(3):
            letters, cost = "I" * inserted, INSERT * inserted
            found.append((cost + DELETE, letters + "D", at))
            if kept != "x":
                if kept == NEXT[at] or (kept == "s" and at == START):
                    found.append((cost + cut, letters + "K", AFTER[kept]))
                found.append((cost + REROLE + cut, letters + "R", AFTER[NEXT[at]]))
            at = AFTER[NEXT[at]]
        out.append(tuple(found))
    return tuple(out)


# A node: per state after the block (or the one end of a conversation) and per state before it, cost and letters.
Node = tuple[tuple[tuple[int, str] | None, ...], ...]
# At the end of a conversation: what completes it.
END: Node = (((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")),)
# At the end of a block: nothing, and only in the state itself.
BORDER: Node = tuple(tuple((0, "") if a == b else None for a in range(4)) for b in range(4))


def _node(sign: str, child: Node) -> Node:
    """The node of a suffix from the node of the suffix without its first sign."""
    out = []
    for target in child:
        row = []
        for options in _choices(sign):
            best = None
            for cost, letters, after in options:
                rest = target[after]
                if rest is not None:
                    found = (cost + rest[0], letters, rest[1])
                    if best is None or found[:2] < best[:2]:
                        best = found
            row.append(None if best is None else (best[0], best[1] + best[2]))
        out.append(tuple(row))
    return tuple(out)


MOVES = "array<struct<entry: int, exit: int, cost: long, audit: string>>"
_MOVES = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures in order of (last, reversed signs): the path of nodes from the end is kept, shared suffixes are not computed again."""
    path: list[Node] = []
    signs, kind = "", None
    for piece in batches:
        names, found = [], []
        for name, back, last in zip(*(piece.column(c).to_pylist() for c in ("signature", "back", "last")), strict=True):
            if kind != last:
                path, signs, kind = [END if last else BORDER], "", last
            shared = 0
            while shared < min(len(signs), len(back)) and signs[shared] == back[shared]:
                shared += 1
            del path[shared + 1 :]
            for sign in back[shared:]:
                path.append(_node(sign, path[-1]))
            signs = back
            names.append(name)
            found.append(
                [
                    {"entry": entry, "exit": -1 if last else target, "cost": best[0], "audit": best[1]}
                    for target, row in enumerate(path[-1])
                    for entry, best in enumerate(row)
                    if best is not None
                ]
            )
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found, _MOVES)], names=["signature", "moves"])


def solve_signatures(signatures: DataFrame) -> DataFrame:
    """(signature, moves) of distinct signatures; one that begins with ``|`` ends its conversation."""
    name = F.col("signature")
    last = name.startswith("|")
    rows = signatures.select(name, F.reverse(F.ltrim(name, F.lit("|"))).alias("back"), last.alias("last"))
    return rows.repartitionByRange("last", "back").sortWithinPartitions("last", "back").mapInArrow(_walk, f"signature string, moves {MOVES}")


def _fold(table: pa.Table) -> pa.Table:
    """Blocks of one conversation: the states between them, found from the last block backwards."""
    table = table.sort_by("block")
    go, picks = {-1: 0}, []  # the cost to go of each state after the block; per block and state before it the state after it
    for options in reversed(table.column("moves").to_pylist()):
        best: dict[int, tuple[int, str, int]] = {}
        for m in options:
            if m["exit"] in go:
                found = (m["cost"] + go[m["exit"]], m["audit"], m["exit"])
                best[m["entry"]] = min(found, best.get(m["entry"], found))
        picks.append({entry: found[2] for entry, found in best.items()})
        go = {entry: found[0] for entry, found in best.items()}
    state, entries, exits = START, [], []
    for pick in reversed(picks):
        entries.append(state)
        state = pick[state]
        exits.append(state)
    columns = [table.column("conv_key"), table.column("block"), pa.array(entries, pa.int32()), pa.array(exits, pa.int32())]
    return pa.Table.from_arrays(columns, names=["conv_key", "block", "entry", "exit"])


# ---- rows


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``: a row is dropped, emptied, cut, repeated or given to the user.

    Dropped rows stay with ``copies`` 0, so that their conversation is known; others have one or two copies.
    """
    absent = F.lit(" ")
    role, text = F.coalesce(F.col("role").cast("string"), absent), F.coalesce(F.col("text").cast("string"), absent)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), absent), F.lit(":"), F.coalesce(F.col("turn").cast("string"), absent))
    case = F.crc32(name.cast("binary")) % 20
    return rows.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )


def turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as they are, in the form that ``repair_conversations`` takes."""
    absent = F.lit(" ")
    return rows.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), absent).alias("role"),
        F.coalesce(F.col("text").cast("string"), absent).alias("text"),
        F.lit(1).alias("copies"),
    )


ORDER = ["turn", "role", "head", "digest"]


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"head": F.substring("text", 1, 64), "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256))})


def _copies(rows: DataFrame) -> DataFrame:
    return rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def _signed(rows: DataFrame, steps: Steps) -> DataFrame:
    """Rows without their texts: conversation, place, order, fault and sign.

    The first of equal rows is found by a minimum per conversation, role and text, which is combined before it is
    shuffled, and joined on the place, which is unique: no hot text or conversation gathers rows.
    """
    rest = F.rtrim("text", F.lit(SPACE))
    light = _copies(_ordered(rows)).select(
        F.struct("conv").alias("conv_key"), *ORDER, "copy", (F.length(rest) == 0).alias("blank"), (~F.substring(rest, -1, 1).isin(".", "!", "?")).alias("cut")
    )
    placed = steps.keep(index_series(light, ["conv_key"], [*ORDER, "copy"], out="place").withMetadata("place", {}))
    first = placed.groupBy("conv_key", "role", "digest").agg(F.min("place").alias("place")).select("conv_key", "place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    sign = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return placed.join(first, ["conv_key", "place"], "left").withColumn("fault", fault).withColumn("sign", sign)


def _pieces(rows: DataFrame, steps: Steps, block: int) -> DataFrame:
    """Per block of a conversation its order (that of its first row), faults, cost and audit."""
    signed = _signed(rows, steps).withColumn("block", F.floor(F.col("place") / block))
    part = F.array_sort(F.collect_list(F.struct("place", "sign", "fault")))
    blocks = signed.groupBy("conv_key", "block").agg(part.alias("p"), F.min_by(F.struct(*ORDER), "place").alias("at"))
    ends = signed.groupBy("conv_key").agg(F.max("block").alias("end"))
    # The last block of a conversation shares its nodes with last blocks only: they count to the end.
    marks = F.concat(F.when(F.col("block") == F.col("end"), "|").otherwise(""), F.array_join("p.sign", ""))
    blocks = steps.keep(
        blocks.join(ends, "conv_key").select(
            "conv_key", "block", "end", "at", marks.alias("signature"), F.transform("p.fault", lambda f: F.substring(f, 1, 1)).alias("faults")
        )
    )
    counted = blocks.groupBy("signature").agg(F.count(F.lit(1)).alias("blocks"))
    total = blocks.count()
    solved = steps.keep(solve_signatures(counted.select("signature")).join(counted, "signature"))
    found = join_unique(blocks, solved, "signature", F.col("blocks") * 1000 > total)
    chosen = F.filter("moves", lambda m: (m.entry == F.col("entry")) & (m.exit == F.col("exit")))[0]
    single = found.where("end = 0").withColumns({"entry": F.lit(START), "exit": F.lit(-1)})
    several = found.where("end > 0")
    kind = blocks.schema["conv_key"].dataType.simpleString()
    states = (
        several.select("conv_key", "block", "moves").groupBy("conv_key").applyInArrow(_fold, f"conv_key {kind}, block long, entry int, exit int")
    )
    cut = several.join(states, ["conv_key", "block"])
    columns = ["conv_key", "block", "at", "faults", "entry", "exit", "moves"]
    return single.select(*columns).unionByName(cut.select(*columns)).select(
        F.col("conv_key.conv").alias("conv"), "block", "at.*", chosen.cost.alias("cost"), chosen.audit.alias("audit"), F.array_join("faults", "|").alias("faults")
    )


LOG = "turn long, role string, text string, fault string, edit string, new_role string, cost long"
FAULT = {"": None, "b": "blank", "d": "duplicate", "t": "truncated"}


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and place, each block's audit before the block's first row: one row per edit.

    A conversation of which nothing is left after damage gives one row without edit.
    """
    conv, state, queue, fault, alive, kind = (), START, deque(), deque(), False, None
    out: list[tuple] = []

    def insert() -> None:
        nonlocal state
        role = NEXT[state]
        state = AFTER[role]
        out.append((conv[0], None, None, "", None, "I", ROLE[role], INSERT))

    def finish() -> None:
        if conv and not alive:
            out.append((conv[0], *[None] * 7))
        for letter in queue:  # what completes the conversation
            assert letter == "I"
            insert()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[] for _ in range(8)]
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = ["conv_id", *[c.split(" ")[0] for c in LOG.split(", ")]]
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        out.clear()
        return done

    for piece in batches:
        kind = piece.schema.field("conv").type
        held = 0
        names = ("conv", "turn", "role", "text", "audit", "faults", "copy")
        for key, turn, role, text, audit, faults, copy in zip(*(piece.column(c).to_pylist() for c in names), strict=True):
            if conv != (key,):
                finish()
                conv, state, queue, fault, alive = (key,), START, deque(), deque(), False
            if audit is not None:
                queue.extend(audit)
                fault.extend(faults.split("|"))
                continue
            if copy is None:
                continue
            alive = True
            while (letter := queue.popleft()) == "I":
                insert()
            named = FAULT[fault.popleft()]
            cost, new = DELETE, None
            if letter != "D":
                new = role if letter == "K" else ROLE[NEXT[state]]
                cost = (REROLE if letter == "R" else 0) + (TRUNCATED if named == "truncated" else 0)
                state = AFTER[new[0]]
            out.append((key, turn, role, text, named, letter, new, cost))
            held += len(text)
            if held > 4 << 20:
                yield flush()
                held = 0
        if out:
            yield flush()
    finish()
    if out:
        yield flush()


def repair_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per edit of each conversation, in order and conversations together: the row, its fault, what becomes of it.

    ``rows`` come from ``turns`` or ``damage``. ``edit`` is K, R, D or I; ``new_role`` the role after it (null: the row
    goes); ``cost`` what the edit costs. Texts are shuffled once, to their conversation, and stream through in order: a
    conversation of any length needs one block's audit in memory. Rows of a conversation are not spread further,
    as their order is the result.
    """
    ship(rows.sparkSession)
    steps = Steps(rows.sparkSession, "conversations")
    pieces = _pieces(rows, steps, block)
    absent = F.lit(None)
    texts = _ordered(rows).withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array(absent.cast("int")))))
    texts = texts.select("conv", *ORDER, "copy", F.lit(1).alias("kind"), "text", absent.cast("string").alias("audit"), absent.cast("string").alias("faults"))
    plans = pieces.select("conv", *ORDER, F.col("block").cast("int").alias("copy"), F.lit(0).alias("kind"), absent.cast("string").alias("text"), "audit", "faults")
    kind = rows.schema["conv"].dataType.simpleString()
    # Blocks whose first rows are equal stand in their own order, before those rows.
    both = texts.unionByName(plans).repartition("conv").sortWithinPartitions("conv", *ORDER, "kind", "copy")
    return both.select("conv", "turn", "role", "text", "audit", "faults", "copy").mapInArrow(_apply, f"conv_id {kind}, {LOG}")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    conv, out, kind = (), [], None
    counts: dict[str, int] = {}

    def finish() -> None:
        if conv:
            gaps = 0 if first is None else latest - first + 1 - distinct
            out.append((conv[0], gaps, *(counts.get(f, 0) for f in names[2:5]), illegal, cost, "".join(audit), sha.hexdigest()))

    def flush() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return done

    for piece in batches:
        kind = piece.schema.field("conv_id").type
        for key, turn, role, text, fault, edit, new, paid in zip(*(c.to_pylist() for c in piece.columns), strict=True):
            if conv != (key,):
                finish()
                conv, counts, audit, sha, before = (key,), {}, [], hashlib.sha256(), None
                illegal, cost, distinct, first, latest, empty = 0, 0, 0, None, None, True
            if edit is None:
                continue
            audit.append(edit)
            cost += paid
            if edit != "I":
                if fault is not None:
                    counts[fault] = counts.get(fault, 0) + 1
                if before is not None and before + role[:1] not in ("su", "ua", "au"):
                    illegal += 1
                before = role[:1]
                if turn is not None and turn != latest:
                    first, latest, distinct = turn if first is None else first, turn, distinct + 1
            if new is not None:
                sha.update(f"{'' if empty else chr(10)}{new}:{text}".encode())
                empty = False
        if out:
            yield flush()
    finish()
    if out:
        yield flush()


def conversation_report(log: DataFrame) -> DataFrame:
    """Per conversation of a repair log: gaps of turns, faults, illegal neighbours, cost, audit and the repaired text's SHA-256.

    Reads the log as ``repair_conversations`` gives it, without a shuffle: the log's order must not be changed in between.
    """
    kind = log.schema["conv_id"].dataType.simpleString()
    columns = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return log.mapInArrow(_digest, f"conv_id {kind}, {columns}")
