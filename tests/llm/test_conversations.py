"""Conversation repair against exhaustive search and a plain dynamic programme that compares whole audits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from strataline.llm.conversations import conversation_report, damage, repair_conversations, turns
from strataline.llm.queries import op11_conversation_repair
from strataline.settings import GROUP_ROWS

from cases import SF_DIR

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        rest = text.rstrip(WHITE)
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired rows) by comparing whole audits; grammar states are the initials read so far."""
    grammar = re.compile(r"(s?(ua)+)?")
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = [dict() for _ in range(len(rows) + 1)]
    best[-1] = {"": (0, "", []), "a": (0, "", []), "u": (2, "I", [("assistant", "")]), "s": (4, "II", [("user", ""), ("assistant", "")])}
    for i in range(len(rows) - 1, -1, -1):
        _, role, text = rows[i]
        must, extra = faults[i] in ("blank", "duplicate"), int(faults[i] == "truncated")
        for start in ("", "s", "u", "a"):
            found, at, added = [], start, []
            for k in range(4):
                c, a, r = best[i + 1][at]
                found.append((2 * k + 3 + c, "I" * k + "D" + a, added + r))
                if not must:
                    if (at, role[:1]) in step:
                        c, a, r = best[i + 1][step[at, role[:1]]]
                        found.append((2 * k + extra + c, "I" * k + "K" + a, added + [(role, text)] + r))
                    for new in ("user", "assistant"):
                        if (at, new[0]) in step:
                            c, a, r = best[i + 1][step[at, new[0]]]
                            found.append((2 * k + 2 + extra + c, "I" * k + "R" + a, added + [(new, text)] + r))
                new = "assistant" if at == "u" else "user"
                added = [*added, (new, "")]
                at = step[at, new[0]]
            best[i][start] = min(found, key=lambda f: f[:2])
    cost, audit, repaired = best[0][""]
    assert grammar.fullmatch("".join(r[0][0] for r in repaired))
    return cost, audit, repaired


def exhaustive(rows, faults):
    """Every string of edits with up to two insertions between rows."""
    best = None
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    ops = []
    for (_, role, _), fault in zip(rows, faults, strict=True):
        extra = int(fault == "truncated")
        ops.append([("D", 3, "")] + ([] if fault in ("blank", "duplicate") else [("K", extra, role[:1] or "?"), ("R", 2 + extra, "u"), ("R", 2 + extra, "a")]))
    for put in itertools.product(gaps, repeat=len(rows) + 1):
        for picked in itertools.product(*ops):
            roles, audit, cost = "", "", 0
            for gap, op in itertools.zip_longest(put, picked):
                roles, audit, cost = roles + "".join(gap), audit + "I" * len(gap), cost + 2 * len(gap)
                if op:
                    roles, audit, cost = roles + op[2], audit + op[0], cost + op[1]
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def report(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).digest()))
    faults = faults_of(rows)
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, repaired = cheapest(rows, faults)
    if len(rows) <= 3:
        assert (cost, audit) == exhaustive(rows, faults)
    text = "\n".join(f"{r}:{t}" for r, t in repaired)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out[conv]
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        kept.extend([(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1))
    return out


def plain(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return out


def rows_of(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def frame(spark, rows, kind="long"):
    rows = [(*r, "clash", 1, "clash") for r in rows]
    return spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string, conv string, copies int, digest string").repartition(4)


TEXTS = ["Yes.", "No!", "Why?", "cut off", " ", "", "ok. \t\n", "x" * 70 + "1.", "x" * 70 + "2.", "a long one. " * 40]


def random_rows(n, seed):
    pick = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(pick.randint(0, 9)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"])
            place = None if pick.random() < 0.05 else turn + pick.choice([0, 0, 0, 0, 1, 3])
            out.append((conv, place, role, pick.choice(TEXTS) if pick.random() < 0.95 else None))
    return out


def test_query_equals_brute_force_on_the_table(spark):
    data = spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()
    found = op11_conversation_repair(spark, SF_DIR)
    want = {c: report(r) for c, r in damaged([tuple(r) for r in data]).items()}
    assert rows_of(found) == want


@pytest.mark.parametrize("block", [1, 3, 256])
def test_random_conversations(spark, block):
    rows = random_rows(150, 5)
    assert rows_of(conversation_report(repair_conversations(damage(frame(spark, rows)), block))) == {c: report(r) for c, r in damaged(rows).items()}
    assert rows_of(conversation_report(repair_conversations(turns(frame(spark, rows)), block))) == {c: report(r) for c, r in plain(rows).items()}


def test_long_conversation_and_hot_signature(spark):
    pick = random.Random(2)
    long = [(-1, i // 2, pick.choice(["user", "assistant", "system"]), f"{i % 700}{pick.choice('.x')}") for i in range(3000)]
    same = [(-2, 5, "user", "The same row.")] * 40
    usual = [(i, t, r, f"{i}.") for i in range(1500) for t, r in enumerate(["user", "assistant", "user"])]
    rows = [*long, *same, *usual]
    want = {c: report(r) for c, r in plain(rows).items()}
    assert rows_of(conversation_report(repair_conversations(turns(frame(spark, rows)), 16))) == want
    spark.conf.set(GROUP_ROWS, "500")
    try:
        assert rows_of(conversation_report(repair_conversations(turns(frame(spark, rows)), 16))) == want
    finally:
        spark.conf.unset(GROUP_ROWS)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_edges(spark, kind):
    rows = [
        (None, 1, "user", "no conversation."),
        (None, 1, "user", "no conversation."),
        (None, None, None, None),
        (1, None, "assistant", "only this."),
        (1, None, "user", "漢字 😀"),
        (2, 3, "System", "a capital."),
        (3, 0, "system", "alone."),
        (4, 0, "user", "x" * 300_000 + "."),
        (4, 9_000_000_000, "assistant", "far away."),
        (5, 0, "user", "line\nassistant:fake."),
    ]
    if kind == "string":
        rows = [(None if c is None else f"c{c}", *r) for c, *r in rows]
    for make, brute in ((damage, damaged), (turns, plain)):
        assert rows_of(conversation_report(repair_conversations(make(frame(spark, rows, kind))))) == {c: report(r) for c, r in brute(rows).items()}
    assert conversation_report(repair_conversations(damage(frame(spark, [], kind)))).collect() == []


def test_log_tells_every_edit(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "tool", "c"), (1, 3, "user", "")]
    log = repair_conversations(turns(frame(spark, rows))).collect()
    assert [(r.edit, r.role, r.new_role, r.fault, r.cost) for r in log] == [
        ("K", "user", "user", None, 0),
        ("I", None, "assistant", None, 2),
        ("K", "user", "user", None, 0),
        ("R", "tool", "assistant", "truncated", 3),
        ("D", "user", None, "blank", 3),
    ]
