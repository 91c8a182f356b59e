"""Phrase collocations against plain counting, with partitions and slices so small that everything crosses their ends."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from strataline.llm import collocations as module
from strataline.llm.collocations import collocations, top_collocations

from cases import LONG, PROSE, edge_docs, edge_rows, empty_docs

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=30, top=2000):
    """{(lang, rank, phrase, a, l, r, n, score)} from (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, f in counts.items():
        long = [p for p, n in f.items() if len(p) > 1 and n >= least]
        found = []
        for p in long:
            covered = any(
                len(q) > len(p) and 100 * f[q] >= 80 * f[p] and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in long
            )
            if not covered:
                cuts = [(2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def corpus(seed, n):
    pick = random.Random(seed)
    words = ["a", "b", "ab", "A", "\x00", "\x01", "\x08x", "ä", "漢", "the", "of", "new", "york", "city", "x" * 40, "x" * 41, "\x7f", "😀", "-", "'s"]
    weights = [9, 7, 5, 5, 2, 3, 2, 3, 3, 9, 9, 4, 4, 4, 3, 3, 1, 2, 2, 2]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(pick.randint(0, 60)):
            text += "new York City hall" if pick.random() < 0.1 else pick.choices(words, weights)[0]
            text += pick.choices([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "?", "\x0b", "\x0c"], [40, 3, 3, 2, 1, 1, 1, 1, 1, 1])[0]
        out.append((pick.choice(["en", "en", "en", "de", "und", None, "x\ty", ""]), text if pick.random() < 0.97 else None))
    return out


def frame(spark, rows):
    rows = [(lang, text, "clash", 1, 1, "clash", 1) for lang, text in rows]
    return spark.createDataFrame(rows, "lang string, text string, key string, n long, part int, phrase string, level int").repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_counting(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(module, "SLICE", 3000)
        monkeypatch.setattr(module, "BOUNDS_SHARE", 1)
        monkeypatch.setattr(module, "PART_BYTES", 1500)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rows = corpus(4, 600)
    try:
        found = rows_of(top_collocations(frame(spark, rows)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(rows)
    assert found == want and len(want) > 90


def test_limit_and_ties(spark):
    rows = [("en", f"w{i} v{i}. " * (30 + i % 3)) for i in range(40)]
    found = rows_of(top_collocations(frame(spark, rows), top=25))
    assert found == brute(rows, top=25) and len(found) == 25


def test_covered_by_the_middle_of_a_longer_phrase(spark):
    rows = [("en", "p q r s. " * 100 + "q r. " * 25 + "q r t. " * 30)]
    assert rows_of(top_collocations(frame(spark, rows))) == brute(rows)


def test_edges(spark):
    want = brute([(r[2], r[1]) for r in edge_rows()], least=2)
    assert rows_of(top_collocations(edge_docs(spark), least=2)) == want
    assert top_collocations(empty_docs(spark)).collect() == [] == collocations(frame(spark, [(None, None), ("en", "")])).collect()
    word = "y" * 300_000
    rows = [("en", f"{word} z " * 3), ("de", PROSE * 40), ("de", LONG)]
    assert rows_of(top_collocations(frame(spark, rows), least=3)) == brute(rows, least=3)
