"""Operators that compare documents with each other: fingerprints, spans, suffixes, near duplicates, mixing, and the pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import corpus_pipeline
import pytest
from cases import (
    PROSE,
    SF_DIR,
    by_id,
    docs_of,
    documents,
    edge_docs,
    edge_rows,
    empty_docs,
    linked_components,
    repeated_bytes,
    word_sets,
)
from pyspark.sql import functions as F

from strataline.llm import graph, mixing, neardup
from strataline.llm.common import Steps
from strataline.llm.graph import components
from strataline.llm.merkle import compare_with_next, fingerprint
from strataline.llm.spans import remove_repeated_spans
from strataline.llm.suffixes import remove_repeats

WORDS = [f"{a}{b}" for a in "ba ko re mi su to la ne".split() for b in "n r s t l m".split()]


def prose(pick: random.Random, n: int) -> str:
    out = []
    while n > 0:
        size = min(n, pick.randint(4, 12))
        out.append(" ".join(pick.choice(WORDS) + pick.choice(WORDS) for _ in range(size)).capitalize() + ".")
        n -= size
    return " ".join(out)


# ---- fingerprints


def test_fingerprints_against_strings(spark):
    docs = documents(spark)
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    found = by_id(compare_with_next(docs))
    roots: dict[str, str] = {}
    for i, (key, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        room = len(text) // 3
        edited = text[: len(text) - room] + after[:room]
        row = found[key]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for t, root in ((text, row.fingerprint), (edited, row.edited_fingerprint)):
            assert roots.setdefault(t, root) == root
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        assert (row.first_paragraph is None) == (text == edited)
    assert len(set(roots.values())) == len(roots)
    rows = [r for r in found.values() if r.n_chars > 300]
    assert sum(r.near_edited for r in rows) / len(rows) > 0.5 > 5 * sum(r.near_next for r in rows) / len(rows)


def test_fingerprint_locates_an_edit(spark):
    lines = [f"paragraph {i} says so. And {i * 7} more." for i in range(60)]
    other = [*lines[:30], "a changed one.", *lines[31:]]
    a, b = (fingerprint(docs_of(spark, ["\n".join(x)])).first() for x in (lines, other))
    assert a.fingerprint != b.fingerprint
    assert [i for i, (x, y) in enumerate(zip(a.paragraphs, b.paragraphs, strict=True)) if x != y] == [30]
    assert len(set(a.sections) - set(b.sections)) <= 2 and len(a.sections) > 3


def test_fingerprint_edges(spark):
    rows = compare_with_next(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    empty = {r.fingerprint for r in rows if r.n_chars == 0}
    assert len(empty) == 1 and {r.doc_id for r in rows if r.n_chars == 0} == {3, 4}
    assert compare_with_next(empty_docs(spark)).collect() == []
    alone = compare_with_next(docs_of(spark, ["abcdef"])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


# ---- sentence spans


def test_passages_are_removed_and_clean_texts_stay(spark):
    pick = random.Random(5)
    passage = prose(pick, 55)
    alone = [prose(pick, 150) for _ in range(12)]
    texts = [*alone, f"{alone[0]} {passage}", f"{prose(pick, 60)} {passage} {prose(pick, 40)}", passage, passage.upper(), f"{passage}\n{passage}"]
    found = by_id(remove_repeated_spans(docs_of(spark, texts)))
    assert all(found[i].n_removed == 0 and found[i].text == texts[i] for i in range(12))
    # The first to hold the passage keeps it, though what it copies from document 0 goes.
    assert found[12].text.strip() == passage
    assert passage not in found[13].text and found[13].n_removed == passage.count(".")
    assert found[14].text == "" and found[15].text == "" and found[16].text == ""


def test_unpunctuated_passages(spark):
    pick = random.Random(9)
    stream = lambda n: " ".join(pick.choice(WORDS) + pick.choice(WORDS) for _ in range(n))
    passage = stream(90)
    texts = [f"{stream(70)} {passage} {stream(50)}", f"{stream(33)} {passage} {stream(61)}"]
    found = by_id(remove_repeated_spans(docs_of(spark, texts)))
    assert found[0].text == texts[0]
    left = found[1].text.split()
    assert sum(w in set(passage.split()) for w in left) < 184 and len(left) <= 33 + 61 + 45


@pytest.mark.parametrize("vocabulary", [48, 2000])
def test_every_unpunctuated_passage_of_over_fifty_words_is_found(spark, vocabulary):
    pick = random.Random(vocabulary)
    known = WORDS if vocabulary == 48 else [f"{a}{b}" for a in WORDS for b in WORDS][:vocabulary]
    stream = lambda n: " ".join(pick.choice(known) for _ in range(n))
    texts = []
    for i in range(400):
        passage = stream(51)
        texts += [f"{stream(pick.randint(20, 90))} {passage} {stream(pick.randint(20, 90))}" for _ in range(2)]
    line = "so it goes and so it went " * 8  # over fifty words, few of them distinct
    texts += [f"{stream(9)}.\n{line}\n{stream(12)}.", f"{stream(14)}.\n{line}\n{stream(7)}."]
    found = by_id(remove_repeated_spans(docs_of(spark, texts)))
    assert [i for i in range(1, len(texts), 2) if not found[i].n_removed] == []
    for i in range(1, 801, 2):
        gone = len(texts[i].split()) - len(found[i].text.split())
        assert 20 <= gone <= 51


def test_span_edges(spark):
    rows = remove_repeated_spans(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    # PROSE * 3 stands in four rows: one keeps its first part, the rest lose all.
    kept = sorted(len(r.text) for r in rows if r.n_sentences and r.n_sentences == PROSE.count(".") * 3 + 3 and r.n_removed)
    assert len(kept) == 4 and kept[:3] == [0, 0, 0] and kept[3] >= len(PROSE)
    assert [r.text for r in rows if r.doc_id == 3] == [None]
    assert remove_repeated_spans(empty_docs(spark)).collect() == []


# ---- suffixes


def check_bytes(spark, texts: dict[int, str | None], docs, depth: int):
    found = by_id(remove_repeats(docs, depth=depth))
    for i, flags in repeated_bytes(texts, depth).items():
        data = (texts[i] or "").encode()
        kept = bytes(b for b, f in zip(data, flags, strict=True) if not f)
        spans = sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
        row = found[i]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256, bytes(row.kept)) == (
            len(data), sum(flags), spans, hashlib.sha256(kept).hexdigest(), kept,
        ), i


def test_repeated_bytes_of_documents(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    check_bytes(spark, texts, documents(spark), 200)


@pytest.mark.parametrize("depth", [50, 64, 200])
def test_repeated_bytes_of_hard_texts(spark, depth, monkeypatch):
    pick = random.Random(depth)
    base = prose(pick, 400)
    texts = ["a" * 1000, "ab" * 300 + "x" + "ab" * 150, base, base[17:900] + "é" + base[901:], "ä" * 130, None, "", base[:199], base[:200]]
    texts += [base[:k] + pick.choice("xyz") + base[k + pick.randint(0, 3) :] for k in (100, 300, 301, 1500)]
    texts += [base[100:100 + depth] + "#" + base[500:500 + depth - 1], base[700:700 + depth + 1][::-1]]
    check_bytes(spark, dict(enumerate(texts)), docs_of(spark, texts), depth)


def test_repeated_bytes_across_segments(spark):
    from strataline.llm import suffixes

    pick = random.Random(2)
    long = prose(pick, 60_000)  # more than one segment
    assert len(long) > suffixes.SEGMENT
    texts = [long, long[suffixes.SEGMENT - 400 : suffixes.SEGMENT + 400], long[1000:1400]]
    check_bytes(spark, dict(enumerate(texts)), docs_of(spark, texts), 200)


def test_suffix_edges(spark):
    rows = remove_repeats(edge_docs(spark)).collect()
    assert Counter(str(r.doc_id) for r in rows) == Counter(str(r[0]) for r in edge_rows())
    assert all(r.n_removed == r.n_bytes for r in rows if r.n_bytes == len(PROSE * 3))
    assert remove_repeats(empty_docs(spark)).collect() == []


# ---- near duplicates


@pytest.mark.parametrize(("words", "share"), [(3, (85, 100)), (5, (4, 5))])
def test_near_duplicates_of_documents(spark, words, share):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    sets = word_sets(texts, words)
    want = linked_components(sets, *share)
    found = by_id(neardup.near_duplicates(documents(spark), words=words, share=share))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}


@pytest.mark.parametrize("block", [512, 8])
def test_large_groups_of_near_copies(spark, block, monkeypatch):
    """Near copies around the threshold: many components inside one group of buckets, compared in blocks of any size."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    pick = random.Random(11)
    base = prose(pick, 160).split()
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(pick.choice((1, 3, 5, 8, 12))):
            own[pick.randrange(len(own))] = pick.choice(WORDS) + "x"
        texts.append(" ".join(own))
    texts += [prose(pick, 40) for _ in range(40)] + texts[:20]
    sets = word_sets(dict(enumerate(texts)), 3)
    want = linked_components(sets, 85, 100)
    assert len({want[i] for i in range(150)}) > 3
    found = by_id(neardup.near_duplicates(docs_of(spark, texts), words=3, share=(85, 100)))
    assert {i: r.component_id for i, r in found.items()} == want


def test_links_among_thousands_of_like_documents(spark, monkeypatch):
    """Documents made of lines that many others hold too, similar at about a third: buckets are full of strangers, one of which is the pivot."""
    monkeypatch.setattr(neardup, "SKETCH_BLOCK", 100, raising=False)
    pick = random.Random(23)
    own_words = lambda k: [pick.choice(WORDS) + pick.choice(WORDS) + pick.choice(WORDS) for _ in range(k)]
    lines = [own_words(10) for _ in range(60)]
    texts = [[w for i in sorted(pick.sample(range(60), 33)) for w in lines[i]] for _ in range(8000)]
    pairs = [(2 * i, 2 * i + 1) for i in range(150)]
    for a, b in pairs:
        texts[b] = texts[a][:-22] + own_words(22)
    sets = word_sets({i: " ".join(t) for i, t in enumerate(texts)}, 3)
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(a, b) >= 0.85 for a, b in pairs)
    assert all(0.15 < alike(a, a + 101) < 0.6 for a in range(300, 7800, 7))
    found = by_id(neardup.near_duplicates(docs_of(spark, [" ".join(t) for t in texts]), words=3, share=(85, 100)))
    assert [(a, b) for a, b in pairs if found[b].component_id != a] == []
    assert sum(not r.kept for r in found.values()) == len(pairs)


def test_near_duplicate_edges(spark):
    rows = neardup.near_duplicates(edge_docs(spark), words=3, share=(85, 100)).collect()
    assert len(rows) == len(edge_rows())
    found = {(r.doc_id, r.n_shingles): r for r in rows}
    assert all(r.component_id == 1 for r in rows if r.doc_id in (1, 2))
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert all(r.n_shingles == 0 and r.kept and r.component_id == r.doc_id for r in rows if r.doc_id in (3, 4))
    assert {r.component_id for r in rows if r.doc_id == 7} == {7} and (8, 1) in found
    assert neardup.near_duplicates(empty_docs(spark)).collect() == []


def test_sketch_estimates_high_similarities(spark):
    import numpy as np

    pick = np.random.default_rng(4)
    worst = 0.0
    for share in (0.8, 0.85, 0.9, 0.95):
        for _ in range(20):
            both = pick.integers(0, 2**63, 2000, dtype=np.uint64)
            cut = int(round(2000 * share))
            rest = (2000 - cut) // 2
            a, b = both[: cut + rest], np.concatenate([both[:cut], both[cut + rest :]])
            x, y = (neardup.odd_sketch(neardup.min_samples(s)).view(np.uint64) for s in (a, b))
            z = int(np.bitwise_count(x ^ y).sum())
            assert z <= neardup.most_apart(share)
            worst = max(worst, abs(neardup.estimate(z) - share))
    assert worst < 0.12


@pytest.mark.parametrize("few", [300_000, 0])
@pytest.mark.parametrize("kind", ["int", "short", "long", "string", "date", "decimal(20,0)"])
def test_ids_of_any_type(spark, monkeypatch, kind, few):
    """Both ways of contracting links keep the type of the ids."""
    monkeypatch.setattr(graph, "FEW", few)
    numbered = docs_of(spark, [PROSE * 3, PROSE * 3 + "End.", PROSE * 3 + "The end.", "something else entirely, of no other kind"], first=1)
    ids = numbered.select((F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")) if kind == "date" else F.col("doc_id").cast(kind)).alias("doc_id"), "text")
    found = neardup.near_duplicates(ids)
    assert dict(found.dtypes)["component_id"] == dict(ids.dtypes)["doc_id"]
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    assert [r.kept for r in rows] == [True, False, False, True]
    assert rows[0].component_id == rows[1].component_id == rows[2].component_id == rows[0].doc_id


def test_texts_that_share_an_id_stay_unless_alike(spark):
    rows = [(1, PROSE * 3), (1, "quite another text that nobody else has, of more than five words"), (2, PROSE * 3), (None, PROSE * 3), (None, None), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit("x")).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(["None", "None", PROSE * 3, rows[1][1]])


def test_components_of_a_long_chain(spark):
    n = 300
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    links = [(a, b) for a, b in zip(ids, ids[1:])] + [(1000, 1001), (1001, 1000), (1002, 1002)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    found = {r.node: r.component for r in components(df, Steps(spark, "test")).collect()}
    assert found == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


# ---- mixing


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2, "c": 5}, {str(i): 1 + i * i for i in range(40)}, {"a": 1e-4, "b": 1.0}, {"x": 3}])
def test_period_meets_all_deadlines(weights):
    shares = mixing.period_shares(weights)
    period = sum(shares.values())
    line = mixing.pfair_period(shares)
    had = Counter()
    for name, j, slot in line:
        assert had[name] == j and j * period // shares[name] <= slot
        had[name] += 1
        assert all(abs(had[s] - shares[s] * (slot + 1) / period) < 1 for s in shares)
    assert had == shares


def test_mixed_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = {f"src{i}": 1 + i % 4 for i in range(20)}
    rows = sorted(mixing.mix_sources(docs, weights=weights, block=4).collect(), key=lambda r: r.position)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert len({r.position for r in rows}) == len(rows)
    slots = {r.slot: r.source for r in rows}
    assert sorted(slots) == list(range(len(slots)))
    total = sum(weights.values())
    had = Counter()
    for slot in range(len(slots)):
        had[slots[slot]] += 1
        assert all(abs(had[s] - (slot + 1) * w / total) < 1.2 for s, w in weights.items())  # weights are cut to slots of a period
    seen = Counter((r.doc_id, r.epoch) for r in rows)
    assert set(seen.values()) == {1}


@pytest.mark.parametrize("weights", [None, {"a": 0.7, "b": 0.299999, "c": 3e-5, None: 2**0.5}])
def test_order_keeps_to_the_true_weights(spark, weights):
    """Tens of thousands of slots: what one of them lacks must not add up."""
    from fractions import Fraction

    sizes = {"a": 30_000, "b": 1_700, "c": 1, None: 333}
    rows = [(n, s) for s, size in sizes.items() for n in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    order = mixing.mix_sources(docs, weights=weights, block=1).collect()
    line = [r.source for r in sorted(order, key=lambda r: r.slot)]
    assert sorted(r.slot for r in order) == list(range(len(line))) and len(line) > 30_000
    assert {(r.doc_id, r.source) for r in order} == set(rows)
    true = {s: Fraction(w) for s, w in (weights or {s: n**mixing.POWER for s, n in sizes.items()}).items()}
    total, had = sum(true.values()), Counter()
    for slot, source in enumerate(line):
        had[source] += 1
        if slot % 97 == 0 or slot > len(line) - 500:
            assert all(abs(had[s] - (slot + 1) * w / total) < 1 + 1e-9 for s, w in true.items())


def test_mixing_edges(spark):
    rows = mixing.mix_sources(edge_docs(spark)).collect()
    assert {(r.doc_id, r.source) for r in rows} == {(r[0], r[3]) for r in edge_rows()}
    assert mixing.mix_sources(empty_docs(spark)).collect() == []
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix_sources(edge_docs(spark), weights={"a": 1.0})
    only = mixing.mix_sources(edge_docs(spark), weights={"a": 1.0, "b": 0.0, "c": 0.0, None: 0.0}).collect()
    assert {r.source for r in only} == {"a"}


# ---- pipeline


def test_pipeline_against_its_operators(spark):
    import re

    import corpus_pipeline as p
    from test_rows import brute_hits

    from strataline.llm.pii import find_private, mask

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    names = [n for n, _ in p.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "pii", "mix"]
    texts = {r.doc_id: r.text for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    parent = linked_components(word_sets(texts, 5), 4, 5)
    kept = {i: t for i, t in texts.items() if parent[i] == i}
    clean = {h[0] for h in brute_hits(list(kept.items()), bench, 13) if not h[-1]}
    want = {}
    for i in clean:
        base, added = find_private(kept[i])
        want[i] = mask(kept[i], [(s, e, f"<{k}>") for k, s, e in (*base, *added)])
    rows = p.run(spark, SF_DIR).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert len({r.mix_position for r in rows}) == len(rows)


def test_every_stage_on_edge_rows(spark):
    import corpus_pipeline as p

    docs = edge_docs(spark)
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF_DIR)
        rows = out.collect()
        if name != "mix":
            assert out.columns == docs.columns, name
            assert len(rows) <= len(edge_rows())
        assert stage(spark, empty_docs(spark), SF_DIR).collect() == []
    # Both texts under id 7 stay; of the copies, the one without id goes like the others.
    ids = Counter(r.doc_id for r in p.near_dedup(spark, docs, SF_DIR).collect())
    assert ids == {1: 1, 3: 1, 4: 1, 5: 1, None: 1, 6: 1, 7: 2, 8: 1}
