"""Operators that judge each text on its own: tokens, personal data, benchmark windows, language, quality."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
from cases import LONG, PROSE, by_id, docs_of, documents, edge_docs, edge_rows, empty_docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataline.llm import language, quality
from strataline.llm.common import held_out
from strataline.llm.decontaminate import BenchmarkSet, drop_contaminated, scan_benchmark
from strataline.llm.pii import find_pii, find_plain, find_private, mask_pii
from strataline.llm.tokens import count_tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


# ---- tokens


def test_token_counts_are_those_of_the_library(spark, library):
    docs = documents(spark)
    found = by_id(count_tokens(docs, JSON, chunk_chars=600, overlap_chars=64))
    for row in docs.collect():
        assert found[row.doc_id].n_tokens == len(library.encode(row.text, add_special_tokens=False)), row.doc_id
        assert found[row.doc_id].n_bytes == len(row.text.encode())
        assert found[row.doc_id].over_limit == (found[row.doc_id].n_tokens > 512)


@pytest.mark.parametrize(
    "text",
    [
        "a" * 5000,  # no boundary anywhere: overlaps widen until the text is whole
        "<|endoftext|> x<|endoftext|>" * 400,
        "it's we'll they've  " * 300,
        " \n\t  \n " * 800,
        "漢字かな" * 700 + " " + "😀 é " * 500,
        "word  " * 900 + "<|endof" + "text|> " * 90,
        "12 345,678.90 -- ... !!! ?? " * 200,
    ],
)
def test_huge_texts_are_spliced_exactly(spark, library, text):
    found = count_tokens(docs_of(spark, [text]), JSON, chunk_chars=200, overlap_chars=40).first()
    assert found.n_tokens == len(library.encode(text, add_special_tokens=False))


def test_cutting_a_huge_text_takes_linear_time(spark):
    import time

    from strataline.llm.tokens import _cut

    def seconds(n):
        rows = docs_of(spark, ["漢 word " * (n // 7)]).select(F.col("doc_id").cast("string").alias("text_key"), "text")
        start = time.time()
        assert _cut(rows, 32_768, 512).agg(F.sum(F.char_length("text"))).first()[0] >= n - 7
        return time.time() - start

    seconds(1 << 20)
    assert seconds(16 << 20) < 6 * max(seconds(4 << 20), 0.5)


def test_other_tokenizers_are_left_to_their_library(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    other = public_tokenizers.path("word_bpe_49k.json")
    texts = [PROSE, "", "ÄÖ 漢字"]
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    words = Tokenizer.from_file(other)
    a = by_id(count_tokens(docs_of(spark, texts), model))
    b = by_id(count_tokens(docs_of(spark, texts), other))
    for i, t in enumerate(texts):
        assert a[i].n_tokens == len(pieces.encode(t))
        assert b[i].n_tokens == len(words.encode(t, add_special_tokens=False))


def test_token_edges(spark, library):
    rows = count_tokens(edge_docs(spark), JSON, chunk_chars=300, overlap_chars=64).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False))) for r in edge_rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert count_tokens(empty_docs(spark), JSON).collect() == []


# ---- personal data


def brute_plain(t: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m.group())
        s = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_plain_spans_are_those_of_the_patterns():
    pick = random.Random(3)
    for _ in range(30_000):
        t = "".join(pick.choice("ab1@..-+% (5 2") for _ in range(pick.randint(0, 30)))
        if pick.random() < 0.4:
            t = "".join(pick.choice("0123456789 -+.") for _ in range(pick.randint(10, 45)))
        assert find_plain(t) == brute_plain(t), t


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("x (at) y [dot] org", "email", "x (at) y [dot] org"),
        ("see pаypal@exаmple.com", "email", "pаypal@exаmple.com"),
        ("no ４１１１ 1111 1111 1111.", "card", "４１１１ 1111 1111 1111"),
        ("four" + " one" * 15, "card", "four" + " one" * 15),
        ("at 10[.]0[.]0[.]1 ok", "ip", "10[.]0[.]0[.]1"),
        ("jo​hn@mail.example.com", "email", "jo​hn@mail.example.com"),
    ],
)
def test_disguised_spans_map_back_to_the_source(text, kind, span):
    _, added = find_private(text)
    base, _ = find_private(text)
    assert any(k == kind and text[s:e] == span for k, s, e in (*base, *added))


FILLER = "Nothing else of note is said here, and so it goes on. " * 8


@pytest.mark.parametrize("span", ["john at example.com", "john @ example.com", "john@ example.com", "john.doe @example.co.uk", "john at mail.example.org"])
def test_written_addresses_alone_in_a_long_text(span):
    text = f"{FILLER}write to {span} or not. {FILLER}"
    base, added = find_private(text)
    assert base == [] and [(k, text[s:e]) for k, s, e in added][-1:] == [("email", span)] and len(added) == 1


@pytest.mark.parametrize("neighbour", ["", "x (at) y [dot] org "])
def test_an_address_is_found_whatever_stands_beside_it(neighbour):
    text = f"{FILLER}{neighbour}ask john at example.com. {FILLER}"
    assert "john at example.com" in [text[s:e] for _, s, e in find_private(text)[1]]


@pytest.mark.parametrize("text", ["We met at noon. The dot was red.", "One two three, go at once.", "look at me dot", PROSE, "un deux trois soleil"])
def test_plain_prose_has_no_personal_data(text):
    assert find_private(text) == ([], [])


PLACES = [
    "meet at booking.com",
    "call me at example.com",
    "look at github.io",
    "I bought it at ebay.co.uk yesterday",
    "profit at siemens.de",
    "contact us at example.com",
    "write to me at example.org",
    "she arrived at example.net. Then",
]
HIDDEN = [
    ("mail jane at example.ru today", "jane at example.ru"),
    ("contact: piet at example.be", "piet at example.be"),
    ("schreib an hans at beispiel.de", "hans at beispiel.de"),
    ("e-mail ana at correo.es or", "ana at correo.es"),
    ("jane (at) example.museum", "jane (at) example.museum"),
    ("we have jane at example dot ru", "jane at example dot ru"),
]


def test_precision_and_recall_of_a_bare_at():
    """None of the places is taken for an address, every address with a cue or another written sign is found."""
    for text in PLACES:
        assert find_private(f"{FILLER}{text}. {FILLER}") == ([], []), text
    for text, span in HIDDEN:
        whole = f"{FILLER}{text}. {FILLER}"
        base, added = find_private(whole)
        assert base == [] and [whole[s:e] for _, s, e in added] == [span], text


def test_long_addresses_are_found_whole():
    for local in ("q" * 300, "q" * 5000):
        for text, span in ((f"see {local} @ example.com.", f"{local} @ example.com"), (f"mail {local} [at] example.com", f"{local} [at] example.com")):
            assert [text[s:e] for _, s, e in find_private(text)[1]] == [span]
        text = f"x {local}@{'d' * 400}.example.com y"
        assert find_plain(text) == [("email", 2, len(text) - 2)]


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "a@" + "b" * n,
        lambda n: "a dot " * (n // 6),
        lambda n: "a.b" * (n // 3) + "@",
        lambda n: "one two " * (n // 8),
        lambda n: ("QWxhZGRpbjpvcGVuIHNlc2FtZQ" * (n // 26)) + "@x one two three four",
        lambda n: "mail a at b " * (n // 12),
        lambda n: "[.]" * (n // 3),
    ],
)
def test_hard_texts_take_linear_time(make):
    import time

    def seconds(n):
        text, start = make(n), time.process_time()
        find_private(text)
        return time.process_time() - start

    seconds(1000)
    assert seconds(400_000) < 6 * max(seconds(100_000), 0.05)


@pytest.mark.parametrize(
    "span",
    [
        "plus four four two zero seven nine four six zero one two three",
        "Plus vier neun drei null eins zwei drei vier fünf sechs",
        "más tres cuatro nueve uno uno dos tres cuatro cinco seis siete",
        "plus trois trois, un deux trois quatre cinq six sept huit",
    ],
)
def test_spelled_phones_map_back_to_the_source(span):
    text = f"{FILLER}call {span} today. {FILLER}"
    base, added = find_private(text)
    assert base == [] and [(k, text[s:e]) for k, s, e in added] == [("phone", span)]


@pytest.mark.parametrize("text", ["plus one two three four", "one plus one", "a plus: two, three, four, five", "surplus four four two zero seven nine four six zero one two"])
def test_a_plus_without_a_phone(text):
    assert find_private(text) == ([], [])


def test_pii_rows(spark):
    order = {k: i for i, k in enumerate(("email", "ip", "card", "phone"))}
    for row in documents(spark).join(find_pii(documents(spark)), "doc_id").collect():
        base = sorted(brute_plain(row.text), key=lambda s: (order[s[0]], s[1]))
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in order]
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))
    masked = mask_pii(docs_of(spark, ["write to a@b.cd, +1 (743) 555-3824", None])).orderBy("doc_id").collect()
    assert [r.text for r in masked] == ["write to <email>, <phone>", None]


def test_pii_edges(spark):
    rows = find_pii(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows()) and all(r.spans == "" for r in rows)
    same = mask_pii(edge_docs(spark))
    assert same.columns == edge_docs(spark).columns
    assert sorted(map(str, same.collect())) == sorted(map(str, edge_docs(spark).collect()))
    assert find_pii(empty_docs(spark)).collect() == []


# ---- benchmark windows


def brute_hits(docs: list[tuple], items: list[tuple], window: int) -> list[tuple]:
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    known: dict[tuple, set] = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if owners := known.get(tuple(w[i : i + n])):
                    found |= owners
                    hit[i : i + n] = [1] * n
        h = sum(hit)
        out.append((key, len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return out


@pytest.mark.parametrize("part_bytes", [32 << 20, 2_000])
def test_benchmark_hits(spark, part_bytes):
    docs, bench = documents(spark), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    bench = bench.unionByName(spark.createDataFrame([(900, "Rely on"), (901, None), (901, "..."), (902, "the")], bench.schema))
    got = scan_benchmark(docs, bench, part_bytes=part_bytes).drop("spans").collect()
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 13)
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(w[-1] for w in want)
    kept = drop_contaminated(docs, bench, part_bytes=part_bytes)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[-1])


@pytest.mark.parametrize("part_bytes", [32 << 20, 40])
def test_benchmark_edges(spark, part_bytes):
    bench = spark.createDataFrame([(1, "some words in a row"), (1, "the lazy dog"), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    got = scan_benchmark(edge_docs(spark), bench, part_bytes=part_bytes).drop("spans").collect()
    want = brute_hits([r[:2] for r in edge_rows()], [(1, "some words in a row"), (1, "the lazy dog")], 13)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert drop_contaminated(edge_docs(spark), bench, part_bytes=part_bytes).columns == edge_docs(spark).columns
    assert scan_benchmark(empty_docs(spark), bench).collect() == []
    assert not any(r.contaminated for r in scan_benchmark(edge_docs(spark), bench.limit(0)).collect())


def test_a_large_benchmark_is_compact_and_long_items_are_cut(spark):
    import pickle
    import time

    pick = random.Random(6)
    words = [f"w{i}" for i in range(30_000)]
    text = " ".join(pick.choice(words) for _ in range(700_000))  # 4 MB
    start = time.process_time()
    known = BenchmarkSet.of([("a", text), ("b", "two words")], 13)
    assert time.process_time() - start < 10 and len(pickle.dumps(known)) < 12 * len(text)
    inner = text.split()
    docs = docs_of(spark, [" ".join(inner[i : i + 14]) for i in (0, 40_000, 349_993, 699_986)] + ["has two words in it", "nothing"])
    bench = spark.createDataFrame([("a", text), ("b", "two words")], "item_id string, text string")
    whole, cut = (sorted(map(str, scan_benchmark(docs, bench, part_bytes=size).collect())) for size in (32 << 20, 1 << 20))
    assert whole == cut and sum("contaminated=True" in r for r in whole) == 5


# ---- language and quality, held out


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = held_out(F.col("doc_id"))
    model = language.fit_language(docs.where(~out))
    found = language.predict_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(out).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    edges = language.predict_language(edge_docs(spark), model).collect()
    assert len(edges) == len(edge_rows())
    assert {r.doc_id for r in edges if r.lang_pred == "und"} == {3, 4, 6}
    kept = language.keep_identified(edge_docs(spark), model, least=0.0)
    assert kept.columns == edge_docs(spark).columns and kept.count() == len(edge_rows()) - 3
    assert language.predict_language(empty_docs(spark), model).collect() == []


def test_a_rare_language_stays_in_the_sample(spark):
    pick = random.Random(8)
    words = {"aa": "kalo misu rena toba", "cc": "üöä éèê ñõã çßø"}
    text = lambda lang: " ".join(pick.choice(words[lang].split()) for _ in range(12))
    rows = [(i, lang, text(lang)) for i, lang in enumerate(["aa"] * 3000 + ["cc"] * 3)]
    rows += [(10_000 + i, "cc", "1234 !!") for i in range(2000)]  # nothing to learn from
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.fit_language(docs, sample_rows=100)
    assert model.languages == ["aa", "cc"]
    found = by_id(language.predict_language(docs_of(spark, [text("cc"), text("aa")]), model))
    assert [found[i].lang_pred for i in range(2)] == ["cc", "aa"]


def test_sample_level_keeps_the_bound():
    for counts in ([5, 10, 9000, 90_000], [6001], [3, 3], [2000] * 4, [1, 5000, 5000]):
        level = language._level(counts, 6000)
        assert sum(min(n, level) for n in counts) <= 6000 + 1e-6 and (sum(counts) <= 6000 or sum(min(n, level) for n in counts) > 5999)
    assert language._level([1000] * 1000, 6000) == language.LEAST_ROWS


def test_one_language_and_no_language(spark):
    one = language.fit_language(docs_of(spark, [PROSE, "more words"]).withColumn("lang", F.lit("xx")))
    assert [r.lang_pred for r in language.predict_language(docs_of(spark, [LONG]), one).collect()] == ["xx"]
    none = language.fit_language(empty_docs(spark))
    assert [r.lang_pred for r in language.predict_language(docs_of(spark, [LONG]), none).collect()] == ["und"]


def test_machines_without_features_agree_with_features():
    import numpy as np
    import pyarrow as pa

    from strataline.llm.common import Texts

    texts = Texts.of(pa.array(["Été à Zürich", "", None, "ab", "Q", PROSE]))
    weights = np.random.default_rng(1).normal(size=(3, 1 << language.BITS)).astype(np.float32)
    bias = np.array([0.5, -1.0, 0.0])
    assert np.allclose(language._margins(texts, weights, bias), language._frequencies(texts) @ weights.T + bias, atol=1e-3)


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = held_out(F.col("doc_id"))
    model = quality.fit_quality(docs.join(labels.select("doc_id", "quality"), "doc_id").where(~out))
    found = quality.score_quality(docs, model).join(labels, "doc_id").where(out).collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found)
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in found)
    edges = quality.score_quality(edge_docs(spark), model).collect()
    assert len(edges) == len(edge_rows()) and all(0 <= r.score <= 1 for r in edges)
    assert quality.score_quality(empty_docs(spark), model).collect() == []


def test_quality_without_both_labels(spark):
    docs = docs_of(spark, [PROSE, None]).withColumn("quality", F.lit(1))
    assert {round(r.score, 6) for r in quality.score_quality(docs, quality.fit_quality(docs)).collect()} == {0.7}
