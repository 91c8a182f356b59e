"""Small tables and brute-force counterparts shared by the tests."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Row
from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for columns of their own.
        *(T.StructField(c, T.StringType()) for c in ("id", "n", "score", "kept", "spans", "key", "code", "rank", "slot", "row_key")),
    ]
)
PROSE = "The quick brown fox jumps over the lazy dog. It was a fine day in May, and nobody minded. What else could one ask for? "
LONG = " ".join(f"word{i * i % 977} and{i % 31}." for i in range(12_000))


def edge_rows() -> list[tuple]:
    texts = [
        (1, PROSE * 3, "en", "a"),
        (2, PROSE * 3, "en", "a"),
        (2, PROSE * 3, "en", "a"),  # a repeated row
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, LONG, "en", None),
        (None, "no id at all, but some words in a row.", "de", "b"),
        (None, PROSE * 3, "en", "b"),
        (6, "1234 5678 !!! ...", None, "c"),
        (7, "ÄÖÜ ß 漢字 😀 é", "de", "c"),
        (7, "another text under the same id", "en", "c"),
        (8, "x", "fr", "a"),
    ]
    return [(i, t, lang, source, len(t or ""), *["clash"] * 10) for i, t, lang, source in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def docs_of(spark, texts: list[str | None], first: int = 0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)


def by_id(df, key: str = "doc_id") -> dict[int, Row]:
    rows = df.collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


def word_sets(texts: dict[int, str | None], words: int) -> dict[int, frozenset]:
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    return out


def linked_components(sets: dict[int, frozenset], num: int, den: int) -> dict[int, int]:
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


def repeated_bytes(texts: dict[int, str | None], depth: int) -> dict[int, bytearray]:
    seen: dict[bytes, int] = defaultdict(int)
    data = {i: (t or "").encode() for i, t in texts.items()}
    for b in data.values():
        for k in range(len(b) - depth + 1):
            seen[b[k : k + depth]] += 1
    out = {}
    for i, b in data.items():
        out[i] = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if seen[b[k : k + depth]] > 1:
                out[i][k : k + depth] = b"\1" * depth
    return out
