"""Token counts with a public tokenizer; huge texts are encoded as overlapping chunks and spliced (operator 10)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import SLICE_BYTES, Steps, map_slices
from strataline.settings import ship

# The split of byte-level BPE vocabularies of this kind. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
WIDEN = 4


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


class Encoder:
    """Counts tokens as the tokenizer file's own library does, special strings inside texts included.

    A .json file with plain byte-level BPE whose merges are in the order of their ids is
    encoded by rank (``splits`` is then true, and a white-space run after another letter is
    always a boundary, whatever stands around it). Any other file is left to its library.
    """

    def __init__(self, content: bytes):
        self.special: list[str] = []
        self.splits = False
        if content[:1] != b"{":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self._encode: Callable[[str], list[int]] = lambda text: model.encode(text)
            return
        spec = json.loads(content)
        ranks = self._ranks(spec)
        if ranks is None:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(content.decode())
            library.no_truncation()
            library.no_padding()
            self._encode = lambda text: library.encode(text, add_special_tokens=False).ids
            return
        import tiktoken

        self.splits = True
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._rank = tiktoken.Encoding(
            "own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]}
        )
        self._encode = self._by_rank

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE"
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and spec.get("normalizer") is None
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
            and all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        )
        if not plain:
            return None
        vocab, letters = model["vocab"], _byte_letters()
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        special = {t["content"] for t in spec["added_tokens"]}
        if any(a >= b for a, b in zip(merged, merged[1:])) or len(merged) + 256 != len(vocab.keys() - special):
            return None
        return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}

    def _by_rank(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self._rank.encode(text, allowed_special="all")
        return self._rank.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self._encode(text))

    def boundaries(self, text: str, first: int, last: int) -> tuple[list[int], list[int], int]:
        """Proven boundaries in characters [first, last) of a text, tokens before each, and tokens in all.

        Proven: a token ends there in this encoding, and an ASCII white-space character follows
        a character that is none. No alternative of the split goes on over that place, so it is
        a boundary in every encoding of a longer text in which no special string lies across it.
        """
        ids = self._encode(text)
        ends = np.cumsum([len(x) for x in self._rank.decode_tokens_bytes(ids)])
        at = [m.start() + 1 for m in re.finditer(r"[^\s](?=[ \n\t])", text[first:last + 1])]
        places = [first + a for a in at if first + a < last]
        before = len(text[:first].encode())
        out, counts = [], []
        for place, previous in zip(places, [first, *places]):
            before += len(text[previous:place].encode())
            i = int(np.searchsorted(ends, before))
            if i < len(ends) and ends[i] == before:
                out.append(place)
                counts.append(i + 1)
        return out, counts, len(ids)


@lru_cache(maxsize=2)
def _encoder(digest: str, load: Callable[[], bytes]) -> Encoder:
    return Encoder(load())


class _Shipped:
    """Tokenizer content on the executors: broadcast once, built once per worker."""

    def __init__(self, spark: SparkSession, content: bytes):
        self.value = spark.sparkContext.broadcast(content)
        self.digest = hashlib.sha256(content).hexdigest()

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Shipped) and self.digest == other.digest

    def __call__(self) -> bytes:
        return self.value.value

    def encoder(self) -> Encoder:
        return _encoder(self.digest, self)


def _count_small(docs: DataFrame, shipped: _Shipped, out: str) -> DataFrame:
    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        encoder = shipped.encoder()
        counts = [encoder.count(t) if t else 0 for t in rows.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(counts, pa.int64())], names=[*rows.schema.names[:-1], out])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return map_slices(docs, run, f"{schema}, `{out}` long")


def _encode_chunks(chunks: DataFrame, shipped: _Shipped, chunk: int, overlap: int) -> DataFrame:
    """(text_key, k, last, text) to tokens of the chunk and the boundaries in its two overlaps, in the text's own offsets."""
    schema = "text_key string, k long, total long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>"

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        encoder = shipped.encoder()
        margin = max(16, *(len(s) + 1 for s in encoder.special)) if encoder.special else 16
        columns: list[list] = [[] for _ in range(5)]
        for k, text in zip(rows.column("k").to_pylist(), rows.column("text").to_pylist(), strict=True):
            # What lies within the margin of the chunk's end may change with the text that follows.
            places, counts, total = encoder.boundaries(text, 1, len(text))
            base = k * chunk
            head = [(p + base, c) for p, c in zip(places, counts) if k and margin <= p < overlap]
            tail = [(p + base, c) for p, c in zip(places, counts) if chunk + margin <= p < len(text) - margin]
            for column, value in zip(columns, (total, [p for p, _ in head], [c for _, c in head], [p for p, _ in tail], [c for _, c in tail])):
                column.append(value)
        many = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [rows.column("text_key"), rows.column("k"), pa.array(columns[0], pa.int64()), *(pa.array(c, many) for c in columns[1:])],
            names=["text_key", "k", "total", "head", "head_n", "tail", "tail_n"],
        )

    return map_slices(chunks, run, schema)


def _cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(text_key, k, text) of the chunks, each with its overlap, in one pass over a text."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
            keys, numbers, parts = zip(*rows, strict=True)
            columns = [pa.array(keys, pa.string()), pa.array(numbers, pa.int64()), pa.array(parts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["text_key", "k", "text"])

        for piece in batches:
            waiting: list[tuple[str, int, str]] = []
            for key, text in zip(piece.column("text_key"), piece.column("text"), strict=True):
                name, whole = key.as_py(), text.as_py()
                for k, start in enumerate(range(0, len(whole), chunk)):
                    waiting.append((name, k, whole[start : start + chunk + overlap]))
                    if len(waiting) * (chunk + overlap) > SLICE_BYTES:
                        yield made(waiting)
                        waiting = []
            if waiting:
                yield made(waiting)

    return texts.select("text_key", "text").mapInArrow(run, "text_key string, k long, text string")


def _spliced(texts: DataFrame, shipped: _Shipped, chunk: int, overlap: int) -> DataFrame:
    """Tokens per text_key; null where two neighbours have no proven boundary in common."""
    cut = _cut(texts, chunk, overlap).groupBy("text_key", "k").agg(F.first("text").alias("text"))
    encoded = _encode_chunks(cut, shipped, chunk, overlap)
    # Border b lies between chunks b - 1 and b: each chunk hands its overlaps to the borders on both sides.
    none = F.lit(None).cast("array<long>")
    sides = encoded.select(
        "text_key",
        F.explode(
            F.array(
                F.struct(F.col("k").alias("border"), F.col("total"), F.lit(None).cast("long").alias("left_total"), "head", "head_n", none.alias("tail"), none.alias("tail_n")),
                F.struct((F.col("k") + 1).alias("border"), F.lit(None).cast("long").alias("total"), F.col("total").alias("left_total"), none.alias("head"), none.alias("head_n"), "tail", "tail_n"),
            )
        ).alias("side"),
    ).select("text_key", "side.*")
    borders = sides.groupBy("text_key", "border").agg(*(F.max(c).alias(c) for c in ("total", "left_total", "head", "head_n", "tail", "tail_n")))
    place = F.array_min(F.array_intersect("tail", "head"))
    extra = F.when((F.col("border") == 0) | F.col("total").isNull(), F.lit(0)).otherwise(
        F.col("left_total")
        - F.element_at("tail_n", F.array_position("tail", place).cast("int"))
        + F.element_at("head_n", F.array_position("head", place).cast("int"))
    )
    return borders.groupBy("text_key").agg(
        F.when(F.count(extra) == F.count(F.lit(1)), F.sum("total") - F.sum(extra)).alias("n_tokens")
    )


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    Texts of up to ``chunk_chars`` characters are encoded whole. Longer ones are cut every
    ``chunk_chars`` characters into chunks that reach ``overlap_chars`` into the next one,
    spread over all tasks, encoded with offsets and spliced where both neighbours have the same
    proven boundary. A text with a pair of neighbours that has none is done again with chunks
    and overlaps four times as long, at last whole. The vocabulary file is read on the driver
    and broadcast (its size is that of the file, whatever the data).

    Null and empty texts have no bytes and no tokens; repeated rows and null ids give a row each;
    other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as file:
        content = file.read()
    shipped = _Shipped(spark, content)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text")
    )
    finish = [F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")]
    if not Encoder(content).splits:
        return _count_small(rows, shipped, "n_tokens").select(*finish)
    is_long = F.coalesce(F.char_length("text"), F.lit(0)) > chunk_chars
    short = _count_small(rows.where(~is_long), shipped, "n_tokens")
    long_rows = rows.where(is_long).withColumn("text_key", F.sha2("text", 256))
    texts = long_rows.select("text_key", "text")
    steps, counts, chunk, overlap = Steps(spark, "tokens"), [], chunk_chars, overlap_chars
    while True:
        found = steps.keep(_spliced(texts, shipped, chunk, overlap))
        counts.append(found.where("n_tokens is not null"))
        failed = found.where("n_tokens is null").select("text_key")
        if failed.isEmpty():
            break
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
        texts = long_rows.join(failed, "text_key", "left_semi").select("text_key", "text")
    known = counts[0]
    for more in counts[1:]:
        known = known.unionByName(more)
    spliced = long_rows.drop("text").join(known, "text_key")
    return short.unionByName(spliced.drop("text_key")).select(*finish)
