"""Repeated runs of consecutive sentences (operator 3)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import U64, Steps, Texts, Words, powers_upto, batch, byte_table, find_words, flags, map_slices, mix, own_ids

# A span is the shortest run of at least so many sentences that has at least so many words.
RUN = 2
MIN_WORDS = 20
# A sentence of more words is also cut after the word with the least hash of every CUT consecutive ones, so
# that text without full stops has sentences that follow its content, of at most CUT words but for its ends.
# Two texts that share a passage of n words without marks share the cuts but for 2 CUT - 2 words at either
# end, so that n > 4 CUT + MIN_WORDS - 4 words hold a span for certain.
LONG_SENTENCE = 24
CUT = 8

_LOWER = byte_table()
_WORD = flags((48, 57), (65, 90), (97, 122), (128, 255))
_LINE, _STOP, _SPACE = flags((10, 10), (13, 13)), flags((33, 33), (46, 46), (63, 63)), flags((9, 13), (32, 32))


@dataclass
class Sentences:
    """Sentences of a slice: the first word of each, the text it belongs to, and per text its first and last sentence."""

    words: Words
    head: np.ndarray  # first word of each sentence
    size: np.ndarray  # words of each sentence
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _count(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])


def _cuts(code: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Words after which long sentences are cut: the last of the least in every CUT words of a sentence."""
    at = np.flatnonzero(np.bincount(number)[number] > LONG_SENTENCE)
    n = len(at) - CUT + 1
    if n <= 0:
        return at[:0]
    code, number = code[at], number[at]
    least, place = code[:n].copy(), np.arange(n)
    for i in range(1, CUT):
        lower = code[i : n + i] <= least
        least[lower] = code[i : n + i][lower]
        place[lower] = np.flatnonzero(lower) + i
    return at[place[number[:n] == number[CUT - 1 :]]]


def find_sentences(texts: Texts) -> Sentences:
    """Words are runs of letters, digits and non-ASCII characters; case is ignored. A sentence ends at a
    line end, or at a full stop, exclamation or question mark with white space before the next word."""
    data = _LOWER[texts.data]
    words = find_words(texts, data, _WORD)
    n = len(words.start)
    ends = np.ones(n, bool)
    if n > 1:
        line, stop, space = (_count(t, data) for t in (_LINE, _STOP, _SPACE))
        a, b = words.end[:-1], words.start[1:]
        ends[:-1] = (line[b] > line[a]) | ((stop[b] > stop[a]) & (space[b] > space[a])) | (words.text[1:] != words.text[:-1])
        number = np.concatenate([[0], np.cumsum(ends[:-1])])
        ends[_cuts(words.hash, number)] = True
    head = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1]) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(head, n))
    first, last = np.searchsorted(head, words.first), np.searchsorted(head, words.last)
    return Sentences(words, head, size, words.text[head] if n else head, first, last)


def find_spans(found: Sentences, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, number of sentences, two hashes) of every span: the shortest run from each sentence on
    that has enough sentences and words and, so that the last short sentences of a passage are covered too, the
    shortest one that ends with a sentence where no run from a sentence on does."""
    words, head = found.words, found.head
    if not len(head):
        return head, head, np.zeros(0, U64), np.zeros(0, U64)
    upto = np.append(head, len(words.hash))
    place = np.arange(len(head))
    # One past the last sentence: the first border with enough words after the head, and enough sentences.
    stop = np.maximum(np.searchsorted(upto, head + min_words), place + run)
    at = np.flatnonzero(stop <= found.last[found.text])
    stop = stop[at]
    ended = np.zeros(len(head) + 1, bool)
    ended[stop] = True
    back = np.minimum(np.searchsorted(upto, upto[1:] - min_words, side="right") - 1, place + 1 - run)
    more = np.flatnonzero(~ended[1:] & (back >= found.first[found.text]))
    at, stop = np.append(at, back[more]), np.append(stop, more + 1)
    power, inverse = powers_upto(len(words.hash) + 1)
    codes = []
    for salt in (U64(0), U64(0x9E3779B97F4A7C15)):
        total = np.zeros(len(words.hash) + 1, U64)
        np.cumsum(mix(words.hash ^ salt) * power[: len(words.hash)], out=total[1:])
        codes.append(mix((total[upto[stop]] - total[head[at]]) * inverse[head[at]]))
    return at, stop - at, codes[0], codes[1]


def _span_rows(rows: DataFrame, run: int, min_words: int, *, full: bool) -> DataFrame:
    """The first hash of every span; with ``full`` also the second one, the id and where the span lies."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = find_sentences(Texts.of(piece.column("text")))
        at, size, code, other = find_spans(found, run, min_words)
        if not full:
            return batch(code=code.view(np.int64))
        text = found.text[at] if len(at) else at
        return batch(
            code=code.view(np.int64),
            other=other.view(np.int64),
            id=piece.column("id").take(pa.array(text)),
            first=(at - found.first[text]).astype(np.int32) if len(at) else np.zeros(0, np.int32),
            size=size.astype(np.int32),
        )

    if not full:
        return map_slices(rows.select("text"), work, "code long")
    return map_slices(rows, work, f"code long, other long, id {rows.schema['id'].dataType.simpleString()}, first int, size int")


def _without(joined: DataFrame) -> DataFrame:
    kind = joined.schema["id"].dataType.simpleString()

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts.of(piece.column("text"))
        found = find_sentences(texts)
        begin = found.words.start[found.head] if len(found.head) else found.head
        kept, n_removed = [], []
        for i, (text, spans) in enumerate(zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True)):
            first, last = int(found.first[i]), int(found.last[i])
            gone = np.zeros(last - first, bool)
            for s in spans or ():
                gone[s["first"] : s["first"] + s["size"]] = True
            n_removed.append(int(gone.sum()))
            if not gone.any():
                kept.append(text)
                continue
            # Borders: what stands before the first sentence stays; a sentence reaches to the next one.
            borders = [*begin[first:last].tolist(), int(texts.ends[i])]
            data, parts = texts.data, [texts.data[texts.starts[i] : borders[0]].tobytes()]
            parts += [data[borders[k] : borders[k + 1]].tobytes() for k in np.flatnonzero(~gone)]
            kept.append(b"".join(parts).decode())
        return batch(
            id=piece.column("id"),
            n_sentences=(found.last - found.first).astype(np.int64),
            n_removed=np.array(n_removed, np.int64),
            text=pa.array(kept, pa.string()),
        )

    return map_slices(joined, work, f"id {kind}, n_sentences long, n_removed long, text string")


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """Remove the sentences covered by a span that occurs earlier: in a lower id, or before in the same text.

    One row per row of ``docs``: id, n_sentences, n_removed, text (what is left). Spans slide over the
    sentences: from each on, the shortest run of at least ``run`` sentences with ``min_words`` words; their
    words, without regard to case and signs, are hashed to 128 bits and joined over all documents. All
    spans that occur more than once lose every occurrence but the first.

    A null text stays null, texts without a span stay as they are. Rows that repeat an id, and rows without
    one, are documents of their own, in the order they are read. Other columns are ignored.
    """
    steps = Steps(docs.sparkSession, "spans")
    rows, names, numbered = own_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), steps)
    # Written, so that the joins read plain exchanges, of which Spark splits those of a hot span.
    many = steps.keep(_span_rows(rows, run, min_words, full=False).groupBy("code").count().where("count > 1").select("code"))
    spans = steps.keep(_span_rows(rows, run, min_words, full=True).join(many, "code"))
    first = steps.keep(spans.groupBy("code", "other").agg(F.min(F.struct("id", "first")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    gone = (
        spans.join(first.select("code", "other", "at"), ["code", "other"])
        .where((F.col("id") != F.col("at.id")) | (F.col("first") != F.col("at.first")))
        .groupBy("id")
        .agg(F.collect_list(F.struct("first", "size")).alias("spans"))  # at most the sentences of one text
    )
    gone = steps.keep(gone)
    steps.drop_all_but(gone, *([numbered] if numbered is not None else []))
    out = _without(rows.join(gone, "id", "left").select("id", "text", "spans"))
    if names is not None:
        out = out.join(names, "id").drop("id").withColumnRenamed("name", "id")
    return out.select(F.col("id").alias(id_col), "n_sentences", "n_removed", "text")
