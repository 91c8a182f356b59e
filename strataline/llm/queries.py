"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.collocations import top_collocations
from strataline.llm.common import held_out, table
from strataline.llm.conversations import conversation_report, damage, repair_conversations
from strataline.llm.decontaminate import scan_benchmark
from strataline.llm.language import fit_language, predict_language
from strataline.llm.merkle import compare_with_next
from strataline.llm.mixing import mix_sources
from strataline.llm.neardup import near_duplicates
from strataline.llm.pii import find_pii
from strataline.llm.quality import fit_quality, score_quality
from strataline.llm.spans import remove_repeated_spans
from strataline.llm.suffixes import remove_repeats
from strataline.llm.tokens import count_tokens
from strataline.llm.warc import read_warc, write_warc
from strataline.settings import work_folder

TOKENIZER = "byte_bpe_50k.json"


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = docs.select("doc_id", "text").join(labels.select("doc_id", "quality").where(~held_out(F.col("doc_id"))), "doc_id")
    scored = score_quality(docs, fit_quality(known))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, share=(85, 100))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("masked")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs, fit_language(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_report(repair_conversations(damage(table(spark, sf_dir, "conversations"))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(table(spark, sf_dir, "documents"))


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), work_folder(spark, "archive")
    write_warc(pages, folder)
    kind = pages.schema["page_id"].dataType
    found = read_warc(spark, folder, payloads=False)
    return found.select(
        F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_ranking,
        op2_merkle_fingerprints,
        op3_sentence_spans,
        op4_pfair_mixing,
        op5_suffix_dedup,
        op6_odd_sketches,
        op7_decontamination,
        op8_pii_spans,
        op9_language_id,
        op10_token_counts,
        op11_conversation_repair,
        op12_collocations,
        op13_warc_archive,
    )
}
SQL: dict[str, str] = {
    "op12_collocations": r"""
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang,
                translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
        ),
        p AS (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
        i AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM w WHERE len(words) > 0),
        g AS (
            SELECT lang, array_to_string(list_slice(words, pos, pos + m - 1), ' ') AS phrase
            FROM i, (VALUES (1), (2), (3), (4)) AS s(m) WHERE pos + m - 1 <= len(words)
        ),
        c AS (SELECT lang, phrase, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 30),
        f AS MATERIALIZED (SELECT lang, string_split(phrase, ' ') AS ws, f FROM c),
        total AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
        way AS MATERIALIZED (
            SELECT lang, ws, f AS a, k, list_slice(ws, 1, k) AS head, list_slice(ws, k + 1, len(ws)) AS tail
            FROM f, (VALUES (1), (2), (3)) AS s(k) WHERE len(ws) > k
        ),
        half AS MATERIALIZED (SELECT way.*, f.f AS l FROM way JOIN f ON f.lang = way.lang AND f.ws = way.head),
        cut AS (
            SELECT half.*, f.f AS r, CAST((2000000::HUGEINT * a) // (l + f.f) AS BIGINT) AS score
            FROM half JOIN f ON f.lang = half.lang AND f.ws = half.tail
        ),
        low AS (SELECT lang, ws, a, l, r, score, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS nth FROM cut),
        part AS (
            SELECT lang, list_slice(ws, x, x + m - 1) AS ws, max(f) AS f FROM f, (VALUES (2), (3)) AS s(m), (VALUES (1), (2), (3)) AS o(x)
            WHERE len(ws) > m AND x + m - 1 <= len(ws) GROUP BY ALL
        ),
        kept AS (
            SELECT low.lang, array_to_string(low.ws, ' ') AS phrase, a, l, r, score FROM low
            LEFT JOIN part ON part.lang = low.lang AND part.ws = low.ws
            WHERE nth = 1 AND NOT coalesce(100::HUGEINT * part.f >= 80::HUGEINT * a, false)
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
    "op13_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             s AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest, sha256(body) AS same FROM p),
             r AS (
                 SELECT *, row_number() OVER (PARTITION BY same ORDER BY page_id DESC NULLS LAST) AS nth,
                     first_value(page_id) OVER (PARTITION BY same ORDER BY page_id DESC NULLS LAST) AS best FROM s
             )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND nth > 1 THEN best END AS refers_to
        FROM r
    """,
}
