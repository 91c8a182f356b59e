"""A training corpus from raw documents: each stage works on what the one before it kept, read back from Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import Steps, held_out, join_unique, table
from strataline.llm.decontaminate import drop_contaminated
from strataline.llm.language import fit_language, keep_identified
from strataline.llm.mixing import mix_sources
from strataline.llm.neardup import near_duplicates
from strataline.llm.pii import mask_pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay. Learns from the documents' own labels, without the held-out ones."""
    return keep_identified(docs, fit_language(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id: five words, similarity 0.8 or more.

    Nothing but likeness removes a row: where an id is absent or repeated, the rows are numbered, written, and
    compared by number. Of a group's rows one with the least known id stays.
    """
    most, absent = docs.groupBy("doc_id").count().agg(F.max("count"), F.count_if(F.col("doc_id").isNull())).first()
    if (most or 0) <= 1 and not absent:
        gone = near_duplicates(docs, words=5, share=(4, 5)).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    steps = Steps(spark, "rows")
    numbered = steps.keep(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = near_duplicates(numbered, id_col="_row", words=5, share=(4, 5)).select("_row", "component_id")
    named = steps.keep(found.join(numbered.select("_row", "doc_id"), "_row"))
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "_row")
    groups = named.groupBy("component_id").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = steps.keep(groups.select("component_id", F.col("best._row").alias("_best"), "n"))
    gone = join_unique(named, groups, "component_id", F.col("n") * 1000 > named.count()).where("_row <> _best").select("_row")
    return numbered.join(gone, "_row", "left_anti").drop("_row")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words at least one in twenty lies in a benchmark window go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return mask_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order (mix_epoch, mix_slot, mix_position), sources at their target weights."""
    order = mix_sources(docs).select(
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_source"),
        F.col("epoch").alias("mix_epoch"),
        F.col("slot").alias("mix_slot"),
        F.col("position").alias("mix_position"),
    )
    own = docs.drop("mix_epoch", "mix_slot", "mix_position")
    joined = own.join(order, own["doc_id"].eqNullSafe(order["_id"]) & own["source"].eqNullSafe(order["_source"]))
    return joined.drop("_id", "_source")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("mix", mix),
]

# Similarity on full sets, trained models and regular matches with checks are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    steps = Steps(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = steps.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
