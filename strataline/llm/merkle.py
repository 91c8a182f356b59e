"""Merkle fingerprints of documents over sections, paragraphs and sentences, in DataFrame functions only (operator 2).

The tree of a text: its paragraphs (each with its line feed) are grouped into sections. A section ends
with a paragraph whose leaves hash to 0 modulo 8, so an edit changes the sections around it and no later ones.
Paragraphs, sections and the root are SHA-256 digests, each over what is below it, so equal roots mean equal texts
at any number of documents; where roots differ, sections that differ lead to the paragraphs that differ. A paragraph
also branches into leaves, its sentences, of at most 8 words: 64-bit hashes for the likeness of trees and the cuts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import Steps

SECTION = 8
# Up to 8 words that end a sentence, else 8 words, else white space: the matches tile the paragraph.
_LEAF = r"\s*+(?:\S++\s++){0,7}?\S*[.!?]\s++|\s*+(?:\S++\s++){0,7}\S++\s*+|\s++"
_PARAGRAPH = r"(?<=\n)"


def add_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add the digests of the leaves, paragraphs and sections in order, and the root, as four columns."""
    leaf, paragraph, section, root = (f"{prefix}{x}" for x in ("leaves", "paragraphs", "sections", "root"))
    parts = F.filter(F.split(F.col(text), _PARAGRAPH), lambda p: p != "")
    nested = F.transform(f"{prefix}parts", lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda s: F.xxhash64(s)))
    last = F.size(f"{prefix}nested") - 1
    ends = F.filter(
        F.transform(F.col(f"{prefix}nested"), lambda x, i: F.when((F.pmod(F.xxhash64(x), F.lit(SECTION)) == 0) | (i == last), i + 1)),
        lambda i: i.isNotNull(),
    )
    spans = F.zip_with(
        F.concat(F.array(F.lit(0)), F.slice(f"{prefix}ends", 1, F.greatest(F.size(f"{prefix}ends") - 1, F.lit(0)))),
        F.col(f"{prefix}ends"),
        lambda s, e: F.when(e.isNotNull(), F.sha2(F.array_join(F.slice(paragraph, s + 1, e - s), ","), 256)),
    )
    return (
        df.withColumn(f"{prefix}parts", parts)
        .withColumn(f"{prefix}nested", nested)
        .withColumn(leaf, F.flatten(f"{prefix}nested"))
        .withColumn(paragraph, F.transform(f"{prefix}parts", lambda p: F.sha2(p, 256)))
        .withColumn(f"{prefix}ends", ends)
        .withColumn(section, F.filter(spans, lambda s: s.isNotNull()))
        .withColumn(root, F.sha2(F.concat_ws(",", section), 256))
        .drop(f"{prefix}parts", f"{prefix}nested", f"{prefix}ends")
    )


def likeness(a: str, b: str) -> Column:
    """Share of the distinct leaves of two trees that both have (Dice); 1 for two empty texts."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * both / total)


def first_change(a: str, b: str) -> Column:
    """0-based index of the first node that differs, null if none does."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(at > 0, at - 1)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (the root), and the digests of sections, paragraphs and leaves.

    A null text is the empty text, whose tree has no nodes. Rows are independent of each other.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return add_tree(rows, "text", "").select(F.col("id").alias(id_col), F.col("root").alias("fingerprint"), "sections", "paragraphs", "leaves")


def _successors(rows: DataFrame, steps: Steps) -> DataFrame:
    """(id, next_id): the next lower id, and the highest after the lowest. Ids only, cut into ranges of about equal size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("id").desc_nulls_last()
    ids = rows.select("id").distinct()
    # Written once: the number of a range must not change between the two uses.
    ranged = steps.keep(ids.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(order)
    led = ranged.select("id", "part", F.lead("id").over(inside).alias("next_id"), F.lead(F.lit(True)).over(inside).alias("inner"))
    first = ranged.groupBy("part").agg(F.max(F.struct(F.col("id").isNotNull(), "id"))["id"].alias("first_id"))
    ring = Window.orderBy("part")  # one row per range
    after = first.select("part", F.lead("first_id").over(ring).alias("later"), F.lead(F.lit(True)).over(ring).alias("more"), F.col("first_id"))
    top = first.agg(F.min_by("first_id", "part").alias("top_id"))
    after = after.crossJoin(F.broadcast(top)).select("part", F.when(F.col("more"), F.col("later")).otherwise(F.col("top_id")).alias("after_id"))
    return led.join(after, "part").select("id", F.when(F.col("inner"), F.col("next_id")).otherwise(F.col("after_id")).alias("next_id"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text, and compare with it and with the next document.

    The next document is the one with the next lower id (a null id is lower than all; after the lowest
    comes the highest). The edited text replaces the last third (floor) of the code points by the first
    as many, or all, of the next document. One row per row of ``docs``: id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next (likeness of the trees), first_paragraph
    (index of the first paragraph that the edit changes, null if none), sections_changed.

    A null text is empty. Rows that share an id each get a row; the least of their texts stands for that
    id as a next document. One row alone is its own next document. Whole texts are shuffled once by id;
    of the next document only the part that is put in and the leaves travel.
    """
    steps = Steps(docs.sparkSession, "merkle")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = rows.select("id", F.char_length("text").alias("n"))
    pairs = _successors(rows, steps)
    repeated = not sizes.groupBy("id").count().where("count > 1").isEmpty()
    lengths = sizes.groupBy("id").agg(F.max("n").alias("n"))
    wanted = pairs.join(lengths.withColumnRenamed("id", "own_id"), F.col("id").eqNullSafe(F.col("own_id"))).select(
        F.col("id").alias("for_id"), "next_id", F.floor(F.col("n") / 3).cast("int").alias("room")
    )
    nexts = rows
    if repeated:
        # A minimum is combined before the shuffle, so that an id with very many rows is no task's burden.
        nexts = rows.groupBy("id").agg(F.min("text").alias("text"))
    given = nexts.join(wanted, F.col("id").eqNullSafe(F.col("next_id")))
    given = add_tree(given, "text", "next_").select("for_id", F.expr("substring(text, 1, room)").alias("head"), "next_leaves")
    joined = rows.join(given, F.col("id").eqNullSafe(F.col("for_id"))).withColumn("n_chars", F.char_length("text").cast("long"))
    room = F.floor(F.col("n_chars") / 3)
    edited = joined.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - room).cast("int")), F.substring("head", F.lit(1), room.cast("int"))))
    trees = add_tree(add_tree(edited, "text", ""), "edited", "edited_")
    return trees.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness("leaves", "edited_leaves").alias("near_edited"),
        likeness("leaves", "next_leaves").alias("near_next"),
        first_change("paragraphs", "edited_paragraphs").alias("first_paragraph"),
        F.size(F.array_except("edited_sections", "sections")).alias("sections_changed"),
    )
