"""Bounded labelled samples for the classifiers.

A sample holds whole rows: at most per_class of either class, and of these, in the order of a hash of their ids, as many as
start within class_bytes of text. So a driver that fits on them never holds more than twice that and two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.kit import materialize

#: Rows of either class that a classifier is fitted on at most, and bytes of their texts within which each of them starts.
SAMPLE_PER_CLASS, CLASS_BYTES = 1500, 16 << 20


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train_on: Column, per_class: int = SAMPLE_PER_CLASS, class_bytes: int = CLASS_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text): at most per_class whole rows of either class, those with the smallest hashes of their ids, within class_bytes.

    Which rows count is settled on ids alone; texts are joined to the chosen ids only, whose number is bounded. Ids with
    labels that differ, null ids and null labels are left out; a repeated text row counts once.
    """
    ids = labels.where(train_on).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    ids = ids.where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label")
    there = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and text is not null")
    known = ids.join(there.select("id").distinct(), "id", "left_semi")
    chosen = None
    for value in (0, 1):
        rows = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = rows if chosen is None else chosen.unionByName(rows)
    texts = there.join(F.broadcast(chosen), "id")  # 2 * per_class rows at most
    texts = materialize(texts.groupBy("id", "label").agg(F.min("text").alias("text")), "sample")
    before = F.sum("size").over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1))
    sizes = texts.select("id", "label", F.octet_length("text").alias("size"))  # per_class small rows a window
    kept = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < class_bytes).select("id")
    return texts.join(F.broadcast(kept), "id")
