"""A corpus pipeline over `documents`: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents (the last one: pieces of packed sequences). run() writes each stage's result as Parquet in the shared folder
and hands it, read back, to the next. The result depends on a trained network and on packing, which SQL cannot express.

Defined cases, for each stage: an empty table gives an empty result; other columns of the input are dropped, whatever
their names; texts may have any length; lang, source and n_chars may be null. What null ids, null texts, repeated rows
and ties come to is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, neardup, packing, quality, secrets
from veilspark.llm.kit import materialize, table
from veilspark.llm.training import fold, labelled_sample

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that score under this are rejected: only what is clearly junk goes.
QUALITY_THRESHOLD = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality. The score is computed beside the text, so nothing is joined.

    A null text scores as an empty one; a null id is scored like any other but never trained on; repeated rows share
    their score and so their fate. Without labels of both classes all rows get the constant, smoothed share.
    """
    labels = table(spark, sf_dir, "labels")
    net = quality.train(labelled_sample(docs, labels, "quality", fold("doc_id", 3) != 1))
    return docs.select(*COLUMNS).where(quality.scorer(spark, net)("text") >= QUALITY_THRESHOLD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates; documents without an id stay.

    Rows that share an id are documents of their own where their texts differ, and one where they are equal: the row
    whose other columns are the smallest. Null and empty texts without words count as copies of each other.
    """
    named = docs.select(*COLUMNS).where("doc_id is not null").withColumn("version", F.struct("doc_id", F.xxhash64("text").alias("of")))
    gone = neardup.near_duplicates(named, "version").where("class_id <> version").select("version")
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    kept = named.join(gone, "version", "left_anti").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("r")).select("doc_id", "text", "r.*")
    return kept.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item: a run of at least WINDOW words inside matches.

    One passage of one item is enough. An item of fewer words than a window makes no leak by itself, as such phrases
    stand in clean documents too. Texts name documents, so null and repeated ids do not matter: all rows of a leaking
    text go, and null and empty texts stay.
    """
    keyed = docs.select(*COLUMNS).withColumn("key", F.md5("text"))
    found = decontaminate.find_matches(keyed, table(spark, sf_dir, "benchmark"), id_col="key")
    leaks = found.where(F.exists("runs", lambda r: r["end"] - r["start"] >= decontaminate.WINDOW)).select("key").distinct()
    return keyed.join(leaks, "key", "left_anti").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts and counts n_chars anew; every row stays, null ids, null texts and repeats too."""
    return secrets.mask_secrets(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences: one row a piece. A null text is an empty one; repeated rows are packed each."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
