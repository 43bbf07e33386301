"""Reports and audits that run beside a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.keep import keep_signature
from veilspark.operators.anonymize import GREEN, YELLOW, anonymize
from veilspark.operators.spans import redaction_spans
from veilspark.plans.rulebase import RuleBase
from veilspark.plans.scratch import saved

FILLS = {GREEN: "D9EAD3", YELLOW: "FFF2CC"}


def report(results: DataFrame) -> DataFrame:
    """One row: rows, changed, green, yellow."""
    count = lambda c: F.count(F.when(c, 1)).alias
    return results.agg(F.count("*").alias("rows"), count(F.col("changed"))("changed"), count(F.col("status") == GREEN)("green"), count(F.col("status") == YELLOW)("yellow"))


def file_report(items: DataFrame, results: DataFrame) -> DataFrame:
    """One row a file of items (row_id, file, sheet): the counters of report(), and how many sheets had items."""
    both = items.select("row_id", "file", "sheet").join(results.select("row_id", "changed", "status"), "row_id")
    count = lambda c: F.count(F.when(c, 1)).alias
    return both.groupBy("file").agg(F.count("*").alias("rows"), count(F.col("changed"))("changed"), count(F.col("status") == GREEN)("green"), count(F.col("status") == YELLOW)("yellow"), F.count_distinct("sheet").alias("sheets"))


def with_fill(results: DataFrame) -> DataFrame:
    """Results plus `fill`, the colour that a sheet shows a status in."""
    fill = F.lit(None).cast("string")
    for status, colour in FILLS.items():
        fill = F.when(F.col("status") == status, colour).otherwise(fill)
    return results.withColumn("fill", fill)


def row_audits(items: DataFrame, results: DataFrame, base: RuleBase) -> DataFrame:
    """(row_id, keep_losses, idempotence_failures, residual_confirmed): whether each row fails one of the guards."""
    base = base.indexed()
    both = saved(items.select("row_id", "name", "code", "factory").join(results.select("row_id", "text"), "row_id"), "both")  # its readers read it many times
    again = anonymize(both.select("row_id", F.col("text").alias("name"), "code", "factory"), base).select("row_id", F.col("text").alias("again"))
    left = redaction_spans(both.select("row_id", "text", "code", "factory"), base).select("row_id", F.lit(True).alias("left")).distinct()
    out = both.join(again, "row_id").join(left, "row_id", "left")
    return out.select("row_id", (keep_signature(F.col("name")) != keep_signature(F.col("text"))).alias("keep_losses"), (F.col("text") != F.col("again")).alias("idempotence_failures"), F.coalesce("left", F.lit(False)).alias("residual_confirmed"))


def audits(items: DataFrame, results: DataFrame, base: RuleBase) -> DataFrame:
    """One row: keep_losses, idempotence_failures, residual_confirmed (rows)."""
    return row_audits(items, results, base).agg(*(F.count_if(c).alias(c) for c in ("keep_losses", "idempotence_failures", "residual_confirmed")))


def batch_summary(files: DataFrame) -> DataFrame:
    """Files (path, outcome) -> ok, review, errors, total."""
    count = lambda v, n: F.count(F.when(F.col("outcome") == v, 1)).alias(n)
    return files.agg(count("ok", "ok"), count("review", "review"), count("error", "errors"), F.count("*").alias("total"))


def supported_files(files: DataFrame) -> DataFrame:
    """Files (ord, path) that a batch takes: known extensions, no earlier outputs, each path once."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    ext, stem = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)), F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return files.where(ext.isin(".xlsx", ".xlsm", ".csv", ".pdf") & ~stem.endswith("_обезличено")).groupBy("path").agg(F.min("ord").alias("ord")).select("ord", "path")


def output_path(path: F.Column) -> F.Column:
    return F.regexp_replace(path, r"(\.[^./\\]*)$", "_обезличено$1")
