"""Whole files from bytes to bytes: read, choose sheets, find headers, anonymize, place results, write, report.

All files of a folder go through one job. A file that cannot be read, or that has no row with a name column beside a code
or factory column, gives a row with outcome 'error' and its reason, and never stops the others. One task writes one file.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.anonymize import anonymize
from veilspark.operators.audit import file_report, output_path, row_audits
from veilspark.plans.rulebase import RuleBase
from veilspark.plans.scratch import saved
from veilspark.sources import sheets
from veilspark.sources.workbooks import RESULT, STATUS, place_results, save_workbooks, workbooks

NO_COLUMNS = "no column of names beside one of codes or factories"
NO_READER = "files of this kind are not read"
_COUNTS = ("rows", "changed", "green", "yellow", "sheets")
AUDITS = ("keep_losses", "idempotence_failures", "residual_confirmed")


def _anonymized(items: DataFrame, base: RuleBase) -> tuple[DataFrame, DataFrame]:
    """(items with row_id, results with file, sheet and r)."""
    items = saved(items.select(F.struct("file", "sheet", "r").alias("row_id"), "*"), "items")
    return items, saved(anonymize(items, base).select("row_id", "row_id.*", "text", "status", "changed"), "results")


def _reported(cells: DataFrame, items: DataFrame, results: DataFrame, headers: DataFrame) -> DataFrame:
    """One row a file: its counters, outcome and reason."""
    read = cells.groupBy("file").agg(F.max(F.when(F.col("data_type") == "failed", F.col("value"))).alias("why"))
    counts = file_report(items, results).drop("sheets").join(headers.groupBy("file").agg(F.count("*").alias("sheets")), "file", "full")
    out = read.join(counts, "file", "left")
    why = F.coalesce("why", F.when(F.col("sheets").isNull(), NO_COLUMNS))
    return out.select("file", F.when(why.isNull(), "ok").otherwise("error").alias("outcome"), why.alias("reason"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS))


def process_workbooks(spark: SparkSession, path: str, folder: str, base: RuleBase, audited: bool = True) -> DataFrame:
    """Anonymize all workbooks under a path into a folder: (file, outcome, reason, rows, changed, green, yellow, sheets[, audits])."""
    cells = saved(sheets.read_workbooks(spark, path, outputs=False), "cells")
    good = cells.where("data_type <> 'failed'")
    headers = saved(sheets.find_headers(good.join(sheets.select_sheets(good), ["file", "sheet"], "left_semi")), "headers")
    items, results = _anonymized(sheets.item_rows(good, headers), base)
    whole = good.join(headers.select("file").distinct(), "file", "left_semi")
    save_workbooks(workbooks(place_results(whole, headers, results.select("file", "sheet", "r", "text", "status"))), folder)
    out = _reported(cells, items, results, headers)
    if not audited:
        return out
    counts = row_audits(items, results, base).groupBy("row_id.file").agg(*(F.count_if(c).alias(c) for c in AUDITS))
    return out.join(counts, "file", "left").fillna(0, list(AUDITS))


def _rewritten(key: tuple, content: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """One delimited file with its results: all its columns, two more, its own dialect, UTF-8 with a byte order mark."""
    rows, dialect = sheets.delimited_rows(content["content"].iloc[0])
    head = int(found["h"].iloc[0]) - 1
    width = len(rows[head])
    rows[head] = [*rows[head], RESULT, STATUS]
    by_row = {int(r): (t, s) for r, t, s in zip(found["r"], found["text"], found["status"]) if r == r}
    factory = found["factory"].iloc[0]
    for i in range(head + 1, len(rows)):
        rows[i] += [""] * (width + 2 - len(rows[i]))
        if i + 1 in by_row:
            rows[i][width : width + 2] = by_row[i + 1]
            if factory == factory and factory is not None:
                rows[i][int(factory) - 1] = ""
    text = io.StringIO(newline="")
    csv.writer(text, dialect=dialect).writerows(rows)
    return pd.DataFrame({"file": [key[0]], "content": [text.getvalue().encode("utf-8-sig")]})


def process_delimited(spark: SparkSession, path: str, folder: str, base: RuleBase) -> DataFrame:
    """Anonymize all .csv files under a path into a folder: (file, outcome, reason, rows, changed, green, yellow, sheets)."""
    cells = saved(sheets.read_delimited(spark, path, outputs=False), "cells")
    good = cells.where("data_type <> 'failed'")
    headers = saved(sheets.find_headers(good, sheets.CODE_CSV), "headers")
    items, results = _anonymized(sheets.item_rows(good, headers, workbook=False), base)
    # a file whose rows are all blank is written too: one row without a result
    put = headers.select("file", F.col("r").alias("h"), "factory").join(results.select("file", "r", "text", "status"), "file", "left")
    raw = sheets.raw_files(spark, path, "*.[cC][sS][vV]", outputs=False).select(F.col("path").alias("file"), "content")
    raw = raw.join(headers.select("file"), "file", "left_semi")
    done = raw.groupBy("file").cogroup(put.groupBy("file")).applyInPandas(_rewritten, "file string, content binary")
    save_workbooks(done.select(output_path(F.col("file")).alias("path"), "content"), folder)
    return _reported(cells, items, results, headers)


def process_files(spark: SparkSession, path: str, folder: str, base: RuleBase) -> DataFrame:
    """A batch over all files under a path: (file, outcome, reason, rows, changed, green, yellow, sheets), for audit.batch_summary().

    Outputs of earlier runs are left alone; files of other kinds are errors of their own.
    """
    base = base.indexed()
    done = process_workbooks(spark, path, folder, base, audited=False).unionByName(process_delimited(spark, path, folder, base))
    others = sheets.raw_files(spark, path, "*", outputs=False).select(F.col("path").alias("file")).where(~F.lower("path").rlike(r"\.(xlsx|xlsm|csv)$"))
    return done.unionByName(others.select("file", F.lit("error").alias("outcome"), F.lit(NO_READER).alias("reason"), *(F.lit(0).cast("long").alias(c) for c in _COUNTS)))
