"""Anonymization of a stream of items: rows are independent, so each micro-batch runs the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.anonymize import anonymize
from veilspark.plans.rulebase import RuleBase


def anonymize_stream(items: DataFrame, base: RuleBase, out: str, checkpoint: str) -> StreamingQuery:
    """Process all that is there, then stop; each batch is one folder, so a repeated batch replaces itself."""

    base = base.indexed()

    def each(batch: DataFrame, epoch: int) -> None:
        anonymize(batch, base).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
