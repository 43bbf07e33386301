"""Tables that cut lineage between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, on a local master only, a temporary folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def saved(df: DataFrame, label: str = "passes") -> DataFrame:
    """df, written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/veilspark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that saved() returned, once nothing that is still to run reads them; other frames are left alone."""
    for df in tables:
        at = getattr(df, "saved_at", None) if df is not None else None
        if at:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
