"""Shared plumbing: Arrow-batched text maps, words, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilspark.plans.scratch import discard  # noqa: F401
from veilspark.plans.scratch import saved as materialize  # noqa: F401

#: A slice of a record batch that a text kernel sees holds about this many bytes of text (or one row).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that the strings of one column hold about `limit` bytes in each slice."""
    n = batch.num_rows
    if not n:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < n:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(df: DataFrame, keys: list[str], text: str, fields: list[T.StructField], make: Callable[[], Callable], limit: int = SLICE_BYTES) -> DataFrame:
    """Narrow map over texts: keys go through, `make()` gives, once a task, a kernel from a string array to columns.

    Only the key and text columns are read, so other columns may have any name.
    """
    source = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*(T.StructField(k, source.schema[k].dataType, True) for k in keys), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        kernel = make()
        for batch in batches:
            for part in slices(batch, len(keys), limit):
                columns = kernel(part.column(len(keys)))
                made = [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(len(keys) + i).type) for i, x in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(arrow.field(i).type) for i in range(len(keys))), *made], schema=arrow)

    return source.mapInArrow(run, schema)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without gaps, and n + 1 offsets; a null counts as empty."""
    filled = texts.fill_null("").cast(pa.large_binary())
    filled = pa.concat_arrays([filled]) if filled.offset == 0 else pa.array(filled.to_pylist(), pa.large_binary())
    _, offsets, data = filled.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(filled) + 1)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# words -----------------------------------------------------------------------------------------------------------

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2 ** 64."""
    out = np.ones(n + 1, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


class WordScanner:
    """Finds the words of a string array: maximal runs of 0-9, a-z and non-ASCII, A-Z lower-cased first."""

    def __init__(self):
        self.powers = _powers(0, _MULTIPLIER)
        inverse = pow(int(_MULTIPLIER), -1, 1 << 64)
        self.inverse_base = np.uint64(inverse)
        self.inverses = _powers(0, self.inverse_base)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of all words, their lengths in bytes, n + 1 offsets of the texts in them)."""
        data, offsets = utf8(texts)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _WORD[data]
        edges = inside[1:] != inside[:-1]
        # a text's edge cuts words too
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        cut = np.unique(inner[inside[inner] & inside[inner + 1]]) if len(inner) else inner
        at = np.flatnonzero(edges)
        if len(cut):
            at = np.sort(np.concatenate([at, cut, cut]))
        starts, ends = at[::2], at[1::2]
        if len(data) >= len(self.powers):
            self.powers = _powers(len(data) * 2, _MULTIPLIER)
            self.inverses = _powers(len(data) * 2, self.inverse_base)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * self.inverses[starts])
        return hashes, (ends - starts).astype(np.int32), np.searchsorted(starts, offsets, side="left")


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, by the position of its first word (len(words) - size + 1 of them)."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        out = out * _MULTIPLIER + words[j : j + len(out)]
    return mix(out)


def release(spark: SparkSession) -> None:
    """Ask the driver's JVM to notice what is no longer referenced, so that shuffle files of finished jobs go.

    Spark deletes them in the background once their plans are collected; two rounds, with a moment for that.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def class_of(df: DataFrame, key: str, id_col: str, salts: int = 64) -> DataFrame:
    """(id, key, first): for each row the smallest id with its key. A hot key is dealt to `salts` groups on the way."""
    rows = df.select(F.col(id_col).alias("id"), F.col(key).alias("key")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    part = rows.groupBy("key", "salt").agg(F.min("id").alias("first"))
    whole = part.groupBy("key").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts"))  # salts rows a key at most
    return rows.join(whole.select("key", "first", F.explode("salts").alias("salt")), ["key", "salt"]).select("id", "key", "first")
