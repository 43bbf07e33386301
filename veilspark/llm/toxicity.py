"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are which hashed n-grams of its characters (code points, lower-cased) occur in it. Each is scaled by
the log ratio of its smoothed frequencies among toxic and clean training texts, and a logistic regression is fitted on the
scaled features (an NB-SVM with a logistic loss). The model is one weight a bucket and a bias.

The frequencies are counted on the executors, which also find the buckets whose ratio is more than noise; only those, and
which of the sample's texts have them, reach the driver.

Defined cases: a null or empty text scores by the bias alone; texts may have any length and are scored whole; repeated
rows get equal scores; with one class or none among the training rows the score is their constant, smoothed share; a
null id goes through; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.kit import discard, map_texts, materialize

ORDERS = (3, 4, 5)
BUCKETS = 1 << 17
#: What is added to each count.
ALPHA = 0.5
#: Ratios of buckets below so many standard errors are noise and count as zero.
MIN_Z = 3.0
_PRIME = np.uint32(0x01000193)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased code points of all texts and n + 1 offsets; a null counts as empty."""
    lower = [(t or "").lower() for t in texts.to_pylist()]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.append(0, np.cumsum([len(t) for t in lower], dtype=np.int64)).astype(np.int64)


def gram_buckets(points: np.ndarray, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> list[np.ndarray]:
    """For each order the bucket of the n-gram at each character."""
    out = []
    for n in orders:
        h = np.full(max(0, len(points) - n + 1), n, np.uint32)
        for j in range(n):
            h = (h ^ points[j : j + len(h)]) * _PRIME
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append((h >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int32))
    return out


def each_present(texts: pa.Array):
    """For each text which buckets occur in it; the array is used again for the next one."""
    points, offsets = characters(texts)
    grams = gram_buckets(points)
    seen = np.zeros(BUCKETS, bool)
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        seen[:] = False
        for n, g in zip(ORDERS, grams):
            seen[g[a : max(a, b - n + 1)]] = True
        yield seen


def features(sample: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grams binary of int32): the distinct buckets of each text, BUCKETS at most."""

    def kernel(texts):
        return [pa.array([np.flatnonzero(seen).astype("<i4").tobytes() for seen in each_present(texts)], pa.binary())]

    return map_texts(sample, keys, "text", [T.StructField("grams", T.BinaryType())], lambda: kernel)


@dataclass
class Model:
    weights: np.ndarray  # float32, one a bucket: log-count ratio times coefficient
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.array([self.weights[seen].sum(dtype=np.float64) + self.bias for seen in each_present(texts)], np.float64)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def bucket_counts(grams: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): texts of either label that have it. Each task adds up its own first."""

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for label, own in zip(batch.column("label").to_pylist(), batch.column("grams")):
                counts[label, np.frombuffer(own.as_buffer(), "<i4")] += 1
        there = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[1, there]), pa.array(counts[0, there])], names=["bucket", "toxic", "clean"])

    return grams.select("label", "grams").mapInArrow(run, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def ratios(counts: DataFrame, toxic: int, clean: int, alpha: float = ALPHA, min_z: float = MIN_Z) -> DataFrame:
    """(bucket, ratio) of the buckets whose two frequencies differ by min_z standard errors or more."""
    ratio = F.log((F.col("toxic") + alpha) / (toxic + 2 * alpha)) - F.log((F.col("clean") + alpha) / (clean + 2 * alpha))
    pooled = (F.col("toxic") + F.col("clean") + alpha) / (toxic + clean + 2 * alpha)
    z = (F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / clean))
    return counts.select("bucket", ratio.alias("ratio"), z.alias("z")).where(F.abs("z") >= min_z).select("bucket", "ratio")


def only(grams: DataFrame, buckets: np.ndarray) -> DataFrame:
    """(id, label, grams) with only the given buckets, as positions among them."""
    held = grams.sparkSession.sparkContext.broadcast(buckets)  # BUCKETS numbers at most

    def run(batches):
        place = np.full(BUCKETS, -1, np.int32)
        place[held.value] = np.arange(len(held.value))
        for batch in batches:
            own = [place[np.frombuffer(g.as_buffer(), "<i4")] for g in batch.column("grams")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([x[x >= 0].astype("<i4").tobytes() for x in own], pa.binary())], names=["id", "label", "grams"])

    return grams.select("id", "label", "grams").mapInArrow(run, grams.select("id", "label", "grams").schema)


def fit(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray, l2: float = 0.5, steps: int = 60) -> tuple[np.ndarray, float]:
    """(coefficients times ratios, bias) of a logistic regression on (label, positions of the features that a text has); both labels occur."""
    n = len(ratio)
    labels = np.array([y for y, _ in rows], np.float64)
    index = np.concatenate([g for _, g in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(g) for _, g in rows])
    value = ratio[index]
    order = np.argsort(index, kind="stable")  # by feature, for the transposed product
    col_row, col_value, col_index = row[order], value[order], index[order]
    scale = 1 / max(1e-9, np.sqrt(np.bincount(row, weights=value**2, minlength=len(rows)).mean()))
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    w, b = np.zeros(n), 0.0
    m_w, v_w, m_b, v_b = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=value * w[index], minlength=len(rows)) * scale + b
        error = share * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels)
        g_w = np.bincount(col_index, weights=col_value * error[col_row], minlength=n) * scale + l2 * 1e-5 * w
        g_b = error.sum()
        m_w, v_w = 0.9 * m_w + 0.1 * g_w, 0.99 * v_w + 0.01 * g_w**2
        m_b, v_b = 0.9 * m_b + 0.1 * g_b, 0.99 * v_b + 0.01 * g_b**2
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= 0.1 * fix * m_w / (np.sqrt(v_w) + 1e-8)
        b -= 0.1 * fix * m_b / (np.sqrt(v_b) + 1e-8)
    return ratio * w * scale, float(b)


def train(sample: DataFrame, min_z: float = MIN_Z) -> Model:
    """Fit on a bounded sample of (id, label, text)."""
    grams = materialize(features(sample, ["id", "label"]), "grams")
    sizes = {r["label"]: r["n"] for r in grams.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    weights = np.zeros(BUCKETS, np.float32)
    if not toxic or not clean:
        share = (toxic + 1) / (toxic + clean + 2)
        discard(grams)
        return Model(weights, float(np.log(share / (1 - share))))
    chosen = sorted(ratios(bucket_counts(grams), toxic, clean, min_z=min_z).collect())  # BUCKETS rows at most
    buckets = np.array([r["bucket"] for r in chosen], np.int64)
    rows = sorted(only(grams, buckets).collect(), key=lambda r: r["id"])
    own, bias = fit([(r["label"], np.frombuffer(r["grams"], "<i4")) for r in rows], np.array([r["ratio"] for r in chosen], np.float64))
    weights[buckets] = own
    discard(grams)
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row. Narrow."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4 * BUCKETS bytes

    return map_texts(docs, [id_col], text_col, [T.StructField("score", T.DoubleType())], lambda: lambda texts: [held.value.scores(texts)])
