"""Quality: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover it whole. Each byte is embedded, learned filters slide over
the chunk, a rectifier and a max over the chunk leave one number a filter, and a linear layer gives the chunk's logit.
The mean of a text's chunk logits, by chunk length, gives its probability. Training is back-propagation with Adam from
that probability through all chunks of a text, in the driver, on a bounded sample of whole labelled texts.

Defined cases: a null or empty text scores by one chunk of padding; texts may have any length and are scored whole;
repeated rows get equal scores; with one class or none among the training rows the score is their constant, smoothed
share; a null id goes through; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.kit import slices, utf8

#: Bytes of a chunk, and bytes that it shares with the next.
CHUNK, OVERLAP = 1024, 32
#: Filters see WIDTH bytes and move by HALF of that, so each byte is seen by two of them.
WIDTH, HALF, EMBEDDED, FILTERS = 8, 4, 8, 24
#: Beside each whole text the fit sees one cut of it of such a size, so that short texts are judged by their bytes and not by the padding.
CUTS = (40, 80, 160, 320, 640)
#: Steps of the fit and texts in each, whatever the sample's size; chunks that are convolved at once.
STEPS, BATCH, RATE, SEED, BLOCK = 450, 32, 0.01, 7, 64


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks padded with zeros, the text of each, bytes of each); every text has one chunk at least."""
    sizes = np.diff(offsets)
    step = CHUNK - OVERLAP
    counts = np.maximum(1, -(-np.maximum(0, sizes - OVERLAP) // step))
    text = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][text] + within * step
    length = np.minimum(CHUNK, offsets[1:][text] - start)
    at = start[:, None] + np.arange(CHUNK)[None]
    inside = np.arange(CHUNK)[None] < length[:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), text, length


def training_texts(text: bytes) -> list[bytes]:
    """What one labelled text gives to the fit: itself, and a cut from anywhere in it."""
    drawn = zlib.crc32(text)
    size = CUTS[drawn % len(CUTS)]
    at = drawn // len(CUTS) % max(1, len(text) - size)
    return [text, text[at : at + size]] if size < len(text) else [text]


@dataclass
class Network:
    embedding: np.ndarray  # 256 x EMBEDDED; byte 0, also the padding, is fixed at zero
    filters: np.ndarray  # WIDTH * EMBEDDED x FILTERS
    filter_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def new(rng: np.random.Generator) -> Network:
        e = rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
        e[0] = 0
        f = rng.normal(0, (WIDTH * EMBEDDED) ** -0.5, (WIDTH * EMBEDDED, FILTERS)).astype(np.float32)
        return Network(e, f, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.filter_bias, self.out, self.out_bias]

    def convolved(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embedded halves, responses of the filters before the rectifier)."""
        halves = self.embedding[x].reshape(len(x), CHUNK // HALF, HALF * EMBEDDED)
        both = halves @ np.concatenate([self.filters[: HALF * EMBEDDED], self.filters[HALF * EMBEDDED :]], axis=1)
        return halves, both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), BLOCK):
            pooled = self.convolved(x[at : at + BLOCK])[1].max(axis=1) + self.filter_bias
            out[at : at + BLOCK] = np.maximum(pooled, 0) @ self.out + self.out_bias[0]
        return out

    def probabilities(self, x: np.ndarray, text: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Of each text: its chunks' logits, each times the chunk's share of it."""
        return 1 / (1 + np.exp(-np.clip(np.bincount(text, weights=self.logits(x) * share), -30, 30)))

    def gradients(self, x: np.ndarray, error: np.ndarray) -> list[np.ndarray]:
        """Of the loss, given its derivatives by the chunks' logits."""
        total = [np.zeros(p.shape) for p in self.parts()]
        for at in range(0, len(x), BLOCK):
            part, own = x[at : at + BLOCK], error[at : at + BLOCK]
            halves, response = self.convolved(part)
            best = response.argmax(axis=1)
            rows = np.arange(len(part))[:, None]
            pooled = np.take_along_axis(response, best[:, None], axis=1)[:, 0] + self.filter_bias
            back = own[:, None] * self.out[None] * (pooled > 0)  # chunks x filters
            windows = np.concatenate([halves[rows, best], halves[rows, best + 1]], axis=2)  # chunks x filters x WIDTH * EMBEDDED
            spots = (best * HALF)[:, :, None] + np.arange(WIDTH)[None, None]
            g_windows = (back[:, :, None] * self.filters.T[None]).reshape(-1, EMBEDDED)
            np.add.at(total[0], part[rows[:, :, None], spots].reshape(-1), g_windows)
            for sums, g in zip(total[1:], (np.einsum("nf,nfw->wf", back, windows), back.sum(0), own @ np.maximum(pooled, 0), np.array([own.sum()])), strict=True):
                sums += g
        total[0][0] = 0
        return total

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offsets = utf8(texts)
        n = len(offsets) - 1
        out = np.empty(n)
        for at in range(0, n, 256):
            part = offsets[at : at + 257]
            x, text, length = chunks(data[part[0] : part[-1]], part - part[0])
            length = np.maximum(length, 1)
            out[at : at + 256] = self.probabilities(x, text, length / np.bincount(text, weights=length)[text])
        return out


def fit(texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit on whole texts and their labels; classes weigh alike. Deterministic."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    rows = [(t, label) for text, label in zip(texts, labels, strict=True) for t in training_texts(text)]
    y = np.array([label for _, label in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        net.out[:] = 0
        net.out_bias[:] = np.log(share / (1 - share))
        return net
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    parts = net.parts()
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        while len(order) < BATCH:  # one shuffled round of all texts after the other
            order = np.append(order, rng.permutation(len(y)))
        drawn, order = order[:BATCH], order[BATCH:]
        sizes = [len(rows[i][0]) for i in drawn]
        x, text, length = chunks(np.frombuffer(b"".join(rows[i][0] for i in drawn), np.uint8), np.append(0, np.cumsum(sizes)))
        share = np.maximum(length, 1) / np.bincount(text, weights=np.maximum(length, 1))[text]
        error = weight[drawn] / BATCH * (net.probabilities(x, text, share) - y[drawn])
        rate = RATE * min(1, step / 20) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for p, m, v, g in zip(parts, first, second, net.gradients(x, error[text] * share), strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def train(sample: DataFrame) -> Network:
    """Fit on a bounded sample of (id, label, text)."""
    rows = sorted(sample.select("id", "label", "text").collect(), key=lambda r: r["id"])  # training.CLASS_BYTES bounds their texts
    return fit([r["text"].encode() for r in rows], [r["label"] for r in rows])


def scorer(spark: SparkSession, net: Network) -> Callable[..., Column]:
    """A column function: the scores of a text column, for use beside other columns."""
    held = spark.sparkContext.broadcast(net)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([s for part in slices(batch, 0) for s in held.value.scores(part.column(0))], pa.float64())

    return scored


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row. Narrow."""
    return docs.select(F.col(f"`{id_col}`"), scorer(docs.sparkSession, net)(F.col(f"`{text_col}`").cast("string")).alias("score"))
