"""Cost-balanced packing of tokenized documents into fixed-length training sequences.

A document is its token ids and a closing id. It is cut into full sequences and a rest. Rests are taken in descending
order; each goes to the sequence of lowest estimated cost (linear plus quadratic attention cost of its pieces) that
still has room for it. Rests that fit nowhere whole are cut to fill the room that is left. The room offered in a block
equals its tokens: whole sequences, and at the end of a task sequences whose lengths are powers of two, which need
no padding. So nothing is padded, and a document is cut beyond its full sequences only where nothing else fits.

Packing runs in blocks inside each task, so there is no shuffle and memory is bounded by a block and one document.
A task that is run again packs its rows alike: the result depends only on the rows of the partition.

Defined cases: a null text counts as empty and gives one piece with the closing id; repeated rows are documents of
their own; a null id goes through; a document longer than a sequence is cut; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilspark.llm.kit import slices

CAPACITY = 1024
CLOSING_ID = 0
#: Rests are packed together in blocks of about this many tokens.
BLOCK_TOKENS = 1 << 19
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n ** 2 (attention stays inside a piece).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

#: Beyond these code points, or with a special token's mark, texts take the reference tokenizer itself.
_RARE = re.compile("[^\x00-ɏ]|<\\|")


def byte_bpe_encoder(json_path: str, ranks_path: str | None, pattern: str | None) -> Callable[[str], np.ndarray]:
    """text -> token ids (uint32) of the `tokenizers` file, without added special tokens.

    Where the same vocabulary is at hand as ranks, Latin texts without special marks go through its faster encoder;
    tests hold both to the same ids. All other texts go through `tokenizers`.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    exact = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    if not ranks_path:
        return exact
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: exact(text) if _RARE.search(text) else np.array(fast.encode_ordinary(text), np.uint32)


def public_encoder() -> Callable[[str], np.ndarray]:
    """The default tokenizer: the installed public byte-level BPE of 50k ids."""
    import public_tokenizers as public

    return byte_bpe_encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def powers_of_two(n: int) -> list[int]:
    """n as descending powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def assign(lengths: np.ndarray, rooms: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each sequence (with its room) the pieces (item, start in item, length) it gets, in order.

    The lengths must sum to at most the rooms. Items descend by length, ties by position.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in rooms]
    room = np.array(rooms, np.int64)
    cost = np.zeros(len(rooms))
    late = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        open_cost = np.where(room >= n, cost, np.inf)
        best = int(np.argmin(open_cost)) if len(rooms) else 0
        if not len(rooms) or room[best] < n:
            late.append(item)
            continue
        out[best].append((item, 0, n))
        room[best] -= n
        cost[best] += LINEAR * n + QUADRATIC * n * n
    if late:  # cut what fits nowhere whole; widest rooms first makes the fewest pieces
        order = iter(np.argsort(-room, kind="stable").tolist())
        at = next(order)
        for item in late:
            start, n = 0, int(lengths[item])
            while start < n:
                while not room[at]:
                    at = next(order)
                take = int(min(room[at], n - start))
                out[at].append((item, start, take))
                room[at] -= take
                start += take
    return out


class Packer:
    """Packs the documents of one task in blocks; rows() gives what is ready as columns of pieces."""

    def __init__(self, capacity: int = CAPACITY, block: int = BLOCK_TOKENS, task: int = 0):
        self.capacity, self.block, self.next = capacity, block, task << 40
        self.rests: list[tuple[object, int, int, np.ndarray]] = []  # key, start, tokens of the document, ids
        self.waiting = 0
        self.ready: list[tuple] = []

    def add(self, key: object, ids: np.ndarray) -> None:
        full = len(ids) // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            self._emit(key, start, len(ids), ids[start : start + self.capacity], 0)
            self.next += 1
        if full < len(ids):
            self.rests.append((key, full, len(ids), ids[full:]))
            self.waiting += len(ids) - full
            if self.waiting >= self.block:
                self._pack(False)

    def _emit(self, key, start, total, ids, offset) -> None:
        self.ready.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))

    def _pack(self, last: bool) -> None:
        whole, left = divmod(self.waiting, self.capacity)
        if not last and left:  # carry the smallest rests over, so that what is packed now fills its sequences
            self.rests.sort(key=lambda r: -len(r[3]))
            carried = []
            while self.rests and len(self.rests[-1][3]) <= left:
                carried.append(self.rests.pop())
                left -= len(carried[-1][3])
            if left and self.rests:
                key, start, total, ids = self.rests.pop()
                self.rests.append((key, start, total, ids[: len(ids) - left]))
                carried.append((key, start + len(ids) - left, total, ids[len(ids) - left :]))
        else:
            carried = []
        rooms = [self.capacity] * whole + (powers_of_two(left) if last else [])
        lengths = np.array([len(r[3]) for r in self.rests], np.int64)
        for pieces in assign(lengths, rooms):
            offset = 0
            for item, at, n in pieces:
                key, start, total, ids = self.rests[item]
                self._emit(key, start + at, total, ids[at : at + n], offset)
                offset += n
            self.next += bool(pieces)
        self.rests = carried
        self.waiting = sum(len(r[3]) for r in carried)

    def finish(self) -> None:
        if self.rests:
            self._pack(True)

    def rows(self) -> list[list]:
        out, self.ready = self.ready, []
        return [list(c) for c in zip(*out, strict=True)] if out else []


PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoder: Callable[[], Callable[[str], np.ndarray]] = public_encoder, capacity: int = CAPACITY, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    source = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([T.StructField(id_col, source.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in PIECE)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        encode, packer = encoder(), Packer(capacity, block, TaskContext.get().partitionId())
        closing = np.array([CLOSING_ID], np.uint32)

        def made():
            columns = packer.rows()
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            for part in slices(batch, 1):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packer.add(key, np.concatenate([encode(text), closing]) if text else closing)
                yield from made()
        packer.finish()
        yield from made()

    return source.mapInArrow(run, schema)
