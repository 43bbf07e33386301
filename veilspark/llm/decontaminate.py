"""Benchmark decontamination by a distributed positional inverted index.

The training side is indexed once, in segments: each task turns a megabyte of documents into one index row that holds,
for each term that the test vocabulary may have, the sorted positions of its postings. Terms that it cannot have are told
by a bitmap of a fixed size; a huge vocabulary fills it, and then all terms are indexed. The index is a table in the
shared folder. Document frequencies are summed over all segments, and each test phrase (a window of consecutive words) is
answered from its rarest term: that term's list, shifted by its offset, is intersected with the shifted lists of the next
rarest terms until it is empty or all terms agree. Proximity matches ask instead for all terms within a span of positions.

Documents are never shuffled; what moves is one count a term and segment. Test phrases are handed out in blocks of a
bounded size, which may cut an item; more blocks search the same index again, and their results meet by row. Terms are
64-bit hashes of whole words.

Defined cases: a null text has no words; a text without words has no hits; a benchmark item without words has no windows,
and rows that repeat an item count once; items with a null id are left out; repeated documents each get their row; texts
may have any length; an empty table on either side gives no hits; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilspark.llm.kit import WordScanner, materialize, slices

#: Words of a window.
WINDOW = 8
#: A block of test phrases has about so many windows; the driver and each task hold one block.
BLOCK_WINDOWS = 1 << 18
#: Free positions between the documents of a segment, so that no phrase crosses them.
GAP = 64
#: Bytes of text in a segment.
SEGMENT_BYTES = 1 << 20
#: Bits of the map of terms that the test vocabulary may have.
VOCABULARY_BITS = 1 << 24
#: Beyond all positions.
NEVER = 1 << 40


class Phrases:
    """A block of test windows: for each distinct window its terms, and the items that have it."""

    def __init__(self, rows: list[tuple[object, np.ndarray]], window: int):
        number: dict[object, int] = {}
        by_window: dict[tuple, list[int]] = {}
        for item, words in rows:
            n = number.setdefault(item, len(number))
            size = min(window, len(words))
            for at in range(len(words) - size + 1) if size else ():
                own = by_window.setdefault(tuple(words[at : at + size].tolist()), [])
                if n not in own[-1:]:
                    own.append(n)
        self.names = [str(i) for i in number]
        self.vocabulary = np.unique(np.array([t for w in by_window for t in w], np.int64))
        self.sizes = np.array([len(w) for w in by_window], np.int64)
        self.terms = np.full((len(by_window), window), -1, np.int64)
        for row, words in enumerate(by_window):
            self.terms[row, : len(words)] = np.searchsorted(self.vocabulary, np.array(words, np.int64))
        self.owners = list(by_window.values())

    def rarest_first(self, frequency: np.ndarray) -> np.ndarray:
        """For each window its offsets by the frequency of the term there; offsets beyond its end come last."""
        weight = np.where(self.terms >= 0, frequency[self.terms], np.iinfo(np.int64).max)
        return np.argsort(weight, axis=1, kind="stable")


INDEX = T.StructType(
    [
        T.StructField("first", T.BinaryType()),  # first position of each document, int64
        T.StructField("n_words", T.BinaryType()),  # of each document, int32
        T.StructField("terms", T.ArrayType(T.LongType())),  # hashes of the terms that occur, ascending
        T.StructField("frequency", T.ArrayType(T.LongType())),  # documents of each of them
        T.StructField("ends", T.BinaryType()),  # where each term's list ends, int64
        T.StructField("steps", T.BinaryType()),  # the lists: first position, then steps, int32
    ]
)


def _slot(terms: np.ndarray, bits: int) -> np.ndarray:
    return (terms % bits).astype(np.int64)


def vocabulary_map(benchmark: DataFrame, id_col: str, text_col: str, bits: int) -> np.ndarray:
    """`bits` bits, packed: one is set for each slot that a term of the test side falls into. The driver holds one text."""
    scan, held = WordScanner(), np.zeros(bits, bool)
    for words, _ in _items(benchmark, id_col, text_col, scan):
        held[_slot(words, bits)] = True
    return np.packbits(held)


def build_index(docs: DataFrame, may_have: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a segment: its number, its documents' ids and the postings in them of the terms in the map. Narrow."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("ids", T.ArrayType(source.schema["id"].dataType)), *INDEX.fields])
    arrow = to_arrow_schema(schema)
    held = docs.sparkSession.sparkContext.broadcast(may_have)  # of a fixed size

    def run(batches):
        scan, wanted = WordScanner(), np.unpackbits(held.value).view(bool)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, SEGMENT_BYTES):
                words, _, bounds = scan(part.column(1))
                counts = np.diff(bounds)
                first = bounds[:-1] + GAP * np.arange(len(counts))
                words = words.view(np.int64)
                hit = np.flatnonzero(wanted[_slot(words, len(wanted))])
                doc = np.repeat(np.arange(len(counts)), counts)[hit]
                term, position = words[hit], hit + GAP * doc
                order = np.argsort(term, kind="stable")
                term, position, doc = term[order], position[order], doc[order]
                terms, starts = np.unique(term, return_index=True)
                ends = np.append(starts[1:], len(term)) if len(terms) else starts
                new = np.ones(len(term), np.int64)
                new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
                frequency = np.add.reduceat(new, starts) if len(terms) else starts
                steps = np.diff(position, prepend=0)
                steps[starts] = position[starts]
                packed = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([part.column(0).to_pylist()], arrow.field("ids").type),
                        packed(first, "<i8"),
                        packed(counts, "<i4"),
                        pa.array([terms], arrow.field("terms").type),
                        pa.array([frequency.astype(np.int64)], arrow.field("frequency").type),
                        packed(ends, "<i8"),
                        packed(steps, "<i4"),
                    ],
                    schema=arrow,
                )
                number += 1

    return source.mapInArrow(run, schema)


class Segment:
    """One index row, opened for the terms of a vocabulary, which are named by their places in it."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        self.number, self.ids = row["segment"], row["ids"]
        self.first = np.frombuffer(row["first"], "<i8")
        self.n_words = np.frombuffer(row["n_words"], "<i4")
        terms = np.array(row["terms"], np.int64)
        at = np.searchsorted(terms, vocabulary)
        there = at < len(terms)
        there[there] = terms[at[there]] == vocabulary[there]
        self.list_of = np.where(there, at, -1)  # of each term of the vocabulary
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.starts = np.append(0, self.ends[:-1]) if len(self.ends) else self.ends
        sums = np.cumsum(np.frombuffer(row["steps"], "<i4").astype(np.int64))
        sizes = self.ends - self.starts
        before = np.where(self.starts > 0, sums[self.starts - 1], 0) if len(self.starts) else self.starts
        self.positions = sums - np.repeat(before, sizes)
        self.keys = (np.repeat(np.arange(len(terms)), sizes) << 32) | self.positions  # ascending

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the terms one after the other, and which of them each position belongs to."""
        which = np.flatnonzero(self.list_of[terms] >= 0)
        own = self.list_of[terms[which]]
        start = self.starts[own]
        size = self.ends[own] - start
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.positions[np.repeat(start, size) + within], np.repeat(which, size)

    def next_from(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The first position of each term at or after one, or NEVER."""
        own = self.list_of[terms]
        at = np.searchsorted(self.keys, (np.maximum(own, 0) << 32) | np.maximum(positions, 0))
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key >> 32 == own), key & 0xFFFFFFFF, NEVER)

    def exact(self, phrases: Phrases, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first word) of each exact match: lists meet from the rarest term on."""
        offset = order[:, 0]
        positions, window = self.lists(phrases.terms[np.arange(len(order)), offset])
        start = positions - offset[window]
        window, start = window[start >= 0], start[start >= 0]
        for turn in range(1, order.shape[1]):
            offset = order[window, turn]
            term = phrases.terms[window, offset]
            keep = (term < 0) | (self.next_from(np.maximum(term, 0), start + offset) == start + offset)
            window, start = window[keep], start[keep]
            if not len(window):
                break
        return window, start

    def near(self, phrases: Phrases, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) where all terms lie within `slop` positions of it, in any order."""
        positions, window = self.lists(phrases.terms[np.arange(len(order)), order[:, 0]])
        for turn in range(1, order.shape[1]):
            term = phrases.terms[window, order[window, turn]]
            keep = (term < 0) | (self.next_from(np.maximum(term, 0), positions - slop) <= positions + slop)
            window, positions = window[keep], positions[keep]
            if not len(window):
                break
        return window, positions

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1


def _items(benchmark: DataFrame, id_col: str, text_col: str, scan: WordScanner):
    """(word hashes, id) of each distinct row that has both; one text at a time comes to the driver."""
    rows = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null").distinct().orderBy("id", "text")
    for row in rows.toLocalIterator():
        words = scan(pa.array([row["text"]], pa.string()))[0].view(np.int64)
        if len(words):
            yield words, row["id"]


def _blocks(items, window: int, block_windows: int):
    """Blocks of (id, words) with `block_windows` windows each (the last one has fewer). Long items are cut between windows."""
    block, windows = [], 0
    for words, item in items:
        at, n = 0, max(1, len(words) - window + 1)
        while at < n:
            take = min(n - at, block_windows - windows)
            block.append((item, words[at : at + take + window - 1]))
            at, windows = at + take, windows + take
            if windows >= block_windows:
                yield block
                block, windows = [], 0
    if block:
        yield block


RUNS = "array<struct<start: int, end: int>>"


def find_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, slop: int = 2 * WINDOW, block_windows: int = BLOCK_WINDOWS, vocabulary_bits: int = VOCABULARY_BITS,
) -> DataFrame:
    """One row a document: id, n_words, runs (of words inside matches), items (ids as strings, sorted), n_near, near (item, at).

    A run is [start, end) in words. n_near counts the items of which some window has all its terms within `slop`
    positions (less than GAP) of its rarest one, but none occurs exactly; near lists these items, once for each place `at` of such a word.
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be under {GAP}")
    if block_windows < 1 or vocabulary_bits < 8 or vocabulary_bits % 8:
        raise ValueError("a block has a window at least, the map whole bytes")
    spark = docs.sparkSession
    index = materialize(build_index(docs, vocabulary_map(benchmark, item_col, item_text_col, vocabulary_bits), id_col, text_col), "postings")
    lists = index.select(F.explode(F.arrays_zip("terms", "frequency")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.frequency").alias("n"))
    results = []
    for rows in _blocks(_items(benchmark, item_col, item_text_col, WordScanner()), window, block_windows):
        phrases = Phrases(rows, window)
        frequency = np.zeros(len(phrases.vocabulary), np.int64)
        asked = F.broadcast(spark.createDataFrame(pa.table({"term": phrases.vocabulary})))  # window * block_windows terms at most
        for row in lists.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
            frequency[np.searchsorted(phrases.vocabulary, row["term"])] = row["n"]
        results.append(_search(index, phrases, phrases.rarest_first(frequency), slop))
    found = results[0] if results else _search(index, Phrases([], window), np.zeros((0, window), np.int64), slop)
    if len(results) > 1:
        for more in results[1:]:
            found = found.unionByName(more)
        found = found.groupBy("row").agg(  # one row a block
            F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
        )
        # an item that is cut may be near in one block and exact in another
        found = found.withColumn("near", F.filter("near", lambda x: ~F.array_contains("items", x["item"])))
        found = found.withColumn("n_near", F.size(F.array_distinct(F.col("near.item"))).cast("long"))
        merged = """aggregate(runs, cast(array() as array<struct<start: int, end: int>>), (done, r) ->
            if(size(done) > 0 and r.start <= element_at(done, -1).end,
               concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start, greatest(element_at(done, -1).end, r.end) as end))),
               concat(done, array(r))))"""
        found = found.withColumn("runs", F.expr(merged))
    return found.select(F.col("id").alias(id_col), "n_words", "runs", "items", "n_near", "near")


def _search(index: DataFrame, phrases: Phrases, order: np.ndarray, slop: int) -> DataFrame:
    id_type = index.schema["ids"].dataType.elementType
    run_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("runs", run_type), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_near", T.LongType()), T.StructField("near", T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("at", T.IntegerType())])))])
    arrow = to_arrow_schema(schema)
    held = index.sparkSession.sparkContext.broadcast((phrases, order))

    def answered(segment: Segment, phrases: Phrases, order: np.ndarray):
        n_docs, n_items = len(segment.ids), len(phrases.names)
        runs, items, n_near, places = [[] for _ in range(n_docs)], [[] for _ in range(n_docs)], np.zeros(n_docs, np.int64), [[] for _ in range(n_docs)]
        if not len(order) or not (segment.list_of >= 0).any():
            return runs, items, n_near, places
        owned = np.array([len(o) for o in phrases.owners], np.int64)
        flat = np.array([i for o in phrases.owners for i in o], np.int64)
        begin = np.cumsum(owned) - owned

        def pairs(window: np.ndarray, doc: np.ndarray) -> np.ndarray:
            """Distinct document * n_items + item of these matches."""
            window, doc = np.divmod(np.unique((window << 32) + doc), 1 << 32)
            n = owned[window]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return np.unique(np.repeat(doc, n) * n_items + flat[np.repeat(begin[window], n) + within])

        window, start = segment.exact(phrases, order)
        mine = pairs(window, segment.doc_of(start))
        near, at = segment.near(phrases, order, slop)
        np.add.at(n_near, np.setdiff1d(pairs(near, segment.doc_of(at)), mine) // n_items, 1)
        n = owned[near]
        item = flat[np.repeat(begin[near], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        spot = np.repeat(at, n)
        only = ~np.isin(segment.doc_of(spot) * n_items + item, mine)
        for i, p in sorted(set(zip(item[only].tolist(), spot[only].tolist(), strict=True)), key=lambda x: (phrases.names[x[0]], x[1])):
            d = int(segment.doc_of(np.array([p]))[0])
            places[d].append({"item": phrases.names[i], "at": int(p - segment.first[d])})
        for doc, item in zip(*np.divmod(mine, n_items), strict=True):
            items[doc].append(phrases.names[item])
        if len(window):
            by = np.argsort(start, kind="stable")
            start, end = start[by], np.maximum.accumulate((start + phrases.sizes[window])[by])
            new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
            stop = end[np.append(new[1:], len(end)) - 1]
            doc = segment.doc_of(start[new])
            for d, a, b in zip(doc.tolist(), (start[new] - segment.first[doc]).tolist(), (stop - segment.first[doc]).tolist(), strict=True):
                runs[d].append({"start": a, "end": b})
        return runs, items, n_near, places

    def run(batches):
        phrases, order = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0], phrases.vocabulary)
                runs, items, n_near, places = answered(segment, phrases, order)
                rows = (np.int64(segment.number) << 24) + np.arange(len(segment.ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(segment.ids, arrow.field(1).type), pa.array(segment.n_words.astype(np.int64)), pa.array(runs, arrow.field(3).type), pa.array([sorted(i) for i in items], arrow.field(4).type), pa.array(n_near), pa.array(places, arrow.field(6).type)],
                    schema=arrow,
                )

    return index.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, **options) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items (sorted strings), contaminated (n_items >= min_items), n_near, near."""
    found = find_matches(docs, benchmark, **options)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    size = F.size("items").cast("long")
    return found.select(found.columns[0], "n_words", hit.alias("n_hit"), size.alias("n_items"), "items", (size >= min_items).alias("contaminated"), "n_near", "near")
