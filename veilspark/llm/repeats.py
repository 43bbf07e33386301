"""Exact repeated passages by common-prefix intervals of an enhanced suffix array.

The core is maximal_repeats(): a suffix array with its table of common prefixes is scanned once with a stack, which
walks the tree of common-prefix intervals bottom up; an interval whose suffixes differ in the character to their left is a
maximal repeat, and is given with all its occurrences.

To run that on a cluster, suffixes are dealt out by content. Each window of `length` bytes belongs to its minimizer, the
smallest hashed k-mer in it, so equal windows belong to equal k-mers wherever they stand. Consecutive windows with one
minimizer form a segment. Segments are compared by hash first: a segment that an earlier document has too is a repeat
as a whole. Only where one k-mer has several different segments are their bytes fetched, and the suffix arrays of those
bytes find the repeats that are parts of segments.

Hot passages are met once a batch (earlier occurrences inside a batch settle later ones) before anything is shuffled.
A hot k-mer that stands in ever new surroundings is split by them: its windows are halved by its place in them, each half
is keyed by the longer string that all its windows share, and so on while that is hot, down to single windows. Equal
windows get equal keys on the way. Which keys are hot is estimated on a sample of the documents; that moves work only,
as the result is the same whatever is split.
Documents move by a hash of their ids, in parts of a bounded size. Segments are compared by 96 bits of hashes, and
texts that share an id are told apart by 32 bits.

Defined cases: a null text counts as empty; texts shorter than `length` have no repeats; rows that share an id are one
owner, whose texts never repeat each other, though each is cut for itself; a row with a null id is left as it is; texts may have any length; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.kit import _MULTIPLIER, _powers, discard, materialize, mix, release, slices, utf8

LENGTH, K = 50, 20
#: Bytes of text whose segments are settled among themselves before they are shuffled.
BATCH_BYTES = 8 << 20
#: Text bytes of a part of the documents, and of the text behind a bucket of segments; there are LEAST_PARTS at least.
PART_BYTES, BUCKET_BYTES, LEAST_PARTS = 4 << 20, 8 << 20, 256

#: A key is split from about so many different segments on, by their number in this share of the documents; at most MAX_HOT keys a round.
HOT_SEGMENTS, SAMPLE, MAX_HOT = 1 << 14, 1 / 64, 1 << 18

#: `version` tells texts apart that share an id: 32 bits of a hash (one stands beside nearly each segment).
SEGMENT = np.dtype([("gram", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("version", "<u4"), ("start", "<u4"), ("windows", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("version", "<u4"), ("start", "<u4"), ("length", "<u4")])


# the suffix array ---------------------------------------------------------------------------------------------------


def suffix_array(strings: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, byte to the left, common prefix with the suffix before) of all suffixes of `least` bytes or more, sorted.

    Where a suffix starts its string, the left byte is a negative number that no other suffix has.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    counts = np.maximum(0, sizes - least + 1)
    string = np.repeat(np.arange(len(strings)), counts)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(string):
        return string, offset, offset, offset
    width = -(-int(sizes.max()) // 8) * 8
    data = np.frombuffer(b"".join(strings) + bytes(width), np.uint8)
    base = np.cumsum(sizes) - sizes
    left = sizes[string] - offset
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[base[string] + offset]
    rows = np.where(np.arange(width)[None] < left[:, None], rows, 0).astype(np.uint8)
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((left, *words.T[::-1]))
    before = np.where(offset > 0, data[np.maximum(base[string] + offset - 1, 0)].astype(np.int64), -1 - string)
    rows, left, string, offset, before = rows[order], left[order], string[order], offset[order], before[order]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return string, offset, before, np.append(0, np.minimum(common, np.minimum(left[1:], left[:-1])))


def intervals(common: np.ndarray, least: int):
    """(depth, first, last) of the common-prefix intervals of at least `least`, children before parents: one stack scan."""
    hot = np.flatnonzero(common >= least)
    stack: list[tuple[int, int]] = []
    previous = -2
    for at, depth in zip(hot.tolist(), common[hot].tolist()):
        if at != previous + 1:  # a gap closes all that is open
            while stack:
                yield stack[-1][0], stack[-1][1], previous
                stack.pop()
        first = at - 1
        while stack and stack[-1][0] > depth:
            yield stack[-1][0], stack[-1][1], at - 1
            first = stack.pop()[1]
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))
        previous = at
    while stack:
        yield stack[-1][0], stack[-1][1], previous
        stack.pop()


def maximal_repeats(strings: list[bytes], least: int):
    """(depth, strings, offsets) of each maximal repeat of `least` bytes or more: all its occurrences.

    A repeat is kept if its occurrences differ in the byte to the left, or one starts its string.
    """
    string, offset, left, common = suffix_array(strings, least)
    if not len(string):
        return
    changes = np.append(0, np.cumsum(left[1:] != left[:-1]))
    starts = np.append(0, np.cumsum(offset == 0))
    for depth, first, last in intervals(common, least):
        if changes[last] != changes[first] or starts[last + 1] > starts[first]:
            yield depth, string[first : last + 1], offset[first : last + 1]


# segments -----------------------------------------------------------------------------------------------------------


def version_of(data: bytes | np.ndarray) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Segmenter:
    """Cuts the windows of a batch of texts into segments by their minimizers, and those of hot keys into shorter ones.

    With `parts_of`, some of the hot keys, only the parts that these are split into directly are given.
    """

    def __init__(self, length: int = LENGTH, k: int = K, hot: np.ndarray | None = None, parts_of: np.ndarray | None = None):
        self.length, self.k = length, k
        self.hot = np.zeros(0, np.uint64) if hot is None else np.sort(hot)
        self.parts_of = parts_of
        self.inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        self.powers = self.inverses = _powers(0, _MULTIPLIER)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, start in it, windows, key, segment hash) of each segment; the key is the hash of its k-mer, or of a longer string."""
        n, span = len(data), self.length - self.k + 1
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        if n >= len(self.powers):
            self.powers, self.inverses = _powers(n * 2, _MULTIPLIER), _powers(n * 2, self.inverse)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=total[1:])
        grams = mix((total[self.k :] - total[: -self.k]) * self.inverses[: n - self.k + 1])
        bits = np.uint64(max(1, n.bit_length()))
        low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :]) if span > reach else low
        at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # the minimizer of each window
        text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[: len(at)]
        valid = np.arange(len(at)) + self.length <= offsets[1:][text]
        new = valid.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
        starts = np.flatnonzero(new)
        ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
        starts, ends, keys = self._split(starts, ends, at[starts], grams[at[starts]], total)
        windows = ends - starts + 1
        stop = ends + self.length
        hashes = mix((total[stop] - total[starts]) * self.inverses[starts] + windows.astype(np.uint64))
        return text[starts], starts - offsets[:-1][text[starts]], windows, keys, hashes

    def _split(self, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, keys: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, last window, key) of the segments, none of which has a hot key that can be split.

        In a window the k-mer at `at` stands between offsets `low` and `high`, so all windows share the bytes from
        at - low to at - high + length.
        """
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.length - self.k)
        wanted = np.full(len(at), self.parts_of is None)
        while len(self.hot) and len(at):
            short = keys >> np.uint64(16)
            found = self.hot[np.minimum(np.searchsorted(self.hot, short), len(self.hot) - 1)] == short
            split = found & (low < high)
            if not split.any():
                break
            pieces = [(starts[~split], ends[~split], at[~split], keys[~split], low[~split], high[~split], wanted[~split])]
            part_of_wanted = np.isin(short[split], self.parts_of) if self.parts_of is not None else wanted[split]
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                a, b, place = a[split], b[split], at[split]
                first, last = np.maximum(starts[split], place - b), np.minimum(ends[split], place - a)
                some = first <= last
                a, b, place, first, last = a[some], b[some], place[some], first[some], last[some]
                shared = mix((total[place - b + self.length] - total[place - a]) * self.inverses[place - a])
                pieces.append((first, last, place, mix(shared + (a * 256 + b + 1).astype(np.uint64)), a, b, part_of_wanted[some]))
            starts, ends, at, keys, low, high, wanted = (np.concatenate(x) for x in zip(*pieces, strict=True))
        return starts[wanted], ends[wanted], keys[wanted]


def settle(segments: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segments of the first document of each hash, ranges of all others)."""
    segments = segments[np.lexsort((segments["start"], segments["doc"], segments["hash"], segments["gram"]))]
    if not len(segments):
        return segments, np.zeros(0, RANGE)
    new = np.append(True, (segments["hash"][1:] != segments["hash"][:-1]) | (segments["gram"][1:] != segments["gram"][:-1]))
    group = np.cumsum(new) - 1
    earliest = segments["doc"] == segments["doc"][np.flatnonzero(new)][group]
    later = segments[~earliest]
    ranges = np.zeros(len(later), RANGE)
    for c in ("doc", "version", "start"):
        ranges[c] = later[c]
    ranges["length"] = later["windows"].astype(np.uint32) + np.uint32(length - 1)
    return segments[earliest], ranges


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """pmod(xxhash64(doc), parts) as Spark SQL has it for a bigint (public XXH64, seed 42, of its 8 bytes)."""
    p1, p2, p3, p4, p5 = (np.uint64(int(x, 16)) for x in ("9E3779B185EBCA87", "C2B2AE3D27D4EB4F", "165667B19E3779F9", "85EBCA77C2B2AE63", "27D4EB2F165667C5"))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turn(doc.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64) % np.int64(parts)


def merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges joined where they touch or overlap, by document."""
    ranges = ranges[np.lexsort((ranges["start"], ranges["version"], ranges["doc"]))]
    if not len(ranges):
        return ranges
    first = np.append(True, (ranges["doc"][1:] != ranges["doc"][:-1]) | (ranges["version"][1:] != ranges["version"][:-1]))
    # one axis for all documents, with room between them
    group = (np.cumsum(first) - 1).astype(np.int64) << 33
    start = group + ranges["start"]
    reach = np.maximum.accumulate(start + ranges["length"])
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    out = ranges[new].copy()
    out["length"] = (reach[np.append(new[1:], len(start)) - 1] - start[new]).astype(np.uint32)
    return out


_FLOW = "bucket int, kind int, part int, data binary"
#: What the data of a row is: segments to compare, ranges that are settled, segments whose bytes are needed.
_SEGMENTS, _RANGES, _WANTED = 0, 1, 2
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])


def _dealt(rows: np.ndarray, to: np.ndarray):
    """(target, its rows) for each target that gets some."""
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)]):
        yield int(to[a]), rows[a:b]


def _flow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)] if rows else [pa.array([], t) for t in _SCHEMA.types], schema=_SCHEMA)


def _batches(batches: Iterator[pa.RecordBatch], cut: Segmenter) -> Iterator[np.ndarray]:
    """Segments of about BATCH_BYTES of text at a time."""
    held, size = [], 0
    for batch in batches:
        for piece in slices(batch, 1, 1 << 20):
            data, offsets = utf8(piece.column(1))
            text, start, windows, keys, hashes = cut(data, offsets)
            out = np.zeros(len(text), SEGMENT)
            out["gram"], out["hash"], out["start"], out["windows"] = keys >> np.uint64(16), hashes >> np.uint64(16), start, windows
            out["doc"] = piece.column(0).to_numpy()[text]
            out["version"] = np.array([version_of(data[a:b]) for a, b in zip(offsets, offsets[1:])], np.uint32)[text]
            held.append(out)
            size += len(data)
            if size >= BATCH_BYTES:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def hot_keys(source: DataFrame, length: int = LENGTH, k: int = K, least: int = HOT_SEGMENTS, sample: float = SAMPLE) -> np.ndarray:
    """Keys that about `least` different segments have, and the keys of their parts that are hot as well, by rounds.

    The driver gets MAX_HOT keys a round at most, the hottest; others are left whole, which changes no result. A round
    counts the parts of the keys that the round before found; it counts all keys again only if that one found MAX_HOT.
    """
    some = materialize(source.sample(sample, 1), "sample") if sample < 1 else source
    hot, parts_of = np.zeros(0, np.uint64), None
    for _ in range((length - k).bit_length() + 1):

        def count(batches, hot=hot, parts_of=parts_of):
            for segments in _batches(batches, Segmenter(length, k, hot, parts_of)):
                first = settle(segments, length)[0]  # sorted by gram and hash
                new = np.append(True, (first["gram"][1:] != first["gram"][:-1]) | (first["hash"][1:] != first["hash"][:-1])) if len(first) else np.zeros(0, bool)
                keys, n = np.unique(first["gram"][new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        counts = some.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        new = counts.where(F.col("n") >= max(2, least * sample)).orderBy(F.desc("n"), "key").limit(MAX_HOT).select("key").collect()
        new = np.array([r["key"] for r in new], np.uint64)
        more = np.union1d(hot, new)
        if len(more) == len(hot):
            break
        hot, parts_of = more, new if len(new) < MAX_HOT else None
    discard(some)
    return hot


def _cut(source: DataFrame, length: int, k: int, buckets: int, parts: int, hot: np.ndarray) -> DataFrame:
    """Segments of all documents by bucket, and ranges that are settled inside a batch."""
    known = source.sparkSession.sparkContext.broadcast(hot)  # MAX_HOT keys a round at most

    def run(batches):
        for segments in _batches(batches, Segmenter(length, k, known.value)):
            kept, ranges = settle(segments, length)
            rows = [(b, _SEGMENTS, 0, _packed(x, buckets)) for b, x in _dealt(kept, (kept["gram"] % np.uint64(buckets)).astype(np.int64))]
            ranges = merged(ranges)
            rows += [(p % buckets, _RANGES, p, x.tobytes()) for p, x in _dealt(ranges, part_of(ranges["doc"], parts))]
            yield _flow(rows)

    return source.mapInArrow(run, _FLOW)


def _planes(x: np.ndarray, size: int) -> np.ndarray:
    """The low `size` bytes of 64-bit integers, byte by byte, so that bytes that are mostly zero lie together."""
    return np.ascontiguousarray(x.astype("<i8").view("u1").reshape(-1, 8)[:, :size].T)


def _packed(segments: np.ndarray, buckets: int) -> bytes:
    """Segments of one bucket, column by column, by document: under 20 bytes each once compressed."""
    s = segments[np.lexsort((segments["start"], segments["version"], segments["doc"]))]
    first = np.flatnonzero(np.append(True, (s["doc"][1:] != s["doc"][:-1]) | (s["version"][1:] != s["version"][:-1])))
    counts = np.diff(np.append(first, len(s)))
    grams = s["gram"] // np.uint64(buckets)
    wide = 5 if not len(grams) or int(grams.max()) < 1 << 40 else 6
    head = np.array([len(s), len(first), wide], "<u4")
    columns = (head, _planes(np.diff(s["doc"][first], prepend=0), 8), s["version"][first], _planes(counts, 4), _planes(grams, wide), _planes(s["hash"], 6), _planes(s["start"], 4), s["windows"])
    return b"".join(c.tobytes() for c in columns)


def _unpacked(data: bytes, bucket: int, buckets: int) -> np.ndarray:
    n, m, wide = np.frombuffer(data, "<u4", 3).tolist()
    out, at = np.zeros(n, SEGMENT), 12

    def column(kind: str, size: int) -> np.ndarray:
        nonlocal at
        at += size * np.dtype(kind).itemsize
        return np.frombuffer(data, kind, size, at - size * np.dtype(kind).itemsize)

    def planes(size: int, rows: int) -> np.ndarray:
        whole = np.zeros((rows, 8), "u1")
        whole[:, :size] = column("u1", size * rows).reshape(size, rows).T
        return whole.view("<i8")[:, 0]

    docs, versions, counts = np.cumsum(planes(8, m)), column("<u4", m), planes(4, m)
    out["doc"], out["version"] = np.repeat(docs, counts), np.repeat(versions, counts)
    out["gram"] = planes(wide, n).astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket)
    out["hash"], out["start"], out["windows"] = planes(6, n), planes(4, n), column("u1", n)
    return out


def _compare(flow: DataFrame, length: int, buckets: int, parts: int) -> DataFrame:
    """Bucket by bucket: ranges of segments that an earlier document has, and the segments whose bytes are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], []
        for batch in batches:
            kinds, which, data = batch.column("kind").to_pylist(), batch.column("part").to_pylist(), batch.column("data").to_pylist()
            rows += [(p % (1 << 30), _RANGES, p, d) for k, p, d in zip(kinds, which, data) if k == _RANGES]
            held += [_unpacked(d, b, buckets) for b, k, d in zip(batch.column("bucket").to_pylist(), kinds, data) if k == _SEGMENTS]
        if held:
            first, ranges = settle(np.concatenate(held), length)
            del held
            ranges = merged(ranges)
            rows += [(0, _RANGES, p, x.tobytes()) for p, x in _dealt(ranges, part_of(ranges["doc"], parts))]
            # k-mers with segments that differ, first met in different documents
            gram = first["gram"]
            new = np.append(True, gram[1:] != gram[:-1]) if len(gram) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            if len(starts):
                low, high = np.minimum.reduceat(first["doc"], starts), np.maximum.reduceat(first["doc"], starts)
                wanted = first[(low < high)[group]]
                rows += [(0, _WANTED, p, x.tobytes()) for p, x in _dealt(wanted, part_of(wanted["doc"], parts))]
        yield _flow(rows)

    return flow.groupBy("bucket").applyInArrow(run, _FLOW)


def _fetch(docs: DataFrame, wanted: DataFrame, length: int, buckets: int) -> DataFrame:
    """Bytes of the wanted segments: bucket, list of segments and list of bytes, once for each distinct segment and document."""
    schema = pa.schema([("bucket", pa.int32()), ("segments", pa.binary()), ("bytes", pa.binary())])

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows and asked.num_rows:
            segments = np.concatenate([np.frombuffer(d, SEGMENT) for d in asked["data"].to_pylist()])
            need = set(np.unique(segments["doc"]).tolist())
            place: dict[tuple[int, int], bytes] = {}
            for i, t in zip(texts["id"].to_pylist(), texts["text"].to_pylist()):
                if i in need:
                    data = (t or "").encode()
                    place[i, version_of(data)] = data
            for bucket, own in _dealt(segments, (segments["gram"] % np.uint64(buckets)).astype(np.int64)):
                strings = []
                for doc, version, start, windows in own[["doc", "version", "start", "windows"]].tolist():
                    strings.append(place[doc, version][start : start + windows + length - 1])
                out.append((bucket, own.tobytes(), b"".join(strings)))
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return docs.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(run, "bucket int, segments binary, bytes binary")


def _inside(fetched: DataFrame, length: int, parts: int) -> DataFrame:
    """Ranges of repeats that are parts of segments, by the suffix arrays of a bucket's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, strings = [], []
        for batch in batches:
            for s, b in zip(batch.column("segments").to_pylist(), batch.column("bytes").to_pylist()):
                own = np.frombuffer(s, SEGMENT)
                ends = np.cumsum(own["windows"].astype(np.int64) + length - 1).tolist()
                segments.append(own)
                strings += [b[i:j] for i, j in zip([0, *ends], ends)]
        rows = []
        if strings:
            segments = np.concatenate(segments)
            # equal segments of one document are one string with several places
            by_string = np.lexsort((segments["doc"], segments["hash"], segments["gram"]))
            ordered = segments[by_string]
            new = np.append(True, (ordered["doc"][1:] != ordered["doc"][:-1]) | (ordered["hash"][1:] != ordered["hash"][:-1]) | (ordered["gram"][1:] != ordered["gram"][:-1]))
            edges = np.append(np.flatnonzero(new), len(ordered))
            first = by_string[edges[:-1]]
            docs = segments["doc"][first]
            got: list[tuple[np.ndarray, np.ndarray, int]] = []
            for depth, string, offset in maximal_repeats([strings[i] for i in first.tolist()], length):
                owners = docs[string]
                later = owners > owners.min()
                if later.any():
                    got.append((string[later], offset[later], depth))
            if got:
                string = np.concatenate([s for s, _, _ in got])
                offset = np.concatenate([o for _, o, _ in got])
                depth = np.repeat([d for _, _, d in got], [len(s) for s, _, _ in got])
                places = edges[string + 1] - edges[string]
                spread = np.repeat(np.arange(len(string)), places)
                nth = np.arange(len(spread)) - np.repeat(np.cumsum(places) - places, places)
                at = by_string[edges[string][spread] + nth]
                ranges = np.zeros(len(spread), RANGE)
                ranges["doc"], ranges["version"], ranges["start"], ranges["length"] = segments["doc"][at], segments["version"][at], segments["start"][at] + offset[spread], depth[spread]
                ranges = merged(ranges)
                rows = [(0, _RANGES, p, x.tobytes()) for p, x in _dealt(ranges, part_of(ranges["doc"], parts))]
        yield _flow(rows)

    return fetched.groupBy("bucket").applyInArrow(run, _FLOW)


def repeated_ranges(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, hot_segments: int = HOT_SEGMENTS, sample: float = SAMPLE
) -> tuple[DataFrame, DataFrame, int]:
    """(documents by part, ranges by part, parts). A range is covered by strings of `length` bytes that an earlier id has too."""
    if not 1 <= k <= length or length - k >= 255:
        raise ValueError("k must be at most `length`, and less than 255 under it")
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets = max(LEAST_PARTS, size // PART_BYTES), max(LEAST_PARTS, size // BUCKET_BYTES)
    named = source.where("id is not null")

    long = named.where(F.octet_length("text") >= length)
    hot = hot_keys(long, length, k, hot_segments, sample)
    flow = materialize(_compare(_cut(long, length, k, buckets, parts, hot), length, buckets, parts), "compared")
    release(spark)
    by_part = named.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    wanted = flow.where(F.col("kind") == _WANTED).select("part", "data")
    inside = materialize(_inside(_fetch(by_part, wanted, length, buckets), length, parts), "inside")
    release(spark)
    ranges = flow.where(F.col("kind") == _RANGES).select("part", "data").unionByName(inside.select("part", "data"))
    return by_part, ranges, parts


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<start, end>>) for each row."""
    by_part, ranges, _ = repeated_ranges(docs, id_col, text_col, length, k, **options)
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        all_ranges = merged(np.concatenate([np.frombuffer(d, RANGE) for d in found["data"].to_pylist()])) if found.num_rows else np.zeros(0, RANGE)
        out = []
        for i, t in zip(texts["id"].to_pylist(), texts["text"].to_pylist()):
            data = (t or "").encode()
            a, b = np.searchsorted(all_ranges["doc"], [i, i + 1])
            at, kept, spans = 0, [], []
            own = all_ranges[a:b]
            own = own[own["version"] == np.uint32(version_of(data))]
            for s, n in zip(own["start"].tolist(), own["length"].tolist()):
                kept.append(data[at:s])
                at = s + n
                spans.append({"start": s, "end": at})
            left = b"".join([*kept, data[at:]])
            out.append((i, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), spans))
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    flat = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, end: int>>"
    done = by_part.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(run, flat)
    nameless = docs.where(F.col(f"`{id_col}`").isNull()).select(
        F.lit(None).cast("long").alias("id"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("kept_sha256"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"),
    )
    return done.unionByName(nameless).withColumnRenamed("id", id_col)
