"""Near-duplicate classes by Order MinHash with banded alignment.

Texts are words; their k-mers are runs of five words, labelled with how often they occurred before in the text. Each
hash function samples the SAMPLED smallest labelled k-mers and keeps them in the order of the text, so equal sketches
speak for small edit distance, not only for common k-mers. Bands deal texts to buckets: each joins ROWS sketches and
the minimum of one hash over the k-mers without labels, so that texts that share but one phrase, however often each
repeats it, are not dealt together. Candidates are verified by an alignment that must close within the band of
insertions and deletions that texts of k-mer similarity `threshold` can need: (n + m) * (1 - threshold) / (1 +
threshold) words, a ninth of both lengths at 0.8. Their distinct k-mers must have a similarity of FLOOR too, for the
same reason, unless their labelled ones have a similarity of `threshold`.

No pairs within a bucket are enumerated up front. Equal word sequences are settled first, by hash. In each bucket the
member that shares most is compared with all others; links are joined to components; a bucket that still holds several
components goes on without that member, with more members of small components each round, until none is left. So all
pairs of a bucket end up in one component or were compared, and no link between different texts is lost. The first round
looks at EARLY bands only: it settles most large groups, whose members would meet again in every other band. Pairs whose
signatures (below) differ by far more than FLOOR and, for labelled k-mers, `threshold` allow never leave the join.

Defined cases: ids name documents, and rows that share an id are versions of one; a null id has no class; null and empty
texts have no words, and texts without words are copies if they are equal, null being equal to empty; texts of under
five words have one k-mer; texts may have any length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.kit import WordScanner, class_of, discard, map_texts, materialize, mix, release, shingle_hashes

#: Words of a k-mer, similarity of a link.
K, THRESHOLD = 5, 0.8
#: Least similarity of the distinct k-mers of a link, repeats counting once.
FLOOR = 0.5
#: Labelled k-mers that a sketch samples; sketches of a band; bands. Two texts of similarity s share a band with
#: probability about s ** (SAMPLED * ROWS + 1), so at 0.8 they miss all bands in about 2 of 100,000 cases.
SAMPLED, ROWS, BANDS = 2, 2, 28
#: Bands of the first round.
EARLY = 4
#: A signature: 16 four-bit slots in each of so many numbers. A slot holds the least hash of the k-mers dealt to it (1 to
#: 15), 0 if there are none. Slots that differ are a share of about 1 - s of those in use; a pair of 0.8 has half of
#: them different in about one of 10 ** 8 cases.
PARTS = 4
SIGNATURE = tuple(f"s{i}" for i in range(PARTS))
#: The same of the labelled k-mers; both.
COUNTED = tuple(f"c{i}" for i in range(PARTS))
#: Whether the number of distinct k-mers dealt to a bit is odd, for 64 bits in each of so many numbers; how many there
#: are. Bits that differ are at most as many as k-mers that only one text has, so nothing is lost to them.
PARITY = tuple(f"p{i}" for i in range(16))
SIGNED = (*SIGNATURE, *COUNTED, *PARITY, "kinds")
#: Signatures settle a pair once more slots differ than the wanted similarity allows by so many standard errors.
ERRORS = 4


def _constants(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(salt))


_A = (_constants(ROWS * BANDS, 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_constants(ROWS * BANDS, 2) >> np.uint64(32)).astype(np.uint32)
_C = (_constants(BANDS, 3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_D = (_constants(BANDS, 4) >> np.uint64(32)).astype(np.uint32)


def kmers(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers of all texts in order, how many each text has); a text of under K words has one, without words none."""
    sizes = np.diff(bounds)
    counts = np.where(sizes >= K, sizes - K + 1, np.minimum(sizes, 1))
    text = np.repeat(np.arange(len(sizes)), counts)
    at = bounds[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros(len(text), np.uint64)
    long = sizes[text] >= K
    if len(words) >= K:
        out[long] = shingle_hashes(words, K)[at[long]]
    for i in np.flatnonzero(~long):
        own = words[bounds[text[i]] : bounds[text[i] + 1]]
        out[i] = mix(shingle_hashes(own, len(own)) + np.uint64(len(own)))[0]
    return out, counts


def labelled(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The k-mers with the number of earlier occurrences in their text mixed in."""
    if not len(grams):
        return grams
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    own = mix(grams ^ mix(text + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = np.append(False, own[order][1:] == own[order][:-1])
    run = np.arange(len(own)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(own))))
    earlier = np.zeros(len(own), np.uint64)
    earlier[order] = run.astype(np.uint64)
    return np.where(earlier > 0, mix(grams + earlier * np.uint64(0xD6E8FEB86659FD93)), grams)


def band_keys(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """texts x BANDS keys of the texts that have k-mers (in order)."""
    counts = counts[counts > 0]
    marked = labelled(grams, counts)
    starts = np.cumsum(counts) - counts
    small = (marked >> np.uint64(32)).astype(np.uint32)
    single = counts < SAMPLED
    sketches = np.zeros((ROWS * BANDS, len(counts)), np.uint64)
    index = np.arange(len(counts))
    for f in range(ROWS * BANDS if len(counts) else 0):
        v = small * _A[f] + _B[f]
        spots = np.empty((SAMPLED, len(counts)), np.int64)
        for turn in range(SAMPLED):
            at = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, starts), counts))
            if len(at) != len(counts):  # equal hashes: the first one
                at = at[np.searchsorted(at, starts + 0 * index)]
            spots[turn] = at
            v[at] = np.uint32(0xFFFFFFFF)
        spots.sort(axis=0)  # back to the order of the text
        sketch = np.full(len(counts), np.uint64(f + 1))
        for turn in range(SAMPLED):
            part = marked[spots[turn]]
            if turn:
                part = np.where(single, np.uint64(0), part)
            sketch = mix(sketch * np.uint64(0x9E3779B97F4A7C15) + part)
        sketches[f] = sketch
    keys = np.zeros((BANDS, len(counts)), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0xFF51AFD7ED558CCD) + sketches[r * BANDS : (r + 1) * BANDS])
    plain = (grams >> np.uint64(32)).astype(np.uint32)
    for band in range(BANDS if len(counts) else 0):
        least = np.minimum.reduceat(plain * _C[band] + _D[band], starts)
        keys[band] = mix(keys[band] * np.uint64(0xFF51AFD7ED558CCD) + least)
    return keys.T


def signatures(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """texts x PARTS numbers of 16 slots each; repeated k-mers count once."""
    slots = 16 * PARTS
    least = np.full(len(counts) * slots, np.iinfo(np.uint64).max, np.uint64)
    hashed = mix(grams + np.uint64(0xA0761D6478BD642F))
    np.minimum.at(least, np.repeat(np.arange(len(counts)), counts) * slots + (hashed % np.uint64(slots)).astype(np.int64), hashed)
    held = np.where(least == np.iinfo(np.uint64).max, np.uint64(0), mix(least) % np.uint64(15) + np.uint64(1))
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.bitwise_or.reduce(held.reshape(len(counts), PARTS, 16) << shifts, axis=2)


def parities(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """texts x (len(PARITY) + 1) numbers: the parity bits of their distinct k-mers, and how many these are."""
    bits, out = 64 * len(PARITY), np.zeros((len(counts), len(PARITY) + 1), np.uint64)
    bounds = np.append(0, np.cumsum(counts))
    single = labelled(grams, counts) == grams
    bit = (mix(grams + np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(bits)).astype(np.int64)
    for at in range(0, len(counts), 1024):
        part = slice(bounds[at], bounds[min(at + 1024, len(counts))])
        n = min(1024, len(counts) - at)
        text = np.repeat(np.arange(n), counts[at : at + n])[single[part]]
        odd = np.bincount(text * bits + bit[part][single[part]], minlength=n * bits).reshape(n, bits) & 1
        out[at : at + n, :-1] = np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)
        out[at : at + n, -1] = np.bincount(text, minlength=n)
    return out


def signed(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """texts x SIGNED."""
    return np.concatenate([signatures(grams, counts), signatures(labelled(grams, counts), counts), parities(grams, counts)], axis=1).astype(np.int64)


def _slots(x):
    """How many of the 16 slots of a number are not 0."""
    pairs = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return F.bit_count(pairs.bitwiseOR(F.shiftrightunsigned(pairs, 2)).bitwiseAND(F.lit(0x1111111111111111)))


def _within(left: str, right: str, columns: tuple[str, ...], least: float):
    """Whether the slots in use that differ between the signatures under two prefixes are within ERRORS of a share of 1 - least."""
    of = [(F.col(f"{left}{c}"), F.col(f"{right}{c}")) for c in columns]
    differ = sum((_slots(a.bitwiseXOR(b)) for a, b in of[1:]), _slots(of[0][0].bitwiseXOR(of[0][1])))
    used = sum((_slots(a.bitwiseOR(b)) for a, b in of[1:]), _slots(of[0][0].bitwiseOR(of[0][1])))
    return differ <= used * (1 - least) + ERRORS * F.sqrt(used * (least * (1 - least)))


def _near_parity(left: str, right: str, least: float):
    """Whether so few parity bits differ that distinct k-mers can have a similarity of `least`: exact, but one-sided."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{left}{c}").bitwiseXOR(F.col(f"{right}{c}"))) for c in PARITY))
    return differ <= (F.col(f"{left}kinds") + F.col(f"{right}kinds")) * ((1 - least) / (1 + least)) + 1e-6


def _alike(left: str, right: str, threshold: float = THRESHOLD):
    """Whether the signatures under two prefixes leave open that distinct k-mers reach FLOOR or labelled ones `threshold`."""
    return (_near_parity(left, right, FLOOR) & _within(left, right, SIGNATURE, FLOOR)) | _within(left, right, COUNTED, threshold)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest binary of the word sequence, keys array<long>, signatures) for each row. Narrow."""

    def make():
        scan = WordScanner()

        def kernel(texts):
            words, _, bounds = scan(texts)
            grams, counts = kmers(words, bounds)
            keys = band_keys(grams, counts).astype(np.int64)
            digests = []
            for i, text in enumerate(texts):
                own = words[bounds[i] : bounds[i + 1]]
                digests.append(hashlib.blake2b(own.tobytes() if len(own) else b"text " + (text.as_py() or "").encode(), digest_size=16).digest())
            offsets = np.append(0, np.cumsum((counts > 0) * BANDS)).astype(np.int32)
            return [pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))), *(pa.array(c) for c in signed(grams, counts).T.copy())]

        return kernel

    return map_texts(docs, [id_col], text_col, [T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), *(T.StructField(c, T.LongType()) for c in SIGNED)], make, 1 << 20)


def overlap(a: np.ndarray, b: np.ndarray, counted: bool = False) -> float:
    """Similarity of the distinct k-mers of two word sequences (hashes) that are not empty, or of the labelled ones."""
    grams, counts = kmers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    grams = labelled(grams, counts) if counted else grams
    first, second = np.unique(grams[: counts[0]]), np.unique(grams[counts[0] :])
    common = len(np.intersect1d(first, second, assume_unique=True))
    return common / (len(first) + len(second) - common)


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether the alignment of two word sequences (hashes) closes within the band of near duplicates.

    Texts whose k-mers have similarity t in order differ by at most (n + m) * (1 - t) / (1 + t) inserted and deleted
    words; that many make the band in which the alignment must close.
    """
    if min(len(a), len(b)) < K:
        return len(a) == len(b) and bool((a == b).all())
    band = int((len(a) + len(b)) * (1 - threshold) / (1 + threshold) + 1e-9)
    if abs(len(a) - len(b)) > band:
        return False
    # words that have no partner at all must be inserted or deleted
    _, side = np.unique(np.concatenate([a, b]), return_inverse=True)
    if np.abs(np.bincount(side[: len(a)], minlength=side.max() + 1) - np.bincount(side[len(a) :], minlength=side.max() + 1)).sum() > band:
        return False
    # anchors settle almost all pairs; where they lead astray, the plain banded alignment decides
    return anchored(a, b, band) is not None or indels(a.tolist(), b.tolist(), band) is not None


def anchored(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Insertions and deletions of an alignment of a and b that needs at most `band`, or None if none was found.

    K-mers that occur once on either side and keep their order are anchors; what lies between two anchors is aligned
    within what is left of the band.
    """
    whole = np.concatenate([a, b])
    bounds = np.array([0, len(a), len(whole)])
    grams, counts = kmers(whole, bounds)
    first, second = grams[: counts[0]], grams[counts[0] :]
    ua, ia, na = np.unique(first, return_index=True, return_counts=True)
    ub, ib, nb = np.unique(second, return_index=True, return_counts=True)
    _, x, y = np.intersect1d(ua[na == 1], ub[nb == 1], assume_unique=True, return_indices=True)
    at_a, at_b = ia[na == 1][x], ib[nb == 1][y]
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    chain = _increasing(at_b)
    at_a, at_b = at_a[chain], at_b[chain]
    total = 0
    i = j = 0  # all before is aligned
    steps = np.flatnonzero((np.diff(at_a, prepend=-2) != 1) | (np.diff(at_b, prepend=-2) != 1))
    ends = np.append(steps[1:], len(at_a))[: len(steps)] - 1
    for start_a, start_b, last_a, last_b in [*zip(at_a[steps].tolist(), at_b[steps].tolist(), at_a[ends].tolist(), at_b[ends].tolist()), (len(a), len(b), len(a) - K, len(b) - K)]:
        # k-mers overlap: a run may start inside what the last one aligned
        late = max(0, i - start_a, j - start_b)
        start_a, start_b = start_a + late, start_b + late
        if start_a > last_a + K or start_b > last_b + K:
            continue
        part = indels(a[i:start_a].tolist(), b[j:start_b].tolist(), band - total)
        if part is None:
            return None
        total += part
        i, j = last_a + K, last_b + K
    return total


def _increasing(values: np.ndarray) -> np.ndarray:
    """Positions of a longest increasing subsequence."""
    if (np.diff(values) > 0).all():
        return np.arange(len(values))
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values.tolist()):
        k = bisect.bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], np.int64)


def indels(x: list, y: list, band: int) -> int | None:
    """Least insertions and deletions between two sequences, or None beyond `band`: furthest-reaching points on diagonals."""
    n, m = len(x), len(y)
    if abs(n - m) > band:
        return None
    if not n or not m:
        return n + m
    reach = {1: 0}
    for d in range(band + 1):
        now = {}
        for k in range(-d, d + 1, 2):
            if k < -m or k > n:
                continue
            down, right = reach.get(k + 1, -1), reach.get(k - 1, -2) + 1
            i = down if down >= right else right
            j = i - k
            if i < 0 or i > n or j > m:
                continue
            while i < n and j < m and x[i] == y[j]:
                i += 1
                j += 1
            if i == n and j == m:
                return d
            now[k] = i
        reach = now
    return None


def _word_sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def make():
        scan = WordScanner()

        def kernel(texts):
            words, _, bounds = scan(texts)
            return [pa.array([words[a:b].astype("<u8").view("<u4")[1::2].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())]

        return kernel

    return map_texts(docs, [id_col], text_col, [T.StructField("words", T.BinaryType())], make, 1 << 20)


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose alignment closes and whose distinct or labelled k-mers are alike."""
    with_b = pairs.join(words.select(F.col("id").alias("b"), F.col("words").alias("of_b")), "b")
    both = with_b.join(words.select(F.col("id").alias("a"), F.col("words").alias("of_a")), "a").select("a", "b", "of_a", "of_b")
    id_type = pairs.schema["a"].dataType

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), "<u4").astype(np.uint64) for v in (x, y))
                keep.append((overlap(a, b) >= FLOOR or overlap(a, b, counted=True) >= threshold) and similar(a, b, threshold))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of a link (a, b) is connected to. Labels spread, then jump."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    new = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        labels = new.select("id", "label")
        seen = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "id").select("id", F.least("label", "near").alias("near"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("next"))
        old, new = new, materialize(nearer.join(jump, "near").select("id", F.least("near", "next").alias("label"), "old"), "labels")
        discard(old)
        if new.where("label <> old").isEmpty():
            discard(both)
            return new.select("id", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) for each distinct id: the smallest id of its class of near duplicates."""
    spark = docs.sparkSession
    named = docs.where(F.col(f"`{id_col}`").isNotNull())
    sketched = materialize(sketches(named, id_col, text_col).withColumnRenamed(id_col, "id"), "sketches")
    members = materialize(class_of(sketched, "digest", "id").select("id", "first"), "copies")
    first = members.where("id = first").select("id").distinct()
    bands = sketched.join(first, "id", "left_semi").select("id", F.posexplode("keys").alias("band", "key")).distinct()
    bands = materialize(bands, "bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    common = materialize(bands.join(shared, "key"), "buckets")
    central = common.groupBy("id").agg(F.sum("n").alias("weight"))
    small = sketched.select("id", *SIGNED).distinct()
    rows = materialize(common.join(central, "id").join(small, "id").select("key", "band", "id", "weight", *SIGNED), "buckets")
    discard(sketched, bands, common)
    release(spark)
    found = None
    if not rows.isEmpty():
        wanted = rows.select("id").distinct()
        words = materialize(_word_sequences(named.join(wanted.withColumnRenamed("id", id_col).hint("merge"), id_col, "left_semi"), id_col, text_col).withColumnRenamed(id_col, "id"), "words")
        found = _link(rows, words, threshold)
        discard(words)
    discard(rows)
    if found is None:
        return members.select(F.col("id").alias(id_col), F.col("first").alias("class_id")).distinct()
    out = members.join(found, members["first"] == found["node"], "left").select(members["id"].alias(id_col), F.coalesce("label", "first").alias("class_id"))
    # an id with several versions belongs to the smallest of their classes
    return out.groupBy(id_col).agg(F.min("class_id").alias("class_id"))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels (node, label) after more links (a, b): only the graph of the labels that they join is walked."""
    if labels is not None:
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
        links = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        links = links.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links, "links")
    if links.isEmpty():
        discard(links)
        return labels
    # each end keeps its smallest neighbour, and its other neighbours are tied to that one instead: one star each
    tied = class_of(links, "b", "a")
    stars = tied.select(F.col("first").alias("a"), F.col("id").alias("b")).where("a <> b").union(tied.select(F.col("first").alias("a"), F.col("key").alias("b"))).distinct()
    found = components(stars).withColumnRenamed("id", "node")
    discard(links)
    if labels is None:
        return found
    moved = found.select(F.col("node").alias("label"), F.col("label").alias("to"))
    kept = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(kept.unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels")


#: Members of a bucket that are compared with all others: one in round 0, about SPOTS * GROWTH ** (r - 1) in round r, the
#: most central of each spot that ids are hashed to. Where one component has most of a bucket, they are taken from it,
#: so that the few others meet some of it first, and all of it only if they link to none.
SPOTS, GROWTH = 8, 64


def _link(rows: DataFrame, words: DataFrame, threshold: float) -> DataFrame | None:
    """(node, label) of the members of buckets that are linked; rows are (key, band, id, weight, signatures)."""
    labels = None
    done: list[DataFrame] = []
    rows = whole = rows.withColumn("label", F.col("id"))
    turn = 0
    while True:
        now = rows.where(F.col("band") < EARLY) if turn == 0 else rows
        sizes = now.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("largest"), F.count("*").alias("labels")).where("labels > 1")
        sizes = materialize(sizes.select("key", F.when(F.col("largest.n") * 2 >= F.col("n"), F.col("largest.label")).alias("main")), "sizes")
        if turn and sizes.isEmpty():
            discard(sizes, *done, rows)
            return labels
        spot = F.pmod(F.xxhash64("id"), F.lit(SPOTS * GROWTH ** (turn - 1) if turn else 1))
        best = F.max(F.struct(F.coalesce(F.col("label") == F.col("main"), F.lit(False)).alias("is_main"), "weight", "id", "label", *SIGNED)).alias("c")
        centers = now.join(sizes, "key").groupBy("key", spot.alias("spot")).agg(best)
        centers = materialize(centers.select("key", F.col("c.id").alias("center"), F.col("c.label").alias("center_label"), *(F.col(f"c.{c}").alias(f"center_{c}") for c in SIGNED)), "centers")
        # a sort-merge join, so that Spark splits the rows of a large bucket
        pairs = now.hint("merge").join(centers, "key").where((F.col("label") != F.col("center_label")) & _alike("", "center_", threshold)).select(F.least("center", "id").alias("a"), F.greatest("center", "id").alias("b")).distinct()
        if done:
            pairs = pairs.join(reduce(DataFrame.unionByName, done), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        done.append(pairs)
        new = materialize(_verified(pairs, words, threshold), "links")
        labels = _joined(labels, new)
        left = rows.join(centers, (rows["key"] == centers["key"]) & (rows["id"] == centers["center"]), "left_anti").select("key", "band", "id", "weight", *SIGNED)
        if turn:
            left = left.join(sizes.select("key"), "key", "left_semi")
        if labels is not None:
            left = left.join(labels, left["id"] == labels["node"], "left").select("key", "band", "id", "weight", *SIGNED, F.coalesce("label", "id").alias("label"))
        else:
            left = left.withColumn("label", F.col("id"))
        left = materialize(left, "buckets")
        several = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        before, rows = rows, materialize(left.join(several, "key", "left_semi"), "buckets")
        discard(left, sizes, centers, new)
        if before is not whole:
            discard(before)
        turn += 1
