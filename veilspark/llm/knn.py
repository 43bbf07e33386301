"""Exact top-k inner products by a Voronoi join.

Vectors are dealt to the cells of a bounded set of pivots. A summary of each cell (rows, radius) bounds from above what
a query can score in it: ip(q, pivot) + |q| * radius. Each query is first solved in the cells that promise most, which
gives it a k-th best score; then it is sent only to the other cells whose bound reaches that score. Cells are sliced by
their row counts, so a hot cell is many groups, and only the queries that need a cell meet its rows.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without an id, take no part;
vectors of different lengths never meet; repeated rows count as candidates of their own, and an id that is repeated
among queries asks once, with its smallest vector; ties go to the smaller id; scaled components are limited to 64-bit
integers, whose scores wrap beyond that range (cells are then not pruned); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.kit import materialize

#: At most so many pivots, whose vectors the driver and each task hold.
MAX_PIVOTS = 512
#: A slice of a cell has about so many rows, and a block of a cell's queries too.
SLICE_ROWS = 8192
_WIDE = 1 << 22


def scaled(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v binary of int64): floor(scale * x) of each component; rows that take no part are left out."""
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False)
                if not np.isfinite(v).all():
                    continue
                ids.append(i)
                with np.errstate(over="ignore"):
                    out.append(np.clip(np.floor(scale * v), -(2.0**62), 2.0**62).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return source.mapInArrow(run, "vec_id long, v binary")


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), "<i8").reshape(len(values), dim) if dim else np.zeros((len(values), 0), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a @ b.T (64-bit; by floats where those are exact)."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Pivots:
    """The pivots, of any lengths; cell ids are positions in the list."""

    def __init__(self, vectors: list[bytes]):
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(v) // 8 for v in vectors}:
            cells = np.array([i for i, v in enumerate(vectors) if len(v) // 8 == dim])
            self.by_dim[dim] = cells, _matrix(pa.array([vectors[i] for i in cells], pa.binary()), dim)

    def nearest(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot, not too small) of each row; rows of a length without pivot get a cell of their own below zero."""
        if dim not in self.by_dim:
            return np.full(len(x), -1 - dim), np.full(len(x), np.inf)
        cells, p = self.by_dim[dim]
        xf, pf = x.astype(np.float64), p.astype(np.float64)
        d2 = (xf**2).sum(1)[:, None] - 2 * (xf @ pf.T) + (pf**2).sum(1)[None]
        best = d2.argmin(1)
        exact = ((xf - pf[best]) ** 2).sum(1)
        wide = np.abs(x).max(axis=1, initial=0) >= _WIDE
        return cells[best], np.where(wide, np.inf, np.sqrt(exact) * (1 + 1e-9) + 1e-6)


def _groups(batch: pa.RecordBatch, column: int):
    """Row positions by the vector's number of components."""
    dims = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False) // 8
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def _assign(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    def run(batches):
        for batch in batches:
            for dim, rows in _groups(batch, 1):
                part = batch.take(pa.array(rows))
                cell, dist = pivots.nearest(dim, _matrix(part.column(1), dim))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(dist)], names=["vec_id", "v", "cell", "dist"])

    return vectors.mapInArrow(run, "vec_id long, v binary, cell int, dist double")


def _route(queries: DataFrame, pivots: Pivots, cells: dict[int, tuple[int, float]], k: int, later: bool) -> DataFrame:
    """(cell, query_id, q): the first cells of each query or, with its `floor` known, all others that may matter."""

    def targets(dim: int, q: np.ndarray, floors: list):
        if dim not in pivots.by_dim:
            for i in range(len(q)):
                if not later and -1 - dim in cells:
                    yield i, -1 - dim
            return
        ids, p = pivots.by_dim[dim]
        known = np.array([int(c) in cells for c in ids])
        ids, p = ids[known], p[known]
        rows = np.array([cells[int(c)][0] for c in ids])
        radius = np.array([cells[int(c)][1] for c in ids])
        norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        bounds = q.astype(np.float64) @ p.astype(np.float64).T + norms[:, None] * radius[None] * (1 + 1e-9) + 1e-3
        bounds[np.isnan(bounds)] = np.inf
        near = q.astype(np.float64) @ p.astype(np.float64).T
        for i in range(len(q)):
            order = np.argsort(-near[i], kind="stable")
            first = max(2, int(np.searchsorted(np.cumsum(rows[order]), 4 * k)) + 1)
            if not later:
                yield from ((i, int(ids[c])) for c in order[:first])
            else:
                rest = order[first:]
                least = -np.inf if floors[i] is None else floors[i]
                yield from ((i, int(ids[c])) for c in rest[bounds[i][rest] >= least])

    def run(batches):
        for batch in batches:
            for dim, rows in _groups(batch, 1):
                part = batch.take(pa.array(rows))
                floors = part.column(2).to_pylist() if later else []
                found = list(targets(dim, _matrix(part.column(1), dim), floors))
                at = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([c for _, c in found], pa.int32()), part.column(0).take(at), part.column(1).take(at)], names=["cell", "query_id", "q"])

    return queries.mapInArrow(run, "cell int, query_id long, q binary")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a row, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= least)
    else:
        rows = np.arange(len(scores))
    return rows[np.lexsort((ids[rows], -scores[rows]))][:k]


def _solve(data: DataFrame, routed: DataFrame, counts: dict[int, int], k: int) -> DataFrame:
    """Partial top-k of each query in each slice of the cells it was sent to."""
    spark = data.sparkSession
    asked = {r["cell"]: -(-r["n"] // SLICE_ROWS) for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell at most
    plan = [(c, -(-n // SLICE_ROWS), asked.get(c, 0)) for c, n in counts.items() if c in asked]
    if not plan:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    sizes = F.broadcast(spark.createDataFrame(plan, "cell int, slices int, blocks int"))  # a row a cell at most
    left = data.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "slices").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")
    right = routed.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), "query_id", "q")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], []]
        if a.num_rows and b.num_rows:
            a, b = a.combine_chunks(), b.combine_chunks()
            vectors, queries = a["v"].combine_chunks(), b["q"].combine_chunks()
            ids, asking = a["vec_id"].to_numpy(), b["query_id"].to_numpy()
            a_dims, b_dims = (pa.compute.binary_length(x).to_numpy(zero_copy_only=False) // 8 for x in (vectors, queries))
            for dim in np.intersect1d(a_dims, b_dims).tolist():
                rows, qs = np.flatnonzero(a_dims == dim), np.flatnonzero(b_dims == dim)
                x = _matrix(vectors.take(pa.array(rows)), dim)
                for at in range(0, len(qs), 512):
                    part = qs[at : at + 512]
                    scores = _products(_matrix(queries.take(pa.array(part)), dim), x)
                    for row, q in zip(scores, asking[part], strict=True):
                        others = np.flatnonzero(ids[rows] != q)
                        best = others[_best(row[others], ids[rows][others], k)]
                        out[0] += [int(q)] * len(best)
                        out[1] += ids[rows][best].tolist()
                        out[2] += row[best].tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=schema)

    keys = ("cell", "slice", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows but its own for each row where is_query (of `vec_id`) holds."""
    vectors = scaled(df, id_col, vector_col, scale)
    n = vectors.count()
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "v").limit(min(max_pivots, max(1, int(n**0.5)))).select("v").collect()  # max_pivots at most
    pivots = Pivots(sorted({bytes(r["v"]) for r in chosen}))
    data = materialize(_assign(vectors, pivots), "knn-cells")
    cells = {r["cell"]: (r["n"], r["radius"]) for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}  # a row a pivot at most
    counts = {c: m for c, (m, _) in cells.items()}
    queries = data.where(is_query).groupBy("vec_id").agg(F.min("v").alias("q"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    first = materialize(ranked(_solve(data, _route(queries, pivots, cells, k, False), counts, k)).drop("rank"), "knn-first")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    known = queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "q", "floor")
    second = _solve(data, _route(known, pivots, cells, k, True), counts, k)
    return ranked(first.unionByName(second)).select("query_id", "rank", "vec_id", "score")
