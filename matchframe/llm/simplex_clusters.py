"""Centroid clustering with n-simplex projection.

Distances of a vector to a few pivots, worked out once and kept, are turned into coordinates: the pivots are the base
of a simplex and the vector its apex, at the height over their plane that is left of its length. For two vectors with
apexes x and y, the Euclidean distance of x and y is never more than theirs, and that of x and y with the last
coordinate's sign turned is never less. Each round projects the centroids onto the same pivots; a centroid whose
lower bound exceeds the least upper bound of all is out, and the rest are compared exactly, in integers.

Vectors are kept with exactly `size` components, none null or not finite, and become integers floor(1024 x). A component
of 2^27 or more, whose distances would not fit in a long, is an error. The first centroids are the kept vectors
whose ids have the smallest hashes (a null id has none and is only assigned; ids that stand twice count twice, smaller
components first). Fewer vectors than clusters give as many clusters as vectors with an id. A tie goes to the smaller
number. An empty table gives an empty result. Columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE, LARGEST = 1024, 1 << 27
#: Stored vectors: components moved above zero and big-endian, so that their bytes have the order of the components.
_STORED, _ABOVE = ">i8", 1 << 62
#: Relative room for rounding in the bounds, which are floating-point numbers; the comparison itself is not.
ROOM = 1e-9


class Simplex:
    """Coordinates over pivots, from distances alone."""

    def __init__(self, pivots: np.ndarray) -> None:
        """pivots: integer vectors. Those in the plane of earlier ones are left out, as they tell nothing new."""
        self.pivots, self.base = pivots[:1], np.zeros((1, 0))
        for p in pivots[1:]:
            apex = self.apexes(squares(p[None], self.pivots).astype(float))
            if apex[0, -1] > 1e-6 * max(1.0, np.abs(apex).max()):
                self.base = np.vstack([np.hstack([self.base, np.zeros((len(self.base), 1))]), apex])
                self.pivots = np.vstack([self.pivots, p[None]])

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """A row of coordinates for each row of squared distances to the pivots; the last one is the height, 0 or more."""
        n = len(self.base)
        out = np.zeros((len(squared), n))
        for k in range(1, n):  # the equations of pivots 0 and k, one coordinate after the other
            b = self.base[k]
            known = out[:, : k - 1] @ b[: k - 1]
            out[:, k - 1] = (squared[:, 0] - squared[:, k] + b @ b - 2 * known) / (2 * b[k - 1])
        out[:, n - 1] = np.sqrt(np.maximum(squared[:, 0] - (out[:, : n - 1] ** 2).sum(axis=1), 0))
        return out


def squares(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each point, in integers."""
    out = np.empty((len(vectors), len(points)), np.int64)
    for k, p in enumerate(points):
        moved = vectors - p
        out[:, k] = (moved * moved).sum(axis=1)
    return out


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector, its exact squared distance, and how many pairs were compared exactly."""
    ends = simplex.apexes(squares(centroids, simplex.pivots).astype(float))
    plane = ((apexes[:, None, :-1] - ends[None, :, :-1]) ** 2).sum(axis=2)
    low = plane + (apexes[:, None, -1] - ends[None, :, -1]) ** 2
    high = plane + (apexes[:, None, -1] + ends[None, :, -1]) ** 2
    room = ROOM * (1 + (apexes**2).sum(axis=1)[:, None] + (ends**2).sum(axis=1)[None])
    open_ = low - room <= (high + room).min(axis=1)[:, None]
    best, number = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int64)
    for k in range(len(centroids)):  # in order, so that a tie stays with the smaller number
        some = np.flatnonzero(open_[:, k])
        moved = vectors[some] - centroids[k]
        exact = (moved * moved).sum(axis=1)
        closer = exact < best[some]
        best[some[closer]], number[some[closer]] = exact[closer], k
    return number, best, int(open_.sum())


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _vectors(column: pa.Array) -> np.ndarray:
    return _matrix(column, _STORED).astype(np.int64) - _ABOVE


def kept(rows: DataFrame, size: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (the integer components, 8 bytes each)."""
    good = F.col("x").isNotNull() & (F.size("x") == size) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.coalesce(good, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(SCALE * batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError("a component is too large for exact distances in a long")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in (x.astype(np.int64) + _ABOVE).astype(_STORED)], pa.binary())], ["vec_id", "x"])

    return rows.mapInArrow(run, "vec_id long, x binary")


def first_vectors(vectors: DataFrame, n: int, seed: int = 3) -> np.ndarray:
    """The n vectors whose ids have the smallest hashes, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select("x", order.alias("at")).orderBy("at", "x").limit(n).collect()  # n rows
    return _vectors(pa.array([r.x for r in rows], pa.binary())) if rows else np.empty((0, 0), np.int64)


def projected(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """vec_id, x, apex: the coordinates of each vector over the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(squares(_vectors(batch.column(1)), simplex.pivots).astype(float)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype("<f8").tobytes() for a in apexes], pa.binary())], ["vec_id", "x", "apex"])

    return vectors.mapInArrow(run, "vec_id long, x binary, apex binary")


def moved(vectors: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round: floor of the mean of the vectors nearest to each; those of none stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(0))
                number, _, _ = nearest(x, _matrix(batch.column(1), "<f8"), centroids, simplex)
                counts += np.bincount(number, minlength=len(centroids))
                np.add.at(sums, number, x)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = vectors.select("x", "apex").mapInArrow(run, "cluster long, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("axis", "v"))
    # sums of all tasks: beyond a long's range if need be
    sums = each.groupBy("cluster", "axis").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = centroids.copy()
    for r in sums.collect():  # clusters times axes
        out[r.cluster, r.axis] = int(r.v) // int(r.n)
    return out


def clusters(rows: DataFrame, k: int = 8, rounds: int = 10, pivots: int = 8, size: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that is kept."""
    vectors = materialise(kept(rows, size, id_col, vector_col), "vectors")
    centroids = first_vectors(vectors, k, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        none = vectors.where(F.lit(False)).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.select("*", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    simplex = Simplex(centroids[:pivots])  # the first centroids: later ones stay near them
    vectors = materialise(projected(vectors, simplex), "apexes")
    for _ in range(rounds):
        before, centroids = centroids, moved(vectors, centroids, simplex)
        if np.array_equal(before, centroids):  # further rounds would change nothing
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, exact, _ = nearest(_vectors(batch.column(1)), _matrix(batch.column(2), "<f8"), centroids, simplex)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(exact)], ["vec_id", "cluster", "distance"])

    assigned = materialise(vectors.mapInArrow(run, schema), "assigned")
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each cluster
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = sum(sums.values())
    facts = assigned.sparkSession.createDataFrame([(c, d, total, hashes[c]) for c, d in sums.items()], "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col("of")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
