"""Exact k-means over integer vectors by Exponion search.

Every vector carries an upper bound on the distance to its centroid and a lower
bound on the distance to any other. Where the upper bound is below the lower one,
no distance is worked out. Otherwise the upper bound is made exact, and where that
doesn't settle it, only the centroids inside a ball around the vector's current
centroid are scanned: its radius is twice the upper bound plus the distance to the
nearest other centroid, so it holds the nearest and the second nearest centroid.
The ball is read off each centroid's list of the others, sorted by distance; the
radius is inclusive, so centroids at equal distance meet and the smaller number
wins. Squared distances are exact 64-bit integers; bounds are doubles, rounded
outwards.

A round is one pass over a written table of vectors with their bounds. It writes
the table of the next round, and with it, a row a task and cluster, what the
vectors that changed cluster add to and take from the clusters' sums; Spark adds
these up, and only `k` sums reach the driver. Tables of earlier rounds are deleted.
`k` centroids and their k x k distances go to every task: k is a parameter, not
a property of the data.

Defined results: vectors that are null, of another length, or hold a null or
non-finite component are left out; rows that repeat an id are vectors each; a null
id counts as empty where the first centroids are drawn; rows alike in hash are
ordered by their components; fewer vectors than `k` give as many centroids; a
centroid that loses all its vectors stays where it is; an empty table gives an
empty result. Components beyond 2**27 after scaling are an error, as distances
would pass 64 bits. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Largest magnitude of a scaled component: 64 differences of twice that, squared, add up to less than 2**63.
LARGEST = 1 << 27
STATE = "vec_id long, vector array<int>, cluster int, upper double, lower double, distance long, sums array<long>, members long, computed long"
#: A relative error that covers a few roundings of a double.
SLACK = 1e-12


@dataclass(frozen=True)
class Centroids:
    """The centroids of a round, how far each has moved since the last one, and each one's list of the others by distance."""

    places: np.ndarray
    moved: np.ndarray

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """order[a]: a and the others, by distance from a (rounded down); near[a]: these distances."""
        apart = np.sqrt(squares(self.places[:, None, :] - self.places[None, :, :])) * (1 - SLACK)
        np.fill_diagonal(apart, -1.0)  # a itself comes first, also where another lies on it
        order = np.argsort(apart, axis=1, kind="stable")
        return order, np.maximum(np.take_along_axis(apart, order, axis=1), 0.0)


def squares(differences: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", differences, differences)


def outwards(d2: np.ndarray) -> np.ndarray:
    """An upper bound of the square root."""
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK)


def inwards(d2: np.ndarray) -> np.ndarray:
    """A lower bound of the square root."""
    return np.sqrt(d2.astype(np.float64)) * (1 - SLACK)


def search(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Centroids) -> int:
    """Move every vector to its nearest centroid, in place; returns how many distances that took."""
    c, (order, near) = at.places, at.lists()
    k = len(c)
    if k == 1:
        return 0
    # the bounds hold for the last places: the own centroid may have moved away, any other one closer
    by_move = np.argsort(-at.moved, kind="stable")
    closer = np.where(np.arange(k) == by_move[0], at.moved[by_move[1]], at.moved[by_move[0]])
    upper += at.moved[cluster]
    upper *= 1 + SLACK
    lower -= closer[cluster]
    lower *= np.where(lower > 0, 1 - SLACK, 1 + SLACK)
    open_ = np.flatnonzero(upper >= lower)
    own = squares(x[open_].astype(np.int64) - c[cluster[open_]])
    upper[open_] = outwards(own)
    still = upper[open_] >= lower[open_]
    computed, open_, own = len(open_), open_[still], own[still]
    was = cluster[open_]
    radius = (2 * upper[open_] + near[was, 1]) * (1 + SLACK)
    for a in np.unique(was):
        mine = np.flatnonzero(was == a)
        mine = mine[np.argsort(radius[mine], kind="stable")]
        rows, balls = open_[mine], radius[mine]
        vectors = x[rows].astype(np.int64)
        best, at_best = own[mine].copy(), np.full(len(rows), a, dtype=np.int32)
        second = np.full(len(rows), np.iinfo(np.int64).max)
        for j, far in zip(order[a][1:], near[a][1:], strict=True):
            first = int(np.searchsorted(balls, far, side="left"))  # those whose ball reaches j
            if first == len(rows):
                break
            d2 = squares(vectors[first:] - c[j])
            computed += len(d2)
            b, n, s = best[first:], at_best[first:], second[first:]
            wins = (d2 < b) | ((d2 == b) & (j < n))
            s[:] = np.where(wins, b, np.minimum(s, d2))
            b[wins], n[wins] = d2[wins], j
        cluster[rows], upper[rows], lower[rows] = at_best, outwards(best), inwards(second)
    return computed


def start(x: np.ndarray, at: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The first round: every distance, as no bound is known yet."""
    best = squares(x.astype(np.int64) - at.places[0])
    cluster, second = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.iinfo(np.int64).max)
    for j in range(1, len(at.places)):
        d2 = squares(x.astype(np.int64) - at.places[j])
        wins = d2 < best
        second = np.where(wins, best, np.minimum(second, d2))
        best[wins], cluster[wins] = d2[wins], j
    return cluster, outwards(best), inwards(second), len(x) * len(at.places)


def flat(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def assigner(at: Centroids, last: bool):
    """One round of a task: the vectors with their new state, then a row a cluster with what changed in its sums."""
    k, dims = at.places.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, members, computed = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = flat(batch.column(1), dims)
            if batch.num_columns == 2:
                was = np.full(n, -1, np.int32)
                cluster, upper, lower, took = start(x, at)
            else:
                was = batch.column(2).to_numpy()
                cluster, upper, lower = was.copy(), batch.column(3).to_numpy().copy(), batch.column(4).to_numpy().copy()
                took = search(x, cluster, upper, lower, at)
            computed += took
            changed = np.flatnonzero(cluster != was)
            for j in range(k):
                came, went = x[changed[cluster[changed] == j]], x[changed[was[changed] == j]]
                sums[j] += came.sum(axis=0, dtype=np.int64) - went.sum(axis=0, dtype=np.int64)
                members[j] += len(came) - len(went)
            distance = pa.array(squares(x.astype(np.int64) - at.places[cluster])) if last else pa.nulls(n, pa.int64())
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(upper), pa.array(lower), distance, pa.nulls(n, pa.list_(pa.int64())), none, none], names=[c.split()[0] for c in STATE.split(", ")])
        nothing, count = pa.nulls(k, pa.float64()), np.zeros(k, np.int64)
        count[0] = computed
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), pa.array(np.arange(k, dtype=np.int32)), nothing, nothing, pa.nulls(k, pa.int64()), lists(sums), pa.array(members), pa.array(count)], names=[c.split()[0] for c in STATE.split(", ")]
        )

    return run


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """vec_id and vector, an array of integers, of the rows that hold a whole vector."""
    v = F.col(vector_col)
    whole = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    checked = F.when(F.exists(scaled, lambda x: F.abs(x) > LARGEST), F.raise_error(F.lit(f"a component beyond {LARGEST} after scaling"))).otherwise(scaled)
    return df.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), checked.cast("array<int>").alias("vector"))


def seeds(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the least hash of their ids, in its order."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    drawn = vectors.select("vector", key.alias("_key")).orderBy("_key", "vector").limit(k).collect()
    return np.array([r["vector"] for r in drawn], dtype=np.int64)


def changes(state: DataFrame) -> tuple[dict[tuple[int, int], int], dict[int, int], int]:
    """What a round changed in the sums by (cluster, component) and in the members by cluster, and the distances it took."""
    parts = state.where("sums is not null")
    rows = parts.select("cluster", "members", "computed", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at")
    got = rows.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("members").alias("members"), F.sum("computed").alias("computed")).collect()
    first = [r for r in got if r["at"] == 0]
    return {(r["cluster"], r["at"]): int(r["s"]) for r in got}, {r["cluster"]: r["members"] for r in first}, sum(r["computed"] for r in first)


@dataclass(frozen=True)
class Clustering:
    """rows: vec_id, vector, cluster, distance; centroids: of the last round; inertia: by cluster; computed: distances worked out; vectors: how many."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]
    computed: int
    vectors: int


def exponion_kmeans(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering | None:
    """k clusters after `rounds` updates of the centroids and a last assignment; None where no vector is whole."""
    vectors = written(whole_vectors(df, id_col, vector_col, dims, scale), "vectors")
    places = seeds(vectors, k, seed)
    if not len(places):
        return None
    k = len(places)
    at, state = Centroids(places, np.zeros(k)), vectors
    sums, members, computed = [[0] * dims for _ in range(k)], [0] * k, 0
    for round_ in range(rounds + 1):
        before, rows = state, state if not round_ else state.where("sums is null").select("vec_id", "vector", "cluster", "upper", "lower")
        state = written(rows.mapInArrow(assigner(at, round_ == rounds), STATE), f"round{round_}")
        forget(before)
        added, joined, took = changes(state)
        computed += took
        for (j, d), s in added.items():
            sums[j][d] += s
        for j, n in joined.items():
            members[j] += n
        if round_ < rounds:
            moved_to = np.array([[s // members[j] for s in sums[j]] if members[j] else list(map(int, at.places[j])) for j in range(k)], dtype=np.int64)
            at = Centroids(moved_to, outwards(squares(moved_to - at.places)))
    rows = state.where("sums is null").select("vec_id", "vector", "cluster", "distance")
    inertia = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())
    return Clustering(rows, [list(map(int, p)) for p in at.places], [inertia.get(j, 0) for j in range(k)], computed, sum(members))


def centroid_mark(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(df: DataFrame, **parameters) -> DataFrame:
    """A row a whole vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = exponion_kmeans(df, **parameters)
    if found is None:
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    marks = [centroid_mark(c) for c in found.centroids]
    return found.rows.select("vec_id", "cluster", "distance", of_cluster(found.inertia, "long").alias("cluster_inertia"), F.lit(sum(found.inertia)).cast("long").alias("inertia"), of_cluster(marks, "string").alias("centroid_sha256"))
