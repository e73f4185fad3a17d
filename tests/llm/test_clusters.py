"""Exponion clustering against plain k-means."""

import hashlib

import numpy as np
import pytest

from siftline.llm.exponion import Centroids, clustered, exponion_kmeans, outwards, search, squares, start


def plain(vectors, k=8, rounds=10):
    """(cluster, distance) by id, and the centroids, with every distance worked out."""
    rows = [(i, np.floor(np.array(v, dtype=np.float32).astype(np.float64) * 1024).astype(np.int64)) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v in rows])
    order = sorted(range(len(rows)), key=lambda n: (hashlib.sha256(f"3:{'' if rows[n][0] is None else rows[n][0]}".encode()).hexdigest(), list(x[n])))
    c = x[order[:k]].copy()
    for n in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if n < rounds:
            for j in range(len(c)):
                if (a == j).any():
                    c[j] = x[a == j].sum(axis=0) // int((a == j).sum())
    return sorted(((i is not None, i or 0), int(j), int(d[n, j])) for n, ((i, _), j) in enumerate(zip(rows, a, strict=True))), c


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")


def test_clusters_odd_rows_and_ties(spark):
    rng = np.random.default_rng(5)
    grid = [(n, [float(x) / 1024 for x in rng.integers(-1, 2, 64)]) for n in range(150)]  # small integers: many ties
    odd = [(200, None), (201, [0.5] * 63), (202, [None] + [0.5] * 63), (203, [float("nan")] * 64), (204, [float("inf")] + [0.0] * 63), (None, [0.25] * 64), (5, [0.125] * 64), (5, [0.125] * 64)]
    got = clustered(table(spark, grid + odd))
    want, c = plain(grid + odd)
    rows = got.collect()
    assert sorted(((r["vec_id"] is not None, r["vec_id"] or 0), r["cluster"], r["distance"]) for r in rows) == want
    marks = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    assert all(r["centroid_sha256"] == marks[r["cluster"]] for r in rows)
    assert {r["inertia"] for r in rows} == {sum(d for _, _, d in want)}
    assert all(r["cluster_inertia"] == sum(d for _, j, d in want if j == r["cluster"]) for r in rows)


def test_clusters_of_few_and_no_vectors(spark):
    few = [(n, [float(n)] * 64) for n in range(3)]
    assert sorted((r["vec_id"], r["distance"]) for r in clustered(table(spark, few)).collect()) == [(0, 0), (1, 0), (2, 0)]
    empty = clustered(table(spark, [(1, None)]))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_component_beyond_the_bound_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        clustered(table(spark, [(1, [1e6] * 64)])).collect()


def test_search_scans_less_and_finds_the_same():
    rng = np.random.default_rng(2)
    middles = rng.integers(-900, 900, (12, 64))
    x = (middles[rng.integers(0, 12, 4000)] + rng.integers(-60, 60, (4000, 64))).astype(np.int64)
    at, scanned = Centroids(x[:12].copy(), np.zeros(12)), 0
    for n in range(8):
        if n:
            scanned += search(x, cluster, upper, lower, at)
        else:
            cluster, upper, lower, _ = start(x, at)
        d = squares(x[:, None, :] - at.places[None])
        assert (cluster == d.argmin(axis=1)).all()
        others = np.where(np.arange(12) == cluster[:, None], np.iinfo(np.int64).max, d)
        assert (upper >= np.sqrt(d.min(axis=1))).all() and (lower <= np.sqrt(others.min(axis=1))).all()
        places = np.array([x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else at.places[j] for j in range(12)])
        at = Centroids(places, outwards(squares(places - at.places)))
    assert scanned < 0.25 * 7 * 12 * len(x)


def test_bounds_hold_between_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(n, [float(x) for x in rng.normal(size=64)]) for n in range(400)]
    found = exponion_kmeans(table(spark, rows), k=5, rounds=4)
    want, c = plain(rows, 5, 4)
    assert sorted(((True, r[0]), r[1], r[2]) for r in found.rows.select("vec_id", "cluster", "distance").collect()) == want
    assert found.centroids == c.tolist() and found.vectors == 400 and found.computed <= 5 * 5 * 400 + 5 * 400
