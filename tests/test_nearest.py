"""Nearest vectors against all pairs."""

import numpy as np
import pytest

from siftline.operators import importer, nearest, retrieval


def clustered(seed, n, groups=12, dims=16, spread=0.15):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims))
    x = middles[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[: n // 3] = x[0]  # a third of all rows are copies
    return x


def sims(a, b):
    return np.round(a @ b.T, 9)


def test_max_sim_equals_all_pairs(spark):
    x, q = clustered(1, 900), clustered(2, 30)
    docs = [(f"s{k % 2}", k, list(map(float, v))) for k, v in enumerate(x)] + [("s0", 5000, None)]
    chunks = [(f"q{k % 7}", k, list(map(float, v))) for k, v in enumerate(q)]
    count = spark.sparkContext.accumulator(0)
    corpus = spark.createDataFrame(docs, "section string, doc_id int, embedding array<double>").repartition(5)
    got = retrieval.max_sim(corpus, spark.createDataFrame(chunks, "query_id string, chunk_idx int, embedding array<double>"), 9, count)
    rows = sorted((r.query_id, r.section, r["rank"], r.doc_id, round(r.score, 6), r.best_chunk) for r in got.collect())
    want = []
    for query in sorted({c[0] for c in chunks}):
        mine = [k for k, c in enumerate(chunks) if c[0] == query]
        all_ = sims(x, q[mine])
        for s in ("s0", "s1"):
            order = sorted((-all_[k].max(), k) for k in range(len(x)) if docs[k][0] == s)[:9]
            want += [(query, s, n, k, round(-v, 6), mine[int(all_[k].argmax())]) for n, (v, k) in enumerate(order)]
    assert rows == sorted(want)
    assert 0 < count.value < 0.8 * len(x) * len(q)


def test_max_sim_with_few_and_no_documents(spark):
    chunks = spark.createDataFrame([("q", 0, [1.0, 0.0])], "query_id string, chunk_idx int, embedding array<double>")
    none = spark.createDataFrame([], "section string, doc_id int, embedding array<double>")
    assert retrieval.max_sim(none, chunks, 3).collect() == []
    one = spark.createDataFrame([("s", 1, [0.5, 0.5])], "section string, doc_id int, embedding array<double>")
    assert [(r.doc_id, r.score, r["rank"]) for r in retrieval.max_sim(one, chunks, 3).collect()] == [(1, 0.5, 0)]
    assert retrieval.max_sim(one, chunks.where("false"), 3).collect() == []


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 4)
    x = clustered(3, 60)
    corpus = spark.createDataFrame([("s", k, list(map(float, v))) for k, v in enumerate(x)], "section string, doc_id int, embedding array<double>")
    chunks = spark.createDataFrame([(f"q{k}", 0, list(map(float, v))) for k, v in enumerate(x[30:45])], "query_id string, chunk_idx int, embedding array<double>")
    got = {(r.query_id, r.doc_id) for r in retrieval.max_sim(corpus, chunks, 1).collect()}
    all_ = sims(x, x[30:45])
    assert got == {(f"q{k}", int(all_[:, k].argmax())) for k in range(15)}


@pytest.mark.parametrize("unit", [7, 2000])
def test_edges_equal_all_pairs(spark, monkeypatch, unit):
    monkeypatch.setattr(nearest, "UNIT", unit)
    x = clustered(4, 150)
    x[40] = -x[40]
    rows = [(k % 2, k, list(map(float, v))) for k, v in enumerate(x)]
    vectors, count = spark.createDataFrame(rows, "block int, id int, embedding array<double>").repartition(4), spark.sparkContext.accumulator(0)
    pairs = nearest.similar_pairs(vectors, "block", 0.9, count)
    all_ = sims(x, x)
    want = {(a % 2, a, b) for a in range(150) for b in range(a + 1, 150) if a % 2 == b % 2 and all_[a, b] >= 0.9}
    got = [(r.block, r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    tops = {a: max([0.0, *(all_[a, b] for b in range(150) if b != a and a % 2 == b % 2)]) for a in range(150)}
    edges = {(r.a, r.b) for r in importer.nearest_edges(vectors, "block", 0.9).collect()}
    assert edges == {(a, b) for _, a, b in want if all_[a, b] >= tops[a] - 1e-9 and all_[a, b] >= tops[b] - 1e-9}


def test_far_groups_do_not_meet(spark):
    x = clustered(5, 600, groups=30, spread=0.03)
    vectors = spark.createDataFrame([(0, k, list(map(float, v))) for k, v in enumerate(x[200:])], "block int, id int, embedding array<double>")
    count = spark.sparkContext.accumulator(0)
    nearest.similar_pairs(vectors, "block", 0.95, count).count()
    assert count.value < 0.5 * 400 * 399 / 2
