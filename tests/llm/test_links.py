"""Links inside a bucket: no step makes a row for each pair of its members."""

import random

import numpy as np
import pytest

pytest.importorskip("xxhash")

from siftline.llm import alignment, graph
from siftline.llm.graph import classes, connected
from siftline.llm.near_dedup import word_aligner


@pytest.mark.parametrize("edits", [4, 9, 14])
def test_a_bucket_of_near_copies_makes_no_row_a_pair(spark, monkeypatch, edits):
    """Copies of one passage whose leader resembles none of them: rows stay few, classes are those of all pairs."""
    monkeypatch.setattr(graph, "BLOCK", 32)
    rng, n = random.Random(edits), 120
    base, texts = [f"w{k}" for k in range(60)], [" ".join(f"x{k}" for k in range(60))]
    for i in range(1, n):
        words = list(base)
        for k in rng.sample(range(60), edits):
            words[k] = f"own{i}" if rng.random() < 0.7 else f"some{k}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame([(b, i, 60) for i in range(n) for b in (1, 2)], "bucket long, node long, size int")
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    real, most = graph.written, []

    def counted(df, name):
        out = real(df, name)
        most.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    got = classes(rows, lambda ids: table.join(ids, "node"), lambda pairs: pairs.mapInArrow(word_aligner(0.8), "a long, b long"), graph.Marks(graph.word_bits, 1, 16), 0.8)
    root = np.arange(n)
    for i in range(n):
        for j in range(i):
            if alignment.similar(texts[i].split(), texts[j].split(), 0.8):
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    assert {r.id: r.root for r in got.collect()} == {i: int(r) for i, r in enumerate(root) if (root == r).sum() > 1}
    assert max(most) <= 8 * n  # two buckets, up to four bands; all pairs are 59 n


def test_connected_gives_a_forest_and_loses_no_link():
    rng = np.random.default_rng(4)
    for n, share in ((2, 1.0), (40, 0.0), (40, 0.03), (80, 0.5), (80, 1.0)):
        a, b = np.triu_indices(n, 1)
        holds, tried = rng.random(len(a)) < share, []

        def alike(k, holds=holds, tried=tried):
            tried.extend(k.tolist())
            return holds[k]

        root, links = connected(np.arange(n), a, b, rng.random(len(a)), alike)
        want = np.arange(n)
        for i, j in zip(a[holds], b[holds], strict=True):
            want[want == max(want[i], want[j])] = min(want[i], want[j])
        assert root.tolist() == want.tolist() and len(links) == n - len(set(want.tolist()))
        assert len(tried) == len(set(tried)) and all(holds[(a == i) & (b == j)][0] for i, j in links)
        assert share < 1 or len(tried) <= 2 * n
