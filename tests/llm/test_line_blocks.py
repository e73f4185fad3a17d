"""The steps of op2_line_dedup and op9_minhash_dedup that work on arrays, against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftline.llm import alignment
from siftline.llm.alignment import similar, similar_texts
from siftline.llm.common import written
from siftline.llm.graph import BAND, shared
from siftline.llm.line_dedup import MARKS


def edited(rng, text, edits, letters="xyé "):
    out = list(text)
    for _ in range(edits):
        i = rng.randrange(len(out) + 1)
        out[i : i + rng.randint(0, 1)] = rng.choice(["", *letters])
    return "".join(out)


def test_alignments_side_by_side_equal_those_one_by_one():
    rng, firsts, seconds = random.Random(4), ["", "", "a"], ["", "abc", ""]
    for k in range(900):
        size = rng.choice([1, 9, 60, 300, 700]) if k % 3 else rng.randint(0, 400)
        a = "".join(rng.choice("abcde 漢") for _ in range(size))
        b = edited(rng, a, rng.randint(0, max(1, size // rng.choice([8, 10, 20])))) if k % 7 else a[::-1]
        firsts.append(a if k % 2 else b)
        seconds.append(b if k % 2 else a)
    for share in (0.8, 0.9, 1.0):
        got = similar_texts(firsts, seconds, share)
        assert got.tolist() == [similar(a, b, share) for a, b in zip(firsts, seconds, strict=True)] and 0 < got.sum() < len(got)
    assert len(similar_texts([], [], 0.9)) == 0


def test_long_texts_are_aligned_side_by_side(monkeypatch):
    """Bands of several words a row give what single alignments give, and few pairs are aligned alone."""
    rng, firsts, seconds = random.Random(9), [], []
    for k in range(240):
        firsts.append("".join(rng.choice("abcdefgh 漢") for _ in range(rng.randint(650, 1900))))
        edits = 0.13 * len(firsts[-1]) * rng.random()
        seconds.append(edited(rng, firsts[-1], int(edits)) if k % 2 else firsts[-1][:40] + "".join(rng.sample(firsts[-1][40:], len(firsts[-1]) - 40)))
    want = [similar(a, b, 0.9) for a, b in zip(firsts, seconds, strict=True)]
    alone = []
    one_by_one = alignment.banded_distance
    monkeypatch.setattr(alignment, "banded_distance", lambda *a: alone.append(a) or one_by_one(*a))
    assert similar_texts(firsts, seconds, 0.9).tolist() == want and 60 < sum(want) < 180
    assert len(alone) < 40


def test_placed_marks_never_rule_out_a_pair_that_holds():
    """And of unrelated texts of the same words they rule out nearly all."""
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    ruled_out = tried = 0
    for _ in range(300):
        a = " ".join(rng.choice(words) for _ in range(rng.randint(4, 90)))
        near = edited(rng, a, rng.randint(0, len(a) // 9))
        far = " ".join(rng.choice(words) for _ in range(90))[: len(a)]
        for b in (near, far):
            home = int(np.floor(np.log(len(b)) / -np.log(0.9) / BAND))
            (_, own, _), (_, _, around) = MARKS.sides(np.array([home]), [b], 0.9), MARKS.sides(np.array([home]), [a], 0.9)
            own, around = (np.frombuffer(x[0], np.uint64)[None, :] for x in (own, around))
            may = MARKS.lost(own, around, np.zeros(1), np.zeros(1))[0] <= 3 * int(max(len(a), len(b)) * 0.1 + 1e-9)
            assert may or not similar(a, b, 0.9)
            if b is far and 100 <= len(a) <= 500:
                tried, ruled_out = tried + 1, ruled_out + (not may)
    assert ruled_out >= 0.95 * tried > 0


def test_shared_buckets_over_several_batches():
    rng = random.Random(8)
    rows = sorted((rng.randrange(-40, 60), rng.randrange(30), 0) for _ in range(120)) + [(99, k % 50, 0) for k in range(200)] + [(100, 7, 0)] * 3
    rows = [(b, n, n + 100) for b, n, _ in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 7]), (pa.int64(), pa.int64(), pa.int32()))], names=["bucket", "node", "size"]) for k in range(0, len(rows), 7)]
    of = defaultdict(set)
    for b, n, _ in rows:
        of[b].add(n)
    got = [tuple(r.values()) for batch in shared(iter(batches)) for r in batch.to_pylist()]
    assert sorted(got) == sorted((b, n, n + 100, min(s), min(s) + 100) for b, s in of.items() if len(s) > 1 for n in s)
    assert list(shared(iter([]))) == []


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")

    before = files()
    out = written(spark.range(10_000).groupBy((F.col("id") % 1_000).alias("k")).count(), "counted")
    assert files() <= before
    assert out.count() == 1_000
