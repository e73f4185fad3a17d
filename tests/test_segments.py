"""The segment index against scores worked out from the documents."""

import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftline.functions.text import tokens
from siftline.operators import retrieval
from siftline.sources.log import Conflict, Log
from siftline.sources.segments import SegmentIndex

WORDS = ["alpha", "beta", "gamma", "delta", "running", "runs", "k8s", "spark", "data", "the", "omega", "sigma"]


def docs(spark, rows):
    return spark.createDataFrame(rows, "section string, doc_id int, text string")


def made(seed, n, sections=("x", "y")):
    rng = random.Random(seed)
    return [(rng.choice(sections), k, " ".join(rng.choices(WORDS, [9, 5, 4, 3, 2, 2, 1, 1, 6, 9, 1, 1], k=rng.randint(0, 12)))) for k in range(n)]


def queries(spark):
    return spark.createDataFrame([("q1", "alpha running running kubernetes"), ("q2", "omega sigma missing"), ("q3", "nothing")], "query_id string, text string").select("query_id", tokens(F.col("text")).alias("tokens"))


def rounded(df):
    return sorted((r.query_id, r.section, r.doc_id, round(r.score, 9)) for r in df.collect())


def fresh(spark, rows, **how):
    return rounded(retrieval.bm25_scores(docs(spark, rows).withColumn("tokens", tokens(F.col("text"))), queries(spark), **how))


def size(tmp_path):
    return sum(f.stat().st_size for f in Path(tmp_path).rglob("*.parquet"))


@pytest.mark.parametrize("stem", [False, True])
def test_scores_follow_every_change(spark, tmp_path, stem):
    index = SegmentIndex(spark, f"file://{tmp_path}/i", stem=stem, buckets=4)
    rows = made(1, 120)
    assert index.sync(docs(spark, rows)) == {"added": 120, "gone": 0}
    assert rounded(index.scores(queries(spark))) == fresh(spark, rows, stem=stem)
    changed = [(s, k, t + " omega" if k % 10 == 0 else t) for s, k, t in rows if k % 7] + [("y", 500, "sigma sigma")]
    wanted = {"added": sum(k % 10 == 0 for _, k, _ in changed if k < 500) + 1, "gone": 120 - sum(k % 10 != 0 for _, k, _ in changed if k < 500)}
    assert index.sync(docs(spark, changed)) == wanted
    assert rounded(index.scores(queries(spark))) == fresh(spark, changed, stem=stem)
    assert index.sync(docs(spark, changed)) == {"added": 0, "gone": 0}
    assert rounded(index.scores(queries(spark), section="x", pad=3)) == [r for r in fresh(spark, changed, stem=stem, pad=3) if r[1] == "x"]


def test_merge_keeps_what_is_in_force(spark, tmp_path):
    index, rows = SegmentIndex(spark, f"file://{tmp_path}/i", buckets=2), []
    for k in range(4):
        rows = [r for r in rows if r[1] % 5] + [(s, 100 * k + n, t) for s, n, t in made(k, 15)]
        index.sync(docs(spark, rows))
    assert len(index.state()[1]["segments"]) == 4 and index.merge(fan=3) >= 3 and len(index.state()[1]["segments"]) < 4
    assert rounded(index.scores(queries(spark))) == fresh(spark, rows)
    assert sorted(r.doc_id for r in index.documents().select("doc_id").collect()) == sorted(r[1] for r in rows)
    assert index.tidy(keep=1) > 0 and rounded(index.scores(queries(spark))) == fresh(spark, rows)


def test_small_change_writes_little_and_queries_read_some_folders(spark, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/i", buckets=32)
    rng = random.Random(4)
    rows = [("x", k, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(40))) for k in range(4000)]
    index.sync(docs(spark, rows))
    before = size(tmp_path)
    index.sync(docs(spark, rows + [("x", 10_000 + k, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(40))) for k in range(40)]))
    assert size(tmp_path) - before < 0.08 * before  # 1 % of the documents, and what each file costs by itself
    found = index.postings_of(spark.createDataFrame([("w1",), ("w2",)], "term string"))
    read = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert {f.split("bucket=")[1].split("/")[0] for f in read} <= {str(r[0]) for r in spark.createDataFrame([("w1",), ("w2",)], "term string").select(index.bucket(F.col("term"))).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(term" in plan or "In(term, [w1,w2])" in plan


def test_parameters_are_part_of_the_index(spark, tmp_path):
    rows = made(2, 20)
    SegmentIndex(spark, f"file://{tmp_path}/i", buckets=2).sync(docs(spark, rows))
    other = SegmentIndex(spark, f"file://{tmp_path}/i", stem=True, buckets=2)
    with pytest.raises(ValueError, match="empty"):
        other.scores(queries(spark))
    assert other.sync(docs(spark, rows))["added"] == 20
    assert rounded(other.scores(queries(spark))) == fresh(spark, rows, stem=True)


def test_log_commits_lose_nothing(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/l")
    assert log.state() == (0, {})

    def add(k):
        for n in range(5):
            log.change(lambda s: s | {f"{k}-{n}": 1})

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    number, state = log.state()
    assert number == 20 and len(state) == 20 and not log.commit(3, {}) and log.state(1)[0] == 1
    with pytest.raises(Conflict):
        log.commit = lambda *_: False
        log.change(lambda s: s | {"z": 1}, tries=2)
